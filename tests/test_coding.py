"""Golden bytes, round trips, malformed input and exactness of dictionary coding."""

import datetime as dt
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotgram.functions import codec, meta, slots, text, xz
from slotgram.functions.paths import checked
from slotgram.operators import corpus, grams, inspect, vocab
from slotgram.plans import api, registry
from slotgram.sources import files, layouts
from slotgram.streaming.counts import running_counts

VOCAB = {"the": 2, "ing": 3, "the ": 4}


@pytest.mark.parametrize(("given_", "hexed"), [("", ""), ("a", "61"), ("the", "010002"), ("the ", "010004"), ("the thing\x01é", "0100047468010003010001c3a9"), ("bathe", "6261010002"), ("inging", "010003010003"), ("\n\U0001f600the", "0af09f9880010002")])
def test_golden_streams(given_, hexed):
    assert codec.Encoder(VOCAB).encode(given_).hex() == hexed
    assert codec.Decoder(VOCAB).decode(bytes.fromhex(hexed)) == given_


def test_golden_codec_file():
    data = layouts.write_codec(list(VOCAB.items()))
    assert data.hex() == "4544414301010300020003746865030003696e6704000474686520"
    assert dict(layouts.read_codec(data)) == VOCAB


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\x01é\U0001f600", max_size=40), st.sets(st.text(alphabet="abé\x01", min_size=1, max_size=4), max_size=8))
def test_round_trip(value, tokens):
    known = {t: s for t, s in zip(sorted(tokens), (s for s in range(4096) if s >> 4 != 1 and s & 255 != 1 and s >> 8 != 1 and s & 15), strict=False)}
    data = codec.Encoder(known).encode(value)
    assert codec.Decoder(known).decode(data) == value
    parts, i = [], 0  # leftmost longest, by definition
    while i < len(value):
        best = max((t for t in known if value.startswith(t, i)), key=len, default=value[i])
        parts.append(best)
        i += len(best)
    assert [p for p, c in codec.Encoder(known).pieces(value) if c] == [p for p in parts if p in known]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab\x01é\U0001f600", max_size=40), max_size=6), st.sets(st.text(alphabet="abé\x01", min_size=1, max_size=4), max_size=8), st.sampled_from([0, 1 << 23]))
def test_batches_encode_as_single_texts(values, tokens, table):
    known = {t: s for t, s in zip(sorted(tokens), (s for s in range(4096) if s >> 4 != 1 and s & 255 != 1 and s >> 8 != 1 and s & 15), strict=False)}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(codec, "TABLE", table)
        many = codec.BatchEncoder(known)
    single, raw = codec.Encoder(known), [x.encode() for x in values]
    out, begins, used, chars = many.encode(np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64))
    pieces = [[p for p, c in single.pieces(x) if c] for x in values]
    assert [out[i:j].tobytes() for i, j in zip(begins[:-1], begins[1:], strict=True)] == [single.encode(x) for x in values]
    assert (used.tolist(), chars.tolist()) == ([len(p) for p in pieces], [sum(map(len, p)) for p in pieces])


@pytest.mark.parametrize("spoil", [lambda b: b[:-3], lambda b: b"XXXX" + b[4:], lambda b: b + b"x"])
def test_spoilt_archives(spoil):
    for data in (layouts.write_file_archive("en", "k=v", b"abc", 0), layouts.write_directory_archive("en", "k=v", [("b", b"2"), ("a", b"1")], 0)):
        with pytest.raises((layouts.LayoutError, ValueError)):
            list(layouts.read_archive(spoil(data))[2])


def test_archives():
    _, kind, rows = layouts.read_archive(layouts.write_directory_archive("en", "k=v", [("b", b"2"), ("a", b"1")], 0))
    assert (kind, list(rows)) == ("D", [(0, "eda_data.txt", b"k=v"), (1, "a", b"1"), (2, "b", b"2")])
    codec_, kind, rows = layouts.read_archive(layouts.write_file_archive("en", "k=v", b"abc", 0))
    assert (codec_, kind, list(rows)[1]) == ("en", "F", (1, "", b"abc"))
    with pytest.raises(layouts.LayoutError):
        layouts.write_file_archive("x" * 68, "", b"")
    assert xz.unpack(xz.pack(b"")) == b""


def test_small_streams_need_small_windows(monkeypatch):
    """Clearing tables for 16 MiB took 21 ms for each small text; the stream still names 16 MiB."""
    seen, compress = [], xz.lzma.compress
    monkeypatch.setattr(xz.lzma, "compress", lambda data, form, filters: seen.append(filters[0]["dict_size"]) or compress(data, form, filters=filters))
    for size in (0, 1, 2000, 65536, 65537, 300_000):
        data = random.Random(size).randbytes(size)
        for preset in (0, 1, 9):
            packed = xz.pack(data, preset)
            assert seen[-1] <= max(1 << 16, 2 * size) and seen[-1] >= size
            assert packed[:24] == compress(data, xz.lzma.FORMAT_XZ, filters=[{"id": xz.lzma.FILTER_LZMA2, "preset": preset, "dict_size": 16 << 20}])[:24]
            assert xz.unpack(packed) == data


def test_unsafe_paths():
    for path in ("/a", "../a", "a/../../b", "", "C:\\a"):
        with pytest.raises(ValueError, match="unsafe"):
            checked(path)


def test_text_predicate_borders(spark):
    rows = [(1, b""), (2, b"\0" + b"a" * 99), (3, b"\0\0" + b"a" * 98), (4, b"\x02" * 15 + b"a" * 85), (5, b"\x02" * 16 + b"a" * 84), (6, b"a" * 8192 + b"\0" * 9000), (7, None)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "id int, b binary").select("id", text.is_text(F.col("b"))).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: False}


def test_lenient_decoding(spark):
    rows = spark.createDataFrame([(b"41\xff42",), (b"a\r\nb\rc",), (None,)], "b binary")
    assert [r[0] for r in rows.select(text.decoded(F.col("b"))).collect()] == ["4142", "a\nb\nc", None]


def test_counts_and_levels(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc é\U0001f600") for _ in range(rng.randrange(60))) for _ in range(40)] + ["", None, "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter(t[i : i + n] for t in texts if t for n in range(2, 6) for i in range(len(t) - n + 1))
    assert dict(map(tuple, grams.count_grams(docs, 2, 5).collect())) == want
    assert {r["gram"]: r["n2"] for r in grams.explode_grams(docs, ["doc_id"], 2, 5).groupBy("gram").agg(F.count(F.lit(1)).alias("n2")).collect()} == want
    for k in (5, 50):
        full = grams.ranked(grams.count_grams(docs, 2, 5).where("cnt >= 2"), k).collect()
        assert [tuple(r) for r in grams.levelwise(docs, 2, 5, k, 2).collect()] == [tuple(r) for r in full]
    with pytest.raises(ValueError, match="shortest"):
        grams.count_grams(docs, 0, 3)


def test_partitioned_vocabulary(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aaaa bbbb", "cccc dddd eeee", "aaaa aaaa", "ffff", ""])], "doc_id long, text string")
    learned = vocab.train_partitioned(docs, 3, 2, 3, 1, slots=12).collect()
    assert len({r["slot"] for r in learned}) == len(learned) == 12
    assert len({r["token"] for r in learned}) == 12
    counts = dict(map(tuple, grams.count_grams(docs, 2, 3).collect()))
    parts = {r["doc_id"]: r["part"] for r in corpus.assign_groups(docs, 3).collect()}
    assert set(parts.values()) == {0, 1, 2}
    assert all(r["cnt"] <= counts[r["token"]] for r in learned)
    one = vocab.train_partitioned(docs, 1, 2, 3, 1, slots=12).collect()
    assert [tuple(r) for r in one] == sorted([tuple(r) for r in vocab.train(docs, 2, 3, 1, 12).collect()], key=lambda r: r[1])


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert vocab.train(docs).count() == 0
    assert grams.levelwise(docs, 3, 4, 5, 1).count() == 0
    assert codec.encode(docs, vocab.train(docs), ["doc_id"]).count() == 0


def test_duplicate_slots_are_refused(spark):
    with pytest.raises(ValueError, match="slot"):
        codec.vocab_map(spark.createDataFrame([("a", 2, 1), ("b", 2, 1)], vocab.SCHEMA))


def test_metadata(spark):
    row = spark.createDataFrame([("a=1\nb\n a = 2=3 ",)], "m string").select(meta.parse_meta(F.col("m"))).first()[0]
    assert row == {"a": "2=3"}


def test_pack_and_unpack(spark, tmp_path):
    source = tmp_path / "books"
    (source / "deep").mkdir(parents=True)
    contents = {"one.txt": "the thing\nthe sing" * 30, "deep/two.txt": "é the \x01 ring" * 30}
    for name, value in contents.items():
        (source / name).write_text(value)
    codecs = str(tmp_path / "codecs")
    api.train(spark, str(source), "en", codecs, min_freq=2, max_len=5)
    assert (tmp_path / "codecs/en.json").is_file()
    assert [r["codec"] for r in api.list_codecs(spark, codecs).collect()] == ["en"]
    archive = api.pack(spark, str(source), "en", str(tmp_path), codecs, 1)
    assert api.summarize(spark, archive).first()["entries"] == 2
    api.unpack(spark, archive, str(tmp_path / "out"), folder=codecs)
    assert {n: (tmp_path / "out/books" / n).read_text() for n in contents} == contents
    assert [r["path"] for r in api.list_entries(spark, archive).collect()] == ["deep/two.txt", "one.txt"]
    about = (tmp_path / "out/books/eda_data.txt").read_text()
    assert re.fullmatch(r"codec=en\nsource_name=books\nsource_type=directory\narchived_at=\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\n", about)
    single = api.pack(spark, str(source / "one.txt"), "en", str(tmp_path), codecs, 1)
    api.unpack(spark, single, str(tmp_path / "single"), folder=codecs)
    assert (tmp_path / "single/one.txt").read_text() == contents["one.txt"]
    assert single.endswith("one.txt.eda") and files.find_codec("en.edc", codecs) == files.find_codec("en", codecs)
    with pytest.raises(FileNotFoundError):
        files.find_codec("none", codecs)


def test_archive_entries_in_batches(spark, monkeypatch):
    """Entries of one archive leave in several batches, in order; one may be larger than a batch."""
    held = [(f"{i:02d}", bytes([i]) * (i * 40)) for i in range(12)]
    data = layouts.write_directory_archive("en", "k=v", held, 0)
    archives = spark.createDataFrame([("a.eda", data), ("b.eda", layouts.write_directory_archive("en", "", [], 0))], "path string, content binary")
    for limit in (1, 300, 1 << 20):
        monkeypatch.setattr(files, "BATCH_BYTES", limit)
        rows = files.archive_entries(archives).collect()
        assert [(r["ord"], r["path"], bytes(r["encoded"])) for r in rows if r["archive"] == "a.eda"] == [(0, "eda_data.txt", b"k=v"), *((i, p, x) for i, (p, x) in enumerate(held, 1))]
        assert [r["ord"] for r in rows if r["archive"] == "b.eda"] == [0]


def test_golden_file_archive(spark, tmp_path):
    """The bytes of a file archive's header, its ratio from the XZ stream alone, no collision of names,
    and several archives with codecs of their own."""
    (tmp_path / "codecs").mkdir()
    for name, known in (("X", VOCAB), ("Y", {"sing": 9})):
        (tmp_path / f"codecs/{name}.edc").write_bytes(layouts.write_codec(list(known.items())))
    for name in ("a.txt", "a.md"):
        (tmp_path / name).write_text("the sing " * 50 + name)
    at = dt.datetime(2026, 4, 26, 10, 0, 0)
    made = [api.pack(spark, str(tmp_path / f), c, str(tmp_path / "out"), str(tmp_path / "codecs"), 1, at=at) for f, c in (("a.txt", "X.edc"), ("a.md", "Y"))]
    assert made == [str(tmp_path / "out/a.txt.eda"), str(tmp_path / "out/a.md.eda")]
    data = (tmp_path / "out/a.txt.eda").read_bytes()
    about = b"codec=X\nsource_name=a.txt\nsource_type=file\nsource_extension=.txt\narchived_at=2026-04-26T10:00:00Z\n"
    encoded = codec.Encoder(VOCAB).encode("the sing " * 50 + "a.txt")
    assert data == bytes.fromhex("4544410101005846") + len(about).to_bytes(2, "little") + about + len(encoded).to_bytes(8, "little") + xz.pack(encoded, 1)
    assert layouts.read_header(data[: len(data) - 20]) == ("X", about, len(encoded), len(data) - len(xz.pack(encoded, 1)))
    seen = {r["codec"]: r for r in api.summarize(spark, str(tmp_path / "out")).collect()}
    assert (seen["X"]["payload_bytes"], seen["X"]["encoded_bytes"]) == (len(xz.pack(encoded, 1)), len(encoded))
    assert seen["X"]["percent"] == round(100 * len(xz.pack(encoded, 1)) / len(encoded), 1) and seen["X"]["encoded_size"] == "0.0 MB"
    api.unpack(spark, str(tmp_path / "out"), str(tmp_path / "back"), folder=str(tmp_path / "codecs"))
    for name in ("a.txt", "a.md"):
        assert (tmp_path / "back" / name).read_text() == (tmp_path / name).read_text()
    assert codec.Decoder({"x": 33}).decode(bytes.fromhex("010021")) == "x"


def test_hidden_and_empty_files(spark, tmp_path):
    source = tmp_path / "_books"
    contents = {"one.txt": "the thing", "_two.txt": "the sing", ".three": "the ring\n", "empty.txt": "", ".none": "", "__init__.py": "the = 1", "_deep/.er/four.txt": "the king", "_deep/empty": ""}
    for name, value in contents.items():
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_text(value)
    codecs = str(tmp_path / "codecs")
    assert {r["token"] for r in api.train(spark, str(source), "en", codecs, min_freq=5, max_len=3).collect()} == {"the", "he "}
    archive = api.pack(spark, str(source), "en", str(tmp_path), codecs, 1, strict=True)
    api.unpack(spark, archive, str(tmp_path / "out"), folder=codecs)
    out = tmp_path / "out/_books"
    assert {str(p.relative_to(out)): p.read_text() for p in out.rglob("*") if p.is_file() and not p.name.endswith(".crc") and p.name != "eda_data.txt"} == contents
    for name in (".three", "empty.txt"):
        single = api.pack(spark, str(source / name), "en", str(tmp_path / "files"), codecs, 1, strict=True)
        api.unpack(spark, single, str(tmp_path / "single"), folder=codecs)
        assert (tmp_path / "single" / name).read_text() == contents[name]
    assert {r["path"].rpartition("_books/")[2]: bytes(r["content"]).decode() for r in files.scan(spark, f"file://{source}").collect()} == contents


def top_grams(texts, k=3570):
    n = Counter(t[i : i + size] for t in texts for size in range(3, 17) for i in range(len(t) - size + 1))
    return sorted(((c, g) for g, c in n.items() if c >= 5), key=lambda x: (-x[0], len(x[1]), x[1]))[:k]


def test_production_vocabulary(spark, tmp_path):
    """The coding queries with 3,570 tokens of 3 to 16 characters, by brute force."""
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdeé\x01") for _ in range(rng.randrange(2, 9))) for _ in range(60)] + ["characteristically", "internationalization"]
    docs = [(i, "xyz"[i % 3], " ".join(rng.choice(words) for _ in range(rng.randrange(90)))) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    ids = [s for s in range(4096) if s >> 4 != 1 and s & 255 != 1 and s >> 8 != 1 and s & 15]
    known = {g: s for (_, g), s in zip(top_grams([t for *_, t in docs]), ids, strict=False)}
    assert len(known) == 3570 and {len(g) for g in known} == set(range(3, 17))
    pattern = re.compile("|".join(map(re.escape, sorted(known, key=len, reverse=True))) + "|.", re.S)
    code = lambda p: bytes((1, known[p] >> 4, known[p] & 15)) if p in known else b"\1\0\1" if p == "\1" else p.encode()
    enc = lambda t: b"".join(map(code, pattern.findall(t)))
    pieces, data = {i: pattern.findall(t) for i, _, t in docs}, {i: enc(t) for i, _, t in docs}
    uses = Counter(p for ps in pieces.values() for p in ps)
    by_lang = {x: [d for d in docs if d[1] == x] for x in "xyz"}
    cut = {i: t.replace(" ", "\1") for i, _, t in docs}
    longest = lambda t, i: max((t[i : i + n] for n in range(3, 17) if t[i : i + n] in known and i + n <= len(t)), key=len, default=None)
    tops = {x: top_grams([t for *_, t in d]) for x, d in by_lang.items()}
    want = {
        "encode_tokens": [(i, sum(p in known for p in ps), sum(len(p) for p in ps if p in known)) for i, ps in pieces.items()],
        "encode_size": [(i, len(t.encode()), len(data[i]), round(len(data[i]) / len(t.encode()), 6) if t else None) for i, _, t in docs],
        "encode_hex": [(i, x.hex().upper()) for i, x in data.items()],
        "encode_escape": [(i, hashlib.md5(enc(t).hex().upper().encode()).hexdigest(), t.count("\1")) for i, t in cut.items()],
        "decode_roundtrip": [(i, True, len(t)) for i, _, t in docs],
        "token_usage": [(g, s, uses[g]) for g, s in known.items()],
        "vocab_savings": [(g, uses[g] * (len(g.encode()) - 3)) for g in known],
        "match_longest_per_pos": [(i, k + 1, known[g], len(g.encode())) for i, _, t in docs for k in range(len(t)) if (g := longest(t, k))],
        "archive_directory": [(f"{x}.eda", n, f"doc/{i:012d}", len(data[i])) for x, d in by_lang.items() for n, (i, *_) in enumerate(d, 1)],
        "archive_summary": [(f"{x}.eda", f"c_{x}", "D", len(d), sum(len(data[i]) for i, *_ in d), f"c_{x}") for x, d in by_lang.items()],
        "vocab_json": [(str(s), g, "0x1") for g, s in known.items()],
        "codec_file_roundtrip": list(known.items()),
        "codec_catalog": [(x, len(top), sum(len(g.encode()) + 3 for _, g in top)) for x, top in tops.items()],
    }
    for name, rows in want.items():
        got = registry.QUERIES[f"{name}_full"](spark, str(tmp_path)).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows)), name


def test_streamed_counts(spark, tmp_path):
    rows = spark.createDataFrame([("abab",), ("bab",), (None,)], "text string")
    for i in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_counts(stream, 2, 2).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert dict(map(tuple, spark.table("counts").collect())) == {"ab": 6, "ba": 4}


def test_slots(spark):
    found = [r["slot"] for r in slots.slot_space(spark).orderBy("slot").collect()]
    assert (len(found), found[0], found[-1]) == (3570, 2, 4095)
    assert sum(r["slot_count"] for r in slots.quotas(spark, 7).collect()) == 3570


def _brute_grams(rows, lo, hi, k, min_freq):
    by = {}
    for group, t in rows:
        for n in range(lo, hi + 1):
            by.setdefault(group, Counter()).update(t[i : i + n] for i in range(len(t or "") - n + 1))
    order = lambda r: (-r[1], len(r[0]), r[0])
    return Counter((group, *r) for group, x in by.items() for r in sorted((r for r in x.items() if r[1] >= min_freq), key=order)[:k])


@pytest.mark.parametrize(("lo", "hi", "k", "min_freq"), [(3, 16, 50, 5), (1, 8, 300, 1), (3, 16, 5000, 2), (4, 6, 20, 2)])
def test_levelwise_by_group(spark, lo, hi, k, min_freq):
    """The best grams of each group, also of null."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdé \U0001f600") for _ in range(r.randint(1, 5))) for _ in range(30)]
    rows = [(r.choice(["a", "b", None]), r.choice([None, "", "ab", " ".join(r.choice(words) for _ in range(r.randint(1, 60)))])) for _ in range(90)] + [("z", "x"), ("y", None)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert Counter(map(tuple, grams.levelwise(docs, lo, hi, k, min_freq, ["lang"]).collect())) == _brute_grams(rows, lo, hi, k, min_freq)
    assert Counter((None, *x) for x in grams.levelwise(docs, lo, hi, k, min_freq).collect()) == _brute_grams([(None, t) for _, t in rows], lo, hi, k, min_freq)


def test_places_and_sums(monkeypatch):
    """Sorted tables find what dense ones find; rows that leave early sum up to the same."""
    numbers, asked = np.array([1, 4, 7]), np.arange(9)
    assert grams._Table(numbers, 9, 9).find(asked).tolist() == grams._Table(numbers, 9, 0).find(asked).tolist() == [-1, 0, -1, -1, 1, -1, -1, 2, -1]
    monkeypatch.setattr(grams, "HELD", 10)
    sums, want, got = grams._Sums(), Counter(), Counter()
    for i in range(40):
        keys = np.arange(i % 7, 20)
        want.update({(i % 3, int(x)): i for x in keys})
        for b in sums.add(i % 3, keys, np.full(len(keys), i)):
            got.update({(r["g"], r["key"]): r["cnt"] for r in b.to_pylist()})
    for b in sums.rows():
        got.update({(r["g"], r["key"]): r["cnt"] for r in b.to_pylist()})
    assert got == want


def test_levelwise_reads_the_texts_a_few_times(spark):
    """Once for each length was 14 times."""
    docs, seen = registry.documents(spark, "/root/testdata/sf0.001").select("text"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    grams.levelwise(docs.mapInArrow(counted, "text string"), 3, 16, 500, 5)
    assert 2 * docs.count() <= seen.value <= 7 * docs.count()


@pytest.mark.parametrize(("lo", "hi", "k"), [(3, 6, 40), (2, 4, 300), (1, 2, 300)])
def test_few_grams_are_counted_in_two_reads(spark, lo, hi, k):
    """Once for each length was four times for 3 to 6 characters; no pair spans two texts."""
    r, seen = random.Random(8), spark.sparkContext.accumulator(0)
    rows = [(r.choice(["a", "b"]), "".join(r.choice("abcé\U0001f600") for _ in range(r.choice([0, 1, 2, 3, 7, 40])))) for _ in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    read = docs.select("text").mapInArrow(counted, "text string")
    assert Counter((None, *x) for x in grams.levelwise(read, lo, hi, k, 2).collect()) == _brute_grams([(None, t) for _, t in rows], lo, hi, k, 2)
    assert seen.value <= 2 * len(rows)
    assert Counter(map(tuple, grams.levelwise(docs, lo, hi, k, 2, ["lang"]).collect())) == _brute_grams(rows, lo, hi, k, 2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab\x01é", max_size=60) | st.integers(0, 60).map(lambda n: "a" * n), max_size=6), st.sets(st.text(alphabet="abé", min_size=3, max_size=7), max_size=8), st.sampled_from([1, 100]), st.sampled_from([1, 30, 1 << 21]))
def test_long_tokens_encode_as_in_single_texts(values, tokens, rounds, leads):
    """Tokens that hold their code, long runs of overlapping ones, and first depths by a table."""
    known = {t: s for t, s in zip(sorted(tokens), (s for s in range(4096) if s >> 4 != 1 and s & 255 != 1 and s >> 8 != 1 and s & 15), strict=False)}
    raw, single = [x.encode() for x in values], codec.Encoder(known)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(codec, "ROUNDS", rounds)
        m.setattr(codec, "LEADS", leads)
        out, begins, used, chars = codec.BatchEncoder(known).encode(np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64))
    pieces = [[p for p, c in single.pieces(x) if c] for x in values]
    assert [out[i:j].tobytes() for i, j in zip(begins[:-1], begins[1:], strict=True)] == [single.encode(x) for x in values]
    assert (used.tolist(), chars.tolist()) == ([len(p) for p in pieces], [sum(map(len, p)) for p in pieces])


def test_file_archives_are_summarised_in_one_pass(spark):
    """Archives were written, read twice, grouped and joined."""
    found = registry.archive_file_summary(spark, "/root/testdata/sf0.001", learn=lambda _: spark.createDataFrame([("the", 2)], "token string, slot int"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Aggregate" not in plan
    assert found.where("payload_ok").count() == 200
    made = spark.createDataFrame([("f", layouts.write_file_archive("en", "k=v", b"abc", 0)), ("d", layouts.write_directory_archive("en", "codec=en", [("b", b"22"), ("a", b"1")], 0)), ("e", layouts.write_directory_archive("en", "", [], 0))], "path string, content binary")
    grouped = {tuple(r) for r in inspect.summary(files.archive_entries(made, content=False)).select("archive", "codec", "entry_type", "entries", "encoded_bytes", "meta_text").collect()}
    heads = inspect.summary_of_heads(files.archive_heads(made)).join(made, F.col("archive") == F.col("path"))
    assert {tuple(r)[:6] for r in heads.drop("meta").collect()} == grouped and len(grouped) == 3
    assert heads.where("archive_bytes = length(content)").count() == 3
    assert files.archive_heads(made.limit(0)).count() == 0
