"""Queries of the dictionary-coding operators, with the SQL that checks them.

All run over whole tables and whole texts.  Edge cases that the tables lack (CR, NUL, 0x01,
malformed streams) are injected in the query and in its SQL alike.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotgram.functions import codec, meta, slots, text, xz
from slotgram.operators import corpus, grams, inspect, positions, vocab
from slotgram.scratch import written
from slotgram.sources import files, layouts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

GROUPS, TOP, SMALL_K, MIN_FREQ, FULL_HI = 4, 100, 256, 5, 16


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- SQL building blocks -----------------------------------------------------

VALID = "(s >> 4) <> 1 AND (s & 255) <> 1 AND (s >> 8) <> 1 AND (s & 15) <> 0"
SLOTS_SQL = f"SELECT CAST(s AS INTEGER) AS slot, CAST(row_number() OVER (ORDER BY s) AS INTEGER) AS slot_rank FROM range(4096) t(s) WHERE {VALID}"
CHARS = "(SELECT doc_id, lang, strlen(text) AS bytes, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS pos FROM documents WHERE length(text) > 0)"


def grams_sql(lo: int, hi: int, columns: str = "doc_id") -> str:
    leads = "".join(f", lead(ch, {k}) OVER w AS c{k}" for k in range(1, hi))
    each = ", ".join(f"{{'n': {n}, 'gram': {' || '.join(['ch', *(f'c{k}' for k in range(1, n))])}}}" for n in range(lo, hi + 1))
    return f"SELECT {columns}, u.n AS n, pos, u.gram AS gram FROM (SELECT {columns}, pos, unnest([{each}]) AS u FROM (SELECT *{leads} FROM {CHARS} WINDOW w AS (PARTITION BY doc_id ORDER BY pos))) WHERE u.gram IS NOT NULL"


def counts_sql(lo: int, hi: int) -> str:
    return f"SELECT gram, count(*) AS cnt FROM ({grams_sql(lo, hi)}) GROUP BY gram"


ORDER = "ORDER BY cnt DESC, length(gram), gram"


def vocab_sql(lo: int, hi: int, k: int) -> str:
    top = f"SELECT gram, cnt, row_number() OVER ({ORDER}) AS slot_rank FROM (SELECT * FROM ({counts_sql(lo, hi)}) WHERE cnt >= {MIN_FREQ} {ORDER} LIMIT {k})"
    return f"SELECT gram AS token, slot, cnt FROM ({top}) JOIN ({SLOTS_SQL}) USING (slot_rank)"


SIZED = f"SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, CAST((row_number() OVER (ORDER BY strlen(text) DESC, doc_id) - 1) % {GROUPS} AS INTEGER) AS part FROM documents"
WITH_VOCAB = f"WITH v AS MATERIALIZED ({vocab_sql(3, 6, SMALL_K)}), p AS (SELECT '(?s)' || string_agg(regexp_escape(token), '|' ORDER BY length(token) DESC, token) || '|.' AS re FROM v)"


def pieces_sql(source: str = "documents", extra: str = "") -> str:
    return f"{WITH_VOCAB}, e AS (SELECT doc_id, text, generate_subscripts(ps, 1) AS k, unnest(ps) AS piece FROM (SELECT doc_id, text, regexp_extract_all(text, re, 0) AS ps FROM {source}, p)), j AS (SELECT e.*, slot, CASE WHEN slot IS NOT NULL THEN '01' || printf('%02X', slot >> 4) || printf('%02X', slot & 15) WHEN piece = chr(1) THEN '010001' ELSE hex(encode(piece)) END AS code FROM e LEFT JOIN v ON token = piece) {extra}"


def small_vocab(docs: DataFrame) -> DataFrame:
    return vocab.train(docs, 3, 6, MIN_FREQ, SMALL_K)


def full_vocab(docs: DataFrame) -> DataFrame:
    """The vocabulary that ``vocab.train`` learns by default."""
    return vocab.train(docs, 3, FULL_HI, MIN_FREQ)


# --- slots -------------------------------------------------------------------


@query(SLOTS_SQL)
def slot_space(spark, sf_dir):
    return slots.slot_space(spark)


RULES = {"high_byte_is_flag": "(s >> 4) = 1", "low_byte_is_flag": "(s & 255) = 1", "high_nibble_is_one": "(s >> 8) = 1", "low_nibble_is_zero": "(s & 15) = 0"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS ids FROM range(4096) t(s) WHERE {v}" for k, v in RULES.items()))
def slot_exclusions(spark, sf_dir):
    rules = slots.broken_rules(F.col("id").cast("int"))
    one = spark.range(slots.SPACE, numPartitions=1).select(F.array(*[F.when(v, k) for k, v in rules.items()]).alias("broken"))
    return one.select(F.explode("broken").alias("rule")).where("rule is not null").groupBy("rule").agg(F.count(F.lit(1)).alias("ids"))


@query(f"SELECT slot, CAST(slot >> 4 AS INTEGER) AS high, CAST(slot & 15 AS INTEGER) AS low, slot AS back FROM ({SLOTS_SQL})")
def slot_bytes(spark, sf_dir):
    high, low = slots.slot_bytes(F.col("slot"))
    return slots.slot_space(spark).select("slot", high.alias("high"), low.alias("low"), slots.slot_of(high, low).alias("back"))


@query("SELECT CAST(n AS INTEGER) AS parts, CAST(p AS INTEGER) AS part, CAST(p * (3570 // n) AS INTEGER) AS slot_start, CAST(CASE WHEN p = n - 1 THEN 3570 - (3570 // n) * (n - 1) ELSE 3570 // n END AS INTEGER) AS slot_count FROM range(1, 9) a(n), range(8) b(p) WHERE p < n")
def slot_quotas(spark, sf_dir):
    out = None
    for n in range(1, 9):
        rows = slots.quotas(spark, n).select(F.lit(n).alias("parts"), "*")
        out = rows if out is None else out.union(rows)
    return out


# --- corpus ------------------------------------------------------------------


@query("SELECT lang, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def corpus_profile(spark, sf_dir):
    return corpus.profile(documents(spark, sf_dir))


@query(SIZED)
def corpus_group_assign(spark, sf_dir):
    return corpus.assign_groups(documents(spark, sf_dir), GROUPS)


@query(f"SELECT part, count(*) AS docs, CAST(sum(bytes) AS BIGINT) AS bytes FROM ({SIZED}) GROUP BY part")
def corpus_group_balance(spark, sf_dir):
    return corpus.assign_groups(documents(spark, sf_dir), GROUPS).groupBy("part").agg(F.count(F.lit(1)).alias("docs"), F.sum("bytes").alias("bytes"))


@query(r"SELECT doc_id, CAST(length(t) AS BIGINT) AS chars, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(replace(replace(text, '. ', '.' || chr(13) || chr(10)), ', ', ',' || chr(13)), '\r\n?', chr(10), 'g') AS t FROM documents)")
def newline_normalize(spark, sf_dir):
    injected = F.replace(F.replace("text", F.lit(". "), F.lit(".\r\n")), F.lit(", "), F.lit(",\r"))
    t = text.newlines(injected)
    return documents(spark, sf_dir).select("doc_id", F.length(t).cast("long").alias("chars"), F.md5(t).alias("digest"))


def predicate_sql(content: str) -> str:
    sample = f"upper(hex({content}))[1:16384]"
    printable = "len(list_filter(regexp_extract_all(h, '[0-9A-F]{2}'), lambda x: x >= '80' OR (x >= '20' AND x <= '7E') OR (x >= '09' AND x <= '0D')))"
    nul = "len(list_filter(regexp_extract_all(h, '[0-9A-F]{2}'), lambda x: x = '00'))"
    ratios = f"SELECT doc_id, length(h) // 2 AS sample, {nul} / nullif(length(h) / 2, 0) AS nul_ratio, {printable} / nullif(length(h) / 2, 0) AS printable_ratio FROM (SELECT doc_id, {sample} AS h FROM documents)"
    return f"SELECT doc_id, CAST(sample AS INTEGER) AS sample, round(nul_ratio, 9) AS nul_ratio, round(printable_ratio, 9) AS printable_ratio, coalesce(sample > 0 AND nul_ratio <= 0.01 AND printable_ratio >= 0.85, false) AS is_text FROM ({ratios})"


def predicate_rows(docs: DataFrame, content) -> DataFrame:
    n, nul, printable = text.sample_ratios(content)
    return docs.select("doc_id", n.alias("sample"), F.round(nul, 9).alias("nul_ratio"), F.round(printable, 9).alias("printable_ratio"), text.is_text(content).alias("is_text"))


@query(predicate_sql("encode(text)"))
def text_predicate(spark, sf_dir):
    return predicate_rows(documents(spark, sf_dir), F.encode("text", "UTF-8"))


@query(predicate_sql("encode(replace(text, 'q', chr(0)))"))
def text_predicate_injected(spark, sf_dir):
    return predicate_rows(documents(spark, sf_dir), F.encode(F.replace("text", F.lit("q"), F.lit("\x00")), "UTF-8"))


# --- grams -------------------------------------------------------------------


@query(f"SELECT gram, cnt FROM ({counts_sql(3, 3)}) {ORDER} LIMIT {TOP}")
def gram3_topk(spark, sf_dir):
    return grams.ranked(grams.count_grams(documents(spark, sf_dir), 3, 3), TOP)


@query(f"SELECT CAST(length(gram) AS INTEGER) AS n, count(*) AS grams, CAST(sum(cnt) AS BIGINT) AS total FROM ({counts_sql(3, 6)}) WHERE cnt >= {MIN_FREQ} GROUP BY length(gram)")
def gram_min_freq(spark, sf_dir):
    kept = grams.count_grams(documents(spark, sf_dir), 3, 6).where(F.col("cnt") >= MIN_FREQ)
    return kept.groupBy(F.length("gram").alias("n")).agg(F.count(F.lit(1)).alias("grams"), F.sum("cnt").alias("total"))


@query(f"SELECT CAST(length(gram) AS INTEGER) AS n, count(*) AS distinct_grams, CAST(sum(cnt) AS BIGINT) AS total FROM ({counts_sql(3, 6)}) GROUP BY length(gram)")
def gram_by_length(spark, sf_dir):
    return grams.count_grams(documents(spark, sf_dir), 3, 6).groupBy(F.length("gram").alias("n")).agg(F.count(F.lit(1)).alias("distinct_grams"), F.sum("cnt").alias("total"))


@query(f"SELECT lang, gram, cnt FROM (SELECT *, row_number() OVER (PARTITION BY lang {ORDER}) AS r FROM (SELECT lang, gram, count(*) AS cnt FROM ({grams_sql(3, 3, 'lang')}) GROUP BY lang, gram)) WHERE r <= 20")
def gram_by_lang_topk(spark, sf_dir):
    counts = grams.count_grams(documents(spark, sf_dir), 3, 3, ["lang"])
    order = Window.partitionBy("lang").orderBy(F.desc("cnt"), F.length("gram"), "gram")
    return counts.withColumn("r", F.row_number().over(order)).where("r <= 20").drop("r")


@query(f"SELECT gram, count(DISTINCT part) AS parts, count(*) AS cnt FROM ({grams_sql(3, 3)}) JOIN ({SIZED}) USING (doc_id) GROUP BY gram")
def gram_merge(spark, sf_dir):
    docs = documents(spark, sf_dir)
    grouped = docs.join(corpus.assign_groups(docs, GROUPS).select("doc_id", "part"), "doc_id")
    counts = grams.count_grams(grouped, 3, 3, ["part"])
    return counts.groupBy("gram").agg(F.count(F.lit(1)).alias("parts"), F.sum("cnt").alias("cnt"))


@query(f"SELECT gram, s.doc_id AS doc_id, CAST(s.pos AS INTEGER) AS pos FROM (SELECT gram, min({{'bytes': -bytes, 'doc_id': doc_id, 'n': n, 'pos': pos}}) AS s FROM ({grams_sql(3, 3, 'doc_id, bytes')}) GROUP BY gram)")
def gram_first_seen(spark, sf_dir):
    rows = grams.explode_grams(documents(spark, sf_dir).withColumn("bytes", -F.octet_length("text")), ["bytes", "doc_id"], 3, 3)
    return rows.groupBy("gram").agg(F.min(F.struct("bytes", "doc_id", "n", "pos")).alias("s")).select("gram", "s.doc_id", "s.pos")


@query(f"SELECT * FROM (SELECT * FROM ({counts_sql(3, 8)}) WHERE cnt >= {MIN_FREQ}) {ORDER} LIMIT {slots.SLOTS}")
def gram_levelwise_topk(spark, sf_dir):
    return grams.levelwise(documents(spark, sf_dir), 3, 8, slots.SLOTS, MIN_FREQ)


# --- vocabularies ------------------------------------------------------------


@query(vocab_sql(3, FULL_HI, slots.SLOTS))
def vocab_global(spark, sf_dir):
    return vocab.train(documents(spark, sf_dir), 3, FULL_HI, MIN_FREQ)


def partitioned_sql(parts: int, lo: int, hi: int) -> str:
    """Part after part: up to its share and what earlier ones left, of grams not yet taken."""
    base, step = slots.SLOTS // parts, []
    for p in range(parts + 1):
        seen = " UNION ALL ".join(f"SELECT gram FROM t{q}" for q in range(p)) or "SELECT '' WHERE false"
        rows = f"SELECT gram, cnt FROM g WHERE part = {p}" if p < parts else "SELECT gram, CAST(sum(cnt) AS BIGINT) AS cnt FROM g GROUP BY gram"
        upto = base * (p + 1) if p + 1 < parts else slots.SLOTS
        step.append(f"t{p} AS MATERIALIZED (SELECT *, {p} AS step FROM (SELECT *, row_number() OVER ({ORDER}) AS r FROM ({rows}) WHERE gram NOT IN ({seen})) WHERE r <= {upto} - (SELECT count(*) FROM ({seen})))")
    counts = f"g AS MATERIALIZED (SELECT part, gram, count(*) AS cnt FROM ({grams_sql(lo, hi)}) JOIN ({SIZED}) USING (doc_id) GROUP BY part, gram HAVING count(*) >= {MIN_FREQ})"
    taken = " UNION ALL ".join(f"SELECT * FROM t{p}" for p in range(parts + 1))
    return f"WITH {counts}, {', '.join(step)} SELECT gram AS token, slot, cnt FROM (SELECT gram, cnt, row_number() OVER (ORDER BY step, r) AS slot_rank FROM ({taken})) JOIN ({SLOTS_SQL}) USING (slot_rank)"


@query(partitioned_sql(GROUPS, 3, 4))
def vocab_partitioned(spark, sf_dir):
    return vocab.train_partitioned(documents(spark, sf_dir), GROUPS, 3, 4, MIN_FREQ)


@query(f"SELECT CAST(slot AS VARCHAR) AS slot, token, '0x1' AS flag_byte FROM ({vocab_sql(3, 6, SMALL_K)})")
def vocab_json(spark, sf_dir, learn=small_vocab):
    return vocab.vocab_json(learn(documents(spark, sf_dir)))


# --- coding ------------------------------------------------------------------


@query(f"{pieces_sql()} SELECT doc_id, count(slot) AS tokens, CAST(coalesce(sum(length(piece)) FILTER (slot IS NOT NULL), 0) AS BIGINT) AS matched_chars FROM j GROUP BY doc_id")
def encode_tokens(spark, sf_dir, learn=small_vocab):
    docs = documents(spark, sf_dir)
    return codec.encode(docs, learn(docs), ["doc_id"]).select("doc_id", "tokens", "matched_chars")


@query(f"{pieces_sql()} SELECT doc_id, any_value(CAST(strlen(text) AS BIGINT)) AS raw_bytes, CAST(sum(length(code) // 2) AS BIGINT) AS enc_bytes, round(sum(length(code) // 2) / any_value(strlen(text)), 6) AS ratio FROM j GROUP BY doc_id")
def encode_size(spark, sf_dir, learn=small_vocab):
    docs = documents(spark, sf_dir)
    return codec.encode(docs, learn(docs), ["doc_id"]).select("doc_id", "raw_bytes", "enc_bytes", F.round(F.try_divide("enc_bytes", "raw_bytes"), 6).alias("ratio"))


@query(f"{pieces_sql()} SELECT doc_id, string_agg(code, '' ORDER BY k) AS encoded FROM j GROUP BY doc_id")
def encode_hex(spark, sf_dir, learn=small_vocab):
    docs = documents(spark, sf_dir)
    return codec.encode(docs, learn(docs), ["doc_id"]).select("doc_id", F.hex("encoded").alias("encoded"))


@query(f"{pieces_sql('(SELECT doc_id, replace(text, chr(32), chr(1)) AS text FROM documents)')} SELECT doc_id, md5(string_agg(code, '' ORDER BY k)) AS digest, count(*) FILTER (piece = chr(1)) AS escapes FROM j GROUP BY doc_id")
def encode_escape(spark, sf_dir, learn=small_vocab):
    docs = documents(spark, sf_dir)
    injected = docs.select("doc_id", F.replace("text", F.lit(" "), F.lit("\x01")).alias("text"))
    escapes = F.regexp_count("text", F.lit("\x01")).cast("long")
    return codec.encode(injected.withColumn("escapes", escapes), learn(docs), ["doc_id", "escapes"]).select("doc_id", F.md5(F.hex("encoded")).alias("digest"), "escapes")


@query("SELECT doc_id, true AS ok, CAST(length(text) AS BIGINT) AS chars FROM documents")
def decode_roundtrip(spark, sf_dir, learn=small_vocab):
    docs = documents(spark, sf_dir)
    learned = learn(docs)
    back = codec.decode(codec.encode(docs, learned, ["doc_id", "text"]).withColumnRenamed("text", "original"), learned, ["doc_id", "original"])
    return back.select("doc_id", F.col("original").eqNullSafe(F.col("text")).alias("ok"), F.length("text").cast("long").alias("chars"))


MALFORMED = {"": "", "01": "01", "0102": "0102", "01FF0F": "01EFBFBD0F", "010001": "01", "0100": "0100", "010002": "746865", "610100026201": "617468656201", "01000201": "74686501", "010108": "010108"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in MALFORMED.items()) + ") t(encoded, decoded)")
def decode_malformed(spark, sf_dir):
    rows = spark.createDataFrame([(k, bytes.fromhex(k)) for k in MALFORMED], "hex string, encoded binary")
    known = spark.createDataFrame([("the", 2, 1)], vocab.SCHEMA)
    return codec.decode(rows, known, ["hex"]).select(F.col("hex").alias("encoded"), F.hex(F.encode("text", "UTF-8")).alias("decoded"))


@query(f"WITH v AS MATERIALIZED ({vocab_sql(3, 6, SMALL_K)}) SELECT doc_id, CAST(pos AS INTEGER) AS pos, arg_max(slot, strlen(gram)) AS slot, CAST(max(strlen(gram)) AS INTEGER) AS token_bytes FROM ({grams_sql(3, 6)}) JOIN v ON gram = token GROUP BY doc_id, pos")
def match_longest_per_pos(spark, sf_dir, learn=small_vocab):
    docs = documents(spark, sf_dir)
    return positions.longest_matches(docs, learn(docs))


@query(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(sum(strlen(gram)) OVER (PARTITION BY doc_id ORDER BY pos) - strlen(gram) AS BIGINT) AS byte_offset FROM ({grams_sql(1, 1)})")
def byte_offsets(spark, sf_dir):
    return positions.byte_offsets(documents(spark, sf_dir))


@query(f"{pieces_sql()} SELECT token, slot, count(piece) AS uses FROM v LEFT JOIN e ON piece = token GROUP BY token, slot")
def token_usage(spark, sf_dir, learn=small_vocab):
    docs = documents(spark, sf_dir)
    learned = learn(docs)
    return learned.join(codec.tokens_used(docs, learned), "token", "left").select("token", "slot", F.coalesce("uses", F.lit(0)).alias("uses"))


@query(f"{pieces_sql()} SELECT token, CAST(count(piece) * (strlen(token) - 3) AS BIGINT) AS saved_bytes FROM v LEFT JOIN e ON piece = token GROUP BY token")
def vocab_savings(spark, sf_dir, learn=small_vocab):
    return token_usage(spark, sf_dir, learn).select("token", (F.col("uses") * (F.octet_length("token") - 3)).alias("saved_bytes"))


# --- metadata, names, archives -----------------------------------------------

_META = [("en", "notes", True, None, "2024-01-02 03:04:05"), ("de", "brief", False, ".txt", "2024-12-31 23:59:59"), ("fr", "a=b", False, "", "2000-02-29 00:00:00")]


@query("""SELECT name, 'codec=' || codec || chr(10) || 'source_name=' || name || chr(10) || 'source_type=' || CASE WHEN d THEN 'directory' ELSE 'file' || chr(10) || 'source_extension=' || ext END || chr(10) || 'archived_at=' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || chr(10) AS meta
FROM (VALUES ('en', 'notes', true, NULL, TIMESTAMP '2024-01-02 03:04:05'), ('de', 'brief', false, '.txt', TIMESTAMP '2024-12-31 23:59:59'), ('fr', 'a=b', false, '', TIMESTAMP '2000-02-29 00:00:00')) t(codec, name, d, ext, ts)""")
def meta_build(spark, sf_dir):
    rows = spark.createDataFrame(_META, "codec string, name string, d boolean, ext string, at string")
    return rows.select("name", meta.build_meta(F.col("codec"), F.col("name"), F.col("d"), F.col("ext"), F.to_timestamp_ntz("at")).alias("meta"))


@query("SELECT doc_id, CAST(t // 10 AS VARCHAR) || '.' || CAST(t % 10 AS VARCHAR) || ' MB' AS size FROM (SELECT doc_id, (strlen(text) * 1000 + 50000) // 100000 AS t FROM documents)")
def human_sizes(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", meta.megabytes(F.octet_length("text").cast("long") * 1000).alias("size"))


@query("SELECT * FROM (VALUES (1, 'codec', 'en'), (1, 'name', 'a=b'), (2, 'k', 'last'), (2, 'x', '')) t(id, key, value)")
def meta_parse(spark, sf_dir):
    rows = spark.createDataFrame([(1, "codec = en\nno pair\nname=a=b"), (2, "k=first\r\nk= last \nx="), (3, "")], "id int, meta string")
    return rows.select("id", F.explode(meta.parse_meta(F.col("meta"))))


def archived(spark, sf_dir, learn=small_vocab) -> DataFrame:
    """Entries, without their contents, after documents were encoded, packed as one directory
    archive per language, and read again."""
    docs = documents(spark, sf_dir)
    encoded = codec.encode(docs, learn(docs), ["doc_id", "lang"])
    rows = encoded.select(F.concat("lang", F.lit(".eda")).alias("archive"), F.concat(F.lit("c_"), "lang").alias("codec"), F.concat(F.lit("codec=c_"), "lang").alias("meta"), F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), "encoded")
    return files.archive_entries(files.pack_directories(rows, 1).withColumnRenamed("archive", "path"), content=False)


@query(f"{pieces_sql()}, s AS (SELECT doc_id, CAST(sum(length(code) // 2) AS BIGINT) AS enc_size FROM j GROUP BY doc_id) SELECT lang || '.eda' AS archive, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INTEGER) AS ord, 'doc/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, enc_size FROM s JOIN documents USING (doc_id)")
def archive_directory(spark, sf_dir, learn=small_vocab):
    return archived(spark, sf_dir, learn).where("ord > 0").select("archive", "ord", "path", "enc_size")


@query(f"{pieces_sql()}, s AS (SELECT doc_id, sum(length(code) // 2) AS enc_size FROM j GROUP BY doc_id) SELECT lang || '.eda' AS archive, 'c_' || lang AS codec, 'D' AS entry_type, count(*) AS entries, CAST(sum(enc_size) AS BIGINT) AS encoded_bytes, 'c_' || lang AS meta_codec FROM s JOIN documents USING (doc_id) GROUP BY lang")
def archive_summary(spark, sf_dir, learn=small_vocab):
    return inspect.summary(archived(spark, sf_dir, learn)).withColumn("meta_codec", F.col("meta")["codec"]).drop("meta", "meta_text")


@query(f"{pieces_sql()}, s AS (SELECT doc_id, CAST(sum(length(code) // 2) AS BIGINT) AS enc_size FROM j GROUP BY doc_id) SELECT CAST(doc_id AS VARCHAR) || '.txt.eda' AS archive, 'c' AS codec, 'F' AS entry_type, 1 AS entries, enc_size AS encoded_bytes, CAST(doc_id AS VARCHAR) || '.txt' AS source_name, true AS payload_ok FROM s")
def archive_file_summary(spark, sf_dir, learn=small_vocab):
    """One file archive for each document, summarised from headers alone."""
    docs = documents(spark, sf_dir).withColumn("name", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    described = meta.build_meta(F.lit("c"), F.col("name"), F.lit(False), F.lit(".txt"), F.to_timestamp_ntz(F.lit("2024-01-02 03:04:05")))
    rows = docs.select(meta.packed_name(F.col("name")).alias("archive"), F.lit("c").alias("codec"), described.alias("meta"), "text")
    heads = codec.encode(rows, learn(docs), ["archive", "codec", "meta"], then=lambda encoded: files.heads(files.packed(encoded, 1)), schema=files.HEAD)
    found = inspect.summary_of_heads(written(heads, "archive-heads"))
    header = F.lit(4 + 2 + 1 + 1 + 2 + 8) + F.octet_length("meta_text")
    return found.select("archive", "codec", "entry_type", "entries", "encoded_bytes", F.col("meta")["source_name"].alias("source_name"), (F.col("payload_bytes") == F.col("archive_bytes") - header).alias("payload_ok"))


@query("SELECT doc_id, true AS ok FROM documents")
def archive_xz_roundtrip(spark, sf_dir):
    raw = F.encode("text", "UTF-8")
    return documents(spark, sf_dir).select("doc_id", (xz.decompress(xz.compress(raw, 1)) == raw).alias("ok"))


@query(f"SELECT token, slot FROM ({vocab_sql(3, 6, SMALL_K)})")
def codec_file_roundtrip(spark, sf_dir, learn=small_vocab):
    """Through the bytes of a codec file."""
    entries = list(codec.vocab_map(learn(documents(spark, sf_dir))).items())
    return spark.createDataFrame(layouts.read_codec(layouts.write_codec(entries)), "token string, slot int")


@query(f"SELECT lang AS codec, count(*) AS tokens, CAST(sum(strlen(gram) + 3) AS BIGINT) AS entry_bytes FROM (SELECT *, row_number() OVER (PARTITION BY lang {ORDER}) AS r FROM (SELECT lang, gram, count(*) AS cnt FROM ({grams_sql(3, 4, 'lang')}) GROUP BY lang, gram HAVING count(*) >= {MIN_FREQ})) WHERE r <= {SMALL_K} GROUP BY lang")
def codec_catalog(spark, sf_dir, hi=4, k=SMALL_K):
    top = grams.levelwise(documents(spark, sf_dir), 3, hi, k, MIN_FREQ, ["lang"])
    return vocab.catalog(top.select(F.col("lang").alias("codec"), F.col("gram").alias("token")))


@query("SELECT archive, coalesce(override, stored) AS codec, tokens FROM (VALUES ('a', 'en', NULL), ('b', 'en', 'de'), ('c', 'none', NULL)) t(archive, stored, override) LEFT JOIN (VALUES ('en', 10), ('de', 20)) c(name, tokens) ON name = coalesce(override, stored)")
def codec_resolve(spark, sf_dir):
    archives = spark.createDataFrame([("a", "en", None), ("b", "en", "de"), ("c", "none", None)], "archive string, stored string, override string")
    known = spark.createDataFrame([("en", 10), ("de", 20)], "name string, tokens int")
    wanted = F.coalesce("override", "stored")
    return archives.join(F.broadcast(known), F.col("name") == wanted, "left").select("archive", wanted.alias("codec"), "tokens")


@query("SELECT * FROM (VALUES ('x/books.eda', 'books', 'x/books.eda.eda'), ('note.eda', 'letter.txt', 'note.eda.eda'), ('n.eda', 'a.txt', 'n.eda.eda'), ('n', 'n', 'n.eda')) t(archive, unpacked, packed)")
def output_names(spark, sf_dir):
    rows = spark.createDataFrame([("x/books.eda", True, None, None), ("note.eda", False, "letter", ".txt"), ("n.eda", False, "a.txt", ".txt"), ("n", False, None, None)], "archive string, d boolean, name string, ext string")
    return rows.select("archive", meta.unpacked_name(F.col("archive"), F.col("d"), F.col("name"), F.col("ext")).alias("unpacked"), meta.packed_name(F.col("archive")).alias("packed"))


PATHS = {"a/b.txt": True, "/etc/passwd": False, "../up": False, "a/../../up": False, "a/..": False, "..a/b": True, "": False, "C:\\x": False, "a\\..\\b": False, "dir/.hidden": True}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(v).lower()})" for k, v in PATHS.items()) + ") t(path, safe)")
def path_safety(spark, sf_dir):
    rows = spark.createDataFrame([(k,) for k in PATHS], "path string")
    return rows.select("path", meta.is_safe_path(F.col("path")).alias("safe"))


# --- the coding queries with the production vocabulary -------------------------

#: 3,570 slots and tokens of 3 to 16 characters.  Those whose SQL needs one regex of all tokens
#: have none: it takes minutes on sf0.01.
_FULL = (vocab_json, encode_tokens, encode_size, encode_hex, encode_escape, decode_roundtrip, token_usage, vocab_savings, match_longest_per_pos, archive_directory, archive_summary, codec_file_roundtrip)
QUERIES |= {f"{f.__name__}_full": functools.partial(f, learn=full_vocab) for f in _FULL}
QUERIES["codec_catalog_full"] = functools.partial(codec_catalog, hi=FULL_HI, k=slots.SLOTS)
_LONGER = {vocab_sql(3, 6, SMALL_K): vocab_sql(3, FULL_HI, slots.SLOTS), grams_sql(3, 6): grams_sql(3, FULL_HI), grams_sql(3, 4, "lang"): grams_sql(3, FULL_HI, "lang"), f"r <= {SMALL_K}": f"r <= {slots.SLOTS}"}
for _name in ("vocab_json", "decode_roundtrip", "match_longest_per_pos", "codec_file_roundtrip", "codec_catalog"):
    ORACLE_SQL[f"{_name}_full"] = functools.reduce(lambda sql, x: sql.replace(*x), _LONGER.items(), ORACLE_SQL[_name])
