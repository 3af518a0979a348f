"""Substring dedup with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words.  Its fingerprint is the leftmost least hash of the
``GRAM``-word grams in it; successive windows with one fingerprint position form a segment,
so a text gives a row for about 13 words, and equal windows have equal fingerprints.

1. ``FingerprintIndex``: each batch's fingerprints are counted and written as an immutable run,
   bucketed and sorted by fingerprint, so runs are merge-joined without being dealt out or sorted
   again.  A run knows for each fingerprint how often it came and the least and greatest hash of
   its segments' words.  A fingerprint of a batch is shared if it comes twice in the batch and the
   runs before it.  More than ``fan_in`` runs are compacted: the two smallest are merged.  A
   manifest in the folder lists the runs, so that a later job can open the index.
2. Verification, only for segments with a shared fingerprint: if all of a fingerprint's segments
   are equal (hash of all their words), they repeat as a whole.  Of other segments, one of each
   kind of equal ones is expanded into hashes of its windows, and a window repeats if hash and
   fingerprint come twice.  Both are 64-bit hashes over the same 64-bit hashes of words: no
   repeat is missed, and different windows are taken for equal with a probability of about 2**-64.
3. Words under repeated windows are removed; windows are judged on the input.  Two windows of one
   segment share its gram, so the first and the last repeated one cover all between.
4. An index that is given stays for later calls: it also keeps the window hashes of all kinds of
   segments (about 8 bytes a word), and later calls verify against these, so a window repeats
   too if an earlier call saw it.  Earlier results do not change.

Counts are pre-aggregated and written, and the joins back from counts to rows have one row
per key on one side, so a hot passage is split by adaptive execution (an aggregate right under
the join would forbid that); runs hold one row for each fingerprint, so no bucket is hot.
Nothing is collected.

Nulls: null text has no words; a null id is a value of its own.  Repeated rows are copies,
so all of their windows repeat.  Empty tables give an empty result.  Texts are taken whole,
in chunks of about a megabyte or one text.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from slotgram import scratch
from slotgram.llm.common import Words, drop, ranges, sliding_min, table, text_chunks, written

WINDOW, GRAM, BATCHES, FAN_IN = 35, 10, 3, 2


def window_anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows inside one text, the position of each one's least gram, and the
    gram hashes."""
    at = words.whole(window)
    grams = words.grams(gram)
    _, least = sliding_min(grams, window - gram + 1)
    return at, least[at], grams


def segments(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, first and last window start, and text of each segment."""
    at, least, grams = window_anchors(words, window, gram)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    text = words.text_of()[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return grams[least[first]], at[first], at[last], text[first]


def segment_rows(docs: DataFrame, window: int, gram: int, windows: bool = False) -> DataFrame:
    """h, d (hash of the segment's words), doc_id, th, first, last (window starts, counted in words
    of the text) of ``docs`` (doc_id, th, text); with ``windows`` only h, d and the window hashes."""

    def found(batches):
        for batch in batches:
            for i, j, buf, offsets in text_chunks(batch):
                words = Words(buf, offsets)
                h, first, last, text = segments(words, window, gram)
                d = words.spans(first, last + window)
                if windows:
                    n = last - first + 1
                    start = np.repeat(first, n) + ranges(n)
                    lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), pa.array(words.spans(start, start + window).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(d.view(np.int64)), lists], ["h", "d", "windows"])
                    continue
                base, part = words.first[text], batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(d.view(np.int64)), part.column("doc_id").take(pa.array(text)), part.column("th").take(pa.array(text)), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))], ["h", "d", "doc_id", "th", "first", "last"])

    keys = StructType([StructField("h", LongType()), StructField("d", LongType())])
    if windows:
        return docs.mapInArrow(found, keys.add("windows", ArrayType(LongType())))
    return docs.mapInArrow(found, keys.add(docs.schema["doc_id"]).add(docs.schema["th"]).add("first", "integer").add("last", "integer"))


def window_rows(docs: DataFrame, kinds: DataFrame, window: int, carry: list[str]) -> DataFrame:
    """h, w (hash of a window), d, k (its number in the segment) and the longs ``carry``: the windows
    of the segments of ``kinds`` (h, d, i, t, first, last, carry), which stand in the row of ``docs``
    with doc_id i and th t."""
    names = ["h", "d", *carry, "first", "last"]
    lists = written(kinds.groupBy("i", "t").agg(F.collect_list(F.struct(*names)).alias("segs")), "dedup-kinds")
    both = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))).select("text", "segs")

    def hashed(batches):
        for batch in batches:
            for i, j, buf, offsets in text_chunks(batch):
                words, segs = Words(buf, offsets), batch.column("segs").slice(i, j - i)
                flat, text = segs.flatten(), np.repeat(np.arange(j - i), np.asarray(segs.value_lengths()))
                fields = dict(zip(names, flat.flatten(), strict=True))
                first, last = (np.asarray(fields[c]).astype(np.int64) + words.first[text] for c in ("first", "last"))
                ends = np.append(0, np.cumsum(last - first + 1))
                cuts = np.searchsorted(ends, np.arange(0, ends[-1], 1 << 16))
                for a, b in zip(cuts, np.append(cuts[1:], len(first)), strict=True):
                    n = (last - first + 1)[a:b]
                    k, row = ranges(n), pa.array(np.repeat(np.arange(a, b), n))
                    start = np.repeat(first[a:b], n) + k
                    yield pa.RecordBatch.from_arrays([fields["h"].take(row), pa.array(words.spans(start, start + window).view(np.int64)), fields["d"].take(row), pa.array(k.astype(np.int32)), *(fields[c].take(row) for c in carry)], ["h", "w", "d", "k", *carry])

    out = written(both.mapInArrow(hashed, "h long, w long, d long, k int" + "".join(f", {c} long" for c in carry)), "dedup-windows")
    drop(lists)
    return out


class FingerprintIndex:
    """Immutable runs (h, n, lo, hi) of fingerprints, bucketed and sorted by h, in the folder
    ``path`` (default: a new one in the shared folder, deleted when Python ends): h came n times,
    lo and hi are the least and greatest hash of its segments, hi null if they are equal.  Runs
    (h, d, windows) hold the segments of earlier calls.  An index that ``path`` holds is opened."""

    RUN = "h BIGINT, n BIGINT, lo BIGINT, hi BIGINT"

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = FAN_IN, buckets: int | None = None):
        self.spark, self.fan_in, self.version = spark, fan_in, 0
        self.path = path.rstrip("/") if path else scratch.new_path(spark, "fingerprint-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: dict[str, int] = {}  # name -> rows
        self.windows: list[str] = []
        self.sizes: list[int] | None = None
        self._tables: dict[str, str] = {}
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-*/_SUCCESS")
        found = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at)
        if names := sorted(x.getPath().getParent().getName() for x in found or ()):
            self.version = int(names[-1].rpartition("-")[2])
            said = json.loads(spark.read.text(f"{self.path}/{names[-1]}", wholetext=True).first()[0])
            self.buckets, self.runs, self.windows, self.sizes = said["buckets"], said["runs"], said["windows"], said["sizes"]

    def check_sizes(self, window: int, gram: int) -> None:
        if self.sizes and self.sizes != [window, gram]:
            raise ValueError(f"the index holds windows and grams of {self.sizes} words")
        self.sizes = [window, gram]

    def save(self) -> None:
        """Writes the next manifest; what it doesn't list is then deleted."""
        said = {"buckets": self.buckets, "runs": self.runs, "windows": self.windows, "sizes": self.sizes}
        self.version += 1
        self.spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.version:08d}")

    def _delete(self, name: str) -> None:
        if table_ := self._tables.pop(name, None):
            self.spark.sql(f"DROP TABLE IF EXISTS {table_}")
        scratch.delete(self.spark, f"{self.path}/{name}")

    def _run(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = f"slotgram_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self._tables[name]} ({self.RUN}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(self._tables[name])

    def _write(self, rows: DataFrame) -> str:
        """A new run; the partitions of ``rows`` by h are its buckets."""
        name = f"run-{uuid.uuid4().hex}"
        self._tables[name] = f"slotgram_{uuid.uuid4().hex}"
        with scratch.settings(self.spark, self._plan()):
            rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").saveAsTable(self._tables[name])
        self.runs[name] = self._run(name).count()
        return name

    def _plan(self) -> dict[str, str]:
        """Settings under which buckets are partitions, and their order is known to scans."""
        return scratch.SETTINGS | {"spark.sql.shuffle.partitions": str(self.buckets), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}

    @staticmethod
    def _sum(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        """Two runs merge-joined by h, with counts added."""
        b = b.toDF("h", "n2", "lo2", "hi2")
        lo, hi = F.least("lo", "lo2"), F.greatest("lo", "hi", "lo2", "hi2")
        n = F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))
        return a.hint("merge").join(b.hint("merge"), "h", how).select("h", n.alias("n"), lo.alias("lo"), F.when(hi != lo, hi).alias("hi"))

    def add(self, prints: DataFrame) -> DataFrame:
        """Adds a batch (h, d); returns h, mixed (whether its segments differ) of the fingerprints
        in it that are now known twice."""
        hi = F.max("d")
        new = self._write(prints.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.when(hi != F.min("d"), hi).alias("hi")))
        known = self._run(new)
        for name in self.runs:
            known = known if name == new else self._sum(known, self._run(name), "left")
        with scratch.settings(self.spark, self._plan()):
            shared = written(known.where("n > 1").select("h", F.col("hi").isNotNull().alias("mixed")), "index-shared")
        gone = []
        while len(self.runs) > self.fan_in:
            a, b = sorted(self.runs, key=lambda x: (self.runs[x], x))[:2]
            self._write(self._sum(self._run(a), self._run(b), "full"))
            gone += [a, b]
            del self.runs[a], self.runs[b]
        self.save()
        for name in gone:
            self._delete(name)
        return shared

    def keep(self, segs: DataFrame) -> None:
        """Keeps one of each kind of a call's segments (h, d, windows) for later calls."""
        parts, gone = [segs], []
        if len(self.windows) >= self.fan_in:
            parts, gone, self.windows = [segs, *(self.spark.read.parquet(f"{self.path}/{x}") for x in self.windows)], self.windows, []
        for i, part in enumerate(parts):
            segs = segs.union(part) if i else part
        self.windows = [*self.windows, f"windows-{uuid.uuid4().hex}"]
        with scratch.settings(self.spark, scratch.SETTINGS):
            segs.dropDuplicates(["h", "d"]).write.parquet(f"{self.path}/{self.windows[-1]}")
        self.save()
        for name in gone:
            self._delete(name)

    def known(self, shared: DataFrame) -> DataFrame | None:
        """Earlier calls' segments (h, d, windows) with a fingerprint of ``shared`` (h)."""
        found = None
        for name in self.windows:
            some = self.spark.read.parquet(f"{self.path}/{name}").join(shared, "h", "left_semi")
            found = some if found is None else found.union(some)
        return None if found is None else written(found.dropDuplicates(["h", "d"]), "index-known")

    def close(self, delete: bool = False) -> None:
        """Forgets the catalog's names of the runs; with ``delete`` the files go too."""
        for table_ in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table_}")
        self._tables = {}
        if delete:
            scratch.delete(self.spark, self.path)


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, th, spans array<struct<start, end>>: word ranges of ``docs`` (doc_id, th, text)
    whose windows also start elsewhere, in ``docs`` or in those of earlier calls with ``index``.
    ``docs`` pass through ``index`` in ``batches``."""
    prints = written(segment_rows(docs, window, gram), "dedup-segments")
    lasting, index = index is not None, index or FingerprintIndex(docs.sparkSession)
    index.check_sizes(window, gram)
    parts = [index.add(prints.where(F.pmod("th", F.lit(batches)) == b).select("h", "d")) for b in range(batches)]
    index.close(delete=not lasting)
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    shared = written(every.groupBy("h").agg(F.max("mixed").alias("mixed")), "dedup-shared")
    flagged = written(prints.join(shared, "h"), "dedup-flagged")
    drop(prints, *parts)
    whole = flagged.where("not mixed").select("doc_id", "th", "first", "last")
    mixed = flagged.where("mixed")
    which = F.xxhash64("doc_id", "th", "first")
    kinds = mixed.groupBy("h", "d").agg(F.count(F.lit(1)).alias("n"), *(F.min_by(c, which).alias(n) for c, n in (("doc_id", "i"), ("th", "t"), ("first", "first"), ("last", "last"))))
    windows = window_rows(docs, kinds, window, ["n"])
    seen, known = windows.select("h", "w", "n"), index.known(shared.where("mixed").select("h"))
    if known is not None:
        seen = seen.union(known.select("h", F.explode("windows").alias("w"), F.lit(1).cast("long")))
    twice = written(seen.groupBy("h", "w").agg(F.sum("n").alias("n")).where("n > 1").select("h", "w"), "dedup-twice")
    hits = written(windows.select("h", "w", "d", "k").join(twice, ["h", "w"]).groupBy("h", "d").agg(F.min("k").alias("k0"), F.max("k").alias("k1")), "dedup-hits")
    drop(windows, twice, shared, known)
    part = mixed.join(hits, ["h", "d"]).select("doc_id", "th", (F.col("first") + F.col("k0")).alias("first"), (F.col("first") + F.col("k1")).alias("last"))
    span = F.struct(F.col("first").cast("long").alias("start"), (F.col("last") + window).cast("long").alias("end"))
    spans = written(whole.union(part).groupBy("doc_id", "th").agg(F.collect_set(span).alias("spans")), "dedup-spans")
    drop(flagged, hits)
    if lasting:
        index.keep(segment_rows(docs, window, gram, windows=True))
    return spans


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the other words joined by a space), for each row.  With
    ``index``, repeats of earlier calls with the same index go too."""
    docs = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text"))
    spans = repeated_spans(docs, window, gram, batches, index).withColumnsRenamed({"doc_id": "i", "th": "t"})
    both = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left").select("doc_id", "text", "spans")
    schema = StructType([docs.schema["doc_id"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])

    def kept(batches_):
        for batch in batches_:
            n, gone, left, ids, size = [], [], [], batch.column("doc_id"), 0
            at = 0
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = text.as_py().encode().split() if text.is_valid else []
                n.append(len(words))
                if spans.is_valid:
                    ends = np.zeros(len(words) + 1, np.int64)
                    flat = spans.values
                    np.add.at(ends, np.asarray(flat.field(0)), 1)
                    np.add.at(ends, np.asarray(flat.field(1)), -1)
                    out = np.cumsum(ends)[:-1] > 0
                    words = [words[k] for k in np.flatnonzero(~out)]
                gone.append(n[-1] - len(words))
                left.append(b" ".join(words))
                size += len(left[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(n)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())], schema.names)
                    at, n, gone, left, size = at + len(n), [], [], [], 0
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(n)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())], schema.names)

    return both.mapInArrow(kept, schema)


def query(spark, sf_dir) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS pos FROM w WHERE w IN (SELECT w FROM w GROUP BY w HAVING count(*) > 1)),
words AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS pos FROM d)
SELECT d.doc_id, CAST(any_value(len(ws)) AS BIGINT) AS n_words, count(g.pos) AS n_removed,
  sha256(coalesce(string_agg(x, ' ' ORDER BY words.pos) FILTER (g.pos IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = words.doc_id AND g.pos = words.pos GROUP BY d.doc_id
"""


def brute(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple[int | None, int, int, str]]:
    """The result by definition, for tests."""
    split = [(t or "").encode().split() for _, t in rows]
    seen: dict[tuple, int] = {}
    for w in split:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = {p for s in range(len(w) - window + 1) if seen[tuple(w[s : s + window])] > 1 for p in range(s, s + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return out
