"""Repeated passages across documents, by windows around sparse places of content.

Of every ``PASSAGE`` consecutive words (a window) the leftmost least ``GRAM``-word gram is the
place (a minimiser: chosen by content, so equal windows have equal grams at equal offsets).
Successive windows with one place form a segment, as in ``substring_dedup``.

1. Grams in segments of two documents are shared; other segments are done with.  If all
   segments of a shared gram are equal (hash of all their words), they repeat as a whole.
2. Of the other segments, one of each kind of equal ones is expanded into hashes of its
   windows, with the least and greatest document that has the kind.  A window repeats if gram
   and hash, 128 bits of two independent functions, stand in two documents.  No pair of
   documents is compared, so no partner is lost and nothing grows with the square of a group.
3. First and last repeated window of each kind go back to its segments: two windows of one
   segment overlap, so all words between repeat too.  What overlaps in a document is joined.

Counts are pre-aggregated and written; the joins back have one row per key on one side, so a
hot passage is split by adaptive execution.  Only passages in two different documents
(different texts or ids) count; repeats inside one document do not.

Nulls: null text has no words; null ids work like values.  Repeated rows (same id, same text)
are one document.  Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotgram.llm.common import drop, table, written
from slotgram.llm.substring_dedup import segment_rows, window_rows

PASSAGE, GRAM = 50, 10


HOLDERS = ["lo", "hi", "least", "most"]


def _holders(lo, hi, least, most) -> list:
    """Two documents' keys, which differ if there are two, and the least and greatest id."""
    return [F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.min(least).alias("least"), F.max(most).alias("most")]


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """doc_id, th, start, end (words), other: one row for each joined passage of ``docs``
    (doc_id, text).  ``other`` is the least id of the documents that hold one of its windows;
    where that is the document's own, the greatest; null if there is no other id."""
    docs = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text"))
    docs = docs.select("doc_id", "th", "text")
    segs = written(segment_rows(docs, passage, gram), "suffix-segments")
    own, number = F.xxhash64("doc_id", "th"), F.col("doc_id").cast("long")
    shared = segs.groupBy("h").agg(*_holders(own, own, number, number), (F.min("d") != F.max("d")).alias("mixed")).where("lo <> hi")
    shared = written(shared.select("h", "least", "most", "mixed"), "suffix-shared")
    flagged = written(segs.join(shared, "h"), "suffix-flagged")
    drop(segs, shared)
    whole = flagged.where("not mixed").select("doc_id", "th", F.col("first").alias("start"), F.col("last").alias("end"), "least", "most")
    mixed = flagged.where("mixed").select("h", "d", "doc_id", "th", "first", "last")
    which = F.xxhash64("doc_id", "th", "first")
    kinds = mixed.groupBy("h", "d").agg(*_holders(own, own, number, number), *(F.min_by(c, which).alias(n) for c, n in (("doc_id", "i"), ("th", "t"), ("first", "first"), ("last", "last"))))
    windows = window_rows(docs, kinds, passage, HOLDERS)
    twice = written(windows.groupBy("h", "w").agg(*_holders("lo", "hi", "least", "most")).where("lo <> hi").select("h", "w", "least", "most"), "suffix-twice")
    hits = windows.select("h", "w", "d", "k").join(twice, ["h", "w"]).groupBy("h", "d").agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("least").alias("least"), F.max("most").alias("most"))
    hits = written(hits, "suffix-hits")
    drop(windows, twice)
    part = mixed.join(hits, ["h", "d"]).select("doc_id", "th", (F.col("first") + F.col("k0")).alias("start"), (F.col("first") + F.col("k1")).alias("end"), "least", "most")
    spans = F.struct(F.col("start").cast("long").alias("start"), (F.col("end") + passage).cast("long").alias("end"), "least", "most")
    lists = whole.union(part).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(spans)).alias("spans"))
    joined = F.expr("""aggregate(spans, cast(array() as array<struct<start: bigint, end: bigint, least: bigint, most: bigint>>), (done, x) ->
        if(size(done) > 0 and x.start <= element_at(done, -1).end,
           concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, x.end), 'least', least(element_at(done, -1).least, x.least), 'most', greatest(element_at(done, -1).most, x.most)))),
           concat(done, array(x))))""")
    other = F.when(~F.col("s.least").eqNullSafe(number), F.col("s.least")).when(~F.col("s.most").eqNullSafe(number), F.col("s.most"))
    return lists.select("doc_id", "th", F.explode(joined).alias("s")).select("doc_id", "th", "s.start", "s.end", other.alias("other"))


def query(spark, sf_dir) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), F.col("other").alias("other_doc_id"))


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + {PASSAGE}], ' ') AS w FROM (SELECT *, unnest(range(0, len(ws) - {PASSAGE - 1})) AS i FROM d)),
r AS (SELECT doc_id, i, least, most FROM w JOIN (SELECT w, min(doc_id) AS least, max(doc_id) AS most FROM w GROUP BY w HAVING min(doc_id) <> max(doc_id)) USING (w)),
o AS (SELECT *, sum(CAST(coalesce(i > before + {PASSAGE}, true) AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r))
SELECT doc_id, min(i) AS start_word, max(i) + {PASSAGE} AS end_word, max(i) + {PASSAGE} - min(i) AS n_words,
  CASE WHEN min(least) <> doc_id THEN min(least) ELSE max(most) END AS other_doc_id
FROM o GROUP BY doc_id, k
"""
