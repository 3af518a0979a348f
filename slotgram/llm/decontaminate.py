"""Benchmark decontamination by winnowing, with DataFrame operations only.

A window is ``WINDOW`` consecutive words of a benchmark item.  Documents keep the leftmost
least hash of their ``GRAM``-word grams in every window of that size (winnowing), so a shared
window always shares such a fingerprint at the same offset.  Fingerprints are joined, each
hit is extended by the offset to the whole window, and the words are compared.  Items with
fewer words are one window of their own length, and are found by grams of that length.

The item side and the hits are broadcast only if their rows and bytes are counted and few;
beyond that the joins shuffle.  Texts are not exploded; they are shuffled only where the
documents with hits are too many to broadcast.  Fingerprints are joined by 64-bit hashes, so what
is fetched to compare words really shares a gram, but for one in 2**64.

Nulls: null text has no words, is never hit and gives no window; a null item id is an empty
string in the digest.  Documents are told apart by id and text, so repeated rows get equal
results, and null ids work.  Empty tables give no hits.  Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotgram.llm.common import drop, let, small, table, written
from slotgram.llm.url_filters import LOWER, UPPER

WINDOW, GRAM, PLACE_BITS = 10, 5, 31
ADDED = ["n_words", "n_hit", "n_items", "items", "spans", "contaminated"]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between words, before A-Z is lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column, fold: bool = True) -> Column:
    """The words of a text, with A-Z lower-cased if ``fold``."""
    text = F.coalesce(text, F.lit(""))
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER) if fold else text, BREAK, -1), "")


def word_hashes(words: Column) -> Column:
    """Equal for words that are equal once A-Z is lower-cased.  ``lower`` is quick where a word
    is ASCII; beyond ASCII it folds more, which only adds hits that the words then refute."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def gram_hashes(hashes: Column, k: int) -> Column:
    """Hash of the k words from each word on; none if there are fewer."""
    gram = lambda h, x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)])
    return let(hashes, lambda h: F.slice(F.transform(h, lambda x, i: gram(h, x, i)), F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(0))))


def sliding_least(values: Column, span: int) -> Column:
    """Least of each element and the ``span - 1`` after it (fewer at the end)."""
    return F.transform(values, lambda x, i: F.least(x, *[F.get(values, i + j) for j in range(1, span)])) if span > 1 else values


def fingerprints(hashes: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """array<struct<h, at>>: leftmost least gram of each window of the words with these hashes,
    without repeats; none if there are fewer words.  The least is taken of longs that hold 33 bits
    of the hash and then 31 bits of the 0-based word position, so the array functions stay linear;
    ``h`` is the gram's whole 64-bit hash."""
    span = window - gram + 1
    placed = lambda g: F.transform(g, lambda x, i: x.bitwiseAND(F.lit(-(1 << PLACE_BITS))).bitwiseOR(i.cast("long")))
    least = lambda p: F.array_distinct(F.slice(sliding_least(p, span), F.lit(1), F.size(p) - (span - 1)))
    whole = lambda g: F.transform(let(placed(g), least), lambda p: let(place_of(p), lambda at: F.struct(F.get(g, at).alias("h"), at.alias("at"))))
    return let(hashes, lambda w: F.when(F.size(w) >= window, let(gram_hashes(w, gram), whole)))


def place_of(placed: Column) -> Column:
    return placed.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, n, w (the words, joined by a space): one row per window of each item."""
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words")).where("size(words) > 0")
    windows = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (window - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, window), " "))
    return items.select("item", F.least(F.size("words"), F.lit(window)).alias("n"), F.explode(let(F.col("words"), windows)).alias("w")).distinct()


def scanned(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, short: bool = False) -> DataFrame:
    """_id, _th, n_words, prints (fingerprints), and the words' hashes if ``short``: one row per
    row of ``docs``.  Texts are split here only, but for those with hits."""
    hashes = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"), word_hashes(words_of(F.col("text"), False)).alias("hashes"))
    made = let(F.col("hashes"), lambda h: F.struct(F.size(h).cast("long").alias("n_words"), fingerprints(h, window, gram).alias("prints"), *([h.alias("hashes")] if short else [])))
    return hashes.select("_id", "_th", made.alias("made")).select("_id", "_th", "made.*")


def find_hits(texts: DataFrame, windows: DataFrame, lengths: list[int], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """_id, _th, hits array<struct<at, n, w>>: where windows may start in the ``scanned`` texts."""
    distinct = windows.select("n", "w").distinct()
    hashed = lambda: word_hashes(F.split("w", " "))
    long = distinct.where(F.col("n") == window).select("n", "w", F.element_at(fingerprints(hashed(), window, gram), 1).alias("p"))
    long = long.select(F.col("p.h").alias("wh"), F.col("p.at").alias("shift"), "n", "w")
    prints = texts.select("_id", "_th", F.inline("prints"))
    hits = prints.join(small(long), F.col("h") == F.col("wh")).where("at >= shift").select("_id", "_th", (F.col("at") - F.col("shift")).alias("at"), "n", "w")
    for n in lengths:
        short = distinct.where(F.col("n") == n).select(F.element_at(gram_hashes(hashed(), n), 1).alias("wh"), "n", "w")
        grams = texts.select("_id", "_th", F.posexplode(gram_hashes(F.col("hashes"), n)).alias("at", "h"))
        hits = hits.unionByName(grams.join(small(short), F.col("h") == F.col("wh")).select("_id", "_th", "at", "n", "w"))
    return hits.groupBy("_id", "_th").agg(F.collect_set(F.struct("at", "n", "w")).alias("hits"))


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The ``scanned`` texts, and _id, _th, n_hit, spans, items of those with windows."""
    windows = written(benchmark_windows(items, window), "decontaminate-windows")
    lengths = sorted(r[0] for r in windows.where(F.col("n") < window).select("n").distinct().collect())  # at most window - 1 rows
    texts = written(scanned(docs, window, gram, bool(lengths)), "decontaminate-texts")
    hits = written(find_hits(texts, windows, lengths, window, gram), "decontaminate-hits")
    docs = docs.select("doc_id", "text").withColumn("_key", F.xxhash64("text"))
    slim = docs.select("doc_id", "_key", "text").join(small(hits), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_th")))
    slim = slim.dropDuplicates(["_id", "_th"]).select("_id", "_th", "hits", words_of(F.col("text")).alias("words"))
    found = written(slim.select("_id", "_th", let(F.col("words"), lambda w: F.filter("hits", lambda x: F.array_join(F.slice(w, x["at"] + 1, x["n"]), " ") == x["w"])).alias("hits")).where("size(hits) > 0"), "decontaminate-found")
    touched = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))))
    spans = F.array_sort(F.array_distinct(F.transform("hits", lambda x: F.struct(x["at"].alias("start"), (x["at"] + x["n"]).alias("end")))))
    per_doc = found.select("_id", "_th", F.explode(F.array_distinct(F.transform("hits", lambda x: x["w"]))).alias("_w"))
    per_doc = per_doc.join(small(windows.select("item", "w")), F.col("_w") == F.col("w")).groupBy(F.col("_id").alias("_i"), F.col("_th").alias("_t")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = found.join(per_doc, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t"))).select("_id", "_th", touched.cast("long").alias("n_hit"), spans.alias("spans"), "items")
    result = written(found, "decontaminate-result")
    drop(windows, hits)
    return texts, result


def _judged(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"),
        "n_items": F.coalesce(F.size("items"), F.lit(0)).cast("long"),
        "items": F.coalesce("items", F.array().cast("array<string>")),
        "contaminated": F.coalesce(F.col("n_hit") > 0, F.lit(False)),
    }).withColumn("n_items", F.greatest("n_items", F.lit(0))).drop("_id", "_th")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (sorted ids), spans (confirmed windows as
    word ranges) and contaminated."""
    names = [c for c in docs.columns if c not in ADDED]
    rows = judged_rows(docs, items, window, gram)
    return rows.select(*(F.col("row")[c].alias(c) for c in names), *ADDED)


def judged_rows(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``, so that no name can clash) with the added columns."""
    texts, found = find_windows(docs, items, window, gram)
    drop(texts)
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("key"), F.size(words_of(docs["text"], False)).cast("long").alias("n_words"))
    joined = whole.join(small(found), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_th")), "left")
    return _judged(joined).select("row", *ADDED)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The same for each row of ``docs``, without its texts and other columns: doc_id, ..."""
    texts, found = find_windows(docs, items, window, gram)
    found = found.withColumnsRenamed({"_id": "_i", "_th": "_t"})
    rows = texts.select("_id", "_th", "n_words").join(small(found), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")), "left")
    return _judged(rows.withColumn("doc_id", F.col("_id"))).drop("_i", "_t")


def query(spark, sf_dir) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT *, least(len(ws), {WINDOW}) AS n, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 2))) AS i FROM b WHERE len(ws) > 0)),
h AS (SELECT doc_id, i, x.n, item FROM (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w))) x JOIN w USING (n, w)),
t AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)
"""
