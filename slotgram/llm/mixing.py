"""Mixing sources to target weights, with DataFrame operations only.

Each row gets a hash-random key.  Keys are range-partitioned by their leading hex digits
inside each source, level by level: sums of sizes over the ranges of a level give the one range
in which the budget ends, which the next level divides by further digits, and at last by whole
keys.  These distributed prefix sums see at most 16 ** LEVEL_DIGITS ranges of a source at once,
and in the end a part of 16 ** (LEVELS * LEVEL_DIGITS) of its keys.  They give one cut per source
(whole epochs, cut key, share at the cut), and one map-side pass over the rows applies it, so
texts are never shuffled or sorted.

Nulls: a null source is a source of its own, sorted last; a null text has size 0; a null id
is hashed as an empty string.  Rows with equal key (repeated rows) share what is left at the
cut evenly, rounded down.  Empty tables give an empty result.  Other columns are kept; the
columns ``size source_size target taken`` are replaced if there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotgram.llm.common import WORD, drop, small, written

ADDED = ["size", "source_size", "target", "taken"]
SHARE, CAP, WEIGHTS, SEED = 1.5, 2, (5.0, 2.0, 1.0), "mix-1"
#: Leading hex digits of the keys by which a level divides a range, and levels before whole keys.
LEVEL_DIGITS, LEVELS = 3, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixing_key(seed: str = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")))))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size -> target: ``share`` of all sizes by weight; targets stop at
    ``cap`` times the source's size, and the excess is shared again by weight until none is
    above (water filling in closed form).  One row per source, so the global windows here see
    as many rows as there are sources, not documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy((F.lit(cap) * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    before, everything = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = (
        sizes.withColumn("weight", weight)
        .withColumn("full", F.col("source_size") * cap)
        .withColumn("full_before", F.coalesce(F.sum("full").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("at_cap", F.col("full") * F.col("weight_left") <= (F.col("budget") - F.col("full_before")) * F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum(F.when(F.col("at_cap"), F.col("full"))).over(everything), F.lit(0)))
        .withColumn("open_weight", F.sum(F.when(~F.col("at_cap"), F.col("weight"))).over(everything))
    )
    target = F.when(F.col("at_cap"), F.col("full").cast("double")).otherwise((F.col("budget") - F.col("capped")) * F.col("weight") / F.col("open_weight"))
    return filled.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def sums_before(parts: DataFrame, by: str) -> DataFrame:
    """``parts`` (s, before, size, ...) with the sizes of the parts before, in order of ``by``, added to ``before``."""
    each = Window.partitionBy("s").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(each), F.lit(0)))


def range_of_cut(ranges: DataFrame) -> DataFrame:
    """s, range, before, rest: of each source's ``ranges`` the one in which ``rest`` words end; none
    where nothing is left."""
    return sums_before(ranges, "range").where("before <= rest and rest < before + size").select("s", "range", "before", "rest")


def source_cuts(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row per source: source_size, target, epochs, cut_key, cut_share (words that each
    row with the cut key gives)."""
    sizes = written(docs.select("source", mixing_key(seed).alias("key"), word_count(F.col("text")).alias("size")), "mixing-sizes")
    first = sizes.groupBy("source", F.substring("key", 1, LEVEL_DIGITS).alias("range")).agg(F.sum("size").alias("size"))
    first = written(first, "mixing-ranges")
    goal = targets(first.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    goal = goal.withColumn("words", F.floor("target")).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0).cast("long")))
    goal = goal.withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size"))
    goal = written(goal, "mixing-targets")
    left = goal.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("before"))
    ended = written(range_of_cut(first.join(small(left), F.col("source").eqNullSafe(F.col("s")))), "mixing-ended")
    drop(first)
    inside = lambda: sizes.join(small(ended), F.col("source").eqNullSafe(F.col("s")) & F.col("key").startswith(F.col("range"))).drop("range")
    for level in range(2, LEVELS + 1):
        parts = inside().groupBy("s", "before", "rest", F.substring("key", 1, LEVEL_DIGITS * level).alias("range")).agg(F.sum("size").alias("size"))
        ended, wider = written(range_of_cut(parts), "mixing-ended"), ended
        drop(wider)
    keys = inside().groupBy("s", "before", "rest", "key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    keys = sums_before(keys, "key")
    cut = keys.where("before <= rest and rest < before + size").select("s", F.col("key").alias("cut_key"), F.expr("(rest - before) div rows").alias("cut_share"))
    cuts = written(goal.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "epochs", "cut_key", "cut_share"), "mixing-cuts")
    drop(sizes, goal, ended)
    return cuts


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and taken (words of
    the row that the mix takes, repeats counted).  The same rows give the same mix."""
    cuts = source_cuts(docs, weights, share, cap, seed).withColumnRenamed("source", "_source")
    names = [c for c in docs.columns if c not in ADDED]
    # the row is one struct meanwhile, so that no column's name can clash
    found = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), docs["source"].alias("source"), mixing_key(seed).alias("key"), word_count(F.col("text")).alias("size"))
    found = found.join(small(cuts), F.col("source").eqNullSafe(F.col("_source")))
    rest = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.col("cut_share")).otherwise(F.lit(0))
    taken = (F.col("epochs") * F.col("size") + rest).cast("long")
    return found.select(*(F.col("row")[c].alias(c) for c in names), "size", "source_size", "target", taken.alias("taken"))


def repeat_texts(mixed: DataFrame) -> DataFrame:
    """One row for each time that a row of the mix is read: ``taken`` is then the words of this
    reading, and the text of a partial reading is cut to its first ``taken`` words (joined by
    one space).  Rows of which nothing is taken go."""
    whole = mixed.where("taken > 0").select(F.struct(*(mixed[c] for c in mixed.columns)).alias("row"), F.explode(F.expr("sequence(0L, (taken - 1) div size)")).alias("epoch"))
    size, taken = F.col("row.size"), F.least("row.size", F.col("row.taken") - F.col("epoch") * F.col("row.size"))
    first = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.lit(1), taken.cast("int")), " ")
    new = {"taken": taken, "text": F.when(taken < size, first).otherwise(F.col("row.text"))}
    return whole.select(*(new.get(c, F.col("row")[c]).alias(c) for c in mixed.columns))


def query(spark, sf_dir) -> DataFrame:
    from slotgram.llm.common import table

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB, over the table ``{docs}``.
MIX_SQL = """
SELECT d.*, s.source_size, s.target,
  CAST(s.epochs * d.size + CASE WHEN before + peers <= rest THEN d.size WHEN before >= rest THEN 0 ELSE CAST((rest - before) // n_peers AS BIGINT) END AS BIGINT) AS taken
FROM (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY key) - sum(size) OVER (PARTITION BY source, key), 0) AS BIGINT) AS before,
    CAST(sum(size) OVER (PARTITION BY source, key) AS BIGINT) AS peers, count(*) OVER (PARTITION BY source, key) AS n_peers
  FROM (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM {docs})) d
JOIN (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs, words - CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END * source_size AS rest
  FROM (SELECT *, CAST(floor(target) AS BIGINT) AS words FROM (
    SELECT source, source_size, CASE WHEN at_cap THEN CAST(cap AS DOUBLE) ELSE (budget - coalesce(sum(cap) FILTER (at_cap) OVER (), 0)) * weight / sum(weight) FILTER (NOT at_cap) OVER () END AS target
    FROM (SELECT *, cap * weight_left <= (budget - cap_before) * weight AS at_cap
      FROM (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
          sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS budget
        FROM (SELECT source, source_size, 2 * source_size AS cap, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
          FROM (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS source_size FROM {docs} GROUP BY source))))))) s
ON d.source IS NOT DISTINCT FROM s.source
"""
SQL = f"SELECT doc_id, size, source_size, target, taken FROM ({MIX_SQL.format(docs='documents')})"
