"""Corpus profile and size-balanced grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotgram.scratch import written

#: Bits of ``monotonically_increasing_id`` that count rows inside a partition.
ROW_BITS = 33


def profile(docs: DataFrame, by: str = "lang") -> DataFrame:
    return docs.groupBy(by).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


def assign_groups(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, bytes, part: documents by size (descending), dealt round robin to n groups.  Ids and
    sizes are range-partitioned and sorted, and written with their place in their partition; the
    rank is that place and the rows of the partitions before, so no task sees all documents."""
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    spread = sized.repartitionByRange(F.desc("bytes"), F.asc("doc_id")).sortWithinPartitions(F.desc("bytes"), F.asc("doc_id"))
    placed = written(spread.withColumn("place", F.monotonically_increasing_id()), "corpus-order")
    split = F.shiftright("place", ROW_BITS).alias("split")
    # one row per partition, so this window is as small as the number of partitions
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(split).agg(F.count(F.lit(1)).alias("rows")).select("split", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return placed.withColumn("split", split).join(F.broadcast(counts), "split").select("doc_id", "bytes", (rank % n).cast("int").alias("part"))
