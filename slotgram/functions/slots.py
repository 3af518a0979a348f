"""The reserved 12-bit slot space, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FLAG, SPACE, SLOTS = 1, 4096, 3570


def broken_rules(slot: Column) -> dict[str, Column]:
    """Why an id is reserved, by rule."""
    return {
        "high_byte_is_flag": F.shiftright(slot, 4) == FLAG,
        "low_byte_is_flag": slot.bitwiseAND(F.lit(255)) == FLAG,
        "high_nibble_is_one": F.shiftright(slot, 8) == 1,
        "low_nibble_is_zero": slot.bitwiseAND(F.lit(15)) == 0,
    }


def is_valid(slot: Column) -> Column:
    ok = F.lit(True)
    for rule in broken_rules(slot).values():
        ok = ok & ~rule
    return ok


def slot_space(spark: SparkSession) -> DataFrame:
    """slot, slot_rank (from 1): the valid ids in ascending order, 3,570 rows."""
    ids = spark.range(SPACE, numPartitions=1).select(F.col("id").cast("int").alias("slot")).where(is_valid(F.col("slot")))
    return ids.withColumn("slot_rank", F.row_number().over(Window.orderBy("slot")))


def slot_bytes(slot: Column) -> tuple[Column, Column]:
    return F.shiftright(slot, 4), slot.bitwiseAND(F.lit(15))


def slot_of(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 4).bitwiseOR(low)


def quotas(spark: SparkSession, parts: int, slots: int = SLOTS) -> DataFrame:
    """part, slot_start, slot_count: even shares by integer division; the last takes the rest."""
    if parts < 1:
        raise ValueError("at least one part is needed")
    base = slots // parts
    count = F.when(F.col("part") == parts - 1, slots - base * (parts - 1)).otherwise(base)
    return spark.range(parts, numPartitions=1).select(F.col("id").cast("int").alias("part")).select("part", (F.col("part") * base).alias("slot_start"), count.alias("slot_count"))
