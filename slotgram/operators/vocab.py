"""Vocabularies: grams ranked by frequency, joined with slots by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotgram.functions.slots import SLOTS, quotas, slot_space
from slotgram.operators.corpus import assign_groups
from slotgram.operators.grams import count_grams, levelwise, ranked

SCHEMA = "token string, slot int, cnt long"


def with_slots(top: DataFrame) -> DataFrame:
    """token, slot, cnt of at most 3,570 ranked grams: the i-th gets the i-th valid slot."""
    order = Window.orderBy(F.desc("cnt"), F.length("gram"), "gram")
    rows = top.withColumn("slot_rank", F.row_number().over(order))
    return rows.join(F.broadcast(slot_space(top.sparkSession)), "slot_rank").select(F.col("gram").alias("token"), "slot", "cnt")


def train(docs: DataFrame, lo: int = 3, hi: int = 16, min_freq: int = 5, k: int = SLOTS) -> DataFrame:
    """The exact vocabulary of the whole corpus, learned length by length."""
    return with_slots(levelwise(docs, lo, hi, min(k, SLOTS), min_freq))


def train_partitioned(docs: DataFrame, parts: int, lo: int = 3, hi: int = 3, min_freq: int = 5, slots: int = SLOTS) -> DataFrame:
    """Vocabulary by groups of documents: each part takes its quota, and what earlier parts
    left, of its most frequent grams that are not in the vocabulary; grams of the merged
    counts fill the rest.  Each accepted gram gets the next unused slot, so slots are unique.
    The loop is over parts; every step sees at most the quota's rows on the driver."""
    spark = docs.sparkSession
    grouped = docs.join(assign_groups(docs, parts).select("doc_id", "part"), "doc_id")
    counts = count_grams(grouped, lo, hi, ["part"]).where(F.col("cnt") >= min_freq).persist()
    shares = [r["slot_count"] for r in quotas(spark, parts, slots).orderBy("part").collect()]
    taken: list[tuple[str, int]] = []

    def fresh(rows: DataFrame, n: int) -> list[tuple[str, int]]:
        known = spark.createDataFrame([(t,) for t, _ in taken], "gram string")
        return [(r["gram"], r["cnt"]) for r in ranked(rows.join(F.broadcast(known), "gram", "left_anti"), n).collect()]

    carry = 0
    for part, share in enumerate(shares):
        new = fresh(counts.where(F.col("part") == part).select("gram", "cnt"), share + carry)
        carry = share + carry - len(new)
        taken += new
    if carry:
        taken += fresh(counts.groupBy("gram").agg(F.sum("cnt").alias("cnt")), carry)
    counts.unpersist()
    ids = [r["slot"] for r in slot_space(spark).orderBy("slot").limit(len(taken)).collect()]
    return spark.createDataFrame([(t, s, c) for (t, c), s in zip(taken, ids, strict=True)], SCHEMA)


def vocab_json(vocab: DataFrame) -> DataFrame:
    """slot (text) and token rows of the JSON sidecar, and its flag."""
    return vocab.select(F.col("slot").cast("string").alias("slot"), "token", F.lit("0x1").alias("flag_byte"))


def catalog(vocabs: DataFrame, by: str = "codec") -> DataFrame:
    return vocabs.groupBy(by).agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.octet_length("token") + 3).cast("long").alias("entry_bytes"))
