"""Summaries of archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotgram.functions.meta import parse_meta

#: Bytes of a file archive's header besides codec name and metadata: magic, two lengths of two bytes,
#: type, size.
HEADER = 4 + 2 + 1 + 2 + 8


def summary(entries: DataFrame) -> DataFrame:
    """archive, codec, entry_type, entries, encoded_bytes (both without metadata), meta_text, meta."""
    data = F.col("ord") > 0
    found = entries.groupBy("archive", "codec", "entry_type").agg(
        F.count_if(data).alias("entries"),
        F.coalesce(F.sum(F.when(data, F.col("enc_size"))), F.lit(0)).alias("encoded_bytes"),
        F.max(F.when(~data, F.decode("encoded", "UTF-8"))).alias("meta_text"),
    )
    return found.withColumn("meta", parse_meta(F.col("meta_text")))


def summary_of_heads(heads: DataFrame) -> DataFrame:
    """The same of ``files.archive_heads``, without grouping and join, and archive_bytes, payload_bytes (of a
    file archive the XZ stream alone, of a directory archive all) and percent, which is their share of the
    encoded bytes."""
    text = F.decode("meta_bytes", "UTF-8")
    found = heads.select("archive", "codec", "entry_type", "entries", "encoded_bytes", text.alias("meta_text"), parse_meta(text).alias("meta"), "archive_bytes")
    header = F.octet_length("codec") + F.octet_length("meta_text") + HEADER
    payload = F.col("archive_bytes") - F.when(F.col("entry_type") == "F", header).otherwise(0)
    return found.withColumn("payload_bytes", payload).withColumn("percent", F.round(F.try_divide(F.col("payload_bytes") * 100, F.col("encoded_bytes")), 1))
