"""Corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, secret
redaction and source mixing, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to
the shared folder and reads it again, so a lost executor never costs more than one stage.
Nulls, repeated rows and empty tables are treated as each operator's module says.  All columns of
documents are kept, whatever their names; only the last stage adds columns (size, source_size,
target and taken, the words of the reading), and replaces input columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotgram.llm import decontaminate, mixing, near_dedup, quality, secrets
from slotgram.llm.common import table, written
from slotgram.shipping import ship

#: SQL can express neither the divergence rules nor the structural confirmation of secrets.
ORACLE_SQL = None


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars, if there, as the length of the text now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the distribution divergence reject go."""
    ship(spark)
    return quality.judged_rows(docs).where("kept").select("row.*")


def near_dedup_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    ship(spark)
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.judged_rows(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select("row.*")


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text."""
    ship(spark)
    return counted(secrets.redact(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each reading of a document in the mix; n_chars follows the text."""
    return counted(mixing.repeat_texts(mixing.mix_sources(docs)))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup_one),
    ("decontamination", decontamination),
    ("secret_redaction", secret_redaction),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
