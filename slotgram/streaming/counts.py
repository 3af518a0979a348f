"""Gram counts of a growing corpus by Structured Streaming.

Each micro-batch adds its partial counts to a stateful sum; the running counts equal those of
a batch run over all documents seen, whatever the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotgram.operators.grams import explode_grams


def running_counts(stream: DataFrame, lo: int, hi: int) -> DataFrame:
    """gram, cnt over a streaming ``stream`` (text); for output modes update and complete."""
    return explode_grams(stream, [], lo, hi).groupBy("gram").agg(F.count(F.lit(1)).alias("cnt"))
