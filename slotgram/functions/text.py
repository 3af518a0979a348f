"""Text decoding, the text-file predicate, and byte offsets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes looked at, least printable share, greatest share of NUL.
SAMPLE, MIN_PRINTABLE, MAX_NUL = 8192, 0.85, 0.01


def newlines(text: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text without the invalid ones, newlines normalised."""

    @F.pandas_udf("string")
    def lenient(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    return newlines(lenient(content))


def sample_ratios(content: Column) -> tuple[Column, Column, Column]:
    """Bytes in the sample, share of NUL, share of printable; shares are null when empty."""
    chars = F.decode(F.substring(content, 1, SAMPLE), "ISO-8859-1")
    n = F.length(chars)
    return n, F.try_divide(F.regexp_count(chars, F.lit(r"\x00")), n), F.try_divide(F.regexp_count(chars, F.lit(r"[\x09-\x0D\x20-\x7E\x80-\xFF]")), n)


def is_text(content: Column) -> Column:
    n, nul, printable = sample_ratios(content)
    return F.coalesce((n > 0) & (nul <= MAX_NUL) & (printable >= MIN_PRINTABLE), F.lit(False))
