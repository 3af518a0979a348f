"""Shared helpers: size-checked broadcasts, and vectorised word hashing over Arrow string
columns.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  UTF-8 never uses those
bytes inside a longer sequence, so byte-wise splitting equals code-point splitting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotgram.scratch import drop, written

__all__ = ["WORD", "Words", "drop", "let", "mix", "ranges", "sliding_min", "small", "table", "text_chunks", "written"]

#: Rows up to which a lookup side may be broadcast; beyond these limits joins shuffle.
BROADCAST_ROWS = 200_000
#: Bytes up to which it may, counted as JSON.
BROADCAST_BYTES = 32 << 20
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if counts prove that it has at most ``rows`` rows and, as
    JSON, at most ``size`` bytes.  Bytes are only counted where the rows are few enough."""
    if df.limit(rows + 1).count() > rows:
        return df
    total = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*(df[c] for c in df.columns)))))).first()[0] or 0
    return F.broadcast(df) if total <= size else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row: the optimiser may copy a
    projected column's expression into a lambda, where it would run for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- hashing -----------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE_FOLDED = _BYTE[_FOLD]
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_BLOCK = 1 << 20


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
                self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


_PP, _QQ = _Powers(_P), _Powers(_Q)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_block(buf: np.ndarray, breaks: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of ``buf``; words also end at ``breaks``."""
    full = ~_SPACE[buf]
    prev = np.zeros(len(buf), bool)
    prev[1:] = full[:-1]
    prev[breaks[breaks < len(buf)]] = False
    starts = np.flatnonzero(full & ~prev)
    after = np.zeros(len(buf), bool)
    after[:-1] = prev[1:] & full[1:]
    ends = np.flatnonzero(full & ~after) + 1
    up, down = _PP.get(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(lut[buf] * up[: len(buf)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _Q)
    return starts, ends, hashes


class Words:
    """The words of several texts: byte ranges, 64-bit hashes, and ``first[i]:first[i + 1]``
    as the words of text i."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, fold: bool = False):
        self.buf, self.offsets = buf, offsets
        lut, parts, at = _BYTE_FOLDED if fold else _BYTE, [], 0
        while at < len(buf):  # blocks are cut at white space or at the start of a text
            end = min(len(buf), at + _BLOCK)
            while end < len(buf):
                tail = np.flatnonzero(_SPACE[buf[max(at, end - 4096) : end]])
                if len(tail):
                    end = max(at, end - 4096) + int(tail[-1]) + 1
                    break
                end = min(len(buf), end + 4096)
            s, e, h = _hash_block(buf[at:end], offsets[(offsets >= at) & (offsets < end)] - at, lut)
            parts.append((s + at, e + at, h))
            at = end
        self.starts, self.ends, self.hashes = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.first = np.searchsorted(self.starts, offsets)
        self.count = np.diff(self.first)
        n = len(self.hashes)
        up, self._down = _QQ.get(n + 1)
        self._total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * up[:n], out=self._total[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences ``start:end``."""
        return mix((self._total[end] - self._total[start]) * self._down[start] + (end - start).astype(np.uint64) * _P)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on, also across texts; see ``whole``."""
        n = len(self.hashes)
        i = np.arange(max(0, n - k + 1))
        return self.spans(i, i + k)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def whole(self, k: int) -> np.ndarray:
        """Positions from which k words of one text follow."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        i = np.arange(len(self.hashes))
        return i[i + k <= np.repeat(self.first[1:], self.count)]


def sliding_min(values: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Value and leftmost position of the least of each w successive values."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, values.dtype), np.zeros(0, np.int64)
    v, p, have = values, np.arange(len(values)), 1
    while have < w:
        step = min(have, w - have)
        less = v[step:] < v[:-step]
        v, p = np.where(less, v[step:], v[:-step]), np.where(less, p[step:], p[:-step])
        have += step
    return v[:n], p[:n]


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most ``limit`` bytes, or of
    one longer row; null counts as empty."""
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of ``lengths``, in one array."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
