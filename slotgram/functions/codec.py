"""Greedy longest-match dictionary coding.

``encode``/``decode`` run over Arrow batches with the vocabulary as a broadcast value (at most
3,570 rows by the slot space).  A document is the unit of work: a token may straddle any cut.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from slotgram.functions.slots import SPACE

FLAG = b"\x01"
#: Bytes of texts that are encoded at once, most bytes of such a text, most entries of a trie's table and of
#: that of its first depths, and steps in which runs of overlapping tokens are followed at once.
SLICE, LONG, TABLE, LEADS, ROUNDS = 1 << 17, 8 << 20, 1 << 23, 1 << 21, 100


class Encoder:
    """Leftmost-longest, non-overlapping replacement of tokens by 3 bytes."""

    def __init__(self, vocab: dict[str, int]):
        if "" in vocab:
            raise ValueError("an empty token can't be encoded")
        self.codes = {t: bytes((1, s >> 4, s & 15)) for t, s in vocab.items()}
        self.lead = min(map(len, vocab), default=1)
        lengths: dict[str, set[int]] = {}
        for t in vocab:
            lengths.setdefault(t[: self.lead], set()).add(len(t))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}

    def pieces(self, text: str):
        """(token or literal run, code or None) in order."""
        i, start, n, lead, find, codes = 0, 0, len(text), self.lead, self.lengths.get, self.codes
        while i < n:
            for k in find(text[i : i + lead], ()):
                code = codes.get(text[i : i + k])
                if code is not None:
                    if start < i:
                        yield text[start:i], None
                    yield text[i : i + k], code
                    i = start = i + k
                    break
            else:
                i += 1
        if start < n:
            yield text[start:], None

    def encode(self, text: str) -> bytes:
        return b"".join(p.encode().replace(FLAG, b"\x01\x00\x01") if c is None else c for p, c in self.pieces(text))


class BatchEncoder:
    """``Encoder`` for many texts at once: a trie of the tokens' UTF-8 bytes is walked from all bytes
    together, depth by depth; the depths that all tokens have are one step, by a table.  In UTF-8 a token
    begins only where a character does, and of tokens that begin at one place the one with the most
    characters has the most bytes."""

    def __init__(self, vocab: dict[str, int]):
        tokens = {t.encode(): (s, len(t)) for t, s in vocab.items()}
        if b"" in tokens:
            raise ValueError("an empty token can't be encoded")
        used = sorted(set(b"".join(tokens)))
        self.classes, self.a = np.zeros(256, np.uint8), len(used) + 1  # UTF-8 has fewer than 255 bytes
        self.classes[used] = np.arange(1, self.a)
        nodes, keys = {b"": 0}, []  # numbered by depth; 0, the root, is no one's child
        for depth in range(1, max(map(len, tokens), default=0) + 1):
            for p in sorted({t[:depth] for t in tokens if len(t) >= depth}):
                keys.append(nodes[p[:-1]] * self.a + int(self.classes[p[-1]]))
                nodes[p] = len(nodes)
        of = [tokens.get(p, (-1, 0)) for p in nodes]
        self.slot, self.chars = np.array([s for s, _ in of], np.int32), np.array([n for _, n in of], np.int64)
        self.lead = min(map(len, tokens), default=1)
        while self.lead > 1 and self.a**self.lead > LEADS:
            self.lead -= 1
        self.leads = np.zeros(self.a**self.lead, np.int16 if len(nodes) < 1 << 15 else np.int32)
        for p, node in nodes.items():
            if len(p) == self.lead:
                self.leads[functools.reduce(lambda key, x: key * self.a + int(self.classes[x]), p, 0)] = node
        self.keys, self.dense = np.array(keys, np.int64), None
        self.children, order = np.arange(1, len(nodes), dtype=np.int32), np.argsort(self.keys)
        if len(nodes) * self.a <= TABLE:
            self.dense = np.zeros(len(nodes) * self.a, np.int32)
            self.dense[self.keys] = self.children
        self.keys, self.children = self.keys[order], self.children[order]

    def _next(self, node: np.ndarray, of: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense.take(node * np.int32(self.a) + of)
        key = node.astype(np.int64) * self.a + of
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.children[place], 0)

    def matches(self, data: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the leftmost longest tokens begin, their nodes and bytes."""
        m = len(data) - self.lead + 1
        if not len(self.keys) or m < 1:
            return (np.zeros(0, np.int64),) * 3
        c = np.frombuffer(data.tobytes().translate(self.classes.tobytes()), np.uint8)
        key = c[:m].astype(np.int64)
        for i in range(1, self.lead):
            key *= self.a
            key += c[i : m + i]
        node = self.leads.take(key)
        at = np.flatnonzero(node)
        node, rest = node[at].astype(np.int32), np.repeat(ends, sizes)[at] - at
        if self.lead > 1:  # across the end of a text
            at, node, rest = (x[rest >= self.lead] for x in (at, node, rest))
        best, size, on, depth = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64), np.arange(len(at)), self.lead
        while True:
            hit = self.slot[node] >= 0
            best[on[hit]], size[on[hit]] = node[hit], depth
            more = rest[on] > depth
            on, node = on[more], node[more]
            node, depth = self._next(node, c[at[on] + depth]), depth + 1
            found = np.flatnonzero(node)
            on, node = on[found], node[found]
            if not len(on):
                break
        begins = size > 0
        at, best, size = at[begins], best[begins], size[begins]
        chosen = _leftmost(at, at + size)
        return at[chosen], best[chosen], size[chosen]

    def encode(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Encoded bytes of all texts, and for each text where they begin (and the last one's end), its
        tokens and the characters in them."""
        ends = np.cumsum(sizes)
        borders = np.concatenate([[0], ends])
        at, node, size = self.matches(data, ends, sizes)
        slot, tokens = self.slot[node], np.searchsorted(at, borders)
        chars = np.concatenate([[0], np.cumsum(self.chars[node])])
        counts = np.diff(tokens), np.diff(chars[tokens])
        flags = np.flatnonzero(data == 1)
        if not len(flags) and (not len(size) or size.min() >= 3):  # codes stand in their tokens' first bytes
            out, kept = data.copy(), np.ones(len(data), bool)
            out[at], out[at + 1], out[at + 2] = 1, slot >> 4, slot & 15
            over, k = at[size > 3], 3
            left = size[size > 3]
            while len(over):
                kept[over + k] = False
                k += 1
                over, left = over[left > k], left[left > k]
            less = np.concatenate([[0], np.cumsum(size - 3)])
            return out[kept], borders - less[tokens], *counts
        inside = np.zeros(len(data) + 1, np.int8)
        inside[at] += 1
        inside[at + size] -= 1
        width = 1 - np.cumsum(inside[:-1], dtype=np.int64)
        flags = flags[width[flags] == 1]
        literal = width == 1
        literal[flags] = False
        width[at], width[flags] = 3, 3
        to = np.zeros(len(data) + 1, np.int64)
        np.cumsum(width, out=to[1:])
        out = np.empty(to[-1], np.uint8)
        out[to[:-1][literal]] = data[literal]
        for places, codes in ((flags, (1, 0, 1)), (at, (1, slot >> 4, slot & 15))):
            for i, code in enumerate(codes):
                out[to[places] + i] = code
        return out, to[borders], *counts


def _leftmost(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the ranges, sorted by begin, are taken from the left without overlap.  Those that no
    earlier one reaches are taken in any case; from these on, all runs are followed at once."""
    if not len(begin):
        return np.zeros(0, bool)
    after = np.searchsorted(begin, end) if len(begin) < 64 else np.concatenate([[0], np.cumsum(np.bincount(begin, minlength=end[-1] + 1))])[end]
    taken = np.ones(len(begin), bool)
    taken[1:] = np.maximum.accumulate(end)[:-1] <= begin[1:]
    i = np.flatnonzero(taken)
    for _ in range(ROUNDS):
        i = after[i]
        i = i[i < len(begin)]
        i = i[~taken[i]]
        taken[i] = True
        if not len(i):
            break
    else:  # long runs
        place = after.tolist()
        for j in i.tolist():
            while (j := place[j]) < len(place) and not taken[j]:
                taken[j] = True
    return taken


def text_slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of at most ``SLICE`` bytes of text or one row, their UTF-8 bytes and sizes (null: 0)."""
    column = batch.column(text).fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) else None
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], np.diff(offsets[i : j + 1])
        i = j


class Decoder:
    def __init__(self, vocab: dict[str, int]):
        self.tokens = {s: t.encode() for t, s in vocab.items()}

    def decode(self, data: bytes) -> str:
        out, i = [], 0
        while (j := data.find(FLAG, i)) >= 0:
            out.append(data[i:j])
            code = data[j + 1 : j + 3]
            if len(code) < 2:  # a truncated tail stays as it is
                i = j
                break
            found = FLAG if code == b"\x00\x01" else self.tokens.get(code[0] << 4 | code[1])
            if found is None:
                out.append(FLAG)
                i = j + 1
            else:
                out.append(found)
                i = j + 3
        return b"".join([*out, data[i:]]).decode("utf-8", "replace")


def vocab_map(vocab: DataFrame) -> dict[str, int]:
    """token -> slot; the slot space bounds it, and duplicate slots are refused."""
    rows = vocab.select("token", "slot").limit(SPACE + 1).collect()
    if len({s for _, s in rows}) < len(rows):
        raise ValueError("two tokens have one slot")
    return dict(rows)


def encode(docs: DataFrame, vocab: DataFrame, keep: list[str], text: str = "text", then: Callable[[Iterator], Iterator] | None = None, schema: str | None = None) -> DataFrame:
    """``keep`` with encoded, raw_bytes, enc_bytes, tokens, matched_chars; null text is null.  ``then`` makes
    batches of ``schema`` of these in the same Python worker: each worker more costs memory and a transfer."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab_map(vocab))
    added = [StructField("encoded", BinaryType()), *(StructField(c, LongType()) for c in ("raw_bytes", "enc_bytes", "tokens", "matched_chars"))]
    source = docs.select(*dict.fromkeys([*keep, text]))

    def run(batches):
        coder, single = BatchEncoder(shared.value), Encoder(shared.value)
        for batch in batches:
            for rows, data, sizes in text_slices(batch, text):
                if len(data) <= LONG:
                    out, begins, tokens, chars = coder.encode(data, sizes)
                else:  # one long text, whose tables would be large
                    found = list(single.pieces(data.tobytes().decode()))
                    out = np.frombuffer(b"".join(p.encode().replace(FLAG, b"\x01\x00\x01") if c is None else c for p, c in found), np.uint8)
                    begins, tokens, chars = np.array([0, len(out)]), np.array([sum(c is not None for _, c in found)]), np.array([sum(len(p) for p, c in found if c is not None)])
                null = rows.column(text).is_null().to_numpy(zero_copy_only=False)
                encoded = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
                if null.any():
                    encoded = pc.if_else(pa.array(~null), encoded, pa.scalar(None, pa.binary()))
                numbers = (sizes, np.diff(begins), tokens, chars)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), encoded, *(pa.array(x.astype(np.int64), mask=null) for x in numbers)], [*keep, *(f.name for f in added)])

    if then:
        return source.mapInArrow(lambda batches: then(run(batches)), schema)
    return source.mapInArrow(run, StructType([*source.select(*keep).schema.fields, *added]))


def decode(rows: DataFrame, vocab: DataFrame, keep: list[str], encoded: str = "encoded") -> DataFrame:
    """``keep`` with text."""
    shared = rows.sparkSession.sparkContext.broadcast(vocab_map(vocab))
    source = rows.select(*dict.fromkeys([*keep, encoded]))

    def run(batches):
        coder = Decoder(shared.value)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column(encoded).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return source.mapInArrow(run, StructType([*source.select(*keep).schema.fields, StructField("text", StringType())]))


def tokens_used(docs: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """token, uses: partial counts in each task, then one sum."""
    from pyspark.sql import functions as F

    shared = docs.sparkSession.sparkContext.broadcast(vocab_map(vocab))

    def run(batches):
        from collections import Counter

        coder, n = Encoder(shared.value), Counter()
        for batch in batches:
            for t in batch.column(text).to_pylist():
                n.update(p for p, c in coder.pieces(t or "") if c is not None)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["token", "n"])

    return docs.select(text).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("uses"))


__all__ = ["BatchEncoder", "Decoder", "Encoder", "decode", "encode", "tokens_used", "vocab_map"]
