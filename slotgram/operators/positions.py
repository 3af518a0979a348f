"""What stands at each place of a text: byte offsets, and the longest token that begins there.
Both are found inside a task, from whole texts, without a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from slotgram.functions.codec import vocab_map
from slotgram.operators.grams import BITS, blocks, code_points

#: Characters of the texts whose places are sent at once.
PLACES = 1 << 18


def byte_offsets(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos (from 1), byte_offset of each character of ``docs`` (key, text)."""
    source = docs.select(key, "text")

    def run(batches):
        for part, texts in blocks(batches, limit=PLACES):
            points, rest = code_points(texts)
            width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            sizes = np.array([len(t) for t in texts], np.int64)
            row = np.repeat(np.arange(len(texts)), sizes)
            before = np.cumsum(width) - width
            begins = np.cumsum(sizes) - sizes
            offset = before - before[begins[row]]
            yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(row)), pa.array((sizes[row] - rest + 1).astype(np.int32)), pa.array(offset.astype(np.int64))], [key, "pos", "byte_offset"])

    return source.mapInArrow(run, StructType([source.schema[key], StructField("pos", IntegerType()), StructField("byte_offset", LongType())]))


def trie(vocab: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each depth the sorted keys of its nodes (the parent's number and a code point), and the
    slot (-1: none) and UTF-8 length of the token that ends there."""
    levels, numbers, depth = [], {"": 0}, 1
    while ends := sorted({t[:depth] for t in vocab if len(t) >= depth}, key=lambda p: (numbers[p[:-1]], p[-1])):
        keys = np.array([numbers[p[:-1]] << BITS | ord(p[-1]) for p in ends], np.int64)
        levels.append((keys, np.array([vocab.get(p, -1) for p in ends], np.int64), np.array([len(p.encode()) for p in ends], np.int64)))
        numbers, depth = {p: i for i, p in enumerate(ends)}, depth + 1
    return levels


def longest_matches(docs: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos (from 1), slot, token_bytes: the longest token at each place that has one."""
    known = docs.sparkSession.sparkContext.broadcast(trie(vocab_map(vocab)))  # at most 3,570 tokens
    source = docs.select(key, "text")

    def run(batches):
        for part, texts in blocks(batches, limit=PLACES):
            points, rest = code_points(texts)
            slot, size = np.full(len(points), -1), np.zeros(len(points), np.int64)
            at, number = np.arange(len(points)), np.zeros(len(points), np.int64)
            for depth, (keys, slots, sizes) in enumerate(known.value):
                inside = rest[at] > depth
                at, number = at[inside], number[inside]
                wanted = number << BITS | points[at + depth]
                place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                ok = keys[place] == wanted
                at, number = at[ok], place[ok]
                ends = slots[number] >= 0
                slot[at[ends]], size[at[ends]] = slots[number[ends]], sizes[number[ends]]
            at = np.flatnonzero(slot >= 0)
            sizes = np.array([len(t) for t in texts], np.int64)
            row = np.repeat(np.arange(len(texts)), sizes)
            yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(row[at])), pa.array((sizes[row[at]] - rest[at] + 1).astype(np.int32)), pa.array(slot[at].astype(np.int32)), pa.array(size[at].astype(np.int32))], [key, "pos", "slot", "token_bytes"])

    return source.mapInArrow(run, StructType([source.schema[key], *(StructField(c, IntegerType()) for c in ("pos", "slot", "token_bytes"))]))
