"""Token counts of byte-level BPE vocabularies from pre-token frequencies.

BPE never merges across pre-tokens, so a text's token count is the sum over its distinct
pre-tokens of frequency times pieces.

1. One pass over the texts turns each block of documents (bounded) into pre-token frequencies,
   inverted: a row for each distinct pre-token of the block, with the documents that hold it and
   how often, packed.  Pre-tokens that are one entry of the vocabulary are counted on the spot:
   that table is bounded by the vocabulary file, and broadcast.  Blocks are a written table.
2. The rows are dealt out and sorted by pre-token.  Each run of equal pre-tokens is counted in
   pieces once, and joined to the frequencies as the run passes: a merge join in one stream.
3. Products are summed by document within a task, packed by block, and then over all tasks: the
   sums of a block meet in one stream, which gives one row for each document.

No ids of a document are ever made.  A pre-token that stands everywhere has one row for a block,
not for a document; in blocks where it takes HOT entries or more its rows are dealt over SALTS
tasks (and counted once in each), so no task gets more than a small row for each block.

Strings of added tokens inside a text are split off first and count one each, as the
library does by default.  Null text counts as empty: 0 bytes, 0 tokens.  Rows are counted one by
one, by their place in a block, so repeated rows, null ids and other columns need no care; an
empty table gives an empty one; texts are taken whole.  Kept columns are written with the blocks.
"""

from __future__ import annotations

import json
import os
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from slotgram.llm.common import ranges, table, written
from slotgram.scratch import settings

LIMIT = 1024
#: A block ends with the document that reaches one of these; a document's place takes two bytes.
BLOCK_CHARS, BLOCK_ROWS = 12 << 20, 1 << 16
HOT, SALTS = 512, 256
#: Documents whose sums a task holds at once.
SUM_CELLS = 4 << 20
#: A document's place in its block, and a frequency.
POSTING = np.dtype([("at", "<u2"), ("n", "u1")])
# Fixed value: the pre-token pattern of byte-level BPE with use_regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Splitter:
    """Pre-tokens of texts, and their pieces."""

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer

        config = json.loads(spec)
        pre = config["pre_tokenizer"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or config.get("normalizer"):
            raise ValueError("only byte-level vocabularies without normaliser or prefix space are supported")
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in config["added_tokens"]):
            raise ValueError("added tokens with white-space rules are not supported")
        self.added = [x["content"] for x in sorted(config["added_tokens"], key=lambda x: -len(x["content"]))]
        self.split = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.find = regex.compile(PATTERN).findall
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True

    def frequencies(self, text: str) -> tuple[int, Counter]:
        """Added tokens, and pre-token frequencies of the rest."""
        if not self.added or not any(x in text for x in self.added):
            return 0, Counter(self.find(text))
        parts, found = self.split.split(text), Counter()
        for part in parts:
            found.update(self.find(part))
        return len(parts) - 1, found

    def pieces(self, words: list[str]) -> list[int]:
        return [len(e) for i in range(0, len(words), 1000) for e in self.tokenizer.encode_batch_fast(words[i : i + 1000], add_special_tokens=False)]

    def entries(self) -> set[str]:
        """Texts of single entries of the vocabulary that are one piece."""
        words = [self.tokenizer.decode([i], skip_special_tokens=False) for i in range(self.tokenizer.get_vocab_size())]
        return {w for w, n in zip(words, self.pieces(words), strict=True) if n == 1}


class Block:
    """Inverted pre-token frequencies of successive documents."""

    def __init__(self, splitter: Splitter, single: set[str]):
        self.splitter, self.single, self.chars = splitter, single, 0
        self.numbers: dict[str, int] = {}
        self.sizes, self.known = array("q"), array("q")
        self.piece, self.at, self.times = array("i"), array("i"), array("q")

    def add(self, text: str) -> None:
        known, found = self.splitter.frequencies(text)
        at, numbers = len(self.sizes), self.numbers
        for word, n in found.items():
            if word in self.single:
                known += n
            else:
                self.piece.append(numbers.setdefault(word, len(numbers)))
                self.at.append(at)
                self.times.append(n)
        self.sizes.append(len(text.encode()))
        self.known.append(known)
        self.chars += len(text)

    def full(self) -> bool:
        return self.chars >= BLOCK_CHARS or len(self.sizes) >= BLOCK_ROWS

    def postings(self) -> tuple[pa.Array, pa.Array]:
        """Pre-tokens in order, and the documents of each; a frequency beyond a byte takes
        several entries."""
        piece, at, n = (np.frombuffer(x, x.typecode) if len(x) else np.zeros(0, np.int64) for x in (self.piece, self.at, self.times))
        entries = (n + 254) // 255
        of, k = np.repeat(np.arange(len(n)), entries), ranges(entries)
        order = np.argsort(piece[of], kind="stable")
        packed = np.zeros(len(of), POSTING)
        packed["at"], packed["n"] = at[of][order], np.minimum(n[of] - 255 * k, 255)[order]
        ends = np.zeros(len(self.numbers) + 1, np.int64)
        np.cumsum(np.bincount(piece[of], minlength=len(self.numbers)) * POSTING.itemsize, out=ends[1:])
        rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.numbers), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
        pieces = pa.array(list(self.numbers), pa.string()).cast(pa.binary())
        by = pc.sort_indices(pieces)  # neighbours share letters, which packs the table and the shuffle
        return pieces.take(by), rows.take(by).cast(pa.binary())


def blocks(batches: Iterator[pa.RecordBatch], splitter: Splitter, single: set[str], task: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, then one for each pre-token, of block after block."""
    names, number, held, block = ["block", "at", "kept", "n_bytes", "known", "piece", "rows"], task << 32, [], Block(splitter, single)

    def flushed():
        n, (pieces, rows) = len(block.sizes), block.postings()
        kept = pa.concat_arrays(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32)), kept, pa.array(block.sizes, pa.int64()), pa.array(block.known, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names)
        for i in range(0, len(pieces), 50_000):
            part, few = pieces[i : i + 50_000], rows[i : i + 50_000]
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.nulls(n, pa.int32()), pa.nulls(n, kept.type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), part, few], names)

    for batch in batches:
        start = 0
        for i, text in enumerate(batch.column("text")):
            block.add(text.as_py() or "")
            if block.full():
                held.append(batch.column("kept")[start : i + 1])
                yield from flushed()
                start, number, held, block = i + 1, number + 1, [], Block(splitter, single)
        held.append(batch.column("kept")[start:])
    if len(block.sizes):
        yield from flushed()


def packed_sums(at: np.ndarray, n: np.ndarray) -> bytes:
    """Steps between places, then sums, each byte by byte: shuffles compress what is alike."""
    return b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(at), -1).T).tobytes() for x in (np.diff(at, prepend=0).astype("<u2"), n.astype("<i8")))


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (block, at, n) for each document of the packed sums, which come block by block."""
    last, total = None, np.zeros(BLOCK_ROWS, np.int64)

    def flushed():
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), last)), pa.array(at.astype(np.int32)), pa.array(total[at])], ["block", "at", "n"])
        total[:] = 0

    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            if block != last:
                yield from flushed()
                last = block
            planes = np.frombuffer(data, np.uint8).reshape(10, -1)
            at, n = (np.ascontiguousarray(x.T).view(t).ravel() for x, t in ((planes[:2], "<u2"), (planes[2:], "<i8")))
            total[np.cumsum(at, dtype=np.int64)] += n
    yield from flushed()


def summed(batches: Iterator[pa.RecordBatch], splitter: Splitter) -> Iterator[pa.RecordBatch]:
    """Frequencies times pieces, summed by document as far as SUM_CELLS documents are held.
    Rows come in order of pre-tokens."""
    sums: dict[int, np.ndarray] = {}
    last, pieces = None, [0]

    def flushed():
        for block, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([packed_sums(at, total[at])], pa.binary())], ["block", "sums"])
        sums.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        runs = batch.column("piece").dictionary_encode()
        words = runs.dictionary.to_pylist()
        again = words[0] == last  # a run goes on
        pieces = pieces[-1:] * again + splitter.pieces([w.decode() for w in words[again:]])
        last = words[-1]
        rows = batch.column("rows").cast(pa.large_binary())
        ends = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
        packed = np.frombuffer(rows.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(POSTING)
        entries = np.diff(ends) // POSTING.itemsize
        product = packed["n"] * np.repeat(np.array(pieces, np.int64)[runs.indices.to_numpy()], entries)
        block, at = np.repeat(batch.column("block").to_numpy(), entries), packed["at"]
        for b in np.unique(block):
            here = block == b
            total = np.zeros(int(at[here].max()) + 1, np.int64)
            np.add.at(total, at[here], product[here])
            old = sums.get(int(b), total[:0])
            long, short = (old, total) if len(old) > len(total) else (total, old)
            long[: len(short)] += short
            sums[int(b)] = long
        if sum(map(len, sums.values())) > SUM_CELLS:
            yield from flushed()
    yield from flushed()


def token_counts(docs: DataFrame, tokenizer_path: str, keep: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """Columns ``keep`` (default: all) with n_bytes, n_tokens and over_limit (more than
    ``limit`` tokens).  ``tokenizer_path`` is read on the driver only."""
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    context = docs.sparkSession.sparkContext
    spec, single = context.broadcast(text), context.broadcast(Splitter(text).entries())  # bounded by the vocabulary file
    keep = list(dict.fromkeys(c for c in (keep or docs.columns) if c not in ("n_bytes", "n_tokens", "over_limit")))
    docs = docs.select(F.struct(*keep).alias("kept"), "text")
    schema = StructType([StructField("block", LongType()), StructField("at", IntegerType()), StructField("kept", docs.schema["kept"].dataType), StructField("n_bytes", LongType()), StructField("known", LongType()), StructField("piece", BinaryType()), StructField("rows", BinaryType())])

    def indexed(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads take memory
        yield from blocks(batches, Splitter(spec.value), single.value, TaskContext.get().partitionId())

    def multiplied(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        yield from summed(batches, Splitter(spec.value))

    with settings(docs.sparkSession, {"spark.sql.parquet.compression.codec": "zstd"}):
        index = written(docs.mapInArrow(indexed, schema), "token-index")
    postings = index.where("piece is not null").select("piece", "block", "rows").repartition("piece", F.when(F.octet_length("rows") < HOT * POSTING.itemsize, 0).otherwise(F.col("block") % SALTS)).sortWithinPartitions("piece")
    sums = postings.mapInArrow(multiplied, "block long, sums binary").repartition("block").sortWithinPartitions("block")
    totals = sums.mapInArrow(unpacked, "block long, at int, n long")
    tokens = F.col("known") + F.coalesce("n", F.lit(0))
    return index.where("at is not null").select("block", "at", "kept", "n_bytes", "known").join(totals, ["block", "at"], "left").select("kept.*", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))


def query(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])
