"""Counting overlapping character grams.

Tasks look at blocks of texts as arrays of code points and send each distinct gram of a block
once, so memory is bounded and the result is exact; sums follow after one shuffle.
"""

from __future__ import annotations

import functools
import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

#: Characters of a block, and bits of a code point.
BLOCK, BITS = 2 << 20, 21
#: In counting length by length: characters of a block, rows that a task holds before they leave, and
#: counters of one table; in counting pairs, pairs of one table.
LEVEL_BLOCK, HELD, TABLE = 1 << 20, 1 << 20, 1 << 21
PAIRS = 1 << 17


def _lengths(lo: int, hi: int) -> None:
    if not 1 <= lo <= hi:
        raise ValueError("lengths need 1 <= shortest <= longest")


def explode_grams(docs: DataFrame, keys: list[str], lo: int, hi: int) -> DataFrame:
    """keys, n, pos (from 1), gram: one row for each gram, by built-in expressions."""
    _lengths(lo, hi)
    c = docs.where("length(text) > 0").select(*keys, F.split("text", "").alias("c")).withColumn("c", F.filter("c", lambda x: x != ""))
    c = c.select(*keys, "c", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("n")).where("size(c) >= n")
    grams = c.select(*keys, "n", "c", F.explode(F.expr("sequence(1, size(c) - n + 1)")).alias("pos"))
    return grams.select(*keys, "n", "pos", F.array_join(F.slice("c", F.col("pos"), F.col("n")), "").alias("gram"))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and how many follow each in its text, itself included."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    return points, np.repeat(ends, sizes) - np.arange(len(points))


def _plain_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each text ends."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([len(t) for t in texts])


def _across(ends: np.ndarray, n: int, m: int) -> np.ndarray:
    """Those of the first m places from which n characters reach over the end of a text."""
    at = np.concatenate([ends - i for i in range(1, n)] or [ends[:0]])
    return at[(at >= 0) & (at < m)]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches and their texts (null: empty), of at most ``limit`` characters or one text."""
    for batch in batches:
        texts, i = [t or "" for t in batch.column(column).to_pylist()], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= limit):
                size, j = size + len(texts[j]), j + 1
            yield batch.slice(i, j - i), texts[i:j]
            i = j


def distinct_grams(texts: list[str], group: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n, first positions and counts of the distinct grams of each length, told apart by the
    ``group`` of their text.  A gram is numbered by its prefix's number and its last character."""
    points, rest = code_points(texts)
    if not len(points):
        return
    letters, c = np.unique(points, return_inverse=True)
    a = len(letters)
    g = np.repeat(group, [len(t) for t in texts])
    at = np.flatnonzero(rest >= 1)
    n, number = 1, g * a + c
    while n < lo and (int(group.max()) + 1) * a ** (n + 1) < 2**62:  # short grams are numbers as they are
        more = rest[at] > n
        at, number = at[more], number[more]
        number = number * a + c[at + n]
        n += 1
    if not len(at):
        return
    while True:
        _, first, number, count = np.unique(number, return_index=True, return_inverse=True, return_counts=True)
        if n >= lo:
            yield n, at[first], count
        if n == hi:
            return
        more = rest[at] > n
        at, number = at[more], number[more]
        if not len(at):
            return
        number = number * a + c[at + n]
        n += 1


def count_grams(docs: DataFrame, lo: int, hi: int, keys: list[str] | None = None) -> DataFrame:
    """keys, gram, cnt."""
    _lengths(lo, hi)
    keys = keys or []
    source = docs.where("text is not null").select(*keys, "text")

    def run(batches):
        for part, texts in blocks(batches):
            values = list(zip(*(part.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * len(texts)
            numbers = {v: i for i, v in enumerate(dict.fromkeys(values))}
            group = np.array([numbers[v] for v in values], np.int64)
            row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            whole = "".join(texts)
            for n, first, count in distinct_grams(texts, group, lo, hi):
                of = pa.array(row[first])
                grams = pa.array([whole[i : i + n] for i in first.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(of) for k in keys), grams, pa.array(count.astype(np.int64))], [*keys, "gram", "cnt"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "gram string, cnt long"])
    return source.mapInArrow(run, schema).groupBy(*keys, "gram").agg(F.sum("cnt").alias("cnt"))


def ranked(counts: DataFrame, k: int) -> DataFrame:
    """The k first grams by count (descending), length and text."""
    return counts.orderBy(F.desc("cnt"), F.length("gram"), "gram").limit(k)


class _Sums:
    """Sums of counts by group and key (numbers), merged when they have grown to ``HELD`` rows."""

    def __init__(self):
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, g: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows leave if merging them doesn't halve them."""
        self.parts.setdefault(g, []).append((keys, counts))
        self.size += len(keys)
        if self.size > HELD:
            self._merge()
            if self.size > HELD // 2:
                yield from self.rows()

    def _merge(self) -> None:
        for g, rows in self.parts.items():
            keys, counts = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            self.parts[g] = [(keys[first], np.add.reduceat(counts[order], first) if len(first) else counts)]
        self.size = sum(len(rows[0][0]) for rows in self.parts.values())

    def rows(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        for g, ((keys, counts),) in self.parts.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), g, np.int32)), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], ["g", "key", "cnt"])
        self.parts, self.size = {}, 0


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str]]]:
    """Group and texts, block by block."""
    for part, texts in blocks(batches, limit=LEVEL_BLOCK):
        of = part.column("g").to_numpy()
        for g in np.unique(of).tolist():
            yield g, [texts[i] for i in np.flatnonzero(of == g)]


def _counted(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers below ``size`` and their counts."""
    if size > TABLE or size > 64 * len(numbers):
        return np.unique(numbers, return_counts=True)
    counts = np.bincount(numbers, minlength=1)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _shortest(docs: DataFrame, lo: int) -> DataFrame:
    """g, key, cnt of all grams of lo characters; a key is their code points."""

    def run(batches):
        sums = _Sums()
        for g, texts in _grouped(batches):
            points, ends = _plain_points(texts)
            m = len(points) - lo + 1
            if m < 1:
                continue
            seen = np.zeros(int(points.max()) + 1, bool)
            seen[points] = True
            letters = np.flatnonzero(seen)
            a, c = len(letters), np.zeros(len(seen), np.int64)
            c[letters] = np.arange(a)
            c = c.take(points)
            number = c[:m].copy()
            for i in range(1, lo):
                number *= a
                number += c[i : m + i]
            number[_across(ends, lo, m)] = a**lo
            found, count = _counted(number, a**lo + 1)
            if len(found) and found[-1] == a**lo:
                found, count = found[:-1], count[:-1]
            key = np.zeros(len(found), np.int64)
            for i in range(lo):
                key = key << BITS | letters[found // a ** (lo - 1 - i) % a]
            yield from sums.add(g, key, count)
        yield from sums.rows()

    return docs.mapInArrow(run, "g int, key long, cnt long").groupBy("g", "key").agg(F.sum("cnt").alias("cnt"))


class _Table:
    """Places of numbers below ``size`` in their sorted list; -1: not there."""

    def __init__(self, numbers: np.ndarray, size: int, most: int):
        self.numbers, self.dense = numbers, None
        if size <= most:
            self.dense = np.full(size, -1, np.int32)
            self.dense[numbers] = np.arange(len(numbers))

    def find(self, numbers: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense.take(numbers)
        if not len(self.numbers):
            return np.full(len(numbers), -1)
        place = np.minimum(np.searchsorted(self.numbers, numbers), len(self.numbers) - 1)
        return np.where(self.numbers[place] == numbers, place, -1)


class _Kept:
    """Finds the kept grams of each group in texts: ``tables`` has for each group the sorted keys of
    its grams of lo, lo + 1, ... characters.  A key is the lo code points, or the prefix's place in
    its table and the last code point."""

    def __init__(self, lo: int, tables: dict[int, list[np.ndarray]]):
        self.lo, mask = lo, (1 << BITS) - 1
        firsts = [t[0] >> BITS * i & mask for t in tables.values() for i in range(lo)]
        self.letters = np.unique(np.concatenate(firsts))  # later characters end kept grams of lo characters, too
        self.a = len(self.letters) + 1
        self.classes = np.full(self.letters[-1] + 2, self.a - 1, np.int64)
        self.classes[self.letters] = np.arange(self.a - 1)
        most = TABLE * 4 // max(1, sum(map(len, tables.values())))
        self.tables = {}
        for g, (first, *more) in tables.items():
            number = np.zeros(len(first), np.int64)
            for i in range(lo - 1, -1, -1):
                number = number * self.a + self.classes[first >> BITS * i & mask]
            found, before = [_Table(number, self.a**lo, most)], len(first)
            for t in more:
                found.append(_Table((t >> BITS) * self.a + self.classes[t & mask], before * self.a, most))
                before = len(t)
            self.tables[g] = found

    def first(self, g: int, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of the characters, ends of the texts, and for each character the place in its table of
        the kept gram of lo characters that begins there, or -1."""
        points, ends = _plain_points(texts)
        if len(points) and points.max() >= len(self.classes):
            points = np.minimum(points, np.uint32(len(self.classes) - 1))
        c, place = self.classes.take(points), np.full(len(points), -1, np.int64)
        m = max(0, len(points) - self.lo + 1)
        number = c[:m].copy()
        for i in range(1, self.lo):
            number *= self.a
            number += c[i : m + i]
        place[:m] = self.tables[g][0].find(number)
        place[_across(ends, self.lo, m)] = -1
        return c, ends, place

    def walk(self, g: int, texts: list[str]):
        """Classes of the characters, how many follow each, where the longest kept grams begin and
        their places in their table, and a mark at each of these beginnings."""
        c, ends, place = self.first(g, texts)
        rest, ok = np.repeat(ends, np.diff(ends, prepend=0)), np.zeros(len(c) + 1, bool)
        rest -= np.arange(len(rest))
        at = np.flatnonzero(place >= 0)
        place = place[at]
        for n, table in enumerate(self.tables[g][1:], self.lo):
            at, place = self.longer(n, at, place, rest, ok)
            place = table.find(place * self.a + c[at + n])
            at, place = at[place >= 0], place[place >= 0]
        ok[at] = True
        return c, rest, at, place.astype(np.int64), ok

    def longer(self, n: int, at, place, rest, ok):
        """Those kept grams of n characters which the next one follows at once: a gram's prefix and its
        suffix are as frequent as the gram."""
        ok[:] = False
        ok[at] = True
        more = ok[at + 1] & (rest[at] > n)
        return at[more], place[more].astype(np.int64)


def _next_level(docs: DataFrame, lo: int, tables: dict[int, list[np.ndarray]]) -> DataFrame:
    """g, key, cnt of the grams by one character longer than the last ones of ``tables`` whose prefix
    and suffix are there; keys, as in ``_Kept``, are in the order of the texts."""
    known = docs.sparkSession.sparkContext.broadcast(tables)  # fewer than k numbers for each group and length

    def run(batches):
        kept, sums = _Kept(lo, known.value), _Sums()
        for g, texts in _grouped(batches):
            if g in kept.tables:
                c, rest, at, place, ok = kept.walk(g, texts)
                n, a = lo + len(kept.tables[g]) - 1, kept.a
                at, place = kept.longer(n, at, place, rest, ok)
                found, count = _counted(place * a + c[at + n], len(kept.tables[g][-1].numbers) * a)
                yield from sums.add(g, found // a << BITS | kept.letters[found % a], count)
        yield from sums.rows()

    return docs.mapInArrow(run, "g int, key long, cnt long").groupBy("g", "key").agg(F.sum("cnt").alias("cnt"))


def _pairs(docs: DataFrame, lo: int, hi: int, tables: dict[int, list[np.ndarray]]) -> DataFrame:
    """g, key, cnt of the longer grams, up to hi characters, that begin and end with one of the last ones of
    ``tables``, if hi is at most twice their length: a gram is that pair and its distance.  A key is the distance,
    and the places of both; so keys are in the order of length and text."""
    known = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        kept, sums, n = _Kept(lo, known.value), _Sums(), lo - 1 + len(next(iter(known.value.values())))
        for g, texts in _grouped(batches):
            if g not in kept.tables:
                continue
            k = len(kept.tables[g][-1].numbers)
            if n == lo:
                _, ends, place = kept.first(g, texts)
                place[place < 0] = k
            else:
                c, rest, at, found, _ = kept.walk(g, texts)
                ends, place = np.flatnonzero(rest == 1) + 1, np.full(len(c), k)
                place[at] = found
            begin = place * (k + 1)
            for more in range(1, hi - n + 1):
                pair = begin[:-more] + place[more:]
                if more == n:  # those before do not share a character
                    over = ends - n
                    pair[over[(over >= 0) & (over < len(pair))]] = (k + 1) ** 2 - 1
                found, count = _counted(pair, (k + 1) ** 2)
                both = (found < k * (k + 1)) & (found % (k + 1) < k)
                yield from sums.add(g, found[both] + more * (k + 1) ** 2, count[both])
        yield from sums.rows()

    return docs.mapInArrow(run, "g int, key long, cnt long").groupBy("g", "key").agg(F.sum("cnt").alias("cnt"))


def _all_longer(docs: DataFrame, lo: int, hi: int, tables: dict[int, list[np.ndarray]]) -> DataFrame:
    """g, gram, cnt of the longer grams, up to hi characters, that are made of the last ones of
    ``tables``: one of these begins at each of their characters that has enough after it."""
    known = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        kept, sums, n = _Kept(lo, known.value), Counter(), lo - 1 + len(next(iter(known.value.values())))

        def rows():
            columns = list(zip(*((g, gram, k) for (g, gram), k in sums.items()), strict=True)) or [(), (), ()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.string(), pa.int64()), strict=True)], ["g", "gram", "cnt"])

        for g, texts in _grouped(batches):
            if g not in kept.tables:
                continue
            c, rest, at, number, ok = kept.walk(g, texts)
            whole = "".join(texts)
            for m in range(n + 1, hi + 1):
                inside = rest[at] >= m
                at, number = at[inside], number[inside]
                inside = ok[at + m - n]
                at, number = at[inside], number[inside] * kept.a + c[at[inside] + m - 1]
                if not len(at):
                    break
                _, first, number, count = np.unique(number, return_index=True, return_inverse=True, return_counts=True)
                for i, k in zip(at[first].tolist(), count.tolist(), strict=True):
                    sums[g, whole[i : i + m]] += k
            if len(sums) > HELD // 8:
                yield rows()
        yield rows()

    return docs.mapInArrow(run, "g int, gram string, cnt long").groupBy("g", "gram").agg(F.sum("cnt").alias("cnt"))


def levelwise(docs: DataFrame, lo: int, hi: int, k: int, min_freq: int, keys: list[str] | None = None) -> DataFrame:
    """The same rows as ``ranked(count_grams(...), k)`` (keys, gram, cnt: for each group of ``keys``),
    without counting every long gram: a gram is at most as frequent as its prefix and its suffix, and
    where counts tie the shorter one ranks first.  So once k grams are found, a longer one needs both
    to be more frequent than the k-th of them, and fewer than k are.  The texts are read once for each
    length until one in 32 places is left, or until few grams are left of at least half the characters,
    then once for all longer grams.  For each group the driver gets at most k rows for each read.  Grams of more than three characters at least are
    counted in full."""
    _lengths(lo, hi)
    spark, keys = docs.sparkSession, keys or []
    fields = [docs.schema[x] for x in keys]
    schema = StructType([*fields, StructField("gram", StringType()), StructField("cnt", LongType())])
    if lo * BITS > 63:
        counts = count_grams(docs, lo, hi, keys).where(F.col("cnt") >= min_freq)
        if not keys:
            return ranked(counts, k)
        order = Window.partitionBy(*keys).orderBy(F.desc("cnt"), F.length("gram"), "gram")
        return counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
    source, groups = docs.where("text is not null").select(*keys, "text"), [()]
    if keys:
        groups = [tuple(r) for r in source.select(*keys).distinct().collect()]
        if not groups:
            return spark.createDataFrame([], schema)
        names = [f"__{i}" for i in range(len(keys))]
        ids = spark.createDataFrame([(*v, g) for g, v in enumerate(groups)], StructType([*(StructField(x, f.dataType) for x, f in zip(names, fields, strict=True)), StructField("g", IntegerType())]))
        same = functools.reduce(operator.and_, (source[x].eqNullSafe(ids[y]) for x, y in zip(keys, names, strict=True)))
        source = source.join(F.broadcast(ids), same).select("g", "text")
    else:
        source = source.select(F.lit(0).alias("g"), "text")

    def first(counts: DataFrame, *order) -> dict[int, list]:
        """The k first rows of each group that are frequent enough."""
        counts = counts.where(F.col("cnt") >= F.get(F.lit([least(g) for g in range(len(groups))]), F.col("g")))
        if len(groups) == 1:
            rows = counts.orderBy(F.desc("cnt"), *order).limit(k).collect()
        else:
            place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("cnt"), *order))
            rows = counts.withColumn("r", place).where(F.col("r") <= k).collect()
        found: dict[int, list] = {}
        for r in rows:
            found.setdefault(r["g"], []).append(r)
        return found

    def least(g: int) -> int:
        return max(min_freq, best[g][-1][1] + 1) if k and len(best[g]) == k else min_freq

    def add(g: int, rows: list[tuple[str, int]]) -> None:
        best[g] = sorted([*best[g], *rows], key=lambda r: (-r[1], len(r[0]), r[0]))[:k]

    best: list[list[tuple[str, int]]] = [[] for _ in groups]
    tables: dict[int, list[np.ndarray]] = {g: [] for g in range(len(groups))}
    prefixes: dict[int, list[str]] = {}
    mask, whole = (1 << BITS) - 1, 0
    for n in range(lo, hi + 1):
        level = first(_next_level(source, lo, tables) if n > lo else _shortest(source, lo), "key")
        places = 0
        for g in list(tables):
            rows = [(r["key"], prefixes[g][r["key"] >> BITS] + chr(r["key"] & mask) if n > lo else "".join(chr(r["key"] >> BITS * i & mask) for i in range(lo - 1, -1, -1)), r["cnt"]) for r in level.get(g, ())]
            add(g, [(gram, c) for _, gram, c in rows])
            if kept := sorted(r for r in rows if r[2] >= least(g)):
                tables[g] = [*tables[g], np.array([x for x, _, _ in kept], np.int64)]
                prefixes[g] = [gram for _, gram, _ in kept]
                places += sum(c for _, _, c in kept)
            else:
                del tables[g]
        whole = whole or places
        if not tables:
            break
        if n < hi <= 2 * n and all((len(t[-1]) + 1) ** 2 <= PAIRS for t in tables.values()):
            for g, rows in first(_pairs(source, lo, hi, tables), "key").items():
                size = len(prefixes[g]) + 1
                pairs = [(r["key"] // size**2, prefixes[g][r["key"] // size % size], prefixes[g][r["key"] % size], r["cnt"]) for r in rows]
                add(g, [(begin + end[-more:], c) for more, begin, end, c in pairs])
            break
        if n < hi and 32 * places <= whole:
            for g, rows in first(_all_longer(source, lo, hi, tables), F.length("gram"), "gram").items():
                add(g, [(r["gram"], r["cnt"]) for r in rows])
            break
    return spark.createDataFrame([(*v, gram, c) for v, rows in zip(groups, best, strict=True) for gram, c in rows], schema)
