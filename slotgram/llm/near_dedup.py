"""Near-duplicate detection with SetSketch registers.

A document's set holds the hashes of its distinct shingles of ``SHINGLE`` words.  Register i
of its sketch is ``floor(1 - log_b(x))`` of the least of exponentially spaced values x that
hash i gives to the set, truncated to 16 bits: registers of a union are register-wise maxima
(mergeable), and two registers agree with probability close to the Jaccard similarity.

1. Rows with equal sets form one class (128-bit set digest), so copies never meet as pairs.
2. Registers are banded; classes that share a band value meet in a bucket.
3. In each bucket all members are compared with one hub, the member that shares most buckets
   with others: a number of pairs linear in the bucket.  Components of these links follow.
4. What is left are pairs x, y that share a hub H and are in different components, so that one
   of them, x, is not linked with H.  Seen from H, a set is what it adds and what it lacks.
   Linked pairs of that kind share an added shingle, or else y lacks shingles that x, but for
   a few, lacks too: fewer than a (|H| - |y|) with a = t / (1 + t).  (|x & H| < a (|x| + |H|),
   and without shared additions |x & y| = |x & H| - |lacks(y) - lacks(x)| must reach
   a (|x| + |y|).)  So pairs meet on added shingles, which are the rare ones in a group of
   near copies, or on that many lacked shingles of y, and pass only if the bound on |x & y|,
   with a bit signature of what each lacks and the place of the shared shingle in the order of
   each side, allows a link.  Edits of one text, which would meet in every bucket, so do not
   meet as pairs.  No member is capped or sampled.
5. Pairs of a hub are compared in full if the joint likelihood estimate from registers and set
   sizes is not far below the threshold, other pairs always; full sets confirm each link.

A pair at similarity 0.75 shares no band of 48 x 5 registers with probability 2e-6, and is
estimated below 0.62 with about 1e-6.

Nulls: null or wordless text has an empty set and links with nothing: its component is its
own id.  Null ids are kept rows; they take part, and a component's id is its least id that
is not null.  Repeated rows join one component.  Empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, ShortType, StructField, StructType

from slotgram.llm.common import Words, drop, mix, small, table, text_chunks, written
from slotgram.llm.url_filters import LOWER, UPPER

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
BASE, RATE = 1.001, 20.0
#: Estimates under this are not verified; its distance from 0.75 is nearly five standard errors.
LEAST_ESTIMATE = 0.62
#: 64-bit words of the signature of the hub's shingles that a set lacks.
SIGNATURE = 4
#: Rows whose registers are computed at once.
BLOCK = 1024

_RNG = np.random.Generator(np.random.PCG64(7))
_A = _RNG.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted inside it, and their bounds."""
    words = Words(buf, offsets, True)
    at = words.whole(k)
    few = np.flatnonzero((words.count > 0) & (words.count < k))
    values = np.concatenate([words.grams(k)[at], words.spans(words.first[few], words.first[few + 1])])
    text = np.concatenate([words.text_of()[at], few])
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[new], text[new]
    return values, np.searchsorted(text, np.arange(len(offsets)))


def registers(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of registers for each set; rows of empty sets are 0."""
    n = len(bounds) - 1
    out = np.zeros((n, REGISTERS), np.int16)
    full = np.flatnonzero(np.diff(bounds))
    halves = (values >> np.uint64(32)).astype(np.uint32), values.astype(np.uint32)
    for at in range(0, len(full), BLOCK):  # blocks of rows bound what the floats below take
        rows = full[at : at + BLOCK]
        lo, hi = bounds[rows[0]], bounds[rows[-1] + 1]
        least = np.empty((REGISTERS, len(rows)), np.uint32)
        for i in range(REGISTERS):
            least[i] = np.minimum.reduceat(halves[i % 2][lo:hi] * _A[i] + _B[i], bounds[rows] - lo)
        x = -np.log1p(-(least.T + 0.5) / 2.0**32) / RATE
        out[rows] = np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, 32767)
    return out


def joint_similarity(u: np.ndarray, v: np.ndarray, size_u: np.ndarray, size_v: np.ndarray) -> np.ndarray:
    """Row-wise maximum-likelihood Jaccard estimate from the numbers of registers that are
    greater, less and equal, given the set sizes (closed form for a base close to 1)."""
    more, less = (u > v).sum(1).astype(float), (u < v).sum(1).astype(float)
    same = u.shape[1] - more - less
    p = size_u / (size_u + size_v)
    q = 1 - p
    a, b = p * p * (same + less), q * q * (same + more)
    return (a + b - np.sqrt((a - b) ** 2 + 4 * less * more * p * p * q * q)) / (2 * u.shape[1] * p * q)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(pc.list_flatten(column)).reshape(len(column), -1)


SKETCH = StructType([StructField("n", LongType()), StructField("cid", BinaryType()), StructField("regs", ArrayType(ShortType()))])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n (set size), cid (set digest; null if empty), regs."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")

    def sketched(batches):
        for batch in batches:
            for i, j, buf, offsets in text_chunks(batch):
                values, bounds = shingle_sets(buf, offsets)
                n, full = np.diff(bounds), np.flatnonzero(np.diff(bounds))
                digest = np.zeros((j - i, 2), np.uint64)
                if len(full):
                    for c, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                        digest[full, c] = mix(np.add.reduceat(mix(values ^ np.uint64(salt)), bounds[:-1][full]) + n[full].astype(np.uint64))
                cid = pa.array([x if k else None for x, k in zip((digest[r].tobytes() for r in range(j - i)), n, strict=True)], pa.binary())
                flat = registers(values, bounds).reshape(-1)
                regs = pa.ListArray.from_arrays(np.arange(j - i + 1, dtype=np.int32) * REGISTERS, pa.array(flat, pa.int16()))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(n.astype(np.int64)), cid, regs], ["doc_id", "th", "n", "cid", "regs"])

    return docs.mapInArrow(sketched, StructType([*docs.select("doc_id", "th").schema.fields, *SKETCH.fields]))


BAND_KEYS = f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, slice(regs, b * {ROWS} + 1, {ROWS})))"


def estimated(pairs: DataFrame, least: float = LEAST_ESTIMATE) -> DataFrame:
    """x, y of the pairs (x, nx, rx, y, ny, ry) whose estimate is at least ``least``."""

    def kept(batches):
        for b in batches:
            if b.num_rows:
                j = joint_similarity(_matrix(b.column("rx")), _matrix(b.column("ry")), np.asarray(b.column("nx"), float), np.asarray(b.column("ny"), float))
                yield b.select(["x", "y"]).filter(pa.array(j >= least))

    return pairs.select("x", "nx", "rx", "y", "ny", "ry").mapInArrow(kept, "x binary, y binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, y, inter, total (sizes of intersection and union of the full sets)."""
    a, b = (sets.select(F.col("cid").alias(f"c{k}"), F.col("shingles").alias(f"s{k}")) for k in "xy")
    both = pairs.join(a, F.col("x") == F.col("cx")).join(b, F.col("y") == F.col("cy")).select("x", "y", "sx", "sy")

    def compared(batches):
        for batch in batches:
            inter, total = [], []
            for s, t in zip(batch.column("sx"), batch.column("sy"), strict=True):
                u, v = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                at = np.searchsorted(v, u)
                at[at == len(v)] = 0
                k = int((v[at] == u).sum())
                inter.append(k)
                total.append(len(u) + len(v) - k)
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(inter, pa.int64()), pa.array(total, pa.int64())], ["x", "y", "inter", "total"])

    return both.mapInArrow(compared, "x binary, y binary, inter long, total long")


def components(links: DataFrame) -> DataFrame:
    """node, label (least node reachable), of the nodes of ``links`` (x, y).  Labels take the
    least label among neighbours and then their label's label, until none changes, so a chain
    takes a number of steps that grows with the logarithm of its length; each step is written,
    and only a count reaches the driver."""
    edges = written(links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "components-edges")
    labels = written(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("label")), "components-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.least("label", "m").alias("l"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("l"), F.col("label").alias("ll"))
        new = written(step.join(jump, "l").select("node", F.least("l", "ll").alias("label"), "old"), "components-labels")
        drop(labels)
        if not new.where("label <> old").limit(1).count():
            drop(edges)
            out = new.select("node", "label")
            out.scratch_path = new.scratch_path
            return out
        labels = new.select("node", "label")
        labels.scratch_path = new.scratch_path


def differences(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """hub, cid, i (size of the intersection), n, nh (set sizes), added, lacked (differing
    shingles), probe (enough lacked shingles that one is lacked by every set that links
    without a shared addition), s0.. (signature of ``lacked``), label and loose for pairs (cid,
    hub, label, loose).  Batches are compared in small slices, so memory is bounded."""
    a, b = (sets.select(F.col("cid").alias(c), F.col("shingles").alias(f"s_{c}")) for c in ("cid", "hub"))
    both = pairs.join(a, "cid").join(b, "hub").select("hub", "cid", "s_cid", "s_hub", "label", "loose")
    signs = [f"s{k}" for k in range(SIGNATURE)]

    def compared(batches):
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            sizes, lists, marks = [], [], np.zeros((batch.num_rows, SIGNATURE), np.uint64)
            for row, (s, t, c) in enumerate(zip(batch.column("s_cid"), batch.column("s_hub"), batch.column("cid"), strict=True)):
                u, h = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                added, lacked = np.setdiff1d(u, h, True), np.setdiff1d(h, u, True)
                inter = len(u) - len(added)
                k = -(-percent * (len(h) - len(u)) // (100 + percent))
                probe = lacked[:0]
                if k > 0 and 100 * inter >= percent * len(u):
                    # an order of each row's own, so that no shingle becomes every row's key
                    probe = lacked[np.argsort(mix(lacked ^ np.frombuffer(c.as_py()[:8], np.uint64)[0]))[:k]]
                bit = mix(lacked) % np.uint64(64 * SIGNATURE)
                np.bitwise_or.at(marks[row], (bit >> np.uint64(6)).astype(int), np.uint64(1) << (bit & np.uint64(63)))
                sizes.append((inter, len(u), len(h)))
                lists.append((added.view(np.int64), lacked.view(np.int64), probe.view(np.int64)))
            cols = [pa.array([x[k] for x in sizes], pa.int64()) for k in range(3)]
            cols += [pa.array([x[k] for x in lists], pa.list_(pa.int64())) for k in range(3)]
            cols += [pa.array(np.ascontiguousarray(marks[:, k]).view(np.int64)) for k in range(SIGNATURE)]
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("cid"), *cols, batch.column("label"), batch.column("loose")], ["hub", "cid", "i", "n", "nh", "added", "lacked", "probe", *signs, "label", "loose"])

    return both.mapInArrow(compared, "hub binary, cid binary, i long, n long, nh long, added array<long>, lacked array<long>, probe array<long>, " + ", ".join(f"{s} long" for s in signs) + ", label binary, loose boolean")


def residual_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """x, y: pairs of ``members`` (cid, hub) that share a hub, differ in their component and
    may reach the threshold."""
    label = labels.select(F.col("node"), F.col("label").alias("l"))
    found = members.where("cid <> hub").distinct().join(label, F.col("cid") == F.col("node"), "left").select("cid", "hub", F.coalesce("l", "cid").alias("label"))
    found = found.join(label, F.col("hub") == F.col("node"), "left").select("cid", "hub", "label", (F.col("label") != F.coalesce("l", "hub")).alias("loose"))
    found = written(found, "near-grouped")
    groups = written(found.groupBy("hub").agg(F.count(F.lit(1)).alias("k"), F.max("loose").alias("any")).where("k > 1 and any").select("hub"), "near-groups")
    parts = written(differences(found.join(small(groups), "hub"), sets, percent), "near-differences")
    drop(found, groups)
    signs = [f"s{k}" for k in range(SIGNATURE)]

    def side(rows: DataFrame, elements: str, end: str) -> DataFrame:
        rows = rows.select("hub", F.posexplode(elements).alias("p", "e"), F.size("added").alias("d"), "cid", "i", "n", "label", "loose", *signs)
        return rows.toDF(*[f"{c}{end}" for c in rows.columns])

    lacks = " + ".join(f"bit_count({s}y & ~{s}x)" for s in signs)
    # what a link still needs in shared additions, times 100 + percent
    need = f"({percent} * (nx + ny) - {100 + percent} * (ix - ({lacks})))"
    apart = F.expr(f"hubx = huby and ex = ey and labelx <> labely and 100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
    loose = parts.where("loose")
    once = F.expr("not loosey or cidx < cidy")
    # added shingles are in one order, so the first shared one leaves enough after it on both sides
    shared = side(loose, "added", "x").join(side(parts, "added", "y"), apart & once & F.expr(f"{100 + percent} * least(dx - px, dy - py) >= {need}"))
    inside = side(loose.where(f"100 * i >= {percent} * n"), "lacked", "x").join(side(parts.where("size(probe) > 0"), "probe", "y"), apart & F.expr(f"{need} <= 0"))
    return shared.union(inside).select(F.col("cidx").alias("x"), F.col("cidy").alias("y")).distinct()


def class_labels(docs: DataFrame, sketch: DataFrame, percent: int = PERCENT) -> DataFrame:
    """cid, label: the component of each set digest that is linked with another."""
    classes = written(sketch.where("cid is not null").groupBy("cid").agg(F.min(F.struct("doc_id", "th")).alias("doc"), F.first("n").alias("n"), F.first("regs").alias("regs")), "near-classes")
    rows = classes.select("cid", "n", F.explode(F.expr(BAND_KEYS)).alias("key"))
    shared = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "near-shared")
    met = written(rows.join(shared, "key"), "near-members")
    score = written(met.groupBy("cid").agg(F.sum("k").alias("score")), "near-scores")
    hubs = met.join(score, "cid").groupBy("key").agg(F.max_by("cid", F.struct("score", "cid")).alias("hub"))
    members = written(met.join(written(hubs, "near-hubs"), "key").select("cid", "hub").distinct(), "near-stars")
    drop(shared, met)
    # full sets of the classes that met others, from one document each
    wanted = classes.join(score.select("cid"), "cid").select("cid", F.col("doc.doc_id").alias("_id"), F.col("doc.th").alias("_th"))
    texts = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text"))
    texts = texts.join(small(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("cid", "text")

    def listed(batches):
        for batch in batches:
            for i, j, buf, offsets in text_chunks(batch):
                values, bounds = shingle_sets(buf, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("cid").slice(i, j - i), pa.array([values[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["cid", "shingles"])

    sets = written(texts.mapInArrow(listed, "cid binary, shingles binary").dropDuplicates(["cid"]), "near-sets")
    x, y = (classes.select(F.col("cid").alias(k), F.col("n").alias(f"n{k}"), F.col("regs").alias(f"r{k}")) for k in "xy")
    like = F.expr(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
    stars = members.where("cid <> hub").select(F.col("cid").alias("x"), F.col("hub").alias("y")).join(x, "x").join(y, "y").where(like)
    linked = F.expr(f"100 * inter >= {percent} * total")
    labels = components(verified(estimated(stars), sets).where(linked))
    drop(classes, score)
    # later links join whole components, so only the components are nodes from here on
    rest = verified(residual_pairs(members, labels, sets, percent), sets).where(linked)
    of = lambda k: labels.select(F.col("node").alias(f"n{k}"), F.col("label").alias(f"l{k}"))
    rest = rest.join(of("x"), F.col("x") == F.col("nx"), "left").join(of("y"), F.col("y") == F.col("ny"), "left")
    rest = components(rest.select(F.coalesce("lx", "x").alias("x"), F.coalesce("ly", "y").alias("y")))
    drop(members, sets)
    rest = rest.toDF("old", "new")
    merged = labels.join(rest, F.col("label") == F.col("old"), "left").select(F.col("node").alias("cid"), F.coalesce("new", "label").alias("label"))
    alone = rest.join(labels, F.col("old") == F.col("node"), "left_anti")
    return merged.union(alone.select("old", "new"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, th, n_shingles, label, component_id, kept: one row per row of ``docs`` (doc_id,
    text).  ``th`` is xxhash64 of the text, for joining back where ids repeat; ``label`` names
    the component (null for an empty set)."""
    sketch = written(sketches(docs), "near-sketches")
    labels = class_labels(docs, sketch, percent)
    least = sketch.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("own"))
    least = least.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = written(least, "near-labels")
    # written, so that a component with very many classes can be split in the join back
    ids = written(least.groupBy("label").agg(F.min("own").alias("component_id")), "near-ids")
    of = least.join(ids, "label").select(F.col("cid").alias("c"), "label", "component_id")
    found = sketch.select("doc_id", "th", "n", "cid").join(of, F.col("cid") == F.col("c"), "left")
    found = found.withColumn("component_id", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return found.select("doc_id", "th", F.col("n").alias("n_shingles"), "label", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without near duplicates: of each component the row with the least id that is
    not null stays, once (of rows with equal id and text the one with the least hash of all
    columns); rows with empty sets all stay."""
    found = written(near_duplicates(docs, percent), "near-found")
    rows = found.groupBy("label", "doc_id", "th").agg(F.count(F.lit(1)).alias("rows"))
    first = rows.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "rows")).alias("d"))
    alone = rows.where("label is null").select("doc_id", "th", F.lit(1).alias("rows"))
    stay = written(first.select("d.doc_id", "d.th", "d.rows").union(alone), "near-stay").toDF("i", "t", "rows")
    # the row is one struct meanwhile, so that no column's name can clash
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("key"))
    joined = whole.join(small(stay), F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("t")))
    once = joined.where("rows > 1").groupBy("i", "t").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return joined.where("rows = 1").select("row").union(once.select("row")).select("row.*")


def query(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("th", "label")


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) AS s FROM (SELECT *, unnest(range(1, greatest(len(ws) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= {PERCENT} * (p.n + q.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id, d.doc_id = min(y) AS kept FROM d LEFT JOIN n USING (doc_id) JOIN r ON x = d.doc_id GROUP BY d.doc_id
"""
