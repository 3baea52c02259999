"""Near-duplicates by an LSH forest of MinHash signatures.

Every text becomes the set of its word shingles (``SHINGLE`` words; blanks
separate words, A-Z lowered).  Texts with equal sets collapse to the smallest
id, so copies are never paired.  Each remaining set has ``HASHES`` MinHash
values.  The forest is ``TREES`` sorted orders of the signatures: tree t reads
the values from its own offset on, so the first ``DEPTH`` of all trees are
independent.  Rows are range-partitioned and sorted by (tree, signature); a
row's candidates are the next ``NEIGHBOURS`` rows that share at least
``DEPTH`` values with it.  Sorted neighbours share the longest prefixes, so
the depth adapts to each region: in a sparse region all rows that share
``DEPTH`` values meet, in a dense one only those that share more.  Regions of
any size are split over partitions; the rows at partition edges are paired in
a second, small step.  A sketch of low bits of all values drops most pairs
that can't reach the threshold before they leave the task.

A region with more rows than neighbours reach is dense, and its neighbours are
not all pairs.  Once the components are known, all rows of such a region that
are of different components are compared by their sketches, in blocks, so no
pair is lost to the number of neighbours.  Blocks are bounded by rows and by
shingles.  A block joins components as it finds links and only hands on the
links that joined two, so its output is of the order of its rows.

Candidate pairs are confirmed on the full sets: first each document with a few
of its likely partners, those with the smallest ids and those that agree most;
then all pairs that still join two components; then those of dense regions.  Pairs
inside a component change nothing and are not compared.  A pivot's pairs
are salted into chunks, and streamed past the pivot's set.

Recall: a pair at a Jaccard similarity of 0.8 misses one tree with probability
1 - 0.8**3, and all 21 with 3e-7; the sketch loses about 3e-5 of such pairs.

No key is hot: copies of a text, links of a node and rows of a region meet
their class, smallest neighbour and counts by :func:`join_heavy`.

Edge cases: a text with fewer words than a shingle is one shingle of all of
them; texts without words, or null, have no set and no links; very long texts
are whole sets like others, one such text at a time in memory; rows that repeat
an id are one document, which has the links of all its texts, and each row is
returned; a null id links with nothing, has a null component and is kept; ties
go to the smallest id; an empty table gives no rows.  Only ``doc_id`` and
``text`` are read, whatever other columns there are and however they are named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernels as K
from quillstone.llm.common import discard, join_heavy, map_arrow, materialise, stored
from quillstone.llm.components import components

SHINGLE = 5
PERCENT = 80
TREES = 21
DEPTH = 3
LEVELS = 8
DENSE = -1
HASHES = TREES * DEPTH
NEIGHBOURS = 10
#: Of a dense region's rows, the nearest that a row is paired with before the region is compared across components.
NEAREST = 3
#: Rows at each side of a partition's edge: enough to see any region that no side sees as dense.
EDGE = 2 * NEIGHBOURS + 2
#: Rows of a dense region that are compared with up to VISITORS others in one block, and the shingles of either.
RESIDENTS = 4096
VISITORS = 4096
BLOCK_SHINGLES = 4 << 20
#: Of the 63 three-bit values of two sketches, those that must agree (0.8 expects 52, with a spread of 3).
AGREE = 40
#: The same for pairs that are likely links, compared first.
LIKELY = 48
#: Likely partners of a document in the first round, of each kind.
BEST = 2
#: Pairs of a pivot that are compared in one chunk.
CHUNK = 64

_rng = np.random.default_rng(17)
_MULTIPLY = (_rng.integers(0, 1 << 31, HASHES, dtype=np.int64) * 2 + 1).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.int64).astype(np.uint32)
_ORDER = (np.arange(TREES)[:, None] * DEPTH + np.arange(LEVELS)[None, :]) % HASHES
_THREE = sum(1 << (3 * i) for i in range(21))

#: keys: eight 16-bit values in two longs, for each tree.
NODE = "n_shingles long, f0 long, f1 long, keys array<long>, sketch array<long>"


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (repeats included) and n+1 offsets by row."""
    lower = K.LOWER[data]
    starts, ends, by = K.spans(lower, offsets, K.NOT_BLANK)
    h = K.hash_spans(lower, starts, ends)
    n = np.diff(by)
    row = K.row_of(by)
    out = np.full(len(h), size, K.U64)
    left = by[row + 1] - np.arange(len(h))
    for k in range(size):
        there = left > k
        at = np.flatnonzero(there)
        out[at] = K.mix(out[at] * K.U64(0x9E3779B97F4A7C15) + h[at + k])
    # a row has its full shingles, or the one at its first word
    inner = np.arange(len(h)) - by[row]
    keep = (left >= size) | ((inner == 0) & (n[row] < size))
    counts = np.bincount(row[keep], minlength=len(n)) if len(h) else np.zeros(len(n), np.int64)
    return out[keep], np.concatenate([[0], np.cumsum(counts)])


def distinct(values: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's set of hashes, sorted, and n+1 offsets by row."""
    rows = len(by) - 1
    if rows > 1 << 16:
        row = K.row_of(by)
        order = np.lexsort((values, row))
        row = row[order]
    else:
        # a stable sort of 16-bit numbers is a radix sort
        row = K.row_of(by).astype(np.uint16)
        order = np.argsort(values)
        order = order[np.argsort(row[order], kind="stable")]
        row = row[order]
    values = values[order]
    if len(values):
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (row[1:] != row[:-1])])
        values, row = values[new], row[new]
    return values, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])


def signature(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    """HASHES MinHash values (32 bits, scrambled) of each row's set."""
    x = (K.mix(values + K.U64(0x51ED27)) >> K.U64(32)).astype(np.uint32)
    out = np.zeros((len(by) - 1, HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = K.per_row(x * _MULTIPLY[k] + _ADD[k], by, np.minimum)
    return (K.mix(out.astype(K.U64) + (np.arange(HASHES, dtype=K.U64) << K.U64(32))) >> K.U64(32)).astype(np.uint32)


def sketch(sig: np.ndarray) -> np.ndarray:
    """Three low bits of every value, 21 values in each of three longs."""
    low = (sig & np.uint32(7)).astype(K.U64).reshape(len(sig), 3, 21)
    return (low << (K.U64(3) * np.arange(21, dtype=K.U64))).sum(axis=2, dtype=K.U64)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the 63 values of two rows of sketches agree."""
    x = a ^ b
    x = (x | (x >> K.U64(1)) | (x >> K.U64(2))) & K.U64(_THREE)
    return HASHES - np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def nodes(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, f0 and f1 (128 bits of the set), keys (of each tree) and sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column(1)):
                values, by = distinct(*shingles(part.data, part.offsets, size))
                fp = [pa.array(K.per_row(K.mix(values ^ K.U64(k)), by).view(np.int64)) for k in (0, 0x5851F42D4C957F2D)]
                sig = signature(values, by)
                short = ((sig.astype(K.U64) >> K.U64(3)) & K.U64(0xFFFF))[:, _ORDER]
                shift = K.U64(16) * np.array([3, 2, 1, 0], K.U64)
                keys = (short.reshape(len(part), TREES, 2, 4) << shift).sum(axis=3, dtype=K.U64).view(np.int64).reshape(len(part), 2 * TREES)
                rows = len(part)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel())) for x in (keys, sketch(sig).view(np.int64))]
                yield pa.record_batch([batch.column(0).slice(part.first, rows), pa.array(np.diff(by), pa.int64()), *fp, *lists], names=["doc_id", "n_shingles", "f0", "f1", "keys", "sketch"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, f"doc_id long, {NODE}")


_FOREST = ("tree", "p", "q", "node", "n", "s0", "s1", "s2")
_PAIRS = "part long, a long, b long, agree int, forest array<long>"


def _neighbours(x: np.ndarray, first_new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of sorted forest rows of which the second is at or after ``first_new``: (a, b, agreeing values)."""
    out = []
    tree, p, _, node, n = (x[:, i] for i in range(5))
    s = x[:, 5:8].view(np.uint64)
    region = p >> 16
    for k in range(1, NEIGHBOURS + 1):
        j = np.arange(max(k, first_new), len(x))
        i = j - k
        ok = (tree[i] == tree[j]) & (region[i] == region[j]) & (node[i] != node[j])
        ok &= 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
        if k > NEAREST:
            back = np.maximum(j - NEIGHBOURS - 1, 0)
            ok &= (j <= NEIGHBOURS) | (tree[back] != tree[j]) | (region[back] != region[j])
        i, j = i[ok], j[ok]
        agree = agreeing(s[i], s[j])
        ok = agree >= AGREE
        i, j = i[ok], j[ok]
        out.append((np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), agree[ok]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    """Forest rows as a table, from their columns or from lists."""
    if "forest" in batch.schema.names:
        return batch.column("forest").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), len(_FOREST))
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _FOREST]) if len(batch) else np.zeros((0, len(_FOREST)), np.int64)


def _marker(part: int, rows: int) -> pa.RecordBatch:
    """How many rows, EDGE at most, the partition ``part`` has."""
    none = pa.nulls(1, pa.int64())
    return pa.record_batch([pa.array([part], pa.int64()), pa.array([rows], pa.int64()), none, pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.int64()))], names=["part", "a", "b", "agree", "forest"])


def _rows(part: int | None, pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | None, forest: np.ndarray | None) -> pa.RecordBatch:
    """Pairs, rows beside the edge ``part``, or (without one) rows of dense regions, which agree as DENSE."""
    n = len(pairs[0]) if pairs is not None else len(forest)
    names = ["part", "a", "b", "agree", "forest"]
    none = pa.nulls(n, pa.int64())
    if pairs is not None:
        a, b, agree = pairs
        return pa.record_batch([none, pa.array(a), pa.array(b), pa.array(agree, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))], names=names)
    place, kind = (none, pa.array(np.full(n, DENSE, np.int32))) if part is None else (pa.array(np.full(n, part, np.int64)), pa.nulls(n, pa.int32()))
    rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(_FOREST), pa.int32()), pa.array(np.ascontiguousarray(forest).ravel(), pa.int64()))
    return pa.record_batch([place, none, none, kind, rows], names=names)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The region number of each sorted forest row, and the length of its region."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = (x[1:, 0] != x[:-1, 0]) | ((x[1:, 1] >> 16) != (x[:-1, 1] >> 16))
    number = np.concatenate([[0], np.cumsum(new)])
    return number, np.bincount(number)[number]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within one sorted partition, the rows of its dense regions, and its first and last rows for the edges."""
    part = TaskContext.get().partitionId()
    tail = head = pending = np.zeros((0, len(_FOREST)), np.int64)
    dense: tuple[int, int] | None = None
    for batch in batches:
        x = _columns(batch)
        if not len(x):
            continue
        if len(head) < EDGE:
            head = np.concatenate([head, x[: EDGE - len(head)]])
        both = np.concatenate([tail, x])
        yield _rows(None, _neighbours(both, len(tail)), None)
        tail = both[-EDGE:]
        # regions with more rows than neighbours reach: rows wait until their region is that long, or over
        y = np.concatenate([pending, x])
        number, length = _runs(y)
        full = length > NEIGHBOURS + 1
        if dense == (y[0, 0], y[0, 1] >> 16):
            full |= number == 0
        yield _rows(None, None, y[full])
        dense = (y[-1, 0], y[-1, 1] >> 16) if full[-1] else None
        pending = y[:0] if full[-1] else y[number == number[-1]]
    if len(head):
        yield _marker(part, len(tail))
        yield _rows(part - 1, None, head)
        yield _rows(part, None, tail)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs and dense regions across the edge of two partitions; rows come sorted by edge."""
    held = np.zeros((0, len(_FOREST) + 1), np.int64)

    def done(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for edge in np.unique(x[:, 0]):
            # a short partition is at both of its edges
            rows = np.unique(x[x[:, 0] == edge][:, 1:], axis=0)
            yield _rows(None, _neighbours(rows, 0), None)
            yield _rows(None, None, rows[_runs(rows)[1] > NEIGHBOURS + 1])

    for batch in batches:
        if len(batch):
            held = np.concatenate([held, np.column_stack([batch.column("part").to_numpy(), _columns(batch)])])
            last = held[:, 0] == held[-1, 0]
            yield from done(held[~last])
            held = held[last]
    yield from done(held)


def candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, dense): (a, b, agree) with a < b from the neighbours of all trees, and the rows of dense regions."""
    rows = reps.select("node", "n", "keys", *[F.col("sketch")[i].alias(f"s{i}") for i in range(3)], F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select(F.col("tree").cast("long").alias("tree"), F.get("keys", 2 * F.col("tree")).alias("p"), F.get("keys", 2 * F.col("tree") + 1).alias("q"), "node", "n", "s0", "s1", "s2")
    order = ["tree", "p", "q", "node"]
    swept = materialise(map_arrow(rows.repartitionByRange(*order).sortWithinPartitions(*order), _sweep, _PAIRS))
    beside = swept.where("forest is not null and part is not null")
    sides = dict(swept.where("a is not null and part is not null").select("part", "a").collect())
    joined = _joined_edges(sides)
    if joined:
        names = reps.sparkSession.createDataFrame(joined, "part long, first long")
        beside = beside.join(F.broadcast(names), "part", "left").withColumn("part", F.coalesce("first", "part")).select(*swept.columns)
    edges = materialise(map_arrow(beside.repartition("part").sortWithinPartitions("part", "forest"), _edges, _PAIRS))
    found = swept.unionByName(edges).where("part is null")
    place = {c: F.get("forest", F.lit(i)).alias(c) for i, c in enumerate(_FOREST)}
    dense = found.where(F.col("agree") == DENSE).select(*place.values()).select("tree", F.shiftright("p", 16).alias("region"), "node", "n", "s0", "s1", "s2")
    return found.where("a is not null").select("a", "b", "agree").distinct(), dense.distinct()


def _joined_edges(sides: dict[int, int]) -> list[tuple[int, int]]:
    """(edge, the first edge of its run): edges with only short or empty partitions between them are one."""
    out: list[tuple[int, int]] = []
    first = None
    for part in range(min(sides, default=0), max(sides, default=0) + 1):
        if sides.get(part, 0) >= EDGE:
            first = None
            continue
        first = part - 1 if first is None else first
        out.append((part, first))
    return out


def across_regions(dense: DataFrame, roots: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """Links (a, b) between different components among all pairs of the dense regions, confirmed on the full sets.

    ``members`` has (node, text, regions), the last with a node's region in
    every tree.  The largest component of a region is dealt into blocks of
    residents; the other rows visit every block, in crowds.  A region that is
    one component costs nothing, no row meets those of its own component, and
    a pair is looked at in the first tree that it shares a region in.  Pairs
    are compared where they meet.  A link joins its components for the rest of
    the block, and only such links leave the task.
    """
    rows = dense.join(roots.select("node", "root"), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    groups = rows.groupBy("tree", "region", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    regions = groups.groupBy("tree", "region").agg(F.sum("c").alias("rows"), F.sum("s").alias("sum"), F.max_by(F.struct("comp", "s"), F.struct("c", "comp")).alias("main"), F.max("c").alias("most")).where("most < rows")
    regions = materialise(regions.select("tree", "region", "rows", "most", F.col("main.comp").alias("main"), F.col("main.s").alias("main_sum"), "sum"))
    rows = join_heavy(rows, regions, ["tree", "region"], "rows", dense.count()).withColumn("minor", (F.col("comp") != F.col("main")).cast("long"))
    parts = lambda count, most, shingles: F.greatest(F.ceil(count / most), F.ceil(shingles / BLOCK_SHINGLES))
    blocks, crowds = parts(F.col("most"), RESIDENTS, F.col("main_sum")), parts(F.col("rows") - F.col("most"), VISITORS, F.col("sum") - F.col("main_sum"))
    # in one block and crowd the visitors meet each other; else they are residents as well
    rows = rows.withColumn("alone", ((blocks == 1) & (crowds == 1)).cast("long"))
    dealt = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), n)
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    keys = ["tree", "region", "block", "crowd"]
    columns = [*keys, "visits", "alone", "minor", "node", "n", "s0", "s1", "s2", "comp"]
    residents = rows.where("minor = 0 or alone = 0").withColumn("block", dealt(1, blocks)).withColumn("crowd", F.explode(every(crowds))).withColumn("visits", F.lit(0).cast("long"))
    visitors = rows.where("minor = 1").withColumn("crowd", dealt(2, crowds)).withColumn("block", F.explode(every(blocks))).withColumn("visits", F.lit(1).cast("long"))
    both = residents.select(*columns).unionByName(visitors.select(*columns)).join(members, "node").select(*columns, "text", "regions")

    def near(tree: int, a: tuple, b: tuple, joined: dict[int, int]) -> list[tuple[int, int]]:
        """Links between the rows of two tables (numbers, regions, sets) that join components which ``joined`` keeps apart."""

        def top(c: int) -> int:
            while joined.get(c, c) != c:
                joined[c] = c = joined.get(joined[c], joined[c])
            return c

        out = []
        (x, xr, xs), (y, yr, ys) = a, b
        step = max(1, (1 << 19) // max(1, len(x)))
        for i in range(0, len(y) if len(x) else 0, step):
            z = y[i : i + step]
            small, large = np.minimum(x[:, None, 2], z[None, :, 2]), np.maximum(x[:, None, 2], z[None, :, 2])
            ok = (x[:, None, 6] != z[None, :, 6]) & (100 * small >= PERCENT * large)
            # two minor rows meet twice, once from each side
            ok &= (z[None, :, 0] == 0) | (x[:, None, 1] < z[None, :, 1])
            v, w = np.nonzero(ok)
            keep = agreeing(x[v, 3:6].view(np.uint64), z[w, 3:6].view(np.uint64)) >= AGREE
            v, w = v[keep], w[keep]
            keep = (xr[v] == yr[i + w]).argmax(axis=1) == tree
            for p, q in zip(v[keep], w[keep], strict=True):
                one, two = top(int(x[p, 6])), top(int(z[q, 6]))
                if one != two and _linked(xs[p], ys[i + q]):
                    joined[max(one, two)] = min(one, two)
                    out.append((int(x[p, 1]), int(z[q, 1])))
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((0, 7), np.int64), np.zeros((0, TREES), np.int64), []
        at, crowd, met = None, none, True
        joined: dict[int, int] = {}
        for batch in batches:
            found: list[tuple[int, int]] = []
            numbers = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]) if len(batch) else np.zeros((0, len(columns)), np.int64)
            inside = batch.column("regions").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), TREES)
            for part in K.slices(batch.column("text")):
                values, by = shingles(part.data, part.offsets, size)
                sets = [np.unique(values[by[i] : by[i + 1]]) for i in range(len(part))]
                x, regions = numbers[part.first : part.first + len(part)], inside[part.first : part.first + len(part)]
                new = np.flatnonzero(np.concatenate([[True], (x[1:, :5] != x[:-1, :5]).any(axis=1), [True]]))
                for lo, hi in zip(new[:-1], new[1:], strict=True):
                    key, own = tuple(x[lo, :4]), (x[lo:hi, 6:], regions[lo:hi], sets[lo:hi])
                    if key != at:
                        if not met:
                            found += near(at[0], crowd, crowd, joined)
                        at, crowd, met, joined = key, none, not x[lo, 5], {}
                    if x[lo, 4]:
                        crowd = np.concatenate([crowd[0], own[0]]), np.concatenate([crowd[1], own[1]]), crowd[2] + own[2]
                    else:
                        found += near(key[0], crowd, own, joined)
            yield pa.record_batch([pa.array([min(f) for f in found], pa.int64()), pa.array([max(f) for f in found], pa.int64())], names=["a", "b"])
        found = near(at[0], crowd, crowd, joined) if not met else []
        yield pa.record_batch([pa.array([min(f) for f in found], pa.int64()), pa.array([max(f) for f in found], pa.int64())], names=["a", "b"])

    return map_arrow(both.repartition(*keys).sortWithinPartitions(*keys, F.desc("visits")), compare, "a long, b long").distinct()


def _linked(own: np.ndarray, other: np.ndarray) -> bool:
    """Two sorted sets that are not empty are similar enough."""
    if 100 * min(len(own), len(other)) < PERCENT * max(len(own), len(other)):
        return False
    at = np.minimum(np.searchsorted(other, own), len(other) - 1)
    both = int((other[at] == own).sum())
    return 100 * both >= PERCENT * (len(own) + len(other) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets are similar enough."""
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    # pivots, which have no b, and members fetch their texts together
    pivots = dealt.select("a", "chunk").distinct().select("a", "chunk", F.lit(None).cast("long").alias("b"), F.col("a").alias("doc_id"))
    asked = dealt.select("a", "chunk", "b", F.col("b").alias("doc_id")).unionByName(pivots)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot: tuple | None = None
        sets: list[np.ndarray] = []
        for batch in batches:
            a, chunk, b = (batch.column(i).to_pylist() for i in range(3))
            found_a, found_b = [], []
            for part in K.slices(batch.column(3)):
                values, by = shingles(part.data, part.offsets, size)
                for i in range(len(part)):
                    r = part.first + i
                    own = np.unique(values[by[i] : by[i + 1]])
                    if b[r] is None:
                        if pivot != (a[r], chunk[r]):
                            pivot, sets = (a[r], chunk[r]), []
                        sets.append(own)
                    elif pivot == (a[r], chunk[r]):
                        for other in sets:
                            if not len(own) or not len(other):
                                continue
                            if _linked(own, other):
                                found_a.append(a[r])
                                found_b.append(b[r])
                                break
            yield pa.record_batch([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    rows = asked.join(texts, "doc_id").select("a", "chunk", "b", "text").repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return map_arrow(rows, compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document of (doc_id, text)."""
    made = materialise(nodes(docs, size))
    usable = made.where("n_shingles > 0 and doc_id is not null")
    reps = usable.groupBy("f0", "f1").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    found, dense = candidates(reps)
    pairs, dense = materialise(found), materialise(dense)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    near = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("agree", "a")), asc=False), 1, BEST), lambda x: x.a)
    low = F.slice(F.sort_array(F.collect_list("a")), 1, BEST)
    # a document has at most TREES * NEIGHBOURS * 2 partners, so these lists are short
    involved = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(dense.select("node")).distinct()
    texts, at = stored(texts.join(involved, "doc_id", "left_semi"))
    first = materialise(pairs.where(F.col("agree") >= LIKELY).groupBy("b").agg(F.array_union(near, low).alias("a")).select(F.explode("a").alias("a"), "b"))
    roots = components(confirmed(first, texts, size))

    def with_links(more: DataFrame) -> DataFrame:
        links = materialise(more)
        return roots if links.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))

    end = lambda c: F.coalesce(F.col(f"root_{c}"), F.col(c))
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    across = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(end("a") != end("b")).select("a", "b")
    # confirming reads its pairs more than once
    roots = with_links(confirmed(materialise(across.join(first, ["a", "b"], "left_anti")), texts, size))
    if not dense.isEmpty():
        members = texts.join(reps.select("node", F.transform(F.filter("keys", lambda _, i: i % 2 == 0), lambda p: F.shiftright(p, 16)).alias("regions")), F.col("doc_id") == F.col("node")).select("node", "text", "regions")
        roots = with_links(across_regions(dense, roots, members, size))
    # links are stored, so nothing reads the texts again
    discard(docs.sparkSession, at)
    return _with_components(made, roots)


def _with_components(made: DataFrame, roots: DataFrame) -> DataFrame:
    """The component of every row: that of its set, and of all sets of its id."""
    usable = made.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "f0", "f1")
    classes = usable.groupBy("f0", "f1").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows"))
    labels = materialise(classes.join(roots, "node", "left").select("f0", "f1", "rows", F.coalesce("root", "node").alias("component")))
    found = join_heavy(usable, labels, ["f0", "f1"], "rows", usable.count()).select("doc_id", "n_shingles", "component")
    rest = made.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    known = made.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    if not known.isEmpty():
        found, rest = _pooled(found, rest, known)
    out = found.unionByName(rest)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def _pooled(found: DataFrame, rest: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components where rows repeat an id: such rows are one document, so the components of its texts are one."""
    total = found.count() + rest.count()
    several = join_heavy(found, repeated, ["doc_id"], "rows", total).select("doc_id", "component").distinct()
    # an id joins the components of its texts; each is named by its smallest id
    joined = components(several.select(F.col("doc_id").alias("a"), F.col("component").alias("b")))
    root = joined.select(F.col("node").alias("component"), "root")
    sizes = found.groupBy("component").agg(F.count("*").alias("rows")).join(root, "component", "left").select("component", "rows", F.coalesce("root", "component").alias("root"))
    found = join_heavy(found, materialise(sizes), ["component"], "rows", total).select("doc_id", "n_shingles", F.col("root").alias("component"))
    # a row without words has the component of the others of its id
    own = found.groupBy("doc_id").agg(F.min("component").alias("root"))
    named, free = rest.where("doc_id is not null"), rest.where("doc_id is null")
    mine = named.groupBy("doc_id").agg(F.count("*").alias("rows")).join(own, "doc_id", "left").select("doc_id", "rows", F.coalesce("root", "doc_id").alias("root"))
    named = join_heavy(named, materialise(mine), ["doc_id"], "rows", total).select("doc_id", "n_shingles", F.col("root").alias("component"))
    return found, named.unionByName(free)
