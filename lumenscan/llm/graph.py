"""Similarity graphs over millions of vectors.

Exact copies are one node. A node's sketch is its unit vector in bytes (of a
random projection, if the vector is sparse). Nodes meet in the cells of
cross-polytope hashes: rotate the vector, take the axis it lies closest to.
Sketches only propose; what is reported is computed from the stored vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.runtime import discard, materialise, materialise_bucketed, release

#: Width of the projection of sparse vectors, and of every sketch at most.
SPARSE_WIDTH = 128
#: How far a sketch's cosine may lie below the true one (dense: rounding to bytes, one deviation
#: is about 0.001; sparse: projection, one deviation is 0.017 at a cosine of 0.9).
DENSE_MARGIN, SPARSE_MARGIN = 0.01, 0.12
#: Rows a cell should hold on average; digits are hashed until it does, none in a group that is no larger.
CELL_ROWS = 1024
#: Rows of a cell that are compared with each other at once.
BLOCK = 2048
#: Nodes of a component that are solved as one block; the matrix of a larger one is compared in tiles and squared by shuffled joins.
BLOCK_NODES = 1024
#: Nodes of a part of a larger component, and of a larger cell.
TILE = 1024


@dataclass(frozen=True)
class HashPlan:
    """Digits and tables for one group: a pair at the planned cosine shares no cell with a chance of about `miss`."""

    digits: int
    tables: int


@lru_cache(maxsize=256)
def agreement(cosine: float, width: int) -> float:
    """Chance that one digit of two vectors at `cosine` is the same, by sampling."""
    rng = np.random.default_rng([width, 79])
    same = 0
    for _ in range(20):
        x, y = rng.standard_normal((2, 2000, width), dtype=np.float32)
        y = cosine * x + math.sqrt(1 - cosine * cosine) * y
        i, j = np.abs(x).argmax(1), np.abs(y).argmax(1)
        at = np.arange(len(x))
        same += int(((i == j) & (x[at, i] * y[at, i] > 0)).sum())
    return same / 40_000


def plan_hashes(rows: int, width: int, cosine: float, miss: float = 0.001, cell_rows: int = CELL_ROWS) -> HashPlan:
    """cosine: the least at which pairs are sought. A group of up to cell_rows is one cell."""
    digits = max(0, math.ceil(math.log(max(rows, 1) / cell_rows) / math.log(2 * width)))
    if not digits:
        return HashPlan(0, 1)
    return HashPlan(digits, math.ceil(math.log(miss) / math.log(1 - agreement(cosine, width) ** digits)))


@lru_cache(maxsize=256)
def _rotation(width: int, table: int, digit: int) -> np.ndarray:
    rng = np.random.default_rng([width, table, digit, 77])
    return np.linalg.qr(rng.standard_normal((width, width)))[0].astype(np.float32)


@lru_cache(maxsize=64)
def _projection(block: int, width: int) -> np.ndarray:
    """Rows block*1024 .. of the projection of sparse positions."""
    rng = np.random.default_rng([block, 78])
    return rng.standard_normal((1024, width)).astype(np.float32)


def _project(pos: np.ndarray, data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    rows = np.empty((len(pos), width), np.float32)
    for b in np.unique(pos >> 10):
        at = (pos >> 10) == b
        rows[at] = _projection(int(b), width)[pos[at] & 1023]
    return np.add.reduceat(rows * data[:, None].astype(np.float32), offsets[:-1], axis=0)


def _cells(unit: np.ndarray, plan: HashPlan, seed: int) -> np.ndarray:
    """A cell for each row and table."""
    n, width = unit.shape
    out = np.empty((n, plan.tables), np.int64)
    for t in range(plan.tables):
        code = np.full(n, ((seed * 1_000_003 + width) * 10_007 + t * 7919) & 0x7FFFFFFFFFFF, np.int64)
        for d in range(plan.digits):
            turned = unit @ _rotation(width, t, d)
            axis = np.abs(turned).argmax(1)
            code = code * 1_315_423_911 + axis * 2 + (turned[np.arange(n), axis] > 0) + 1
        out[:, t] = code
    return out


def to_nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: nid, grp, vec, pos), (members: nid, id, grp), both written out; nodes lie in buckets of nid.

    Equal vectors of a group are one node, whichever rows hold them; repeated
    rows leave one member. A nid is a hash; should two different vectors share
    one, which a second hash tells, all are numbered anew.
    """
    for seed in range(4):
        nid, check = F.xxhash64(F.lit(seed), "grp", "vec", "pos"), F.hash(F.lit(seed), "grp", "vec", "pos")
        keyed = materialise(vectors.select(nid.alias("nid"), check.alias("check"), "id", "grp", "vec", "pos"), "keyed", dictionary=False)
        first = [F.first(c).alias(c) for c in ("grp", "vec", "pos")]
        nodes = materialise_bucketed(keyed.groupBy("nid").agg(*first, F.min("check").alias("low"), F.max("check").alias("high")), "nid", "nodes", dictionary=False)
        if nodes.filter("low <> high").isEmpty():
            members = materialise(keyed.select("nid", "id", "grp").distinct(), "members")
            discard(keyed)
            release(nodes.sparkSession)
            return nodes, members
        discard(nodes)
        discard(keyed)
    raise RuntimeError("different vectors kept sharing a hash")


def sketch(nodes: DataFrame, counts: dict[str, int], threshold: float, miss: float = 0.001, company: int = 0, width: int = SPARSE_WIDTH) -> DataFrame:
    """(nid, slack, sketch, cells): slack is what the sketch's cosine may fall short by.

    Pairs at `threshold` or above are to share a cell, but for a share of about
    `miss`. Cells of sparse vectors are planned for two deviations of the
    projection less. With `company`, every node is in a random cell of about
    so many besides. width: that of a sparse vector's projection.
    """
    cell_rows = CELL_ROWS
    cosine = {True: threshold, False: threshold - 2 * (1 - threshold**2) / math.sqrt(width)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp = batch.column(1).dictionary_encode()
            names, grp = grp.dictionary.to_pylist(), grp.indices.to_numpy()
            vec, pos = batch.column(2), batch.column(3)
            off = vec.offsets.to_numpy().astype(np.int64)
            values = vec.values.to_numpy(zero_copy_only=False).astype(np.float64)
            nids, size, dense = batch.column(0).to_numpy(), np.diff(off), pos.is_null().to_numpy(zero_copy_only=False)
            kinds = np.where(dense, size, -1)
            for g, n in dict.fromkeys(zip(grp.tolist(), kinds.tolist())):
                at = np.flatnonzero((grp == g) & (kinds == n))
                if n >= 0:
                    unit = unit_rows(values[off[at][:, None] + np.arange(n)]).astype(np.float32)
                else:
                    ends = np.concatenate([[0], np.cumsum(size[at])])
                    step = np.repeat(off[at] - ends[:-1], size[at]) + np.arange(ends[-1])
                    p = pos.values.to_numpy(zero_copy_only=False)[np.repeat(pos.offsets.to_numpy()[at] - ends[:-1], size[at]) + np.arange(ends[-1])].astype(np.int64)
                    own = values[step]
                    own = own / np.repeat(np.maximum.reduceat(np.abs(own), ends[:-1]), size[at])
                    unit = unit_rows(_project(p, own, ends, width).astype(np.float64)).astype(np.float32)
                plan = plan_hashes(counts[names[g]], unit.shape[1], cosine[n >= 0], miss, cell_rows)
                cells = _cells(unit, plan, _seed(names[g]))
                if company and plan.digits:
                    parts = -(-counts[names[g]] // company)
                    cells = np.hstack([cells, (nids[at] % parts * 2_654_435_761 + _seed(names[g]) * 31 + 17)[:, None]])
                peak = np.abs(unit).max(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(nids[at]),
                        pa.array(np.full(len(at), DENSE_MARGIN if n >= 0 else SPARSE_MARGIN, np.float32)),
                        _binary(np.rint(unit / peak * 127).astype(np.int8)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32)), pa.array(cells.ravel())),
                    ],
                    ["nid", "slack", "sketch", "cells"],
                )

    return nodes.select("nid", "grp", "vec", "pos").mapInArrow(run, "nid long, slack float, sketch binary, cells array<long>")


def _seed(group: str) -> int:
    h = 0
    for c in group.encode():
        h = (h * 131 + c) & 0xFFFFFFFF
    return h


def _binary(code: np.ndarray) -> pa.Array:
    n, w = code.shape
    width = w * code.itemsize
    offsets = np.arange(0, n * width + 1, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(code))])


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return off, np.frombuffer(column.buffers()[2], np.int8) if column.buffers()[2] else np.empty(0, np.int8)


def by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of sketches, apart by width (groups of different width share a batch)."""
    off, raw = _raw(column)
    width = np.diff(off)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        x = raw[off[at][:, None] + np.arange(w)].astype(np.float32)
        yield at, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def runs(batches: Iterator[pa.RecordBatch], key: int = 1, rows: int = 20_000) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole runs of the first `key` columns; a run of more than `rows` comes in pieces."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(t.num_rows, bool)
        for c in t.columns[:key]:
            c = c.to_numpy()
            same &= c == c[-1]
        last = int(np.flatnonzero(same)[0])
        if last:
            yield t.slice(0, last).combine_chunks()
            t = t.slice(last)
            held, n = t.to_batches(), t.num_rows
        else:
            yield t
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def cell_blocks(cell: np.ndarray, small: int = 384, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Rows to compare at once: several small cells or up to `most` (BLOCK) rows of one."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    ends = np.append(starts[1:], len(cell))
    k = 0
    while k < len(starts):
        a = starts[k]
        while k + 1 < len(starts) and ends[k + 1] - a <= small:
            k += 1
        step = most or BLOCK
        for b in range(a, ends[k], step):
            yield b, min(b + step, ends[k])
        k += 1


def cell_rows(sketches: DataFrame) -> DataFrame:
    """(cell, t, nid, slack, sketch): a row for each table; with parts, above 1 for cells of more than BLOCK rows, if there are any."""
    cells = sketches.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    large = materialise(cells.select("cell", F.ceil(F.col("n") / TILE).cast("int").alias("parts")), "cells")
    rows = sketches.select(F.posexplode("cells").alias("t", "cell"), "nid", "slack", "sketch")
    if large.isEmpty():
        return rows.select("cell", "t", "nid", "slack", "sketch")
    return rows.join(large, "cell", "left").select("cell", "t", "nid", "slack", "sketch", F.coalesce("parts", F.lit(1)).alias("parts"))


def spread_cells(sketches: DataFrame) -> DataFrame:
    """(cell, part, nid, slack, sketch): cells whole in a task, large ones in random parts, other parts in every table."""
    n = int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cell_rows(sketches)
    part = F.pmod(F.xxhash64("nid", "t"), F.col("parts")).cast("int") if "parts" in rows.columns else F.lit(0)
    rows = rows.select("cell", part.alias("part"), "nid", "slack", "sketch")
    return rows.repartition(n, "cell", "part").sortWithinPartitions("cell", "part", "nid")


def cell_forest(sketches: DataFrame, floor: float) -> DataFrame:
    """(u, v): links that join, within each cell, the nodes whose sketches reach floor - slack.

    A link for each node joined is written, not each pair. A cell of more than
    BLOCK rows is cut into parts of about TILE, and every two parts are
    compared in one task.
    """
    rows = cell_rows(sketches)
    if "parts" not in rows.columns:
        tiles, keys = rows.select("cell", "nid", "slack", "sketch").repartition("cell").sortWithinPartitions("cell"), 1
    else:
        placed = rows.withColumn("part", F.pmod(F.xxhash64("nid", F.lit(81)), F.col("parts")).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        tiles = placed.select("cell", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "nid", "slack", "sketch")
        tiles, keys = tiles.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b"), 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, keys):
            new = np.ones(t.num_rows, bool)
            new[1:] = False
            for c in t.columns[:keys]:
                c = c.to_numpy()
                new[1:] |= c[1:] != c[:-1]
            key, nid, slack = np.cumsum(new), t.column("nid").to_numpy(), t.column("slack").to_numpy()
            sketched = t.column("sketch").combine_chunks()
            us, vs = [], []
            for p, z in cell_blocks(key, most=t.num_rows):
                if z - p < 2:
                    continue
                for at, unit in by_width(sketched.slice(p, z - p)):
                    own, k, floors = nid[p:z][at], key[p:z][at], (floor - slack[p:z][at])[:, None]
                    left, right = [], []
                    for a in range(0, len(at), 256):
                        i, j = np.nonzero(unit[a : a + 256] @ unit[a:].T >= floors[a : a + 256])
                        ok = (i < j) & (k[a:][i] == k[a:][j])
                        left.append(i[ok] + a)
                        right.append(j[ok] + a)
                    i, j = np.concatenate(left), np.concatenate(right)
                    if not len(i):
                        continue
                    root = np.arange(len(at))
                    while True:
                        low = np.minimum(root[i], root[j])
                        if (low == root[i]).all() and (low == root[j]).all():
                            break
                        np.minimum.at(root, i, low)
                        np.minimum.at(root, j, low)
                    least = np.full(len(at), np.iinfo(np.int64).max)  # the least node of each group, so that tables agree
                    np.minimum.at(least, root, own)
                    u = least[root]
                    joined = u != own
                    us.append(u[joined])
                    vs.append(own[joined])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return tiles.mapInArrow(run, "u long, v long").distinct()


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that extreme values do not overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pair_cosines(vec: pa.ListArray, pos: pa.ListArray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines, rounded to six decimals, of rows i with rows j of (vec, pos): two of a pair have the same form."""
    out = np.zeros(len(i))
    off = vec.offsets.to_numpy().astype(np.int64)
    size = np.diff(off)
    values = vec.values.to_numpy(zero_copy_only=False).astype(np.float64)
    dense = pos.is_null().to_numpy(zero_copy_only=False)
    kinds = np.where(dense, size, -1)
    for n in np.unique(kinds[i]) if len(i) else ():
        pairs = np.flatnonzero(kinds[i] == n)
        used, inverse = np.unique(np.concatenate([i[pairs], j[pairs]]), return_inverse=True)
        a, b = inverse[: len(pairs)], inverse[len(pairs) :]
        if n >= 0:
            unit = unit_rows(values[off[used][:, None] + np.arange(n)])
            for k in range(0, len(pairs), 50_000):
                out[pairs[k : k + 50_000]] = np.einsum("ij,ij->i", unit[a[k : k + 50_000]], unit[b[k : k + 50_000]])
            continue
        ends = np.concatenate([[0], np.cumsum(size[used])])
        step = np.arange(ends[-1])
        x = values[np.repeat(off[used] - ends[:-1], size[used]) + step]
        x = x / np.repeat(np.maximum.reduceat(np.abs(x), ends[:-1]), size[used])
        x = x / np.repeat(np.sqrt(np.add.reduceat(x * x, ends[:-1])), size[used])
        p = pos.values.to_numpy(zero_copy_only=False)[np.repeat(pos.offsets.to_numpy().astype(np.int64)[used] - ends[:-1], size[used]) + step].astype(np.int64)
        own = size[used]
        for k in range(0, len(pairs), 20_000):
            sides = []
            for rows in (a[k : k + 20_000], b[k : k + 20_000]):
                n_of = own[rows]
                first = np.concatenate([[0], np.cumsum(n_of)])
                at = np.repeat(ends[rows] - first[:-1], n_of) + np.arange(first[-1])
                sides.append(((np.repeat(np.arange(len(rows)), n_of) << 32) + p[at], x[at], np.repeat(np.arange(len(rows)), n_of)))
            (ka, xa, ra), (kb, xb, _) = sides
            hit = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
            same = kb[hit] == ka
            out[pairs[k : k + 20_000]] = np.bincount(ra[same], xa[same] * xb[hit[same]], minlength=len(a[k : k + 20_000]))
    return np.round(out, 6)


def both_ways(edges: DataFrame) -> DataFrame:
    """Links (u, v, ...) in either direction."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.select("u", "v", *rest).union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *rest))


def components(edges: DataFrame) -> DataFrame:
    """(nid, label): label is the least nid of the connected component.

    Least labels travel along edges and then to the label's own label, so the
    rounds grow with the logarithm of a component's width. Nodes without an
    edge are not listed.
    """
    links = both_ways(edges).select("u", "v")
    labels = materialise(links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    turn = 0
    while True:
        heard = links.join(labels.select(F.col("u").alias("v"), "label"), "v").select("u", "label", F.lit(None).cast("long").alias("own"))
        told = heard.union(labels.select("u", "label", F.col("label").alias("own")))
        step = told.groupBy("u").agg(F.min("label").alias("label"), F.max("own").alias("own"))
        if turn >= 2:  # wide components only: most are settled before
            jump = labels.select(F.col("u").alias("label"), F.col("label").alias("beyond"))
            step = step.join(jump, "label", "left").select("u", F.least("label", "beyond").alias("label"), "own")
        step = materialise(step.select("u", "label", (F.col("label") < F.col("own")).alias("moved")), "labels")
        discard(labels)
        labels = step
        if labels.filter("moved").isEmpty():
            break
        turn += 1
    return labels.select(F.col("u").alias("nid"), "label")


def blocks(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(label, nids, vecs, poss): components of bounded size, their vectors together."""
    sized = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= BLOCK_NODES)
    inside = labels.join(sized.select("label"), "label", "left_semi")
    return (
        nodes.select("nid", "vec", "pos").join(inside, "nid")
        .groupBy("label").agg(F.collect_list(F.struct("nid", "vec", "pos")).alias("m"))
        .select(F.col("m.nid").alias("nids"), F.col("m.vec").alias("vecs"), F.col("m.pos").alias("poss"), "label")
    )


def block_entries(packed: DataFrame, threshold: float) -> DataFrame:
    """(label, col, row, s, p): the matrices of blocks: every pair whose stored vectors reach threshold, both ways, and
    loops of weight one. s is the cosine, p its share of the column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for (nids, unit), label in zip(block_vectors(batch), batch.column(3).to_pylist()):
                s = np.round(unit @ unit.T, 6)
                np.fill_diagonal(s, 1.0)
                col, row = np.nonzero(s >= threshold)
                w = s[col, row]
                total = np.bincount(col, w, minlength=len(nids))
                for held, x in zip(out, (np.full(len(col), label), nids[col], nids[row], w, w / total[col])):
                    held.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["label", "col", "row", "s", "p"])

    return packed.mapInArrow(run, "label long, col long, row long, s double, p double")


def large_components(labels: DataFrame) -> DataFrame:
    sized = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_NODES)
    return labels.join(sized.select("label"), "label", "left_semi")


def tile_edges(large: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(label, u, v, s): every pair of a component of `large` (nid, label) whose stored vectors reach threshold.

    A component is cut into parts of about TILE nodes; each two parts are
    compared in one task, so the tasks are bounded and their number is
    quadratic in the component.
    """
    sized = large.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("nid", F.lit(80)), F.col("parts")).cast("int")
    placed = nodes.select("nid", "vec", "pos").join(large.join(sized, "label").withColumn("part", part), "nid")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    tiles = (
        placed.withColumn("other", other)
        .groupBy("label", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
        .agg(F.collect_list(F.struct("nid", "vec", "pos", (F.col("part") > F.col("other")).alias("second"))).alias("m"))
        .select(F.col("m.nid").alias("nids"), F.col("m.vec").alias("vecs"), F.col("m.pos").alias("poss"), F.col("m.second").alias("second"), (F.col("a") < F.col("b")).alias("two"), "label")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (nids, unit), second, two, label in zip(block_vectors(batch), *(batch.column(k).to_pylist() for k in (3, 4, 5))):
                right = np.array(second) if two else np.ones(len(nids), bool)
                left = ~right if two else right
                s = np.round(unit[left] @ unit[right].T, 6)
                i, j = np.nonzero(s >= threshold)
                u, v, s = nids[left][i], nids[right][j], s[i, j]
                keep = (u != v) if two else (u < v)
                u, v, s = u[keep], v[keep], s[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), label)), pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(s)], ["label", "u", "v", "s"])

    return tiles.mapInArrow(run, "label long, u long, v long, s double")


def block_vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(nids, unit vectors in double) of each block of a batch of `blocks`."""
    nids, vecs, poss = batch.column(0), batch.column(1), batch.column(2)
    outer = nids.offsets.to_numpy()
    ids, inner, data = nids.values.to_numpy(), vecs.values, vecs.values.values.to_numpy(zero_copy_only=False)
    off = inner.offsets.to_numpy()
    pos = poss.values
    sparse = pos.is_valid().to_numpy(zero_copy_only=False)
    pos_off = pos.offsets.to_numpy()
    pos_data = pos.values.to_numpy(zero_copy_only=False)
    for a, z in zip(outer[:-1], outer[1:]):
        m = z - a
        if sparse[a]:
            flat = np.concatenate([pos_data[pos_off[i] : pos_off[i + 1]] for i in range(a, z)])
            column = np.unique(flat, return_inverse=True)[1]
            x = np.zeros((m, column.max() + 1))
            x[np.repeat(np.arange(m), np.diff(off[a : z + 1])), column] = data[off[a] : off[z]]
        else:
            x = data[off[a] : off[z]].reshape(m, -1).astype(np.float64)
        yield ids[a:z], unit_rows(x)


def group_counts(nodes: DataFrame) -> dict[str, int]:
    """Nodes by group. Groups are kinds of vectors (entity, index and block), so their number is small."""
    return {r["grp"]: r["n"] for r in nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
