"""The k most similar vectors of every vector: a neighbour graph by NN-descent.

Every node has a list of its most similar nodes so far. Lists begin with what
the node meets in its hash cells. In a round a node receives a few of its
neighbours and of the nodes that have it for a neighbour: all that meet there
are compared, and what is better than the end of a list enters it, until
hardly any place changes. Which neighbours these are is drawn by a hash of the
neighbour, so nodes with common neighbours mostly meet. At last the
lists are scored with the stored vectors. Queries walk the graph greedily.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenscan.llm.graph import by_width, cell_blocks, group_counts, pair_cosines, runs, sketch, spread_cells, to_nodes
from lumenscan.runtime import discard, materialise, materialise_bucketed, release

#: Length of a node's list while descending is at least this, and three times k.
LIST = 16
#: Neighbours that a node is sent to in a round, and that are sent to it.
MEETINGS = 2
#: Share of pairs at the floor that may share no hash cell: the rounds find them.
MISS = 0.1
#: Rounds end when no more than this share of the lists' places changed; they are never cut short.
DELTA = 0.0001
#: Where lists have no floor: cosine for which cells are planned, nodes of a random cell that everyone is also in, and
#: neighbours sent, share of places and width of a sparse vector's sketch in place of those above (most are not near each other,
#: so there is more to find and less to tell it by).
OPEN_COSINE, COMPANY, OPEN_MEETINGS, OPEN_DELTA, OPEN_WIDTH = 0.7, 64, 5, 0.002, 256
#: Nodes that a query keeps while it walks.
BEAM = 24

_FOUND = "nid long, near array<long>, s array<float>"
_LISTS = _FOUND + ", meet array<long>, known binary, least float, fresh int"
_DRAW = np.uint64(0x2545F4914F6CDD1D)
_NOTHING = -2.0


def _drawn(nids: np.ndarray, turn: int) -> np.ndarray:
    """A hash of each node, another one every turn."""
    return (nids.astype(np.uint64) ^ np.uint64((turn + 1) * 0x5851F42D4C957F2D & (1 << 64) - 1)) * _DRAW


def _packed(owner: np.ndarray, near: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    """Entries in order of their owner as a row for each owner."""
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    ends = pa.array(np.append(start, len(owner)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(owner[start]), pa.ListArray.from_arrays(ends, pa.array(near)), pa.ListArray.from_arrays(ends, pa.array(s.astype(np.float32)))], ["nid", "near", "s"])


def _best(score: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the up to k highest of every row among those that are ok; more only with ties."""
    many = np.flatnonzero(ok.sum(axis=1) > 2 * k)
    if len(many):
        part = np.where(ok[many], score[many], _NOTHING)
        ok[many] &= part >= np.partition(part, -k, axis=1)[:, -k, None]
    i, j = np.nonzero(ok)
    order = np.lexsort((j, -score[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k]


def cell_lists(sketches: DataFrame, floor: float, k: int) -> DataFrame:
    """(nid, near, s): the k best that a node meets in each of its cells, at floor - slack or above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 2):
            cell, part, nid, slack = (t.column(c).to_numpy() for c in ("cell", "part", "nid", "slack"))
            cell = np.cumsum(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])]))
            sketches = t.column("sketch").combine_chunks()
            for a, z in cell_blocks(cell):
                if z - a < 2:
                    continue
                for at, unit in by_width(sketches.slice(a, z - a)):
                    own, c = nid[a:z][at], cell[a:z][at]
                    s = unit @ unit.T
                    ok = s >= (floor - slack[a:z][at])[:, None]
                    if c[0] != c[-1]:
                        ok &= c[:, None] == c[None, :]
                    np.fill_diagonal(ok, False)
                    i, j = _best(s, ok, k)
                    if len(i):
                        yield _packed(own[i], own[j], s[i, j])

    return spread_cells(sketches).mapInArrow(run, _FOUND)


def merged(found: DataFrame, lists: DataFrame | None, k: int, turn: int, sent: int = MEETINGS) -> DataFrame:
    """The lists with what was found, written out in buckets of nid.

    meet: the neighbours it meets next; known: 16 bits of a hash of each of its
    neighbours; least: what a newcomer must exceed; fresh: places taken by
    newcomers.
    """
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = found.select("nid", "near", "s", F.lit(False).alias("old"))
    if lists is not None:
        rows = rows.union(lists.select("nid", "near", "s", F.lit(True).alias("old")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, rows=5_000):
            near, s = (t.column(c).combine_chunks() for c in ("near", "s"))
            off = near.offsets.to_numpy()
            size = np.diff(off)
            u = np.repeat(t.column("nid").to_numpy(), size)
            old = np.repeat(t.column("old").to_numpy(), size)
            v, x = near.values.to_numpy()[off[0] : off[-1]], s.values.to_numpy()[s.offsets[0].as_py() : s.offsets[-1].as_py()]
            order = np.lexsort((~old, v, u))
            u, v, x, old = u[order], v[order], x[order], old[order]
            first = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
            u, v, x, old = u[first], v[first], x[first], old[first]
            order = np.lexsort((v, -x, u))
            u, v, x, old = u[order], v[order], x[order], old[order]
            keep = np.arange(len(u)) - np.searchsorted(u, u) < k
            u, v, x, old = u[keep], v[keep], x[keep], old[keep]
            base = _packed(u, v, x)
            ends = base.column(1).offsets.to_numpy()
            size = np.diff(ends)
            row = np.repeat(np.arange(len(size)), size)
            draw = _drawn(v, turn)
            by_draw = np.lexsort((draw, row))
            met = by_draw[np.arange(len(v)) - ends[row] < sent]
            meet_ends = np.concatenate([[0], np.cumsum(np.minimum(size, sent))])
            short = (draw >> np.uint64(48)).astype(np.uint16)
            least = np.where(size == k, x[ends[1:] - 1], _NOTHING).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [
                    *base.columns,
                    pa.ListArray.from_arrays(pa.array(meet_ends.astype(np.int32)), pa.array(v[met])),
                    pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((ends * 2).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(short))]),
                    pa.array(least),
                    pa.array(np.add.reduceat(~old, ends[:-1]).astype(np.int32) if len(size) else np.empty(0, np.int32)),
                ],
                ["nid", "near", "s", "meet", "known", "least", "fresh"],
            )

    placed = rows.repartition(n, "nid").sortWithinPartitions("nid")
    return materialise_bucketed(placed.mapInArrow(run, _LISTS), "nid", "lists", placed=True)


def meetings(lists: DataFrame, sketches: DataFrame, floor: float, k: int, turn: int) -> DataFrame:
    """(nid, near, s): better neighbours of the nodes that meet at a common one; turn is that of the lists.

    A node is at home, where it meets the drawn of its list, and goes to each
    of these, so that neighbours of neighbours are compared either way.
    """
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = lists.select("nid", F.explode("meet").alias("v"))
    places = links.select(F.col("nid").alias("mid"), F.col("v").alias("nid")).union(links.select(F.col("v").alias("mid"), "nid")).union(lists.select(F.col("nid").alias("mid"), "nid"))
    shown = places.repartition(n, "nid").distinct().join(lists.select("nid", "known", "least"), "nid").join(sketches.select("nid", "slack", "sketch"), "nid")
    shown = shown.select("mid", "nid", "known", "least", "slack", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches):
            mid, nid, least, slack = (t.column(c).to_numpy() for c in ("mid", "nid", "least", "slack"))
            sketches, known = t.column("sketch").combine_chunks(), t.column("known").combine_chunks()
            ends = np.frombuffer(known.buffers()[1], np.int32)[known.offset : known.offset + len(known) + 1] // 2
            hashes = np.frombuffer(known.buffers()[2], np.uint16)
            mine, theirs, scores = [], [], []
            for a, z in cell_blocks(mid):
                if z - a < 2:
                    continue
                for at, unit in by_width(sketches.slice(a, z - a)):
                    at = at + a
                    own, m = nid[at], mid[at]
                    s = unit @ unit.T
                    ok = s >= (floor - slack[at])[:, None]
                    ok &= s > least[at][:, None]
                    if m[0] != m[-1]:
                        ok &= m[:, None] == m[None, :]
                    np.fill_diagonal(ok, False)
                    # What is known already, by its hash; of 4,000 newcomers one may be taken for known this turn.
                    size = np.diff(ends)[at]
                    row = np.repeat(np.arange(len(at)), size)
                    entry = hashes[np.repeat(ends[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
                    drawn = (_drawn(own, turn) >> np.uint64(48)).astype(np.uint16)
                    order = np.argsort(drawn, kind="stable")
                    short = drawn[order]
                    left, right = np.searchsorted(short, entry), np.searchsorted(short, entry, "right")
                    while (hit := left < right).any():
                        ok[row[hit], order[left[hit]]] = False
                        left = left + hit
                    if not ok.any():
                        continue
                    i, j = _best(s, ok, k)
                    mine.append(own[i])
                    theirs.append(own[j])
                    scores.append(s[i, j])
            if mine:
                u, v, s = map(np.concatenate, (mine, theirs, scores))
                order = np.lexsort((v, u))  # the same pair often meets at several places of a table
                u, v, s = u[order], v[order], s[order]
                once = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
                yield _packed(u[once], v[once], s[once])

    return shown.repartitionByRange(n, "mid", "nid").sortWithinPartitions("mid", "nid").mapInArrow(run, _FOUND)


def descend(lists: DataFrame, sketches: DataFrame, floor: float, k: int, sent: int = MEETINGS, delta: float = DELTA) -> DataFrame:
    """Rounds of NN-descent over lists from `merged` at turn 0, until hardly any place changes.

    Ends of lists only rise, so the rounds come to an end by themselves.
    """
    places = lists.agg(F.sum(F.size("near"))).first()[0] or 0
    turn = 0
    while True:
        turn += 1
        step = merged(meetings(lists, sketches, floor, k, turn - 1), lists, k, turn, sent)
        discard(lists)
        release(lists.sparkSession)
        lists = step
        fresh = lists.agg(F.sum("fresh")).first()[0] or 0
        if fresh <= delta * places:
            return lists


def neighbour_graph(vectors: DataFrame, k: int, floor: float | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, members, sketches, lists) of a collection (grp, id, vec, pos); lists of `k` by sketch.

    With a floor lists hold nodes at that similarity or above (and some just
    below), and nodes without such have none. Without, every node has a list.
    """
    nodes, members = to_nodes(vectors)
    counts = group_counts(nodes)
    if floor is None:
        flat = sketch(nodes, counts, OPEN_COSINE, 0.5, COMPANY, OPEN_WIDTH)
    else:
        flat = sketch(nodes, counts, floor, MISS)
    sketches = materialise_bucketed(flat, "nid", "sketches")
    release(sketches.sparkSession)
    low = _NOTHING / 2 - 1 if floor is None else floor
    sent, delta = (OPEN_MEETINGS, OPEN_DELTA) if floor is None else (MEETINGS, DELTA)
    lists = descend(merged(cell_lists(sketches, low, k), None, k, 0, sent), sketches, low, k, sent, delta)
    return nodes, members, sketches, lists


def exact_lists(lists: DataFrame, nodes: DataFrame, k: int, slack: float) -> DataFrame:
    """(nid, near, s) with the cosine of the stored vectors, for the places of each list that may be among the k best.

    A list is scored where its least node is; a vector goes once to every such
    place that needs it, so lists of alike nodes share it.
    """
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nid, near, s = b.column(0).to_numpy(), b.column(1), b.column(2)
            off = near.offsets.to_numpy()
            size = np.diff(off)
            v, x = near.values.to_numpy()[off[0] : off[-1]], s.values.to_numpy()[s.offsets[0].as_py() : s.offsets[-1].as_py()]
            off = off - off[0]
            row = np.repeat(np.arange(len(size)), size)
            bound = np.where(size > k, x[off[:-1] + np.minimum(size, k) - 1] - slack, _NOTHING)
            keep = x >= bound[row]
            place = np.minimum(nid, np.minimum.reduceat(v, off[:-1])) if len(v) else nid
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(size)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(nid), pa.ListArray.from_arrays(pa.array(ends), pa.array(v[keep]))], ["place", "nid", "near"])

    release(lists.sparkSession)
    asked = materialise(lists.filter(F.size("near") > 0).select("nid", "near", "s").mapInArrow(cut, "place long, nid long, near array<long>"), "asked")
    need = asked.select("place", F.explode(F.array_append("near", F.col("nid"))).alias("nid")).repartition(n, "nid").distinct()
    held = need.join(nodes.select("nid", "vec", "pos"), "nid").select("place", "nid", "vec", "pos", F.lit(None).cast("array<long>").alias("near"))
    rows = held.union(asked.select("place", "nid", F.lit(None).cast("array<double>"), F.lit(None).cast("array<int>"), "near"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, rows=8_000):
            near = t.column("near").combine_chunks()
            ask = near.is_valid().to_numpy(zero_copy_only=False)
            place, nid = t.column("place").to_numpy(), t.column("nid").to_numpy()
            code = np.cumsum(np.concatenate([[False], place[1:] != place[:-1]]))
            own = np.flatnonzero(~ask)
            take = pa.array(own)
            vec, pos = t.column("vec").combine_chunks().take(take), t.column("pos").combine_chunks().take(take)
            names = np.unique(nid)
            key = code[own] * len(names) + np.searchsorted(names, nid[own])
            order = np.argsort(key)
            key = key[order]
            lists = near.take(pa.array(np.flatnonzero(ask)))
            size = np.diff(lists.offsets.to_numpy())
            u, c = np.repeat(nid[ask], size), np.repeat(code[ask], size)
            v = lists.values.to_numpy()
            i = order[np.searchsorted(key, c * len(names) + np.searchsorted(names, u))] if len(u) else u
            j = order[np.searchsorted(key, c * len(names) + np.searchsorted(names, v))] if len(u) else u
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(pair_cosines(vec, pos, i, j))], ["nid", "near", "s"])

    return rows.repartition(n, "place").sortWithinPartitions("place").mapInArrow(score, "nid long, near long, s double")


def _slack(sketches: DataFrame) -> float:
    """What two scores by sketch may differ by, against what they stand for."""
    return 2 * (sketches.agg(F.max("slack")).first()[0] or 0.0)


def _ranked(lists: DataFrame, members: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Exact lists of nodes (nid, near, s) as lists of ids, for the members `asked`; equal vectors are neighbours too."""
    # Of equal vectors only the k + 1 smallest ids can be in anyone's list.
    smallest = F.row_number().over(W.partitionBy("nid").orderBy("id"))
    heads = materialise(members.withColumn("r", smallest).filter(F.col("r") <= k + 1).select("nid", "id", "r"), "heads")
    twins = heads.filter("r = 2").select("nid", F.col("nid").alias("near"), F.lit(1.0).alias("s"))
    ids = heads.select(F.col("nid").alias("near"), F.col("id").alias("other"))
    place = F.row_number().over(W.partitionBy("nid").orderBy(F.col("s").desc(), "other"))
    best = lists.union(twins).join(ids, "near").withColumn("p", place).filter(F.col("p") <= k + 1).select("nid", "other", "s")
    each = asked.join(best, "nid").filter("id <> other")
    rank = F.row_number().over(W.partitionBy("grp", "id").orderBy(F.col("s").desc(), "other"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("grp", "id", "other", "s", "rank")


def nearest(vectors: DataFrame, k: int, floor: float | None = 0.9, graph: tuple | None = None) -> DataFrame:
    """(grp, id, other, s, rank): up to k most similar others of every id, at `floor` or above if there is one.

    s is the cosine of the stored vectors rounded to six decimals; ties go to
    the smaller id. Repeated rows count once, equal vectors are neighbours of
    each other, an id is never its own. With a floor a vector without such
    others has no row. An empty collection gives none. graph: from
    neighbour_graph with the same k and floor, if it is there already.
    """
    nodes, members, sketches, lists = graph or neighbour_graph(vectors, max(LIST, 3 * k), floor)
    exact = exact_lists(lists, nodes, k, _slack(sketches))
    if floor is not None:
        exact = exact.filter(F.col("s") >= floor)
    return _ranked(exact, members, members, k)


def greedy_search(queries: DataFrame, entries: DataFrame, lists: DataFrame, sketches: DataFrame, beam: int = BEAM) -> DataFrame:
    """(q, nid, s): the nodes each query has found, best `beam` by sketch.

    queries: (q, sketch); entries: (q, node, s), where each query enters. A hop
    looks at the neighbours, either way, of what is new in the query's beam; the
    walk ends when no beam has anything new. A query never sees its own node.
    """
    links = lists.select(F.col("nid").alias("u"), F.explode("near").alias("v"))
    ways = materialise_bucketed(links.union(links.select("v", "u")).distinct(), "u", "ways")
    order = W.partitionBy("q").orderBy(F.col("s").desc(), "node")
    held = materialise(entries.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= beam).select("q", "node", "s", F.lit(False).alias("seen")), "beam")
    known = sketches.select(F.col("nid").alias("node"), F.col("sketch").alias("y"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.zeros(b.num_rows, np.float32)
            other = dict()
            for at, unit in by_width(b.column(3)):
                other[unit.shape[1]] = (at, unit)
            for at, unit in by_width(b.column(2)):
                if unit.shape[1] in other:
                    to, theirs = other[unit.shape[1]]
                    both, i, j = np.intersect1d(at, to, assume_unique=True, return_indices=True)
                    s[both] = np.einsum("ij,ij->i", unit[i], theirs[j])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["q", "node", "s"])

    while True:
        out = held.filter(~F.col("seen")).join(ways, F.col("node") == F.col("u")).select("q", F.col("v").alias("node")).filter("q <> node").distinct()
        out = out.join(held, ["q", "node"], "left_anti").join(known, "node").join(queries.select("q", F.col("sketch").alias("x")), "q").select("q", "node", "x", "y")
        fresh = out.mapInArrow(judge, "q long, node long, s float").withColumn("seen", F.lit(False))
        step = held.select("q", "node", "s", F.lit(True).alias("seen")).unionByName(fresh)
        step = materialise(step.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= beam).drop("r"), "beam")
        discard(held)
        held = step
        if held.filter(~F.col("seen")).isEmpty():
            return held.select("q", F.col("node").alias("nid"), "s")


def enter(sketches: DataFrame, queries: DataFrame, floor: float, beam: int) -> DataFrame:
    """(q, node, s): for each query (q, slack, sketch, cells) the best nodes of each of its cells, its own left out."""
    n = int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = materialise(queries.select("q", "slack", "sketch", F.explode("cells").alias("cell")), "entering")
    stored = sketches.select("nid", "slack", "sketch", F.explode("cells").alias("cell")).join(wanted.select("cell").distinct(), "cell", "left_semi")
    # The queries of a cell are compared with all its nodes: nodes of a large cell are spread by a salt, the queries sent to each.
    sizes = stored.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / 8192).cast("int").alias("parts"))
    stored = stored.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("nid", F.lit(82)), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("ask"), "nid", "slack", "sketch")
    asking = wanted.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("ask"), F.col("q").alias("nid"), "slack", "sketch")
    rows = stored.union(asking).repartition(n, "cell", "part").sortWithinPartitions("cell", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 2):
            cell, part, ask, nid, slack = (t.column(c).to_numpy() for c in ("cell", "part", "ask", "nid", "slack"))
            sketches = t.column("sketch").combine_chunks()
            cut = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1
            for a, z in zip(np.append(0, cut), np.append(cut, len(cell))):
                for at, unit in by_width(sketches.slice(a, z - a)):
                    at = at + a
                    for k in range(0, int(ask[at].sum()), 512):
                        mine, theirs = np.flatnonzero(ask[at])[k : k + 512], np.flatnonzero(~ask[at])
                        s = unit[mine] @ unit[theirs].T
                        ok = (s >= (floor - slack[at][mine])[:, None]) & (nid[at][mine][:, None] != nid[at][theirs][None, :])
                        i, j = _best(s, ok, beam) if ok.any() else (np.empty(0, int), np.empty(0, int))
                        yield pa.RecordBatch.from_arrays([pa.array(nid[at][mine][i]), pa.array(nid[at][theirs][j]), pa.array(s[i, j])], ["q", "node", "s"])

    return rows.mapInArrow(run, "q long, node long, s float").groupBy("q", "node").agg(F.max("s").alias("s"))


def search(vectors: DataFrame, wanted: DataFrame, k: int, floor: float | None = 0.9, graph: tuple | None = None) -> DataFrame:
    """(grp, id, other, s, rank) of the vectors `wanted` (grp, id, vec, pos) against all of `vectors`.

    Wanted vectors need not be stored. A query enters the graph in its hash
    cells, never at its own node, and walks it greedily; what it found is
    scored with the stored vectors. Stored equals of a query are neighbours
    too, except its own id. Others below `floor` are not reported. graph: as
    for nearest.
    """
    nodes, members, sketches, lists = graph or neighbour_graph(vectors, max(LIST, 3 * k), floor)
    homes, asked = to_nodes(wanted)
    counts = group_counts(nodes)
    shape = (OPEN_COSINE, 0.5, COMPANY, OPEN_WIDTH) if floor is None else (floor, MISS, 0)
    counts = {**{r["grp"]: 0 for r in asked.select("grp").distinct().collect()}, **counts}
    queries = materialise(sketch(homes, counts, *shape).withColumnRenamed("nid", "q"), "queries")
    low = _NOTHING / 2 - 1 if floor is None else floor
    beam = max(BEAM, 4 * k)
    found = greedy_search(queries, enter(sketches, queries, low, beam), lists, sketches, beam)
    pairs = found.join(homes.select(F.col("nid").alias("q"), F.col("vec").alias("qv"), F.col("pos").alias("qp")), "q").join(nodes.select("nid", "vec", "pos"), "nid").select("q", "nid", "qv", "qp", "vec", "pos")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            vec, pos = pa.concat_arrays([b.column(2), b.column(4)]), pa.concat_arrays([b.column(3), b.column(5)])
            s = pair_cosines(vec, pos, np.arange(n), n + np.arange(n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["nid", "near", "s"])

    exact = pairs.mapInArrow(score, "nid long, near long, s double")
    if floor is not None:
        exact = exact.filter(F.col("s") >= floor)
    # A query's own node, if it is stored, holds its equals.
    own = homes.select("nid").join(nodes.select("nid"), "nid").select("nid", F.col("nid").alias("near"), F.lit(1.0).alias("s"))
    smallest = F.row_number().over(W.partitionBy("nid").orderBy("id"))
    ids = members.withColumn("r", smallest).filter(F.col("r") <= k + 1).select(F.col("nid").alias("near"), F.col("id").alias("other"))
    rank = F.row_number().over(W.partitionBy("grp", "id").orderBy(F.col("s").desc(), "other"))
    each = asked.join(exact.union(own), "nid").join(ids, "near").filter("id <> other")
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("grp", "id", "other", "s", "rank")
