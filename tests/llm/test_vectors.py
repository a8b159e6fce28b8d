"""Similarity graph, Markov clusters and nearest neighbours against brute force."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenscan.llm import clusters, graph, lists, neighbours
from lumenscan.llm.collections import checked, checked_sparse

SCHEMA = "grp string, id string, vec array<double>, pos array<int>, nid long, s double, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0, 3) for r in rows], SCHEMA).repartition(3)


def clique(rng, n, d, noise=0.08):
    c = rng.normal(size=d)
    return [c + rng.normal(size=d) * noise for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = []
    for g, d in (("a", 32), ("b", 16)):
        vs = [v * s for n in (1, 2, 3, 6, 12, 25) for v, s in zip(clique(rng, n, d), rng.uniform(0.01, 100, n))]
        vs += list(rng.normal(size=(60, d)))
        out += [(g, f"{g}{i:03d}", [float(x) for x in v], None) for i, v in enumerate(vs)]
    out += [("a", f"c{i}", out[3][2], None) for i in range(9)]  # copies of one vector
    out += out[:10]  # repeated rows
    for k in range(3):  # sparse: two alike and one apart
        for i in range(7):
            pos = sorted(rng.choice(np.arange(k * 300, k * 300 + 250), 20, replace=False).tolist()) if i == 0 else pos
            data = [float(x) for x in (rng.normal(size=20) if i == 0 else np.array(data) + rng.normal(size=20) * 0.02)]
            out.append(("s", f"s{k}{i}", data, pos))
    return out


def dense(r):
    if r[3] is None:
        return np.array(r[2])
    x = np.zeros(1000)
    x[r[3]] = r[2]
    return x


def sims(rows):
    distinct = {(r[0], r[1]): dense(r) for r in rows}
    out = {}
    for (p, x), (q, y) in combinations(distinct.items(), 2):
        if p[0] == q[0]:
            out[p[0], *sorted((p[1], q[1]))] = round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 6)
    return out


@pytest.fixture(scope="module")
def near(rows):
    return {k: s for k, s in sims(rows).items() if s >= 0.9}


@pytest.mark.parametrize("cell,block,most", [(1024, 1024, 2048), (16, 1024, 2048), (16, 4, 2048), (1024, 1024, 20)], ids=["one-cell", "hashed", "large-components", "large-cells"])
def test_pairs_of_clusters(spark, rows, near, monkeypatch, cell, block, most):
    monkeypatch.setattr(graph, "CELL_ROWS", cell)
    monkeypatch.setattr(graph, "BLOCK_NODES", block)
    monkeypatch.setattr(graph, "BLOCK", most)
    monkeypatch.setattr(graph, "TILE", min(most, 1024))
    got = [(r["grp"], r["id_a"], r["id_b"]) for r in clusters.similar_pairs(frame(spark, rows)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == set(near)


def isolated_pairs(rng, n, d):
    """n pairs at cosine 0.90 to 0.92 that are far from all others."""
    x, y = (graph.unit_rows(rng.normal(size=(n, d))) for _ in range(2))
    y = graph.unit_rows(y - (x * y).sum(axis=1, keepdims=True) * x)
    c = rng.uniform(0.9001, 0.92, (n, 1))
    return x, c * x + np.sqrt(1 - c * c) * y


@pytest.mark.parametrize("rows,width,digits", [(2_000, 48, 1), (90_000, 64, 1), (100_000, 48, 2), (300_000, 128, 2)])
def test_isolated_pairs_share_a_cell(rows, width, digits):
    plan = graph.plan_hashes(rows, width, 0.9)
    assert plan.digits == digits
    x, y = (graph._cells(v.astype(np.float32), plan, 5) for v in isolated_pairs(np.random.default_rng(3), 4000, width))
    assert (x == y).any(axis=1).mean() >= 0.998


@pytest.mark.parametrize("cell_rows", [1024, 16], ids=["one-digit", "two-digits"])
def test_isolated_pairs_are_found(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(graph, "CELL_ROWS", cell_rows)
    x, y = isolated_pairs(np.random.default_rng(4), 1000, 48)
    data = [("g", f"{i:04d}{side}", v.tolist(), None) for side, vs in (("a", x), ("b", y)) for i, v in enumerate(vs)]
    got = clusters.similar_pairs(frame(spark, data)).select("id_a", "id_b").collect()
    assert len(got) == len(set(got)) >= 996
    assert all(a[:4] == b[:4] for a, b in got)


@pytest.mark.parametrize("tile", [1024, 10], ids=["one-tile", "tiles"])
def test_large_components_are_compared_whole(spark, rows, near, monkeypatch, tile):
    """The forest of the cells has one link for each node joined; all pairs come from comparing components."""
    monkeypatch.setattr(graph, "BLOCK_NODES", 4)
    monkeypatch.setattr(graph, "TILE", tile)
    got = [(r["grp"], r["id_a"], r["id_b"]) for r in clusters.similar_pairs(frame(spark, rows)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == set(near)


def test_clusters_of_every_vector(spark, rows, near):
    got = {(r["grp"], r["id"]): r for r in clusters.all_clusters(frame(spark, rows)).collect()}
    assert set(got) == {(r[0], r[1]) for r in rows}
    for (g, a, b) in near:
        assert got[g, a]["cluster"] == got[g, b]["cluster"]
    for c in {(g, r["cluster"]) for (g, _), r in got.items()}:
        members = [r for (g, _), r in got.items() if (g, r["cluster"]) == c]
        assert {r["size"] for r in members} == {len(members)} and sorted(r["typical"] for r in members) == list(range(1, len(members) + 1))
        assert c[1] == min(r["id"] for r in members)


def dense_markov(w, inflation=2.0):
    """One component, as a full matrix: (least attractor, flow) of every node."""
    m = w / w.sum(axis=0)
    while True:
        square = m @ m
        done = np.abs(square - m).max() <= clusters.SETTLED * square.max()
        m = square**inflation
        m[m < clusters.PRUNE * m.max(axis=0)] = 0
        m /= m.sum(axis=0)
        if done:
            break
    n = len(w)
    low = np.arange(n)
    for _ in range(n):
        for i, j in zip(*np.nonzero(m)):
            low[i] = low[j] = min(low[i], low[j])
    attractors = np.flatnonzero(m.any(axis=1))
    return [min(a for a in attractors if low[a] == low[i]) for i in range(n)], m.sum(axis=1)


def bridged(rng):
    """Three groups of which two hang together by a bridge."""
    w = np.zeros((24, 24))
    for a, z in ((0, 9), (9, 16), (16, 24)):
        w[a:z, a:z] = rng.uniform(0.5, 1, (z - a, z - a))
    w[8, 9] = 0.5
    w = np.maximum(w, w.T)
    np.fill_diagonal(w, 1)
    return w


@pytest.mark.parametrize("together", [True, False])
def test_sparse_squaring_agrees_with_full_matrices(spark, together):
    """Also: a component's clusters are the same whatever other components are there, and wherever the rows lie."""
    rng = np.random.default_rng(1)
    matrices = [bridged(rng) for _ in range(12)]
    edges = []
    for c, w in enumerate(matrices):
        for a, z in ((0, 16), (16, 24)):  # connected parts
            edges += [(100 * c + a, 100 * c + i, 100 * c + j, float(w[i, j])) for i in range(a, z) for j in range(i + 1, z) if w[i, j]]
    schema = "label long, u long, v long, s double"
    results = []
    for parts, chosen in ((1, edges), (5, edges[::-1]), (3, [e for e in edges if e[0] < 200])):
        df = spark.createDataFrame(chosen, schema).repartition(parts, "v")
        matrix = graph.materialise_bucketed(clusters.entries(df), "label" if together else "col")
        ends = clusters.markov_sparse(matrix, together)
        found = (clusters.settled_clusters if together else clusters.settled_clusters_of_any_size)(ends, df)
        rows = found.collect()
        results.append({r["a"]: (r["b"], r["x"]) for r in rows if not r["link"]})
        kept = {(r["a"], r["b"]) for r in rows if r["link"]}
        assert kept == {(u, v) for _, u, v, _ in chosen if results[-1][u][0] == results[-1][v][0]}
    for c, w in enumerate(matrices):
        for a, z in ((0, 16), (16, 24)):
            cluster, flow = dense_markov(w[a:z, a:z])
            for got in results if c < 2 else results[:2]:
                assert [got[100 * c + i][0] for i in range(a, z)] == [100 * c + a + k for k in cluster]
                assert [got[100 * c + i][1] for i in range(a, z)] == pytest.approx(list(flow), abs=1e-6)


def test_hashes_shared_by_different_vectors(spark, monkeypatch):
    """Should two vectors share a number, all are numbered anew."""
    from pyspark.sql import functions

    real, calls = functions.xxhash64, []

    def shared(*columns):
        calls.append(columns)
        return functions.lit(7).cast("long") if len(calls) == 1 else real(*columns)

    monkeypatch.setattr(graph.F, "xxhash64", shared)
    nodes, _ = graph.to_nodes(frame(spark, [("a", "x", [1.0, 2.0], None), ("a", "y", [2.0, 1.0], None)]))
    assert nodes.count() == 2 and len(calls) == 2


def brute_lists(rows, k):
    out = {}
    for (g, a, b), s in sims(rows).items():
        if s >= 0.9:
            out.setdefault((g, a), []).append((-s, b))
            out.setdefault((g, b), []).append((-s, a))
    return {key: [b for _, b in sorted(v)[:k]] for key, v in out.items()}


@pytest.mark.parametrize("cell,most", [(1024, 2048), (16, 2048), (16, 20)], ids=["one-cell", "hashed", "large-cells"])
def test_nearest(spark, rows, monkeypatch, cell, most):
    monkeypatch.setattr(graph, "CELL_ROWS", cell)
    monkeypatch.setattr(graph, "BLOCK", most)
    monkeypatch.setattr(graph, "TILE", min(most, 1024))
    got = {}
    for r in sorted(neighbours.nearest(frame(spark, rows), 5).collect(), key=lambda r: r["rank"]):
        got.setdefault((r["grp"], r["id"]), []).append(r["other"])
    want = brute_lists(rows, 5)
    if most > 20:
        assert got == want
    else:  # cells are cut into random parts, and what was cut is found by the rounds
        hit = sum(len(set(v) & set(got.get(key, ()))) for key, v in want.items())
        assert hit >= 0.97 * sum(map(len, want.values()))


def test_nearest_in_one_large_component(spark, monkeypatch):
    """3,000 vectors around one direction: a single component far above any block; lists come from the graph alone."""
    rng = np.random.default_rng(12)
    x = graph.unit_rows(rng.normal(size=64) + rng.normal(size=(3000, 64)) * rng.uniform(0.1, 0.35, (3000, 1)))
    data = [("g", f"{i:05d}", v.tolist(), None) for i, v in enumerate(x)]
    monkeypatch.setattr(graph, "CELL_ROWS", 256)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -2)
    got = {}
    for r in neighbours.nearest(frame(spark, data), 5).collect():
        got.setdefault(int(r["id"]), set()).add(int(r["other"]))
    hit = total = 0
    for i in range(0, 3000, 10):
        best = [j for j in np.lexsort((np.arange(3000), -s[i]))[:5] if s[i, j] >= 0.9]
        hit, total = hit + len(set(best) & got.get(i, set())), total + len(best)
    assert total > 500 and hit >= 0.97 * total


def test_lists_without_a_floor(spark, rows, monkeypatch):
    """Every vector has five others where its group has; most of them the true ones."""
    monkeypatch.setattr(graph, "CELL_ROWS", 64)
    got, want = {}, {}
    for r in neighbours.nearest(frame(spark, rows), 5, None).collect():
        got.setdefault((r["grp"], r["id"]), set()).add(r["other"])
    for (g, a, b), s in sims(rows).items():
        want.setdefault((g, a), []).append((-s, b))
        want.setdefault((g, b), []).append((-s, a))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hit = sum(len({b for _, b in sorted(v)[:5]} & got[key]) for key, v in want.items())
    assert hit >= 0.9 * 5 * len(want)


@pytest.mark.parametrize("chunk", [32_768, 40])
def test_lists_of_every_vector_whatever_the_similarity(spark, rows, monkeypatch, chunk):
    monkeypatch.setattr(lists, "CHUNK", chunk)
    got = {}
    for r in sorted(lists.nearest_lists(frame(spark, rows), 5).collect(), key=lambda r: r["rank"]):
        got.setdefault((r["grp"], r["id"]), []).append(r["other"])
    want = {}
    for (g, a, b), s in sims(rows).items():
        want.setdefault((g, a), []).append((-s, b))
        want.setdefault((g, b), []).append((-s, a))
    assert got == {key: [b for _, b in sorted(v)[:5]] for key, v in want.items()}
    assert all(len(v) == 5 for v in got.values())


def test_descent_mends_a_poor_graph(spark, rows):
    """A third of the entries of the cells is enough to begin with."""
    nodes, _ = graph.to_nodes(frame(spark, rows))
    sketches = neighbours.materialise_bucketed(graph.sketch(nodes, graph.group_counts(nodes), 0.9), "nid")
    pairs = lambda df: {(r["nid"], v) for r in df.collect() for v in r["near"]}
    met = neighbours.cell_lists(sketches, 0.9, 16)
    full = pairs(neighbours.merged(met, None, 16, 0))
    thin = F.filter(F.arrays_zip("near", "s"), lambda p: F.pmod(F.xxhash64("nid", p["near"]), F.lit(3)) == 0)
    poor = met.select("nid", thin.alias("p")).filter(F.size("p") > 0).select("nid", "p.near", "p.s")
    start = neighbours.merged(poor, None, 16, 0)
    begun = pairs(start)
    mended = pairs(neighbours.descend(start, sketches, 0.9, 16))
    assert len(begun & full) < 0.5 * len(full) and len(mended & full) >= 0.9 * len(full)


@pytest.mark.parametrize("floor", [0.9, None])
def test_greedy_search_recall(spark, rows, floor):
    vectors = frame(spark, rows)
    ids = {(r[0], r[1]) for r in rows[::4]}
    foreign = ("a", "new", (np.array(rows[30][2]) * 3 + 1e-3).tolist(), None)  # not stored
    wanted = frame(spark, [r for r in rows if (r[0], r[1]) in ids] + [foreign])
    got = {}
    for r in neighbours.search(vectors, wanted, 5, floor).collect():
        got.setdefault((r["grp"], r["id"]), set()).add(r["other"])
    want = {k: set(v) for k, v in brute_lists(rows, 5).items() if k in ids}
    hit, total = sum(len(v & got.get(k, set())) for k, v in want.items()), sum(map(len, want.values()))
    assert hit >= 0.97 * total
    assert all(a not in v for (_, a), v in got.items())
    assert rows[30][1] in got["a", "new"]


def test_empty_and_single(spark):
    none = frame(spark, [("a", "x", [1.0], None)]).limit(0)
    one = frame(spark, [("a", "x", [1.0, 1e300], None), ("a", "x", [1.0, 1e300], None)])
    for v in (none, one):
        assert clusters.similar_pairs(v).count() == 0
        assert neighbours.nearest(v, 3).count() == 0
    assert clusters.all_clusters(none).count() == 0
    assert [(r["cluster"], r["size"]) for r in clusters.all_clusters(one).collect()] == [("x", 1)]


def test_usable_and_parsing(spark):
    texts = ["{1, -2.5 ,3e1}", "[1;2;3]", "(1 2 +3.)", "<1,n/a,2>", "{}", "", None, "1,NaN,2", "0 0 0", "1,,2", "1,2", "1,1e999,2"]
    rows = spark.createDataFrame([("g", str(i), t, 3) for i, t in enumerate(texts)], "grp string, id string, v string, n int")
    got = {r["id"]: r["vec"] for r in checked(rows).collect()}
    assert got == {"0": [1.0, -2.5, 30.0], "1": [1.0, 2.0, 3.0], "2": [1.0, 2.0, 3.0]}
    nan, inf = float("nan"), float("inf")
    lists = [[1.0, -0.0], [0.0, 0.0], [1.0, nan], [1.0, inf], [1.0, None], [], None, [1.0, 2.0, 3.0], [3.0, 0.0]]
    rows = spark.createDataFrame([("g", str(i), v, 2) for i, v in enumerate(lists)] + [(None, "x", [1.0, 2.0], 2), ("g", None, [1.0, 2.0], 2)], "grp string, id string, v array<float>, n int")
    assert {r["id"]: r["vec"] for r in checked(rows.coalesce(1)).collect()} == {"0": [1.0, 0.0], "8": [3.0, 0.0]}


def test_usable_sparse_vectors(spark):
    cases = [([5, 1], [1.0, 2.0], 9), ([5, 1], [1.0], 9), ([9], [1.0], 9), ([-1], [1.0], 9), ([1, 2], [0.0, 4.0], 9), ([1], [0.0], 9), (None, None, None), ([], [], 9), ([1], [float("nan")], 9), ([1, None], [1.0, 2.0], 9), ([1], [1.0], None)]
    rows = spark.createDataFrame([("g", str(k), *c) for k, c in enumerate(cases)], "grp string, id string, i array<int>, d array<float>, n int")
    got = {r["id"]: (r["vec"], r["pos"]) for r in checked_sparse(rows.coalesce(1)).collect()}
    assert got == {"0": ([2.0, 1.0], [1, 5]), "4": ([4.0], [2])}
