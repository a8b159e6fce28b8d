"""Golden distances, and the two ways of building them against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenscan.functions import distance as D

X, Y = [0.0] * 10, [1.0] * 10
Z = [0.1 * i + 0.1 for i in range(10)]
WEIGHTS = [0.2 * i for i in range(10)]

# (name, options, d(x,y), d(x,z), d(y,z)) computed by an independent library.
GOLDEN = [
    ("chisquared", {}, 10.0, 5.5, 2.250856127017118),
    ("correlation", {}, 0, 0, 0),
    ("cosine", {}, 0, 0, 0.11359473957208177),
    ("hamming", {}, 10, 10, 9),
    ("jaccard", {}, 1, 1, 0.44999999999999996),
    ("kullbackleibler", {}, 0, 0, 7.921438356864942),
    ("chebyshev", {}, 1, 1, 0.9),
    ("euclidean", {}, 3.1622776601683795, 1.9621416870348585, 1.6881943016134133),
    ("squaredeuclidean", {}, 10, 3.85, 2.8500000000000005),
    ("manhattan", {}, 10, 5.5, 4.5),
    ("minkowski", {"norm": 5.5}, 1.5199110829529339, 1.1428468094176871, 1.0148028591241314),
    ("spannorm", {}, 0, 0.9, 0.9),
]
WEIGHTED = [
    ("euclidean", {}, 3.0, 2.2978250586152114, 1.0392304845413265),
    ("squaredeuclidean", {}, 9.0, 5.28, 1.08),
    ("manhattan", {}, 9.0, 6.6, 2.4),
    ("minkowski", {"norm": 5.5}, 1.491072079537323, 1.2463626613947523, 0.7298778196120014),
    ("hamming", {}, 9.0, 9.0, 7.199999999999999),
]


def both(spark, name, options, q, v, w=None):
    d = D.find(name, **options)
    df = spark.createDataFrame([(q, v, w or [1.0] * len(q))], "q array<double>, v array<double>, w array<double>")
    row = df.select(D.between(d, q, F.col("v"), w).alias("a"), D.between(d, F.col("q"), F.col("v"), F.col("w") if w else None).alias("b")).first()
    return row["a"], row["b"]


@pytest.mark.parametrize("case", GOLDEN + [(*c, "w") for c in WEIGHTED], ids=lambda c: c[0] + "-w" * (len(c) > 5))
def test_golden(spark, case):
    w = WEIGHTS if len(case) > 5 else None
    for (q, v), want in zip(((X, Y), (X, Z), (Y, Z)), case[2:5]):
        for got in both(spark, case[0], case[1], q, v, w):
            assert got == pytest.approx(want, abs=1e-5)


def test_haversine(spark):
    # x, y, z as places: only the first two numbers count.
    for (q, v), want in zip(((X, Y), (X, Z), (Y, Z)), (157249, 24863, 133893)):
        assert both(spark, "haversine", {}, q, v)[0] == pytest.approx(want, abs=1)
    assert both(spark, "haversine", {}, [1.0], [2.0])[0] == math.inf


def test_null_short_and_zero(spark):
    df = spark.createDataFrame([(None,), ([1.0, 2.0],), ([],)], "v array<double>")
    for name in D.names():
        got = [r[0] for r in df.select(D.between(D.find(name), [1.0, 2.0, 3.0], F.col("v"))).collect()]
        assert got[0] == D.MAX_DISTANCE
        assert got[1] is not None
    got = df.select(D.between(D.find("manhattan"), [0.0, 0.0, 9.0], F.col("v"))).collect()
    assert got[1][0] == 3.0 and got[2][0] == 0.0


def test_zero_weights_make_all_equal(spark):
    assert both(spark, "euclidean", {}, Y, Z, [0.0] * 10) == (0.0, 0.0)


def test_modulo_takes_sign_of_dividend(spark):
    assert both(spark, "modulo", {}, [3.0, 2.0], [-5.0, 5.0])[0] == pytest.approx(-2 + 1)
    assert math.isnan(both(spark, "modulo", {}, [0.0], [5.0])[0])


def test_sparse_round_trip_and_positions(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(20):
        v = rng.normal(size=12) * (rng.random(12) < 0.4)
        rows.append((i, [float(np.float32(x)) for x in v]))
    df = spark.createDataFrame(rows, "i int, v array<double>").withColumn("s", D.to_sparse(F.col("v")))
    q = [float(np.float32(x)) for x in rng.normal(size=12)]
    qs = D.to_sparse(F.array(*[F.lit(x) for x in q]))
    got = df.select("v", D.to_dense(F.col("s")).alias("d"), D.sparse_dot(qs, F.col("s")).alias("dot"), D.sparse_cosine(F.col("s"), qs).alias("cos"), D.between(D.find("cosine"), q, F.col("v")).alias("cos2")).collect()
    for r in got:
        assert r["d"] == r["v"]
        assert r["dot"] == pytest.approx(float(np.dot(q, r["v"])), abs=1e-6)
        assert r["cos"] == pytest.approx(r["cos2"], abs=1e-6)


def test_wide_query_is_folded(spark):
    v = np.random.default_rng(1).normal(size=(3, 300))
    df = spark.createDataFrame([(v[1].tolist(),), (v[2].tolist(),)], "v array<double>")
    got = [r[0] for r in df.select(D.between(D.find("euclidean"), v[0].tolist(), F.col("v"))).collect()]
    assert got == pytest.approx([float(np.linalg.norm(v[0] - v[1])), float(np.linalg.norm(v[0] - v[2]))])


@pytest.mark.parametrize("weighted", [False, True])
def test_every_distance_of_sparse_vectors_equals_the_dense_one(spark, weighted):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(12):
        v = np.round(np.abs(rng.normal(size=14)), 3) * (rng.random(14) < (0.4 if i else 0)) * (1 if i % 2 else -1)
        rows.append((i, [float(np.float32(x)) for x in v]))
    df = spark.createDataFrame(rows, "i int, v array<double>").withColumn("s", D.to_sparse(F.col("v")))
    q = [float(np.float32(x)) for x in np.round(np.abs(rng.normal(size=14)), 3) * (rng.random(14) < 0.5)]
    w = [float(x) for x in rng.choice([0.0, 0.5, 2.0], 14)] if weighted else None
    ws = D.sparse_literal(w) if weighted else None
    columns = []
    for name in D.names():
        d = D.find(name)
        columns += [D.between(d, q, F.col("v"), w).alias(name), D.sparse_between(d, D.sparse_literal(q), F.col("s"), ws if d.weighted else None).alias(name + "_s")]
    for r in df.select(*columns).collect():
        for name in D.names():
            assert r[name + "_s"] == pytest.approx(r[name], abs=1e-6, nan_ok=True), name
    null = spark.createDataFrame([(None,)], "s struct<index:array<int>,data:array<float>,length:int>").select(D.sparse_between(D.find("euclidean"), D.sparse_literal(q), F.col("s")).alias("d")).first()
    assert null["d"] == D.MAX_DISTANCE


def test_widths_that_differ_mean_the_common_dimensions_either_way(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0, 5.0]), ([1.0, 2.0, 3.0, 4.0], [3.0, 4.0, 5.0])], "v array<double>, q array<double>")
    for name in ("jaccard", "euclidean", "chebyshev", "spannorm", "chisquared"):
        d = D.find(name)
        got = df.select(D.between(d, [3.0, 4.0, 5.0], F.col("v")).alias("a"), D.between(d, F.col("q"), F.col("v")).alias("b")).collect()
        assert all(r["a"] == pytest.approx(r["b"]) for r in got), name
