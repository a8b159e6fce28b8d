"""Exact indexes give the exact neighbours; lossy ones most of them after refinement."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenscan.model import Ranking
from lumenscan.operators import basic, indexes
from lumenscan.types import EngineError


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 2
    x = centres[rng.integers(0, 20, 1200)] + rng.normal(size=(1200, 16))
    x[:5] *= 25  # outside of what a sample shows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)], "ap_id long, v array<double>")
    return df.cache(), x


def refined(df, ix, r):
    c = indexes.candidates(ix, r)
    return [x["ap_id"] for x in basic.nearest(df.join(c.select("ap_id"), "ap_id", "left_semi"), r).select("ap_id").collect()]


@pytest.mark.parametrize("kind,distance,options", [
    ("vaf", "euclidean", {}), ("vaf", "manhattan", {"marktype": "equidistant"}), ("vaf", "chebyshev", {}),
    ("vav", "squaredeuclidean", {}), ("vap", "euclidean", {}),
])
def test_exact(rows, kind, distance, options):
    df, x = rows
    ix = indexes.build(kind, df, "v", distance, **options)
    assert ix.data.count() == len(x)
    for at in (0, 3, 700):
        r = Ranking("v", tuple(x[at] + 0.1), 10, distance)
        assert refined(df, ix, r) == [y["ap_id"] for y in basic.nearest(df, r).select("ap_id").collect()]


def test_exact_with_weights(rows):
    df, x = rows
    ix = indexes.build("vaf", df, "v")
    r = Ranking("v", tuple(x[9]), 7, "euclidean", tuple(np.linspace(0, 2, 16)))
    assert refined(df, ix, r) == [y["ap_id"] for y in basic.nearest(df, r).select("ap_id").collect()]


@pytest.mark.parametrize("kind", ["pq", "sh", "lsh", "ecp", "mi"])
def test_lossy_recall(rows, kind):
    df, x = rows
    ix = indexes.build(kind, df, "v", "euclidean")
    assert ix.lossy and ix.data.count() == len(x)
    hits = 0
    for at in (50, 400, 900):
        r = Ranking("v", tuple(x[at]), 10, options=(("timesK", 10),))
        got = refined(df, ix, r)
        assert got[0] == at
        hits += len(set(got) & {y["ap_id"] for y in basic.nearest(df, r).select("ap_id").collect()})
    assert hits >= 27  # recall of 0.9


def test_refusals(rows, spark):
    df, _ = rows
    with pytest.raises(EngineError):
        indexes.build("vaf", df.limit(5), "v")
    with pytest.raises(EngineError):
        indexes.build("pq", df, "v", "cosine")
    ix = indexes.build("vap", df, "v")
    assert not ix.conforms(Ranking("v", (0.0,) * 16, 3, "manhattan"))
    assert not ix.conforms(Ranking("w", (0.0,) * 16, 3))


def test_prefilter(rows):
    df, x = rows
    ix = indexes.build("ecp", df, "v", "cosine", leadertype="centroid")
    keep = df.filter(F.col("ap_id") % 2 == 0)
    got = indexes.candidates(ix, Ranking("v", tuple(x[4]), 5, "cosine"), keep).collect()
    assert got and all(g["ap_id"] % 2 == 0 for g in got)
