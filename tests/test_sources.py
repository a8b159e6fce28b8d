"""Importers, stores, search in texts, parser and planner."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenscan import model as M
from lumenscan.operators import basic, random_data, textsearch
from lumenscan.plans import planner
from lumenscan.plans.parser import parse
from lumenscan.sources import importers, stores
from lumenscan.types import Attribute, EngineError, kind_of


def test_feature_and_text_files(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("a\tcld\t3\t1 2 x\nbroken line\nb\tjcd\t2\t1,2\n")
    got = {r["id"]: (r["type"], r["length"], r["feature"]) for r in importers.read_features(spark, str(tmp_path / "f.tsv")).collect()}
    assert got == {"a": ("cld", 3, [1.0, 2.0, 1.0]), "b": ("jcd", 2, [1.0, 2.0])}
    (tmp_path / "t.tsv").write_text("1\thello\tworld\nnothing\n")
    assert [tuple(r) for r in importers.read_texts(spark, str(tmp_path / "t.tsv")).collect()] == [("1", "hello\tworld")]
    old = spark.createDataFrame([("<1,2.5>", "7")], "feature string, shotid string")
    new = importers.read_legacy(old, {"shotid": "tid"}, {"tid": "long"}, ["feature"]).first()
    assert (new["tid"], new["feature"]) == (7, [1.0, 2.5])
    importers.export(spark.range(3), str(tmp_path / "x"), "orc")
    assert importers.import_files(spark, str(tmp_path / "x"), "orc").count() == 3


def test_stores(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("ap_id"), (F.col("id") % 5).alias("g"))
    for engine in ("parquet", "orc", "json"):
        stores.write(df, engine, str(tmp_path / engine))
        assert stores.read(spark, engine, str(tmp_path / engine), df.schema, [M.Predicate("g", "=", (1,))]).count() == 10
    stores.write_both(df, str(tmp_path / "both"), "ap_id", 2)
    assert stores.read_both(spark, str(tmp_path / "both"), [M.Predicate("ap_id", "=", (3,))]).count() == 1
    assert stores.supports("jdbc", "long") and not stores.supports("jdbc", "vector") and "parquet" in stores.handlers()
    with pytest.raises(EngineError):
        stores.write(df, "papyrus", str(tmp_path / "no"))


def test_bm25_edges(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a b a")], "id long, x string")
    assert textsearch.bm25(df, "id", "x", " .. ").count() == 0
    assert [r["id"] for r in textsearch.bm25(df, "id", "x", "A a").collect()] == [3]
    assert textsearch.bm25(df.limit(0), "id", "x", "a").count() == 0


def test_random_data_every_type(spark):
    kinds = ["integer", "long", "float", "double", "string", "text", "boolean", "vector", "sparsevector", "geometry"]
    df = random_data.generate(spark, [Attribute(f"c{i}", k) for i, k in enumerate(kinds)], 50, 4, **{"fv-dimensions": 5, "fv-distribution": "gaussian", "fv-sparsity": 0.3})
    assert df.count() == 50
    assert [kind_of(f.dataType) for f in df.schema] == ["integer", "long", "float", "double", "string", "string", "boolean", "vector", "sparsevector", "geometry"]
    x, y = textsearch.point(F.col("c9"))
    assert df.filter(x.isNull() | y.isNull()).count() == 0


def test_parse():
    q = {"from": {"index": "i"}, "using": {"attribute": "v", "query": {"index": [1], "data": [2], "length": 3}, "k": 3, "indexOnly": True, "distance": {"type": "MINKOWSKI", "options": {"norm": "3"}}}}
    n = parse(json.dumps(q))
    assert isinstance(n, M.IndexScan) and n.ranking.query == (0.0, 2.0, 0.0) and n.ranking.option("norm") == 3.0 and n.ranking.index_only
    assert parse({"from": {"entity": "e"}, "time": 5, "paths": ["vaf", "pq"]}) == M.Timed((M.HintScan("e", (), None, ("vaf",)), M.HintScan("e", (), None, ("pq",))), 5.0)
    for bad in ({"from": {"index": "i"}}, {"from": {"indexes": ["i"]}}, {"from": {"nothing": 1}}, {"from": {"expression": {"operation": "xor"}}}):
        with pytest.raises(EngineError):
            parse(bad)


def test_predicates_and_refusals():
    for bad in (M.Predicate("a", "<", (1, 2)), M.Predicate("a", "=", ()), M.Predicate("a", "or 1=1 --", (1,))):
        with pytest.raises(EngineError):
            basic.condition(bad)


def test_hints_and_models(spark):
    assert planner.expand(["exact", "vaf", "VAF_INDEX"]) == ["vaf", "vav", "sequential"]
    r = M.Ranking("v", (1.0,), 3)
    assert planner.by_hints(["exact"], [], r) == "sequential" and planner.by_hints(["pq"], [], r) is None
    rng = np.random.default_rng(0)
    ms = [planner.Measurement("p", np.array([i / 20] * 12), 0.1 + i / 10, 1.0, 1.0) for i in rng.permutation(20)]
    svm = planner.OnlineSVR()
    svm.train(ms)
    assert svm.score("p", np.array([0.05] * 12)) > svm.score("p", np.array([0.9] * 12)) > 0
    naive = planner.NaiveScores()
    naive.train(ms + [planner.Measurement("q", ms[0].features, 9.0, 1.0, 1.0)])
    assert naive.score("p", ms[0].features) > naive.score("q", ms[0].features) > 0
    for kind in ("rig", "dt"):
        m = planner.SparkRegression(spark, kind)
        m.train(ms)
        assert m.score("p", ms[0].features) > 0


def test_vote_and_pages(spark):
    a, b = spark.range(5).withColumnRenamed("id", "ap_id"), spark.range(3, 8).withColumnRenamed("id", "ap_id")
    assert {r["ap_id"]: r["ap_distance"] for r in basic.vote([a, b]).collect()} == {i: 0.0 if i in (3, 4) else 0.5 for i in range(8)}
    assert [len(p) for p in basic.pages(spark.range(25), 10)] == [10, 10, 5]
    with pytest.raises(EngineError):
        basic.vote([])
