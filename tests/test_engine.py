"""Entities, data, indexes and query trees end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenscan import model as M
from lumenscan.engine import Engine
from lumenscan.streaming.ingest import stream_insert
from lumenscan.types import Attribute, EngineError

A = Attribute


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")), minimum_index_rows=50)
    rng = np.random.default_rng(2)
    e.create_entity("Pictures!", [A("tid", "long"), A("v", "vector"), A("s", "string", "orc"), A("n", "auto")])
    rows = [(i, [float(x) for x in rng.normal(size=8)], f"g{i % 5}") for i in range(300)]
    e.insert("pictures", spark.createDataFrame(rows, "tid long, v array<float>, s string"))
    return e


def rank(k=10, **kw):
    return M.Ranking("v", tuple([0.1] * 8), k, **kw)


def ids(df, c="tid"):
    return [r[c] for r in df.select(c).collect()]


def test_definition_refusals(engine):
    for bad in ([], [A("ap_x", "long")], [A("a", "long"), A("A!", "int" + "eger")], [A("v", "vector", "jdbc")]):
        with pytest.raises(EngineError):
            engine.create_entity("bad", bad)
    with pytest.raises(EngineError):
        A("x", "decimal")
    with pytest.raises(EngineError):
        engine.create_entity("pictures", [A("a", "long")])
    assert engine.create_entity("pictures", [A("a", "long")], if_not_exists=True) == "pictures"


def test_insert_count_and_auto(engine):
    t = engine.table("pictures")
    assert engine.count("pictures") == 300
    assert t.filter("n = ap_id").count() == 300 and t.select("ap_id").distinct().count() == 300
    with pytest.raises(EngineError):
        engine.insert("pictures", t.select("tid", "v", "s", "n"))
    with pytest.raises(EngineError):
        engine.insert("pictures", t.limit(1).select("tid", F.array(F.lit(1.0)).alias("v"), "s"))


def test_knn_and_filter(engine):
    r = rank()
    got = engine.knn("pictures", r).select("tid", "ap_distance").collect()
    x = {p["tid"]: np.array(p["v"]) for p in engine.table("pictures").collect()}
    want = sorted(x, key=lambda i: (np.linalg.norm(x[i] - 0.1), i))[:10]
    assert [g["tid"] for g in got] == want
    p = (M.Predicate("s", "=", ("g1", "g2")), M.Predicate("tid", "<", (200,)))
    assert all(i % 5 in (1, 2) and i < 200 for i in ids(engine.knn("pictures", r, p)))
    assert engine.filter("pictures", p).count() == 80
    with pytest.raises(EngineError):
        engine.filter("pictures", (M.Predicate("s", "; drop", ("x",)),))


@pytest.mark.parametrize("method", ["semijoin", "inlist", "bloom", "pushdown"])
def test_prefilter_methods_agree(engine, method):
    pre = M.Scan("pictures", (M.Predicate("s", "=", ("g3",)),))
    assert ids(engine.query(M.Scan("pictures", (), rank(5), pre, method))) == ids(engine.knn("pictures", rank(5), (M.Predicate("s", "=", ("g3",)),)))


def test_indexes_and_paths(engine):
    made = engine.create_all_indexes("pictures", "v", "euclidean")
    assert len(made) == 8 and engine.index_exists("pictures", "v", "vaf")
    exact = ids(engine.knn("pictures", rank()))
    for kind in ("vaf", "vav", "vap"):
        assert ids(engine.knn("pictures", rank(), hint=kind)) == exact
    for kind in ("pq", "sh", "ecp", "mi", "lsh"):
        name = next(n for n, _, k in engine.list_indexes("pictures") if k == kind)
        assert set(ids(engine.knn_index(name, rank(5)))) <= set(range(300))
    p = (M.Predicate("s", "=", ("g1",)),)
    assert ids(engine.knn("pictures", rank(5), p, "vaf")) == ids(engine.knn("pictures", rank(5), p))
    last = list(engine.knn_parallel("pictures", rank()))[-1]
    assert last[0] == 1.0 and ids(last[1]) == exact
    assert ids(engine.knn_timed("pictures", rank(), 120, chooser="kinds", hints=("vaf",))) == exact
    voted = engine.query(M.StochasticScan(tuple(n for n, _, k in engine.list_indexes() if k in ("vaf", "vav")), rank()))
    assert ids(voted) == exact
    scores = engine.train_planner("pictures", "v", 1, 5, "svm", 1)
    assert all(s > 0 for s in scores.values())
    assert ids(engine.knn("pictures", rank(), hint="empirical"))
    name = next(n for n, _, k in engine.list_indexes() if k == "ecp")
    part = engine.repartition_index(name, 4, "ecp", mode="new")
    assert engine.index(part).data.count() == 300
    got = engine.knn_index(part, M.Ranking("v", tuple([0.1] * 8), 5, options=(("skipPart", 0.5),)))
    assert got.count() <= 5
    only = engine.repartition_index(name, 4, "hash", mode="temp")
    r = M.Ranking("v", tuple([0.1] * 8), 50, partitions=frozenset({0}), index_only=True, options=(("timesK", 100),))
    assert engine.query(M.IndexScan(only, r)).join(engine.index(only).data, "ap_id").select("part").distinct().count() <= 1


def test_combinations(engine):
    a, b = M.Scan("pictures", (M.Predicate("tid", "<", (20,)),), rank(20)), M.Scan("pictures", (M.Predicate("tid", ">=", (10,)), M.Predicate("tid", "<", (30,))), rank(20))
    n = {h: engine.query(M.Combine(h, a, b)).count() for h in ("union", "intersect", "except", "join", "fuzzyunion", "fuzzyintersect")}
    assert n == {"union": 40, "intersect": 10, "except": 10, "join": 10, "fuzzyunion": 30, "fuzzyintersect": 30}
    f = {r["tid"]: r for r in engine.query(M.Combine("fuzzyintersect", a, b)).collect()}
    assert f[5]["ap_distance"] > 0
    low = {r["ap_id"]: r["ap_distance"] for r in engine.query(M.Combine("fuzzyunion", a, b)).collect()}
    assert sum(v == 0.0 for v in low.values()) == 20  # a side that lacks the id counts as 0
    assert sorted(ids(engine.query(M.Combine("except", a, b, "left")))) == list(range(10))
    assert sorted(ids(engine.query(M.Combine("intersect", a, b, "left")))) == list(range(10, 20))


def test_messages(engine):
    q = {"from": {"entity": "pictures"}, "where": [{"attribute": "s", "value": "g1"}], "using": {"attribute": "v", "query": [0.1] * 8, "k": 4, "distance": {"type": "minkowski", "options": {"norm": 1}}}}
    assert ids(engine.query(q)) == ids(engine.knn("pictures", rank(4, distance="manhattan"), (M.Predicate("s", "=", ("g1",)),)))
    assert engine.query({**q, "projection": {"attributes": ["s"], "op": "distinct"}}).collect()[0]["s"] == "g1"
    assert engine.query({"from": {"entity": "pictures"}, "projection": {"op": "count"}}).first()["count"] == 300
    one = {"from": {"entity": "pictures"}, "where": [{"attribute": "tid", "value": 7}], "projection": {"op": "exists"}}
    assert engine.query(one).first()["exists"] is True
    sub = {"from": {"expression": {"operation": "union", "left": q, "right": q}}, "using": q["using"], "where": [{"attribute": "tid", "op": ">", "value": 10}]}
    assert engine.query(sub).count() <= 4
    steps = [(n, df.count()) for n, df in engine.progressive(sub)]
    assert len(steps) == 4 and steps[-1][1] == engine.query(sub).count()
    early = next(engine.progressive(sub))
    assert isinstance(early[0], M.Node) and early[1].count() == 4
    assert [ids(df) for df in engine.batch([q, sub])] == [ids(engine.query(q)), ids(engine.query(sub))]
    assert engine.query({}).count() == 0
    assert sum(len(p) for p in engine.iter_pages({"from": {"entity": "pictures"}}, 90)) == 300
    assert {"ap_partition", "ap_source"} <= set(engine.query(q, ("partition", "source")).columns)
    kept = {**q, "id": "one", "useCached": True, "putInCache": True}
    assert ids(engine.query(kept)) == ids(engine.query(kept)) and engine.cached_result("one") is not None


def test_write_operations(spark, engine, tmp_path):
    engine.create_entity("w", [A("t", "long"), A("v", "vector"), A("g", "geometry"), A("x", "text")])
    engine.generate("w", 200, fv_dimensions=8, **{"fv-dimensions": 6, "fv-sparsity": 0.5})
    assert engine.count("w") == 200
    engine.create_index("w", "v", "vaf")
    assert engine.delete("w", [M.Predicate("t", "<", (300,)), M.Predicate("t", ">", (900,))]) == 200 - engine.count("w")
    assert not engine.index_exists("w", "v", "vaf") and engine.index_exists("w", "v", "vaf", True)
    left = engine.count("w")
    engine.vacuum("w", 3)
    engine.repartition("w", 2, "t")
    engine.transfer("w", ["t", "x"], "json")
    engine.sparsify("w", "v")
    assert engine.count("w") == left
    assert dict(engine.table("w").dtypes)["v"].startswith("struct")
    assert engine.properties("w")["count"] == left and engine.properties("w", "t")["engine"] == "json"
    src = tmp_path / "in"
    engine.create_entity("st", [A("a", "long")])
    spark.range(10).select(F.col("id").alias("a")).write.parquet(str(src))
    for _ in range(2):
        q = stream_insert(engine, "st", spark.readStream.schema("a long").parquet(str(src)), str(tmp_path / "cp"))
        q.awaitTermination()
        assert engine.count("st") == 10
    engine.drop_entity("w")
    assert not engine.exists("w") and not engine.list_indexes("w")
    engine.drop_entity("w", if_exists=True)
    with pytest.raises(EngineError):
        engine.drop_entity("w")
    assert "pictures" in engine.catalog() and engine.ping()


def test_a_failed_insert_leaves_nothing_and_can_be_repeated(spark, tmp_path, monkeypatch):
    from lumenscan.sources import stores

    root = str(tmp_path / "e")
    e = Engine(spark, root)
    e.create_entity("c", [A("t", "long"), A("x", "string", "json")])
    rows = spark.createDataFrame([(i, str(i)) for i in range(7)], "t long, x string")
    e.insert("c", rows, stream_batch=0)
    e.save()
    real, calls = stores.write, []

    def failing(*args, **kw):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("the store is away")
        return real(*args, **kw)

    monkeypatch.setattr(stores, "write", failing)
    with pytest.raises(OSError):
        e.insert("c", rows, stream_batch=1)
    assert e.count("c") == 7
    assert e.insert("c", rows, stream_batch=1) == 1 and e.insert("c", rows, stream_batch=1) == 0
    assert e.count("c") == 14 and e.table("c").select("ap_id").distinct().count() == 14
    # After a restart without a save the written batch is there, with its number.
    back = Engine.open(spark, root)
    assert back.count("c") == 14 and back.insert("c", rows, stream_batch=1) == 0 and back.insert("c", rows, stream_batch=2) == 1
    back.vacuum("c")
    back.save()
    again = Engine.open(spark, root)
    assert again.count("c") == 21 and again.insert("c", rows, stream_batch=2) == 0


def test_ids_of_very_many_partitions(spark):
    from lumenscan.operators import basic

    a = basic.tuple_ids(spark.range(20_000, numPartitions=10_000).toDF("x"), 3)
    assert a.select(F.min("ap_id"), F.max("ap_id"), F.countDistinct("ap_id")).first() == (3 << 43, (3 << 43) + 19_999, 20_000)
    with pytest.raises(EngineError):
        basic.tuple_ids(spark.range(1), 1 << 20)


def test_pk_and_unique_attributes_are_enforced(spark):
    e = Engine(spark)
    e.create_entity("u", [A("pkfield", "long", params={"pk": True}), A("uniquefield", "integer", params={"unique": True}), A("indexedfield", "integer", params={"indexed": True})])
    frame = lambda rows: spark.createDataFrame(rows, "pkfield long, uniquefield int, indexedfield int")
    e.insert("u", frame([(1, 10, 5), (2, None, 4), (3, None, 4)]))
    for bad in ([(4, 11, 1), (4, 12, 1)], [(1, 13, 1)], [(5, 10, 1)], [(None, 14, 1)], [(6, 15, 1), (7, 15, 1)]):
        with pytest.raises(EngineError):
            e.insert("u", frame(bad))
    e.insert("u", frame([(8, 16, 3)]))
    assert e.count("u") == 4


def test_names_and_files_of_indexes(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), 10)
    e.create_entity("c", [A("v", "vector")])
    e.generate("c", 40, **{"fv-dimensions": 4})
    first, second = (e.create_index("c", "v", "vaf") for _ in range(2))
    folder = e.index(first).options["path"]
    e.drop_index(first)
    assert e.create_index("c", "v", "vaf") not in (first, second) and e.index(second).data.count() == 40
    assert not (tmp_path / folder.split("/e/", 1)[1]).exists() and not list((tmp_path / "e" / "c" / "index").glob(f"{first}-*"))


def test_sources_of_combinations(engine):
    a, b = M.Scan("pictures", (M.Predicate("tid", "<", (20,)),), rank(20)), M.Scan("pictures", (M.Predicate("tid", ">=", (10,)),))
    of = lambda n: {r["ap_source"] for r in engine.query(n, ("source",)).collect()}
    assert of(M.Combine("intersect", a, b, "left")) == {"sequential scan->filter"}
    assert of(M.Combine("union", a, b)) == {"x UNION"}
    c = M.Scan("pictures", (M.Predicate("tid", ">=", (10,)), M.Predicate("tid", "<", (30,))), rank(20))
    assert of(M.Combine("fuzzyunion", a, c)) == {"sequential scan FUZZYUNION sequential scan", "x FUZZYUNION sequential scan", "sequential scan FUZZYUNION x"}


def test_stopping_a_query_by_its_id(spark, engine):
    import threading
    import time as clock

    slow = spark.range(0, 64, 1, 64).mapInPandas(lambda it: (clock.sleep(2) or p for p in it), "id long")
    engine.attach("slow", slow, "id")
    failed = []

    def work():
        try:
            engine.run(M.Scan("slow"), "the-slow-one")
        except Exception as e:
            failed.append(e)

    t = threading.Thread(target=work)
    t.start()
    clock.sleep(4)
    engine.stop("the-slow-one")
    t.join(25)
    assert not t.is_alive() and failed


def test_saved_catalog_import_and_export(spark, engine, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), 10)
    e.create_entity("c", [A("t", "long"), A("v", "vector")])
    e.generate("c", 60, **{"fv-dimensions": 4})
    name = e.create_index("c", "v", "vaf")
    e.save()
    back = Engine.open(spark, str(tmp_path / "e"))
    r = M.Ranking("v", (0.5,) * 4, 5)
    assert ids(back.knn_index(name, r), "t") == ids(e.knn("c", r), "t")
    e.export_data("c", str(tmp_path / "out"), "json")
    e.import_data("c", str(tmp_path / "out"), "json")
    assert e.count("c") == 120
    assert "vaf" in str(e.train_planner("c", "v", 1, 3, "naive", 1, logged=True)) or e.index(name).stale


def test_missing_modules_are_refused(spark, tmp_path):
    from lumenscan.sources import stores

    for kind in ("avro", "jdbc", "cassandra", "hbase"):
        with pytest.raises(EngineError):
            stores.write(spark.range(1), kind, str(tmp_path / "x"), url="jdbc:none:x", dbtable="t")


def test_text_and_geo(spark, engine):
    df = spark.createDataFrame([(1, "red fox and red hen", "POINT(8.5 47.4)"), (2, "blue hen", "POINT(2.3 48.9)"), (3, None, None)], "id long, x string, w string")
    engine.attach("ext", df.withColumn("g", F.struct(F.col("w").alias("geometry_desc"))), "id")
    got = engine.query(M.External("text", "ext", (("attribute", "x"), ("query", "red hen")))).collect()
    assert [r["id"] for r in got] == [1, 2] and got[0]["ap_score"] > got[1]["ap_score"]
    near = engine.query(M.External("geo", "ext", (("attribute", "g"), ("lat", 47.0), ("lng", 8.0), ("metres", 100_000.0)))).collect()
    assert [r["id"] for r in near] == [1]
