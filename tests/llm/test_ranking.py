"""Rank walk and top N: small and distributed paths, ties, empty and hot groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenscan.llm import rankwalk
from lumenscan.llm.rankwalk import answered_results, rank_items, walks
from lumenscan.llm.topn import oriented_results, top_n

SCANS = "query_id string, ap_source string, ap_id long, ap_distance double, scored_at timestamp_ntz, rank int, cost int"
DETAILS = "query_id string, ap_source string, sense string, confidence float"


def slow_walk(lists, damping=0.85):
    """lists: {scan: [items best first]}. The walk as a dense matrix."""
    items = sorted({i for v in lists.values() for i in v})
    at, n = {x: i for i, x in enumerate(items)}, len(items)
    m = np.zeros((n, n))
    for order in lists.values():
        for x in items:
            better = order[: order.index(x) + 1] if x in order else order
            for y in better:
                m[at[y], at[x]] += 1 / len(better) / len(lists)
    m = damping * m + (1 - damping) / n
    p = np.full(n, 1 / n)
    for _ in range(3000):
        p = m @ p
    return dict(zip(items, p))


@pytest.fixture(scope="module")
def lists():
    random.seed(4)
    return {f"q{q}": {f"s{s}": random.sample(range(40), random.randint(1, 30)) for s in range(random.randint(1, 4))} for q in range(6)}


def as_rows(lists):
    # Costs on wildly different scales; equal costs for a few, so that the id decides.
    return [(q, s, i, float(10 ** (int(s[1]) * 3) * (k + 1))) for q, v in lists.items() for s, order in v.items() for k, i in enumerate(order)]


@pytest.mark.parametrize("pack,damping", [(1000, 0.85), (1000, 0.5), (0, 0.85), (0, 0.5)])
def test_walk_is_the_stationary_distribution(spark, lists, monkeypatch, pack, damping):
    monkeypatch.setattr(rankwalk, "BLOCK_ROWS", 7)
    df = spark.createDataFrame(as_rows(lists), "query_id string, ap_source string, ap_id long, cost double")
    got = {(r["query_id"], r["ap_id"]): r for r in rank_items(df, damping, pack_rows=pack).collect()}
    for q, v in lists.items():
        for i, p in slow_walk(v, damping).items():
            r = got[q, i]
            assert r["stationarity"] == pytest.approx(p, rel=1e-7)
            assert r["scans"] == len(v) and r["listed"] == sum(i in o for o in v.values())
            assert r["worst_rank"] == max(o.index(i) + 1 for o in v.values() if i in o)


def test_agreed_items_stand_in_the_first_places():
    """What every list has among its five best is among the first 5k places of the walk of k lists."""
    rng = np.random.default_rng(9)
    seen = 0
    for _ in range(300):
        k, n = int(rng.integers(2, 5)), int(rng.integers(6, 60))
        agreed, rest = list(range(3)), list(range(3, n))
        lists = []
        for _ in range(k):
            others = [int(x) for x in rng.permutation(rest)[: rng.integers(3, n - 2)]]
            head = agreed + others[:2]
            rng.shuffle(head)
            lists.append(head + others[2:])
        item, scan = np.concatenate(lists), np.repeat(np.arange(k), [len(x) for x in lists])
        cost = np.concatenate([np.arange(len(x)) for x in lists]).astype(float)
        _, ids, p, _, listed, worst = walks(np.zeros(len(item), int), scan, item, cost)
        place = np.argsort(np.lexsort((ids, -p)))
        case = (listed == k) & (worst <= 5)
        seen += case.sum()
        assert (place[case] < 5 * k).all()
    assert seen > 500


def test_no_scan_outweighs_by_its_range(spark, lists):
    df = spark.createDataFrame(as_rows(lists), "query_id string, ap_source string, ap_id long, cost double")
    a = {(r[0], r[1]): r[2] for r in rank_items(df).collect()}
    b = {(r[0], r[1]): r[2] for r in rank_items(df.withColumn("cost", F.log("cost"))).collect()}
    assert a == pytest.approx(b)


def test_single_list_keeps_its_order_and_ties_go_to_the_smaller_id():
    ids = np.array([5, 6, 7, 9])
    _, _, p, _, listed, worst = walks(np.zeros(4, int), np.zeros(4, int), ids, np.array([2.0, 1.0, 1.0, 3.0]))
    assert list(np.argsort(-p)) == [1, 2, 0, 3] and list(worst) == [3, 1, 2, 4] and set(listed) == {1}


def test_empty(spark):
    none = spark.createDataFrame([], "query_id string, ap_source string, ap_id long, cost double")
    assert rank_items(none).count() == 0


@pytest.fixture(scope="module")
def raw(spark):
    t0, t1 = "2022-01-01 00:00:00", "2022-01-02 00:00:00"
    big = 1.7976931348623157e308
    rows = [
        ("q", " A", 1, 9.0, t0), ("q", "a", 1, 1.0, t1), ("q", "a", 1, 1.0, t1), ("q", "a", 2, 1.0, t0), ("q", "a", 3, float("nan"), t0), ("q", "a", 4, None, t0),
        ("q", "a", 5, big, t0), ("q", "a", 6, float("inf"), t0), ("q", "a", None, 0.0, t0), ("q", "a", 7, 0.5, t0), ("q", "a", 7, None, t1), ("q", "a", 8, 4.0, t0),
        ("q", "TEXT ", 1, 0.1, t0), ("q", "text", 2, 0.9, t0), ("r", "a", 1, -1.0, t0), (None, "a", 1, 2.0, t0), ("q", None, 1, 2.0, t0),
    ]
    from datetime import datetime

    scans = spark.createDataFrame([(*r[:4], datetime.fromisoformat(r[4]), 0, 0) for r in rows], SCANS)
    details = spark.createDataFrame([("q", "a", "asc", 0.5), ("q", "a", "asc", 0.5), ("q", "text", "desc", 0.0), ("r", "a", "asc", float("nan")), ("r", "text", "desc", None)], DETAILS)
    return scans, details


def test_results_and_answered(raw):
    scans, details = raw
    got = {(r["query_id"], r["ap_source"], r["ap_id"]): r["cost"] for r in oriented_results(scans, details).collect()}
    assert got == {("q", "a", 1): 1.0, ("q", "a", 2): 1.0, ("q", "a", 8): 4.0, ("q", "text", 1): -0.1, ("q", "text", 2): -0.9, ("r", "a", 1): -1.0, (None, "a", 1): 2.0, ("q", None, 1): 2.0}
    assert {(r["query_id"], r["ap_source"]) for r in answered_results(scans, details).collect()} == {("q", "a")}
    assert oriented_results(scans.limit(0), details).count() == 0 == answered_results(scans, details.limit(0)).count()


def test_top_n_edges(spark):
    rows = [(g, i, float(s) if s is not None else None, 7) for g, i, s in [("x", 2, 1), ("x", 1, 1), ("x", 3, 1), ("x", 4, None), ("y", 1, 5), (None, 9, 1), ("x", 0, float("nan"))]]
    df = spark.createDataFrame(rows, "g string, i long, score double, rank int")
    got = {(r["g"], r["rank_"], r["i"]) for r in top_n(df, ["g"], F.col("score"), "i", 2).collect()}
    assert got == {("x", 1, 1), ("x", 2, 2), ("y", 1, 1), (None, 1, 9)}
    down = {(r["g"], r["i"]) for r in top_n(df, ["g"], F.col("score"), "i", 1, descending=True).collect()}
    assert down == {("x", 1), ("y", 1), (None, 9)}
    assert top_n(df.limit(0), ["g"], F.col("score"), "i", 2).count() == 0


def test_group_limit_prunes_before_the_shuffle(spark):
    df = spark.range(0, 100_000, 1, 8).select((F.col("id") % 3 * 0).alias("g"), "id", F.rand(1).alias("score"))
    plan = top_n(df, ["g"], F.col("score"), "id", 3)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert top_n(df, ["g"], F.col("score"), "id", 3).count() == 3


def test_group_limits_hold_for_any_n(spark):
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(key)
    df = spark.createDataFrame([("a", float(i), i) for i in range(50)], "g string, s double, i long")
    out = top_n(df, ["g"], F.col("s"), "i", 5000)
    assert out.count() == 50 and "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(key, before)
