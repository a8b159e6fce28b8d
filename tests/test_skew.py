"""Offset chunking against plain grouping, on skewed, null and empty keys."""

import pytest
from pyspark.sql import functions as F

from lumenscan.operators.skew import chunked_aggregate, number_rows_by_key, prefix_sum


@pytest.fixture(scope="module")
def rows(spark):
    # One key holds a third, one is null, the rest are rare.
    k = F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 500 + 2)
    return spark.range(0, 6000, 1, 6).select(k.alias("k"), "id", (F.col("id") * 31 % 97).cast("double").alias("x"), F.lit(1).alias("_row"), F.lit(2).alias("_pid"))


def test_row_numbers_are_a_permutation_in_key_order(rows):
    got = sorted((r["_n"], r["k"]) for r in number_rows_by_key(rows.select("k", "id"), "k").select(F.col("_row").alias("_n"), "k").collect())
    assert [n for n, _ in got] == list(range(6000))
    keys = [k for _, k in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))


@pytest.mark.parametrize("chunk", [7, 100, 1_000_000])
def test_equals_group_by(rows, chunk):
    aggs = {"n": ("count", None), "s": ("sum", "x"), "lo": ("min", "x"), "hi": ("max", "x"), "a": ("first", "id"), "z": ("last", "id")}
    got = {r["k"]: tuple(r)[1:] for r in chunked_aggregate(rows, "k", aggs, chunk).collect()}
    plain = rows.groupBy("k").agg(F.count(F.lit(1)), F.sum("x"), F.min("x"), F.max("x"), F.min("id"), F.max("id"))
    assert got == {r["k"]: tuple(r)[1:] for r in plain.collect()}


def test_empty_and_all_null(spark, rows):
    assert chunked_aggregate(rows.limit(0), "k", {"n": ("count", None)}).count() == 0
    one = chunked_aggregate(spark.range(5).select(F.lit(None).cast("long").alias("k")), "k", {"n": ("count", None)}).collect()
    assert [(r["k"], r["n"]) for r in one] == [(None, 5)]
    with pytest.raises(ValueError):
        chunked_aggregate(rows, "k", {"n": ("median", "x")})


def test_prefix_sum(spark):
    df = spark.range(200).select((F.col("id") * 37 % 200).alias("o"), F.lit(2).alias("v"), F.lit(0).alias("_base"))
    got = {r["o"]: r["t"] for r in prefix_sum(df, ["o"], "v", "t").collect()}
    assert got == {i: 2 * i for i in range(200)}
