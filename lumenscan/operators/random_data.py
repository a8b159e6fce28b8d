"""Random tuples for entities, made on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.types import Attribute

_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _word(n: int, seed: int) -> Column:
    letters = F.array(*[F.lit(c) for c in _LETTERS])
    return F.array_join(F.array(*[F.get(letters, F.floor(F.rand(seed * 1000 + i) * 26).cast("int")) for i in range(n)]), "")


def _column(a: Attribute, seed: int, o: dict) -> Column:
    def span(kind: str, low: float, high: float) -> Column:
        lo, hi = float(o.get(f"{kind}-min", low)), float(o.get(f"{kind}-max", high))
        return F.rand(seed) * (hi - lo) + lo

    if a.kind in ("integer", "long", "auto"):
        return F.floor(F.rand(seed) * int(o.get("int-max", 1000))).cast(a.spark)
    if a.kind in ("float", "double"):
        return span(a.kind, 0, 1).cast(a.spark)
    if a.kind == "boolean":
        return F.rand(seed) < 0.5
    if a.kind == "string":
        return _word(int(o.get("string-nletters", 10)), seed)
    if a.kind == "text":
        return F.concat_ws(" ", *[_word(int(o.get("text-nletters", 10)), seed * 100 + i) for i in range(int(o.get("text-nwords", 20)))])
    if a.kind in ("geometry", "geography"):
        return F.struct(F.format_string("POINT(%.6f %.6f)", F.rand(seed) * 200 - 100, F.rand(seed + 1) * 180 - 90).alias("geometry_desc"))
    n, empty = int(o.get("fv-dimensions", 128)), float(o.get("fv-sparsity", 0.0))
    low, high = float(o.get("fv-min", 0)), float(o.get("fv-max", 1))

    def entry(i: int) -> Column:
        x = F.randn(seed * 10_007 + i) if o.get("fv-distribution") == "gaussian" else F.rand(seed * 10_007 + i) * (high - low) + low
        return (F.when(F.rand(seed * 20_011 + i) < empty, 0.0).otherwise(x) if empty else x).cast("float")

    v = F.array(*[entry(i) for i in range(n)])
    if a.kind == "vector":
        return v
    kept = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: F.abs(p["x"]) > 1e-10)
    return F.struct(kept["i"].alias("index"), kept["x"].alias("data"), F.lit(n).alias("length"))


def generate(spark: SparkSession, attributes: list[Attribute], n: int, seed: int = 1, **options) -> DataFrame:
    """n rows of the given attributes, the same for the same seed and partitioning."""
    made = [a for a in attributes if a.kind != "auto"]
    return spark.range(n).select(*[_column(a, seed + 31 * i, options).alias(a.name) for i, a in enumerate(made)])
