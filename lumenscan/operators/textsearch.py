"""Text and place search in DataFrames, in place of external search engines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.functions.distance import haversine

K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25(df: DataFrame, pk: str, text: str, query: str, rounded: int | None = None) -> DataFrame:
    """(pk, ap_score) of rows that hold a term of the query, by BM25.

    Only query terms are counted, so one pass over the texts yields a row for
    each match; corpus sizes are a single aggregate. Null texts never match. A
    query without terms gives nothing; terms given twice count once.
    """
    wanted = sorted({t for t in re.split(r"[^\w]+|_", query.lower()) if t})
    if not wanted:
        return df.select(pk, F.lit(0.0).alias("ap_score")).limit(0)
    t = df.filter(F.col(text).isNotNull()).select(pk, terms(F.col(text)).alias("_t"))

    def occurrences(w: str) -> Column:
        return F.size(F.filter("_t", lambda x: x == w))

    counts = [occurrences(w).alias(f"_n{i}") for i, w in enumerate(wanted)]
    rows = t.select(pk, F.size("_t").alias("_len"), *counts)
    stats = rows.agg(
        F.count(F.lit(1)).alias("_rows"), F.avg("_len").alias("_avg"), *[F.sum((F.col(f"_n{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(wanted))]
    )

    def part(i: int) -> Column:
        n, df_ = F.col(f"_n{i}"), F.col(f"_df{i}")
        idf = F.log(1 + (F.col("_rows") - df_ + 0.5) / (df_ + 0.5))
        return idf * n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))

    score = sum((part(i) for i in range(1, len(wanted))), part(0))
    hit = rows.filter(sum((F.col(f"_n{i}") for i in range(1, len(wanted))), F.col("_n0")) > 0)
    out = hit.join(F.broadcast(stats), F.lit(True))  # one row of totals
    return out.select(pk, (F.round(score, rounded) if rounded is not None else score).alias("ap_score"))


def point(geo: Column) -> tuple[Column, Column]:
    """(x, y) of a WKT point; null for anything else."""
    number = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    pattern = rf"^\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$"

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(geo["geometry_desc"], pattern, i), F.lit("")).try_cast("double")

    return part(1), part(2)


def geo_within(df: DataFrame, geo: str, lat: float, lng: float, metres: float) -> DataFrame:
    """Rows whose point (x: longitude, y: latitude) is at most so many metres away, with ap_distance."""
    x, y = point(F.col(geo))
    d = haversine(F.lit(lat), F.lit(lng), y, x)
    return df.withColumn("ap_distance", d).filter(F.col("ap_distance") <= metres)
