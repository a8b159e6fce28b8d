"""Reading scan results and tuples by the conventions of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.functions.names import source_key

NO_RESULT = 1.7976931348623157e308


def valid_distance(c: Column) -> Column:
    """Null, NaN, an infinity and the largest double mean: no result."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(NO_RESULT))


def counted_results(scans: DataFrame) -> DataFrame:
    """One row per (query_id, ap_source, ap_id): the latest counts.

    Rows without ap_id are void. Of rows with the same scored_at the larger
    distance counts (a null only if there is no other), so that the result
    does not depend on row order. Gives distance (null where the tuple has no
    result), first_at and last_at over all its rows.
    """
    d = F.col("ap_distance")
    return (
        scans.filter(F.col("ap_id").isNotNull())
        .select("query_id", source_key(F.col("ap_source")).alias("ap_source"), F.col("ap_id").cast("long").alias("ap_id"), d, "scored_at")
        .groupBy("query_id", "ap_source", "ap_id")
        .agg(
            F.max(F.struct("scored_at", "ap_distance")).alias("_last"),
            F.min("scored_at").alias("first_at"),
            F.max("scored_at").alias("last_at"),
        )
        .select(
            "query_id", "ap_source", "ap_id", "first_at", "last_at",
            F.when(valid_distance(F.col("_last.ap_distance")), F.col("_last.ap_distance")).alias("distance"),
        )
    )


def source_senses(details: DataFrame) -> DataFrame:
    """(ap_source, descending) as expression_details say; one row per source."""
    return (
        details.filter(F.col("ap_source").isNotNull())
        .groupBy(source_key(F.col("ap_source")).alias("ap_source"))
        .agg(F.max(F.lower(F.trim("sense")) == "desc").alias("descending"))
    )
