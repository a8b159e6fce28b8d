"""The N best items of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenscan.operators.scans import counted_results, source_senses


def top_n(df: DataFrame, group: list[str], score: Column, tie: str, n: int, descending: bool = False) -> DataFrame:
    """Rows ranked 1 .. n of each group, with `rank`.

    A row_number window with a rank filter: the optimiser turns it into group
    limits before and after the shuffle, so a group of any size sends at most
    n rows from each partition. Rows whose score is null or NaN have no rank.
    Ties go to the smaller `tie`. Null group values form a group. Repeated rows
    are the caller's to drop. An empty table gives an empty result.
    """
    conf, limit = df.sparkSession.conf, "spark.sql.optimizer.windowGroupLimitThreshold"
    if n > int(conf.get(limit)):  # beyond it Spark would not prune, and a large group would go whole to one task
        conf.set(limit, str(n))
    rank = next(c for c in ("rank", "rank_", "rank__") if c not in df.columns)
    scored = df.filter(score.isNotNull() & ~F.isnan(score.cast("double")))
    order = score.desc() if descending else score.asc()
    return scored.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(order, F.col(tie).asc()))).filter(F.col(rank) <= n)


def oriented_results(scans: DataFrame, details: DataFrame) -> DataFrame:
    """(query_id, ap_source, ap_id, cost): results only, small cost is better.

    A source that expression_details do not know counts as ascending. The
    table of sources has a row per kind of scan; it is broadcast by Spark only
    if it is small.
    """
    results = counted_results(scans).filter(F.col("distance").isNotNull())
    senses = source_senses(details)
    return results.join(senses, "ap_source", "left").select(
        "query_id", "ap_source", "ap_id", F.when(F.coalesce("descending", F.lit(False)), -F.col("distance")).otherwise(F.col("distance")).alias("cost")
    )
