"""Per-key aggregation that is indifferent to how unevenly keys are spread.

Exact offset chunking: count each key per input partition, prefix-sum those
counts into offsets, give every row its number in key order, cut the numbers
into chunks of equal size, aggregate each chunk on its own and merge the
states of the keys that cross a chunk's border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenscan.runtime import materialise

_PARTIAL = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def prefix_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running total of `value` over the whole table in `order`.

    Range partitions carry the order; each one's total is a single number, so
    what is broadcast is bounded by the number of partitions, not by the data.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(n, *order).withColumn("_range__", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_range__").agg(F.sum(value).alias("_total__"))
    before = totals.select("_range__", (F.sum("_total__").over(W.orderBy("_range__")) - F.col("_total__")).alias("_base__"))
    w = W.partitionBy("_range__").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        ranged.join(F.broadcast(before), "_range__")
        .withColumn(out, F.col("_base__") + F.coalesce(F.sum(value).over(w), F.lit(0)))
        .drop("_range__", "_base__")
    )


def number_rows_by_key(df: DataFrame, key: str) -> DataFrame:
    """Adds `_row`: 0, 1, 2, ... in key order, and within a key in input order.

    No task sees more of one key than one input partition held of it.
    """
    base = materialise(df.withColumn("_mid", F.monotonically_increasing_id()), "numbered")
    base = base.withColumn("_pid", F.shiftright("_mid", 33))
    counts = base.groupBy(F.col(key).alias("_k"), "_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = prefix_sum(counts, ["_k", "_pid"], "_n", "_off").select("_k", F.col("_pid").alias("_p"), "_off")
    joined = base.join(offsets, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_pid") == F.col("_p")))
    rank = F.row_number().over(W.partitionBy(key, "_pid").orderBy("_mid"))
    return joined.withColumn("_row", F.col("_off") + rank - 1).drop("_mid", "_pid", "_k", "_p", "_off")


def chunked_aggregate(
    df: DataFrame,
    key: str,
    aggs: dict[str, tuple[str, str | Column | None]],
    chunk_rows: int = 50_000,
) -> DataFrame:
    """One row per key with `aggs`: {out: (count|sum|min|max|first|last, column)}.

    `first` and `last` go by input order. Null keys form one group, as in SQL;
    null values are ignored by every aggregate but count of None (all rows),
    first and last. An empty table gives an empty result. Column names of df
    never clash with the operator's own: only the needed columns are kept,
    under positional names.
    """
    cols = [F.col(key).alias("_key")]
    for i, (_, c) in enumerate(aggs.values()):
        cols.append((F.lit(1) if c is None else F.col(c) if isinstance(c, str) else c).alias(f"_v{i}"))
    numbered = number_rows_by_key(df.select(*cols), "_key").withColumn("_chunk", F.floor(F.col("_row") / chunk_rows))
    partial, merge = [], []
    for i, (out, (how, _)) in enumerate(aggs.items()):
        v, s = F.col(f"_v{i}"), f"_s{i}"
        if how in _PARTIAL:
            partial.append(_PARTIAL[how](v).alias(s))
            merge.append(_MERGE[how](s).alias(out))
        elif how == "first":
            partial.append(F.min_by(F.struct(v.alias("x")), F.col("_row")).alias(s))
            merge.append(F.min_by(s, F.col("_chunk"))["x"].alias(out))
        elif how == "last":
            partial.append(F.max_by(F.struct(v.alias("x")), F.col("_row")).alias(s))
            merge.append(F.max_by(s, F.col("_chunk"))["x"].alias(out))
        else:
            raise ValueError(f"unknown aggregate {how!r}")
    states = numbered.groupBy("_chunk", "_key").agg(*partial)
    return states.groupBy("_key").agg(*merge).withColumnRenamed("_key", key)


def heavy_keys(per_key: DataFrame, n: str, total: Column, percent: int = 3) -> DataFrame:
    """Adds `heavy`: the key holds at least `percent` % of `total`."""
    return per_key.withColumn("heavy", F.col(n) * 100 >= total * percent)
