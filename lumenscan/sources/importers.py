"""Imports of feature and text files, and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAD_NUMBER = 1.0


def vector_of(text: Column, bad: float | None = BAD_NUMBER) -> Column:
    """Numbers divided by blanks or commas; what is no number becomes `bad` (None: null)."""
    parts = F.filter(F.split(F.trim(text), r"[\s,]+"), lambda s: s != "")
    return F.transform(parts, lambda s: F.coalesce(s.try_cast("float"), F.lit(bad).cast("float")))


def feature_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, type, length, feature) of lines id TAB type TAB length TAB numbers."""
    p = F.split(column, "\t", -1)
    return lines.filter(F.size(p) == 4).select(
        F.trim(p[0]).alias("id"), F.trim(p[1]).alias("type"), p[2].try_cast("int").alias("length"), vector_of(p[3]).alias("feature")
    )


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return feature_lines(spark.read.text(path))


def text_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, text) of lines id TAB text."""
    p = F.split(column, "\t", 2)
    return lines.filter(F.size(p) == 2).select(F.trim(p[0]).alias("id"), p[1].alias("text"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return text_lines(spark.read.text(path))


def read_legacy(table: DataFrame, renamed: dict[str, str], casts: dict[str, str], vectors: list[str]) -> DataFrame:
    """A table of another database: columns renamed, cast, and vectors parsed from text like '<1,2,3>'."""
    for old, new in renamed.items():
        table = table.withColumnRenamed(old, new)
    for name in vectors:
        table = table.withColumn(name, vector_of(F.regexp_replace(name, r"[<>\[\](){}]", " "), None))
    return table.withColumns({n: F.col(n).cast(t) for n, t in casts.items()})


def export(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def import_files(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    r = spark.read.format(fmt)
    return (r.schema(schema) if schema is not None else r).load(path)
