"""Few well-sized files in place of very many tiny ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.functions.names import entity_key
from lumenscan.operators.skew import prefix_sum
from lumenscan.runtime import delete_path, materialise, scratch_path
from lumenscan.sources.parquet_blocks import merge_files

_REPORT = "grp string, file string, files_in long, blocks long, n_rows long, n_bytes long, valid boolean"


def list_files(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """(path, length) of the files under root; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")
    )


def consolidate(files: DataFrame, out_dir: str, target_bytes: int = 128 << 20) -> DataFrame:
    """Joins Parquet files of each `grp` into files of about `target_bytes`.

    files: (grp, path, length). Files go to bins by the running total of their
    lengths in (grp, path) order; a bin is one task that copies encoded column
    chunks and rewrites the footer. Every input is in exactly one bin, so rows
    are neither lost nor doubled; each output is read back and checked before
    it takes its place. Returns the report, one row per written file. An empty
    list of files gives an empty report; a null grp counts as a group.
    """
    binned = prefix_sum(files.select("grp", "path", "length"), ["grp", "path"], "length", "_before").withColumn(
        "bin", F.floor(F.col("_before") / target_bytes)
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grp, b = key
        folder = "none" if grp is None else "g-" + "".join(c if c.isalnum() or c == "_" else "-" for c in str(grp))
        m = merge_files(sorted(pdf["path"]), f"{out_dir}/{folder}/part-{int(b):06d}.parquet")
        return pd.DataFrame([[grp, m.path, m.files_in, m.blocks, m.rows, m.n_bytes, m.ok]], columns=["grp", "file", "files_in", "blocks", "n_rows", "n_bytes", "valid"])

    return materialise(binned.groupBy("grp", "bin").applyInPandas(run, _REPORT), "consolidated")


def file_records(files: DataFrame) -> DataFrame:
    """The complete records of committed files, one row per line.

    A line is ap_id, type, length and values between tabs; it is complete if it
    has exactly `length` values, all numbers. Torn, blank and heading lines and
    files with null or empty content give nothing.
    """
    line = F.split("line", "\t", -1)
    return (
        files.filter(F.col("state") == "committed")
        .select(entity_key(F.coalesce("entityname", F.lit(""))).alias("entity"), "file_id", "written_at", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("line_no", "line"))
        .filter(F.size(line) == 4)
        .select(
            "entity", "file_id", "written_at", "line_no",
            line[0].try_cast("bigint").alias("ap_id"),
            F.trim(line[1]).alias("type"),
            line[2].try_cast("int").alias("length"),
            F.filter(F.split(line[3], " +"), lambda v: v != "").alias("_text"),
        )
        .withColumn("values", F.transform("_text", lambda v: v.try_cast("double")))
        .filter(F.col("ap_id").isNotNull() & (F.size("_text") == F.col("length")) & ~F.exists("values", lambda v: v.isNull()))
        .drop("_text")
    )


def single_records(records: DataFrame) -> DataFrame:
    """One row per (entity, ap_id): the first stored, and how often it stood there."""
    order = F.struct("written_at", "file_id", "line_no")
    return (
        records.groupBy("entity", "ap_id")
        .agg(F.min_by(F.struct("type", "length", "values"), order).alias("_r"), F.count(F.lit(1)).alias("n_copies"))
        .select("entity", "ap_id", "_r.*", "n_copies")
    )


def compact_entities(files: DataFrame, target_bytes: int = 128 << 20) -> tuple[DataFrame, DataFrame]:
    """(records read back from the consolidated files, report of the files).

    Raises if the consolidated files do not hold as many records as the pieces.
    """
    spark = files.sparkSession
    pieces, out = scratch_path(spark, "pieces"), scratch_path(spark, "compacted")
    single = single_records(file_records(files))
    single.withColumn("_g", F.when(F.col("entity") == "", "_").otherwise(F.col("entity"))).write.partitionBy("_g").parquet(pieces)
    listed = list_files(spark, pieces).withColumn("grp", F.regexp_extract("path", r"/_g=([^/]*)/", 1))
    report = consolidate(listed, out, target_bytes)
    moved, valid = report.agg(F.sum("n_rows"), F.min("valid")).first()
    schema = single.schema
    stored = spark.read.schema(schema).parquet(pieces).count()
    if (moved or 0) != stored or valid is False:
        raise RuntimeError(f"{stored} records went in, {moved} came out")
    delete_path(spark, pieces)
    if not moved:
        return spark.createDataFrame([], schema), report
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out), report
