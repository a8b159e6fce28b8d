"""The vector collections of the data, read by their conventions.

Every reader gives (grp, id, vec, pos): grp is the set within which vectors
are compared, id a string, vec array<double>. For sparse vectors vec holds the
stored values and pos their sorted positions. A vector that is null, empty,
all zero, of the wrong length or with an entry that is no finite number takes
no part. Vectors are checked in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.functions.names import entity_key
from lumenscan.runtime import table

ENTITY_DIMS = {"shot_colour": 64, "shot_motion": 56, "clip_audio": 48}
SHOT_DIMS = 48

_OUT = "grp string, id string, vec array<double>, pos array<int>"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parsed(text: pa.Array) -> pa.ListArray:
    """Numbers between brackets of any kind, divided by commas, semicolons or blanks; what is no number is null."""
    inner = pc.utf8_trim_whitespace(pc.replace_substring_regex(text, r"[\[\](){}<>]", " "))
    lists = pc.split_pattern_regex(inner, r"\s*[,;\s]\s*")
    flat = lists.values
    good = pc.if_else(pc.match_substring_regex(flat, _NUMBER), pc.replace_substring_regex(flat, r"^\+", ""), pa.scalar(None, flat.type))
    try:
        numbers = pc.cast(good, pa.float64())
    except pa.ArrowInvalid:
        numbers = pa.array([None if x is None else float(x) for x in good.to_pylist()], pa.float64())
    # A null text has an empty list here.
    return pa.ListArray.from_arrays(lists.offsets, numbers)


def _counted(marks: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many marks each list holds."""
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[off[1:]] - total[off[:-1]]


def checked(rows: DataFrame) -> DataFrame:
    """Usable vectors of rows (grp, id, v, n): v is a list of numbers or a text of them, n the length it must have (null: any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2)
            if not pa.types.is_list(v.type):
                v = parsed(v)
            off = v.offsets.to_numpy().astype(np.int64)
            values = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            size, want = np.diff(off), b.column(3).fill_null(-1).to_numpy()
            ok = v.is_valid().to_numpy(zero_copy_only=False) & (size > 0) & ((size == want) | (want < 0))
            ok &= (_counted(np.isfinite(values), off) == size) & (_counted(values != 0, off) > 0)
            ok &= b.column(0).is_valid().to_numpy(zero_copy_only=False) & b.column(1).is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(ok)
            ends = np.concatenate([[0], np.cumsum(size[at])])
            take = np.repeat(off[at] - ends[:-1], size[at]) + np.arange(ends[-1])
            rows = pa.array(at)
            vec = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[take] + 0.0))  # -0.0 is 0.0
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), vec, pa.nulls(len(at), pa.list_(pa.int32()))], ["grp", "id", "vec", "pos"])

    return rows.mapInArrow(run, _OUT)


def checked_sparse(rows: DataFrame) -> DataFrame:
    """Usable vectors of rows (grp, id, i, d, n): positions, values and length. Stored zeros are dropped and positions
    sorted, so equal vectors look equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, d = b.column(2), b.column(3)
            off, own = i.offsets.to_numpy().astype(np.int64), d.offsets.to_numpy().astype(np.int64)
            pos = i.values.to_numpy(zero_copy_only=False).astype(np.float64)
            data = d.values.to_numpy(zero_copy_only=False).astype(np.float64)
            n = b.column(4).fill_null(0).to_numpy()
            size = np.diff(off)
            ok = (size == np.diff(own)) & (size > 0)
            for c in (b.column(0), b.column(1), i, d):
                ok &= c.is_valid().to_numpy(zero_copy_only=False)
            length = np.zeros(len(pos))
            length[off[0] : off[-1]] = np.repeat(n, size)
            ok &= (_counted((pos >= 0) & (pos < length), off) == size) & (_counted(np.isfinite(data), own) == np.diff(own)) & (_counted(data != 0, own) > 0)
            at = np.flatnonzero(ok)
            ends = np.concatenate([[0], np.cumsum(size[at])])
            step = np.arange(ends[-1])
            p = pos[np.repeat(off[at] - ends[:-1], size[at]) + step].astype(np.int32)
            x = data[np.repeat(own[at] - ends[:-1], size[at]) + step]
            row = np.repeat(np.arange(len(at)), size[at])
            held = np.flatnonzero(x != 0)
            held = held[np.lexsort((x[held], p[held], row[held]))]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[held], minlength=len(at)))]).astype(np.int32))
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), b.column(1).take(rows), pa.ListArray.from_arrays(ends, pa.array(x[held])), pa.ListArray.from_arrays(ends, pa.array(p[held]))],
                ["grp", "id", "vec", "pos"],
            )

    return rows.mapInArrow(run, _OUT)


def tuple_vectors(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    dims = F.create_map(*[F.lit(x) for kv in ENTITY_DIMS.items() for x in kv])
    t = table(spark, sf_dir, "index_tuples").select(entity_key(F.col("entityname")).alias("e"), F.col("ap_id").cast("string").alias("id"), "ap_indexable")
    t = t.filter(F.col("e").isin(*ENTITY_DIMS))
    return checked(t.select(F.concat(F.lit(prefix), "e").alias("grp"), "id", F.col("ap_indexable").alias("v"), dims[F.col("e")].alias("n")))


def leader_vectors(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    t = table(spark, sf_dir, "ecp_leaders")
    return checked(t.select(F.concat(F.lit(prefix), "indexname").alias("grp"), F.col("ap_id").cast("string").alias("id"), F.col("ap_indexable").alias("v"), F.lit(None).cast("int").alias("n")))


def model_vectors(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    t = table(spark, sf_dir, "pq_models")
    grp = F.concat_ws("|", F.concat(F.lit(prefix), "indexname"), F.col("block").cast("string"))
    return checked(t.select(grp.alias("grp"), F.col("center_id").cast("string").alias("id"), F.col("center").alias("v"), F.lit(None).cast("int").alias("n")))


def shot_vectors(spark: SparkSession, sf_dir: str, prefix: str = "shot_features") -> DataFrame:
    return checked(table(spark, sf_dir, "shot_features").select(F.lit(prefix).alias("grp"), "id", F.col("feature").alias("v"), F.lit(SHOT_DIMS).alias("n")))


def sparse_vectors(spark: SparkSession, sf_dir: str, prefix: str = "sparse_features") -> DataFrame:
    f = F.col("feature")
    return checked_sparse(table(spark, sf_dir, "sparse_features").select(F.lit(prefix).alias("grp"), F.col("ap_id").cast("string").alias("id"), f.index.alias("i"), f.data.alias("d"), f.length.alias("n")))
