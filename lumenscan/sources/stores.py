"""Storage engines: where the attributes of an entity lie, and reading and writing them.

Spark's own sources do the work, so predicates and columns are pushed down by
Catalyst. Avro, JDBC and other databases need their modules; without them their
use is refused with a clear message.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lumenscan.model import Predicate
from lumenscan.operators.basic import where
from lumenscan.types import ENGINE_TYPES, EngineError

FILE_ENGINES = ("parquet", "orc", "json", "avro")
#: Engines that are reached by options instead of a path, and their Spark formats.
CONNECTORS = {"jdbc": "jdbc", "cassandra": "org.apache.spark.sql.cassandra", "hbase": "org.apache.hadoop.hbase.spark"}


def handlers() -> dict[str, list[str]]:
    """Engines and the attribute types each can hold."""
    return {k: sorted(v) for k, v in ENGINE_TYPES.items()}


def supports(engine: str, kind: str) -> bool:
    return kind in ENGINE_TYPES.get(engine, ())


def _connected(engine: str, act: Callable):
    try:
        return act()
    except Exception as e:
        if any(x in str(e) for x in ("DATA_SOURCE_NOT_FOUND", "Failed to find data source", "No suitable driver", "external but built-in", "ClassNotFound")):
            raise EngineError(f"the module of the {engine} store is not installed") from e
        raise


def write(df: DataFrame, engine: str, path: str, mode: str = "append", **options) -> None:
    if engine in CONNECTORS:
        _connected(engine, lambda: df.write.format(CONNECTORS[engine]).options(**options).mode(mode).save())
        return
    if engine not in FILE_ENGINES:
        raise EngineError(f"unknown engine {engine!r}")
    _connected(engine, lambda: df.write.format(engine).mode(mode).save(path))


def read(spark: SparkSession, engine: str, path: str | list[str], schema: T.StructType, predicates: Sequence[Predicate] = (), **options) -> DataFrame:
    """The stored rows; predicates reach the scan."""
    if engine in CONNECTORS:
        df = _connected(engine, lambda: spark.read.format(CONNECTORS[engine]).options(**options).load())
    elif engine in FILE_ENGINES:
        df = _connected(engine, lambda: spark.read.format(engine).schema(schema).load(path))
    else:
        raise EngineError(f"unknown engine {engine!r}")
    return where(df, predicates)


def write_both(df: DataFrame, path: str, pk: str, buckets: int) -> None:
    """Two copies: one in plain order for scans, one clustered by id for look-ups."""
    df.write.mode("overwrite").parquet(f"{path}/scan")
    df.repartitionByRange(buckets, pk).sortWithinPartitions(pk).write.mode("overwrite").parquet(f"{path}/lookup")


def read_both(spark: SparkSession, path: str, predicates: Sequence[Predicate] = (), pk: str = "ap_id") -> DataFrame:
    """Look-ups by id go to the clustered copy, where row-group statistics prune; all else to the other."""
    by_id = any(p.attribute == pk for p in predicates)
    return where(spark.read.parquet(f"{path}/{'lookup' if by_id else 'scan'}"), predicates)
