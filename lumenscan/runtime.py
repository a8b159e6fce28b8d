"""Session, table and scratch-folder helpers shared by every operator."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Tables that materialise and others wrote, for cleanup(); names of those in the session's catalog, by path.
_written: list[str] = []
_named: dict[str, str] = {}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lumenscan")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session, so that they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_lumenscan_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lumenscan-code-")) / "lumenscan.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, Path("lumenscan") / p.relative_to(here))
    sc.addPyFile(str(archive))
    sc._lumenscan_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only a local session may go without: it gets a folder of its own."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lumenscan-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, label: str = "stage", partition_by: list[str] | None = None, dictionary: bool = True) -> DataFrame:
    """Write df to the shared folder and read it back. dictionary: off for columns of numbers that hardly repeat.

    Cuts lineage with a copy that outlives any executor and fixes values such
    as partition numbers, which a recomputation could otherwise change.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("overwrite").option("parquet.enable.dictionary", str(dictionary).lower())
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def materialise_bucketed(df: DataFrame, key: str, label: str = "bucketed", placed: bool = False, buckets: int | None = None, dictionary: bool = True) -> DataFrame:
    """As materialise, laid out in buckets of `key`: later joins on it need not shuffle this side.

    placed: its tasks hold the partitions of repartition(n, key) already, n being buckets or else spark.sql.shuffle.partitions.
    """
    spark = df.sparkSession
    path, name = scratch_path(spark, label), f"{label}_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df if placed else df.repartition(n, key)
    rows.write.format("parquet").option("parquet.enable.dictionary", str(dictionary).lower()).bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    _named[path] = name
    out = spark.table(name)
    out._scratch_path = path
    return out


def cleanup(spark: SparkSession) -> None:
    """Deletes every table this process wrote to the shared folder. DataFrames over them can no longer be read."""
    while _written:
        _delete(spark, _written.pop())


def discard(df: DataFrame) -> None:
    """Delete a materialised table that nothing will read again."""
    path = getattr(df, "_scratch_path", None)
    if path:
        if path in _written:
            _written.remove(path)
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _named:
        spark.sql(f"DROP TABLE IF EXISTS {_named.pop(path)}")
    delete_path(spark, path)


def release(spark: SparkSession) -> None:
    """Lets executors delete the shuffle files of finished steps.

    Spark does so when the driver has collected what stood for them, which in
    a long job with little garbage may be never.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a path; 0 if it is not there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0
