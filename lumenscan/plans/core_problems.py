"""Queries of the general problems: heavy keys (2) and small files (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.operators.compaction import compact_entities
from lumenscan.operators.scans import counted_results
from lumenscan.operators.skew import chunked_aggregate, heavy_keys
from lumenscan.runtime import materialise, table

HEAVY_PERCENT = 3


def _per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuples = (
        table(spark, sf_dir, "index_tuples")
        .select("leader", "ap_id", "inserted_at")
        .groupBy("leader", "ap_id")
        .agg(F.min("inserted_at").alias("a"), F.max("inserted_at").alias("z"))
    )
    by_leader = chunked_aggregate(tuples, "leader", {"n": ("count", None), "first_at": ("min", "a"), "last_at": ("max", "z")})
    scans = counted_results(table(spark, sf_dir, "scan_results"))
    by_id = chunked_aggregate(
        scans, "ap_id",
        {"n": ("count", None), "first_at": ("min", "first_at"), "last_at": ("max", "last_at"), "least_distance": ("min", "distance")},
    )
    left = by_leader.filter("leader is not null").select(
        F.lit("leader").alias("field"), F.col("leader").alias("ap_id"), "n", "first_at", "last_at", F.lit(None).cast("double").alias("least_distance")
    )
    return left.unionByName(by_id.select(F.lit("ap_id").alias("field"), "ap_id", "n", "first_at", "last_at", "least_distance"))


def p2_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-key results of every leader and every scanned ap_id, heavy ones marked."""
    keys = materialise(_per_key(spark, sf_dir), "p2keys")
    n_tuples = table(spark, sf_dir, "index_tuples").agg(F.countDistinct("ap_id").alias("t")).select(F.lit("leader").alias("field"), "t")
    n_scans = keys.filter("field = 'ap_id'").agg(F.sum("n").alias("t")).select(F.lit("ap_id").alias("field"), "t")
    totals = n_tuples.unionByName(n_scans)
    marked = heavy_keys(keys.join(F.broadcast(totals), "field"), "n", F.col("t"), HEAVY_PERCENT)  # a total for each field
    return marked.select("field", "ap_id", "n", "first_at", "last_at", "least_distance", "heavy")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_keys(spark, sf_dir).filter("heavy").select("field", "ap_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that stood more than once in the committed files, as read back from the compacted ones."""
    records, _ = compact_entities(table(spark, sf_dir, "entity_files"))
    return records.filter("n_copies > 1").select("entity", "ap_id")


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the compacted files, once each."""
    records, _ = compact_entities(table(spark, sf_dir, "entity_files"))
    return records.select("entity", "ap_id", "length", F.col("n_copies").cast("long").alias("n_copies"))


def p6_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files written for each entity and what was checked of them."""
    _, report = compact_entities(table(spark, sf_dir, "entity_files"))
    return report.select(F.col("grp").alias("entity"), "files_in", "blocks", "n_rows", "n_bytes", "valid")


_SCANS = """
latest AS (SELECT query_id, lower(trim(ap_source)) AS ap_source, CAST(ap_id AS BIGINT) AS ap_id,
  arg_max(struct_pack(d := ap_distance), scored_at) AS l, min(scored_at) AS first_at, max(scored_at) AS last_at
  FROM scan_results WHERE ap_id IS NOT NULL GROUP BY 1, 2, 3),
counted AS (SELECT query_id, ap_source, ap_id, first_at, last_at,
  CASE WHEN l.d IS NOT NULL AND NOT isnan(l.d) AND abs(l.d) < 1.7976931348623157e308 THEN l.d END AS distance FROM latest)"""

_P2_KEYS = f"""WITH {_SCANS},
k AS (SELECT 'leader' AS field, CAST(leader AS BIGINT) AS ap_id, count(DISTINCT ap_id) AS n, min(inserted_at) AS first_at,
    max(inserted_at) AS last_at, CAST(NULL AS DOUBLE) AS least_distance, (SELECT count(DISTINCT ap_id) FROM index_tuples) AS t
  FROM index_tuples WHERE leader IS NOT NULL GROUP BY leader
  UNION ALL
  SELECT 'ap_id', ap_id, count(*), min(first_at), max(last_at), min(distance), (SELECT count(*) FROM counted) FROM counted GROUP BY ap_id)
SELECT field, ap_id, n, first_at, last_at, least_distance, n * 100 >= t * {HEAVY_PERCENT} AS heavy FROM k"""

_P6_RECORDS = r"""WITH lines AS (SELECT lower(regexp_replace(coalesce(entityname, ''), '[^A-Za-z0-9_]', '', 'g')) AS entity,
    string_split(unnest(regexp_split_to_array(content, '\r\n|\n|\r')), chr(9)) AS p FROM entity_files WHERE state = 'committed'),
parts AS (SELECT entity, TRY_CAST(p[1] AS BIGINT) AS ap_id, TRY_CAST(p[3] AS INT) AS length,
    list_filter(string_split(p[4], ' '), lambda v: v <> '') AS v FROM lines WHERE len(p) = 4)
SELECT entity, ap_id, min(length) AS length, count(*) AS n_copies FROM parts
WHERE ap_id IS NOT NULL AND len(v) = length AND len(list_filter(v, lambda x: TRY_CAST(x AS DOUBLE) IS NULL)) = 0 GROUP BY 1, 2"""

QUERIES = {"p2_found": p2_found, "p2_keys": p2_keys, "p6_found": p6_found, "p6_records": p6_records, "p6_files": p6_files}
SQL = {
    "p6_found": f"SELECT entity, ap_id FROM ({_P6_RECORDS}) WHERE n_copies > 1",
    "p6_records": _P6_RECORDS,
    "p2_keys": _P2_KEYS,
    "p2_found": f"SELECT field, ap_id FROM ({_P2_KEYS}) WHERE heavy",
}
