"""Queries of the training-data problems and the SQL they can be checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenscan.llm import collections as C
from lumenscan.llm.clusters import all_clusters, similar_pairs
from lumenscan.llm.leaks import find_leaks
from lumenscan.llm.lists import nearest_lists
from lumenscan.llm.mixture import mix
from lumenscan.llm.neighbours import LIST, nearest, neighbour_graph, search
from lumenscan.llm.rankwalk import answered_results, rank_items
from lumenscan.llm.subjects import corpus_by_subject, subject_areas
from lumenscan.llm.topn import oriented_results, top_n
from lumenscan.runtime import materialise, table


def _p1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuples = C.tuple_vectors(spark, sf_dir, "ap_indexable|")
    leaders = C.leader_vectors(spark, sf_dir, "leaders|")
    models = C.model_vectors(spark, sf_dir, "models|")
    return tuples.unionByName(leaders).unionByName(models)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similar_pairs(_p1_vectors(spark, sf_dir))
    a, b = F.col("id_a").cast("long"), F.col("id_b").cast("long")
    return pairs.select(F.substring_index("grp", "|", 1).alias("field"), F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster, the cluster's size and the vector's rank as a typical member."""
    out = all_clusters(_p1_vectors(spark, sf_dir))
    return out.select(
        F.substring_index("grp", "|", 1).alias("field"), F.expr("substring(grp, instr(grp, '|') + 1)").alias("part"),
        F.col("id").cast("long").alias("id"), F.col("cluster").cast("long").alias("cluster"), "size", F.col("typical").cast("long").alias("typical"),
    )


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ranking of every query's tuples over its answered scans."""
    results = answered_results(table(spark, sf_dir, "scan_results"), table(spark, sf_dir, "expression_details"))
    return rank_items(results)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples high in the ranking that every answered scan has among its five best.

    One that every scan has among its five best gets more of the walk than any
    that all scans put below it; only those among the four before it in some
    scan may come first. So it is among the first five times as many as there
    are scans; these places are taken from the ranking, then checked.
    """
    order = W.partitionBy("query_id").orderBy(F.col("stationarity").desc(), "ap_id")
    first = p3_ranking(spark, sf_dir).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 5 * F.col("scans"))
    return first.filter("scans >= 2 AND listed = scans AND worst_rank <= 5").select("query_id", "ap_id")


def _p4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuples = C.tuple_vectors(spark, sf_dir, "index_tuples|")
    return tuples.unionByName(C.shot_vectors(spark, sf_dir)).unionByName(C.sparse_vectors(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a vector that has five others at 0.9 or above with its five most similar."""
    lists = nearest(_p4_vectors(spark, sf_dir), 5, 0.9)
    full = lists.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("grp", "id"))).filter("n = 5")
    return full.select(
        F.substring_index("grp", "|", 1).alias("collection"), F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")
    ).distinct()


def _p4_rows(lists: DataFrame) -> DataFrame:
    return lists.select(
        F.substring_index("grp", "|", 1).alias("collection"), F.substring_index("grp", "|", -1).alias("part"),
        "id", "other", F.col("s").alias("similarity"), F.col("rank").cast("long").alias("place"),
    )


def p4_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar others of every vector of the three collections, however similar, by NN-descent."""
    return _p4_rows(nearest(_p4_vectors(spark, sf_dir), 5, None))


def _p4_wanted(vectors: DataFrame) -> DataFrame:
    """Vectors whose id is divisible by 50; of the ids of shots the hexadecimal digits count."""
    number = F.when(F.col("id").startswith("sh"), F.conv(F.substring("id", 3, 12), 16, 10).cast("long")).otherwise(F.col("id").try_cast("long"))
    return vectors.filter(number % 50 == 0)


def p4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar others at 0.9 or above of the vectors with an id divisible by 50, by greedy graph search."""
    vectors = _p4_vectors(spark, sf_dir)
    return _p4_rows(search(vectors, _p4_wanted(vectors), 5, 0.9))


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p4_lists and the same search without a floor find of the true five most similar, for ids divisible by 50."""
    vectors = _p4_vectors(spark, sf_dir)
    wanted = _p4_wanted(vectors)
    key = ["collection", "part", "id", "other"]
    truth = materialise(_p4_rows(nearest_lists(vectors, 5, wanted)), "truth")
    graph = neighbour_graph(vectors, LIST, None)
    listed = _p4_rows(nearest(vectors, 5, None, graph)).select(*key, F.lit(1).alias("in_lists"))
    walked = _p4_rows(search(vectors, wanted, 5, None, graph)).select(*key, F.lit(1).alias("in_search"))
    held = truth.join(listed, key, "left").join(walked, key, "left").groupBy("collection", "part")
    return held.agg(F.count(F.lit(1)).alias("places"), F.count("in_lists").alias("in_lists"), F.count("in_search").alias("in_search"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = oriented_results(table(spark, sf_dir, "scan_results"), table(spark, sf_dir, "expression_details"))
    return top_n(results, ["query_id", "ap_source"], F.col("cost"), "ap_id", 3).select("query_id", "ap_source", "ap_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items they leak, the longest run and the words found in order."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each drawn document is in the mixture."""
    draws, _ = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))
    return draws.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.first("tokens").alias("tokens"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats or part taken, actual share and what is missing, for every source."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_areas(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_samples"), table(spark, sf_dir, "subject_areas"))


def p9_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The make-up of the corpus by subject."""
    return corpus_by_subject(table(spark, sf_dir, "documents"), materialise(p9_found(spark, sf_dir), "subjects"))


_RESULTS = """
counted AS (SELECT query_id, lower(trim(ap_source)) AS ap_source, CAST(ap_id AS BIGINT) AS ap_id, arg_max(struct_pack(d := ap_distance), scored_at).d AS d
  FROM scan_results WHERE ap_id IS NOT NULL GROUP BY 1, 2, 3),
sense AS (SELECT lower(trim(ap_source)) AS ap_source, max(CASE WHEN sense = 'desc' THEN -1 ELSE 1 END * -1) AS minus FROM expression_details GROUP BY 1),
result AS (SELECT query_id, c.ap_source, ap_id, CASE WHEN minus = 1 THEN -d ELSE d END AS cost FROM counted c LEFT JOIN sense USING (ap_source)
  WHERE d IS NOT NULL AND NOT isnan(d) AND abs(d) < 1.7976931348623157e308)"""

_UNIT = """
raw AS (
  SELECT 'ap_indexable' AS field, e AS part, ap_id AS id, ap_indexable::DOUBLE[] AS v FROM (
    SELECT DISTINCT lower(regexp_replace(entityname, '[^A-Za-z0-9_]', '', 'g')) AS e, ap_id, ap_indexable FROM index_tuples)
  WHERE len(ap_indexable) = CASE e WHEN 'shot_colour' THEN 64 WHEN 'shot_motion' THEN 56 WHEN 'clip_audio' THEN 48 END
  UNION ALL SELECT 'leaders', indexname, ap_id, ap_indexable::DOUBLE[] FROM ecp_leaders
  UNION ALL SELECT 'models', concat(indexname, '|', block), center_id, center::DOUBLE[] FROM pq_models),
vecs AS (SELECT DISTINCT * FROM raw WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(v, lambda x: x <> 0)) > 0)"""

_SIMS = f"""{_UNIT},
shot AS (SELECT DISTINCT id, list_transform(regexp_split_to_array(trim(regexp_replace(feature, '[\\[\\](){{}}<>]', ' ', 'g')), '\\s*[,;\\s]\\s*'), lambda x: TRY_CAST(x AS DOUBLE)) AS v FROM shot_features),
sp AS (SELECT DISTINCT ap_id, list_sort(list_filter(list_zip(feature.index, feature.data), lambda p: p[2] <> 0)) AS p FROM sparse_features
  WHERE len(feature.index) = len(feature.data) AND len(list_filter(feature.data, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(feature.index, lambda i: i < 0 OR i >= feature.length)) = 0 AND len(list_filter(feature.data, lambda x: x <> 0)) > 0),
entry AS (SELECT ap_id, unnest(p) AS e FROM sp), cell AS (SELECT ap_id, e[1] AS i, CAST(e[2] AS DOUBLE) AS x FROM entry),
norm AS (SELECT ap_id, sqrt(sum(x * x)) AS n FROM cell GROUP BY 1),
sims AS (
  SELECT 'index_tuples' AS collection, a.part, CAST(a.id AS VARCHAR) AS a, CAST(b.id AS VARCHAR) AS b, round(list_cosine_similarity(a.v, b.v), 6) AS s
  FROM vecs a JOIN vecs b ON a.field = 'ap_indexable' AND b.field = 'ap_indexable' AND a.part = b.part AND a.id <> b.id
  UNION ALL
  SELECT 'shot_features', 'shot_features', a.id, b.id, round(list_cosine_similarity(a.v, b.v), 6) FROM
    (SELECT * FROM shot WHERE len(v) = 48 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0) a JOIN
    (SELECT * FROM shot WHERE len(v) = 48 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0) b ON a.id <> b.id
  UNION ALL
  SELECT 'sparse_features', 'sparse_features', CAST(a AS VARCHAR), CAST(b AS VARCHAR), round(dot / (m.n * k.n), 6) FROM
    (SELECT a.ap_id AS a, b.ap_id AS b, sum(a.x * b.x) AS dot FROM cell a JOIN cell b USING (i) WHERE a.ap_id <> b.ap_id GROUP BY 1, 2)
    JOIN norm m ON m.ap_id = a JOIN norm k ON k.ap_id = b)"""

SQL = {
    "p1_found": f"""WITH {_UNIT}
SELECT a.field, a.id AS id_a, b.id AS id_b FROM vecs a JOIN vecs b ON a.field = b.field AND a.part = b.part AND a.id < b.id
WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.9""",
    "p3_found": f"""WITH {_RESULTS},
trusted AS (SELECT DISTINCT query_id, lower(trim(ap_source)) AS ap_source FROM expression_details WHERE confidence > 0 AND NOT isnan(confidence)),
ranked AS (SELECT query_id, ap_source, ap_id, row_number() OVER (PARTITION BY query_id, ap_source ORDER BY cost, ap_id) AS r
  FROM result JOIN trusted USING (query_id, ap_source)),
scans AS (SELECT query_id, count(DISTINCT ap_source) AS k FROM ranked GROUP BY 1)
SELECT query_id, ap_id FROM ranked JOIN scans USING (query_id) WHERE r <= 5 AND k >= 2 GROUP BY query_id, ap_id, k HAVING count(*) = k""",
    "p4_found": f"""WITH {_SIMS},
near AS (SELECT *, row_number() OVER (PARTITION BY collection, a ORDER BY s DESC, b) AS r FROM sims WHERE s >= 0.9),
five AS (SELECT collection, a FROM near GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT DISTINCT collection, least(a, b) AS id_a, greatest(a, b) AS id_b FROM near JOIN five USING (collection, a) WHERE r <= 5""",
    "p4_search": f"""WITH {_SIMS},
number AS (SELECT *, CASE WHEN a LIKE 'sh%' THEN CAST(concat('0x', substr(a, 3)) AS BIGINT) ELSE CAST(a AS BIGINT) END AS n FROM sims WHERE s >= 0.9)
SELECT collection, part, a AS id, b AS other, s AS similarity, row_number() OVER (PARTITION BY collection, part, a ORDER BY s DESC, b) AS place
FROM number WHERE n % 50 = 0 QUALIFY place <= 5""",
    "p5_found": f"""WITH {_RESULTS}
SELECT query_id, ap_source, ap_id FROM result QUALIFY row_number() OVER (PARTITION BY query_id, ap_source ORDER BY cost, ap_id) <= 3""",
}
QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters, "p3_found": p3_found, "p3_ranking": p3_ranking, "p4_found": p4_found, "p4_lists": p4_lists, "p4_search": p4_search, "p4_recall": p4_recall, "p5_found": p5_found, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_draws": p8_draws, "p8_mix": p8_mix, "p9_found": p9_found, "p9_corpus": p9_corpus}
