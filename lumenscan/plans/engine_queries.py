"""Named queries for the operators of the engine, over the given tables.

The query vector is the one of the smallest id; distances are rounded to six
decimals on both sides and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan import model as M
from lumenscan.engine import Engine
from lumenscan.functions import distance as D
from lumenscan.operators import basic, indexes, random_data, textsearch
from lumenscan.plans import planner
from lumenscan.runtime import materialise, table
from lumenscan.sources import importers
from lumenscan.types import Attribute, EngineError

K = 25
DIMS = 64
WEIGHTS = tuple(round(0.05 * (i % 7), 2) for i in range(DIMS))
_W = "[" + ", ".join(map(str, WEIGHTS)) + "]::DOUBLE[]"


def _emb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("ap_id"), "embedding", "label")


def _q(df: DataFrame) -> tuple[float, ...]:
    return tuple(float(x) for x in df.orderBy("ap_id").limit(1).first()["embedding"])


def _ranking(df: DataFrame, k: int = K, distance: str = "euclidean", weights: tuple | None = None, **options) -> M.Ranking:
    return M.Ranking("embedding", _q(df), k, distance, weights, tuple(sorted(options.items())))


def _listed(df: DataFrame) -> DataFrame:
    return df.select("ap_id", F.col("ap_distance").cast("double").alias("ap_distance"))


def _exact(distance: str, weights: tuple | None = None, **options) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = _emb(spark, sf)
        return _listed(basic.nearest(e, _ranking(e, K, distance, weights, **options), rounded=6))

    return run


_BASE = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS a FROM e ORDER BY vec_id LIMIT 1)"


def _sum(term: str, a: str = "a", v: str = "v") -> str:
    """Sum over dimensions of a term in x (query), y (row) and w."""
    return f"list_sum(list_transform(list_zip({a}, {v}, {_W}), lambda z: {term.replace('x', 'z[1]').replace('y', 'z[2]').replace('#', 'z[3]')}))"


def _max(term: str, f: str = "list_max") -> str:
    return f"{f}(list_transform(list_zip(a, v, {_W}), lambda z: {term.replace('x', 'z[1]').replace('y', 'z[2]').replace('#', 'z[3]')}))"


def _top(d: str, k: int = K, condition: str = "TRUE") -> str:
    return f"WITH {_BASE} SELECT vec_id AS ap_id, round({d}, 6) + 0.0 AS ap_distance FROM e, q WHERE {condition} ORDER BY round({d}, 6), vec_id LIMIT {k}"


_DOT, _AA, _BB = _sum("(x * y)"), _sum("(x * x)"), _sum("(y * y)")
_SA, _SB = "list_sum(a)", "list_sum(v)"
_COR = f"1 - ({_DOT} - {_SA} * {_SB} / 64) / (sqrt({_AA} - {_SA} * {_SA} / 64) * sqrt({_BB} - {_SB} * {_SB} / 64))"
_EUCLID = f"sqrt({_sum('((x - y) * (x - y))')})"

_DISTANCES: dict[str, tuple[str, tuple | None, dict, str]] = {
    "manhattan": ("manhattan", None, {}, _sum("abs(x - y)")),
    "euclidean": ("euclidean", None, {}, _EUCLID),
    "squaredeuclidean": ("squaredeuclidean", None, {}, _sum("((x - y) * (x - y))")),
    "minkowski": ("minkowski", None, {"norm": 3.0}, f"pow({_sum('pow(abs(x - y), 3)')}, 1 / 3.0)"),
    "chebyshev": ("chebyshev", None, {}, _max("abs(x - y)")),
    "chisquared": ("chisquared", None, {}, _sum("CASE WHEN x + y > 0 THEN (x - y) * (x - y) / (x + y) ELSE 0 END")),
    "cosine": ("cosine", None, {}, f"1 - {_DOT} / (sqrt({_AA}) * sqrt({_BB}))"),
    "correlation": ("correlation", None, {}, _COR),
    "hamming": ("hamming", None, {}, _sum("CASE WHEN abs(x - y) > 1e-5 THEN 1.0::DOUBLE ELSE 0.0 END")),
    "spannorm": ("spannorm", None, {}, f"{_max('(x - y)')} - {_max('(x - y)', 'list_min')}"),
    "modulo": ("modulo", None, {}, _sum("(y % x)")),
    "weighted_manhattan": ("manhattan", WEIGHTS, {}, _sum("(# * abs(x - y))")),
    "weighted_euclidean": ("euclidean", WEIGHTS, {}, f"sqrt({_sum('(# * (x - y) * (x - y))')})"),
    "weighted_squaredeuclidean": ("squaredeuclidean", WEIGHTS, {}, _sum("(# * (x - y) * (x - y))")),
    "weighted_minkowski": ("minkowski", WEIGHTS, {"norm": 3.0}, f"pow({_sum('(# * pow(abs(x - y), 3))')}, 1 / 3.0)"),
    "weighted_chebyshev": ("chebyshev", WEIGHTS, {}, _max("abs(# * (x - y))")),
    "weighted_chisquared": ("chisquared", WEIGHTS, {}, _sum("CASE WHEN x + y > 0 THEN # * (x - y) * (x - y) / (x + y) ELSE 0 END")),
    "weighted_hamming": ("hamming", WEIGHTS, {}, _sum("CASE WHEN abs(x - y) > 1e-5 THEN # ELSE 0.0 END")),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

for _name, (_d, _w, _o, _sql) in _DISTANCES.items():
    QUERIES[f"knn_{_name}"] = _exact(_d, _w, **_o)
    SQL[f"knn_{_name}"] = _top(_sql)


def _add(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Non-negative vectors for the distances made for histograms.
_POS = "e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda z: abs(z)) AS v FROM embeddings), q AS (SELECT v AS a FROM e ORDER BY vec_id LIMIT 1)"


def _positive(distance: str) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = _emb(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: F.abs(x.cast("double"))))
        return _listed(basic.nearest(e, _ranking(e, K, distance), rounded=6))

    return run


_JACCARD = f"1 - {_sum('least(x, y)')} / {_sum('greatest(x, y)')}"
_KL = _sum("CASE WHEN abs(x) < 1e-5 OR abs(y) < 1e-5 THEN 0 ELSE x * ln(x / y) END").replace("ez[1]p", "exp")
for _name, _sql in (("jaccard", _JACCARD), ("kullbackleibler", _KL)):
    QUERIES[f"knn_{_name}"] = _positive(_name)
    SQL[f"knn_{_name}"] = f"WITH {_POS} SELECT vec_id AS ap_id, round({_sql}, 6) AS ap_distance FROM e, q ORDER BY round({_sql}, 6), vec_id LIMIT {K}"


@_add(
    "WITH p AS (SELECT c_custkey AS ap_id, c_custkey % 180 - 90.0 AS lat, (c_custkey * 7) % 360 - 180.0 AS lng FROM customer), "
    "h AS (SELECT ap_id, pow(sin(radians(lat - 47.5) / 2), 2) + cos(radians(47.5)) * cos(radians(lat)) * pow(sin(radians(lng - 7.6) / 2), 2) AS h FROM p) "
    "SELECT ap_id, round(2 * 6371000 * asin(sqrt(least(h, 1.0))), 3) AS ap_distance FROM h ORDER BY 2, 1 LIMIT 25"
)
def knn_haversine(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    p = table(spark, sf, "customer").select(c.alias("ap_id"), F.array((c % 180 - 90.0).cast("double"), ((c * 7) % 360 - 180.0).cast("double")).alias("embedding"))
    return _listed(basic.nearest(p, M.Ranking("embedding", (47.5, 7.6), K, "haversine"), rounded=3))


_SPARSE = """s AS (SELECT DISTINCT ap_id, list_sort(list_filter(list_zip(feature.index, feature.data), lambda p: p[2] <> 0)) AS p FROM sparse_features
  WHERE len(feature.index) = len(feature.data) AND len(list_filter(feature.data, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(feature.index, lambda i: i < 0 OR i >= feature.length)) = 0 AND len(list_filter(feature.data, lambda x: x <> 0)) > 0),
c AS (SELECT ap_id, e[1] AS i, CAST(e[2] AS DOUBLE) AS x FROM (SELECT ap_id, unnest(p) AS e FROM s)),
q AS (SELECT i, x FROM c WHERE ap_id = (SELECT min(ap_id) FROM s)), n AS (SELECT ap_id, sqrt(sum(x * x)) AS n FROM c GROUP BY 1),
d AS (SELECT c.ap_id, sum(c.x * q.x) AS dot FROM c JOIN q USING (i) GROUP BY 1)"""


@_add(
    f"WITH {_SPARSE} SELECT n.ap_id, round(1 - coalesce(dot, 0) / (n.n * (SELECT sqrt(sum(x * x)) FROM q)), 6) AS ap_distance "
    f"FROM n LEFT JOIN d USING (ap_id) ORDER BY 2, 1 LIMIT {K}"
)
def knn_sparse_cosine(spark: SparkSession, sf: str) -> DataFrame:
    f = F.col("feature")
    bad = F.exists(f.data, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.exists(f.index, lambda i: (i < 0) | (i >= f.length))
    t = table(spark, sf, "sparse_features").filter((F.size(f.index) == F.size(f.data)) & ~bad & F.exists(f.data, lambda x: x != 0)).select("ap_id", "feature").dropDuplicates(["ap_id"])
    first = t.orderBy("ap_id").limit(1).first()["feature"]
    q = F.struct(F.array(*[F.lit(i) for i in first["index"]]).alias("index"), F.array(*[F.lit(x).cast("float") for x in first["data"]]).alias("data"), F.lit(first["length"]).alias("length"))
    return t.select("ap_id", F.round(D.sparse_cosine(q, f), 6).alias("ap_distance")).orderBy("ap_distance", "ap_id").limit(K)


_SPARSE_TERMS = {
    "manhattan": "sum(abs(x - qx))", "euclidean": "sqrt(sum((x - qx) * (x - qx)))", "chebyshev": "max(abs(x - qx))", "minkowski": "pow(sum(pow(abs(x - qx), 3)), 1 / 3.0)",
    "hamming": "sum(CASE WHEN abs(x - qx) > 1e-5 THEN 1.0::DOUBLE ELSE 0.0 END)", "chisquared": "sum(CASE WHEN x + qx > 0 THEN (x - qx) * (x - qx) / (x + qx) ELSE 0 END)",
    "spannorm": "greatest(max(qx - x), 0) - least(min(qx - x), 0)",
}


def _sparse_ranked(distance: str) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        f = F.col("feature")
        bad = F.exists(f.data, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.exists(f.index, lambda i: (i < 0) | (i >= f.length))
        t = table(spark, sf, "sparse_features").filter((F.size(f.index) == F.size(f.data)) & ~bad & F.exists(f.data, lambda x: x != 0)).select("ap_id", "feature").dropDuplicates(["ap_id"])
        first = t.orderBy("ap_id").limit(1).first()["feature"]
        q = [0.0] * first["length"]
        for i, x in zip(first["index"], first["data"]):
            q[i] = float(x)
        r = M.Ranking("feature", tuple(q), K, distance, None, (("norm", 3.0),) if distance == "minkowski" else ())
        return _listed(basic.nearest(t, r, rounded=6))

    return run


for _name, _sql in _SPARSE_TERMS.items():
    QUERIES[f"knn_sparse_{_name}"] = _sparse_ranked(_name)
    SQL[f"knn_sparse_{_name}"] = (
        f"WITH {_SPARSE}, p AS (SELECT s.ap_id, q.i, q.x AS qx FROM s CROSS JOIN q), "
        "pair AS (SELECT ap_id, coalesce(c.x, 0) AS x, coalesce(qx, 0) AS qx FROM c FULL JOIN p USING (ap_id, i)) "
        f"SELECT ap_id, round({_sql}, 6) + 0.0 AS ap_distance FROM pair GROUP BY 1 ORDER BY 2, 1 LIMIT {K}"
    )


_WHERE = (M.Predicate("label", "=", (1, 3, 5)), M.Predicate("ap_id", ">", (40,)))
_WHERE_SQL = "label IN (1, 3, 5) AND vec_id > 40"


@_add(_top(_EUCLID, K, _WHERE_SQL))
def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    e = _emb(spark, sf)
    return _listed(basic.nearest(basic.where(e, _WHERE), _ranking(e), rounded=6))


@_add(f"SELECT vec_id AS ap_id, label FROM embeddings WHERE {_WHERE_SQL}")
def filter_boolean(spark: SparkSession, sf: str) -> DataFrame:
    return basic.where(_emb(spark, sf), _WHERE).select("ap_id", "label")


@_add("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_name LIKE '%1' AND c_acctbal <= 5000 AND regexp_matches(c_name, '[0-9]+')")
def filter_operators(spark: SparkSession, sf: str) -> DataFrame:
    p = [M.Predicate("c_mktsegment", "!=", ("BUILDING", "MACHINERY")), M.Predicate("c_name", "like", ("%1",)), M.Predicate("c_acctbal", "<=", (5000,)), M.Predicate("c_name", "rlike", ("[0-9]+",))]
    return basic.where(table(spark, sf, "customer"), p).select("c_custkey", "c_name")


def _prefiltered(method: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = _emb(spark, sf)
        return _listed(basic.nearest(basic.within(e, basic.where(e, _WHERE), method), _ranking(e), rounded=6))

    QUERIES[f"prefilter_{method}"] = run
    SQL[f"prefilter_{method}"] = _top(_EUCLID, K, _WHERE_SQL)


for _m in ("semijoin", "inlist", "bloom"):
    _prefiltered(_m)


@_add(_top(_EUCLID, K, _WHERE_SQL))
def prefilter_pushdown(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of the filter go into a fresh read of the entity."""
    q = M.Scan("emb", (), _ranking(_emb(spark, sf)), M.Scan("emb", _WHERE), "pushdown")
    return _rounded(_engine(spark, sf).query(q))


@_add(_top(_EUCLID, K, "label >= 1"))
def prefilter_of_most_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of more than half of the rows: the configured way gives way to a semi-join."""
    q = M.Scan("emb", (), _ranking(_emb(spark, sf)), M.Scan("emb", (M.Predicate("label", ">=", (1,)),)), "inlist")
    return _rounded(_engine(spark, sf).query(q))


@_add(
    f"WITH {_BASE} SELECT e.vec_id AS ap_id, o.vec_id AS query_id, round({_sum('((x - y) * (x - y))', 'o.v', 'e.v')}, 6) AS ap_distance FROM e, e o WHERE o.vec_id % 50 = 0 "
    f"QUALIFY row_number() OVER (PARTITION BY o.vec_id ORDER BY round({_sum('((x - y) * (x - y))', 'o.v', 'e.v')}, 6), e.vec_id) <= 10"
)
def knn_batch(spark: SparkSession, sf: str) -> DataFrame:
    e = _emb(spark, sf)
    queries = e.filter("ap_id % 50 = 0").select(F.col("ap_id").alias("query_id"), F.col("embedding").alias("qv"))
    return basic.batch_nearest(queries, e, M.Ranking("embedding", (), 10, "squaredeuclidean"), "query_id", "qv", rounded=6)


# ---- set and fuzzy combination: neighbours of the first vector by two distances ----


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = _emb(spark, sf)
    return _listed(basic.nearest(e, _ranking(e, 40), rounded=6)), _listed(basic.nearest(e, _ranking(e, 40, "chebyshev"), rounded=6))


_TWO = f"WITH l AS ({_top(_EUCLID, 40)}), r AS ({_top(_max('abs(x - y)'), 40)})"


@_add(f"{_TWO} SELECT ap_id, 0.0::DOUBLE AS ap_distance FROM (SELECT ap_id FROM l UNION ALL SELECT ap_id FROM r)")
def set_union(spark: SparkSession, sf: str) -> DataFrame:
    return basic.union(*_two(spark, sf))


@_add(f"{_TWO} SELECT ap_id, 0.0::DOUBLE AS ap_distance FROM (SELECT ap_id FROM l INTERSECT SELECT ap_id FROM r)")
def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return basic.intersect(*_two(spark, sf))


@_add(f"{_TWO} SELECT ap_id, 0.0::DOUBLE AS ap_distance FROM (SELECT ap_id FROM l EXCEPT SELECT ap_id FROM r)")
def set_except(spark: SparkSession, sf: str) -> DataFrame:
    return basic.minus(*_two(spark, sf))


@_add(f"{_TWO} SELECT r.ap_id, r.ap_distance FROM r SEMI JOIN l USING (ap_id)")
def set_left_first(spark: SparkSession, sf: str) -> DataFrame:
    return basic.sequenced("intersect", *_two(spark, sf))


@_add(f"{_TWO} SELECT l.ap_id, l.ap_distance FROM l ANTI JOIN r USING (ap_id)")
def set_except_left_first(spark: SparkSession, sf: str) -> DataFrame:
    return basic.sequenced("except", *_two(spark, sf))


@_add(
    f"{_TWO} SELECT ap_id, least(coalesce(l.ap_distance, 0), coalesce(r.ap_distance, 0)) AS ap_distance, "
    "CASE WHEN l.ap_distance IS NULL THEN 'x FUZZYUNION chebyshev' WHEN r.ap_distance IS NULL THEN 'euclidean FUZZYUNION x' ELSE 'euclidean FUZZYUNION chebyshev' END AS ap_source "
    "FROM l FULL JOIN r USING (ap_id)"
)
def fuzzy_union(spark: SparkSession, sf: str) -> DataFrame:
    return basic.fuzzy(*_two(spark, sf), "union", source=("euclidean", "chebyshev"))


@_add(f"{_TWO} SELECT ap_id, greatest(coalesce(l.ap_distance, 1), coalesce(r.ap_distance, 1)) AS ap_distance FROM l FULL JOIN r USING (ap_id)")
def fuzzy_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return basic.fuzzy(*_two(spark, sf), "intersect", default=1.0)


@_add(f"{_TWO}, u AS (SELECT ap_id FROM l UNION ALL SELECT ap_id FROM r) SELECT ap_id, 1 - count(*) / 2.0::DOUBLE AS ap_distance FROM u GROUP BY 1")
def stochastic_votes(spark: SparkSession, sf: str) -> DataFrame:
    return basic.vote(_two(spark, sf))


# ---- projection ----


@_add("SELECT count(*) AS count FROM embeddings WHERE label = 2")
def project_count(spark: SparkSession, sf: str) -> DataFrame:
    return basic.project(basic.where(_emb(spark, sf), [M.Predicate("label", "=", (2,))]), op="count")


@_add('SELECT count(*) > 0 AS "exists" FROM embeddings WHERE label = 99')
def project_exists(spark: SparkSession, sf: str) -> DataFrame:
    return basic.project(basic.where(_emb(spark, sf), [M.Predicate("label", "=", (99,))]), op="exists")


@_add("SELECT DISTINCT label FROM embeddings")
def project_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return basic.project(_emb(spark, sf), ("label",), "distinct")


# ---- indexes ----


def _indexed(kind: str, **options) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = _emb(spark, sf)
        ix = indexes.build(kind, e, "embedding", "euclidean", **options)
        r = _ranking(e, K, timesK=10)
        found = indexes.candidates(ix, r)
        return _listed(basic.nearest(basic.within(e, found), r, rounded=6))

    return run


for _kind in indexes.KINDS:
    QUERIES[f"index_{_kind}"] = _indexed(_kind)
for _kind in ("vaf", "vav", "vap"):
    SQL[f"index_{_kind}"] = _top(_EUCLID)
QUERIES["index_vaf_equidistant"], SQL["index_vaf_equidistant"] = _indexed("vaf", marktype="equidistant"), _top(_EUCLID)


def _recall(kind: str, distance: str, times: int, **options) -> Callable:
    """Whether the index finds nine of ten true neighbours (k = 10) of ten vectors, looking at `times` times k rows.

    The vectors are all but random in 64 dimensions, so the lossy kinds must look at many.
    """

    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = _emb(spark, sf)
        ix = indexes.build(kind, e, "embedding", distance, **options)
        ix.data = materialise(ix.data, "signatures")
        asked = e.filter("ap_id % 10 = 0").orderBy("ap_id").limit(10).collect()
        found = hit = None
        for r in asked:
            ranking = M.Ranking("embedding", tuple(float(x) for x in r["embedding"]), 10, distance, None, (("timesK", times),))
            truth = basic.nearest(e, ranking).select("ap_id")
            got = basic.nearest(basic.within(e, indexes.candidates(ix, ranking)), ranking).select("ap_id")
            hit = truth.join(got, "ap_id", "left_semi").select(F.lit(1).alias("one")) if hit is None else hit.unionAll(truth.join(got, "ap_id", "left_semi").select(F.lit(1).alias("one")))
            found = len(asked) * 10
        return hit.agg((F.count("one") >= F.lit(0.9 * found)).alias("recall_is_enough"))

    return run


for _kind, _d, _times, _o in (("pq", "euclidean", 10, {}), ("sh", "euclidean", 25, {}), ("lsh", "euclidean", 0, {"width": 0.9}), ("ecp", "cosine", 40, {}), ("mi", "euclidean", 25, {})):
    QUERIES[f"index_{_kind}_recall"], SQL[f"index_{_kind}_recall"] = _recall(_kind, _d, _times, **_o), "SELECT TRUE AS recall_is_enough"


@_add("SELECT count(*) AS clustered, TRUE AS sizes_agree, TRUE AS leaders_are_means FROM embeddings")
def index_ecp_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Every row in one cluster; the sizes kept with the index are those of the rows, and leaders are the means of their rows."""
    e = _emb(spark, sf)
    ix = indexes.build("ecp", e, "embedding", "cosine", leadertype="centroid")
    rows = ix.data.select("ap_id", F.get("sig", 0).alias("c")).join(e, "ap_id")
    leaders = [(i, int(n), float(m[0]), float(m[-1])) for i, (n, m) in enumerate(zip(ix.meta["counts"], ix.meta["leaders"])) if n]
    kept = spark.createDataFrame(leaders, "c int, size long, first double, last double")
    real = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.avg(F.get("embedding", 0)).alias("a"), F.avg(F.element_at("embedding", -1)).alias("z"))
    near = (F.abs(F.col("a") - F.col("first")) < 1e-6) & (F.abs(F.col("z") - F.col("last")) < 1e-6)
    both = real.join(kept, "c", "full_outer")
    return both.agg(F.sum("n").alias("clustered"), F.min(F.coalesce(F.col("n") == F.col("size"), F.lit(False))).alias("sizes_agree"), F.min(F.coalesce(near, F.lit(False))).alias("leaders_are_means"))


# ---- messages, planner ----


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("ap_id", F.round("ap_distance", 6).alias("ap_distance"))


def _engine(spark: SparkSession, sf: str) -> Engine:
    e = Engine(spark)
    e.attach("emb", table(spark, sf, "embeddings"), "vec_id")
    return e


@_add(_top(_EUCLID, 10, _WHERE_SQL.replace("vec_id", "vec_id")))
def message_query(spark: SparkSession, sf: str) -> DataFrame:
    e = _engine(spark, sf)
    q = {
        "from": {"entity": "emb"},
        "where": [{"attribute": "label", "values": [1, 3, 5]}, {"attribute": "vec_id", "op": ">", "value": 40}],
        "using": {"attribute": "embedding", "query": list(_q(_emb(spark, sf))), "k": 10, "distance": "euclidean"},
    }
    return e.query(q).select("ap_id", F.round("ap_distance", 6).alias("ap_distance"))


@_add(_top(_EUCLID))
def hint_exact(spark: SparkSession, sf: str) -> DataFrame:
    e = _engine(spark, sf)
    e.create_index("emb", "embedding", "vaf")
    return e.knn("emb", _ranking(_emb(spark, sf)), hint="exact").select("ap_id", F.round("ap_distance", 6).alias("ap_distance"))


@_add(_top(_EUCLID))
def stochastic_scan(spark: SparkSession, sf: str) -> DataFrame:
    e = _engine(spark, sf)
    names = [e.create_index("emb", "embedding", k) for k in ("vaf", "vav")]
    return e.query(M.StochasticScan(tuple(names), _ranking(_emb(spark, sf)))).select("ap_id", F.round("ap_distance", 6).alias("ap_distance"))


@_add(_top(_EUCLID))
def parallel_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The last, best result of paths that run side by side."""
    e = _engine(spark, sf)
    e.create_index("emb", "embedding", "ecp")
    *_, (_, best) = e.knn_parallel("emb", _ranking(_emb(spark, sf)))
    return best.select("ap_id", F.round("ap_distance", 6).alias("ap_distance"))


@_add("SELECT 3 AS paths, TRUE AS positive, TRUE AS best_first")
def planner_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The planner is trained on every path; all get a score, and the ranking of paths follows it."""
    e = _engine(spark, sf)
    e.create_index("emb", "embedding", "vaf")
    e.create_index("emb", "embedding", "ecp")
    r = _ranking(_emb(spark, sf))
    trained = e.train_planner("emb", "embedding", 2, 10, "svm", 1)
    order = [s for _, s in e.score_paths("emb", r)]
    return spark.createDataFrame([(len(trained), all(s > 0 for s in trained.values()), order == sorted(order, reverse=True))], "paths int, positive boolean, best_first boolean")


# ---- queries through the engine: trees, caches, times, pages, parts ----


@_add(f"WITH {_BASE}, u AS (SELECT vec_id FROM e WHERE label = 1 UNION SELECT vec_id FROM e WHERE label = 2) SELECT vec_id AS ap_id, round({_EUCLID}, 6) AS ap_distance FROM e SEMI JOIN u USING (vec_id), q WHERE vec_id > 40 ORDER BY round({_EUCLID}, 6), vec_id LIMIT 10")
def compound_query(spark: SparkSession, sf: str) -> DataFrame:
    """Filter and rank the union of two filters."""
    side = lambda v: M.Scan("emb", (M.Predicate("label", "=", (v,)),))
    q = M.SubQuery(M.Combine("union", side(1), side(2)), (M.Predicate("vec_id", ">", (40,)),), _ranking(_emb(spark, sf), 10))
    return _rounded(_engine(spark, sf).query(q))


@_add(f"WITH l AS ({_top(_EUCLID, 40)}) SELECT ap_id FROM l JOIN embeddings ON vec_id = ap_id WHERE label = 3")
def filter_of_a_result(spark: SparkSession, sf: str) -> DataFrame:
    """Predicates on attributes of a result that is there already."""
    q = M.SubQuery(M.Project(M.Scan("emb", (), _ranking(_emb(spark, sf), 40)), ("ap_id", "ap_distance")), (M.Predicate("label", "=", (3,)),))
    return _engine(spark, sf).query(q).select("ap_id")


@_add(f"{_TWO} SELECT ap_id FROM l JOIN r USING (ap_id)")
def combine_join(spark: SparkSession, sf: str) -> DataFrame:
    e = _emb(spark, sf)
    q = M.Combine("join", M.Scan("emb", (), _ranking(e, 40)), M.Scan("emb", (), _ranking(e, 40, "chebyshev")))
    return _engine(spark, sf).query(q).select("ap_id")


@_add(
    f"{_TWO} SELECT ap_id, CASE WHEN l.ap_distance IS NULL THEN 'x FUZZYUNION sequential scan' WHEN r.ap_distance IS NULL THEN 'sequential scan FUZZYUNION x' "
    "ELSE 'sequential scan FUZZYUNION sequential scan' END AS ap_source FROM l FULL JOIN r USING (ap_id) UNION ALL SELECT ap_id, 'sequential scan->sequential scan' FROM l JOIN r USING (ap_id)"
)
def sources_of_results(spark: SparkSession, sf: str) -> DataFrame:
    """ap_source of a fuzzy combination and of one that goes from left to right."""
    e, engine = _emb(spark, sf), _engine(spark, sf)
    a, b = M.Scan("emb", (), _ranking(e, 40)), M.Scan("emb", (), _ranking(e, 40, "chebyshev"))
    found = [engine.query(M.Combine(how, a, b, order), ("source",)).select("ap_id", "ap_source") for how, order in (("fuzzyunion", "parallel"), ("intersect", "left"))]
    return found[0].union(found[1])


@_add(_top(_EUCLID))
def timed_query(spark: SparkSession, sf: str) -> DataFrame:
    """Alternatives side by side: an exact one of full confidence ends the race."""
    e, r = _engine(spark, sf), _ranking(_emb(spark, sf))
    ix = e.create_index("emb", "embedding", "vaf")
    return _rounded(e.query(M.Timed((M.Scan("emb", (), r), M.IndexScan(ix, r)), 300.0)))


@_add(_top(_EUCLID))
def timed_paths_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    e = _engine(spark, sf)
    e.create_index("emb", "embedding", "vav")
    return _rounded(e.knn_timed("emb", _ranking(_emb(spark, sf)), 300.0, chooser="kinds", hints=("vav",)))


@_add(_top(_EUCLID))
def cached_query(spark: SparkSession, sf: str) -> DataFrame:
    """The second run of a query takes the kept result, also when the entity is gone."""
    e = _engine(spark, sf)
    q = M.Cached(M.Scan("emb", (), _ranking(_emb(spark, sf))), id="kept")
    e.query(q).count()
    e.drop_entity("emb")
    return _rounded(e.query(q))


@_add(_top(_EUCLID, 5))
def empty_side(spark: SparkSession, sf: str) -> DataFrame:
    """A union with a query that gives nothing, ranked again."""
    e, r = _emb(spark, sf), _ranking(_emb(spark, sf), 5)
    return _rounded(_engine(spark, sf).query(M.SubQuery(M.Combine("union", M.Scan("emb", (), r), M.Empty()), (), r)))


@_add("SELECT count(*) AS n, ceil(count(*) / 90.0)::INT AS pages FROM embeddings")
def paged_rows(spark: SparkSession, sf: str) -> DataFrame:
    sizes = [len(p) for p in _engine(spark, sf).iter_pages(M.Scan("emb"), 90, None)]
    return spark.createDataFrame([(sum(sizes), len(sizes))], "n long, pages int")


@_add(" UNION ALL ".join(f"(SELECT {i} AS query, count(*) AS n, min(vec_id) AS first FROM embeddings WHERE label = {i})" for i in range(4)))
def batch_of_queries(spark: SparkSession, sf: str) -> DataFrame:
    found = _engine(spark, sf).batch([M.Scan("emb", (M.Predicate("label", "=", (i,)),)) for i in range(4)])
    parts = [df.agg(F.lit(i).alias("query"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first")) for i, df in enumerate(found)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@_add("SELECT * FROM (VALUES (1, 'Scan'), (2, 'Scan'), (3, 'Combine'), (4, 'SubQuery')) t(step, kind) CROSS JOIN (SELECT count(*) AS n FROM embeddings WHERE label IN (1, 2)) c WHERE step >= 3")
def progressive_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The steps of a query as they become ready, the last two with their rows."""
    side = lambda v: M.Scan("emb", (M.Predicate("label", "=", (v,)),))
    q = M.SubQuery(M.Combine("union", side(1), side(2)))
    steps = [(i, type(n).__name__, df.count()) for i, (n, df) in enumerate(_engine(spark, sf).progressive(q), 1)]
    return spark.createDataFrame([s for s in steps if s[0] >= 3], "step int, kind string, n long")


@_add("SELECT 4 AS parts, TRUE AS all_there, TRUE AS only_asked, TRUE AS agree")
def partition_restriction(spark: SparkSession, sf: str) -> DataFrame:
    """An index laid out in four parts; a ranking of two parts gives what an exact ranking of their rows gives."""
    e, engine = _emb(spark, sf), _engine(spark, sf)
    name = engine.repartition_index(engine.create_index("emb", "embedding", "vaf"), 4, "hash")
    data = engine.index(name).data
    r = M.Ranking("embedding", _q(e), K, partitions=frozenset({0, 2}))
    got = engine.query(M.IndexScan(name, r)).select("ap_id")
    rows = e.join(data.filter("part IN (0, 2)").select("ap_id"), "ap_id", "left_semi")
    want = basic.nearest(rows, _ranking(e)).select("ap_id")
    asked = got.join(data, "ap_id").agg(F.min(F.col("part").isin(0, 2)).alias("only_asked"))
    same = got.exceptAll(want).unionAll(want.exceptAll(got)).agg((F.count(F.lit(1)) == 0).alias("agree"))
    return data.agg(F.countDistinct("part").cast("int").alias("parts"), (F.count(F.lit(1)) == e.count()).alias("all_there")).crossJoin(asked).crossJoin(same)


@_add("SELECT 2 AS kept, TRUE AS inside")
def partition_skipping(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the parts of a clustered index may be left out: those far from the query are."""
    e, engine = _emb(spark, sf), _engine(spark, sf)
    name = engine.repartition_index(engine.create_index("emb", "embedding", "ecp"), 4, "ecp")
    r = _ranking(e, K, skipPart=0.5)
    kept = engine.choose_partitions(name, r, 0.5)
    got = engine.query(M.IndexScan(name, r)).join(engine.index(name).data, "ap_id")
    return got.agg(F.lit(len(kept)).alias("kept"), F.min(F.col("part").isin(sorted(kept))).alias("inside"))


@_add("SELECT kind, TRUE AS there, count(*) AS n FROM embeddings CROSS JOIN (VALUES ('ecp'), ('lsh'), ('mi'), ('pq'), ('sh'), ('vaf'), ('vap'), ('vav')) t(kind) GROUP BY 1")
def indexes_of_every_kind(spark: SparkSession, sf: str) -> DataFrame:
    """One index of every kind, what the catalog says of each, and how many rows it holds."""
    e = _engine(spark, sf)
    made = e.create_all_indexes("emb", "embedding")
    rows = [(k, e.index_exists("emb", "embedding", k), sum(e.index_properties(n)["tuples"].values())) for n, _, k in e.list_indexes("emb") if n in made]
    return spark.createDataFrame(rows, "kind string, there boolean, n long")


@_add("SELECT 'doc' AS handler, count(*) AS n FROM documents WHERE contains(lower(text), 'turbine') AND list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'turbine')")
def external_text(spark: SparkSession, sf: str) -> DataFrame:
    """A text search as a query operator, all hits."""
    e = Engine(spark)
    e.attach("doc", table(spark, sf, "documents"), "doc_id")
    found = e.query(M.External("text", "doc", (("attribute", "text"), ("query", "turbine"), ("limit", 0))))
    return found.agg(F.lit("doc").alias("handler"), F.count(F.lit(1)).alias("n"))


# ---- data definition and change ----


@_add("SELECT c_custkey AS tid, c_name AS name FROM customer WHERE NOT (c_custkey < 100 OR c_mktsegment = 'BUILDING')")
def entity_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Insert, delete rows for which any predicate holds, vacuum, read back."""
    e = Engine(spark)
    e.create_entity("cust", [Attribute("tid", "long"), Attribute("name", "string", "orc"), Attribute("segment", "string")])
    e.insert("cust", table(spark, sf, "customer").select(F.col("c_custkey").alias("tid"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))
    e.delete("cust", [M.Predicate("tid", "<", (100,)), M.Predicate("segment", "=", ("BUILDING",))])
    e.vacuum("cust")
    return e.table("cust").select("tid", "name")


@_add("SELECT vec_id AS tid, len(list_filter(embedding, lambda x: abs(x) > 1e-10)) AS stored FROM embeddings")
def entity_sparsify(spark: SparkSession, sf: str) -> DataFrame:
    e = Engine(spark)
    e.create_entity("emb", [Attribute("tid", "long"), Attribute("v", "vector")])
    e.insert("emb", table(spark, sf, "embeddings").select(F.col("vec_id").alias("tid"), F.col("embedding").alias("v")))
    e.sparsify("emb", "v")
    return e.table("emb").select("tid", F.size("v.index").cast("long").alias("stored"))


@_add("SELECT count(*) AS n, count(DISTINCT event_id) AS events FROM events")
def stream_insert_events(spark: SparkSession, sf: str) -> DataFrame:
    """Inserts the events as a stream and reads the entity."""
    from lumenscan.runtime import scratch_path
    from lumenscan.streaming.ingest import stream_insert

    e = Engine(spark)
    e.create_entity("ev", [Attribute("event_id", "long"), Attribute("event_type", "string"), Attribute("value", "double")])
    path = f"{sf}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*").select("event_id", "event_type", "value")
    stream_insert(e, "ev", stream, scratch_path(spark, "stream")).awaitTermination()
    return e.table("ev").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("events"))


@_add("SELECT 1000 AS n, 1000 AS ids, 16 AS width, TRUE AS in_range, 0 AS changed")
def random_tuples(spark: SparkSession, sf: str) -> DataFrame:
    """Generated rows: their ids, widths and ranges; the same seed gives the same rows."""
    a = [Attribute("v", "vector"), Attribute("s", "string"), Attribute("x", "double")]
    first, second = (random_data.generate(spark, a, 1000, 3, **{"fv-dimensions": 16}) for _ in range(2))
    df = basic.tuple_ids(first, 1)
    known = ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & F.col("s").isNotNull() & F.col("x").isNotNull()
    one = df.agg(F.count(F.lit(1)).cast("int").alias("n"), F.countDistinct("ap_id").cast("int").alias("ids"), F.max(F.size("v")).alias("width"), F.min(known).alias("in_range"))
    return one.crossJoin(first.exceptAll(second).agg(F.count(F.lit(1)).cast("int").alias("changed")))


@_add("SELECT count(*) AS n, 100 AS shown, 50 AS sampled, TRUE AS same_sample FROM embeddings")
def entity_looks(spark: SparkSession, sf: str) -> DataFrame:
    """Count, preview and a sample of an entity; the sample is the same each time."""
    e = _engine(spark, sf)
    draws = [{r[0] for r in basic.sample_rows(e.table("emb").select("ap_id"), 50).collect()} for _ in range(2)]
    return spark.createDataFrame([(e.count("emb"), e.preview("emb").count(), len(draws[0]), draws[0] == draws[1])], "n long, shown int, sampled int, same_sample boolean")


@_add("SELECT count(*) AS n, 4 AS refused FROM customer")
def entity_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that break a key or a unique attribute are refused whole."""
    e = Engine(spark)
    e.create_entity("cust", [Attribute("pkfield", "long", params={"pk": True}), Attribute("uniquefield", "string", params={"unique": True}), Attribute("indexedfield", "double", params={"indexed": True})])
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("pkfield"), F.col("c_name").alias("uniquefield"), F.col("c_acctbal").alias("indexedfield"))
    e.insert("cust", c)
    refused = 0
    fresh = c.withColumn("pkfield", F.col("pkfield") + 10_000_000).withColumn("uniquefield", F.concat("uniquefield", F.lit("+")))
    null = fresh.withColumn("pkfield", F.when(F.col("pkfield") % 2 == 0, F.col("pkfield")))
    for bad in (c, fresh.unionAll(fresh), fresh.withColumn("uniquefield", F.lit("one")), null):
        try:
            e.insert("cust", bad)
        except EngineError:
            refused += 1
    return e.table("cust").agg(F.count(F.lit(1)).alias("n"), F.lit(refused).alias("refused"))


# ---- sources ----


@_add(
    r"WITH l AS (SELECT string_split(unnest(regexp_split_to_array(content, '\r\n|\n|\r')), chr(9)) AS p FROM entity_files), "
    "f AS (SELECT trim(p[1]) AS id, trim(p[2]) AS type, TRY_CAST(p[3] AS INT) AS length, list_filter(regexp_split_to_array(trim(p[4]), '[\\s,]+'), lambda s: s <> '') AS v FROM l WHERE len(p) = 4) "
    "SELECT id, type, length, len(v) AS n, round(coalesce(list_sum(list_transform(v, lambda s: coalesce(TRY_CAST(s AS FLOAT), 1.0)::DOUBLE)), 0), 3) AS total FROM f"
)
def import_features(spark: SparkSession, sf: str) -> DataFrame:
    """Feature lines of the tiny files, bad numbers as 1."""
    lines = table(spark, sf, "entity_files").select(F.explode(F.split("content", "\r\n|\n|\r")).alias("value"))
    f = importers.feature_lines(lines)
    total = F.aggregate("feature", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return f.select("id", "type", "length", F.size("feature").cast("long").alias("n"), F.round(total, 3).alias("total"))


_BM = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


@_add(
    f"WITH t AS (SELECT doc_id, {_BM} AS w FROM documents WHERE text IS NOT NULL), "
    "c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'compiler')) AS a, len(list_filter(w, lambda x: x = 'turbine')) AS b FROM t), "
    "s AS (SELECT count(*) AS rows, avg(n) AS mean, sum((a > 0)::INT) AS da, sum((b > 0)::INT) AS db FROM c) "
    "SELECT doc_id, round(ln(1 + (rows - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + "
    "ln(1 + (rows - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS ap_score FROM c, s WHERE a + b > 0"
)
def text_search(spark: SparkSession, sf: str) -> DataFrame:
    return textsearch.bm25(table(spark, sf, "documents"), "doc_id", "text", "compiler turbine", 6)


@_add(
    "WITH p AS (SELECT c_custkey, c_custkey % 180 - 90.0 AS lat, (c_custkey * 7) % 360 - 180.0 AS lng FROM customer), "
    "h AS (SELECT c_custkey, pow(sin(radians(lat - 47.5) / 2), 2) + cos(radians(47.5)) * cos(radians(lat)) * pow(sin(radians(lng - 7.6) / 2), 2) AS h FROM p) "
    "SELECT c_custkey FROM h WHERE 2 * 6371000 * asin(sqrt(least(h, 1.0))) <= 2000000"
)
def geo_search(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    wkt = F.format_string("POINT(%.1f %.1f)", ((c * 7) % 360 - 180.0).cast("double"), (c % 180 - 90.0).cast("double"))
    p = table(spark, sf, "customer").select("c_custkey", F.struct(wkt.alias("geometry_desc")).alias("g"))
    return textsearch.geo_within(p, "g", 47.5, 7.6, 2_000_000).select("c_custkey")


@_add("SELECT vec_id, embedding[1]::DOUBLE AS first_value FROM embeddings WHERE vec_id IN (3, 7, 400)")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Two copies, one clustered by id; a look-up by id reads that one."""
    from lumenscan.runtime import scratch_path
    from lumenscan.sources import stores

    path = scratch_path(spark, "both")
    stores.write_both(table(spark, sf, "embeddings"), path, "vec_id", 4)
    got = stores.read_both(spark, path, [M.Predicate("vec_id", "in", (3, 7, 400))], "vec_id")
    return got.select("vec_id", F.get("embedding", 0).cast("double").alias("first_value"))


@_add("SELECT vec_id, label FROM embeddings")
def store_transfer(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes moved between Parquet, ORC and JSON, joined again by id."""
    e = Engine(spark)
    e.create_entity("t", [Attribute("vec_id", "long"), Attribute("label", "integer", "orc"), Attribute("v", "vector")])
    e.insert("t", table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("v")))
    e.transfer("t", ["label"], "json")
    return e.table("t").select("vec_id", "label")
