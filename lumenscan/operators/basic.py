"""Filters, exact nearest neighbours, set and fuzzy combination, projection.

All of these take and give lazy DataFrames; ids are in ap_id, distances in
ap_distance. A combination works on ids; scalar work stays in Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from lumenscan.functions import distance as D
from lumenscan.model import OPERATORS, Predicate, Ranking
from lumenscan.runtime import materialise
from lumenscan.types import DISTANCE, PK, SOURCE, EngineError

IN_CHUNK = 500
STOCHASTIC_LIMIT = 5000


def condition(p: Predicate) -> Column:
    """One value: attribute op value; several with = or !=: IN or NOT IN."""
    op = p.operator.strip().lower()
    if op == "<>":
        op = "!="
    if op not in OPERATORS:
        raise EngineError(f"operator {p.operator!r} is not allowed")
    c, values = F.col(f"`{p.attribute}`"), list(p.values)
    if op in ("in", "not in") or len(values) > 1:
        if op in ("=", "in"):
            return c.isin(values)
        if op in ("!=", "not in"):
            return ~c.isin(values)
        raise EngineError(f"{op} takes one value")
    if not values:
        raise EngineError("predicate without a value")
    v = F.lit(values[0])
    return {
        "=": lambda: c == v, "!=": lambda: c != v, "<": lambda: c < v, ">": lambda: c > v, "<=": lambda: c <= v, ">=": lambda: c >= v,
        "like": lambda: c.like(values[0]), "rlike": lambda: c.rlike(values[0]),
    }[op]()


def where(df: DataFrame, predicates: Sequence[Predicate]) -> DataFrame:
    """All predicates hold; none: all rows."""
    return df.filter(reduce(lambda a, b: a & b, map(condition, predicates))) if predicates else df


def within(df: DataFrame, ids: DataFrame, method: str = "semijoin", pk: str = PK, again: Callable[[], DataFrame] | None = None, most: int = 100 * IN_CHUNK) -> DataFrame:
    """Rows whose id is among `ids`, by one of four ways with the same result.

    semijoin leaves the physical join to Catalyst, which broadcasts ids only if
    they are small. The others are taken only for fewer ids than `most` and than
    half of the rows, and are a semi-join beyond: inlist turns the ids into IN
    filters on df, pushdown into IN filters on a fresh read (`again`), which
    reach the scan; bloom first drops most rows by a filter of 16 slots an id.
    """
    if method not in ("semijoin", "inlist", "pushdown", "bloom"):
        raise EngineError(f"unknown filter method {method!r}")
    ids = ids.select(pk).distinct()
    if method == "semijoin":
        return df.join(ids, pk, "left_semi")
    few = [r[0] for r in ids.limit(most + 1).collect()]
    if len(few) > most or 2 * len(few) >= df.count():
        return df.join(ids, pk, "left_semi")
    if method == "bloom":
        slot = F.pmod(F.xxhash64(pk), F.lit(max(1 << 16, 16 * len(few))))
        held = ids.select(slot.alias("_slot")).distinct()
        df = df.withColumn("_slot", slot).join(held, "_slot", "left_semi").drop("_slot")
        return df.join(ids, pk, "left_semi")
    source = again() if method == "pushdown" and again is not None else df
    chunks = [few[i : i + IN_CHUNK] for i in range(0, len(few), IN_CHUNK)]
    return source.filter(reduce(lambda a, b: a | b, (F.col(pk).isin(c) for c in chunks))) if chunks else source.limit(0)


def with_distance(df: DataFrame, r: Ranking, rounded: int | None = None) -> DataFrame:
    """Adds ap_distance; a sparse attribute is compared by position, the query and weights being dense."""
    d, v = D.find(r.distance, **dict(r.options)), F.col(f"`{r.attribute}`")
    if isinstance(df.schema[r.attribute].dataType, StructType):
        out = D.sparse_between(d, D.sparse_literal(r.query), v, None if r.weights is None or not d.weighted else D.sparse_literal(r.weights))
    else:
        out = D.between(d, list(r.query), v, r.weights)
    return df.withColumn(DISTANCE, F.round(out, rounded) if rounded is not None else out)


def nearest(df: DataFrame, r: Ranking, pk: str = PK, rounded: int | None = None) -> DataFrame:
    """All attributes of the k nearest rows and their distance; ties to the smaller id."""
    return with_distance(df, r, rounded).orderBy(F.col(DISTANCE).asc(), F.col(pk).asc()).limit(r.k)


def batch_nearest(queries: DataFrame, data: DataFrame, r: Ranking, query_id: str, query_vector: str, pk: str = PK, rounded: int | None = None, block_bytes: int = 8 << 20) -> DataFrame:
    """(query id, id, distance): k nearest rows for each of a stated set of queries.

    The queries are cut into blocks of at most about block_bytes (a vector's
    width is taken from the longest); each block is sent to all tasks and meets
    every row once, and the k best of a query are kept within each partition
    before the shuffle. Null query vectors have no neighbours.
    """
    q = queries.select(F.col(query_id), F.col(query_vector).cast("array<double>").alias("_q")).filter(F.col("_q").isNotNull())
    n, width = q.agg(F.count(F.lit(1)), F.max(F.size("_q"))).first()
    blocks = max(1, -(-n * 8 * (width or 1) // block_bytes))
    d = D.between(D.find(r.distance, **dict(r.options)), F.col("_q"), F.col(r.attribute), r.weights)
    rank = F.row_number().over(W.partitionBy(query_id).orderBy(DISTANCE, pk))
    out = []
    for b in range(blocks):
        part = q.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b) if blocks > 1 else q
        met = data.select(F.col(pk), F.col(r.attribute)).join(F.broadcast(part), F.lit(True), "inner")
        scored = met.select(query_id, pk, (F.round(d, rounded) if rounded is not None else d).alias(DISTANCE))
        out.append(scored.withColumn("_r", rank).filter(F.col("_r") <= r.k).drop("_r"))
    return reduce(DataFrame.union, out)


# ---- combination of two results ----


def _ids(df: DataFrame) -> DataFrame:
    return df.select(PK)


def _unranked(ids: DataFrame) -> DataFrame:
    return ids.withColumn(DISTANCE, F.lit(0.0))


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids of both, duplicates kept, distance 0."""
    return _unranked(_ids(left).unionAll(_ids(right)))


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return _unranked(_ids(left).intersect(_ids(right)))


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    return _unranked(_ids(left).subtract(_ids(right)))


def fuzzy(left: DataFrame, right: DataFrame, how: str = "union", combination: str = "outer", default: float = 0.0, standard: bool = True, source: tuple[str, str] | None = None) -> DataFrame:
    """Joins two rankings on their id; a side that does not list it has distance `default`.

    union takes the lesser distance, intersect the larger (the other way round
    if not standard). Note that with the default of 0 an id that one side lacks
    is at 0 in a union. Payload of either side is kept, the left's where both
    have it; ap_source says which side gave the id if `source` names them.
    """
    least = (how == "union") == standard
    drop = [c for c in right.columns if c in left.columns and c not in (PK, DISTANCE)] + ["ap_indexfeature"]
    a = left.drop("ap_indexfeature").withColumnRenamed(DISTANCE, "_l")
    b = right.drop(*drop).withColumnRenamed(DISTANCE, "_r")
    j = a.join(b, PK, {"outer": "full_outer"}.get(combination, combination))
    da, db = F.coalesce("_l", F.lit(default)), F.coalesce("_r", F.lit(default))
    out = j.withColumn(DISTANCE, F.least(da, db) if least else F.greatest(da, db))
    if source:
        name = f"FUZZY{how.upper()}"
        both = F.lit(f"{source[0]} {name} {source[1]}")
        out = out.withColumn(SOURCE, F.when(F.col("_l").isNull(), F.lit(f"x {name} {source[1]}")).when(F.col("_r").isNull(), F.lit(f"{source[0]} {name} x")).otherwise(both))
    return out.drop("_l", "_r")


def sequenced(how: str, first: DataFrame, second: DataFrame) -> DataFrame:
    """Asymmetric evaluation: the first's ids restrict the second, whose rows come back.

    For `except` the rows of the first that the second lacks.
    """
    if how == "except":
        return first.join(second.select(PK).distinct(), PK, "left_anti")
    return within(second, first)


def vote(lists: Sequence[DataFrame], limit: int | None = STOCHASTIC_LIMIT) -> DataFrame:
    """Distance 1 - share of the lists that hold the id; the `limit` nearest (None: all), ties to the smaller id."""
    if not lists:
        raise EngineError("nothing to vote")
    every = reduce(DataFrame.unionAll, (_ids(x).distinct() for x in lists))
    voted = every.groupBy(PK).agg((1 - F.count(F.lit(1)) / len(lists)).alias(DISTANCE))
    return voted if limit is None else voted.orderBy(DISTANCE, PK).limit(limit)


# ---- projection ----


def project(df: DataFrame, attributes: Sequence[str] = (), op: str | None = None) -> DataFrame:
    """Attributes first (none, or a leading *: all), then count, exists or distinct."""
    if attributes and attributes[0] != "*":
        df = df.select(*[F.col(f"`{a}`") for a in attributes])
    op = (op or "").lower()
    if op == "count":
        return df.agg(F.count(F.lit(1)).alias("count"))
    if op == "exists":
        return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("exists"))
    if op == "distinct":
        return df.distinct()
    if op:
        raise EngineError(f"unknown projection {op!r}")
    return df


def with_partition(df: DataFrame) -> DataFrame:
    return df.withColumn("ap_partition", F.spark_partition_id())


def pages(df: DataFrame, size: int = 500, cap: int | None = 50_000) -> Iterator[list]:
    """Up to cap rows (None: all) in pages, as they come; only one partition at a time is on the driver."""
    page: list = []
    for row in (df if cap is None else df.limit(cap)).toLocalIterator(prefetchPartitions=True):
        page.append(row)
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page


def tuple_ids(df: DataFrame, batch: int, pk: str = PK) -> DataFrame:
    """Adds unique ids: 20 bits of batch, 43 of the row's number in it. The rows are written out, so ids do not change.

    Numbers are dense, whatever the number of partitions: the counts of the
    partitions, a row for each, are summed up and joined back.
    """
    if not 0 <= batch < 1 << 20:
        raise EngineError(f"batch {batch} does not fit an id")
    row = F.monotonically_increasing_id()
    kept = materialise(df.withColumn("_row", row), "rows").withColumn("_part", F.shiftright("_row", 33))
    counts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    number = F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(before), "_part").withColumn(pk, F.lit(batch << 43) + number).drop("_row", "_part", "_before")


def sample_rows(df: DataFrame, n: int, pk: str = PK, seed: int = 7) -> DataFrame:
    """n rows, the same ones each time: those with the least hash of their id."""
    return df.orderBy(F.xxhash64(F.col(pk), F.lit(seed)), F.col(pk)).limit(n)
