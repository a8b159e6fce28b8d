"""Distances between a query vector and a column of vectors.

Every distance is a few sums (or an extremum) of terms over the dimensions, so
it is said once and built in one of two ways: unrolled arithmetic, which whole-
stage code generation compiles, for a literal query of moderate width; higher-
order functions for queries that are columns themselves. Elements are doubles.
Vectors of unequal length are compared over their common dimensions; a null
vector is at the largest double.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DISTANCE = 1.7976931348623157e308
EARTH_RADIUS_M = 6_371_000.0
TINY = 1e-5
UNROLL_DIMS = 128

Term = Callable[[Column, Column, Column | float], Column]


@dataclass(frozen=True)
class Distance:
    """sums: terms to add up over the dimensions; of_row: those of them that do not look at the query.
    largest/least: terms to take the extremum of."""

    name: str
    finish: Callable[..., Column]
    sums: tuple[Term, ...] = ()
    largest: tuple[Term, ...] = ()
    least: tuple[Term, ...] = ()
    weighted: bool = True
    options: dict = field(default_factory=dict)
    of_row: tuple[int, ...] = ()
    whole: Callable[[Column, Column], Column] | None = None


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(float("nan"))).otherwise(top / F.when(bottom == 0, F.lit(1.0)).otherwise(bottom))


def _cosine(dot: Column, aa: Column, bb: Column) -> Column:
    na, nb = F.sqrt(F.greatest(aa, F.lit(0.0))), F.sqrt(F.greatest(bb, F.lit(0.0)))
    flat = (na < TINY) | (nb < TINY)
    return F.when(flat, 0.0).otherwise(1 - dot / F.when(flat, F.lit(1.0)).otherwise(na * nb))


def _correlation(ab: Column, aa: Column, bb: Column, a: Column, b: Column, n: Column) -> Column:
    n = F.greatest(n, F.lit(1.0))
    return _cosine(ab - a * b / n, aa - a * a / n, bb - b * b / n)


def _chi(a: Column, b: Column, w) -> Column:
    return F.when(a + b > 0, w * (a - b) * (a - b) / F.when(a + b > 0, a + b).otherwise(F.lit(1.0))).otherwise(0.0)


def _kl(a: Column, b: Column, w) -> Column:
    flat = (F.abs(a) < TINY) | (F.abs(b) < TINY)
    return F.when(flat, 0.0).otherwise(a * F.log(F.when(flat, F.lit(1.0)).otherwise(a / F.when(flat, F.lit(1.0)).otherwise(b))))


def _modulo(a: Column, b: Column, w) -> Column:
    return F.when(a == 0, F.lit(float("nan"))).otherwise(w * (b % F.when(a == 0, F.lit(1.0)).otherwise(a)))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres; latitudes are clamped to +-90, longitudes wrapped to [-180, 180)."""

    def clamp(x: Column) -> Column:
        return F.radians(F.least(F.greatest(x, F.lit(-90.0)), F.lit(90.0)))

    def wrap(x: Column) -> Column:
        return F.radians(F.pmod(x + 180.0, F.lit(360.0)) - 180.0)

    p, q = clamp(lat1), clamp(lat2)
    h = F.pow(F.sin((q - p) / 2), 2.0) + F.cos(p) * F.cos(q) * F.pow(F.sin((wrap(lng2) - wrap(lng1)) / 2), 2.0)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _haversine_arrays(q: Column, v: Column) -> Column:
    short = (F.size(q) < 2) | (F.size(v) < 2)
    return F.when(short, F.lit(float("inf"))).otherwise(haversine(F.get(q, 0), F.get(q, 1), F.get(v, 0), F.get(v, 1)))


def _d(a, b):
    return a - b


_REGISTRY: dict[str, Callable[..., Distance]] = {}


def register(name: str, make: Callable[..., Distance]) -> None:
    """Adds a distance; make(**options) gives its definition."""
    _REGISTRY[name] = make


def _simple(name: str, **kw) -> None:
    register(name, lambda **options: Distance(name, options=options, **kw))


_simple("manhattan", sums=(lambda a, b, w: w * F.abs(_d(a, b)),), finish=lambda s: s)
_simple("euclidean", sums=(lambda a, b, w: w * _d(a, b) * _d(a, b),), finish=F.sqrt)
_simple("squaredeuclidean", sums=(lambda a, b, w: w * _d(a, b) * _d(a, b),), finish=lambda s: s)
_simple("chebyshev", largest=(lambda a, b, w: F.abs(w * _d(a, b)),), finish=lambda m: m)
_simple("chisquared", sums=(_chi,), finish=lambda s: s)
_simple("cosine", sums=(lambda a, b, w: a * b, lambda a, b, w: a * a, lambda a, b, w: b * b), of_row=(2,), finish=_cosine, weighted=False)
_simple(
    "correlation",
    sums=(lambda a, b, w: a * b, lambda a, b, w: a * a, lambda a, b, w: b * b, lambda a, b, w: a, lambda a, b, w: b, lambda a, b, w: a * 0 + b * 0 + 1.0),
    of_row=(2, 4, 5), finish=_correlation, weighted=False,
)
_simple("hamming", sums=(lambda a, b, w: F.when(F.abs(_d(a, b)) > TINY, w * F.lit(1.0)).otherwise(0.0),), finish=lambda s: s)
_simple("jaccard", sums=(lambda a, b, w: F.when(b.isNotNull(), F.least(a, b)), lambda a, b, w: F.when(b.isNotNull(), F.greatest(a, b))), finish=lambda x, y: 1 - _ratio(x, y), weighted=False)
_simple("kullbackleibler", sums=(_kl,), finish=lambda s: s, weighted=False)
_simple("spannorm", largest=(lambda a, b, w: _d(a, b),), least=(lambda a, b, w: _d(a, b),), finish=lambda x, y: x - y, weighted=False)
_simple("modulo", sums=(_modulo,), finish=lambda s: s)
_simple("haversine", finish=lambda: None, weighted=False, whole=_haversine_arrays)


def _minkowski(norm: float = 2.0, **_) -> Distance:
    n = float(norm)
    if abs(n - 1) < TINY:
        return _REGISTRY["manhattan"]()
    if abs(n - 2) < TINY:
        return _REGISTRY["euclidean"]()
    if math.isinf(n):
        return _REGISTRY["chebyshev"]()
    return Distance("minkowski", sums=(lambda a, b, w: w * F.pow(F.abs(_d(a, b)), n),), finish=lambda s: F.pow(s, 1.0 / n), options={"norm": n})


register("minkowski", _minkowski)


def names() -> list[str]:
    return sorted(_REGISTRY)


def find(name: str | None, **options) -> Distance:
    """Unknown and missing names mean Euclidean."""
    return _REGISTRY.get((name or "euclidean").lower().replace("_", "").replace("-", ""), _REGISTRY["euclidean"])(**options)


def exponent(d: Distance) -> float | None:
    """The n of a Minkowski distance, None for others."""
    return {"manhattan": 1.0, "euclidean": 2.0, "squaredeuclidean": 2.0, "chebyshev": math.inf, "minkowski": d.options.get("norm", 2.0)}.get(d.name)


def _tree(op: Callable, xs: list[Column]) -> Column:
    while len(xs) > 1:
        xs = [op(xs[i], xs[i + 1]) if i + 1 < len(xs) else xs[i] for i in range(0, len(xs), 2)]
    return xs[0]


def _unrolled(d: Distance, q: Sequence[float], v: Column, w: Sequence[float] | None) -> Column:
    at = [F.get(v, i).cast("double") for i in range(len(q))]
    qs = [F.lit(float(x)) for x in q]
    ws = [1.0] * len(q) if w is None else [float(x) for x in w]
    own = F.slice(v, 1, len(q))  # sums over the row alone are folded: unrolled too, the code would outgrow a method

    def added(k: int, t: Term) -> Column:
        if k in d.of_row:
            return F.aggregate(own, F.lit(0.0), lambda s, x: s + F.coalesce(t(F.lit(0.0), x.cast("double"), 1.0), F.lit(0.0)))
        return _tree(lambda x, y: x + y, [F.coalesce(t(a, b, c), F.lit(0.0)) for a, b, c in zip(qs, at, ws)])

    parts = [added(k, t) for k, t in enumerate(d.sums)]
    for terms, op in ((d.largest, F.greatest), (d.least, F.least)):
        parts += [_tree(op, [t(a, b, c) for a, b, c in zip(qs, at, ws)]) if len(q) > 1 else t(qs[0], at[0], ws[0]) for t in terms]
    return d.finish(*parts)


def _folded(d: Distance, q: Column, v: Column, w: Column | None) -> Column:
    n = F.least(F.size(q), F.size(v))
    pairs = F.zip_with(F.slice(q, F.lit(1), n), F.slice(v, F.lit(1), n), lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
    if w is not None:
        pairs = F.zip_with(pairs, F.slice(w, F.lit(1), n), lambda p, x: F.struct(p["a"].alias("a"), p["b"].alias("b"), x.cast("double").alias("w")))

    def over(t: Term) -> Column:
        return F.transform(pairs, lambda p: t(p["a"], p["b"], 1.0 if w is None else p["w"]))

    parts = [F.aggregate(over(t), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) for t in d.sums]
    parts += [F.array_max(F.filter(over(t), lambda x: x.isNotNull())) for t in d.largest]
    parts += [F.array_min(F.filter(over(t), lambda x: x.isNotNull())) for t in d.least]
    return d.finish(*parts)


def between(d: Distance, q: Column | Sequence[float], v: Column, weights: Column | Sequence[float] | None = None) -> Column:
    """The distance of q to v as a Column; a null vector is at the largest double.

    q may be a sequence of numbers or an array column. Weights do nothing for
    distances that have none.
    """
    if not d.weighted:
        weights = None
    literal = not isinstance(q, Column)
    if literal and d.whole is None and 0 < len(q) <= UNROLL_DIMS and not isinstance(weights, Column):
        out = _unrolled(d, q, v, weights)
    else:
        qc = F.array(*[F.lit(float(x)) for x in q]) if literal else q
        wc = F.array(*[F.lit(float(x)) for x in weights]) if weights is not None and not isinstance(weights, Column) else weights
        vd = F.transform(v, lambda x: x.cast("double"))
        out = d.whole(qc.cast("array<double>"), vd) if d.whole else _folded(d, qc, v, wc)
    null = v.isNull() | (F.lit(False) if literal else q.isNull())
    return F.when(null, F.lit(MAX_DISTANCE)).otherwise(F.coalesce(out, F.lit(MAX_DISTANCE)))


# ---- sparse vectors: struct<index, data, length> ----


def to_dense(s: Column) -> Column:
    """array<double> of a sparse struct; positions not stored are 0."""
    held = F.map_from_arrays(s["index"], s["data"])
    return F.transform(F.sequence(F.lit(0), s["length"] - 1), lambda i: F.coalesce(F.try_element_at(held, i).cast("double"), F.lit(0.0)))


def to_sparse(v: Column, least: float = 1e-10) -> Column:
    """The sparse struct of a dense vector: entries above `least` in size are stored."""
    kept = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.cast("float").alias("x"))), lambda p: F.abs(p["x"]) > least)
    return F.struct(kept["i"].alias("index"), kept["x"].alias("data"), F.size(v).alias("length"))


def sparse_between(d: Distance, a: Column, b: Column, weights: Column | None = None) -> Column:
    """The distance of two sparse structs by position, for any distance; weights are a sparse struct too.

    Positions that neither stores are 0 in both. Both are read over the
    positions 0 .. length-1 that either or the weights store, and over one more
    that stands for each kind of position that none of them stores, so the work
    follows what is stored. A null is at the largest double.
    """

    def values(s: Column, at: Column) -> Column:
        held = F.map_from_arrays(s["index"], s["data"])
        return F.transform(at, lambda i: F.coalesce(F.try_element_at(held, i).cast("double"), F.lit(0.0)))

    if d.whole is not None or d.name == "correlation":
        out = between(d, to_dense(a), to_dense(b))  # these look at every position
        return F.when(a.isNull() | b.isNull(), F.lit(MAX_DISTANCE)).otherwise(out)
    at = F.array_union(a["index"], b["index"])
    if weights is not None:
        at = F.array_union(at, weights["index"])
    rest = F.greatest(a["length"], b["length"]) > F.size(at)
    # A position that nobody stores: zero on both sides, with no weight.
    at = F.when(rest, F.array_append(at, F.lit(-1))).otherwise(at)
    out = between(d, values(a, at), values(b, at), None if weights is None else values(weights, at))
    return F.when(a.isNull() | b.isNull(), F.lit(MAX_DISTANCE)).otherwise(out)


def sparse_literal(x: Sequence[float]) -> Column:
    """The sparse struct of numbers given in full; zeros are not stored."""
    held = [(i, float(v)) for i, v in enumerate(x) if v]
    index = F.array(*[F.lit(i) for i, _ in held]).cast("array<int>")
    return F.struct(index.alias("index"), F.array(*[F.lit(v) for _, v in held]).cast("array<double>").alias("data"), F.lit(len(x)).alias("length"))


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product by position, not by place in the list."""
    held = F.map_from_arrays(b["index"], b["data"])
    terms = F.zip_with(a["index"], a["data"], lambda i, x: x.cast("double") * F.coalesce(F.try_element_at(held, i).cast("double"), F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def sparse_cosine(a: Column, b: Column) -> Column:
    def square(s: Column) -> Column:
        return F.aggregate(s["data"], F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))

    return _cosine(sparse_dot(a, b), square(a), square(b))
