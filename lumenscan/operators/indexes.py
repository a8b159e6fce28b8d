"""Eight vector indexes: build a signature for every row, probe for candidates.

An index is fitted on a bounded sample (`ntraining`, a parameter) and then
holds every row. Metadata is a small dictionary of arrays; signatures are a
DataFrame (ap_id, sig). A probe gives (ap_id, ap_distance) with approximate
distances; unless asked for these alone, candidates are ranked exactly.
Training and signatures are array maths, done in Arrow batches with numpy.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.functions import distance as D
from lumenscan.model import Ranking
from lumenscan.operators.basic import sample_rows
from lumenscan.runtime import materialise
from lumenscan.types import DISTANCE, PK, EngineError

KINDS = ("vaf", "vav", "vap", "pq", "sh", "lsh", "ecp", "mi")
#: (confidence, naive score, ranked): fixed properties of the kinds.
PROPERTIES = {
    "vaf": (1.0, 0.9), "vav": (1.0, 1.0), "vap": (1.0, 0.9), "pq": (0.5, 0.5),
    "sh": (0.5, 0.4), "lsh": (0.5, 0.3), "ecp": (0.5, 0.6), "mi": (0.5, 0.2),
}
MINIMUM_ROWS = 100
#: Leaders of cluster pruning unless `nleaders` says otherwise: every row is compared with all of them, and they travel to all tasks.
MOST_LEADERS = 200
SEED = 11


@dataclass
class Index:
    name: str
    entity: str
    attribute: str
    kind: str
    distance: str
    meta: dict
    data: DataFrame | None = None
    options: dict = field(default_factory=dict)
    stale: bool = False

    @property
    def confidence(self) -> float:
        return PROPERTIES[self.kind][0]

    @property
    def score(self) -> float:
        return PROPERTIES[self.kind][1]

    @property
    def lossy(self) -> bool:
        return self.confidence < 1

    def conforms(self, r: Ranking) -> bool:
        """Whether the index can answer this ranking."""
        if r.attribute != self.attribute:
            return False
        d = D.find(r.distance, **dict(r.options))
        if self.kind in ("vaf", "vav", "pq"):
            return D.exponent(d) is not None and (r.weights is None or self.kind != "pq")
        if self.kind in ("vap", "sh"):
            return D.exponent(d) == 2.0 and r.weights is None
        if self.kind == "lsh":
            return d.name == D.find(self.distance).name and r.weights is None
        return r.weights is None


def _matrix(column: pa.Array) -> np.ndarray:
    off = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    return flat.astype(np.float64).reshape(len(column), -1)


def _signatures(rows: DataFrame, vec: str, encode: Callable[[np.ndarray], np.ndarray], kind: str = "int") -> DataFrame:
    """(ap_id, sig): encode gives an integer matrix, a row for each vector."""
    arrow = pa.int64() if kind == "long" else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = encode(_matrix(b.column(1)))
                off = np.arange(0, s.size + 1, s.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(off, pa.array(s.ravel(), arrow))], ["ap_id", "sig"])

    source = rows.filter(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(F.col(PK).cast("long"), F.col(vec).cast("array<double>"))
    return source.mapInArrow(run, f"ap_id long, sig array<{kind}>")


def _judged(data: DataFrame, judge: Callable[[np.ndarray], tuple[np.ndarray, ...]], names: list[str]) -> DataFrame:
    """(ap_id, *names): judge gives a column of doubles for each name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                off = b.column(1).offsets.to_numpy()
                sig = b.column(1).values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.asarray(c, np.float64)) for c in judge(sig)]], ["ap_id", *names])

    return data.select("ap_id", "sig").mapInArrow(run, "ap_id long, " + ", ".join(f"{n} double" for n in names))


def _sample(rows: DataFrame, vec: str, n: int) -> np.ndarray:
    """At most n vectors (the documented bound of what training sees)."""
    got = sample_rows(rows.filter(F.col(vec).isNotNull()).select(PK, vec), n).collect()
    return np.array([r[vec] for r in got], np.float64)


def _few_tasks(df: DataFrame) -> DataFrame:
    """So that partial results are as many as the cluster has cores, not as the data has partitions."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def _extremes(rows: DataFrame, vec: str, dims: int, turn: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """True least and largest value of every dimension over all rows, turned first if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dims, np.inf), np.full(dims, -np.inf)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                x = x if turn is None else x @ turn.T
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([low.tolist()]), pa.array([high.tolist()])], ["low", "high"])

    source = rows.filter(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(F.col(vec).cast("array<double>"))
    parts = _few_tasks(source).mapInArrow(run, "low array<double>, high array<double>").toArrow()
    return tuple(f(np.array(parts.column(i).to_pylist()), axis=0) for i, f in enumerate((np.min, np.max)))


# ---- vector approximation files ----


def equidistant_marks(low: float, high: float, n: int) -> np.ndarray:
    return np.linspace(low, high, n + 1)


def equifrequent_marks(values: np.ndarray, low: float, high: float, n: int) -> np.ndarray:
    """Quantiles of the sample; the outermost marks are the true bounds of the data."""
    m = np.quantile(values, np.linspace(0, 1, n + 1))
    m[0], m[-1] = low, high
    return np.maximum.accumulate(m)


def _va_marks(sample: np.ndarray, low: np.ndarray, high: np.ndarray, bits: np.ndarray, how: str) -> list[np.ndarray]:
    if how == "equidistant":
        return [equidistant_marks(a, z, 1 << int(b)) for a, z, b in zip(low, high, bits)]
    return [equifrequent_marks(np.clip(sample[:, i], low[i], high[i]), low[i], high[i], 1 << int(b)) for i, b in enumerate(bits)]


def _cells(marks: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, np.int32)
    for i, m in enumerate(marks):
        out[:, i] = np.clip(np.searchsorted(m, x[:, i], side="right") - 1, 0, len(m) - 2)
    return out


def _bounds(marks: list[np.ndarray], q: np.ndarray, w: np.ndarray, n: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per dimension, the least and largest term of the distance from q to each cell."""
    low, up = [], []
    for m, x, weight in zip(marks, q, w):
        a, z = m[:-1], m[1:]
        near = np.where(x < a, a - x, np.where(x > z, x - z, 0.0))
        far = np.maximum(np.abs(x - a), np.abs(x - z))
        power = 1.0 if math.isinf(n) else n
        low.append(weight * near**power)
        up.append(weight * far**power)
    return low, up


def _build_va(kind: str, rows: DataFrame, vec: str, options: dict) -> tuple[dict, DataFrame]:
    n = int(options.get("ntraining", 5000 if kind == "vaf" else 1000))
    sample = _sample(rows, vec, n)
    dims = sample.shape[1]
    how = options.get("marktype", "equifrequent")
    turn = None
    if kind == "vap":
        centred = sample - sample.mean(axis=0)
        axes = np.linalg.svd(centred, full_matrices=False)[2]
        if len(axes) < dims:  # fewer samples than dimensions: complete the rotation
            axes = np.linalg.qr(np.vstack([axes, np.eye(dims)]).T)[0].T[:dims]
        turn = axes
        sample = sample @ turn.T
    variance = sample.var(axis=0)
    if kind == "vaf":
        bits = np.full(dims, int(options.get("nbits", options.get("nmarks", max(5, math.ceil(5 + 0.5 * math.log2(dims / 10)))))))
    else:
        total = int(options.get("signature-nbits", int(options.get("signature-nbits-dim", 5)) * dims))
        if kind == "vav":
            share = variance / max(variance.sum(), 1e-30)
            bits = 1 + np.floor(share * max(0, total - dims)).astype(int)
        else:
            bits, left = np.zeros(dims, int), variance.copy()
            for _ in range(total):
                i = int(left.argmax())
                bits[i] += 1
                left[i] /= 4
        bits = np.clip(bits, 1, 12)
    low, high = _extremes(rows, vec, dims, turn)  # of all rows, so bounds hold for every one
    marks = _va_marks(sample, low, high, bits, how)
    meta = {"marks": marks, "bits": bits, "turn": turn, "dims": dims}
    encode = (lambda x: _cells(marks, x)) if turn is None else (lambda x: _cells(marks, x @ turn.T))
    return meta, _signatures(rows, vec, encode)


def _probe_va(ix: Index, r: Ranking, data: DataFrame) -> DataFrame:
    """Rows whose lower bound is within the k-th smallest upper bound: all true neighbours are."""
    marks, turn = ix.meta["marks"], ix.meta["turn"]
    q = np.asarray(r.query, float)
    w = np.ones(len(q)) if r.weights is None else np.asarray(r.weights, float)
    if turn is not None:
        q = turn @ q
    n = D.exponent(D.find(r.distance, **dict(r.options))) or 2.0
    low, up = _bounds(marks, q, w, n)
    join = np.maximum.reduce if math.isinf(n) else np.add.reduce
    slack = 1e-9

    k = r.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.empty(0)  # the k smallest upper bounds of this task so far
        for b in batches:
            if not b.num_rows:
                continue
            off = b.column(1).offsets.to_numpy()
            sig = b.column(1).values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].reshape(b.num_rows, -1)
            lo = join([t[sig[:, i]] for i, t in enumerate(low)]) * (1 - slack)
            hi = join([t[sig[:, i]] for i, t in enumerate(up)]) * (1 + slack) + 1e-12
            least = np.sort(np.concatenate([least, hi]))[:k]
            at = np.flatnonzero(lo <= least[-1]) if len(least) == k else np.arange(len(lo))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(lo[at]), pa.array(hi[at])], ["ap_id", "lo", "hi"])

    # One pass over the signatures; what a task leaves out lies beyond k rows of its own.
    b = materialise(data.select("ap_id", "sig").mapInArrow(run, "ap_id long, lo double, hi double"), "bounds")
    tau = b.orderBy("hi").limit(r.k).agg(F.max("hi").alias("t"))
    return b.filter(F.col("lo") <= tau.scalar()).select("ap_id", ((F.col("lo") + F.col("hi")) / 2).alias(DISTANCE))


# ---- product quantization ----


def lloyd(x: np.ndarray, k: int, rounds: int = 100, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1) if len(x) * len(c) * x.shape[1] < 2e7 else _nearest(x, c)
        new = np.stack([x[at == i].mean(axis=0) if (at == i).any() else c[i] for i in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None] - 2 * x @ c.T).argmin(axis=1)


def _build_pq(rows: DataFrame, vec: str, options: dict) -> tuple[dict, DataFrame]:
    sample = _sample(rows, vec, int(options.get("ntraining", 1000)))
    dims = sample.shape[1]
    blocks = np.array_split(np.arange(dims), min(dims, int(options.get("nsq", 8))))
    k = min(int(options.get("nclusters", 256)), len(sample))
    books = [lloyd(sample[:, b], k, 25) for b in blocks]

    def encode(x: np.ndarray) -> np.ndarray:
        return np.stack([_nearest(x[:, b], c) for b, c in zip(blocks, books)], axis=1).astype(np.int32)

    return {"blocks": blocks, "books": books}, _signatures(rows, vec, encode)


def _probe_pq(ix: Index, r: Ranking, data: DataFrame) -> DataFrame:
    q = np.asarray(r.query, float)
    n = D.exponent(D.find(r.distance, **dict(r.options))) or 2.0
    # Terms before the root are summed, so that their order is that of the distance.
    tables = [(np.abs(c - q[b]).max(axis=1) if math.isinf(n) else (np.abs(c - q[b]) ** n).sum(axis=1)) for b, c in zip(ix.meta["blocks"], ix.meta["books"])]
    join = np.maximum.reduce if math.isinf(n) else np.add.reduce
    root = 1.0 if math.isinf(n) or r.distance == "squaredeuclidean" else 1.0 / n
    d = _judged(data, lambda s: (join([t[s[:, i]] for i, t in enumerate(tables)]) ** root,), [DISTANCE])
    return d.orderBy(DISTANCE, PK).limit(int(r.option("timesK", 5)) * r.k)


# ---- spectral hashing ----


def _bits(x: np.ndarray, meta: dict) -> np.ndarray:
    y = (x - meta["mean"]) @ meta["axes"].T
    phase = math.pi / 2 + (y[:, meta["which"]] - meta["low"][meta["which"]]) * meta["omega"]
    return np.sin(phase) > 0


def _pack(bits: np.ndarray) -> np.ndarray:
    n, w = bits.shape
    padded = np.zeros((n, -(-w // 64) * 64), bool)
    padded[:, :w] = bits
    return np.packbits(padded, axis=1).view(">i8").astype(np.int64)


def _build_sh(rows: DataFrame, vec: str, options: dict) -> tuple[dict, DataFrame]:
    sample = _sample(rows, vec, int(options.get("ntraining", 1000)))
    dims = sample.shape[1]
    nbits = int(options.get("nbits", 2 * dims))
    mean = sample.mean(axis=0)
    axes = np.linalg.svd(sample - mean, full_matrices=False)[2][: min(nbits, dims)]
    y = (sample - mean) @ axes.T
    # Without the outermost hundredths, which a few far vectors would stretch.
    low, high = np.quantile(y, 0.01, axis=0) - 1e-9, np.quantile(y, 0.99, axis=0) + 1e-9
    span = high - low
    modes = sorted((k * math.pi / span[i], i) for i in range(len(axes)) for k in range(1, max(2, math.ceil((nbits + 1) * span[i] / span.max()) + 1)))[:nbits]
    meta = {"mean": mean, "axes": axes, "low": low, "span": span, "omega": np.array([m for m, _ in modes]), "which": np.array([i for _, i in modes]), "radius": 0.1}
    return meta, _signatures(rows, vec, lambda x: _pack(_bits(x, meta)), "long")


def _jittered(q: np.ndarray, n: int, radius: float) -> np.ndarray:
    """The query and n copies of it, moved at random by up to `radius` in each dimension."""
    return np.vstack([q[None], q[None] + np.random.default_rng(SEED).uniform(-radius, radius, (n, len(q)))])


def _probe_sh(ix: Index, r: Ranking, data: DataFrame) -> DataFrame:
    q = np.asarray(r.query, float)
    codes = _pack(_bits(_jittered(q, int(r.option("numOfQ", 3)), ix.meta["radius"] * float(np.abs(q).mean())), ix.meta))
    terms = [F.bit_count(F.get("sig", i).bitwiseXOR(F.lit(int(w)))) for code in codes for i, w in enumerate(code)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return data.select("ap_id", total.cast("double").alias(DISTANCE)).orderBy(DISTANCE, PK).limit(int(r.option("timesK", 5)) * r.k)


# ---- locality-sensitive hashing ----


def _lsh_hash(x: np.ndarray, meta: dict) -> np.ndarray:
    """(rows, tables): the bucket of each table, never negative."""
    if meta["how"] == "hamming":
        h = (np.abs(x[:, meta["pick"]]) > D.TINY).astype(np.int64)
    else:
        h = np.floor((x @ meta["a"].reshape(-1, x.shape[1]).T).reshape(len(x), *meta["b"].shape) / meta["radius"] + meta["b"]).astype(np.int64)
    mixed = (h * meta["mix"][None]).sum(axis=2)
    return np.mod(mixed, meta["buckets"]).astype(np.int32)


def _build_lsh(rows: DataFrame, vec: str, options: dict, distance: str) -> tuple[dict, DataFrame]:
    d = D.find(distance)
    if d.name not in ("manhattan", "euclidean", "squaredeuclidean", "hamming"):
        raise EngineError("hashing needs manhattan, euclidean or hamming")
    sample = _sample(rows, vec, int(options.get("ntraining", 500)))
    dims = sample.shape[1]
    tables, hashes = int(options.get("nhashtables", 64)), int(options.get("nhashes", 4))
    rng = np.random.default_rng(SEED)
    order = 1 if d.name == "manhattan" else 2
    gaps = [np.linalg.norm(sample[: min(200, len(sample))] - x, ord=order, axis=1).max() for x in sample[: min(200, len(sample))]]
    meta = {
        "how": d.name, "buckets": int(options.get("nbuckets", 2 if d.name == "hamming" else 1 << 20)), "radius": max(1e-9, float(np.mean(gaps)) * float(options.get("width", 0.5))),
        "mix": rng.integers(1, 1 << 20, (tables, hashes)),
    }
    if d.name == "hamming":
        meta["pick"] = rng.integers(0, dims, (tables, hashes))
    else:
        meta["a"] = rng.standard_cauchy((tables, hashes, dims)) if order == 1 else rng.standard_normal((tables, hashes, dims))
        meta["b"] = rng.random((tables, hashes))
    return meta, _signatures(rows, vec, lambda x: _lsh_hash(x, meta))


def _probe_lsh(ix: Index, r: Ranking, data: DataFrame) -> DataFrame:
    """Rows that share a bucket of the same table with the query or a moved copy; all at distance 0."""
    q = np.asarray(r.query, float)
    n = int(r.option("numOfQ", 3))
    hit = _lsh_hash(_jittered(q, n, 0.05 * ix.meta["radius"] / math.sqrt(len(q))), ix.meta)
    pairs = sorted({(t, int(b)) for row in hit for t, b in enumerate(row)})
    keys = F.array(*[F.lit(t * (1 << 32) + b) for t, b in pairs])
    own = F.transform("sig", lambda b, t: t.cast("long") * F.lit(1 << 32) + b.cast("long"))
    return data.filter(F.arrays_overlap(own, keys)).select("ap_id", F.lit(0.0).alias(DISTANCE))


# ---- cluster pruning ----


def pairwise(name: str, q: np.ndarray, v: np.ndarray, **options) -> np.ndarray:
    """numpy form of the distances, for leaders and references: (rows of q, rows of v)."""
    d = D.find(name, **options)
    n = D.exponent(d)
    if n == 2.0:
        s = np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * q @ v.T, 0)
        return s if d.name == "squaredeuclidean" else np.sqrt(s)
    if d.name in ("cosine", "correlation"):
        if d.name == "correlation":
            q, v = q - q.mean(axis=1, keepdims=True), v - v.mean(axis=1, keepdims=True)
        nq, nv = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
        flat = (nq[:, None] < D.TINY) | (nv[None] < D.TINY)
        return np.where(flat, 0.0, 1 - (q @ v.T) / np.where(flat, 1.0, nq[:, None] * nv[None]))
    out = np.empty((len(q), len(v)))
    for i, a in enumerate(q):
        x = a[None] - v
        if n is not None:
            out[i] = np.abs(x).max(axis=1) if math.isinf(n) else (np.abs(x) ** n).sum(axis=1) ** (1 / n)
        elif d.name == "hamming":
            out[i] = (np.abs(x) > D.TINY).sum(axis=1)
        elif d.name == "chisquared":
            t = a[None] + v
            out[i] = np.where(t > 0, x * x / np.where(t > 0, t, 1), 0).sum(axis=1)
        elif d.name == "jaccard":
            out[i] = 1 - np.minimum(a, v).sum(axis=1) / np.maximum(a, v).sum(axis=1)
        elif d.name == "spannorm":
            out[i] = x.max(axis=1) - x.min(axis=1)
        else:
            raise EngineError(f"{d.name} has no leaders")
    return out


def _build_ecp(rows: DataFrame, vec: str, options: dict, distance: str) -> tuple[dict, DataFrame]:
    n = rows.count()
    leaders = _sample(rows, vec, int(options.get("nleaders", options.get("ntraining", max(1, min(MOST_LEADERS, math.isqrt(n)))))))

    def assign(x: np.ndarray) -> np.ndarray:
        return np.concatenate([pairwise(distance, x[i : i + 1000], leaders).argmin(axis=1) for i in range(0, len(x), 1000)])[:, None].astype(np.int32)

    data = _signatures(rows, vec, assign)
    if options.get("leadertype", "simple") == "centroid":
        for c, n, mean in _means(rows, vec, assign, len(leaders)):
            leaders[c] = mean / n
    counts = {r["c"]: r["n"] for r in data.groupBy(F.get("sig", 0).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"leaders": leaders, "counts": np.array([counts.get(i, 0) for i in range(len(leaders))])}, data


def _means(rows: DataFrame, vec: str, assign: Callable[[np.ndarray], np.ndarray], n: int) -> list[tuple[int, int, np.ndarray]]:
    """(cluster, rows, sum of their vectors), summed in tasks and then by cluster."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, np.zeros(n, np.int64)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                c = assign(x)[:, 0]
                total = np.zeros((n, x.shape[1])) if total is None else total
                np.add.at(total, c, x)
                count += np.bincount(c, minlength=n)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held]), pa.array([total[c].tolist() for c in held], pa.list_(pa.float64()))], ["c", "n", "x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for c, k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                before = sums.get(c, (0, 0.0))
                sums[c] = (before[0] + k, before[1] + np.array(x))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([k for k, _ in sums.values()], pa.int64()), pa.array([x.tolist() for _, x in sums.values()], pa.list_(pa.float64()))], ["c", "n", "x"])

    kind = "c long, n long, x array<double>"
    source = rows.filter(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(F.col(vec).cast("array<double>"))
    t = _few_tasks(source).mapInArrow(partial, kind).repartition("c").mapInArrow(add, kind).toArrow()
    return [(c, k, np.array(x)) for c, k, x in zip(*(col.to_pylist() for col in t.columns))]


def _probe_ecp(ix: Index, r: Ranking, data: DataFrame) -> DataFrame:
    """Clusters by their leader's distance until they hold timesK * k rows, and one more."""
    d = pairwise(r.distance, np.asarray([r.query], float), ix.meta["leaders"], **dict(r.options))[0]
    order = np.argsort(d, kind="stable")
    held = np.cumsum(ix.meta["counts"][order])
    take = order[: int(np.searchsorted(held, int(r.option("timesK", 5)) * r.k)) + 2]
    c = F.get("sig", 0)
    at = F.array(*[F.lit(float(x)) for x in d])
    return data.filter(c.isin([int(i) for i in take])).select("ap_id", F.get(at, c).alias(DISTANCE))


# ---- metric inverted index ----


def _build_mi(rows: DataFrame, vec: str, options: dict, distance: str) -> tuple[dict, DataFrame]:
    n = rows.count()
    refs = _sample(rows, vec, int(options.get("nrefs", min(200, math.ceil(2 * math.sqrt(n))))))
    ki = min(int(options.get("ki", 100)), len(refs))

    def nearest(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argsort(pairwise(distance, x[i : i + 1000], refs), axis=1, kind="stable")[:, :ki] for i in range(0, len(x), 1000)]).astype(np.int32)

    return {"refs": refs, "ki": ki, "ks": min(int(options.get("ks", 50)), ki)}, _signatures(rows, vec, nearest)


def _probe_mi(ix: Index, r: Ranking, data: DataFrame) -> DataFrame:
    """Spearman's footrule over the query's nearest references; one that a row lacks is at ki + 1."""
    ki, ks, n_refs = ix.meta["ki"], ix.meta["ks"], len(ix.meta["refs"])
    own = np.argsort(pairwise(r.distance, np.asarray([r.query], float), ix.meta["refs"], **dict(r.options))[0], kind="stable")[:ks]

    def judge(sig: np.ndarray) -> tuple[np.ndarray]:
        place = np.full((len(sig), n_refs), ki + 1)
        np.put_along_axis(place, sig, np.broadcast_to(np.arange(1, sig.shape[1] + 1), sig.shape), axis=1)
        return (np.abs(place[:, own] - np.arange(1, len(own) + 1)).sum(axis=1),)

    return _judged(data, judge, [DISTANCE]).orderBy(DISTANCE, PK).limit(int(r.option("timesK", 5)) * r.k)


_PROBE = {"vaf": _probe_va, "vav": _probe_va, "vap": _probe_va, "pq": _probe_pq, "sh": _probe_sh, "lsh": _probe_lsh, "ecp": _probe_ecp, "mi": _probe_mi}


def build(kind: str, rows: DataFrame, attribute: str, distance: str = "euclidean", name: str | None = None, entity: str = "", minimum: int = MINIMUM_ROWS, **options) -> Index:
    """Fits an index of `kind` and encodes every row (ap_id, attribute) that has a vector."""
    if kind not in KINDS:
        raise EngineError(f"unknown index type {kind!r}")
    if rows.filter(F.col(attribute).isNotNull()).limit(minimum).count() < minimum:
        raise EngineError(f"an index needs at least {minimum} tuples")
    if kind in ("vaf", "vav", "vap", "pq") and D.exponent(D.find(distance)) is None:
        raise EngineError(f"{kind} needs a Minkowski distance")
    if kind in ("vaf", "vav", "vap"):
        meta, data = _build_va(kind, rows, attribute, options)
    elif kind == "pq":
        meta, data = _build_pq(rows, attribute, options)
    elif kind == "sh":
        meta, data = _build_sh(rows, attribute, options)
    elif kind == "lsh":
        meta, data = _build_lsh(rows, attribute, options, distance)
    elif kind == "ecp":
        meta, data = _build_ecp(rows, attribute, options, distance)
    else:
        meta, data = _build_mi(rows, attribute, options, distance)
    return Index(name or f"{entity}_{attribute}_{kind}_0", entity, attribute, kind, distance, meta, data, options)


def candidates(ix: Index, r: Ranking, prefilter: DataFrame | None = None) -> DataFrame:
    """(ap_id, ap_distance) of the index alone; `r.partitions` and `prefilter` restrict what is probed."""
    if not ix.conforms(r):
        raise EngineError(f"index {ix.name} does not answer this ranking")
    data = ix.data
    if r.partitions is not None and "part" in data.columns:
        data = data.filter(F.col("part").isin(sorted(r.partitions)))
    if prefilter is not None:
        data = data.join(prefilter.select(PK).distinct(), PK, "left_semi")
    return _PROBE[ix.kind](ix, r, data)
