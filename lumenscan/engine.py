"""The engine: a catalog of entities and indexes, and the queries over them."""

from __future__ import annotations

import json
import pickle
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import replace
from functools import reduce
from threading import RLock

import numpy as np
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenscan import model as M
from lumenscan.functions.distance import to_sparse
from lumenscan.functions.names import clean_name
from lumenscan.operators import basic, indexes, random_data, textsearch
from lumenscan.plans import planner
from lumenscan.plans.parser import parse
from lumenscan.runtime import delete_path, materialise, path_bytes, scratch_path
from lumenscan.sources import stores
from lumenscan.sources.importers import export, import_files
from lumenscan.sources.parquet_blocks import open_fs
from lumenscan.types import DISTANCE, PK, SOURCE, SPARK_TYPES, Attribute, EngineError, check_attributes, kind_of

VACUUM_AFTER = 100
#: A rewritten entity has files of about this size.
FILE_BYTES = 128 << 20
CACHE_ENTRIES, CACHE_SECONDS = 1000, 3600


class Engine:
    """Entities, indexes and queries under one folder.

    Tables are immutable versions; a write that replaces data goes to a new
    version and then switches the catalog, so a failed write leaves the old one.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, minimum_index_rows: int = indexes.MINIMUM_ROWS):
        self.spark = spark
        self.root = root or scratch_path(spark, "engine")
        self.minimum = minimum_index_rows
        self.entities: dict[str, dict] = {}
        self.attached: dict[str, DataFrame] = {}
        self.indexes: dict[str, indexes.Index] = {}
        self.results: OrderedDict[str, tuple[float, DataFrame]] = OrderedDict()
        self.lock = RLock()
        self.scorer: Callable | None = None
        self.log: list[tuple[float, M.Node]] = []

    # ---- definition ----

    def attach(self, name: str, df: DataFrame, pk: str) -> str:
        """A table that is already there becomes a read-only entity; pk is its id."""
        name = clean_name(name)
        self.attached[name] = df if pk == PK else df.withColumn(PK, F.col(pk).cast("long"))
        return name

    def create_entity(self, name: str, attributes: Sequence[Attribute], if_not_exists: bool = False) -> str:
        name = clean_name(name)
        if self.exists(name):
            if if_not_exists:
                return name
            raise EngineError(f"entity {name} exists")
        if not name:
            raise EngineError("empty entity name")
        check_attributes(list(attributes))
        with self.lock:
            self.entities[name] = {"attributes": list(attributes), "version": 0, "batch": 0, "batches": [], "stream": -1, "dims": {}}
        return name

    def list_entities(self) -> list[str]:
        return sorted([*self.entities, *self.attached])

    def exists(self, name: str) -> bool:
        return clean_name(name) in self.entities or clean_name(name) in self.attached

    def _entry(self, name: str) -> dict:
        name = clean_name(name)
        if name not in self.entities:
            raise EngineError(f"entity {name} {'is read-only' if name in self.attached else 'does not exist'}")
        return self.entities[name]

    def attributes(self, name: str) -> list[Attribute]:
        name = clean_name(name)
        if name in self.attached:
            return [Attribute(f.name, kind_of(f.dataType)) for f in self.attached[name].schema if f.name != PK and not isinstance(f.dataType, (T.TimestampType, T.DateType))]
        return self._entry(name)["attributes"]

    def _path(self, name: str, engine: str, version: int, batch: int | None = None) -> str:
        """The folder of a version of an entity in a store, or of one batch in it."""
        whole = f"{self.root}/{name}/{engine}-{version}"
        return whole if batch is None else f"{whole}/b{batch:07d}"

    def _schema(self, attributes: Sequence[Attribute]) -> T.StructType:
        return T.StructType([T.StructField(PK, T.LongType()), *[T.StructField(a.name, a.spark) for a in attributes]])

    def _by_engine(self, e: dict) -> dict[str, list[Attribute]]:
        out: dict[str, list[Attribute]] = {}
        for a in e["attributes"]:
            out.setdefault(a.engine, []).append(a)
        return out

    def table(self, name: str, predicates: Sequence[M.Predicate] = ()) -> DataFrame:
        """The entity as a lazy DataFrame; attributes in several stores are joined by id."""
        name = clean_name(name)
        if name in self.attached:
            return basic.where(self.attached[name], predicates)
        e = self._entry(name)
        if not e["batches"]:
            return self.spark.createDataFrame([], self._schema(e["attributes"]))
        parts = [stores.read(self.spark, g, [self._path(name, g, e["version"], b) for b in e["batches"]], self._schema(a)) for g, a in self._by_engine(e).items()]
        df = reduce(lambda a, b: a.join(b, PK), parts)
        return basic.where(df.select(PK, *[a.name for a in e["attributes"]]), predicates)

    # ---- data ----

    def insert(self, name: str, rows: DataFrame, stream_batch: int | None = None) -> int:
        """Appends rows under new ids; 1 if they were written, 0 if it is a batch of a stream that is there already.

        Auto attributes equal the id and may not be given. The rows of an
        insert lie in folders of their own; they count from when a note of the
        batch, with its number in the stream, is written after them, so a
        failed insert leaves nothing and can be repeated.
        """
        name = clean_name(name)
        with self.lock:
            e = self._entry(name)
            if stream_batch is not None and stream_batch <= e["stream"]:
                return 0
            auto = [a.name for a in e["attributes"] if a.kind == "auto"]
            given = {clean_name(c): c for c in rows.columns}
            if set(auto) & set(given):
                raise EngineError("auto attributes are filled by the engine")
            missing = [a.name for a in e["attributes"] if a.kind != "auto" and a.name not in given]
            if missing:
                raise EngineError(f"missing attributes {missing}")
            made = rows.select(*[F.col(f"`{given[a.name]}`").cast(a.spark).alias(a.name) for a in e["attributes"] if a.kind != "auto"])
            batch = e["batch"] + 1
            made = basic.tuple_ids(made, batch)  # written once: every store gets the same ids
            dims = self._check_dims(e, made)
            self._check_unique(name, e, made)
            made = made.withColumns({a: F.col(PK) for a in auto}) if auto else made
            self._write(name, e, e["attributes"], made, e["version"], batch)
            self._note(name, e["version"], batch, stream_batch)
            e["batch"], e["batches"], e["dims"] = batch, [*e["batches"], batch], dims
            if stream_batch is not None:
                e["stream"] = stream_batch
            self._stale(name)
            if len(e["batches"]) > VACUUM_AFTER:
                self.vacuum(name)
        return 1

    def _write(self, name: str, e: dict, attributes: Sequence[Attribute], df: DataFrame, version: int, batch: int) -> None:
        """One batch to all stores of these attributes; `indexed` attributes order the rows of a file, so that scans can skip."""
        for g, attrs in self._by_engine({"attributes": attributes}).items():
            part = df.select(PK, *[a.name for a in attrs])
            order = [a.name for a in attrs if a.params.get("indexed") or a.params.get("pk")]
            stores.write(part.sortWithinPartitions(*order) if order else part, g, self._path(name, g, version, batch), "overwrite")

    def _note(self, name: str, version: int, batch: int, stream: int | None) -> None:
        fs, path = open_fs(f"{self.root}/{name}/notes-{version}")
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{batch:07d}.json") as f:
            f.write(json.dumps({"batch": batch, "stream": stream}).encode())

    def _recover(self, name: str) -> None:
        """Batches that were noted after the catalog was saved."""
        e = self.entities[name]
        fs, path = open_fs(f"{self.root}/{name}/notes-{e['version']}")
        for info in fs.get_file_info(FileSelector(path, allow_not_found=True)):
            if info.base_name.endswith(".json") and not info.base_name.startswith("."):
                with fs.open_input_stream(info.path) as f:
                    note = json.loads(f.read())
                if note["batch"] not in e["batches"]:
                    e["batches"] = sorted([*e["batches"], note["batch"]])
                e["batch"] = max(e["batch"], note["batch"])
                if note["stream"] is not None:
                    e["stream"] = max(e["stream"], note["stream"])

    def _check_unique(self, name: str, e: dict, rows: DataFrame) -> None:
        """Values of pk and unique attributes stand once, in the rows and in the entity; only pk may not be null."""
        for a in e["attributes"]:
            if not (a.params.get("pk") or a.params.get("unique")) or a.kind == "auto":
                continue
            values = rows.select(a.name)
            if a.params.get("pk") and not values.filter(F.col(a.name).isNull()).isEmpty():
                raise EngineError(f"{a.name} may not be null")
            values = values.filter(F.col(a.name).isNotNull())
            twice = values.groupBy(a.name).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
            if not twice.isEmpty() or (e["batches"] and not values.join(self.table(name).select(a.name), a.name, "left_semi").isEmpty()):
                raise EngineError(f"values of {a.name} are not unique")

    def _check_dims(self, e: dict, rows: DataFrame) -> dict:
        """The width of a vector attribute is learnt from the first rows and then enforced; gives the widths known now."""
        dims = dict(e["dims"])
        for a in e["attributes"]:
            if a.kind == "vector":
                low, high = rows.agg(F.min(F.size(a.name)), F.max(F.size(a.name))).first()
                if high is None or high < 0:
                    continue
                n = dims.setdefault(a.name, high)
                if high != n or (low not in (n, -1, None)):
                    raise EngineError(f"vectors of {a.name} have {n} dimensions")
        return dims

    def _replace(self, name: str, df: DataFrame, attributes: Sequence[Attribute] | None = None) -> None:
        """A new version of an entity in one batch. The catalog changes when it is written; then the old one goes."""
        e = self._entry(name)
        after = list(attributes or e["attributes"])
        old, new, before = e["version"], e["version"] + 1, self._by_engine(e)
        self._write(name, e, after, df, new, e["batch"])
        self._note(name, new, e["batch"], e["stream"])
        e["attributes"], e["version"], e["batches"] = after, new, [e["batch"]]
        for g in before:
            delete_path(self.spark, self._path(name, g, old))
        delete_path(self.spark, f"{self.root}/{name}/notes-{old}")

    def _bytes(self, name: str) -> int:
        e = self._entry(name)
        return sum(path_bytes(self.spark, self._path(name, g, e["version"])) for g in self._by_engine(e))

    def delete(self, name: str, predicates: Sequence[M.Predicate]) -> int:
        """Deletes rows for which any predicate holds (a query wants all); gives their number."""
        if not predicates:
            return 0
        with self.lock:
            df = self.table(name)
            hit = F.coalesce(reduce(lambda a, b: a | b, (F.coalesce(basic.condition(p), F.lit(False)) for p in predicates)), F.lit(False))
            n = df.filter(hit).count()
            if n:
                self._replace(clean_name(name), df.filter(~hit))
                self._stale(clean_name(name))
        return n

    def vacuum(self, name: str, partitions: int | None = None) -> None:
        """Rewrites an entity in files of about FILE_BYTES, or in so many partitions."""
        name = clean_name(name)
        with self.lock:
            if self._entry(name)["batches"]:
                n = partitions or max(1, -(-self._bytes(name) // FILE_BYTES))
                self._replace(name, self.table(name).repartition(n, PK))

    def repartition(self, name: str, n: int, attribute: str | None = None, join: DataFrame | None = None) -> None:
        """Rewrites an entity by hash of an attribute; join adds columns to choose it from."""
        df = self.table(name)
        wide = df.join(join, PK) if join is not None else df
        self._replace(clean_name(name), wide.repartition(n, attribute or PK).select(df.columns))

    def sparsify(self, name: str, attribute: str) -> None:
        e = self._entry(name)
        df = self.table(name).withColumn(attribute, to_sparse(F.col(attribute)))
        with self.lock:
            self._replace(clean_name(name), df, [replace(a, kind="sparsevector") if a.name == attribute else a for a in e["attributes"]])

    def transfer(self, name: str, attributes: Sequence[str], engine: str) -> None:
        """Moves attributes to another store."""
        e, df = self._entry(name), self.table(name)
        wanted = {clean_name(a) for a in attributes}
        after = [replace(a, engine=engine) if a.name in wanted else a for a in e["attributes"]]
        check_attributes(after)
        with self.lock:
            self._replace(clean_name(name), df, after)

    def count(self, name: str) -> int:
        return self.table(name).count()

    def preview(self, name: str, k: int = 100) -> DataFrame:
        return self.table(name).limit(k)

    def cache(self, name: str) -> int:
        return self.table(name).persist().count()

    def properties(self, name: str, attribute: str | None = None) -> dict:
        if attribute:
            a = next(a for a in self.attributes(name) if a.name == clean_name(attribute))
            return {"name": a.name, "type": a.kind, "engine": a.engine, **a.params}
        df = self.table(name)
        parts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        return {"attributes": [a.name for a in self.attributes(name)], "indexes": self.list_indexes(name), "count": sum(r["n"] for r in parts), "partitions": len(parts)}

    def drop_entity(self, name: str, if_exists: bool = False) -> None:
        name = clean_name(name)
        if not self.exists(name):
            if if_exists:
                return
            raise EngineError(f"entity {name} does not exist")
        for ix in self.list_indexes(name):
            self.drop_index(ix[0])
        if self.attached.pop(name, None) is None:
            self.entities.pop(name)
            delete_path(self.spark, f"{self.root}/{name}")

    def generate(self, name: str, n: int, seed: int = 1, **options) -> None:
        self.insert(name, random_data.generate(self.spark, self.attributes(name), n, seed, **options))

    # ---- indexes ----

    def create_index(self, entity: str, attribute: str, kind: str, distance: str = "euclidean", **options) -> str:
        entity, attribute = clean_name(entity), clean_name(attribute)
        stem = f"{entity}_{attribute}_{kind}_"
        taken = [int(n[len(stem) :]) for n in self.indexes if n.startswith(stem) and n[len(stem) :].isdigit()]
        name = f"{stem}{max(taken, default=-1) + 1}"
        ix = indexes.build(kind, self.table(entity), attribute, distance, name, entity, self.minimum, **options)
        path = f"{self.root}/{entity}/index/{name}-{time.time_ns()}"
        ix.data.write.mode("overwrite").parquet(path)
        ix.data = self.spark.read.schema(ix.data.schema).parquet(path)
        ix.options = {**ix.options, "path": path}
        self.indexes[name] = ix
        return name

    def create_all_indexes(self, entity: str, attribute: str, distance: str = "euclidean", **options) -> list[str]:
        """One index of every kind that is not there; all are undone if one fails."""
        have = {ix.kind for ix in self.indexes.values() if ix.entity == clean_name(entity) and ix.attribute == clean_name(attribute)}
        made = []
        try:
            for kind in indexes.KINDS:
                if kind not in have:
                    made.append(self.create_index(entity, attribute, kind, distance, **options))
        except Exception:
            for name in made:
                self.drop_index(name)
            raise
        return made

    def list_indexes(self, entity: str | None = None) -> list[tuple[str, str, str]]:
        return [(ix.name, ix.attribute, ix.kind) for ix in self.indexes.values() if entity is None or ix.entity == clean_name(entity)]

    def index_exists(self, entity: str, attribute: str, kind: str, accept_stale: bool = False) -> bool:
        return any(
            ix.entity == clean_name(entity) and ix.attribute == clean_name(attribute) and ix.kind == kind and (accept_stale or not ix.stale) for ix in self.indexes.values()
        )

    def index(self, name: str) -> indexes.Index:
        if name not in self.indexes:
            raise EngineError(f"index {name} does not exist")
        return self.indexes[name]

    def index_properties(self, name: str) -> dict:
        ix = self.index(name)
        parts = ix.data.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        return {"kind": ix.kind, "stale": ix.stale, "confidence": ix.confidence, "lossy": ix.lossy, "tuples": {r["p"]: r["n"] for r in parts}}

    def cache_index(self, name: str) -> int:
        return self.index(name).data.persist().count()

    def drop_index(self, name: str) -> None:
        ix = self.index(name)
        ix.data.unpersist()
        del self.indexes[name]
        path = ix.options.get("path")
        if path and all(other.options.get("path") != path for other in self.indexes.values()):
            delete_path(self.spark, path)

    def save_index_meta(self, name: str) -> bytes:
        ix = self.index(name)
        return pickle.dumps({"kind": ix.kind, "meta": ix.meta, "options": ix.options})

    def _stale(self, name: str) -> None:
        for ix in self.indexes.values():
            if ix.entity == name:
                ix.stale = True

    def repartition_index(self, name: str, n: int, partitioner: str = "hash", attribute: str | None = None, join: DataFrame | None = None, mode: str = "replace", seed: int = 1) -> str:
        """Gives every row of an index a `part` of 0 .. n-1 and lays it out by it.

        hash: of the id or an attribute joined in; random; ecp: the part of the
        coarse leader nearest to the row's cluster leader. mode: replace, new
        (another index), temp (the data only lives in memory).
        """
        ix = self.index(name)
        data = ix.data.drop("part")
        if partitioner == "hash":
            wide = data.join(join, PK) if join is not None else data
            placed = wide.withColumn("part", F.pmod(F.xxhash64(attribute or PK), F.lit(n)).cast("int")).select(*data.columns, "part")
        elif partitioner == "random":
            placed = data.withColumn("part", F.floor(F.rand(seed) * n).cast("int"))
        elif partitioner == "ecp":
            placed = data.withColumn("part", F.get(F.array(*[F.lit(int(p)) for p in self._coarse(ix, n)]), F.get("sig", 0)))
        else:
            raise EngineError(f"unknown partitioner {partitioner!r}")
        placed = placed.repartition(n, "part")
        new = ix if mode == "replace" else replace(ix, name=f"{ix.name}_{mode}_{time.time_ns()}")
        if mode == "temp":
            new.data = placed.persist()
        else:
            path = f"{self.root}/{ix.entity}/index/{new.name}-{time.time_ns()}"
            placed.write.mode("overwrite").partitionBy("part").parquet(path)
            new.data = self.spark.read.schema(placed.schema).parquet(path)
        old = ix.options.get("path")
        new.options = {**ix.options, "partitioner": partitioner, "nparts": n, **({"path": path} if mode != "temp" else {})}
        if mode == "replace" and old:
            delete_path(self.spark, old)
        self.indexes[new.name] = new
        return new.name

    def _coarse(self, ix: indexes.Index, n: int) -> np.ndarray:
        if ix.kind != "ecp":
            raise EngineError("the ecp partitioner needs an ecp index")
        leaders = ix.meta["leaders"]
        coarse = leaders[np.random.default_rng(indexes.SEED).choice(len(leaders), min(n, len(leaders)), replace=False)]
        ix.meta["coarse"] = coarse
        return indexes.pairwise(ix.distance, leaders, coarse).argmin(axis=1)

    def choose_partitions(self, name: str, r: M.Ranking, skip: float, seed: int = 1) -> frozenset:
        """Which parts to keep if the share `skip` may be left out: those nearest to the query, else random ones.

        Without leaders the parts are of ids or drawn, so no part is nearer to a query than another.
        """
        ix = self.index(name)
        n = ix.options.get("nparts", 1)
        keep = max(1, round(n * (1 - skip)))
        if "coarse" in ix.meta:
            d = indexes.pairwise(r.distance, np.asarray([r.query], float), ix.meta["coarse"])[0]
            return frozenset(int(i) for i in np.argsort(d, kind="stable")[:keep])
        return frozenset(int(i) for i in np.random.default_rng(seed).permutation(n)[:keep])

    # ---- queries ----

    def query(self, q: M.Node | dict | str, levels: Sequence[str] = (), on_step: Callable[[M.Node, DataFrame], None] | None = None) -> DataFrame:
        """The result of a query tree or message, as one lazy plan.

        levels: `partition` and `source` add ap_partition and ap_source.
        on_step is called with every node and its DataFrame, innermost first.
        """
        node = q if isinstance(q, M.Node) else parse(q)
        self.log = [*self.log[-CACHE_ENTRIES + 1 :], (time.time(), node)]
        df = self._run(node, on_step, "source" in levels)
        return basic.with_partition(df) if "partition" in levels else df

    def _run(self, n: M.Node, on_step: Callable | None = None, source: bool = False) -> DataFrame:
        def run(x: M.Node) -> DataFrame:
            return self._run(x, on_step, source)

        label = type(n).__name__
        if isinstance(n, M.Scan):
            df = basic.where(self.table(n.entity), n.where)
            if n.prefilter is not None:
                df = basic.within(df, run(n.prefilter), n.filter_method, again=lambda: self.table(n.entity, n.where))
            out = basic.nearest(df, n.ranking) if n.ranking else df
            label = "sequential scan" if n.ranking else "filter"
        elif isinstance(n, M.IndexScan):
            out = self._index_scan(n, run)
            label = n.index
        elif isinstance(n, M.HintScan):
            out = run(self._planned(n))
        elif isinstance(n, M.StochasticScan):
            ranks = replace(n.ranking, k=n.ranking.k * 10, index_only=True)
            ixs = [self.index(i) for i in n.indexes]
            if len({ix.entity for ix in ixs}) != 1:
                raise EngineError("indexes of one entity are needed")
            voted = basic.vote([indexes.candidates(ix, ranks) for ix in ixs])
            out = voted.limit(n.ranking.k) if n.ranking.index_only else basic.nearest(basic.within(self.table(ixs[0].entity), voted), n.ranking)
        elif isinstance(n, M.SubQuery):
            df = run(n.source)
            needed = [p.attribute for p in n.where] + ([n.ranking.attribute] if n.ranking else [])
            if any(a not in df.columns for a in needed):
                entity = self._entity_of(n.source)
                df = basic.within(self.table(entity), df)
            df = basic.where(df, n.where)
            out = basic.nearest(df, n.ranking) if n.ranking else df
        elif isinstance(n, M.Combine):
            out = self._combine(n, run)
            label = n.how
        elif isinstance(n, M.Project):
            out = basic.project(run(n.source), n.attributes, n.op)
        elif isinstance(n, M.Timed):
            best = None
            for _, best in self.in_parallel(n.alternatives, n.seconds):
                pass
            if best is None:
                raise EngineError("no alternative was ready in time")
            out = best
        elif isinstance(n, M.External):
            out = self._external(n)
        elif isinstance(n, M.Cached):
            out = self._cached(n, run)
        elif isinstance(n, M.Empty):
            out = self.spark.createDataFrame([], f"{PK} long, {DISTANCE} double")
        else:
            raise EngineError(f"unknown query operator {label}")
        if source and SOURCE not in out.columns:
            out = out.withColumn(SOURCE, F.lit(label))
        if source and isinstance(n, M.Combine):
            out = self._with_source(n, out, label)
        if on_step:
            on_step(n, out)
        return out

    def _index_scan(self, n: M.IndexScan, run: Callable) -> DataFrame:
        ix = self.index(n.index)
        pre = None
        if n.where:
            pre = basic.where(self.table(ix.entity), n.where).select(PK)
        if n.prefilter is not None:
            other = run(n.prefilter).select(PK)
            pre = other if pre is None else basic.within(pre, other)
        r = n.ranking
        skip = r.option("skipPart")
        if skip is not None and r.partitions is None:
            r = replace(r, partitions=self.choose_partitions(n.index, r, float(skip)))
        found = indexes.candidates(ix, r, pre)
        if r.index_only:
            return found.orderBy(DISTANCE, PK).limit(r.k)
        return basic.nearest(basic.within(self.table(ix.entity), found), r)

    def _planned(self, n: M.HintScan) -> M.Node:
        if n.ranking is None:
            return M.Scan(n.entity, n.where)
        own = [ix for ix in self.indexes.values() if ix.entity == clean_name(n.entity)]
        got = planner.by_hints(n.hints, own, n.ranking, self.scorer)
        if got is None and n.fallback:
            got = planner.by_hints(planner.FALLBACK, own, n.ranking)
        if got is None:
            raise EngineError("no access path follows the hints")
        return M.Scan(n.entity, n.where, n.ranking) if got == "sequential" else M.IndexScan(got.name, n.ranking, n.where)

    def _entity_of(self, n: M.Node) -> str:
        if isinstance(n, (M.Scan, M.HintScan, M.External)):
            return n.entity
        if isinstance(n, M.IndexScan):
            return self.index(n.index).entity
        if isinstance(n, M.StochasticScan):
            return self.index(n.indexes[0]).entity
        if isinstance(n, M.Combine):
            return self._entity_of(n.left)
        if isinstance(n, (M.SubQuery, M.Project, M.Cached)):
            return self._entity_of(n.source)
        raise EngineError("the query has no single entity")

    def _label(self, n: M.Node) -> str:
        if isinstance(n, M.IndexScan):
            return n.index
        if isinstance(n, M.Combine):
            return n.how
        if isinstance(n, M.Scan):
            return "sequential scan" if n.ranking else "filter"
        return type(n).__name__

    def _with_source(self, n: M.Combine, out: DataFrame, label: str) -> DataFrame:
        """ap_source of a combination: a->b if one side went first, x UNION and the like, l FUZZYUNION r with x for a side that lacks the id."""
        if n.order != "parallel" and n.how != "union":
            first, second = (n.left, n.right) if n.order == "left" else (n.right, n.left)
            return out.withColumn(SOURCE, F.lit(f"{self._label(first)}->{self._label(second)}"))
        return out if n.how.startswith("fuzzy") else out.withColumn(SOURCE, F.lit(f"x {label.upper()}"))

    def _combine(self, n: M.Combine, run: Callable) -> DataFrame:
        left, right = run(n.left), run(n.right)
        how = "intersect" if n.how == "join" else n.how
        if n.order != "parallel" and how != "union":
            first, second = (left, right) if n.order == "left" else (right, left)
            return basic.sequenced(how, first, second)
        o = dict(n.options)
        if how.startswith("fuzzy"):
            return basic.fuzzy(left, right, how[5:], o.get("fuzzycombination", "outer"), float(o.get("fuzzydefault", 0.0)), o.get("fuzzy", "standard") == "standard", (self._label(n.left), self._label(n.right)))
        return {"union": basic.union, "intersect": basic.intersect, "except": basic.minus}[how](left, right)

    def _external(self, n: M.External) -> DataFrame:
        o, df = dict(n.params), self.table(n.entity)
        if n.handler in ("text", "solr"):
            found = textsearch.bm25(df, PK, o["attribute"], o["query"])
            return df.join(found, PK).orderBy(F.col("ap_score").desc(), PK).limit(int(o.get("limit") or 2**31 - 1))
        if n.handler in ("geo", "gis", "postgis"):
            return textsearch.geo_within(df, o["attribute"], float(o["lat"]), float(o["lng"]), float(o["metres"]))
        raise EngineError(f"unknown handler {n.handler!r}")

    def _cached(self, n: M.Cached, run: Callable) -> DataFrame:
        key = n.id or repr(n.source)
        hit = self.results.get(key)
        if n.use and hit and time.time() - hit[0] < CACHE_SECONDS:
            self.results.move_to_end(key)
            return hit[1]
        df = run(n.source)
        if n.put:
            self.results[key] = (time.time(), df.persist())
            while len(self.results) > CACHE_ENTRIES:
                self.results.popitem(last=False)[1][1].unpersist()
        return df

    def cached_result(self, key: str) -> DataFrame | None:
        hit = self.results.get(key)
        return hit[1] if hit and time.time() - hit[0] < CACHE_SECONDS else None

    # ---- convenience, paging, batches, parallel and timed runs ----

    def filter(self, entity: str, where: Sequence[M.Predicate] = ()) -> DataFrame:
        return self.query(M.Scan(entity, tuple(where)))

    def knn(self, entity: str, r: M.Ranking, where: Sequence[M.Predicate] = (), hint: str | None = None) -> DataFrame:
        return self.query(M.HintScan(entity, tuple(where), r, (hint,)) if hint else M.Scan(entity, tuple(where), r))

    def knn_index(self, index: str, r: M.Ranking, where: Sequence[M.Predicate] = ()) -> DataFrame:
        return self.query(M.IndexScan(index, r, tuple(where)))

    def iter_pages(self, q: M.Node | dict | str, size: int = 500, cap: int | None = 50_000) -> Iterator[list]:
        """Rows in pages; cap None gives all."""
        yield from basic.pages(self.query(q), size, cap)

    def run(self, q: M.Node | dict | str, query_id: str) -> DataFrame:
        """Runs a query to its end under an id by which stop() can end it; gives the stored result."""
        self.spark.sparkContext.addJobTag(query_id)
        try:
            return materialise(self.query(q), "result")
        finally:
            self.spark.sparkContext.removeJobTag(query_id)

    def batch(self, qs: Sequence[M.Node | dict | str], at_once: int = 4) -> list[DataFrame]:
        """The stored results of several queries, so many run side by side; in the order given."""
        with ThreadPoolExecutor(max(1, at_once)) as pool:
            return list(pool.map(lambda i: self.run(qs[i], f"batch-{id(qs)}-{i}"), range(len(qs))))

    def paths(self, entity: str, r: M.Ranking, chooser: str = "simple", hints: Sequence[str] = (), names: Sequence[str] = (), where: Sequence[M.Predicate] = ()) -> list[M.Node]:
        """Access paths to run side by side; simple: the best of each kind, all, hints, kinds or names."""
        own = [ix for ix in self.indexes.values() if ix.entity == clean_name(entity) and ix.conforms(r) and not ix.stale]
        w = tuple(where)
        if chooser == "simple":
            own = list({ix.kind: ix for ix in sorted(own, key=lambda ix: ix.score)}.values())
        elif chooser == "kinds":
            own = [ix for ix in own if ix.kind in hints]
        elif chooser == "names":
            own = [ix for ix in own if ix.name in names]
        elif chooser == "hints":
            return list(dict.fromkeys(self._planned(M.HintScan(entity, w, r, (h,))) for h in hints))
        out: list[M.Node] = [M.IndexScan(ix.name, r, w) for ix in own]
        if chooser in ("simple", "all") and not r.index_only:
            out.append(M.Scan(entity, w, r))
        return list(dict.fromkeys(out))

    def _confidence(self, n: M.Node) -> float:
        n = self._planned(n) if isinstance(n, M.HintScan) else n
        return self.index(n.index).confidence if isinstance(n, M.IndexScan) else 1.0

    def in_parallel(self, nodes: Sequence[M.Node], seconds: float | None = None) -> Iterator[tuple[float, DataFrame]]:
        """(confidence, result) of each path as it gets ready, never worse than the one before.

        Results of k rows are held as local tables, others are stored. What
        still runs when one of full confidence is there, or time is up, is cancelled.
        """
        tag = f"paths-{time.time_ns()}"
        end = None if seconds is None else time.time() + seconds

        def work(n: M.Node) -> tuple[float, DataFrame]:
            self.spark.sparkContext.addJobTag(tag)
            try:
                df = self._run(n)
                small = getattr(n, "ranking", None) is not None  # k rows
                return self._confidence(n), self.spark.createDataFrame(df.collect(), df.schema) if small else materialise(df, "result")
            finally:
                self.spark.sparkContext.removeJobTag(tag)

        pool = ThreadPoolExecutor(max(1, len(nodes)))
        todo, best = {pool.submit(work, n) for n in dict.fromkeys(nodes)}, -1.0
        try:
            while todo and best < 1.0:
                left = None if end is None else max(0.0, end - time.time())
                done, todo = wait(todo, left, FIRST_COMPLETED)
                if not done:
                    break
                for f in done:
                    if f.exception() is None and f.result()[0] > best:
                        best = f.result()[0]
                        yield f.result()
        finally:
            self.spark.sparkContext.cancelJobsWithTag(tag)
            pool.shutdown(wait=False, cancel_futures=True)

    def knn_parallel(self, entity: str, r: M.Ranking, where: Sequence[M.Predicate] = (), chooser: str = "simple", **kw) -> Iterator[tuple[float, DataFrame]]:
        yield from self.in_parallel(self.paths(entity, r, chooser, where=where, **kw))

    def knn_timed(self, entity: str, r: M.Ranking, seconds: float, where: Sequence[M.Predicate] = (), chooser: str = "simple", **kw) -> DataFrame | None:
        best = None
        for _, best in self.in_parallel(self.paths(entity, r, chooser, where=where, **kw), seconds):
            pass
        return best

    def progressive(self, q: M.Node | dict | str) -> Iterator[tuple[M.Node, DataFrame]]:
        """Every intermediate result of one plan, innermost first, each as soon as it is computed; later ones build on it."""
        steps: list[tuple[M.Node, DataFrame]] = []
        self.query(q, on_step=lambda n, df: steps.append((n, df)))
        held = []
        try:
            for n, df in steps:
                held.append(df.persist())
                df.count()
                yield n, df
        finally:
            for df in held:
                df.unpersist()

    def stop(self, query_id: str) -> None:
        """Ends the jobs of a query that runs under this id."""
        self.spark.sparkContext.cancelJobsWithTag(query_id)

    def stop_all(self) -> None:
        self.spark.sparkContext.cancelAllJobs()

    def ping(self) -> bool:
        return self.spark.range(1).count() == 1

    # ---- planner training ----

    def _training_rankings(self, entity: str, attribute: str, n: int, k: int, logged: bool) -> list[M.Ranking]:
        if logged:
            kept = [q.ranking for _, q in self.log if isinstance(q, (M.Scan, M.HintScan)) and q.ranking and clean_name(q.entity) == clean_name(entity)]
            return list(dict.fromkeys(r for r in kept if r.attribute == clean_name(attribute)))[-n:]
        rows = basic.sample_rows(self.table(entity).filter(F.col(attribute).isNotNull()).select(PK, attribute), n).collect()
        return [M.Ranking(clean_name(attribute), tuple(float(x) for x in r[attribute]), k) for r in rows]

    def train_planner(self, entity: str, attribute: str, n_queries: int = 3, k: int = 100, kind: str = "naive", runs: int = 2, logged: bool = False) -> dict[str, float]:
        """Measures every path on sampled vectors (or logged queries) and makes the planner choose by what it learnt."""
        models = {"naive": planner.NaiveScores, "svm": planner.OnlineSVR}
        model = models[kind]() if kind in models else planner.SparkRegression(self.spark, kind)
        n_rows, seen = self.count(entity), []
        for r in self._training_rankings(entity, attribute, n_queries, k, logged):
            truth = [x[0] for x in self.query(M.Scan(entity, (), r)).select(PK).collect()]
            for node in self.paths(entity, r, "all"):
                ix = self.index(node.index) if isinstance(node, M.IndexScan) else None
                name = ix.name if ix else "sequential"
                seen += planner.measure(name, planner.features(ix, r, n_rows), lambda n=node: [x[0] for x in self._run(n).select(PK).collect()], truth, runs)
        if not seen:
            return {}
        model.train(seen)
        self.scorer = lambda ix, r: model.score(ix.name if ix else "sequential", planner.features(ix, r, n_rows))
        return {m.path: model.score(m.path, m.features) for m in seen}

    def score_paths(self, entity: str, r: M.Ranking) -> list[tuple[str, float]]:
        own = [ix for ix in self.indexes.values() if ix.entity == clean_name(entity) and ix.conforms(r) and not ix.stale]
        score = self.scorer or (lambda ix, _: ix.score if ix else 0.5)
        return sorted(((ix.name if ix else "sequential", score(ix, r)) for ix in [None, *own]), key=lambda x: (-x[1], x[0]))

    # ---- catalog on disk, import and export, log ----

    def save(self) -> str:
        """Writes the catalog (entities, index metadata) beside the data; attached tables are not part of it."""
        fs, path = open_fs(self.root)
        fs.create_dir(path, recursive=True)
        ixs = {n: (replace(ix, data=None), ix.data.inputFiles()[:1], ix.data.schema.json()) for n, ix in self.indexes.items() if ix.entity in self.entities}
        with fs.open_output_stream(f"{path}/catalog.bin") as f:
            f.write(pickle.dumps({"entities": self.entities, "indexes": ixs, "minimum": self.minimum}))
        return f"{self.root}/catalog.bin"

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Engine:
        """The engine whose catalog was saved under root. Only open what you wrote: the catalog is a pickle."""
        fs, path = open_fs(root)
        with fs.open_input_stream(f"{path}/catalog.bin") as f:
            kept = pickle.loads(f.read())
        e = cls(spark, root, kept["minimum"])
        e.entities = kept["entities"]
        for name in e.entities:
            e._recover(name)
        for name, (ix, files, schema) in kept["indexes"].items():
            if files:
                folder = files[0].rsplit("/", 1)[0].split("/part=")[0]
                ix.data = spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(folder)
                e.indexes[name] = ix
        return e

    def export_data(self, name: str, path: str, fmt: str = "parquet") -> None:
        export(self.table(name), path, fmt)

    def import_data(self, name: str, path: str, fmt: str = "parquet") -> None:
        """Inserts the rows of a file that has the entity's attributes."""
        made = [a for a in self.attributes(name) if a.kind != "auto"]
        rows = import_files(self.spark, path, fmt, T.StructType([T.StructField(a.name, a.spark) for a in made]))
        self.insert(name, rows)

    def catalog(self) -> str:
        """The catalog as JSON."""
        e = {n: {"version": x["version"], "attributes": [[a.name, a.kind, a.engine] for a in x["attributes"]]} for n, x in self.entities.items()}
        return json.dumps({"entities": e, "attached": sorted(self.attached), "indexes": [list(x) for x in self.list_indexes()], "types": list(SPARK_TYPES)})
