"""The k most similar vectors, whatever their similarity, exactly: what the neighbour graph is measured against.

The vectors asked for are compared with one chunk of their group after
another: a chunk of bounded size is sent to every task, which keeps the best
of it for each of its vectors. The work is the product of both numbers;
nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenscan.llm.graph import to_nodes
from lumenscan.runtime import materialise, scratch_path

#: Vectors of a chunk, and vectors compared with it at once.
CHUNK, STEP = 32_768, 256
#: What single precision and rounding to six decimals may take from a cosine.
MARGIN = 1e-5


class Rows:
    """Unit vectors of a list column, dense or with positions."""

    def __init__(self, vec: pa.ListArray, pos: pa.ListArray):
        off = vec.offsets.to_numpy().astype(np.int64)
        values = vec.values.to_numpy(zero_copy_only=False).astype(np.float64)[off[0] : off[-1]]
        self.off, self.size = off - off[0], np.diff(off)
        which = np.repeat(np.arange(len(vec)), self.size)
        values = values / np.maximum.reduceat(np.abs(values), self.off[:-1])[which]
        self.values = values / np.sqrt(np.add.reduceat(values * values, self.off[:-1]))[which]
        self.pos = None
        if pos.null_count == 0:
            o = pos.offsets.to_numpy()
            self.pos = pos.values.to_numpy(zero_copy_only=False)[o[0] : o[-1]]
        else:
            self.unit = self.values.reshape(len(vec), -1)

    def __len__(self) -> int:
        return len(self.size)


class Chunk:
    """Vectors in order of their least id, ready to be compared with others."""

    def __init__(self, nids: np.ndarray, rows: Rows):
        self.nids, self.rows = nids, rows
        if rows.pos is None:
            self.single = np.ascontiguousarray(rows.unit.astype(np.float32).T)
        else:
            order = np.argsort(rows.pos, kind="stable")
            at = rows.pos[order]
            start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            which = np.repeat(np.arange(len(rows)), rows.size)[order]
            value = rows.values[order]
            self.postings = {int(at[a]): (which[a:z], value[a:z]) for a, z in zip(start, np.append(start[1:], len(at)))}

    def scores(self, x: Rows, a: int, z: int) -> np.ndarray:
        if x.pos is None:
            return x.unit[a:z].astype(np.float32) @ self.single
        out = np.zeros((z - a, len(self.nids)))
        for i in range(a, z):
            for p, v in zip(x.pos[x.off[i] : x.off[i + 1]].tolist(), x.values[x.off[i] : x.off[i + 1]]):
                if p in self.postings:
                    which, value = self.postings[p]
                    out[i - a, which] += v * value
        return out

    def best(self, x: Rows, a: int, z: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in the chunk, cosine) of the k best of every row; ties to the smaller place."""
        s = self.scores(x, a, z)
        n = s.shape[1]
        bound = np.full(z - a, -2.0)
        if n > k:
            # The k-th of the maxima of disjoint parts is no more than the k-th of all.
            parts = max(k, n // 32)
            folds = n // parts
            m = s[:, : folds * parts].reshape(z - a, folds, parts).max(axis=1)
            bound = np.partition(m, -k, axis=1)[:, -k] - MARGIN
        i, j = np.nonzero(s >= bound[:, None])
        c = s[i, j] if x.pos is not None else np.einsum("ij,ij->i", x.unit[a + i], self.rows.unit[j])
        c = np.round(c, 6)
        order = np.lexsort((j, -c, i))
        i, j, c = i[order], j[order], c[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        return a + i[rank < k], j[rank < k], c[rank < k]


def nearest_lists(vectors: DataFrame, k: int, wanted: DataFrame | None = None) -> DataFrame:
    """(grp, id, other, s, rank): the k most similar others of every id in its group, or of those in `wanted`.

    s is the cosine of the stored vectors rounded to six decimals; ties go to
    the smaller id. A list is shorter only where the group has fewer others.
    Vectors of different length in a group are not compared.
    """
    spark = vectors.sparkSession
    parted = vectors.withColumn("grp", F.to_json(F.struct("grp", F.when(F.col("pos").isNull(), F.size("vec")).otherwise(-1).alias("n"))))
    nodes, members = to_nodes(parted)
    asked, own = members, nodes
    if wanted is not None:
        ids = wanted.select("id", F.col("grp").alias("g")).distinct()
        asked = materialise(members.join(ids, (members["id"] == ids["id"]) & (F.get_json_object("grp", "$.grp") == ids["g"]), "left_semi"), "asked")
        own = materialise(nodes.join(asked.select("nid").distinct(), "nid", "left_semi"), "wanted")
    # Of equal vectors only the k + 1 smallest ids can be in anyone's list.
    smallest = F.row_number().over(W.partitionBy("nid").orderBy("id"))
    heads = materialise(members.withColumn("r", smallest).filter(F.col("r") <= k + 1), "heads")
    place = F.row_number().over(W.partitionBy("grp").orderBy("id"))
    placed = materialise(heads.filter("r = 1").withColumn("place", place).select("nid", "grp", "place", F.floor((F.col("place") - 1) / CHUNK).alias("chunk")), "placed")
    path = scratch_path(spark, "lists")
    schema = "nid long, near long, s double"
    spark.createDataFrame([], schema).write.parquet(path)
    for grp, chunk in sorted(tuple(r) for r in placed.select("grp", "chunk").distinct().collect()):
        inside = placed.filter((F.col("grp") == grp) & (F.col("chunk") == chunk)).select("nid", "place")
        t = nodes.join(inside, "nid").orderBy("place").select("nid", "vec", "pos").toArrow().combine_chunks()
        column = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns]
        column = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in column]
        shared = spark.sparkContext.broadcast(Chunk(column[0].to_numpy(), Rows(column[1], column[2])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            others = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                nids, rows = batch.column(0).to_numpy(), Rows(batch.column(1), batch.column(2))
                for a in range(0, len(rows), STEP):
                    i, j, s = others.best(rows, a, min(a + STEP, len(rows)), k + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(nids[i]), pa.array(others.nids[j]), pa.array(s)], ["nid", "near", "s"])

        own.filter(F.col("grp") == grp).select("nid", "vec", "pos").mapInArrow(run, schema).write.mode("append").parquet(path)
        shared.destroy()
    lists = spark.read.schema(schema).parquet(path)
    ids = heads.select(F.col("nid").alias("near"), F.col("id").alias("other"))
    order = F.row_number().over(W.partitionBy("nid").orderBy(F.col("s").desc(), "other"))
    best = lists.join(ids, "near").withColumn("p", order).filter(F.col("p") <= k + 1).select("nid", "other", "s")
    each = asked.join(best, "nid").filter("id <> other")
    rank = F.row_number().over(W.partitionBy("grp", "id").orderBy(F.col("s").desc(), "other"))
    out = each.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select(F.get_json_object("grp", "$.grp").alias("grp"), "id", "other", "s", "rank")
