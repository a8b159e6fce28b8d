"""Clusters of mutually similar vectors by Markov clustering.

The matrix of a similarity graph is squared, inflated and pruned in turn, as a
table of sparse entries that is joined with itself. Nothing flows between
connected components, so each settles by itself, and those of bounded size lie
together in a partition, where the join needs no shuffle; larger ones are
joined through shuffles on rows and columns. A column's attractors are the
rows it ends in; columns with common attractors are one cluster. A member's
flow is the sum of its row over its cluster: the strongest are the most
typical.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenscan.llm.graph import block_entries, blocks, both_ways, cell_forest, components, group_counts, large_components, runs, sketch, tile_edges, to_nodes
from lumenscan.runtime import discard, materialise, materialise_bucketed, release

INFLATION = 2.0
#: Entries below this share of their column's largest are dropped.
PRUNE = 1e-3
#: A component whose square differs by no more than this share of its largest entry has settled.
SETTLED = 1e-4
#: More rounds than any component has needed; one that has not settled by then is an error, not a result.
MAX_ROUNDS = 100

_TOGETHER = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def _joined_where_it_lies(spark: SparkSession) -> Iterator[None]:
    """Joins on (label, x) of tables that lie by label need no shuffle."""
    before = spark.conf.get(_TOGETHER)
    spark.conf.set(_TOGETHER, "false")
    try:
        yield
    finally:
        spark.conf.set(_TOGETHER, before)


def entries(edges: DataFrame) -> DataFrame:
    """(label, col, row, s, p) of a graph (label, u, v, s), u < v: both ways, with loops of weight one; p is the share of the column."""
    ways = both_ways(edges.select("u", "v", "label", "s")).select("label", F.col("u").alias("col"), F.col("v").alias("row"), "s")
    loops = ways.select("label", "col").distinct().select("label", "col", F.col("col").alias("row"), F.lit(1.0).alias("s"))
    return ways.union(loops).withColumn("p", F.col("s") / F.sum("s").over(W.partitionBy("label", "col")))


def markov_sparse(matrix: DataFrame, together: bool = True, inflation: float = INFLATION) -> DataFrame:
    """What is left of a matrix (label, col, row, p) of connected components when all have settled: its attractor rows.

    A round joins the rows of the table with its columns, sums, inflates and
    prunes; components that have settled leave. together: the components are
    of bounded size and the table lies in buckets of label; otherwise it lies
    by col, and rows and columns are shuffled. Both give the same numbers but
    for the order of sums.
    """
    key = "label" if together else "col"
    column, part = W.partitionBy("label", "col"), W.partitionBy("label")
    m, done = matrix.select("label", "col", "row", "p"), []
    with _joined_where_it_lies(matrix.sparkSession):
        for turn in range(MAX_ROUNDS):
            through = m.select("label", F.col("col").alias("mid"), F.col("row").alias("to"), F.col("p").alias("q"))
            flows = m.select("label", F.col("row").alias("mid"), "col", "p").join(through, ["label", "mid"])
            # The term of a flow through its own end holds the entry as it was (0 where the end attracts nothing, so its entry must go).
            old = F.max(F.when(F.col("mid") == F.col("to"), F.col("p")))
            square = flows.groupBy("label", "col", F.col("to").alias("row")).agg(F.sum(F.col("p") * F.col("q")).alias("x"), F.coalesce(old, F.lit(0.0)).alias("old"))
            change, peak = F.max(F.abs(F.col("x") - F.col("old"))), F.max("x")
            if together:
                inflated = square.withColumn("p", F.pow("x", inflation)).withColumn("top", F.max("p").over(column))
                inflated = inflated.withColumn("change", change.over(part)).withColumn("peak", peak.over(part))
            else:  # a component may be of any size
                square = materialise(square, "square")
                square = square.join(square.groupBy("label").agg(change.alias("change"), peak.alias("peak")), "label")
                inflated = square.withColumn("p", F.pow("x", inflation)).withColumn("top", F.max("p").over(column))
            normal = inflated.filter(F.col("p") >= PRUNE * F.col("top")).withColumn("p", F.col("p") / F.sum("p").over(column))
            step = normal.select("label", "col", "row", "p", (F.col("change") <= SETTLED * F.col("peak")).alias("settled"))
            step = materialise_bucketed(step, key, "mcl", placed=together)
            done.append(step.filter("settled").select("label", "col", "row", "p"))
            m = step.filter(~F.col("settled")).select("label", "col", "row", "p")
            if m.isEmpty():
                return reduce(DataFrame.union, done)
    raise RuntimeError(f"a component has not settled in {MAX_ROUNDS} rounds")


def settled_clusters(ends: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, x, link): clusters of settled entries, component by component, as rows (nid, cluster, flow), and after
    them the links (label, u, v, s) that lie within a cluster, as rows (u, v, s) marked as links."""
    rows = ends.select("label", F.lit(False).alias("link"), F.col("col").alias("a"), F.col("row").alias("b"), F.col("p").alias("x"))
    rows = rows.union(links.select("label", F.lit(True), "u", "v", "s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches):
            link, a, b, x = (t.column(c).to_numpy() for c in ("link", "a", "b", "x"))
            col, row, p = a[~link], b[~link], x[~link]
            nid, at = np.unique(np.concatenate([col, row]), return_inverse=True)
            c, r = at[: len(col)], at[len(col) :]
            low = np.arange(len(nid))
            while True:  # columns with a common attractor meet in their least node
                least = np.minimum(low[c], low[r])
                if (least == low[c]).all() and (least == low[r]).all():
                    break
                np.minimum.at(low, c, least)
                np.minimum.at(low, r, least)
            # The least attractor names the cluster.
            name = np.full(len(nid), len(nid))
            np.minimum.at(name, low[r], r)
            u, v = a[link], b[link]
            inside = low[np.searchsorted(nid, u)] == low[np.searchsorted(nid, v)]
            columns = [
                np.concatenate([nid, u[inside]]), np.concatenate([nid[name[low]], v[inside]]),
                np.concatenate([np.bincount(r, p, minlength=len(nid)), x[link][inside]]), np.arange(len(nid) + inside.sum()) >= len(nid),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(col) for col in columns], ["a", "b", "x", "link"])

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "label").sortWithinPartitions("label").mapInArrow(run, "a long, b long, x double, link boolean")


def settled_clusters_of_any_size(ends: DataFrame, links: DataFrame) -> DataFrame:
    """The same for components of any size, by joins."""
    ends = materialise(ends, "ends")
    near = components(ends.select(F.col("col").alias("u"), F.col("row").alias("v")))
    attractor = ends.join(near, ends["row"] == near["nid"]).groupBy(near["label"].alias("met")).agg(F.min("row").alias("cluster"))
    flow = ends.groupBy("row").agg(F.sum("p").alias("flow"))
    found = near.select("nid", F.col("label").alias("met")).join(attractor, "met").join(flow, F.col("nid") == F.col("row"), "left")
    found = materialise(found.select("nid", "cluster", F.coalesce("flow", F.lit(0.0)).alias("flow")), "clusters")
    u, v = found.select(F.col("nid").alias("u"), F.col("cluster").alias("cu")), found.select(F.col("nid").alias("v"), F.col("cluster").alias("cv"))
    kept = links.join(u, "u").join(v, "v").filter("cu = cv")
    rows = found.select(F.col("nid").alias("a"), F.col("cluster").alias("b"), F.col("flow").alias("x"), F.lit(False).alias("link"))
    return rows.union(kept.select("u", "v", "s", F.lit(True)))


def markov_clusters(vectors: DataFrame, threshold: float = 0.9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, links, members) of a collection (grp, id, vec, pos).

    clusters: nid, cluster, flow of every distinct vector that has a similar
    other; the rest are clusters of their own. links: u, v, s, u < v, the pairs
    of a cluster that reach threshold. members: nid, id, grp. Repeated rows
    count once, equal vectors are one nid with several members. An empty
    collection gives empty tables.
    """
    nodes, members = to_nodes(vectors)
    sketches = materialise(sketch(nodes, group_counts(nodes), threshold), "sketches")
    forest = materialise(cell_forest(sketches, threshold), "forest")
    discard(sketches)
    release(nodes.sparkSession)
    labels = materialise(components(forest), "components")
    discard(forest)
    release(nodes.sparkSession)
    small = materialise_bucketed(block_entries(blocks(labels, nodes), threshold), "label", "entries")
    release(nodes.sparkSession)
    links = small.filter("col < row").select("label", F.col("col").alias("u"), F.col("row").alias("v"), "s")
    found = materialise(settled_clusters(markov_sparse(small), links), "clusters")
    large = materialise(large_components(labels), "large")
    if not large.isEmpty():
        # Large components are compared whole too, in tiles.
        links = materialise(tile_edges(large, nodes, threshold), "links")
        matrix = materialise_bucketed(entries(links), "col", "entries")
        found = materialise(found.union(settled_clusters_of_any_size(markov_sparse(matrix, together=False), links)), "clusters")
    clusters = found.filter(~F.col("link")).select(F.col("a").alias("nid"), F.col("b").alias("cluster"), F.col("x").alias("flow"))
    return clusters, found.filter("link").select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("x").alias("s")), members


def all_clusters(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(grp, id, cluster, size, typical): one row per member of the collection.

    cluster is the smallest id of the cluster, size its number of ids, typical
    the rank of a member by flow (ties to the smaller id).
    """
    found, _, members = markov_clusters(vectors, threshold)
    base = members.join(found, "nid", "left").select(
        "grp", "id", F.coalesce("cluster", "nid").alias("c"), F.coalesce("flow", F.lit(1.0)).alias("flow")
    )
    sizes = base.groupBy("c").agg(F.min("id").alias("cluster"), F.count(F.lit(1)).alias("size"))
    w = W.partitionBy("c").orderBy(F.col("flow").desc(), "id")
    return base.join(sizes, "c").withColumn("typical", F.row_number().over(w)).select("grp", "id", "cluster", "size", "typical")


def similar_pairs(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(grp, id_a, id_b): every pair of different ids in one cluster that reaches threshold.

    Pairs come from the clusters; the cosine of the stored vectors, rounded to
    six decimals, is checked exactly. Copies of one vector are pairs too.
    """
    _, links, members = markov_clusters(vectors, threshold)
    ids = members.select("nid", "id", "grp")
    mates = links.select(F.col("u").alias("nid"), F.col("v").alias("mate"))
    across = (
        mates.join(ids, "nid").select("mate", "grp", F.col("id").alias("a"))
        .join(ids.select(F.col("nid").alias("mate"), F.col("id").alias("b")), "mate").select("grp", "a", "b")
    )
    copied = ids.groupBy("nid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("nid")
    twins = ids.join(copied, "nid")
    within = twins.select("nid", "grp", F.col("id").alias("a")).join(twins.select("nid", F.col("id").alias("b")), "nid").filter("a < b").select("grp", "a", "b")
    return across.union(within).filter("a <> b").select("grp", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
