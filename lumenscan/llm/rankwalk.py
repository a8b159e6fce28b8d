"""One ranking out of several differently-scaled scores.

A walk over the items of a query: from an item pick one of the scans, jump to
an item that this scan ranks at least as high, each with the same chance, and
now and then to any item. Only ranks matter, so no scan outweighs another by
its range. The stationary probability orders the items. A step needs, for
each scan, the sums of probability over rank, from the last rank up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenscan.functions.names import source_key
from lumenscan.llm.topn import oriented_results
from lumenscan.operators.skew import prefix_sum
from lumenscan.runtime import discard, materialise, materialise_bucketed

DAMPING = 0.85
#: Rounds between extrapolations, and the summed change of a query's last round at which it has converged.
CYCLE, TOLERANCE = 10, 1e-8
#: Far more cycles than any walk has taken; one that has not converged by then is an error, not a result.
MOST_CYCLES = 50
#: Results of a query that are solved in one task; larger queries take the same steps over blocks of ranks.
PACK_ROWS = 50_000
#: Ranks of a block of a large list, and results of small queries that are solved side by side.
BLOCK_ROWS = 20_000
#: Results of large queries that a partition holds at least.
PART_ROWS = 50_000

_OUT = "query_id string, ap_id long, stationarity double, scans int, listed int, worst_rank int"


def blend(gram: np.ndarray) -> np.ndarray:
    """Weights, summing to one, under which the last steps cancel best: reduced rank extrapolation.

    gram: inner products of the steps of a cycle.
    """
    top = gram.max()
    if not top:
        return np.full(len(gram), 1 / len(gram))
    g = np.linalg.solve(gram / top + 1e-14 * len(gram) * np.eye(len(gram)), np.ones(len(gram)))
    return g / g.sum()


def walks(query: np.ndarray, scan: np.ndarray, ids: np.ndarray, cost: np.ndarray, damping: float = DAMPING) -> tuple[np.ndarray, ...]:
    """The walks of several queries side by side, from their results: query and scan number, item id, cost.

    Gives (query, id, stationary probability, scans of the query, scans that
    list the item, worst rank), a row for each item. Ranks are by cost, ties to
    the smaller id. A scan that does not list an item sends it to any of the
    items it lists.
    """
    order = np.lexsort((ids, cost, scan, query))
    query, scan, ids = query[order], scan[order], ids[order]
    new = np.concatenate([[True], (query[1:] != query[:-1]) | (scan[1:] != scan[:-1])])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(query)))
    scan, owner = np.cumsum(new) - 1, query[first]  # lists are numbered through
    rank = np.arange(len(query)) - first[scan] + 1
    by_item = np.lexsort((ids, query))
    fresh = np.concatenate([[True], (query[by_item][1:] != query[by_item][:-1]) | (ids[by_item][1:] != ids[by_item][:-1])])
    item = np.empty(len(query), np.int64)
    item[by_item] = np.cumsum(fresh) - 1
    item_query, item_id = query[by_item][fresh], ids[by_item][fresh]
    names, start = np.unique(item_query, return_index=True)
    number = np.searchsorted(names, item_query)
    owner = np.searchsorted(names, owner)
    n, k = np.bincount(number), np.bincount(owner)
    n_item, k_item = n[number], k[number]
    listed, worst = np.bincount(item, minlength=len(item_id)), np.zeros(len(item_id), np.int64)
    np.maximum.at(worst, item, rank)

    def moved(p: np.ndarray) -> np.ndarray:
        upward = np.cumsum((p[item] / rank)[::-1])[::-1]
        beyond = np.append(upward, 0.0)[first + size]  # what lies after the list's last rank
        absent = (np.add.reduceat(p, start)[owner] - np.bincount(scan, p[item], minlength=len(first))) / size
        return damping * np.bincount(item, upward - beyond[scan] + absent[scan], minlength=len(p)) / k_item + (1 - damping) / n_item

    p = 1 / n_item
    for _ in range(MOST_CYCLES):
        path = [p]
        for _ in range(CYCLE):
            path.append(moved(path[-1]))
        steps = np.diff(path, axis=0)
        p = path[-1]
        open_ = np.add.reduceat(np.abs(steps[-1]), start) > TOLERANCE
        if not open_.any():
            return item_query, item_id, p, k_item, listed, worst
        gram = np.stack([np.add.reduceat(steps * step, start, axis=1) for step in steps])
        weights = np.array([blend(gram[:, :, q]) if open_[q] else np.zeros(CYCLE) for q in range(len(names))])
        ahead = np.maximum(np.einsum("ij,ji->i", weights[number], np.asarray(path[1:])), 0)
        total = np.add.reduceat(ahead, start)[number]
        p = np.where(open_[number], ahead / np.where(total > 0, total, 1), p)
    raise RuntimeError("a walk has not converged")


def _packed(batches: Iterator[pa.RecordBatch], damping: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column(1)
        off, fields = rows.offsets.to_numpy(), rows.values.flatten()
        source = fields[0].dictionary_encode().indices.fill_null(-1).to_numpy()
        ap_id, cost = fields[1].to_numpy(), fields[2].to_numpy()
        a = 0
        while a < batch.num_rows:
            z = max(a + 1, int(np.searchsorted(off, off[a] + BLOCK_ROWS, "right")) - 1)
            part = slice(off[a], off[z])
            query = np.repeat(np.arange(a, z), np.diff(off[a : z + 1]))
            out = walks(query, source[part], ap_id[part], cost[part], damping)
            kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0])), *[pa.array(c).cast(t) for c, t in zip(out[1:], kinds)]], ["query_id", "ap_id", "stationarity", "scans", "listed", "worst_rank"])
            a = z


def _ranked(results: DataFrame) -> DataFrame:
    """Adds rank within (query_id, ap_source) without a task per group: sort all rows, number them, subtract the group's start."""
    order = ["query_id", "ap_source", "cost", "ap_id"]
    numbered = prefix_sum(results.withColumn("_one", F.lit(1)), order, "_one", "_at")
    start = numbered.groupBy("query_id", "ap_source").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("size"))
    return numbered.join(start, ["query_id", "ap_source"]).withColumn("rank", F.col("_at") - F.col("_first") + 1).drop("_one", "_at", "_first")


def _distributed(results: DataFrame, damping: float) -> DataFrame:
    """The same walk for queries of any size.

    Ranks are cut into blocks of equal size; a round sums within blocks and
    adds the totals of the later blocks. Entries lie by item, as the state
    does, so a round shuffles them to their blocks and their flows back.
    """
    spark = results.sparkSession
    ranked = materialise(_ranked(results), "ranked")
    # As many partitions as the entries need: rounds are many and short.
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), ranked.count() // PART_ROWS))
    items = materialise(ranked.groupBy("query_id", "ap_id").agg(F.count(F.lit(1)).alias("listed"), F.max("rank").alias("worst_rank")).withColumn("item", F.monotonically_increasing_id()), "items")
    sizes = ranked.groupBy("query_id", "ap_source").agg(F.max("size").alias("s")).groupBy("query_id").agg(F.count(F.lit(1)).alias("k"))
    sizes = materialise(items.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).join(sizes, "query_id"), "sizes")
    scan = F.xxhash64("query_id", "ap_source").alias("scan")
    block = F.floor((F.col("rank") - 1) / BLOCK_ROWS).cast("int").alias("block")
    entries = ranked.join(items.select("query_id", "ap_id", "item"), ["query_id", "ap_id"]).select("item", scan, block, "rank", "size")
    entries = materialise_bucketed(entries, "item", "entries", buckets=n)
    state = materialise_bucketed(items.join(sizes, "query_id").select("item", "query_id", "n", "k", (1.0 / F.col("n")).alias("p"), F.array().cast("array<double>").alias("path")), "item", "walk", buckets=n)
    inside = W.partitionBy("scan", "block").orderBy(F.col("rank").desc()).rowsBetween(W.unboundedPreceding, 0)
    later = W.partitionBy("scan").orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("scan")

    def one_round(state: DataFrame) -> DataFrame:
        held = entries.join(state.select("item", "p"), "item").withColumn("share", F.col("p") / F.col("rank"))
        totals = held.groupBy("scan", "block").agg(F.sum("share").alias("t"), F.sum("p").alias("listed_p"), F.max("size").alias("size"))
        more = F.coalesce(F.sum("t").over(later), F.lit(0.0)) + (1 - F.sum("listed_p").over(whole)) / F.col("size")
        flows = held.withColumn("within", F.sum("share").over(inside)).join(totals.select("scan", "block", more.alias("more")), ["scan", "block"])
        flows = flows.select("item", (F.col("within") + F.col("more")).alias("flow")).repartition(n, "item").groupBy("item").agg(F.sum("flow").alias("flow"))
        new = damping * F.col("flow") / F.col("k") + (1 - damping) / F.col("n")
        return state.join(flows, "item").select("item", "query_id", "n", "k", new.alias("p"), F.array_append("path", F.col("p")).alias("path"))

    path = [F.col("path")[i] for i in range(CYCLE)] + [F.col("p")]
    steps = [path[i + 1] - path[i] for i in range(CYCLE)]
    products = [F.sum(steps[i] * steps[j]).alias(f"g{i}_{j}") for i in range(CYCLE) for j in range(i, CYCLE)]

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.stack([c.to_numpy() for c in b.columns[1:]], axis=1) if b.num_rows else np.empty((0, 1))
            out = []
            for row in values:
                gram = np.empty((CYCLE, CYCLE))
                at = np.triu_indices(CYCLE)
                gram[at] = row
                gram.T[at] = row
                out.append(blend(gram).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], ["query_id", "w"])

    for _ in range(MOST_CYCLES):
        for _ in range(CYCLE):
            step = materialise_bucketed(one_round(state), "item", "walk", buckets=n)
            discard(state)
            state = step
        change = state.groupBy("query_id").agg(F.sum(F.abs(steps[-1])).alias("c")).agg(F.max("c")).first()[0]
        if change is None or change <= TOLERANCE:
            break
        w = materialise(state.groupBy("query_id").agg(*products).mapInArrow(weights, "query_id string, w array<double>"), "weights")
        ahead = F.greatest(sum((F.col("w")[i] * path[i + 1] for i in range(1, CYCLE)), F.col("w")[0] * path[1]), F.lit(0.0))
        ahead = materialise(state.join(w, state["query_id"].eqNullSafe(w["query_id"])).select("item", state["query_id"], "n", "k", ahead.alias("x")), "ahead")
        total = ahead.groupBy("query_id").agg(F.sum("x").alias("t")).withColumnRenamed("query_id", "q")
        scaled = ahead.join(total, F.col("query_id").eqNullSafe(F.col("q"))).select("item", "query_id", "n", "k", (F.col("x") / F.col("t")).alias("p"), F.array().cast("array<double>").alias("path"))
        step = materialise_bucketed(scaled, "item", "walk", buckets=n)
        discard(state)
        discard(ahead)
        state = step
    else:
        raise RuntimeError("a walk has not converged")
    return items.join(state.select("item", "k", F.col("p").alias("stationarity")), "item").select(
        "query_id", "ap_id", "stationarity", F.col("k").cast("int").alias("scans"), F.col("listed").cast("int").alias("listed"), F.col("worst_rank").cast("int").alias("worst_rank")
    )


def answered_results(scans: DataFrame, details: DataFrame) -> DataFrame:
    """Results (query_id, ap_source, ap_id, cost) of scans with a confidence above 0.

    Repeated rows of a scan's details count once; one with such a confidence is enough.
    """
    c = F.col("confidence").cast("double")
    trusted = details.filter(c.isNotNull() & ~F.isnan(c) & (c > 0)).select("query_id", source_key(F.col("ap_source")).alias("ap_source")).distinct()
    return oriented_results(scans, details).join(trusted, ["query_id", "ap_source"], "left_semi")


def rank_items(results: DataFrame, damping: float = DAMPING, pack_rows: int = PACK_ROWS) -> DataFrame:
    """(query_id, ap_id, stationarity, scans, listed, worst_rank) for (query_id, ap_source, ap_id, cost).

    scans: lists of the query; listed: how many of them hold the item;
    worst_rank: its lowest place in those. One row per item; a query with one
    scan keeps that scan's order. Rows must be distinct by (query, scan, item),
    costs neither null nor NaN, an infinity is an ordinary cost. No rows give
    no rows.
    """
    results = materialise(results.select("query_id", "ap_source", "ap_id", "cost"), "results")
    sized = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    large = materialise(sized.filter(F.col("n") > pack_rows).select("query_id"), "large")
    some_large = not large.isEmpty()
    small = results.join(large, "query_id", "left_anti") if some_large else results
    packs = small.groupBy("query_id").agg(F.collect_list(F.struct("ap_source", "ap_id", "cost")).alias("rows"))
    out = packs.mapInArrow(lambda batches: _packed(batches, damping), _OUT)
    if some_large:
        out = out.union(_distributed(results.join(large, "query_id", "left_semi"), damping))
    return out
