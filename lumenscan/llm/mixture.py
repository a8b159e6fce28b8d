"""Mixing sources to target shares of all tokens, in whole documents.

The documents of a source are put in a pseudorandom order and packed into
blocks of about equal numbers of tokens. Each output shard draws how many of
its slots go to which source; slot i of a source maps to a block through a
pseudorandom permutation of the block numbers, a new one each time the source
has been gone through, at most max_repeats times. Slots join blocks by number.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.functions.names import document_source_key
from lumenscan.operators.skew import prefix_sum
from lumenscan.runtime import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text before merging, as the public byte-level vocabulary was made for.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_TOKENS = 4096
SHARD_SLOTS = 256
SEED = 20

_encoder: dict = {}


def _load(path: str):
    if path not in _encoder:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoder[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoder[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens): sizes of whole texts in tokens of a public tokenizer, whose file is sent to the workers.

    source is compared trimmed, in lower case, '-' equal to '_'; a null source
    stays null. Null and empty texts have no tokens.
    """

    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = tokenizer.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _load(SparkFiles.get(name))
        for b in batches:
            n = [len(encoder.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    rows = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", document_source_key(F.col("source")).alias("source"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, tokens long")


def packed(counts: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """(source, block, doc_id, tokens): a document belongs to the block in which it begins.

    Sources are cut by a running total over the whole table, so one source
    with most of the rows is spread like any other.
    """
    rows = counts.filter(F.col("source").isNotNull() & (F.col("tokens") > 0)).withColumn("_turn", F.xxhash64("doc_id", F.lit(seed)))
    total = materialise(prefix_sum(rows, ["source", "_turn", "doc_id"], "tokens", "_at"), "packed")
    first = total.groupBy("source").agg(F.min("_at").alias("_first"))
    block = F.floor((F.col("_at") - F.col("_first")) / block_tokens)
    return total.join(F.broadcast(first), "source").select("source", block.alias("block"), "doc_id", "tokens")


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size-1 for each key, by a Feistel network that walks until it is in range."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for turn in range(4):
            mixed = (right + np.uint64(turn * 0x9E3779B9)) * np.uint64(0xFF51AFD7ED558CCD) + key[todo].astype(np.uint64)
            mixed ^= mixed >> np.uint64(33)
            mixed *= np.uint64(0xC4CEB9FE1A85EC53)
            mixed ^= mixed >> np.uint64(29)
            left, right = right, left ^ (mixed & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _plan(blocks: DataFrame, targets: DataFrame, total_tokens: int | None, block_tokens: int) -> tuple[pd.DataFrame, int]:
    """One row per source that has documents or a target, and the number of slots.

    Sources are few (a row each in the table of targets), so this is a driver-side table.
    """
    key = document_source_key(F.col("source"))
    wanted = targets.filter(F.col("source").isNotNull()).groupBy(key.alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    held = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), (F.max("block") + 1).alias("blocks"))
    t = wanted.join(held, "source", "full_outer").toPandas().sort_values("source").reset_index(drop=True)
    t["share"] = t["share"].astype(float).fillna(0.0).clip(lower=0.0)
    t["repeats"] = t["repeats"].astype(float).fillna(1).clip(lower=0).astype(np.int64)
    for c in ("tokens", "documents", "blocks"):
        t[c] = t[c].astype(float).fillna(0).astype(np.int64)
    can = t[(t["share"] > 0) & (t["tokens"] > 0)]
    if total_tokens is None:
        total_tokens = int((can["tokens"] * can["repeats"] / can["share"]).min()) if len(can) else 0
    return t, int(round(total_tokens / block_tokens))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, tokenizer: str = TOKENIZER, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(draws, report).

    draws: (shard, slot, source, block, round, doc_id, tokens), one row each
    time a document is drawn, whole and at most max_repeats times. report: for
    every source with documents or a target its tokens, target_share,
    max_repeats, drawn tokens, actual_share of all that is drawn, how often its
    tokens are used (repeats, a part if below one) and missing_tokens against
    its target.

    total_tokens is the size to aim at; unset, the largest at which every
    source with documents can meet its target. A source without a target is
    not drawn, a target without documents is all missing. The share of a
    source strays from its target by about sqrt(share / slots).
    """
    spark = documents.sparkSession
    counts = materialise(token_counts(documents, tokenizer), "tokens")
    blocks = materialise(packed(counts, block_tokens, seed), "blocks")
    plan, slots = _plan(blocks, targets, total_tokens, block_tokens)
    p = plan["share"].to_numpy()
    whole = p.sum()
    schema = "shard long, n array<long>"

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [np.random.default_rng([seed, int(s)]).multinomial(min(SHARD_SLOTS, slots - int(s) * SHARD_SLOTS), p / whole) for s in pdf["id"]]
            yield pd.DataFrame({"shard": pdf["id"], "n": [r.tolist() for r in rows]})

    shards = spark.range(-(-slots // SHARD_SLOTS) if whole > 0 else 0).mapInPandas(draw, schema)
    names = spark.createDataFrame(
        [(i, s, int(b), int(r)) for i, (s, b, r) in enumerate(zip(plan["source"], plan["blocks"], plan["repeats"]))], "k int, source string, n_blocks long, repeats long"
    )
    per = materialise(shards.select("shard", F.posexplode("n").alias("k", "n")).join(F.broadcast(names), "k"), "shards")
    begun = prefix_sum(per, ["k", "shard"], "n", "_at")
    base = begun.groupBy("k").agg(F.min("_at").alias("_first"))
    slot = begun.join(F.broadcast(base), "k").filter("n > 0 AND n_blocks > 0").select(
        "shard", "k", "source", "n_blocks", "repeats", F.explode(F.sequence(F.col("_at") - F.col("_first"), F.col("_at") - F.col("_first") + F.col("n") - 1)).alias("slot")
    )
    slot = slot.withColumn("round", F.floor(F.col("slot") / F.col("n_blocks"))).filter(F.col("round") < F.col("repeats"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, size, at, turn = (b.column(i).to_numpy() for i in (2, 3, 4, 5))
            block = permuted(at % size, size, k.astype(np.int64) * 1_000_003 + turn * 7919 + seed)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), b.column(5), pa.array(block)], ["shard", "source", "slot", "round", "block"])

    placed = slot.select("shard", "source", "k", "n_blocks", "slot", "round").mapInArrow(place, "shard long, source string, slot long, round long, block long")
    draws = materialise(placed.join(blocks, ["source", "block"]).select("shard", "slot", "source", "block", "round", "doc_id", "tokens"), "draws")
    taken = draws.groupBy("source").agg(F.sum("tokens").alias("drawn")).toPandas().set_index("source")["drawn"]
    drawn = plan["source"].map(taken).fillna(0).astype(np.int64)
    aim = p / whole * slots * block_tokens if whole > 0 else p * 0
    lines = [
        (s, int(d), int(t), float(sh), int(r), int(x), float(x / max(drawn.sum(), 1)), float(x / t) if t else 0.0, int(max(0, round(a - x))))
        for s, d, t, sh, r, x, a in zip(plan["source"], plan["documents"], plan["tokens"], p, plan["repeats"], drawn, aim)
    ]
    report = spark.createDataFrame(
        lines, "source string, documents long, tokens long, target_share double, max_repeats long, drawn_tokens long, actual_share double, repeats double, missing_tokens long"
    )
    return draws, report
