"""Subject areas of documents: truncated SVD of term weights, seeded centroids.

Terms are hashed words of the whole text. A word's weight falls with the share
of a language's documents that hold it; the common words of each language have
none. Which language a text is in is told by its words, from what words the
texts of each language code have. Subspace iteration over all documents finds
the leading right singular vectors. Centroids start from labelled documents,
one for each subject and language, and are refined over all documents. A
document is then assigned by the cosines of two embeddings, of its claims and
of the rest, with the centroids of its language, each for what the other
centroids do not explain; an area must show in both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.llm.graph import _binary, _raw
from lumenscan.runtime import discard, materialise

#: Buckets that words are hashed to: bounds every broadcast and every driver-side array here.
BUCKETS = 1 << 16
#: Codes of the languages that texts are in. Texts with other codes or none count to the language their words fit best.
LANGUAGES = {"en": ("en", "eng"), "de": ("de", "ger", "deu"), "fr": ("fr", "fre", "fra")}
#: A word weighs nothing in a language where more than the first or less than the second share of the documents hold it, or fewer than so many.
COMMON_SHARE, RARE_SHARE, MIN_DOCUMENTS = 0.5, 0.0004, 3
RANK, OVERSAMPLE = 56, 8
#: Subspace iteration ends when the sum of the singular values grows by less than this share in a round.
GROWTH = 0.01
#: A document refines the centroid it is nearest to from this cosine on, if the next centroid is no nearer than this share of it.
JOIN_COSINE, CLEAR = 0.5, 0.5
#: Refinement ends when no centroid turns by more than this (one less the cosine).
SETTLED, MOST_ROUNDS = 1e-4, 100
#: What an area must explain of the document without its claims, and of its claims.
BODY_SHARE, CLAIMS_SHARE = 0.25, 0.02
#: Bytes of text that are split into words at once, at least a whole text; documents that are embedded at once. Both fit a core's cache.
TEXT_BYTES, EMBED_ROWS = 1 << 18, 250
#: Buckets or centroids that travel in one row of partial sums.
SUM_ROWS = 256

#: Headings after which the claims stand, fixed values of this kind of text.
_CLAIMS = re.compile("(?:^|\n)[ \t]*(?:we claim|what is claimed is|claims|(?:patent)?ansprüche|revendications)[ \t]*:?[ \t]*(?=\r?\n|$)".encode())

_TERMS = "doc_id long, code int, term array<int>, body array<int>, claims array<int>"
_ROWS = "doc_id long, lang int, slot array<int>, whole array<float>, body array<float>, claims array<float>"

_STEP = 0x9E3779B97F4A7C15
#: Bytes that may be part of a word: ASCII letters and all of longer characters (signs among these are left out below).
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    out = []
    for x in (_STEP, pow(_STEP, -1, 1 << 64)):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, is claim) of every word of two letters or more, in order.

    Words are runs of letters in lower case; digits, signs and punctuation
    divide them. Hashes are differences of running sums over the bytes, so
    there is no loop over words. Claims are what follows the last heading of
    claims.
    """
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    off = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    whole = low.buffers()[2].to_pybytes()[off[0] : off[-1]] if low.buffers()[2] else b""
    off = off - off[0]
    data = np.frombuffer(whole, np.uint8)
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none.astype(bool)
    letter = _LETTER[data]
    for lead, n in ((0xE2, 3), (0xC2, 2)):  # general punctuation and signs
        at = np.flatnonzero(data == lead)
        for k in range(n):
            letter[np.minimum(at + k, len(letter) - 1)] = False
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    before[off[:-1][off[:-1] < len(data)]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    start, end = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    long = end - start >= 2
    start, end = start[long], end[long]
    power, inverse = _powers(1 << max(19, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53)
    text = np.searchsorted(off, start, side="right") - 1
    claims = off[1:].copy()
    for i in range(len(low)):
        for m in _CLAIMS.finditer(whole[off[i] : off[i + 1]]):
            claims[i] = off[i] + m.end()
    return text, (h >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1), start >= claims[text]


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of about TEXT_BYTES, at least one."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    a = 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(size, size[a] + TEXT_BYTES, "right")) - 1)
        yield a, min(z, len(texts))
        a = z


def _lists(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind))


def term_counts(documents: DataFrame) -> DataFrame:
    """(doc_id, code, term, body, claims): the distinct terms of whole texts, how often they stand in claims and outside.

    code is the place in LANGUAGES that the document's code names, -1 for any other.
    """
    named = F.element_at(F.split(F.lower(F.trim(F.col("lang"))), "[-_]"), 1) if "lang" in documents.columns else F.lit(None).cast("string")
    places = [F.when(named.isin(*codes), F.lit(i)) for i, codes in enumerate(LANGUAGES.values())]
    rows = documents.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce(*places, F.lit(-1)).alias("code"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in _pieces(batch.column(2)):
                b = batch.slice(a, z - a)
                text, bucket, claim = hashed_words(b.column(2))
                key, n = np.unique((text * BUCKETS + bucket) * 2 + claim, return_counts=True)
                term = key >> 1
                first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
                inside = np.add.reduceat(np.where(key & 1, n, 0), first) if len(term) else first
                both = np.add.reduceat(n, first) if len(term) else first
                term = term[first]
                ends = np.concatenate([[0], np.cumsum(np.bincount(term // BUCKETS, minlength=z - a))])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), _lists(ends, term % BUCKETS, pa.int32()), _lists(ends, both - inside, pa.int32()), _lists(ends, inside, pa.int32())],
                    ["doc_id", "code", "term", "body", "claims"],
                )

    return rows.mapInArrow(run, _TERMS)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    off = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], off - off[0]


def _few_tasks(df: DataFrame) -> DataFrame:
    """So that partial sums are as many as the cluster has cores, not as the data has partitions."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def _summed(partial: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Partial sums (key, x: doubles as bytes) added up by key in tasks; the driver gets one row for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(x.as_buffer(), np.float64)
                total[k] = total[k] + x if k in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["key", "x"])

    out = partial.repartition("key").mapInArrow(run, "key long, x binary").toArrow()
    return {k: np.frombuffer(x, np.float64).reshape(-1, width) for k, x in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}


def _partial(total: np.ndarray) -> pa.RecordBatch:
    """A matrix in rows of SUM_ROWS of its rows; what is all zero is left out."""
    short = -len(total) % SUM_ROWS
    blocks = np.concatenate([total, np.zeros((short, total.shape[1]))]).reshape(-1, SUM_ROWS * total.shape[1])
    held = np.flatnonzero(blocks.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(held), _binary(blocks[held])], ["key", "x"])


def _matrix(sums: dict[int, np.ndarray], n: int, width: int) -> np.ndarray:
    out = np.zeros((-(-n // SUM_ROWS) * SUM_ROWS, width))
    for k, x in sums.items():
        out[k * SUM_ROWS : (k + 1) * SUM_ROWS] = x
    return out[:n]


def document_frequencies(terms: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(languages, buckets): how many documents of a language code hold each bucket; and how many there are of each."""
    size = len(LANGUAGES) * BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + len(LANGUAGES))
        for b in batches:
            code = b.column(0).to_numpy()
            term, off = _flat(b.column(1))
            known = np.repeat(code, np.diff(off))
            total[:size] += np.bincount((known * BUCKETS + term)[known >= 0], minlength=size)
            total[size:] += np.bincount(code[code >= 0], minlength=len(LANGUAGES))
        yield _partial(total[:, None])

    sums = _matrix(_summed(_few_tasks(terms.select("code", "term")).mapInArrow(run, "key long, x binary"), 1), size + len(LANGUAGES), 1)[:, 0]
    return sums[:size].reshape(len(LANGUAGES), BUCKETS), sums[size:]


def weighted(terms: DataFrame, df: np.ndarray, n: np.ndarray) -> tuple[DataFrame, int]:
    """((doc_id, lang, slot, whole, body, claims), number of slots): the weights of the terms that have any.

    lang is the language that a text's words fit best; whole is a unit row,
    body and claims are weighed alike but not scaled.
    """
    fit = np.log((df + 0.5) / (n[:, None] + 1.0)).astype(np.float32)
    fit[n == 0] = -100.0
    idf = np.log(np.maximum(n[:, None], 1) / np.maximum(df, 1)).clip(min=0)
    idf[(df > COMMON_SHARE * n[:, None]) | (df < np.maximum(RARE_SHARE * n[:, None], MIN_DOCUMENTS))] = 0
    used = np.flatnonzero(idf.any(axis=0))
    slot = np.full(BUCKETS, -1, np.int32)
    slot[used] = np.arange(len(used))
    shared = terms.sparkSession.sparkContext.broadcast((fit, idf.astype(np.float32), slot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, idf, slot = shared.value
        for b in batches:
            term, off = _flat(b.column(1))
            body, claims = _flat(b.column(2))[0], _flat(b.column(3))[0]
            row = np.repeat(np.arange(b.num_rows), np.diff(off))
            lang = np.stack([np.bincount(row, f[term], minlength=b.num_rows) for f in fit]).argmax(axis=0)
            w = idf[lang[row], term]
            at = np.flatnonzero(w > 0)
            row, term, w, body, claims = row[at], term[at], w[at], body[at], claims[at]
            parts = [np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) * w for c in (body + claims, body, claims)]
            norm = np.sqrt(np.bincount(row, parts[0] * parts[0], minlength=b.num_rows))
            parts[0] = parts[0] / np.maximum(norm, 1e-12)[row]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang.astype(np.int32)), _lists(ends, slot[term], pa.int32()), *[_lists(ends, p.astype(np.float32), pa.float32()) for p in parts]],
                ["doc_id", "lang", "slot", "whole", "body", "claims"],
            )

    return terms.select("doc_id", "term", "body", "claims").mapInArrow(run, _ROWS), len(used)


def _sum_runs(values: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows with equal key; keys ascend."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(keys):
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        out[keys[start]] = np.add.reduceat(values, start, axis=0)
    return out


def _embedded(basis: np.ndarray, slot: np.ndarray, off: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = []
    for k in range(0, len(off) - 1, EMBED_ROWS):
        own = off[k : k + EMBED_ROWS + 1]
        part = slice(own[0], own[-1])
        row = np.repeat(np.arange(len(own) - 1), np.diff(own))
        out.append(_sum_runs(basis[slot[part]] * weight[part, None], row, len(own) - 1))
    return np.concatenate(out) if out else np.zeros((0, basis.shape[1]), np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; a row of nothing stays nothing."""
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def leading_vectors(rows: DataFrame, n: int, balance: np.ndarray, rank: int = RANK) -> np.ndarray:
    """(slots, rank): orthonormal right singular vectors, by subspace iteration over all documents.

    balance: what a document's row counts by its language, so that the areas
    of a rare language are not crowded out by those of a common one.
    """
    q = min(rank + OVERSAMPLE, n)
    basis = np.linalg.qr(np.random.default_rng(5).standard_normal((n, q)))[0].astype(np.float32)
    source, before = _few_tasks(rows.select("slot", "whole", "lang")), 0.0
    while True:
        sent = rows.sparkSession.sparkContext.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            basis = sent.value
            total = np.zeros(basis.shape)
            for b in batches:
                for k in range(0, b.num_rows, EMBED_ROWS):
                    part = b.slice(k, EMBED_ROWS)
                    (s, off), w = _flat(part.column(0)), _flat(part.column(1))[0]
                    y = _embedded(basis, s, off, w) * balance[part.column(2).to_numpy(), None]
                    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
                    back = np.argsort(s, kind="stable")
                    s = s[back]
                    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else s
                    if len(s):
                        total[s[start]] += np.add.reduceat(y[row[back]] * w[back, None], start, axis=0)
            yield _partial(total)

        product = _matrix(_summed(source.mapInArrow(run, "key long, x binary"), q), n, q)
        sent.unpersist()
        turned, values, _ = np.linalg.svd(product, full_matrices=False)
        held = float(np.sqrt(values).sum())
        basis = turned.astype(np.float32)
        if held <= (1 + GROWTH) * before or not held:
            return basis[:, :rank]
        before = held


def embed(rows: DataFrame, basis) -> DataFrame:
    """(doc_id, lang, e: unit row of floats as bytes) of the documents that have any weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot, off = _flat(b.column(2))
            e = _unit(_embedded(basis.value, slot, off, _flat(b.column(3))[0])).astype(np.float32)
            at = np.flatnonzero(e.any(axis=1))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), _binary(e[at])], ["doc_id", "lang", "e"])

    return rows.select("doc_id", "lang", "slot", "whole").mapInArrow(run, "doc_id long, lang int, e binary")


def _centroid_sums(embedded: DataFrame, width: int, size: int, choose) -> np.ndarray:
    """Sums of embeddings (lang, e, ...) by centroid; choose gives each document's centroid or -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, width))
        for b in batches:
            off, raw = _raw(b.column(1))
            e = raw[off[0] : off[-1]].view(np.float32).reshape(-1, width)
            c = choose(b, e)
            for k in np.unique(c[c >= 0]):
                total[k] += e[c == k].sum(axis=0, dtype=np.float64)
        yield _partial(total)

    return _matrix(_summed(_few_tasks(embedded).mapInArrow(run, "key long, x binary"), width), size, width)


def refined_centroids(embedded: DataFrame, labels: DataFrame, subjects: list[str], width: int) -> np.ndarray:
    """(languages x subjects, width) unit rows, zero where nothing is known of the pair."""
    k = len(subjects)
    place = F.array_position(F.array(*[F.lit(s) for s in subjects]), F.col("subject")).cast("int") - 1
    single = labels.select("doc_id", "subject").distinct().groupBy("doc_id").agg(F.min("subject").alias("subject"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    seeds = embedded.join(single.filter(F.col("subject").isin(subjects)), "doc_id").select("lang", "e", place.alias("place"))
    m = _unit(_centroid_sums(seeds, width, len(LANGUAGES) * k, lambda b, e: b.column(0).to_numpy() * k + b.column(2).to_numpy()))
    source = embedded.select("lang", "e")
    for _ in range(MOST_ROUNDS):
        current = m.astype(np.float32)

        def choose(b: pa.RecordBatch, e: np.ndarray, current=current) -> np.ndarray:
            lang = b.column(0).to_numpy()
            score = (e @ current.T).reshape(len(e), -1, k)[np.arange(len(e)), lang]
            best = score.argmax(axis=1)
            top = score[np.arange(len(e)), best]
            score[np.arange(len(e)), best] = -1
            clear = (top >= JOIN_COSINE) & (score.max(axis=1) <= CLEAR * top)
            return np.where(clear, lang * k + best, -1)

        sums = _centroid_sums(source, width, len(m), choose)
        found = sums.any(axis=1)
        new = np.where(found[:, None], _unit(sums), m)
        moved = 1 - (new * m).sum(axis=1)[m.any(axis=1)].min(initial=1.0)
        m = new
        if moved <= SETTLED:
            return m
    raise RuntimeError(f"centroids have not settled in {MOST_ROUNDS} rounds")


def subject_areas(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject): each area a document deals with; none gives no row.

    Texts may be null or empty (no row) or of any length (all of it is read).
    A text without claims is judged by the rest alone, one of claims only by
    these. Labels that name no area are ignored, repeated ones count once,
    documents with two labels do not seed. A subject without a seed in a
    language is not found in it. Without documents or areas the result is
    empty. Where no document names one of LANGUAGES, all count as one language.
    """
    spark = documents.sparkSession
    subjects = sorted({r["subject"] for r in areas.select("subject").distinct().collect() if r["subject"] is not None})
    empty = spark.createDataFrame([], "doc_id long, subject string")
    terms = materialise(term_counts(documents), "terms")
    df, n = document_frequencies(terms)
    if not n.any():
        terms = terms.withColumn("code", F.lit(0))
        df, n = document_frequencies(terms)
    plan, slots = weighted(terms, df, n)
    if not slots or not subjects:
        return empty
    rows = materialise(plan, "weights")
    discard(terms)
    found = leading_vectors(rows, slots, (n.max() / np.maximum(n, 1)).astype(np.float32))
    width, k = found.shape[1], len(subjects)
    basis = spark.sparkContext.broadcast(found)
    embedded = materialise(embed(rows, basis), "embedded")
    m = refined_centroids(embedded, labels, subjects, width)
    discard(embedded)
    # What each centroid explains beside the others of its language: rows of the dual basis.
    dual = np.zeros_like(m)
    for lang in range(len(LANGUAGES)):
        at = lang * k + np.flatnonzero(m[lang * k : (lang + 1) * k].any(axis=1))
        if len(at):
            dual[at] = np.linalg.solve(m[at] @ m[at].T + 1e-6 * np.eye(len(at)), m[at])
    shared = spark.sparkContext.broadcast(dual.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.asarray(subjects, object)
        for b in batches:
            lang = b.column(1).to_numpy()
            slot, off = _flat(b.column(2))
            share, held = [], []
            for c in (3, 4):
                e = _unit(_embedded(basis.value, slot, off, _flat(b.column(c))[0]))
                share.append((e @ shared.value.T).reshape(len(e), -1, k)[np.arange(len(e)), lang])
                held.append(e.any(axis=1)[:, None])
            ok = ((share[0] >= BODY_SHARE) | ~held[0]) & ((share[1] >= CLAIMS_SHARE) | ~held[1]) & (held[0] | held[1])
            ok &= held[0] | (share[1] >= BODY_SHARE)
            d, j = np.nonzero(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array(names[j], pa.string())], ["doc_id", "subject"])

    return rows.select("doc_id", "lang", "slot", "body", "claims").mapInArrow(run, "doc_id long, subject string")


def corpus_by_subject(documents: DataFrame, assigned: DataFrame) -> DataFrame:
    """(subject, documents, share): the make-up of the corpus; 'none' where no area was found.

    A document with two areas counts half for each in `share`.
    """
    counts = assigned.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    each = documents.select("doc_id").join(assigned, "doc_id", "left").join(counts, "doc_id", "left")
    n = max(documents.count(), 1)
    return (
        each.groupBy(F.coalesce("subject", F.lit("none")).alias("subject"))
        .agg(F.count(F.lit(1)).alias("documents"), F.sum(1 / F.coalesce("k", F.lit(1))).alias("weight"))
        .select("subject", "documents", (F.col("weight") / F.lit(n)).alias("share"))
    )
