"""Test passages inside a training corpus, by a positional inverted index.

The index holds every word of the corpus and is stored once, in blocks of
documents: the terms of a block and, for each, the places where it stands. A
search of any items only reads it: it takes the rarest terms of each item,
aligns their lists by offset, and where enough of them agree it reads the
passage back from the lists and looks for an exact run of words or for most of
the item's words in order.

No leak by these rules is missed: every twelve successive words hold two seeds
(the rarest of each six), which agree exactly in a run; and as there are more
seeds than words that may be missing, four of them at least stand in a passage
that keeps enough words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.llm.subjects import _powers
from lumenscan.runtime import materialise

#: Successive words that make a leak; share of an item's words that do, in order.
RUN_WORDS, PART = 12, 0.7
#: Each stretch of so many words has a seed for runs, so a leaked run holds two.
SEED_STRETCH = 6
#: Seeds of a passage in order that make it worth reading (fewer if the item has no more).
AGREEING = 4
#: Words by which a passage may be longer than its item.
BAND = 16
#: Documents of a block and bytes of their texts, at most (but a whole text at least).
BLOCK_DOCUMENTS, BLOCK_BYTES = 500, 1 << 21
#: Words of the items searched at once, which bounds what is broadcast; more items take further passes over the stored index.
ITEM_WORDS = 1_000_000

_HYPHEN = re.compile(r"[-‐‑](?<=[^\W\d_].)\s*(?=[^\W\d_])")
_UNSEEN = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_SIGN = re.compile(r"[^\w\s\x00-\x7f]")
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True

_INDEX = "docs binary, starts binary, terms binary, ends binary, places binary"
_FOUND = "doc_id long, item_id long, run int, ordered int"


def plain(text: str | None) -> str:
    """Text past case, forms of characters, hyphenation and unseen characters; signs are blanks."""
    if not text:
        return ""
    if not text.isascii():
        t = _UNSEEN.sub("", unicodedata.normalize("NFKC", text).lower())
        return _SIGN.sub(" ", _HYPHEN.sub("", t))
    return _HYPHEN.sub("", text.lower())


def word_bounds(texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, text number) of all words; numerals such as reference signs are left out."""
    raw = [plain(t).encode() for t in texts]
    off = np.cumsum([0, *(len(r) + 1 for r in raw)])
    whole = b" ".join([*raw, b""])
    data = np.frombuffer(whole, np.uint8)
    if not len(data):
        none = np.empty(0, np.int64)
        return whole, none, none, none
    word = _ALNUM[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    others = (end - start) - (digits[end] - digits[start])
    last = data[end - 1] if len(end) else data[:0]
    numeral = _DIGIT[data[start]] & ((others == 0) | ((others == 1) & (last >= 97) & (last <= 122))) if len(start) else np.empty(0, bool)
    start, end = start[~numeral], end[~numeral]
    return whole, start, end, np.searchsorted(off, start, side="right") - 1


def words(text: str | None) -> list[str]:
    """Words past case, punctuation, spacing, hyphenation, forms of characters and numerals."""
    whole, start, end, _ = word_bounds([text])
    return [whole[a:z].decode() for a, z in zip(start.tolist(), end.tolist())]


def term_lists(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(terms, text number) of all words in order; a term is a word's hash of 64 bits, by differences of running sums."""
    whole, start, end, text = word_bounds(texts)
    data = np.frombuffer(whole, np.uint8)
    if not len(start):
        return np.empty(0, np.uint64), text
    power, inverse = _powers(1 << max(20, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33)), text


def build_index(documents: DataFrame) -> DataFrame:
    """The positional index of all words of (doc_id, text), written out: a row for each block of documents.

    docs and starts: the documents of the block and the number of their first
    word in it; terms, ends: its terms in order and where their lists end;
    places: the lists, numbers of words in the block. Null texts and ids are
    left out, empty ones have no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            size = np.cumsum([0, *map(len, texts)])
            a = 0
            while a < len(texts):
                z = min(a + BLOCK_DOCUMENTS, len(texts), max(a + 1, int(np.searchsorted(size, size[a] + BLOCK_BYTES, "right")) - 1))
                terms, text = term_lists(texts[a:z])
                order = np.argsort(terms, kind="stable")
                sorted_terms = terms[order]
                first = np.flatnonzero(np.concatenate([[True], sorted_terms[1:] != sorted_terms[:-1]])) if len(terms) else np.empty(0, np.int64)
                row = [
                    np.ascontiguousarray(ids[a:z], np.int64), np.searchsorted(text, np.arange(z - a)).astype(np.int64),
                    sorted_terms[first], np.append(first[1:], len(terms)).astype(np.int32)[: len(first)], order.astype(np.int32),
                ]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], ["docs", "starts", "terms", "ends", "places"])
                a = z

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return materialise(source.mapInArrow(run, _INDEX), "postings")


class Items:
    """Items to search for, with their seeds by term."""

    def __init__(self, ids: list[int], terms: list[np.ndarray], frequency: dict[int, int]):
        self.ids, self.terms = np.asarray(ids, np.int64), terms
        seeds: list[tuple[int, int, int, bool]] = []
        self.agreeing, self.spread = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for number, t in enumerate(terms):
            places, of_runs, self.agreeing[number] = seed_places(t, frequency)
            missing = len(t) - int(np.ceil(PART * len(t) - 1e-9))
            self.spread[number] = 2 * missing + BAND  # by how much the offsets of one passage may differ
            seeds += [(int(t[p]), number, p, r) for p, r in zip(places.tolist(), of_runs.tolist())]
        seeds.sort(key=lambda x: x[0])
        term = np.array([x[0] for x in seeds], np.uint64)
        self.seed_terms, self.first = np.unique(term, return_index=True)
        self.first = np.append(self.first, len(term))
        self.item, self.place = (np.array([x[k] for x in seeds], np.int64) for k in (1, 2))
        self.of_run = np.array([x[3] for x in seeds], bool)


def seed_places(item: np.ndarray, frequency: dict[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, whether the place is a seed for runs, seeds that must agree for words in order).

    Seeds for runs are the rarest of each SEED_STRETCH words (every word of a
    shorter item). For words in order the rarest words are added until there
    are AGREEING more than may be missing, or the item has no more.
    """
    n = len(item)
    f = np.array([frequency.get(int(t), 0) for t in item])
    if n < RUN_WORDS:
        runs = np.arange(n)
    else:
        runs = np.unique([i + int(f[i : i + SEED_STRETCH].argmin()) for i in range(n - SEED_STRETCH + 1)])
    missing = n - int(np.ceil(PART * n - 1e-9))
    places = runs
    if len(places) < min(n, missing + AGREEING):
        rest = np.setdiff1d(np.arange(n), runs)
        rest = rest[np.argsort(f[rest], kind="stable")]
        places = np.sort(np.concatenate([runs, rest[: missing + AGREEING - len(runs)]]))
    return places, np.isin(places, runs), len(places) - missing


def ordered_words(item: np.ndarray, passage: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each word of the item."""
    where: dict[int, int] = {}
    for i, t in enumerate(item.tolist()):
        where[t] = where.get(t, 0) | 1 << i
    ones = (1 << len(item)) - 1
    v = ones
    for t in passage.tolist():
        m = where.get(t)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & ones
    return len(item) - v.bit_count()


def longest_run(item: np.ndarray, passage: np.ndarray) -> int:
    """Length of the longest stretch of words that both hold."""
    same = item[:, None] == passage[None, :]
    best, row = 0, np.zeros(len(passage) + 1, np.int32)
    for line in same:
        row[1:] = (row[:-1] + 1) * line
        best = max(best, int(row.max()))
    return best


def _hits(items: Items, terms: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed, word number) of every place of every seed in a block."""
    at = np.searchsorted(terms, items.seed_terms)
    known = np.flatnonzero(at < len(terms))
    known = known[terms[at[known]] == items.seed_terms[known]]
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    # A pair of a term and one of its seeds brings the whole list of the term.
    per = items.first[known + 1] - items.first[known]
    seed = np.repeat(items.first[known] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())
    t = np.repeat(at[known], per)
    size = ends[t].astype(np.int64) - begin[t]
    where = np.repeat(begin[t] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return np.repeat(seed, size), places[where].astype(np.int64)


def _search_block(items: Items, docs: np.ndarray, starts: np.ndarray, terms: np.ndarray, ends: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(doc, item number, longest run, words in order) of the leaks in a block."""
    seed, at = _hits(items, terms, ends, places)
    if not len(seed):
        return
    item, offset = items.item[seed], at - items.place[seed]
    key = (np.searchsorted(starts, at, side="right") - 1) * len(items.ids) + item
    order = np.lexsort((offset, key))
    key, item, offset, seed = key[order], item[order], offset[order], seed[order]
    # Exact runs: two seeds of runs with one offset. A shorter item must stand whole or in order.
    runs = np.flatnonzero(items.of_run[seed])
    twice = (key[runs][1:] == key[runs][:-1]) & (offset[runs][1:] == offset[runs][:-1])
    exact = runs[1:][twice]
    # Words in order: enough seeds whose offsets differ no more than those of a passage may.
    to = np.arange(len(key)) + items.agreeing[item] - 1
    inside = to < len(key)
    to = np.minimum(to, len(key) - 1)
    near = np.flatnonzero(inside & (key[to] == key) & (offset[to] - offset <= items.spread[item]))
    if not len(exact) and not len(near):
        return
    word = np.empty(len(places), np.int32)  # the block's texts, as numbers of terms
    word[places] = np.repeat(np.arange(len(terms), dtype=np.int32), np.diff(ends, prepend=0))
    limits = np.append(starts, len(places))
    local: dict[int, np.ndarray] = {}

    def own(number: int) -> np.ndarray:
        if number not in local:
            t = items.terms[number]
            k = np.minimum(np.searchsorted(terms, t), len(terms) - 1)
            local[number] = np.where(terms[k] == t, k, -1)
        return local[number]

    best: dict[int, tuple[int, int]] = {}
    tried: set[tuple[int, int]] = set()
    for h in exact.tolist():
        k, o = int(key[h]), int(offset[h])
        if (k, o) in tried:
            continue
        tried.add((k, o))
        doc, number = divmod(k, len(items.ids))
        q = own(number)
        a, z = max(o, limits[doc]), min(o + len(q), limits[doc + 1])
        same = np.concatenate([[False], word[a:z] == q[a - o : z - o], [False]])
        gaps = np.flatnonzero(~same)
        run = int(np.diff(gaps).max()) - 1
        if run >= RUN_WORDS and run > best.get(k, (0, 0))[0]:
            best[k] = (run, best.get(k, (0, 0))[1])
    last_key, covered = -1, 0
    for h in near.tolist():
        k, o = int(key[h]), int(offset[h])
        if k == last_key and o <= covered:
            continue
        doc, number = divmod(k, len(items.ids))
        q, spread = own(number), int(items.spread[number])
        last_key, covered = k, o + spread
        lo, hi = max(o - spread, limits[doc]), min(o + 2 * spread + len(q), limits[doc + 1])
        need = int(np.ceil(PART * len(q) - 1e-9))
        passage = word[lo:hi]
        held = np.flatnonzero(np.isin(passage, q))
        if len(held) < need:
            continue
        ordered = most_in_order(q, passage, held, need)
        if ordered >= need:
            run, before = best.get(k, (0, 0))
            best[k] = (max(run, longest_run(q, passage)), max(before, ordered))
    for k, (run, ordered) in best.items():
        doc, number = divmod(k, len(items.ids))
        yield int(docs[doc]), number, run, ordered


def most_in_order(item: np.ndarray, passage: np.ndarray, held: np.ndarray, need: int) -> int:
    """Most words of the item in order within one stretch of its length and BAND more; 0 if below need.

    held: the places of the passage that hold a word of the item; a best stretch begins at one of them.
    """
    width = len(item) + BAND
    bound = ordered_words(item, passage[held])
    if bound < need:
        return 0
    best = 0
    for i, s in enumerate(held):
        z = int(np.searchsorted(held, s + width))
        if z - i <= max(best, need - 1):
            continue
        best = max(best, ordered_words(item, passage[held[i:z]]))
        if best >= bound:
            break
    return best if best >= need else 0


def find_leaks(documents: DataFrame | None, items: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_id, run, ordered): every document that holds a passage of an item.

    run: longest run of the item's words at the places looked at; ordered: its
    words found in order within one passage (0 if too few). Items without
    words are ignored; one shorter than RUN_WORDS must stand there with PART
    of its words in order. An item given twice is reported for each item_id.
    No documents or no items: no rows. index: from build_index, if it is there
    already; then documents are not read.
    """
    spark = items.sparkSession
    rows = items.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id").toLocalIterator()
    out, ids, texts, size = None, [], [], 0
    for row in rows:
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"]) // 6
        if size >= ITEM_WORDS:
            index = index if index is not None else build_index(documents)
            found = _search(index, ids, texts)
            out, ids, texts, size = found if out is None else out.union(found), [], [], 0
    if ids:
        index = index if index is not None else build_index(documents)
        found = _search(index, ids, texts)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], _FOUND)


def _search(index: DataFrame, ids: list[int], texts: list[str]) -> DataFrame:
    spark = index.sparkSession
    terms, text = term_lists(texts)
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    lists = [terms[a:z] for a, z in zip(cut[:-1], cut[1:])]
    ids, lists = [i for i, t in zip(ids, lists) if len(t)], [t for t in lists if len(t)]
    if not ids:
        return spark.createDataFrame([], _FOUND)
    vocabulary = spark.sparkContext.broadcast(np.unique(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        total = np.zeros(len(known), np.int64)
        for b in batches:
            for t, e in zip(b.column(0), b.column(1)):
                t, n = np.frombuffer(t.as_buffer(), np.uint64), np.diff(np.frombuffer(e.as_buffer(), np.int32), prepend=0)
                at = np.minimum(np.searchsorted(known, t), len(known) - 1)
                same = known[at] == t
                total[at[same]] += n[same]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "n"])

    counted = index.select("terms", "ends").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    frequency = dict(zip(vocabulary.value[counted.column("term").to_numpy()].tolist(), counted.column("n").to_pylist()))
    shared = spark.sparkContext.broadcast(Items(ids, lists, frequency))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in batches:
            for row in zip(*b.columns):
                kinds = (np.int64, np.int64, np.uint64, np.int32, np.int32)
                found = list(zip(*_search_block(items, *(np.frombuffer(x.as_buffer(), k) for x, k in zip(row, kinds)))))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found[0], pa.int64()), pa.array(items.ids[list(found[1])]), pa.array(found[2], pa.int32()), pa.array(found[3], pa.int32())],
                        ["doc_id", "item_id", "run", "ordered"],
                    )

    return index.mapInArrow(run, _FOUND)
