"""Leaks, mixtures and subjects on small texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lumenscan.llm import leaks, mixture, subjects

WORDS = [a + b for a in "ba de fi go ku lo mi ne pa ru".split() for b in "ton lar sen vik mor dun".split()]


def brute(docs, items):
    """Every window of every document against every item."""
    out = set()
    for d, text in docs:
        w = leaks.term_lists([text])[0]
        for i, t in items:
            q = leaks.term_lists([t])[0]
            if not len(q) or not len(w):
                continue
            span = len(q) + leaks.BAND
            best = max(leaks.ordered_words(q, w[s : s + span]) for s in range(0, max(1, len(w) - span + 1)))
            if leaks.longest_run(q, w) >= leaks.RUN_WORDS or best >= np.ceil(leaks.PART * len(q) - 1e-9):
                out.add((d, i))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(i, " ".join(text(40))) for i in range(12)]
    docs = []
    for d in range(150):
        w = text(rng.randint(5, 300))
        if d % 3 == 0:
            q = items[d % 12][1].split()
            if d % 2:
                q = [x if rng.random() > 0.15 else "zz" for x in q]
            else:
                a = rng.randint(0, 20)
                q = q[a : a + rng.choice([8, 11, 12, 20])]
            at = rng.randint(0, len(w))
            w[at:at] = q
        docs.append((d, " ".join(w)))
    q = items[0][1].split()
    docs += [
        (900, "Intro. " + " ".join(q).upper().replace(" ", ",\n ")), (901, " ".join(f"{x} (12{c})" for x, c in zip(q, "abcdefgh" * 5))),
        (902, " ".join(x[:3] + "-\n" + x[3:] for x in q)), (903, " ".join(x[:2] + "­" + x[2:] for x in q)), (904, None), (905, ""),
        (906, " ".join(text(40_000) + q + text(20_000))), (907, " ".join(q)), (908, " ".join(q)),
    ]
    return docs, items


def test_leaks_equal_brute_force(spark, corpus):
    docs, items = corpus
    df = spark.createDataFrame([(d, t, 5, "x") for d, t in docs], "doc_id long, text string, item_id long, term string").repartition(4)
    ev = spark.createDataFrame([*[(i, t) for i, t in items], (50, None), (51, "  12 "), (52, items[0][1])], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(df, ev).collect()]
    assert len(got) == len(set(got))
    want = brute([d for d in docs if d[0] != 906], items)
    want |= {(d, 52) for d, i in want if i == 0}
    assert {g for g in got if g[0] != 906} == want
    assert {(906, 0), (906, 52), (901, 0), (902, 0), (903, 0), (908, 0)} <= set(got)


def test_leaks_in_several_passes_and_empty(spark, corpus, monkeypatch):
    docs, items = corpus
    df, ev = spark.createDataFrame(docs[:60], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in leaks.find_leaks(df, ev).collect()}
    monkeypatch.setattr(leaks, "ITEM_WORDS", 100)
    assert {tuple(r) for r in leaks.find_leaks(df, ev).collect()} == whole and whole
    stored = leaks.build_index(df)
    assert {tuple(r) for r in leaks.find_leaks(None, ev, stored).collect()} == whole
    monkeypatch.setattr(leaks, "BLOCK_DOCUMENTS", 7)
    assert {tuple(r) for r in leaks.find_leaks(df, ev).collect()} == whole
    assert leaks.find_leaks(df.limit(0), ev).count() == 0 == leaks.find_leaks(df, ev.limit(0)).count()


def test_short_items_are_found_where_they_stand(spark):
    rng = np.random.default_rng(12)
    vocabulary = ["w" + "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 5)) for _ in range(400)]
    docs, items = [], []
    for n in range(1, 12):
        for v in range(4):
            own = [f"q{chr(97 + n)}{chr(97 + v)}{chr(97 + i)}x" for i in range(n)]
            around = [list(rng.choice(vocabulary, 60)) for _ in range(2)]
            items.append((len(items), "test", " ".join(own)))
            docs.append((len(docs), " ".join(around[0] + own + around[1])))
            docs.append((len(docs), " ".join(around[0] + own[: n // 2] + around[1])))  # half of it is no leak
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, benchmark string, text string")
    ).collect()}
    assert got == {(2 * i, i) for i in range(len(items))}


def test_rare_words_exchanged_and_words_put_in(spark):
    """Thirty of a hundred words of an item exchanged, the rarest first; words put in at one place; runs in items of 9 to 25 words."""
    rng = np.random.default_rng(21)
    common = [f"c{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    docs, items, want = [], [], set()
    for i, n in enumerate([9, 12, 13, 20, 21, 40, 41, 74, 100] * 3):
        rare = [f"r{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n)]
        own = [rare[k] if rng.random() < 0.4 else str(rng.choice(common)) for k in range(n)]
        items.append((i, " ".join(own)))
        need = int(np.ceil(0.7 * n - 1e-9))
        first = sorted(range(n), key=lambda k: own[k] in common)  # rare words come first
        kept = [w if k not in first[: n - need] else "zz" for k, w in enumerate(own)]
        less = [w if k not in first[: n - need + 1] else "zz" for k, w in enumerate(own)]
        wide = kept[: n // 2] + ["yy"] * 15 + kept[n // 2 :]
        left_out = [w for k, w in enumerate(own) if k not in first[: n - need]]
        around = lambda: [str(x) for x in rng.choice(common, 80)] + ["xx"] * 40
        for w in (kept, less, wide, left_out, own[: min(n, 12)], own):
            docs.append((len(docs), " ".join(around() + w + ["xx"] * 40 + around())))
    df, ev = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(df, ev).collect()}
    assert got == want and all((6 * i + k, i) in want for i in range(len(items)) for k in (0, 3, 5))


def test_words_are_read_past_their_forms():
    assert leaks.words("Thirty-ﬁve [0027] low (12a) tide;\nbel-\nfry ＡＢ") == ["thirtyfive", "low", "tide", "belfry", "ab"]


def test_ordered_words_is_the_longest_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(40):
        a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(-1, 6, rng.integers(1, 40))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert leaks.ordered_words(a, b) == t[-1, -1]


# ---- mixtures ----


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(n):
    got = mixture.permuted(np.arange(n), np.full(n, n), np.full(n, 12345))
    assert sorted(got.tolist()) == list(range(n))
    if n > 60:
        assert (got != mixture.permuted(np.arange(n), np.full(n, n), np.full(n, 12346))).mean() > 0.9


def test_mixture(spark):
    rng = random.Random(1)
    sizes = {"Big": 1800, "mid-dle ": 600, "small": 40, "untold": 100}
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(10, 60))), s, 3) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [(10_000, None, "Big", 3), (10_001, "", "Big", 3), (10_002, "no source", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid_dle", 0.4, 2), ("small", 0.05, 3), ("ghost", 0.05, 2), ("big", 0.5, 1)], "source string, target_share double, max_repeats int")
    draws, report = mixture.mix(docs, targets, block_tokens=64)
    got = {r["source"]: r for r in report.collect()}
    assert set(got) == {"big", "mid_dle", "small", "ghost", "untold"}
    assert got["ghost"]["drawn_tokens"] == 0 and got["ghost"]["missing_tokens"] > 0 and got["untold"]["drawn_tokens"] == 0
    whole = sum(r["drawn_tokens"] for r in got.values())
    for s, r in got.items():
        assert r["actual_share"] == pytest.approx(r["drawn_tokens"] / whole)
        assert r["repeats"] <= r["max_repeats"] + 1e-9
        if s in ("big", "mid_dle", "small"):
            assert abs(r["drawn_tokens"] / (whole / 0.95) - r["target_share"]) < 0.06
    times = {}
    for r in draws.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    limit = {"Big": 1, "mid-dle ": 2, "small": 3}
    assert all(n <= limit[rows[d][2]] for d, n in times.items()) and not {10_000, 10_001, 10_002} & set(times)
    again, _ = mixture.mix(docs, targets, block_tokens=64)
    assert again.select("shard", "slot", "doc_id").exceptAll(draws.select("shard", "slot", "doc_id")).count() == 0


def test_mixture_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    draws, report = mixture.mix(docs, targets)
    assert draws.count() == 0 and [r["source"] for r in report.collect()] == ["a"]
    one = spark.createDataFrame([(1, "some words here", "b")], docs.schema)
    draws, report = mixture.mix(one, targets.limit(0))
    assert draws.count() == 0 and report.count() == 1


def test_token_counts_of_whole_texts(spark):
    texts = ["", None, "Hello world", "é" * 3000 + " x" * 5000]
    got = {r["doc_id"]: r["tokens"] for r in mixture.token_counts(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect()}
    assert got[0] == got[1] == 0 and got[2] == 2 and got[3] >= 5000


# ---- subjects ----

VOCAB = {
    ("law", "en"): "statute verdict appeal plaintiff tribunal clause", ("sea", "en"): "harbour keel anchor tide rudder mast", ("ore", "en"): "shaft gravel smelter quarry seam pick",
    ("oven", "en"): "dough crust loaf yeast crumb batter", ("loom", "en"): "weft yarn spindle shuttle fibre bobbin",
    ("oven", "de"): "teig kruste laib hefe krume backblech", ("loom", "de"): "schuss garn spindel schiffchen faser spule",
    ("law", "de"): "gesetz urteil berufung klage gericht absatz", ("sea", "de"): "hafen kiel anker flut ruder mast", ("ore", "de"): "schacht kies hütte bruch flöz hacke",
}
AREAS = ["law", "sea", "ore", "oven", "loom"]
GENERAL = {"en": "the part of a unit is held by it and moved".split(), "de": "der teil und die einheit wird von das gehalten".split()}
HEADS = {"en": ("Description", "We claim:"), "de": ("BESCHREIBUNG", "Ansprüche")}


def written(rng, areas, lang, aside=None):
    def sentence(area):
        return " ".join(rng.sample(VOCAB[area, lang].split(), 3) + rng.sample(GENERAL[lang], 5)) + "."

    body = [sentence(a) for a in areas for _ in range(8 // len(areas))] + ([sentence(aside)] if aside else [])
    claims = [f"{i}. {sentence(a)}" for i, a in enumerate([*areas, *areas], 1)]
    rng.shuffle(body)
    return "\n".join(["Abstract", HEADS[lang][0], *body, HEADS[lang][1], *claims])


@pytest.fixture(scope="module")
def library():
    rng = random.Random(6)
    docs, truth = [], {}
    for d in range(600):
        areas = rng.sample(AREAS, 2 if d % 6 == 0 else 1)
        aside = rng.choice([a for a in AREAS if a not in areas])
        lang = rng.choice(["en", "de"])
        code = rng.choice([{"en": "EN", "de": "de-AT"}[lang], {"en": "eng", "de": "ger"}[lang]]) if rng.random() > 0.1 else rng.choice([None, "fr", "xx", "de"])
        docs.append((d, written(rng, areas, lang, aside), code, 0.5))
        truth[d] = set(areas)
    docs += [(900, None, "en", 0.5), (901, "", "x", 0.5), (902, "1 2 3 + ...", "x", 0.5), (903, docs[0][1] * 200, "x", 0.5), (904, docs[1][1], None, 0.5)]
    return docs, truth


def test_subjects_of_held_out_documents(spark, library):
    docs, truth = library
    labels = [(d, a) for d in range(0, 120) for a in sorted(truth[d])]
    labels += labels[:5] + [(500, "no such area"), (None, "law"), (7, None)]
    out = subjects.subject_areas(
        spark.createDataFrame(docs, "doc_id long, text string, lang string, terms double").repartition(3), spark.createDataFrame(labels, "doc_id long, subject string"),
        spark.createDataFrame([(a, a, ".") for a in AREAS], "subject string, title string, covers string"),
    )
    rows = [(r["doc_id"], r["subject"]) for r in out.collect()]
    assert len(rows) == len(set(rows))
    got = {}
    for d, s in rows:
        got.setdefault(d, set()).add(s)
    held = [d for d in truth if d >= 120]
    assert sum(got.get(d) == truth[d] for d in held) >= 0.95 * len(held)
    assert not {900, 901, 902} & set(got) and got[903] == got[0] and got[904] == got[1]
    mix = {r["subject"]: r for r in subjects.corpus_by_subject(spark.createDataFrame(docs, "doc_id long, text string, lang string, terms double"), out).collect()}
    assert sum(r["share"] for r in mix.values()) == pytest.approx(1) and mix["none"]["documents"] == 3


def test_no_documents_or_areas(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    labels, areas = spark.createDataFrame([(1, "x")], "doc_id long, subject string"), spark.createDataFrame([("x",)], "subject string")
    assert subjects.subject_areas(docs.limit(0), labels, areas).count() == 0
    assert subjects.subject_areas(docs, labels, areas.limit(0)).count() == 0


def test_subjects_without_language_codes(spark, library):
    docs, truth = library
    labels = [(d, a) for d in range(0, 120) for a in sorted(truth[d])]
    out = subjects.subject_areas(
        spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame([(a,) for a in AREAS], "subject string")
    )
    got = {}
    for d, s in out.collect():
        got.setdefault(d, set()).add(s)
    held = [d for d in truth if d >= 120]
    assert sum(got.get(d) == truth[d] for d in held) >= 0.6 * len(held)  # one centroid for two languages


def test_hashed_words(monkeypatch):
    texts = ["Abstract\nx ﬁn Ünit-2a\nDescription\nbody of claims\nCLAIMS:\n1. body", None, "", "body", "Ansprüche\nünit “unit” body", "2 3"]
    text, bucket, claim = subjects.hashed_words(pa.array(texts))
    by = {}
    for t, b, c in zip(text.tolist(), bucket.tolist(), claim.tolist()):
        by.setdefault(t, []).append((b, c))
    body = by[3][0][0]
    assert [b for b, c in by[0] if c] == [body] and (body, False) in by[0]
    assert len([b for b, c in by[4] if c]) == 3 and by[4][-1][0] == body and set(by) == {0, 3, 4}
    assert by[4][1][0] == by[0][2][0]  # ünit
    monkeypatch.setattr(subjects, "TEXT_BYTES", 8)
    pieces = list(subjects._pieces(pa.array(texts)))
    assert pieces[0] == (0, 1) and pieces[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
