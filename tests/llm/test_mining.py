"""Hard negatives, source mixing and collocations: odd rows, empty tables, and brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations as phrases
from tidemark.llm import hard_negatives, mixing, queries

# mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Targets per source, by resharing what is above the limits until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, left = set(), sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] >= most * sizes[s] * total]
        if not over:
            return {s: float(most * sizes[s]) if s in full else left * weight[s] / total for s in order}
        full |= set(over)
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        if len(full) == len(order):
            return {s: float(most * sizes[s]) for s in order}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mix(docs, rows):
    """Sizes, targets and bounds of a mix of (id, text, source); returns the words taken by source."""
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += words(text)
    targets = brute_targets(sizes)
    want = Counter((i, words(t), sizes[s], round(targets[s], 6)) for i, t, s in docs)
    assert Counter((r[0], r[1], r[2], round(r[3], 6)) for r in rows) == want
    by_source = {}
    names = {(i, words(t)): s for i, t, s in docs}
    for r in rows:
        assert r[4] in (r[1] * np.arange(4)).tolist()
        source = names[r[0], r[1]]
        by_source[source] = by_source.get(source, 0) + r[4]
    return by_source, targets


def test_fitted_is_the_nearest_sum():
    rnd = random.Random(3)
    for _ in range(200):
        n = rnd.randint(0, 5)
        sizes = rnd.sample(range(0, 15), n)
        docs = [rnd.randint(1, 3) for _ in sizes]
        budget = rnd.uniform(0, 1.2 * sum(s * d for s, d in zip(sizes, docs)) + 1)
        got = mixing.fitted(np.array(sizes, np.int64), np.array(docs, np.int64), budget)
        assert all(0 <= g <= d for g, d in zip(got, docs))
        best = min(abs(sum(s * k for s, k in zip(sizes, pick)) - budget) for pick in product(*[range(d + 1) for d in docs]))
        assert abs(sum(s * g for s, g in zip(sizes, got)) - budget) == pytest.approx(best)


def test_fitted_fills_a_large_budget_first():
    rnd = np.random.default_rng(5)
    sizes, docs = np.unique(rnd.integers(1, 5000, 900)), None
    docs = rnd.integers(1, 40, len(sizes))
    for share in (0.01, 0.37, 0.99):
        budget = share * float((sizes * docs).sum())
        got = mixing.fitted(sizes, docs, budget, cells=4000)
        assert (got >= 0).all() and (got <= docs).all() and abs((sizes * got).sum() - budget) <= 0.5
    one = mixing.fitted(np.array([1_000_000]), np.array([1]), 600_000.0, cells=1000)
    assert one.tolist() == [1]  # nearer than nothing
    assert mixing.fitted(np.array([1_000_000]), np.array([1]), 400_000.0, cells=1000).tolist() == [0]
    even = mixing.fitted(np.array([2, 4]), np.array([50, 50]), 101.0)
    assert abs((even * [2, 4]).sum() - 101) == 1


def test_mix_of_odd_documents(spark, odd_documents):
    docs = [tuple(r) for r in odd_documents.select("doc_id", "text", "source").collect()]
    wide = odd_documents.withColumns({c: F.lit(1) for c in ("size", "taken", "target", "whole", "part", "draw")})
    rows = mixing.mix(wide).collect()
    check_mix(docs, rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(wide.repartition(7)).collect()), key=str)


def test_mix_reaches_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 40)  # lengths in several parts
    rnd = random.Random(8)
    docs = [(k, " ".join("w" * rnd.randint(1, 40)), "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(3000)]
    docs += [(5000 + k, "a b c", "copies") for k in range(900)] + [(9000, "x " * 40_000, "one"), (9001, None, None), (9002, "p q", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    taken, targets = check_mix(docs, mixing.mix(frame).collect())
    for source in targets:
        room = {"one": 40_000, "copies": 1.5}.get(source, 0.5)
        assert abs(taken[source] - targets[source]) <= room, source


def test_mix_of_nothing(spark, no_documents):
    assert mixing.mix(no_documents).count() == 0
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mixing.mix(empty).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


# hard negatives


def brute_negatives(rows, is_anchor, k=5, m=3):
    """``rows`` are (id, vector, label); scores in Python integers."""
    ready = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ready.append((i, label, tuple(math.floor(256 * float(x)) for x in v)))
    out = []
    for i, label, a in sorted({r for r in ready if is_anchor(r[0])}):
        scored = sorted(
            (-sum(x * y for x, y in zip(a, b)), j, other) for j, other, b in ready if j != i and len(a) == len(b)
        )
        for s, j, _ in [x for x in scored if x[2] == label][:k]:
            inside = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:m]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(inside, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_negatives_match_brute_force(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(6, 12))
    data = []
    for k in range(700):
        v = (centres[k % 6] + rnd.normal(size=12)) * rnd.choice([0.1, 0.5, 1, 3])
        data.append((k, np.float32(v).tolist(), int(rnd.integers(0, 4))))
    data += [(1000 + k, data[5][1], k % 2) for k in range(300)]  # copies tie
    monkeypatch.setattr(hard_negatives, "RUN", 32)
    monkeypatch.setattr(hard_negatives, "BUFFER", 100)
    frame = spark.createDataFrame(data, VECTORS).repartition(4)
    want = brute_negatives(data, lambda i: i % 20 == 0)
    assert len(want) > 200
    for how in ({}, {"block_bytes": 3000}):
        got = hard_negatives.mine(frame, F.col("vec_id") % 20 == 0, **how)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (0, [0.0, 1.0], 2), (1, [0.9, 0.1], 1), (1, [0.9, 0.1], 1), (2, [0.7, 0.7], 2),
        (3, [0.8, -0.1], 3), (4, [], 1), (50, [], 1), (5, [], 2), (6, [0.0, 0.0], 1), (7, [0.0, -0.0], 2), (100, [0.0, 0.0], 2),
        (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [inf, 0.0], 2), (11, None, 1), (12, [1.0, 1.0], None), (None, [1.0, 1.0], 1),
        (150, [1e30, 0.0], 1), (200, [-1.0, 0.0], 1), (13, [4e5, 4e5], 1), (250, [4e5, 4e5], 2), (14, [3e5, 4e5], 2), (15, [2e5, 3e5], 1),
        (16, [0.5], 1), (300, [0.7], 1), (17, [0.4], 2),
    ]
    frame = spark.createDataFrame(data, VECTORS)
    frame = frame.withColumns({c: F.lit(2) for c in ("id", "norm", "vec", "near", "angle", "anchor", "slot", "score")})
    got = hard_negatives.mine(frame, F.col("vec_id") % 50 == 0)
    small = [r for r in data if r[0] != 150]  # its squares pass 64 bits
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(small, lambda i: i % 50 == 0)
    assert hard_negatives.mine(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(frame, F.lit(False)).count() == 0


def test_score_bounds_hold_every_score():
    rnd = np.random.default_rng(9)
    for _ in range(30):
        refs = rnd.normal(size=(5, 4))
        refs /= np.linalg.norm(refs, axis=1)[:, None]
        x, a = (np.floor(rnd.normal(size=(20, 4)) * s) for s in rnd.choice([1, 50, 4000], 2))
        nx, na = np.linalg.norm(x, axis=1), np.linalg.norm(a, axis=1)
        ax = hard_negatives._angles(x, nx, refs).astype(np.float32).astype(float)
        aa = hard_negatives._angles(a, na, refs).astype(np.float32).astype(float)
        low, high = hard_negatives.score_bounds(na, aa, ax.min(axis=0), ax.max(axis=0), nx.min(), nx.max())
        scores = a @ x.T
        assert (scores >= low[:, None]).all() and (scores <= high[:, None]).all()
        one = hard_negatives.score_bounds(na, aa, ax[0], ax[0], nx[0], nx[0])
        assert (one[1] - one[0] <= 2 * na * nx[0] + 3).all()  # never wider than without directions


# collocations


def brute_collocations(docs, least, k):
    """``docs`` are (lang, text); everything in Python integers."""
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            found = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(found)
            for size in (1, 2, 3, 4):
                f.update((lang, tuple(found[s : s + size])) for s in range(len(found) - size + 1))
    candidates = {c: a for c, a in f.items() if len(c[1]) > 1 and a >= least}
    gone = set()
    for (lang, phrase), a in candidates.items():
        for size in range(2, len(phrase)):
            for s in range(len(phrase) - size + 1):
                inner = (lang, phrase[s : s + size])
                if 100 * a >= 80 * candidates[inner]:
                    gone.add(inner)
    rows = defaultdict(list)
    for (lang, phrase), a in candidates.items():
        if (lang, phrase) in gone:
            continue
        cuts = [(2_000_000 * a // (f[lang, phrase[:c]] + f[lang, phrase[c:]]), c) for c in range(1, len(phrase))]
        score, c = min(cuts)
        text = " ".join(phrase)
        rows[lang].append((-score, -a, text.encode(), text, a, f[lang, phrase[:c]], f[lang, phrase[c:]]))
    out = []
    for lang, found in rows.items():
        for rank, (s, _, _, text, a, left, right) in enumerate(sorted(found)[:k], 1):
            out.append((lang, rank, text, a, left, right, n[lang], -s))
    return sorted(out)


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = ["The", "of", "é", "ÉA", "b c", "x"] + [f"w{k}" for k in range(40)]
    weights = [60, 40, 8, 5, 4, 3] + [1 + 30 // (k + 1) for k in range(40)]
    stops = [" "] * 12 + [", ", ".", "\n", "\t ", " ; ", "  ", "!?", "\r\n", "\x0b", "\x0c"]
    docs = []
    for k in range(n):
        drawn = rnd.choices(vocabulary, weights, k=rnd.choice([0, 1, 5, 40, 200]))
        docs.append((rnd.choice(["en", "en", "fr", None, "und", ""]), "".join(w + rnd.choice(stops) for w in drawn)))
    docs += [("en", "New York City Hall is in New York, new york city")] * 9 + [(None, None), ("fr", ""), ("de", ". ; ,")]
    return docs + [("en", "the of " * 20_000)]


@pytest.mark.parametrize("how", [{}, {"group_rows": 40, "chunk_words": 300}])
def test_collocations_match_brute_force(spark, how):
    docs = corpus(2, 250)
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    wide = frame.withColumns({c: F.lit("x") for c in ("phrase", "word", "n", "f", "words", "part", "pair", "size")})
    got = phrases.collocations(wide, least=5, k=30, **how).collect()
    want = brute_collocations(docs, 5, 30)
    assert sorted(tuple(r) for r in got) == want and len(want) > 90


def test_all_counts_of_phrases(spark):
    docs = corpus(7, 60)
    frame = spark.createDataFrame(docs, "lang string, text string")
    for how in ({}, {"group_rows": 8, "chunk_words": 100}):
        found, sizes = phrases.phrase_counts(frame, least=4, **how)
        f = Counter()
        for lang, text in docs:
            low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
                w = re.findall(r"[^\x20\x09]+", piece)
                f.update(("und" if lang is None else lang, " ".join(w[s : s + k]), k) for k in (1, 2, 3, 4) for s in range(len(w) - k + 1))
        assert {tuple(r) for r in found.collect()} == {(*p, n) for p, n in f.items() if n >= 4}


def test_scores_past_64_bits(spark):
    big = 10**13
    made = [("x", "a b", 2, big), ("x", "a", 1, 3 * big), ("x", "b", 1, big)]
    frame = spark.createDataFrame(made, "lang string, phrase string, size int, f long")
    sizes = spark.createDataFrame([("x", 4 * big)], "lang string, n long")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(phrases, "phrase_counts", lambda *a, **k: (frame, sizes))
        assert [tuple(r) for r in phrases.collocations(frame).collect()] == [("x", 1, "a b", big, 3 * big, big, 4 * big, 500_000)]


def test_no_phrases(spark, no_documents, odd_documents):
    assert phrases.collocations(no_documents).count() == 0
    docs = [tuple(r) for r in odd_documents.select("lang", "text").collect()]
    got = phrases.collocations(odd_documents, least=3).collect()
    assert sorted(tuple(r) for r in got) == brute_collocations(docs, 3, 2000)


# the queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("mining"))
    rnd = random.Random(21)
    docs = [(k, t, lang, f"s{k % 4}" if k % 9 else None, len(t or "")) for k, (lang, t) in enumerate(corpus(5, 300)[:-1])]
    vectors = [(k, [rnd.gauss(0, 1) * 0.2 for _ in range(8)], rnd.randint(0, 9)) for k in range(400)]
    vectors += [(400 + k, vectors[k][1], k % 10) for k in range(200)] + [(700, None, 1), (701, [1.0] * 8, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(
        f"{place}/documents.parquet"
    )
    spark.createDataFrame(vectors, VECTORS).repartition(3).write.parquet(f"{place}/embeddings.parquet")
    return place, docs, vectors


def test_op11(spark, folder):
    place, _, vectors = folder
    rows = spark.read.parquet(f"{place}/embeddings.parquet").collect()
    moved = [(i, v, label if label is None or i % 7 else (label + 1) % 10) for i, v, label in rows]
    got = queries.QUERIES["op11_hard_negatives"](spark, place)
    want = brute_negatives(moved, lambda i: i % 50 == 0)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 50


def test_op12(spark, folder):
    place, docs, _ = folder
    rows = queries.QUERIES["op12_source_mix"](spark, place).collect()
    taken, targets = check_mix([(i, t, s) for i, t, _, s, _ in docs], rows)
    assert all(abs(taken[s] - targets[s]) <= max(0.5, 0.01 * targets[s]) for s in targets)


def test_op13(spark, folder):
    place, docs, _ = folder
    got = queries.QUERIES["op13_collocations"](spark, place).collect()
    want = brute_collocations([(lang, t) for _, t, lang, _, _ in docs], 30, 2000)
    assert sorted(tuple(r) for r in got) == want and len(want) > 25
