"""Chunks, embeddings, vector and text search against brute force."""

import math
import random
import re

import numpy as np
import pytest
from helpers import rows, small

from tidemark.functions.columns import combine_embeddings
from tidemark.operators.docs import build_context, chunk, chunk_spans, embed
from tidemark.functions.stem import porter
from tidemark.operators.text import bm25, keyword_search, match_all
from tidemark.operators.vector import hybrid_search, ivf_build, ivf_search, nearest, vector_search
from tidemark.plans.flows import ingest_documents


def test_chunk_spans():
    assert chunk_spans("", 10, 2) == []
    assert chunk_spans("short", 10, 2) == [(0, 5)]
    # cut behind the last sentence end past the middle
    assert chunk_spans("aaaaaa. bbbbbbbb", 10, 2) == [(0, 8), (6, 16)]
    # a break before the middle does not count
    assert chunk_spans("a. bbbbbbbbbbbbb", 10, 2)[0] == (0, 10)
    # sentence ends go before line ends, line ends before spaces
    assert chunk_spans("aaaaaa\nb c. dddddd", 12, 0)[0] == (0, 12)
    assert chunk_spans("aaaaaaa\nb cccccccc", 12, 0)[0] == (0, 8)


def test_chunk_tail():
    text = "x" * 500
    assert chunk_spans(text, 1000, 200) == [(0, 500)]
    tail = chunk_spans(text, 1000, 200, tail=True)
    assert len(tail) == 201 and tail[0] == (0, 500) and tail[-1] == (499, 500)


def test_chunks_cover_every_character():
    rnd = random.Random(4)
    for _ in range(50):
        text = "".join(rnd.choice("ab .\n") for _ in range(rnd.randint(1, 400)))
        spans = chunk_spans(text, 40, 8)
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        for (a, b), (c, d) in zip(spans, spans[1:]):
            assert a < c <= b < d and d - c <= 40


def test_chunk_rows(spark):
    df = small(spark, [(1, " hello "), (2, None), (3, "")], "d int, text string")
    assert rows(chunk(df, "text")) == [(1, 0, "hello", 0, 7)]


def test_ingest_documents(spark, tmp_path):
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "a.txt").write_text("one two. " * 30)
    (tmp_path / "docs" / "sub" / "b.md").write_text("three")
    (tmp_path / "docs" / "c.pdf").write_text("ignored")
    target = str(tmp_path / "out")
    stats = ingest_documents(spark, str(tmp_path / "docs"), target, size=100, overlap=10).first()
    table = spark.read.parquet(target + "/numbered")
    assert stats["row_count"] == table.count() and sorted({r["filename"] for r in table.collect()}) == ["a.txt", "b.md"]
    assert sorted(r["chunk_id"] for r in table.collect()) == list(range(table.count()))
    assert table.filter("size(embedding) = 256").count() == table.count()


def test_embed_with_a_model(spark):
    def model():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = small(spark, [(1, "abc"), (2, None)], "d int, text string")
    assert rows(embed(df, "text", model), "d", "embedding") == [(1, [3.0, 1.0]), (2, [0.0, 1.0])]


def test_embed_default_counts_words(spark):
    df = small(spark, [(1, "a a b"), (2, "B a A"), (3, "c"), (4, "")], "d int, text string")
    got = {r["d"]: np.array(r["embedding"]) for r in embed(df, "text").collect()}
    assert np.allclose(got[1], got[2]) and np.isclose(np.linalg.norm(got[1]), 1)
    assert sorted(got[1][got[1] > 0].round(4)) == [round(1 / math.sqrt(5), 4), round(2 / math.sqrt(5), 4)]
    assert not got[4].any()


DIM = 6


def vectors(seed, n):
    """A third of the vectors are copies of one."""
    rnd = random.Random(seed)
    copy = [round(rnd.uniform(-1, 1), 2) for _ in range(DIM)]
    return [copy if i % 3 == 0 else [round(rnd.uniform(-1, 1), 2) for _ in range(DIM)] for i in range(n)]


def brute(metric, docs, queries, k):
    out = []
    for q, qv in queries:
        scored = []
        for d, v in docs:
            a, b = np.array(v), np.array(qv)
            dist = {
                "cosine": 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b),
                "l2": np.linalg.norm(a - b),
                "l1": np.abs(a - b).sum(),
                "inner_product": -(a @ b),
            }[metric]
            scored.append((round(float(dist), 9), d))
        out += [(q, d, rank) for rank, (_, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("metric", ["cosine", "l2", "l1", "inner_product"])
@pytest.mark.parametrize("limit", [1 << 20, 64])
def test_vector_search(spark, metric, limit):
    docs = list(enumerate(vectors(1, 120)))
    queries = [(f"q{i}", v) for i, v in enumerate(vectors(2, 7))]
    d = small(spark, docs, "d long, v array<double>").repartition(5)
    q = small(spark, queries, "q string, v array<double>")
    out = vector_search(d, q, "d", "v", "q", "v", metric, 9, query_bytes=limit)
    assert sorted((r["q"], r["d"], r["rank"]) for r in out.collect()) == brute(metric, docs, queries, 9)


def test_vector_search_edges(spark):
    d = small(spark, [("a", [0.0, 0.0]), ("b", [1.0, 0.0]), ("c", None)], "d string, v array<float>")
    q = small(spark, [(1, [1.0, 0.0])], "q int, v array<float>")
    assert rows(vector_search(d, q, "d", "v", "q", "v"), "d", "distance") == [("b", 0.0)]
    assert vector_search(d, q.limit(0), "d", "v", "q", "v").count() == 0
    assert vector_search(d.limit(0), q, "d", "v", "q", "v").count() == 0
    assert nearest(d, "d", "v", [1.0, 0.0]).select("d").first()["d"] == "b"


@pytest.mark.parametrize("limit", [1 << 20, 64])
def test_ivf(spark, limit):
    docs = list(enumerate(vectors(3, 300)))
    queries = list(enumerate(vectors(4, 10)))
    d, q = small(spark, docs, "d long, v array<double>"), small(spark, queries, "q long, v array<double>")
    indexed, centres = ivf_build(d, "v", nlist=16)
    exact = brute("l2", docs, queries, 10)
    full = ivf_search(indexed, centres, q, "d", "v", "q", "v", "l2", 10, nprobe=16, query_bytes=limit)
    assert sorted((r["q"], r["d"], r["rank"]) for r in full.collect()) == exact
    some = ivf_search(indexed, centres, q, "d", "v", "q", "v", "l2", 10, nprobe=10, query_bytes=limit)
    got = {(r["q"], r["d"]) for r in some.collect()}
    assert len(got & {(a, b) for a, b, _ in exact}) >= 0.8 * len(exact)


def test_combine_embeddings(spark):
    df = small(spark, [([1.0, 2.0], [3.0])], "a array<double>, b array<double>")

    def value(*args):
        return df.select(combine_embeddings("a", "b", *args).alias("c")).first()["c"]

    assert value("weighted_sum", 0.25, 0.75) == [2.5, 0.5]
    assert value("average") == [2.0, 1.0]
    assert value("concatenate") == [1.0, 2.0, 3.0]
    for bad in (("weighted_sum", 0.5, 0.6), ("other",)):
        with pytest.raises(ValueError):
            value(*bad)


WORDS = ["the", "cat", "dog", "sat", "mat", "Éte", "x1", "rare"]


def corpus(seed, n):
    rnd = random.Random(seed)
    return [
        (i, "the " * 5 if i % 3 == 0 else " ".join(rnd.choices(WORDS[:-1], k=rnd.randint(0, 12))) + ("!" if i % 2 else ""))
        for i in range(n)
    ] + [(n, "a rare, Rare find")]


def words(text):
    return [w for w in re.split(r"[^\w]+", text.lower().replace("é", "e")) if w]


def brute_bm25(docs, queries, k, match):
    n, mean = len(docs), sum(len(words(t)) for _, t in docs) / len(docs)
    out = []
    for q, text in queries:
        terms = set(words(text))
        scored = []
        for d, body in docs:
            w = words(body)
            hit = [t for t in terms if t in w]
            if not hit or (match == "all" and len(hit) < len(terms)):
                continue
            total = 0.0
            for t in hit:
                df = sum(t in words(b) for _, b in docs)
                idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
                tf = w.count(t)
                total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
            scored.append((round(-total, 9), d))
        out += [(q, d, r, s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("match", ["any", "all"])
@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_bm25(spark, match, limit):
    docs = corpus(1, 60)
    queries = [(0, "the cat"), (1, "RARE"), (2, "éte dog sat"), (3, "missing"), (4, "the missing")]
    d, q = small(spark, docs, "d long, text string"), small(spark, queries, "q int, text string")
    out = bm25(d.repartition(4), "d", ["text"], q, "q", "text", 7, match, matrix_bytes=limit)
    got = sorted((r["q"], r["d"], r["rank"], round(r["distance"], 9)) for r in out.collect())
    want = brute_bm25(docs, queries, 7, match)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


# words and stems of Porter's paper
STEMS = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing
    conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail
    filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper
    decisiveness decis formaliti formal triplicate triplic formative form electrical electr hopeful hope goodness good
    revival reviv allowance allow adjustable adjust replacement replac adoption adopt communism commun effective effect
    probate probat rate rate cease ceas controll control roll roll""".split()


def test_stems():
    assert [porter(w) for w in STEMS[::2]] == STEMS[1::2]
    assert [porter(w) for w in ("is", "été", "x1", "")] == ["is", "été", "x1", ""]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_stemmed_search(spark, limit):
    rnd = random.Random(4)
    docs = [(i // 2, " ".join(rnd.choices(STEMS[::2], k=rnd.randint(0, 12)))) for i in range(40)]  # repeated ids
    queries = [(0, "hoping agree"), (1, "Motors cat"), (2, "falls")]
    plain = lambda t: " ".join(porter(w) for w in words(t))
    d, q = small(spark, docs, "d long, text string"), small(spark, queries, "q int, text string")
    out = bm25(d.repartition(3), "d", ["text"], q, "q", "text", 9, "any", matrix_bytes=limit, stem=True)
    got = sorted((r["q"], r["d"], r["rank"], round(r["distance"], 9)) for r in out.collect())
    want = brute_bm25([(i, plain(t)) for i, t in docs], [(i, plain(t)) for i, t in queries], 9, "any")
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    some = match_all(d, "d", ["text"], q, "q", "text", matrix_bytes=limit, stem=True)
    assert sorted(r["d"] for r in some.where("q = 2").collect()) == sorted(i for i, t in docs if "fall" in plain(t).split())


@pytest.mark.parametrize("k", [None, 4])
@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_match_all(spark, k, limit):
    docs = corpus(2, 60)
    queries = [(0, "the cat"), (1, "rare"), (2, "the")]
    want = []
    for q, text in queries:
        hits = []
        for d, body in docs:
            w, terms = words(body), set(words(text))
            if terms <= set(w):
                hits.append((-round(sum(w.count(t) for t in terms) / len(w), 9), d))
        want += [(q, d, -s) for s, d in sorted(hits)[:k]]
    d, q = small(spark, docs, "d long, text string"), small(spark, queries, "q int, text string")
    out = match_all(d.repartition(4), "d", ["text"], q, "q", "text", k, matrix_bytes=limit)
    assert sorted((r["q"], r["d"], round(r["text_rank"], 9)) for r in out.collect()) == sorted(want)


def test_keyword_and_hybrid(spark):
    d = small(
        spark, [(1, "red cat", None, [1.0, 0.0]), (2, "dog", "cat", [0.0, 1.0]), (3, "bird", "x", [1.0, 0.0])],
        "d int, a string, b string, v array<double>",
    )
    assert rows(keyword_search(d, ["a", "b"], "cat", ["d"]), "d") == [(1,), (2,)]
    assert rows(keyword_search(d, ["a", "b"], "cat", ["d"], 1), "d") == [(1,)]
    q = small(spark, [(0, [1.0, 0.1])], "q int, v array<double>")
    out = hybrid_search(d, ["a", "b"], "cat", q, "d", "v", "q", "v", "l2", 5)
    assert [r["d"] for r in out.orderBy("rank").collect()] == [1, 2]


def test_context_order(spark):
    hits = small(spark, [(1, "c", 3), (1, "a", 1), (1, "b", 2), (2, "z", 1)], "q int, text string, rank int")
    assert rows(build_context(hits, ["q"], "text", "rank", 2, "|")) == [(1, "a|b", 2), (2, "z", 1)]
