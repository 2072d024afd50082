"""Stored structures: pointer, buckets, latest tables, text and vector indexes, profiles, documents, traces."""

import os
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from helpers import rows, small
from pyspark.sql import functions as F

from tidemark.operators import text_index
from tidemark.operators.asof import Side, asof_join
from tidemark.operators.lineage import trace_all_upstream, trace_upstream
from tidemark.operators.lineage_table import LineageTable
from tidemark.operators.profiles import StoredProfile
from tidemark.operators.quality import Check, ValidationError
from tidemark.operators.substring import SubstringIndex
from tidemark.operators.text import bm25, keyword_search, match_all
from tidemark.operators.text_index import TextIndex
from tidemark.operators.timeline import TimeLine
from tidemark.operators.vector import hybrid_ranked, vector_search
from tidemark.operators.vector_index import VectorIndex
from tidemark.plans.documents import DocumentTable
from tidemark.plans.views import View
from tidemark.plans.workspace import Workspace
from tidemark.sources.buckets import BucketTable
from tidemark.sources.pointer import KEEP, Pointer
from tidemark.sources.read import BatchSource
from tidemark.sources.write import LatestTable

T0 = datetime(2024, 1, 1)


def at(h):
    return T0 + timedelta(hours=h)


# the pointer


def test_pointer_versions_and_removal(spark, tmp_path):
    pointer = Pointer(spark, str(tmp_path / "t"))
    assert pointer.read() == (0, {})
    for n in range(30):
        (tmp_path / "t" / f"f{n}").mkdir(parents=True)
        pointer.change(lambda state, n=n: state | {"folders": [f"f{n}"], "n": n})
    version, state = pointer.read()
    assert version == 30 and state["n"] == 29
    there = sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("f"))
    assert "f29" in there and len(there) <= KEEP + 1
    assert len([p for p in (tmp_path / "t" / "versions").iterdir() if p.name.isdigit()]) <= KEEP + 1
    assert pointer.change(lambda state: None)["n"] == 29 and pointer.read()[0] == 30


def test_pointer_does_not_lose_changes(spark, tmp_path):
    pointer = Pointer(spark, str(tmp_path / "t"))
    tried = []

    def add(name):
        def make(state):
            if not tried:  # somebody else is faster
                tried.append(name)
                pointer.change(lambda s: s | {"names": [*s.get("names", []), "other"]})
            return state | {"names": [*state.get("names", []), name]}

        return make

    pointer.change(add("mine"))
    assert pointer.read()[1]["names"] == ["other", "mine"]


# buckets


def test_bucket_table_rewrites_touched_buckets(spark, tmp_path):
    table = BucketTable(str(tmp_path / "b"), ("k",), "k long, v string", 8)
    assert table.read(spark).count() == 0
    first = small(spark, [(k, f"a{k}") for k in range(40)], "k long, v string")
    assert len(table.replace(first.select("k"), first)) == 8
    before = table._where(spark)
    new = small(spark, [(3, "b3"), (3, "c3"), (99, "b99")], "k long, v string")
    gone = small(spark, [(3,), (5,), (1000,)], "k int")
    touched = table.replace(gone, new)
    after = table._where(spark)
    assert {b for b in before if before[b] != after.get(b)} <= {str(b) for b in touched} and len(touched) < 8
    want = [(k, f"a{k}") for k in range(40) if k not in (3, 5)] + [(3, "b3"), (3, "c3"), (99, "b99")]
    assert rows(table.read(spark)) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
    asked = small(spark, [(3,), (99,), (7777,), (None,)], "k int")
    assert rows(table.read_keys(asked)) == [(3, "b3"), (3, "c3"), (99, "b99")]
    everything = table.read(spark).select("k")
    table.replace(everything, first.limit(0))
    assert table.read(spark).count() == 0


# latest values

DDL = "k int, event_timestamp timestamp, v int"


def test_many_upserts_leave_few_folders(spark, tmp_path):
    table = LatestTable(str(tmp_path / "t"), ("k",), "event_timestamp", buckets=4, most=4)
    rnd = random.Random(5)
    want = {}
    for n in range(40):
        data = [(rnd.randrange(30), at(rnd.randrange(100)), n) for _ in range(rnd.randrange(6))]
        table.upsert(small(spark, data, DDL))
        newest = {}
        for k, ts, v in data:
            if k not in newest or ts > newest[k][0]:
                newest[k] = (ts, v)
        for k, (ts, v) in newest.items():
            if k not in want or ts > want[k][0]:
                want[k] = (ts, v)
    _, state = table._pointer(spark).read()
    assert len(state["batches"]) < 4
    # what a read lists, and what lies there until it is removed
    assert len(os.listdir(f"{table.path}/batch_writer=pushes")) <= 4 + KEEP
    got = {r["k"]: r["event_timestamp"] for r in table.read(spark).collect()}
    assert got == {k: ts for k, (ts, _) in want.items()}


def test_lookup_reads_the_buckets_asked_for(spark, tmp_path):
    table = LatestTable(str(tmp_path / "t"), ("k",), "event_timestamp", buckets=16)
    table.upsert(small(spark, [(k, at(1), k) for k in range(500)], DDL))
    table.compact(spark)
    table.upsert(small(spark, [(7, at(2), 70), (1000, at(0), 1)], DDL))
    found = table.read_keys(small(spark, [(7,), (8,), (1000,), (-4,), (None,)], "k long"))
    assert rows(found, "k", "v") == [(1000, 1), (7, 70), (8, 8)]
    asked = small(spark, [(8,)], "k long")
    plan = table.read_keys(asked)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    table.compact(spark)
    assert rows(table.read_keys(asked), "k", "v") == [(8, 8)]
    with_view = Workspace(spark, str(tmp_path / "space"), [View("act", ("k",), ("v",), BatchSource(table="unused"))])
    with_view.push(["act"], small(spark, [(k, at(1), k) for k in range(50)], DDL))
    out = with_view.lookup(["act:v"], small(spark, [(3,), (77,), (3,)], "k int"), at(5))
    assert rows(out, "k", "v", "v__status") == [(3, 3, "PRESENT"), (3, 3, "PRESENT"), (77, None, "NOT_FOUND")]


def test_replay_of_a_folded_batch_changes_nothing(spark, tmp_path):
    table = LatestTable(str(tmp_path / "t"), ("k",), "event_timestamp")
    batch = small(spark, [(1, at(1), 10)], DDL)
    for n in range(3):
        table.upsert(small(spark, [(n, at(n), n)], DDL), n, "stream")
    table.compact(spark)
    table.upsert(batch.withColumn("v", F.lit(99)), 1, "stream")
    assert table.batches(spark).count() == 3 and rows(table.read(spark), "k", "v") == [(0, 0), (1, 1), (2, 2)]


def test_pushes_share_a_folder_a_day(spark, tmp_path):
    space = Workspace(spark, str(tmp_path), [View("act", ("k",), ("v",), BatchSource(table="unused"))])
    for n in range(3):
        space.push(["act"], small(spark, [(n, at(n), n)], DDL), "offline")
    assert space.offline("act").count() == 3 and len(os.listdir(f"{tmp_path}/offline/act/batch_writer=pushes")) == 1


# checks in the run that writes


@pytest.mark.parametrize("kind", [{"online": True, "offline": False}, {"online": False, "offline": True}, {"online": True, "offline": True}])
def test_checked_views_are_computed_once_and_withdrawn(spark, tmp_path, kind):
    seen = spark.sparkContext.accumulator(0)

    def counted(df):
        def run(batches):
            for b in batches:
                seen.add(len(b))
                yield b

        return df.mapInPandas(run, df.schema)

    data = small(spark, [(k, at(k), k) for k in range(10)], DDL)
    good = View("good", ("k",), ("v",), BatchSource(frame=data), transform=counted, checks=(Check("between", "v", 0, 9),), **kind)
    bad = View("bad", ("k",), ("v",), BatchSource(frame=data), transform=counted, checks=(Check("between", "v", 0, 5),), **kind)
    space = Workspace(spark, str(tmp_path), [good, bad])
    space.materialize(at(0), at(20), ["good"])
    assert seen.value == 10
    with pytest.raises(ValidationError, match=r"between\(v\)"):
        space.materialize(at(0), at(20), ["bad"])
    assert seen.value == 20 and space.last_end("bad") is None
    if kind["online"]:
        assert space.online("good").read(spark).count() == 10
        assert not space.online("bad")._pointer(spark).read()[1]
    if kind["offline"]:
        assert space.offline("good").count() == 10
    left = [f for _, _, files in os.walk(tmp_path) for f in files if f.endswith(".parquet") and "/bad/" in f]
    assert not left


# text


def corpus(n, seed=3):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    texts = [" ".join(rnd.choices(words, weights, k=rnd.choice([0, 3, 10, 40]))) for _ in range(n)]
    return [(k // 2 if k % 10 == 0 else k, t if k % 17 else None) for k, t in enumerate(texts)]


QUERIES = [(0, "w0"), (1, "w3 w50"), (2, "W5, w7 w9"), (3, "nothing here"), (4, ""), (5, "w0 w1 w2"), (6, "w40 w59 w41")]


@pytest.mark.parametrize("match", ["any", "all"])
def test_text_index_equals_search(spark, tmp_path, match):
    data = corpus(600)
    docs = small(spark, data, "doc long, text string").repartition(5)
    asked = small(spark, QUERIES, "q int, ask string")
    index = TextIndex(str(tmp_path / "i"), "doc", buckets=8, range_docs=16)
    index.add(docs, ["text"])
    seen = {}
    got = index.bm25(asked, "q", "ask", 3, match, seen)
    assert rows(got, "q", "doc", "rank", "distance") == rows(bm25(docs, "doc", ["text"], asked, "q", "ask", 3, match), "q", "doc", "rank", "distance")
    assert 0 < seen["scored"] < seen["ranges"]
    if match == "all":
        want = match_all(docs, "doc", ["text"], asked, "q", "ask", 3)
        assert rows(index.match_all(asked, "q", "ask", 3), "q", "doc", "text_rank", "rank") == rows(want, "q", "doc", "text_rank", "rank")


def test_text_index_takes_documents_and_merges(spark, tmp_path):
    data = corpus(300, seed=9)
    asked = small(spark, QUERIES, "q int, ask string")
    index = TextIndex(str(tmp_path / "i"), "doc", buckets=4, range_docs=32)
    assert index.bm25(asked, "q", "ask").count() == 0
    for part in range(2):
        index.add(small(spark, data[part::2], "doc long, text string"), ["text"])
        docs = small(spark, [r for p in range(part + 1) for r in data[p::2]], "doc long, text string")
        want = rows(bm25(docs, "doc", ["text"], asked, "q", "ask", 4, "any"), "q", "doc", "rank", "distance")
        assert rows(index.bm25(asked, "q", "ask", 4, "any"), "q", "doc", "rank", "distance") == want
    index.compact(spark)
    assert len(index._pointer(spark).read()[1]["folders"]) == 1
    assert rows(index.bm25(asked, "q", "ask", 4, "any"), "q", "doc", "rank", "distance") == want
    index.add(small(spark, [], "doc long, text string"), ["text"])
    assert rows(index.bm25(asked, "q", "ask", 4, "any"), "q", "doc", "rank", "distance") == want


def test_text_index_reads_its_terms_buckets(spark, tmp_path):
    index = TextIndex(str(tmp_path / "i"), "doc", buckets=16)
    index.add(small(spark, corpus(100), "doc long, text string"), ["text"])
    state = index._pointer(spark).read()[1]
    plan = index._read(spark, state["folders"]).where("bucket in (3)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1]


def test_text_index_with_stems(spark, tmp_path):
    docs = small(spark, [(1, "running runner"), (2, "he runs"), (3, "walk")], "doc long, text string")
    asked = small(spark, [(0, "run")], "q int, ask string")
    index = TextIndex(str(tmp_path / "i"), "doc", stem=True, buckets=2)
    index.add(docs, ["text"])
    assert rows(index.bm25(asked, "q", "ask"), "doc") == rows(bm25(docs, "doc", ["text"], asked, "q", "ask", stem=True), "doc")


def test_ranges_keep_their_best_pairs(spark, monkeypatch):
    monkeypatch.setattr(text_index, "spread_small", lambda df: df)  # one task, so one range
    data = [(k, " ".join(["a"] * tf + ["b"] * (n - tf))) for k, (tf, n) in enumerate([(3, 9), (1, 4), (3, 7), (2, 5), (1, 6), (2, 8), (0, 2)])]
    blocks = text_index._blocks(small(spark, data, "doc long, text string").coalesce(1), "doc", F.col("text"), False, "s", 100)
    best = {r["term"]: sorted(zip(r["top_tf"], r["top_length"])) for r in blocks.where("term is not null").collect()}
    assert best["a"] == [(1, 4), (2, 5), (3, 7)]
    totals = blocks.where("term is null").select(F.sum("docs"), F.sum("words")).first()
    assert tuple(totals) == (7, 41)


@pytest.mark.parametrize("limit", [1 << 24, 200])
def test_hybrid_ranked_matches_a_join(spark, limit):
    rnd = np.random.default_rng(2)
    data = [(k, t, None if k % 13 == 0 else rnd.normal(size=4).tolist()) for k, (_, t) in enumerate(corpus(200))]
    docs = small(spark, data, "doc long, text string, v array<double>")
    asked = small(spark, [(q, t, rnd.normal(size=4).tolist()) for q, t in QUERIES], "q int, ask string, qv array<double>")
    got = hybrid_ranked(docs, ["text"], asked, "doc", "v", "q", "ask", "qv", "l2", 3, limit)
    want = []
    for q, t, qv in asked.collect():
        terms = set(t.lower().replace(",", " ").split())
        hits = []
        for d, text, v in data:
            words = (text or "").split()
            if terms and v is not None and terms <= set(words):
                share = sum(w in terms for w in words) / len(words)
                hits.append((round(float(np.linalg.norm(np.array(v) - qv)), 9), d, round(share, 9)))
        want += [(q, d, s, dist, k) for k, (dist, d, s) in enumerate(sorted(hits)[:3], 1)]
    assert [tuple(r) for r in got.select("q", "doc", "text_rank", "distance", "rank").orderBy("q", "rank").collect()] == sorted(want, key=lambda r: (r[0], r[4]))


# vectors


def clusters(n, dim=12, seed=1):
    rnd = np.random.default_rng(seed)
    middles = rnd.normal(size=(12, dim)) * 4
    data = [(k, (middles[k % 12] + rnd.normal(size=dim) * 0.6).tolist()) for k in range(n)]
    data += [(n + k, data[3][1]) for k in range(30)] + [(n + 100, [0.0] * dim), (n + 101, None)]
    asked = [(q, (middles[q] + rnd.normal(size=dim) * 0.3).tolist()) for q in range(6)] + [(9, [0.0] * dim), (10, None)]
    return data, asked


@pytest.mark.parametrize("metric", ["l2", "cosine", "l1", "inner_product"])
def test_vector_index_is_exact(spark, tmp_path, metric):
    data, asked = clusters(900)
    docs, asked = small(spark, data, "d long, v array<double>"), small(spark, asked, "q int, w array<double>")
    if metric == "cosine":
        asked = asked.where("q < 9")
    index = VectorIndex(str(tmp_path / "i"), "d", "v", metric)
    index.build(docs.repartition(4), nlist=24, parts=4)
    want = rows(vector_search(docs, asked, "d", "v", "q", "w", metric, 7), "q", "d", "distance", "rank")
    seen = {}
    assert rows(index.search(asked, "q", "w", 7, seen), "q", "d", "distance", "rank") == want
    assert metric == "inner_product" or seen["read"] < seen["lists"] / 2
    assert rows(index.search(asked, "q", "w", 7, query_bytes=12 * 8 * 2), "q", "d", "distance", "rank") == want
    assert index.search(asked.limit(0), "q", "w").count() == 0


@pytest.mark.parametrize("metric", ["l2", "cosine", "l1", "inner_product"])
def test_coded_search_finds_most(spark, tmp_path, metric):
    data, asked = clusters(3000, seed=8)
    docs, asked = small(spark, data, "d long, v array<double>"), small(spark, [a for a in asked if a[0] < 9], "q int, w array<double>")
    index = VectorIndex(str(tmp_path / "i"), "d", "v", metric)
    index.build(docs.repartition(4), nlist=12, parts=6, sample=1000)
    exact = {(r["q"], r["d"]): r["distance"] for r in vector_search(docs, asked, "d", "v", "q", "w", metric, 10).collect()}
    found = {(r["q"], r["d"]): r["distance"] for r in index.search_coded(asked, "q", "w", 10, nprobe=6, refine=10).collect()}
    both = exact.keys() & found.keys()
    assert len(found) == len(exact) and len(both) >= 0.9 * len(exact)
    assert all(found[p] == exact[p] for p in both)


# substrings


def test_substring_index_skips_files(spark, tmp_path):
    data = [(k, f"row {k} of site{k // 25} é", None if k % 7 else "extra") for k in range(200)]
    docs = small(spark, data, "k long, a string, b string")
    index = SubstringIndex(str(tmp_path / "i"), ("a", "b"))
    index.build(docs, 8, "k")
    for needle in ("site3", "ro", "", "é", "extra", "nowhere at all", "of site7 é"):
        seen = {}
        got = rows(index.search(spark, needle, seen), "k")
        assert got == rows(keyword_search(docs, ["a", "b"], needle, ["k"]), "k"), needle
        assert seen["scanned"] <= seen["files"]
    seen = {}
    index.search(spark, "site3", seen)
    assert seen["scanned"] < seen["files"]
    index.add(small(spark, [(900, "a site3 more", None)], "k long, a string, b string"))
    assert (900,) in rows(index.search(spark, "site3 m"), "k")


# profiles


def test_profiles_merge(spark, tmp_path):
    rnd = random.Random(4)
    data = [(at(rnd.randrange(24 * 10)), rnd.randrange(500), rnd.gauss(0, 1) if k % 5 else None, f"s{k % 40}") for k in range(4000)]
    data += [(at(24 * 3), 7, None, None)]
    df = small(spark, data, "ts timestamp, n int, x double, s string")
    stored = StoredProfile(str(tmp_path / "p"), ("n", "x", "s"), "ts")
    first = df.where(F.col("ts") < F.lit(at(24 * 6)))
    stored.add(first)
    stored.add(df.where(F.col("ts") >= F.lit(at(24 * 6))))
    stored.add(first)  # whole days again
    got = {r["column_name"]: r for r in stored.merged(spark).collect()}
    numbers = sorted(r[2] for r in data if r[2] is not None)
    assert got["n"]["row_count"] == 4001 and got["x"]["null_count"] == 4001 - len(numbers)
    assert (got["x"]["min_value"], got["x"]["max_value"]) == (numbers[0], numbers[-1])
    assert got["x"]["mean_value"] == pytest.approx(sum(numbers) / len(numbers))
    assert abs(got["n"]["distinct_count"] - len({r[1] for r in data})) <= 10 and got["s"]["distinct_count"] == 40
    for share, q in zip((0.25, 0.5, 0.75), got["x"]["quantiles"]):
        assert abs(sum(v <= q for v in numbers) / len(numbers) - share) < 0.01
    assert got["s"]["quantiles"] is None and got["s"]["min_value"] is None
    some = {r["column_name"]: r["row_count"] for r in stored.merged(spark, date(2024, 1, 2), date(2024, 1, 3)).collect()}
    assert some["n"] == sum(1 for r in data if r[0].day in (2, 3))
    plan = stored.days(spark, date(2024, 1, 2), date(2024, 1, 3))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    new = small(spark, [(at(0), 10_000, 0.0, "s1")], "ts timestamp, n int, x double, s string")
    failed = [r["column_name"] for r in stored.check_day(new).collect() if not r["success"]]
    assert failed == ["n"]
    assert all(r["success"] for r in stored.check_day(df.where("x is not null").limit(50)).collect())


# documents


def test_documents_follow_their_source(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def model():
        def run(texts):
            calls.add(len(texts))
            return [[float(len(t)), float(sum(map(ord, t)) % 97)] for t in texts]

        return run

    def fresh(data, name):
        table = DocumentTable(str(tmp_path / name), "d", "long", 40, 10, model=model, buckets=4)
        table.update(small(spark, data, "d long, body string"), "body")
        return rows(table.read(spark), "d", "pos", "text", "embedding")

    long = "One two three four five. Six seven eight nine ten. Eleven twelve thirteen fourteen. "
    data = [(1, long), (2, long * 2), (3, "short"), (4, None), (5, "")]
    table = DocumentTable(str(tmp_path / "t"), "d", "long", 40, 10, model=model, buckets=4)
    done = table.update(small(spark, data, "d long, body string"), "body")
    assert done["changed"] == 5 and calls.value == done["embedded"]
    assert rows(table.read(spark), "d", "pos", "text", "embedding") == fresh(data, "f1")
    before = calls.value
    assert table.update(small(spark, data, "d long, body string"), "body") == dict.fromkeys(done, 0) and calls.value == before
    changed = [(1, long + "An end."), (2, long * 2), (6, "short"), (7, long)]
    done = table.update(small(spark, changed, "d long, body string"), "body")
    assert (done["changed"], done["removed"]) == (3, 3) and calls.value == before + done["embedded"]
    assert 0 < done["embedded"] < done["chunks"]
    assert rows(table.read(spark), "d", "pos", "text", "embedding") == fresh(changed, "f2")
    kept = {r[0] for r in table.chunks.read(spark).select("hash").collect()}
    assert {r[0] for r in table.embeddings.read(spark).select("hash").collect()} == kept
    done = table.update(small(spark, [], "d long, body string"), "body")
    assert table.read(spark).count() == 0 and table.embeddings.read(spark).count() == 0


# traces


def test_traces_stay_up_to_date(spark, tmp_path):
    rnd = random.Random(6)
    links = [(f"dataset:n:{k}", f"job:n:{k:04d}", f"dataset:n:{k + 1}") for k in range(300)]
    links += [("dataset:n:0", "job:n:loop", "dataset:x:1"), ("dataset:x:1", "job:n:loop2", "dataset:x:2"), ("dataset:x:2", "job:a:first", "dataset:x:1")]
    pairs = [p for i, j, o in links for p in ((i, j), (j, o))]
    rnd.shuffle(pairs)
    table = LineageTable(str(tmp_path / "t"), 4)
    for part in range(3):
        table.update(small(spark, pairs[part::3], "src string, dst string"))
    edges = small(spark, pairs, "src string, dst string")
    assert rows(table.trace_all(spark), "dataset", "step", "job", "input_dataset") == rows(
        trace_all_upstream(edges), "dataset", "step", "job", "input_dataset"
    )
    one = rows(table.trace(spark, "dataset:n:300"), "step", "input_dataset", "job", "output_dataset")
    assert len(one) == 300 and one == rows(trace_upstream(edges, "dataset:n:300"), "step", "input_dataset", "job", "output_dataset")
    assert table.update(small(spark, pairs[:3], "src string, dst string")) == 0


def test_a_later_event_can_move_a_chain(spark, tmp_path):
    table = LineageTable(str(tmp_path / "t"), 2)
    chain = [("dataset:a", "job:m"), ("job:m", "dataset:b"), ("dataset:b", "job:n"), ("job:n", "dataset:c")]
    table.update(small(spark, chain, "src string, dst string"))
    more = [("dataset:0", "job:b"), ("job:b", "dataset:b")]  # a smaller job counts from now on
    table.update(small(spark, more, "src string, dst string"))
    want = trace_upstream(small(spark, chain + more, "src string, dst string"), "dataset:c")
    assert rows(table.trace(spark, "dataset:c")) == rows(want) == [(0, "dataset:0", "job:b", "dataset:b"), (1, "dataset:b", "job:n", "dataset:c")]


# time lines


def feature_rows(seed, n, keys=8):
    rnd = random.Random(seed)
    return [(rnd.choice([None, *range(keys)]), at(rnd.randrange(200)), at(rnd.randrange(50)), rnd.randrange(1000)) for _ in range(n)]


FEATURES = "k int, ts timestamp, made timestamp, v int"


@pytest.mark.parametrize("how", [{}, {"block_rows": 4}, {"block_rows": 3, "slice_blocks": 2}])
def test_time_line_equals_the_join(spark, tmp_path, how):
    data = feature_rows(1, 400)
    entity = small(spark, [(k, at(h), h) for k in (*range(9), None) for h in range(-5, 210, 13)], "k int, et timestamp, n int")
    line = TimeLine(str(tmp_path / "t"), ("k",), "ts", ("v",), "made", buckets=4, **how)
    with pytest.raises(ValueError, match="no rows"):
        line.join(entity, "et")
    line.add(small(spark, data[:200], FEATURES))
    for part in (data[200:300], data[300:]):  # earlier and later rows, and equal instants
        line.add(small(spark, part, FEATURES))
    for ttl in (None, timedelta(hours=20)):
        side = Side(small(spark, data, FEATURES), ("k",), "ts", {"v": "w"}, ttl, "made")
        want = rows(asof_join(entity, side, "et"), "k", "et", "n", "w")
        assert rows(line.join(entity, "et", ttl, {"v": "w"}), "k", "et", "n", "w") == want
    line.compact(spark)
    assert len(line._segments(spark)) == 1
    assert rows(line.join(entity, "et", ttl, {"v": "w"}), "k", "et", "n", "w") == want
    with pytest.raises(ValueError, match="collide"):
        line.join(entity.withColumn("v", F.lit(1)), "et")


def big_plan(spark, line, entity):
    """The plan where nothing is small enough to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return line.join(entity, "et")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_retrieval_moves_entities_only(spark, tmp_path):
    line = TimeLine(str(tmp_path / "t"), ("k",), "ts", ("v",), buckets=4)
    for part in (1, 2):
        line.add(small(spark, feature_rows(part, 200), FEATURES))
    entity = small(spark, [(1, at(3))], "k int, et timestamp")
    plan = big_plan(spark, line, entity)
    assert plan.count("SortMergeJoin") == 2 and plan.count("Bucketed: true") == 2
    assert plan.count("Exchange") == 1  # of the entity rows, once for all segments


def test_time_line_in_another_catalog(spark, tmp_path):
    line = TimeLine(str(tmp_path / "t"), ("k",), "ts", ("v",), buckets=2)
    line.add(small(spark, feature_rows(3, 50), FEATURES))
    entity = small(spark, [(k, at(90)) for k in range(8)], "k int, et timestamp")
    want = rows(line.join(entity, "et"))
    for s in line._segments(spark):
        spark.sql(f"drop table {s['name']}")  # external: its files stay
    assert rows(line.join(entity, "et")) == want
    assert "Bucketed: true" in big_plan(spark, line, entity)
