"""Operators on tables: odd rows, empty tables, several tasks, and brute force on small data."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chunks, katz, packing, simhash
from tidemark.llm.chat import conversations, digests, fold, render
from tidemark.llm.common import components, join_groups
from tidemark.llm.decontaminate import drop_contaminated, find_passages
from tidemark.llm.exact_dedup import DigestIndex, decide, keep_unique, own_index
from tidemark.llm.quality import Discriminant, classify, fit, keep_good
from tidemark.llm.repeats import repeated_words
from tidemark.llm.secret_scan import scan
from tidemark.llm.token_counts import count_tokens, fits_budget, tokens_of_prefix

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# exact dedup


def test_exact_decisions(spark, odd_documents):
    docs = texts_of(odd_documents)
    got = decide(odd_documents, own_index(spark)).collect()
    assert len(got) == len(docs)
    by_text = {}
    for i, t in docs:
        by_text.setdefault(t, []).append(i)
    want = []
    for i, t in docs:
        ids = [x for x in by_text[t] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, hashlib.sha256(t.encode()).digest(), keep, len(by_text[t]), i == keep))
    assert sorted(map(str, want)) == sorted(str((r[0], bytes(r[1]), *r[2:])) for r in got)


def test_exact_filter_keeps_one_row_and_every_column(spark, odd_documents):
    out = keep_unique(odd_documents, own_index(spark))
    assert out.columns == odd_documents.columns
    kept = texts_of(out)
    assert sorted({t for _, t in texts_of(odd_documents)}) == sorted(t for _, t in kept)
    assert keep_unique(odd_documents.limit(0), own_index(spark)).count() == 0


def test_index_persists_and_is_idempotent(spark, tmp_path):
    where = str(tmp_path / "index")
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    later = spark.createDataFrame([(9, "a"), (10, "c"), (11, "c")], "doc_id long, text string")
    kept = lambda df: sorted(r["id"] for r in decide(df, DigestIndex(spark, where, 4)).where("kept").collect())
    assert kept(first) == [2, 3]
    assert kept(first) == [2, 3]  # run again after a crash
    assert kept(later) == [11]
    index = DigestIndex(spark, where, 4)
    assert index.read().count() == 3
    groups = spark.createDataFrame([(b"x", 1)], "digest binary, keep_id long")
    plan = groups.repartition(4, "digest").hint("merge").join(index.read(), "digest", "left_anti")
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # the index is not moved


# SimHash


def brute_components(points, bits):
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in points:
        for b in points:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in points}


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_balls_find_every_link(spark, bits, monkeypatch):
    monkeypatch.setattr(simhash, "RUN_ROWS", 50)  # meeting points that go on over several batches
    rnd = random.Random(bits)
    points = set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(12):  # spread over groups, and within one group of bits
            flips = rnd.sample(range(64), rnd.randint(0, 4)) if rnd.random() < 0.5 else rnd.sample(range(21), rnd.randint(0, 4))
            p = centre
            for b in flips:
                p ^= 1 << b
            points.add(p - 2**64 if p >= 2**63 else p)
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(df, bits)).collect()}
    assert {p: got.get(p, p) for p in points} == brute_components(points, bits)


def test_near_duplicates_of_odd_rows(spark, odd_documents, no_documents):
    docs = texts_of(odd_documents)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    fps = [(i, signed(simhash.fingerprint(t))) for i, t in docs]
    roots = brute_components({f for _, f in fps}, 3)
    firsts = {}
    for i, f in fps:
        if i is not None:
            firsts[roots[f]] = min(i, firsts.get(roots[f], i))
    want = sorted(((i, f, firsts.get(roots[f])) for i, f in fps), key=str)
    assert rows(simhash.near_duplicates(odd_documents)) == want
    assert simhash.near_duplicates(no_documents).count() == 0
    kept = simhash.keep_one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    assert {i for i, _ in texts_of(kept)} == {i for i, f in fps if i is None or i == firsts[roots[f]]}


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == dict.fromkeys(range(n), 0) | {1000: 1000, 1001: 1000}


def test_hot_groups_are_spread(spark):
    left = spark.range(5000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    out = join_groups(left, groups, "k", "n")
    assert out.count() == 5000 and out.where("k = 0 and m = 2999 and n = 3000").count() == 3000


# packing


def test_pieces_and_places(spark, odd_documents, no_documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    want = Counter()
    for i, t in texts_of(odd_documents):
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        head = len(ids) % 64 or 64
        cuts = [0, *range(head, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            data = b"".join(x.to_bytes(4, "little") for x in ids[a:b])
            want[i, k, a, b - a, zlib.crc32(data), tuple(ids[a:b])] += 1
    cut = packing.pieces(odd_documents, BYTE_BPE, public_tokenizers.PATTERN, 2, 64, with_ids=True)
    out = packing.pack(cut, 64).collect()
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in out) == want
    used = {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(packing.pieces(no_documents, BYTE_BPE, public_tokenizers.PATTERN, 2, 64), 64).count() == 0


def test_numbering_over_slices(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 10)
    items = spark.range(200).select("id", F.lit(0).alias("piece"), F.lit(0).alias("start"), (F.col("id") % 3 + 1).alias("length"))
    out = packing.pack(items, 4).collect()
    places = {(r["sequence_id"], r["offset"]) for r in out}
    assert len(places) == 200 and len({s for s, _ in places}) == -(-sum(r["length"] for r in out) // 4)


# token counts and secrets


def test_token_count_columns(spark, odd_documents, no_documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    tokens = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    docs = texts_of(odd_documents)
    assert rows(count_tokens(odd_documents, WORD_BPE)) == sorted(((i, len(t.encode()), tokens(t)) for i, t in docs), key=str)
    assert count_tokens(no_documents, WORD_BPE).count() == 0
    few = odd_documents.where(F.length("text") < 200)
    at = count_tokens(few, WORD_BPE, prefixes="characters").join(few.select(F.col("doc_id").alias("id"), "text"), "id")
    for r in at.select("text", tokens_of_prefix(F.lit(7)).alias("n"), fits_budget(5).alias("cut")).collect():
        assert r["n"] == tokens(r["text"][:7])
        assert tokens(r["text"][: r["cut"]]) <= 5 and (r["cut"] == len(r["text"]) or tokens(r["text"][: r["cut"] + 1]) > 5)


def test_scan_rows(spark, odd_documents, no_documents):
    out = scan(odd_documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert out.count() == odd_documents.count()
    assert {r["base_sha256"] for r in out.collect()} == {hashlib.sha256(b"").hexdigest()}
    assert scan(no_documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


# chat


def folded(events):
    """The same fold, event by event."""
    out = {}
    for conv, seq, kind, turn, role, text in sorted(set(events), key=lambda e: (str(e[0]), e[1], e[5] or "")):
        if kind == "regenerate":
            for key in [k for k in out if k[0] == conv and k[1] > turn]:
                del out[key]
        key = (conv, turn, role or "")
        out[key] = (text or "") if kind != "delta" else out.get(key, "") + (text or "")
    return sorted(((*k, v) for k, v in out.items()), key=str)


def test_fold_of_a_log(spark):
    rnd = random.Random(10)
    events = []
    for conv in (1, 2, 3):
        for seq in range(40):
            turn = rnd.randint(0, 4)
            kind = rnd.choice(["delta"] * 6 + ["edit", "regenerate"])
            events.append((conv, seq, kind, turn, "assistant" if turn % 2 else "user", rnd.choice(["a", "bc", None, ""])))
    df = spark.createDataFrame(events + events[:5], "conv_id long, seq long, kind string, turn long, role string, text string")
    assert rows(fold(df)) == folded(events)
    assert fold(df.limit(0)).count() == 0


def test_format_read_back(spark):
    said = "</s>[INST] ok [/INST] <|im_end|>\n\\"
    talks = {1: [("user", said), ("assistant", said), ("assistant", "")], 2: [("system", "s"), ("tool", "é\n")], None: [("assistant", "x")]}
    events = [(c, k, "delta", k, r, t) for c, turns in talks.items() for k, (r, t) in enumerate(turns)]
    events.append((3, None, "delta", None, None, None))
    df = spark.createDataFrame(events, "conv_id long, seq long, kind string, turn long, role string, text string")
    segments = render(fold(df))
    got = {r["conv_id"]: r for r in digests(segments).collect()}
    whole = {r["conv_id"]: r["formatted"] for r in conversations(segments).collect()}
    for c, turns in (talks | {3: [("", "")]}).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == len(whole[c])
    assert digests(segments.limit(0)).count() == 0


# quality


def test_classifier_of_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(11)] + [(3, None), (None, 1), (999, 0)], "id long, label long")
    out = classify(odd_documents, labels).collect()
    assert len(out) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert all(r["held_out"] == (r["id"] is not None and zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in out)
    assert classify(no_documents, labels).count() == 0
    assert {r["score"] for r in classify(odd_documents, labels.limit(0)).collect()} == {0.5}
    kept = keep_good(odd_documents, labels)
    assert kept.columns == odd_documents.columns
    assert kept.count() == sum(r["predicted"] for r in out)


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    out = classify(spark.read.parquet(f"{folder}/documents.parquet"), labels).where("held_out").join(labels, "id")
    right, n = out.agg(F.sum((F.col("predicted") == F.col("label")).cast("int")), F.count("*")).first()
    assert n > 50 and right / n > 0.97
    assert isinstance(fit(spark.createDataFrame([], "id long, x array<double>"), labels), Discriminant)


# decontamination


def test_passages_in_odd_tables(spark, odd_documents, no_documents, monkeypatch):
    from tidemark.llm import decontaminate

    item = "Which of these rivers flows through the northern plain before it meets the sea at last?"
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = odd_documents.select("doc_id", "text", "fp").unionByName(
        spark.createDataFrame([(100, "Start. " + item.upper() + " End.", "f"), (101, item[:50], "f")], "doc_id long, text string, fp string")
    )
    has = {i for i, t in texts_of(docs) if "one two three" in low(t)} | {100}
    for size in (decontaminate.BLOCK_CHARS, 10):  # one block, and a block per item
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", size)
        found = find_passages(docs, benchmark).collect()
        assert {r["id"] for r in found} == has
        text = dict(texts_of(docs))
        assert {text[r["id"]][r["start"] : r["end"]] for r in found if r["item_id"] == 1} == {item[:-1].upper()}
    left = drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns and {i for i, _ in texts_of(left)} == {i for i, _ in texts_of(docs)} - has
    assert find_passages(docs, benchmark.limit(0)).count() == 0
    assert find_passages(no_documents, benchmark).count() == 0


# repeats and the language model


def brute_repeats(docs, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in docs]
    first = {}
    rank = lambda i: -1 if i is None else i
    for i, w in words:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, (rank(i), p)), (rank(i), p))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (rank(i), p):
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [2, 4, 20])
def test_repeats_against_brute_force(spark, odd_documents, window, monkeypatch):
    rnd = random.Random(window)
    made = [(500 + k, " ".join(rnd.choice("ab") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 60))), "") for k in range(40)]
    made += [(600 + k, made[k][1] + " tail", "") for k in range(10)]
    docs = odd_documents.select("doc_id", "text", "fp").unionByName(spark.createDataFrame(made, "doc_id long, text string, fp string"))
    want = brute_repeats(texts_of(docs), window)
    for limit in (50, 5_000_000):
        monkeypatch.setattr(chunks, "BUCKET_WORDS", 50 if limit == 50 else 4_000_000)
        out = repeated_words(docs.repartition(7) if limit == 50 else docs.coalesce(1), window=window, with_text=True)
        assert rows(out.select("id", "n_words", "n_removed", "kept_sha256", "kept")) == want
    assert all(r["n_removed"] == sum(s["length"] for s in r["repeats"]) for r in out.collect())


def test_repeats_of_nothing(no_documents):
    assert repeated_words(no_documents).count() == 0


def brute_katz(docs, folds):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [" end"]) for i, t in docs]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % folds == 0
    one, two, before = Counter(), Counter(), Counter()
    for i, w in words:
        if not held(i):
            one.update(w)
            pairs = list(zip([" start", *w], w))
            two.update(pairs)
            before.update(a for a, _ in pairs)
    n, v = sum(one.values()), len(one)
    d = [katz.discounts([Counter(c.values())[r] for r in range(1, katz.UPTO + 2)]) for c in (one, two)]
    cut = lambda k, c: d[k][min(c, katz.UPTO + 1)] * c
    unknown = 1 - sum(cut(0, c) for c in one.values()) / n if n else 1.0
    single = lambda b: cut(0, one[b]) / n if one[b] else unknown
    seen, lower = Counter(), Counter()
    for (a, b), c in two.items():
        seen[a] += cut(1, c)
        lower[a] += single(b)

    def probability(a, b):
        whole = seen[a] >= before[a]
        if two[a, b]:
            return cut(1, two[a, b]) / (before[a] + whole)
        left = 1 / (before[a] + 1) if whole else 1 - seen[a] / before[a]
        return left / (1 - lower[a]) * single(b) if before[a] else single(b)

    for a in list(before)[:20]:  # exactly normalised
        assert abs(sum(probability(a, b) for b in one) + probability(a, "never seen") - 1) < 1e-9
    out = []
    for i, w in words:
        base = sum(log10((one[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        full = sum(log10(probability(a, b)) for a, b in zip([" start", *w], w))
        out.append((i, held(i), len(w), sum(one[x] > 0 for x in w), n, base, full))
    return sorted(out, key=lambda r: str(r[:5]))


def test_katz_against_brute_force(spark, odd_documents, monkeypatch):
    rnd = random.Random(11)
    made = [(500 + k, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 30)))) for k in range(120)]
    docs = odd_documents.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    want = brute_katz(texts_of(docs), 10)
    for size in (50, 4_000_000):
        monkeypatch.setattr(chunks, "BUCKET_WORDS", size)
        out = katz.score(katz.fit(docs.repartition(6) if size == 50 else docs)).collect()
        got = sorted((tuple(r) for r in out), key=lambda r: str(r[:5]))
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert sorted(map(str, [tuple(round(x, 6) for x in r[5:]) for r in got])) == sorted(
            map(str, [tuple(round(x, 6) for x in r[5:]) for r in want])
        )


def test_katz_without_training_rows(spark, no_documents):
    assert katz.score(katz.fit(no_documents)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    one = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    (row,) = katz.score(katz.fit(one)).collect()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["score"]) == (True, 3, 0, 0, 0.0)


def test_discounts():
    assert katz.discounts([0] * 6).tolist() == [0, 0.5, 0.75, 2.5 / 3, 3.5 / 4, 0.9, 1]
    d = katz.discounts([1000, 300, 140, 80, 52, 36])
    assert (d[1:6] > 0).all() and (d[1:6] < 1).all() and d[0] == 0 and d[6] == 1


@pytest.mark.parametrize(
    "n",
    [  # words and pairs of the given documents, sf0.001 and sf0.01, seen 1 to 6 times in training
        [16884, 3826, 1232, 564, 512, 208],
        [45798, 5858, 1223, 308, 371, 88],
        [51146, 14744, 5459, 2720, 2557, 1132],
        [206637, 32233, 5107, 1903, 2578, 674],
        [9, 0, 2, 0, 0, 1],
        [5, 7, 9, 11, 13, 15],
        [4, 1, 0, 0, 0, 0],
    ],
)
def test_discounts_of_uneven_counts_are_good_turing(n):
    import numpy as np

    some = [r for r in range(1, 7) if n[r - 1]]
    gaps = [b - a for a, b in zip([0, *some], [*some[1:], 2 * some[-1] - some[-2]])]
    line = np.polyfit([np.log(r) for r in some], [np.log(2 * n[r - 1] / g) for r, g in zip(some, gaps)], 1)
    smooth = [0, *np.exp(np.polyval(line, np.log(range(1, 7))))]
    beyond = 6 * smooth[6] / smooth[1]
    want = [((r + 1) * smooth[r + 1] / smooth[r] / r - beyond) / (1 - beyond) for r in range(1, 6)]
    d = katz.discounts(n)
    assert d[1:6].tolist() == pytest.approx(want) and d[0] == 0 and d[6] == 1
    assert (d[1:6] > 0).all() and (d[1:6] < 1).all() and (np.diff(d) > 0).all()
    # the smoothing's limit, a table on which Good-Turing estimates are the counts themselves
    assert katz.discounts([60, 30, 20, 15, 12, 10])[1:6].tolist() == pytest.approx(
        [1 - np.log(1 + 1 / r) / np.log(6) for r in range(1, 6)], abs=1e-5
    )


def test_packed_arrays():
    import numpy as np

    for values in (np.array([], np.uint64), np.array([3, 9, 2**63, 2**64 - 1], np.uint64)):
        assert chunks.unpack_sorted(chunks.pack_sorted(values)).tolist() == values.tolist()
    floats = np.array([0.5, -1e300])
    assert chunks.unpack(chunks.pack(floats), float).tolist() == floats.tolist()
