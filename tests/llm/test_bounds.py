"""Bounds of memory, time and rounds on odd inputs."""

import random
import re
import resource
import time

import numpy as np
import pytest

from tidemark.llm import common, decontaminate, secret_scan
from tidemark.llm.common import components
from tidemark.llm.decontaminate import Block, normalise


def brute_matches(block, text):
    """Item ids with a piece within its edits of some stretch, by full alignment of every piece."""
    chars, _ = normalise(text)
    found = set()
    for k, item in enumerate(block.chars):
        m, most = block.pieces[k]
        for piece in {item[s : s + m].tobytes() for s in range(len(item) - m + 1)}:
            piece = np.frombuffer(piece, np.uint32)
            cost = np.zeros(len(chars) + 1, np.int64)
            for i, c in enumerate(piece, 1):
                match = cost[:-1] + (chars != c)
                gap = np.concatenate(([i], np.minimum(match, cost[1:] + 1)))
                column = np.arange(len(gap))
                cost = np.minimum.accumulate(gap - column) + column
            if cost.min() <= most:
                found.add(block.ids[k])
    return found


def odd_pairs():
    rnd = random.Random(11)
    prose = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(n))
    line = "the quick brown fox, again and again; "
    items = [(1, "a" * 400), (2, "ab" * 150), (3, line * 8), (4, prose(60)), (5, "=" * 30 + "x" * 200), (6, "a" * 120 + prose(30))]
    texts = ["a" * 900, "ab" * 300, "ba" * 41, line * 20, prose(200), "x" * 500 + prose(20), "a" * 60 + "b" + "a" * 60, prose(20) + line * 5 + prose(20)]
    texts += [prose(10) + items[3][1][40:200] + prose(10), "a" * 200 + items[5][1][100:230], "abab" * 15 + "c" + "abab" * 15, ("aaaaaaab" * 40)]
    broken = list(line * 6)
    for k in range(9, len(broken), 31):
        broken[k] = "#"
    return items, [*texts, "".join(broken)]


@pytest.mark.parametrize("pairs", [1_500_000, 2000, 1])
def test_passages_are_those_of_full_alignment(monkeypatch, pairs):
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    items, texts = odd_pairs()
    block = Block(items, 8, 80, 0.09, 24)
    for text in texts:
        assert {k for k, *_ in block.matches(text)} == brute_matches(block, text), text[:80]


def test_stretches_do_not_depend_on_the_path(monkeypatch):
    items, texts = odd_pairs()
    block = Block(items[3:4], 8, 80, 0.09, 24)
    text = texts[8]
    usual = block.matches(text)
    monkeypatch.setattr(decontaminate, "PAIRS", 1)
    (k, s, e, d), = usual
    (k2, s2, e2, d2), = block.matches(text)
    assert (k, d) == (k2, d2) and abs(s - s2) <= 7 and abs(e - e2) <= 7


def test_periodic_texts_take_little_memory_and_time():
    rule = "-=" * 15 + "a" * 30 + " one two "
    items = [(1, "a" * 5000), (2, "x" * 2000), (3, "ab" * 2500), (4, rule * 30)]
    block = Block(items, 8, 80, 0.09, 24)
    block.matches("warm up " * 100)
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    assert {k for k, *_ in block.matches("a" * 200_000)} == {1}
    assert {k for k, *_ in block.matches("ab" * 100_000)} == {3}
    assert {k for k, *_ in block.matches(rule * 2000)} == {4}
    assert time.perf_counter() - start < 60
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # KB


def base_spans(text):
    """The contract's three shapes, written out."""
    out = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.IGNORECASE | re.ASCII):
        if len(m.group(2)) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if m.end() - m.start() >= 16:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if m.end() - m.start() >= 32:
            out.append((m.start(), 2, m.end(), "hex"))
    return [(kind, s, e) for s, _, e, kind in sorted(out)]


def test_spans_against_the_shapes_written_out():
    rnd = random.Random(7)
    letters = "abcdef0123456789ABCXYZ+/_.=-"
    run = lambda n: "".join(rnd.choices(letters, k=n))
    encode = lambda text: list(range(len(text) // 2 + 1))  # noqa: E731  # everything looks random
    for _ in range(300):
        parts = ['password="' + run(9) + '"', "AKIA" + "".join(rnd.choices("ABC123", k=rnd.randint(8, 20))), run(25), "secret: " + run(5)]
        parts += ["".join(rnd.choices("0123456789abcdef", k=rnd.randint(20, 70))), "api_key='" + run(30) + "'", "Token=" + run(40), "é plain"]
        text = rnd.choice([" ", ",", ""]).join(rnd.choices(parts, k=6))
        found = secret_scan.spans(text, encode, 2.2)
        base = base_spans(text)
        assert [s for s in found if s[0] != "random"] == base
        runs = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text)]
        free = [(s, e) for s, e in runs if not any(a < e and s < b for _, a, b in base)]
        want = [(s, e) for s, e in free if secret_scan.is_random(text[s:e], encode, 2.2)]
        assert [(s, e) for kind, s, e in found if kind == "random"] == want


def test_many_spans_take_linear_time():
    rnd = random.Random(1)
    text = " ".join("".join(rnd.choices("0123456789abcdef", k=40)) for _ in range(200_000))
    start = time.perf_counter()
    found = secret_scan.spans(text, lambda t: list(t), 2.2)
    assert len(found) == 200_000 and time.perf_counter() - start < 10


def test_a_chain_in_order_takes_few_rounds(spark, monkeypatch):
    rounds = []
    ends = common._ends
    monkeypatch.setattr(common, "_ends", lambda hook: rounds.append(1) or ends(hook))
    n = 5000
    edges = spark.range(n - 1).selectExpr("id as a", "id + 1 as b")
    got = components(edges)
    assert got.count() == n and got.where("root <> 0").isEmpty()
    assert len(rounds) <= 3
