"""Near-duplicates by SimHash, found by hashing balls that meet half way.

Two fingerprints at most ``max_bits`` apart have a common value within half that
distance of both, so each emits every value in its half-radius ball, the values
are shuffled, and fingerprints that meet are verified. An odd radius has no whole
half: the 64 bits are cut into three groups, and of two fingerprints that differ
by the full odd distance at least one group holds a difference. Leaving that group
out, the rest is an even distance apart and balls of half of it meet. So for three
bits every fingerprint emits 3 x (1 + 43) masked values instead of the 2,081 that
a ball of two bits has, and no pair is lost.

Fingerprints that meet are never paired all with all. Within a meeting point two
fingerprints are linked when the left-out bits differ by at most one (then the
distance is at most three, whatever the rest), or when they have no flip at all
and the left-out bits differ by at most three; both are looked up by flipping bits.
Each meeting point passes on one link per member.

Defined cases: fewer words than a shingle give the whole sequence as the only
shingle; no words, or a null text, give fingerprint zero, linked like any other.
Equal fingerprints are one node, so copies in any number cost one row. Empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import shuffle_partitions

from .common import MARK, components, join_groups, per_text, stored

SEED = 42  # of the shingle hash
GROUPS = ((0, 21), (21, 22), (43, 21))  # (first bit, width): the bits left out in turn
RUN_ROWS = 500_000  # rows looked at together within a task
POINTS_PER_TASK = 100_000  # whose variants a task makes


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit SimHash of the lower-cased words' shingles, repeats included."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # of ASCII only: A-Z, and space and \t to \r
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle or None], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def make():
        return lambda i, text: [(i, int(np.uint64(fingerprint(text, shingle)).astype(np.int64)))]

    return per_text(docs, id_col, text_col, make, "id long, fp long")


def _plan(max_bits: int) -> list[tuple[int, np.ndarray]]:
    """For every group left out: its mask and the flips of the half-radius ball over the other bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3")
    out = []
    for first, width in GROUPS if max_bits % 2 else ((0, 0),):
        mask = ((1 << width) - 1) << first
        free = [1 << b for b in range(64) if not mask >> b & 1]
        flips = [0] + [sum(c) for k in range(1, max_bits // 2 + 1) for c in combinations(free, k)]
        out.append((mask, np.array(flips, np.uint64)))
    return out


def variants(points: DataFrame, max_bits: int) -> DataFrame:
    """(g, v, fp): every value in the half-radius ball of each fingerprint, per left-out group."""
    plan = _plan(max_bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(all_fps), 4096):
                fps = all_fps[at : at + 4096]
                for g, (mask, flips) in enumerate(plan):
                    values = ((fps & ~np.uint64(mask))[:, None] ^ flips).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(values), g, np.int32)),
                            pa.array(values.view(np.int64)),
                            pa.array(np.repeat(fps, len(flips)).view(np.int64)),
                        ],
                        names=["g", "v", "fp"],
                    )

    return points.select("fp").mapInArrow(run, "g int, v long, fp long")


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows 0..n-1 linked by (a, b): the first row each one reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _links(g: np.ndarray, v: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by meeting point (g, v), at most one per row."""
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])))
    run = np.cumsum(new) - 1
    many = np.bincount(run)[run] > 1
    g, v, fp, run = g[many], v[many], fp[many], run[many]
    if not len(fp):
        return fp, fp
    masks = np.array([m for m, _ in _plan(max_bits)], np.uint64)[g]
    shifts = np.array([first for first, _ in GROUPS], np.uint64)[g] if max_bits % 2 else np.zeros(len(g), np.uint64)
    key = run.astype(np.int64) << 22 | ((fp & masks) >> shifts).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, fp, plain = key[order], fp[order], ((fp & ~masks) == v)[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    a, b = [same], [same + 1]

    def look(rows: np.ndarray, flips: Iterable[int]) -> None:
        keys = key[rows]
        for flip in flips:
            want = keys ^ flip
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = (keys[at] == want) & (want > keys)
            if hit.any():
                a.append(rows[hit])
                b.append(rows[at[hit]])

    if max_bits % 2:
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        look(heads, [1 << i for i in range(22)])
    if max_bits == 3:
        rows = np.flatnonzero(plain)
        runs = key[rows] >> 22
        rows = rows[np.isin(runs, runs[1:][runs[1:] == runs[:-1]])]
        if len(rows):
            look(rows, [sum(c) for k in (2, 3) for c in combinations([1 << i for i in range(22)], k)])
    a, b = np.concatenate(a), np.concatenate(b)
    near = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits  # the verification
    root = _smallest(len(fp), a[near], b[near])
    keep = root != np.arange(len(fp))
    return fp[keep], fp[root[keep]]


def links(points: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): links that join every two fingerprints at most ``max_bits`` apart, directly or in steps."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool):
            g, v, fp = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
            cut = len(v)
            if not last:  # the last meeting point may go on in the next batch
                cut = int(np.flatnonzero((v != v[-1]) | (g != g[-1]))[-1]) + 1 if (v[0], g[0]) != (v[-1], g[-1]) else 0
            rest = pa.RecordBatch.from_arrays([pa.array(x[cut:]) for x in (g, v, fp)], names=["g", "v", "fp"])
            held[:] = [rest] if cut < len(v) else []
            if cut:
                return _links(g[:cut], v[:cut].view(np.uint64), fp[:cut].view(np.uint64), max_bits)
            return np.empty(0, np.uint64), np.empty(0, np.uint64)

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= RUN_ROWS:
                a, b = flush(False)
                size = 0
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)
        if held:
            a, b = flush(True)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    # a point becomes over a hundred rows, so points are spread by number, not by their few bytes
    parts = max(shuffle_partitions(points.sparkSession), -(-points.count() // POINTS_PER_TASK))
    met = variants(points.select("fp").repartition(parts), max_bits).repartition("g", "v").sortWithinPartitions("g", "v")
    return met.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3
) -> DataFrame:
    """(id, fp, component_id) per row: component_id is the smallest id reachable by links, itself included."""
    marked = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    points = marked.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    roots = components(links(points, max_bits))
    grouped = points.join(roots, points.fp == roots.node, "left").select(
        "fp", "first", "n", F.coalesce("root", "fp").alias("root")
    )
    firsts = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(grouped.join(firsts, "root").select("fp", "n", "component_id"), "groups")
    return join_groups(marked, named, "fp", "n").select("id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3
) -> DataFrame:
    """The rows of ``docs`` but those whose id is not the smallest of its near-duplicate group.

    A row without an id is kept. Rows that repeat an id go or stay together.
    """
    goes = near_duplicates(docs, id_col, text_col, shingle, max_bits).where("id <> component_id")
    goes = goes.select(F.col("id").alias(f"{MARK}id")).distinct()
    return docs.join(goes, docs[id_col].cast("long") == F.col(f"{MARK}id"), "left_anti")
