"""Benchmark passages in documents, found by the q-gram lemma and banded alignment.

Texts are compared in lower case with every run of other characters than letters
and digits as one space. A benchmark item is looked for in pieces of ``width``
characters (a shorter item whole), one from every start, so a quoted part of that
length is found wherever it lies in the item. A stretch of a document within
``k`` edits of a piece of length ``m`` shares at least m + 1 - q (k + 1) of its
q-grams, all on at most k + 1 neighbouring diagonals. So the q-grams a document
shares with an item are counted in overlapping bands of diagonals and bands below
that bound are dropped. One edit spoils at most q q-grams in a row, so a piece whose
missing q-grams take more than ``k`` such rows to cover is dropped as well. Pieces that
stand in the document letter by letter are read off their diagonal, and what is left is
aligned within the band.

The benchmark is read in blocks of bounded size, and each block is laid against all
documents. Within a task a text is worked on in overlapping slices, and the shared
q-grams of a slice in groups of items that have at most ``PAIRS`` of them, so memory
depends neither on the number of items nor on the length of a text. An item that alone
has more, as where both texts repeat a sign or a line, is not counted pair by pair: each
distinct stretch of the slice that holds enough of the item's q-grams is laid against
each distinct piece once, and what is found counts wherever that stretch stands.

Defined cases: a null or empty text, on either side, matches nothing, and neither
does an item of fewer than ``least`` characters after normalising, which ordinary
prose would match by chance. Repeated rows give repeated matches. Empty tables give
no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MARK, per_text

BLOCK_CHARS = 1_000_000  # of benchmark text that a task holds
SLICE_CHARS = 200_000  # of a document looked at together
ALIGNED = 2000  # pieces aligned together
PAIRS = 1_500_000  # shared q-grams of a slice looked at together
BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "id long, item_id long, start long, end long, edits long"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case form, and whether it is a letter or digit, of every code point."""
    chars = [chr(c) for c in range(0x110000)]
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], np.uint32)
    return lower, np.array([c.isalnum() for c in chars])


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The characters compared, and where each stands in the text."""
    lower, word = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_word = word[points]
    keep = is_word.copy()
    keep[1:] |= is_word[:-1]
    at = np.flatnonzero(keep)
    chars = np.where(is_word[at], lower[points[at]], 32).astype(np.uint32)
    return (chars[:-1], at[:-1]) if len(chars) and chars[-1] == 32 else (chars, at)


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    n = len(chars) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(q):
        out *= BASE
        out += chars[j : j + n]
    return out


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for ``many[0]`` numbers, and so on."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _content(chars: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Two hashes in one number of the ``size`` characters from each start."""
    one, two = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for j in range(size):
        c = chars[starts + j].astype(np.uint64)
        one = one * BASE + c
        two = (two ^ c) * np.uint64(0x100000001B3)
    return one ^ (two << np.uint64(32) | two >> np.uint64(32))


def budget(m: int, q: int, rate: float) -> int:
    """Edits allowed in a piece of ``m`` characters: its share, as far as the lemma's bound stays at 4 or more."""
    return max(0, min(int(m * rate), (m - 3) // q - 1))


def merged(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(item, start, end, fewest edits) with the stretches of an item that meet as one."""
    out: list[list[int]] = []
    for k, s, e, d in sorted(found):
        if out and out[-1][0] == k and s <= out[-1][2]:
            out[-1][2:] = [max(out[-1][2], e), min(out[-1][3], d)]
        else:
            out.append([k, s, e, d])
    return [tuple(x) for x in out]


class Block:
    """The q-gram index of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]], q: int, width: int, rate: float, least: int):
        self.q, self.rate = q, rate
        self.ids, self.chars, self.pieces = [], [], []
        found, owner, place = [], [], []
        for item_id, text in items:
            chars, _ = normalise(text)
            if len(chars) < max(least, q):
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.chars.append(chars)
            m = min(width, len(chars))
            self.pieces.append((m, budget(m, q, rate)))
            own = grams(chars, q)
            found.append(own)
            owner.append(np.full(len(own), k))
            place.append(np.arange(len(own)))
        if not found:
            self.keys = np.empty(0, np.uint64)
            return
        found, owner, place = map(np.concatenate, (found, owner, place))
        order = np.argsort(found, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.keys, self.first, self.many = np.unique(found[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.keys >> np.uint64(44)] = True
        self.most_edits = budget(max(m for m, _ in self.pieces), q, rate)
        self.need = np.array([m + 1 - q * (budget(m, q, rate) + 1) for m, _ in self.pieces])
        self.longest = max(map(len, self.chars))

    def regions(self, chars: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the pieces found in a slice."""
        own = grams(chars, self.q)
        at = np.flatnonzero(self.seen[own >> np.uint64(44)])
        if len(at) < self.need.min():
            return []
        slot = np.minimum(np.searchsorted(self.keys, own[at]), len(self.keys) - 1)
        hit = self.keys[slot] == own[at]
        at, slot = at[hit], slot[hit]
        if not len(at):
            return []
        order = np.argsort(slot, kind="stable")
        at, slot = at[order], slot[order]
        distinct, start, there = np.unique(slot, return_index=True, return_counts=True)
        entry = _ranges(self.first[distinct], self.many[distinct])  # of the index, for every distinct shared q-gram
        start, there = np.repeat(start, self.many[distinct]), np.repeat(there, self.many[distinct])
        load = np.bincount(self.owner[entry], there, len(self.ids))
        out = []
        for k in np.flatnonzero(load > PAIRS).tolist():
            out += self.by_stretches(k, chars, own)
        load[load > PAIRS] = 0
        group = (np.cumsum(load) // PAIRS).astype(np.int64)  # of an item
        for g in np.unique(group[load > 0]).tolist():
            mine = (load[self.owner[entry]] > 0) & (group[self.owner[entry]] == g)
            doc_at = at[_ranges(start[mine], there[mine])]
            pairs = np.repeat(entry[mine], there[mine])
            out += self.counted(chars, doc_at, self.owner[pairs], self.place[pairs])
        return out

    def counted(self, chars: np.ndarray, doc_at: np.ndarray, item: np.ndarray, item_at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Pieces found along the bands that hold enough of the given shared q-grams."""
        # bands of 2 (k + 1) diagonals, one beginning every k + 1: any k + 1 lie in one of them
        step = self.most_edits + 1
        band = (doc_at - item_at + self.longest) // step
        bands = (self.longest + len(chars)) // step + 2
        key = np.concatenate((item * bands + band, item * bands + band - 1))
        mask = (1 << (2 * len(key)).bit_length()) - 1
        bins = (key * 0x9E3779B1 >> 7) & mask  # a coarse count first
        busy = np.flatnonzero(np.bincount(bins)[bins] >= np.tile(self.need[item], 2))
        if not len(busy):
            return []
        names, which, count = np.unique(key[busy], return_inverse=True, return_counts=True)
        good = count >= self.need[names // bands]
        order = np.argsort(which, kind="stable")
        ends = np.cumsum(count)
        todo: dict[int, list[tuple[int, int, int]]] = {}
        out = []
        for n in np.flatnonzero(good):
            rows = busy[order[ends[n] - count[n] : ends[n]]] % len(doc_at)
            k, low = int(names[n]) // bands, (int(names[n]) % bands) * step - self.longest
            m, _ = self.pieces[k]
            likely = self.likely(k, item_at[rows])
            if not likely.any():
                continue
            for a, b, s in self.verbatim(k, chars, doc_at[rows], item_at[rows]):
                out.append((k, s, s + b - a, 0))
                likely[a : b - m + 1] = False
            some = todo.setdefault(m, [])
            some += [(k, start, low) for start in np.flatnonzero(likely).tolist()]
            while len(some) >= ALIGNED:
                out = merged(out + self.align(chars, m, some[:ALIGNED], 2 * step))
                del some[:ALIGNED]
        for m, some in todo.items():
            if some:
                out += self.align(chars, m, some, 2 * step)
        return out

    def by_stretches(self, k: int, chars: np.ndarray, own: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Pieces of item ``k`` found in a slice by its distinct stretches; ``own`` are the slice's q-grams."""
        m, most = self.pieces[k]
        item = grams(self.chars[k], self.q)
        shared = np.concatenate(([0], np.cumsum(np.isin(own, item))))
        # a piece within its edits of a stretch from s lies in [s, s + m + most); what it is aligned with begins most earlier
        starts = np.arange(max(len(chars) - (m - most) + 1, 0))
        last = np.minimum(starts + m + most - self.q + 1, len(own))
        starts = starts[shared[last] - shared[starts] >= self.need[k]]
        wide = m + 2 * most + 1
        padded = np.concatenate((np.zeros(most, np.uint32), chars, np.zeros(wide, np.uint32)))
        _, first, which = np.unique(_content(padded, starts, wide), return_index=True, return_inverse=True)
        pieces = np.unique(_content(self.chars[k], np.arange(len(self.chars[k]) - m + 1), m), return_index=True)[1]
        # per distinct stretch the best match: start and end relative to the stretch, edits
        best = np.full((len(first), 3), -1)
        todo: list[tuple[int, int, int, int]] = []

        def settle() -> None:
            found = self.align(chars, m, [t[1:] for t in todo], 1, whole=True)
            for (r, *_), (_, s, e, edits) in zip(todo, found):
                if edits <= most and (best[r, 2] < 0 or edits < best[r, 2]):
                    best[r] = s - starts[first[r]], e - starts[first[r]], edits
            todo.clear()

        for r, s in enumerate(starts[first].tolist()):
            likely = self.likely(k, np.flatnonzero(np.isin(item, own[s : s + m + most - self.q + 1])))
            for piece in pieces[likely[pieces]].tolist():
                todo.append((r, k, piece, s - piece))
                if len(todo) >= ALIGNED:
                    settle()
        if todo:
            settle()
        hit = best[which]
        there = hit[:, 2] >= 0
        spans = np.stack([starts[there] + hit[there, 0], starts[there] + hit[there, 1], hit[there, 2]], axis=1)
        if not len(spans):
            return []
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        reach = np.maximum.accumulate(spans[:, 1])
        cuts = np.concatenate(([0], np.flatnonzero(spans[1:, 0] > reach[:-1]) + 1))
        edits = np.minimum.reduceat(spans[:, 2], cuts)
        ends = reach[np.append(cuts[1:], len(spans)) - 1]
        joined = zip(spans[cuts, 0].tolist(), ends.tolist(), edits.tolist())
        return [(k, max(0, s), min(len(chars), e), d) for s, e, d in joined]

    def likely(self, k: int, shared: np.ndarray) -> np.ndarray:
        """Whether the piece from each start of item ``k`` can be within its edits, by the item's shared q-grams."""
        m, most = self.pieces[k]
        n = len(self.chars[k]) - self.q + 1
        missing = np.arange(n + 1)
        missing[shared] = n
        missing = np.minimum.accumulate(missing[::-1])[::-1]  # the next one from each place
        starts = np.arange(len(self.chars[k]) - m + 1)
        at = missing[starts]
        for _ in range(most):
            at = missing[np.minimum(at + self.q, n)]
        return at > starts + m - self.q

    def verbatim(self, k: int, chars: np.ndarray, doc_at: np.ndarray, item_at: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, place in ``chars``) of the parts of item ``k`` of a piece or more that stand there unchanged."""
        order = np.lexsort((item_at, doc_at - item_at))
        doc_at, item_at = doc_at[order], item_at[order]
        cuts = np.flatnonzero((np.diff(doc_at) != 1) | (np.diff(item_at) != 1)) + 1
        first, last = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(order)])) - 1
        out = []
        for n in np.flatnonzero(item_at[last] + self.q - item_at[first] >= self.pieces[k][0]):
            a, b, s = int(item_at[first[n]]), int(item_at[last[n]]) + self.q, int(doc_at[first[n]])
            if np.array_equal(self.chars[k][a:b], chars[s : s + b - a]):
                out.append((a, b, s))
        return out

    def align(
        self, chars: np.ndarray, m: int, some: list[tuple[int, int, int]], diagonals: int, whole: bool = False
    ) -> list[tuple[int, int, int, int]]:
        """Align pieces of length ``m`` along their bands; keeps those within the edit budget, or all as they come if ``whole``."""
        k = budget(m, self.q, self.rate)
        wide = diagonals + 2 * k  # a path may leave the counted diagonals by the budget
        padded = np.concatenate((np.zeros(self.longest + wide, np.uint32), chars, np.zeros(self.longest + 2 * wide + m, np.uint32)))
        first = np.array([start + low - k for _, start, low in some])  # of each region, in the slice
        region = padded[(first + self.longest + wide)[:, None] + np.arange(m + wide)]
        piece = np.stack([self.chars[i][start : start + m] for i, start, _ in some])
        column = np.arange(wide)
        cost = np.zeros((len(some), wide), np.int32)
        for i in range(m):  # cost[b]: edits of piece[:i] against a stretch that ends at region[i + b]
            match = cost + (region[:, i : i + wide] != piece[:, i : i + 1])
            match[:, :-1] = np.minimum(match[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(match - column, axis=1) + column
        best = cost.argmin(axis=1)
        edits = cost[np.arange(len(some)), best]
        out = []
        for n in range(len(some)) if whole else np.flatnonzero(edits <= k):
            end = int(first[n]) + m + int(best[n])
            out.append((some[n][0], max(0, end - m), min(len(chars), end), int(edits[n])))
        return out

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, fewest edits) of the stretches of a text that hold pieces of an item."""
        if not len(self.keys) or not text:
            return []
        chars, place = normalise(text)
        found = []
        overlap = self.longest + 4 * (self.most_edits + 1)
        for at in range(0, max(1, len(chars) - overlap), SLICE_CHARS):
            found += [(k, at + s, at + e, d) for k, s, e, d in self.regions(chars[at : at + SLICE_CHARS + overlap])]
        return [(self.ids[k], int(place[s]), int(place[e - 1]) + 1, d) for k, s, e, d in merged(found)]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks; the driver holds one partition of the benchmark at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull())
    for item_id, text in rows.toLocalIterator():
        block.append((item_id, text))
        size += len(text)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    q: int = 8,
    width: int = 80,
    rate: float = 0.09,
    least: int = 24,
) -> DataFrame:
    """(id, item_id, start, end, edits): stretches of documents that hold a piece of a benchmark item.

    ``rate`` is the share of edits allowed in a piece; ``edits`` the fewest of the
    pieces in the stretch; ``start`` and ``end`` are code points of the text.
    """
    spark = docs.sparkSession
    out = None
    for items in _blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(items)  # about BLOCK_CHARS of text

        def make(shared=shared) -> Callable:
            block = Block(shared.value, q, width, rate, least)
            return lambda i, text: [(i, *found) for found in block.matches(text)]

        part = per_text(docs, id_col, text_col, make, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any passage of the benchmark, with all their columns.

    A row without an id goes with every contaminated row that has none.
    """
    goes = find_passages(docs, benchmark, id_col, text_col).select(F.col("id").alias(f"{MARK}id")).distinct()
    return docs.join(goes, docs[id_col].cast("long").eqNullSafe(F.col(f"{MARK}id")), "left_anti")
