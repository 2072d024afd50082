"""Repeated passages across documents, found from fixed blocks.

A passage counts as repeated when a window of ``window`` words of a document starts
earlier too: in a document with a smaller id, or earlier in the same one. Every
document is an index of non-overlapping blocks of half a window; every rolling
window of that length probes it. A repeated window always holds a whole block of
its earlier occurrence, so only windows that touch a hit, on either side, can be
repeats. These are extended to whole windows and compared with the earliest start
of the same words; consecutive ones make up the maximal exact repeats.

Windows are judged on the input, so what is removed does not depend on what was
removed before. Both steps are questions of chunks to the whole corpus (see
``chunks``): a passage in any number of documents is one entry per chunk.

Defined cases: a null text has no words; a document shorter than a window loses
nothing; a null id is smaller than any id; rows that repeat an id are equally early
and do not remove each other's words at equal places. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .chunks import NO_ID, Chunk, answer, answers_of, ask, buckets_for, chunked, mix, requests, with_answers
from .common import stored

BASE, BASE_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _window_hashes(words: np.ndarray, size: int, base: np.uint64 = BASE) -> np.ndarray:
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(size if n > 0 else 0):
        out *= base
        out += words[j : j + n]
    return mix(out)


class _Windows:
    """The windows of a chunk that lie in one document."""

    def __init__(self, chunk: Chunk, window: int):
        self.window, self.block = window, window // 2
        self.hashed = chunk.hashes()[chunk.words] if len(chunk.words) else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(chunk.ids)), chunk.sizes)
        self.place = np.arange(len(self.hashed)) - chunk.starts[self.doc]
        self.room = chunk.sizes[self.doc] - self.place

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and keys of the rolling windows that probe."""
        at = np.flatnonzero(self.room >= self.block)
        return at, _window_hashes(self.hashed, self.block)[at]

    def near_hits(self, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, keys and check values of the whole windows that hold a hit; ``hits`` per probe.

        Key and check value together have 96 bits, so that even the windows of a
        corpus of 100 TB do not meet by chance.
        """
        at, _ = self.probes()
        seen = np.zeros(len(self.hashed) + 1, np.int64)
        seen[at[hits] + 1] = 1
        seen = np.cumsum(seen)
        whole = np.flatnonzero(self.room >= self.window)
        whole = whole[seen[whole + self.window - self.block + 1] > seen[whole]]
        keys = _window_hashes(self.hashed, self.window)[whole]
        check = _window_hashes(mix(self.hashed), self.window, BASE_2)[whole] >> np.uint64(32)
        return whole, keys, check.astype(np.uint32)


def _merge_probes(keys, slot, values):
    windows = np.bincount(slot, values[0] & 3)
    blocks = np.bincount(slot, values[0] >> 2)
    return ((windows >= 2) & (blocks >= 1))[slot].astype(np.uint8), None


def _merge_starts(keys, slot, values):
    doc, place, check = values
    order = np.lexsort((place, doc, check, slot))
    new = np.concatenate(([True], (np.diff(slot[order]) > 0) | (check[order][1:] != check[order][:-1])))
    first = np.empty(len(order), np.int64)  # of every entry, the earliest start of its words
    first[order] = order[new][np.cumsum(new) - 1]
    doc0, place0 = doc[first], place[first]
    return ((doc0 < doc) | ((doc0 == doc) & (place0 < place))).astype(np.uint8), None


def repeated_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, with_text: bool = False
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, repeats[, kept]) per row.

    ``repeats`` are the removed stretches as (first word, words); ``kept`` is what is
    left, joined by single spaces. ``window`` must be even.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be an even number of words")
    chunks = chunked(docs, id_col, text_col, lower=False)
    buckets = buckets_for(chunks)

    def probe(chunk: Chunk) -> list[tuple]:
        windows = _Windows(chunk, window)
        at, keys = windows.probes()
        distinct, which, n = np.unique(keys, return_inverse=True, return_counts=True)
        is_block = np.bincount(which, windows.place[at] % windows.block == 0, len(distinct)) > 0
        value = (np.minimum(n, 2) | (is_block.astype(np.int64) << 2)).astype(np.uint8)
        return requests(chunk.number, distinct, [value], buckets)

    def candidates(chunk: Chunk, rows: list[dict]):
        windows = _Windows(chunk, window)
        _, which = np.unique(windows.probes()[1], return_inverse=True)
        hits = answers_of(rows, "hits", np.uint8)[which] > 0 if len(which) else np.empty(0, bool)
        whole, keys, check = windows.near_hits(hits)
        doc, place = chunk.ids[windows.doc[whole]], windows.place[whole]
        order = np.lexsort((place, doc, check, keys))
        whole, keys, check, doc, place = (x[order] for x in (whole, keys, check, doc, place))
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (check[1:] != check[:-1])
        return whole, keys, check, doc, place, new

    def extend(chunk: Chunk, rows: list[dict]) -> list[tuple]:
        _, keys, check, doc, place, new = candidates(chunk, rows)
        return requests(chunk.number, keys[new], [doc[new], place[new], check[new]], buckets)

    def remove(chunk: Chunk, rows: list[dict]) -> list[tuple]:
        whole, keys, _, doc, place, new = candidates(chunk, rows)
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        later = (doc > doc[first][group]) | (place > place[first][group]) if len(keys) else np.empty(0, bool)
        gone = whole[later | (answers_of(rows, "starts", np.uint8)[group] > 0)] if len(keys) else whole
        edges = np.zeros(len(chunk.words) + 1, np.int64)
        np.add.at(edges, gone, 1)
        np.add.at(edges, gone + window, -1)
        removed = np.cumsum(edges[:-1]) > 0
        out = []
        for i, start, size in zip(chunk.ids.tolist(), chunk.starts.tolist(), chunk.sizes.tolist()):
            own = removed[start : start + size]
            kept = b" ".join([chunk.vocabulary[w] for w in chunk.words[start : start + size][~own].tolist()])
            steps = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
            spans = [{"start": int(s), "length": int(e - s)} for s, e in zip(steps[::2], steps[1::2])]
            row = (None if i == NO_ID else i, size, int(own.sum()), hashlib.sha256(kept).hexdigest(), spans)
            out.append(row + ((kept.decode("utf-8", "surrogatepass"),) if with_text else ()))
        return out

    hits = stored(answer(ask(chunks, probe), [np.uint8], _merge_probes), "hits")
    asked = with_answers(chunks, {"hits": hits}, extend, "chunk long, bucket int, keys binary, values array<binary>")
    starts = answer(asked, [np.int64, np.int64, np.uint32], _merge_starts)
    ddl = "id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:int,length:int>>"
    return with_answers(chunks, {"hits": hits, "starts": starts}, remove, ddl + ", kept string" * with_text)
