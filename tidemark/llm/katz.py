"""A Katz back-off language model of word pairs, and the scores it gives whole texts.

Counts are discounted by Good-Turing, and what a word's discounted followers leave
over is spread over all other words by how often these occur, with a weight that
makes every distribution sum to one. Single words are discounted the same way; what
they leave over is the probability of any word not seen in training. So

    P(b | a) = d(n(a b)) n(a b) / n(a)      for a pair that was seen
             = weight(a) P(b)               for a word a that was seen
             = P(b)                         otherwise
    P(b)     = d(n(b)) n(b) / N             for a word that was seen, else what is left

A word all of whose followers were seen too often to be discounted leaves nothing
over; its followers' probabilities are then scaled by n(a) / (n(a) + 1).

Every text is its words and one end; the first word follows a start.

The tables are too large to send to every task and every position of the corpus
needs an entry, so chunks of documents ask for the entries they need (see
``chunks``): first counts of words and pairs, then back-off weights. The first
chunk that brings a pair adds it to its first word's sums, so each distinct pair
counts once. Counts and weights are written as tables partitioned by order and by
range of keys; keys are 64-bit hashes of a word or a pair.

Defined cases: a null or empty text is one end; a null id is a training id. With no
training rows every word is unknown with probability one. Repeated rows count as
often as they occur and are scored each. Empty tables give no rows. Other columns
are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import NO_ID, Chunk, answer, answers_of, ask, buckets_for, chunked, mix, requests, with_answers
from .common import stored

UPTO = 5  # counts above this are not discounted
END, START = b" end", b" start"  # no word holds a space
OWNER = np.uint64(1 << 63)  # set in the answer of the chunk that accounts for a pair


def discounts(count_of_counts: list[int]) -> np.ndarray:
    """d(0) = 0, d(1) ... d(UPTO), then 1, from the numbers of entries seen once, twice and so on.

    Good-Turing by Katz's formula, on counts of counts smoothed as in Simple Good-Turing:
    a line through the logarithms of 1 ... UPTO + 1 and of how many entries were seen
    that often, each averaged over the gap around it. Raw counts of counts are uneven
    where texts come in copies and give estimates over one; on a line every estimate
    lies between 0 and 1. Only where fewer than two counts of counts are there, and so
    no line, absolute discounting with a half stands in.
    """
    out = np.ones(UPTO + 2)
    out[0] = 0
    n = np.array(count_of_counts[: UPTO + 1], float)
    r = np.arange(1, UPTO + 1)
    seen = np.flatnonzero(n) + 1
    if len(seen) < 2:
        out[1:-1] = (r - 0.5) / r
        return out
    last, following = np.append(0, seen[:-1]), np.append(seen[1:], 2 * seen[-1] - seen[-2])
    slope = np.polyfit(np.log(seen), np.log(2 * n[seen - 1] / (following - last)), 1)[0]
    power = slope + 1  # (r + 1) n(r + 1) / (r n(r)) is (1 + 1 / r) to this power
    if abs(power) < 1e-6:
        out[1:-1] = 1 - np.log1p(1 / r) / np.log(UPTO + 1)  # the limit
    else:
        beyond = (UPTO + 1) ** power
        out[1:-1] = ((1 + 1 / r) ** power - beyond) / (1 - beyond)
    return out


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(counts, UPTO + 1).astype(np.int64)] * counts


@dataclass
class Totals:
    """Numbers that describe a whole table of counts."""

    tokens: int
    types: int
    d: np.ndarray
    mass: float  # discounted counts of all entries

    @property
    def unknown(self) -> float:
        """The probability of a word not seen in training."""
        return 1 - self.mass / self.tokens if self.tokens else 1.0

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d) / max(self.tokens, 1), self.unknown)


def totals(counted: DataFrame) -> Totals:
    """From the record rows of a count: tokens, types, and how many entries were seen 1 to UPTO + 1 times."""
    sums = (
        counted.where("kind = 'record'")
        .select(F.posexplode("sums").alias("at", "value"))
        .groupBy("at")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    n = [0] * (3 + UPTO + 1)
    for row in sums:
        n[row["at"]] = row["value"]
    tokens, types, low, *seen = n
    d = discounts(seen)
    counts = np.arange(1, UPTO + 1)
    return Totals(tokens, types, d, tokens - low + float((discounted(counts, d) * seen[:UPTO]).sum()))


def _sums(counts: np.ndarray) -> list[int]:
    """[tokens, types, tokens of entries with at most UPTO, entries seen once, ..., UPTO + 1 times]."""
    some = np.bincount(np.minimum(counts, UPTO + 2), minlength=UPTO + 3)[1 : UPTO + 2]
    return [int(counts.sum()), int((counts > 0).sum()), int((some[:UPTO] * np.arange(1, UPTO + 1)).sum()), *some.tolist()]


def _add(slot: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, values.dtype)
    np.add.at(out, slot, values)
    return out


def _merge_words(keys, slot, values):
    counts = _add(slot, values[0], len(keys))
    return counts[slot], (counts > 0, [counts], _sums(counts.astype(np.int64)))


def _merge_pairs(keys, slot, values):
    counts = _add(slot, values[0], len(keys))
    first = np.full(len(keys), len(slot))
    np.minimum.at(first, slot, np.arange(len(slot)))
    answers = counts[slot]
    answers[first] |= OWNER
    return answers, (counts > 0, [counts], _sums(counts.astype(np.int64)))


def _merge_weights(keys, slot, values):
    seen, lower = (_add(slot, v, len(keys)) for v in values[:2])
    context = np.zeros(len(keys))
    context[slot] = values[2]  # the same for every chunk
    whole = seen >= context  # nothing was discounted
    left = np.where(whole, 1 / (context + 1), 1 - seen / np.maximum(context, 1))
    weights = np.where(context > 0, left / (1 - lower), 1.0)
    share = np.where(whole & (context > 0), context / (context + 1), 1.0)
    # an answer is negative where the seen followers are scaled down
    return np.where(share < 1, -weights, weights)[slot], (context > 0, [weights, share], [])


class _Pairs:
    """A chunk's words and word pairs, with which documents train."""

    def __init__(self, chunk: Chunk, folds: int):
        self.chunk = chunk
        n_words, n_docs = len(chunk.vocabulary), len(chunk.ids)
        self.hashed = chunk.hashes(END, START)
        self.order = np.argsort(self.hashed)  # of the words by key, as asked
        self.held = np.array(
            [i != NO_ID and zlib.crc32(str(i).encode()) % folds == 0 for i in chunk.ids.tolist()], bool
        )
        # every document's words and its end, and what stands before each
        self.sizes = chunk.sizes + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        ends = self.starts + chunk.sizes
        self.word = np.full(len(chunk.words) + n_docs, n_words, np.int64)
        inside = np.ones(len(self.word), bool)
        inside[ends] = False
        self.word[inside] = chunk.words
        self.before = np.concatenate(([n_words + 1], self.word[:-1])) if len(self.word) else self.word
        self.before[self.starts] = n_words + 1
        self.trains = np.repeat(~self.held, self.sizes)

    def word_counts(self) -> np.ndarray:
        """Training counts by word number; the start counts nothing."""
        return np.bincount(self.word[self.trains], minlength=len(self.hashed)).astype(np.uint64)

    def pairs(self):
        """Distinct pair keys, where each occurs first, the key of every position, and training counts."""
        keys = mix(self.hashed[self.before] * np.uint64(0x9E3779B97F4A7C15) + self.hashed[self.word])
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        return distinct, first, which, np.bincount(which[self.trains], minlength=len(distinct)).astype(np.uint64)

    def by_word(self, sorted_answers: np.ndarray) -> np.ndarray:
        out = np.empty_like(sorted_answers)
        out[self.order] = sorted_answers
        return out

    def known_counts(self, rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Corpus counts of this chunk's words, as words and as what stands before a word."""
        counts = self.by_word(answers_of(rows, "words", np.uint64)).astype(np.int64)
        before = counts.copy()
        before[-1] = counts[-2]  # a start for every end
        return counts, before


@dataclass
class Model:
    """The tables of a fitted model, and the chunks it was fitted on."""

    chunks: DataFrame
    words: DataFrame
    pairs: DataFrame
    weights: DataFrame
    word_totals: Totals
    pair_totals: Totals
    folds: int


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> Model:
    """Learn from the rows whose crc32 of the id is not divisible by ``folds``.

    ``words``, ``pairs`` and ``weights`` are tables partitioned by ``kind``: rows of kind
    ``record`` are the model (per range of keys: packed keys with counts, or with
    weights and scales), rows of kind ``answer`` what the chunks of ``docs`` asked for.
    """
    chunks = chunked(docs, id_col, text_col, lower=True)
    buckets = buckets_for(chunks)

    def ask_words(chunk: Chunk) -> list[tuple]:
        p = _Pairs(chunk, folds)
        return requests(chunk.number, p.hashed[p.order], [p.word_counts()[p.order]], buckets)

    def ask_pairs(chunk: Chunk) -> list[tuple]:
        keys, _, _, counts = _Pairs(chunk, folds).pairs()
        return requests(chunk.number, keys, [counts], buckets)

    words = stored(answer(ask(chunks, ask_words), [np.uint64], _merge_words), "model-words", "kind", "bucket")
    pairs = stored(answer(ask(chunks, ask_pairs), [np.uint64], _merge_pairs), "model-pairs", "kind", "bucket")
    word_totals, pair_totals = totals(words), totals(pairs)

    def ask_weights(chunk: Chunk, rows: list[dict]) -> list[tuple]:
        p = _Pairs(chunk, folds)
        counts, before = p.known_counts(rows)
        _, first, _, _ = p.pairs()
        found = answers_of(rows, "pairs", np.uint64)
        own = first[(found & OWNER > 0) & (found != OWNER)]
        seen = discounted((found & ~OWNER)[(found & OWNER > 0) & (found != OWNER)].astype(np.int64), pair_totals.d)
        lower = word_totals.word_probability(counts[p.word[own]])
        sums = [np.bincount(p.before[own], v, len(p.hashed)) for v in (seen, lower)]
        return requests(chunk.number, p.hashed[p.order], [v[p.order] for v in (*sums, before.astype(float))], buckets)

    ddl = "chunk long, bucket int, keys binary, values array<binary>"
    asked = with_answers(chunks, {"words": words, "pairs": pairs}, ask_weights, ddl)
    weights = stored(answer(asked, [float, float, float], _merge_weights), "model-weights", "kind", "bucket")
    return Model(chunks, words, pairs, weights, word_totals, pair_totals, folds)


def score(model: Model) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of the model's documents.

    ``score`` is the log10 probability of the text; ``base_score`` that of single words
    with a tenth added to every count.
    """
    word_totals, pair_totals, folds = model.word_totals, model.pair_totals, model.folds

    def make(chunk: Chunk, rows: list[dict]) -> list[tuple]:
        p = _Pairs(chunk, folds)
        counts, before = p.known_counts(rows)
        weights = p.by_word(answers_of(rows, "weights", float))
        _, _, which, _ = p.pairs()
        pair = (answers_of(rows, "pairs", np.uint64) & ~OWNER).astype(np.int64)[which]
        lower = np.log10(word_totals.word_probability(counts))
        with np.errstate(divide="ignore"):
            weight = np.where(before > 0, np.log10(np.abs(weights)), 0.0)
            share = np.log10(np.maximum(before + (weights < 0), 1))  # of a follower: its count over this
        backed = weight[p.before] + lower[p.word]  # where a pair was not seen
        full = np.log10(np.maximum(discounted(pair, pair_totals.d), 1e-300)) - share[p.before]
        logs = np.where(pair > 0, full, backed)
        n, v = word_totals.tokens, word_totals.types
        base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))[p.word]
        known = (counts > 0)[p.word].astype(np.int64)
        add = lambda x: np.add.reduceat(x, p.starts).tolist()
        return [
            (None if i == NO_ID else i, h, size, k, n, b, s)
            for i, h, size, k, b, s in zip(
                chunk.ids.tolist(), p.held.tolist(), p.sizes.tolist(), add(known), add(base), add(logs)
            )
        ]

    topics = {"words": model.words, "pairs": model.pairs, "weights": model.weights}
    ddl = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return with_answers(model.chunks, topics, make, ddl)
