"""Phrases that are collocations, from suffix trees built group by group of prefixes.

The counts of all phrases of up to ``MOST`` words are the totals of the nodes of a tree
over all suffixes of all pieces, cut at that depth. As in vertical partitioning, the
tree is never one thing: prefixes are counted level by level, a prefix too frequent
for the memory budget is told apart by its next word, and prefixes are dealt into
groups that fit the budget. A group's part of the tree is built by itself, and its
nodes' counts are read from the totals of its leaves, level by level upwards.

1. Words are counted per language.
2. Pairs of frequent words are counted by hash.
3. Suffixes that begin with a frequent pair, cut before the first pair that is not
   frequent, are counted per chunk of documents and sent to the group of their prefix.

A phrase below ``least`` is of no interest here, and a phrase is never more frequent
than a pair in it, so the cut changes no count that is kept. Frequent and hot keys are
known to the tasks by bitmaps of hashes, sized by how many there are up to a fixed
bound: a false hit keeps a suffix longer, or splits a prefix further, and changes no
result either. Words travel as text, so no result rests on a hash.

Every task first counts a chunk of documents by itself, so what a group gets is one row
per distinct suffix and chunk, also where copies fill the corpus.

Defined cases: a null text has no words; a null language is ``und``. Repeated rows
count as often as they occur. Empty tables and languages without words give no rows.
Other columns are not read. Texts of any length are one document of a chunk.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import mix
from .common import stored

MOST = 4  # words of a phrase
CHUNK_WORDS = 2_000_000  # counted together in one task
GROUP_ROWS = 1_000_000  # suffixes of a group, about
BATCH = 50_000
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30  # of a bitmap
EXACT = "decimal(38,0)"

# What ends a piece.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_TO_BREAK = bytes.maketrans(BREAKS, b"\n" * len(BREAKS))
_MARK = b"\xff"  # a break among words; no word in UTF-8 holds this byte

WORDS = "lang string, word string, n long"
PAIRS = "key long, n long"
SUFFIXES = "part int, deep int, lang string, pair string, third string, fourth string, n long"
NODES = "lang string, phrase string, size int, f long"


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _chunks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(language, distinct words, words by number) for chunks of documents; number 0 is a break."""

    def new():
        index: dict[bytes, int] = defaultdict(count().__next__)
        index[_MARK]
        return index, []

    open_: dict[str, tuple] = {}
    n = 0
    end = np.zeros(1, np.int64)

    def flush():
        for lang, (index, parts) in open_.items():
            yield lang, list(index), np.concatenate([end, *parts])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            if lang not in open_:
                open_[lang] = new()
            index, parts = open_[lang]
            found = (text.as_py() or b"").lower().translate(_TO_BREAK).replace(b"\n", b" " + _MARK + b" ").split()
            parts += [np.fromiter(map(index.__getitem__, found), np.int64, len(found)), end]
            n += len(found)
            if n >= most:
                yield from flush()
                open_, n = {}, 0
    yield from flush()


def _hashes(lang: str, vocabulary: list[bytes]) -> np.ndarray:
    """What Spark's xxhash64 gives for the language, a space and the word; 0 for a break."""
    import xxhash

    start = lang.encode() + b" "
    return np.array([0] + [xxhash.xxh64_intdigest(start + w, 42) for w in vocabulary[1:]], np.uint64)


def _followed(hashed: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of a prefix followed by a word."""
    return mix(hashed * np.uint64(0x9E3779B97F4A7C15) + word)


class Marks:
    """A set of 64-bit keys as a bitmap; it may hold more keys than were put in."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.bits = bits
        data = np.zeros(bits // 8, np.uint8)
        for number, block in blocks.items():
            data[number * 4096 : (number + 1) * 4096] = np.frombuffer(block, np.uint8)
        self.data = data

    @classmethod
    def of(cls, keys: DataFrame, key: str) -> Marks:
        """Sixteen bits a key, within fixed bounds; built by Spark in blocks of 4096 bytes."""
        wanted = 16 * keys.count()
        bits = LEAST_BITS
        while bits < min(wanted, MOST_BITS):
            bits *= 2
        at = F.pmod(F.col(key), F.lit(bits))
        blocks = (
            keys.select(F.floor(at / 32768).cast("long").alias("block"), (at % 32768).alias("bit"))
            .groupBy("block")
            .agg(F.bitmap_construct_agg("bit").alias("data"))
        )
        return cls(bits, {r["block"]: bytes(r["data"]) for r in blocks.collect()})

    def has(self, hashed: np.ndarray) -> np.ndarray:
        at = (hashed & np.uint64(self.bits - 1)).astype(np.int64)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _batches(columns: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    for first in range(0, len(arrays[0]), BATCH):
        part = [a.slice(first, BATCH) for a in arrays]
        yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(part, schema)], schema=schema)


def _name(lang: str, n: int) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([lang])).cast(pa.string())


def _words(texts: DataFrame, most: int) -> DataFrame:
    """(lang, word, n) per chunk."""
    schema = _arrow(WORDS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, vocabulary, words in _chunks(batches, most):
            n = np.bincount(words, minlength=len(vocabulary))[1:]
            yield from _batches([_name(lang, len(n)), pa.array(vocabulary[1:], pa.binary()), n], schema)

    return texts.mapInArrow(run, WORDS)


class _Pairs:
    """A chunk's pairs of frequent words: distinct ones with hashes, and which one begins where."""

    def __init__(self, lang: str, vocabulary: list[bytes], words: np.ndarray, frequent: Marks):
        self.hashed = _hashes(lang, vocabulary)
        known = frequent.has(self.hashed)
        known[0] = False
        self.words = words = np.where(known[words], words, 0)
        self.at = np.flatnonzero((words[:-1] > 0) & (words[1:] > 0))
        codes = words[self.at] * len(vocabulary) + words[self.at + 1]
        distinct, self.which, self.n = np.unique(codes, return_inverse=True, return_counts=True)
        self.first, self.second = distinct // len(vocabulary), distinct % len(vocabulary)
        self.keys = _followed(self.hashed[self.first], self.hashed[self.second])


def _pairs(texts: DataFrame, frequent, most: int) -> DataFrame:
    """(key, n) per chunk for pairs of frequent words; the key is a hash."""
    schema = _arrow(PAIRS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, most):
            pairs = _Pairs(*chunk, frequent.value)
            yield from _batches([pairs.keys.view(np.int64), pairs.n], schema)

    return texts.mapInArrow(run, PAIRS)


def _suffixes(texts: DataFrame, frequent, paired, hot_words, hot_pairs, parts: int, most: int) -> DataFrame:
    """Suffixes of two to four words per chunk, with the group of their prefix.

    ``deep`` is how many words the prefix has: one, or as many as it takes for the
    prefix not to be hot.
    """
    schema = _arrow(SUFFIXES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, vocabulary, words in _chunks(batches, most):
            p = _Pairs(lang, vocabulary, words, frequent.value)
            good = paired.value.has(p.keys)
            # the number of the frequent pair that begins at a position, or -1
            pair_at = np.full(len(words) + 2, -1)
            pair_at[p.at] = np.where(good[p.which], p.which, -1)
            start = np.flatnonzero(pair_at >= 0)
            one, two, three = (pair_at[start + k] for k in range(3))
            three = np.where(two >= 0, three, -1)
            distinct, first, n = np.unique(
                (one * (len(good) + 1) + two + 1) * (len(good) + 1) + three + 1
                if len(good) < 1 << 20
                else _rank(one, two) * (len(good) + 1) + three + 1,
                return_index=True,
                return_counts=True,
            )
            if not len(distinct):
                continue
            one, two, three = one[first], two[first], three[first]
            third = np.where(two >= 0, p.second[two], 0)
            fourth = np.where(three >= 0, p.second[three], 0)
            # prefixes told apart as far as they are hot
            hot = hot_pairs.value.has(p.keys)
            deep = np.ones(len(one), np.int64)
            group = p.hashed[p.first[one]]
            for level, too_many, following in (
                (2, hot_words.value.has(group), p.hashed[p.second[one]]),
                (3, hot[one], p.hashed[third]),
                (4, (two >= 0) & hot[two], p.hashed[fourth]),
            ):
                further = (deep == level - 1) & too_many
                deep[further] = level
                group = np.where(further, _followed(group, following), group)
            part = ((group >> np.uint64(11)) % np.uint64(parts)).astype(np.int32)
            names = pa.array([None, *vocabulary[1:]], pa.binary())
            text = lambda numbers: names.take(pa.array(numbers))
            pair = pc.binary_join_element_wise(text(p.first[one]), text(p.second[one]), b" ")
            columns = [part, deep, _name(lang, len(one)), pair, text(third), text(fourth), n]
            yield from _batches(columns, schema)

    return texts.mapInArrow(run, SUFFIXES)


def _rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of distinct (a, b), for values whose product passes 64 bits."""
    return np.unique(a * (int(b.max(initial=0)) + 2) + b + 1, return_inverse=True)[1]


def _tree(least: int):
    """Node totals of one group's subtree, from its leaves upwards."""
    schema = _arrow(NODES)

    def run(table: pa.Table) -> pa.Table:
        def total(t: pa.Table, by: list[str]) -> pa.Table:
            summed = t.group_by(["deep", "lang", *by], use_threads=False).aggregate([("n", "sum")])
            return summed.rename_columns({"n_sum": "n"})

        out = []
        level, by = table, ["pair", "third", "fourth"]
        for size in (4, 3, 2):
            level = total(level, by)  # leaves first, then what is above them
            nodes = level if size == 2 else level.filter(pc.is_valid(level.column(by[-1])))
            # a node above its group's prefix has parts in other groups
            kept = nodes.filter(pc.or_(pc.greater_equal(nodes.column("n"), least), pc.greater(nodes.column("deep"), size)))
            phrase = pc.binary_join_element_wise(*[kept.column(c) for c in by], " ") if size > 2 else kept.column("pair")
            sizes = pa.array(np.full(kept.num_rows, size, np.int32))
            out.append(pa.table([kept.column("lang"), phrase, sizes, kept.column("n")], schema=schema))
            by = by[:-1]
        return pa.concat_tables(out)

    return run


def phrase_counts(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30,
    group_rows: int = GROUP_ROWS, chunk_words: int = CHUNK_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to four words seen ``least`` times: (lang, phrase, size, f); and (lang, n), the words of a language."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = stored(_words(texts, chunk_words).groupBy("lang", "word").agg(F.sum("n").alias("n")), "phrase-words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = words.where(F.col("n") >= least)
    hot = F.col("n") > max(group_rows // 4, least)
    keyed = often.withColumn("key", F.xxhash64(F.concat_ws(" ", "lang", "word")))
    # fixed bounds on the size of a bitmap, whatever the corpus
    frequent = sc.broadcast(Marks.of(keyed, "key"))
    hot_words = sc.broadcast(Marks.of(keyed.where(hot), "key"))
    pairs = _pairs(texts, frequent, chunk_words).groupBy("key").agg(F.sum("n").alias("n"))
    pairs = stored(pairs.where(F.col("n") >= least), "phrase-pairs")
    paired = sc.broadcast(Marks.of(pairs, "key"))
    hot_pairs = sc.broadcast(Marks.of(pairs.where(hot), "key"))
    parts = (pairs.agg(F.sum("n")).first()[0] or 0) // group_rows + 1
    found = _suffixes(texts, frequent, paired, hot_words, hot_pairs, parts, chunk_words)
    nodes = found.groupBy("part").applyInArrow(_tree(least), NODES)
    longer = nodes.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    single = often.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("f"))
    return stored(longer.unionByName(single), "phrases"), sizes


def _big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(EXACT)


def _part(start: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", start, size), " ")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, k: int = 2000, **how: int
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``k`` phrases of every language.

    A phrase seen ``a`` times is scored by its weakest cut, floor(2000000 a / (l + r)) for
    parts seen ``l`` and ``r`` times. A phrase inside a longer one that holds four fifths
    of its occurrences or more is left out.
    """
    phrases, sizes = phrase_counts(docs, lang_col, text_col, least, **how)
    split = phrases.where("size > 1").withColumn("words", F.split("phrase", " "))
    cut = split.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select(
        "lang", "phrase", F.col("f").alias("a"), "cut",
        _part(F.lit(1), F.col("cut")).alias("first"), _part(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("rest"),
    )
    counted = phrases.select("lang", "phrase", "f")
    left = counted.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counted.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cut = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    over, under = _big("a") * F.lit(2_000_000).cast("decimal(8,0)"), _big("l") + _big("r")
    scored = cut.select("lang", "phrase", "a", "l", "r", "cut", F.call_function("div", over, under).alias("score"))
    worst = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("worst"), F.first("a").alias("a")
    )
    inner = (
        split.where("size > 2")
        .withColumn("inside", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
        .withColumn("start", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("inside") + 1)))
        .select("lang", _part(F.col("start"), F.col("inside")).alias("phrase"), "f")
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("around"))
    )
    kept = worst.join(inner, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (F.lit(5).cast("decimal(1,0)") * _big("around") < F.lit(4).cast("decimal(1,0)") * _big("a"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("worst.score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("worst.l").alias("l"), F.col("worst.r").alias("r"),
        "n", F.col("worst.score").cast("long").alias("score"),
    )
