"""A stored text index: ranked search that reads the postings of its terms only.

Documents are numbered in ranges of some thousand. A row of the index is a block: one
term in one range, with the places of its documents there and how often the term
occurs. Which documents lie at a range's places and how long they are stands once, in
the range's own row. Blocks are stored by bucket of terms and sorted by term, so a
search reads its terms' buckets, the ranges' rows and nothing else.

With each block lie its best pairs of (count, length): the ones no other document of
the block beats in both. Whatever the corpus' averages are by the time of a search,
the block's best score is that of one of these pairs. The sum over a query's terms
bounds every score in a range. A search scores the most promising ranges first, and
after that only those whose bound reaches the worst score it would keep; the answers
are those of scoring everything. A range is scored for all its queries in one place,
where each of its blocks comes once, and k documents per query leave it.

Documents are added as segments and segments are merged by ``compact``. What counts is
listed by a ``Pointer``: a search sees whole segments only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.stem import porter
from ..session import reliable, spread_small
from ..sources.pointer import Pointer
from .latest import top_rows
from .text import BM25_B, BM25_K1, BM25_MIN_IDF, BROADCAST_PAIRS, joined_text, query_terms, tokens
from .topk import DIGITS

RANGE_DOCS = 4096
RANGE_WORDS = 1_000_000  # a range ends when it has that many
FIRST_RANGES = 8  # scored per query before any is skipped
FEW_TERMS = 1000  # named in the scan's filter
SLACK = 2e-9  # scores are rounded to nine digits
GROUP_QUERIES = 4096  # that a range is scored for at a time

Weight = Callable[[Any, Any, Any], Any]  # (count, length, idf), columns or arrays, to what a term adds to a score


def _blocks(df: DataFrame, doc: str, text: Column, stem: bool, segment: str, range_docs: int) -> DataFrame:
    """One row per term and range, and one without a term for the range's totals."""
    kind = df.schema[doc].dataType.simpleString()
    ddl = (
        "term string, part string, `range` long, place array<int>, tf array<int>, "
        f"top_tf array<int>, top_length array<int>, docs long, words long, ids array<{kind}>, length array<int>"
    )
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def lists(ends: np.ndarray, values: pa.Array, field: pa.Field) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values).cast(field.type)

    def block(number: int, ids: list[pa.Array], lengths: list[np.ndarray], words: list[pa.Array]) -> pa.RecordBatch:
        ids, length = pa.concat_arrays(ids), np.concatenate(lengths)
        coded = pa.chunked_array(words).unify_dictionaries()
        names, code = coded.chunk(0).dictionary, np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks])
        if stem:
            stemmed = pa.array([porter(w) for w in names.to_pylist()], pa.string()).dictionary_encode()
            names, code = stemmed.dictionary, stemmed.indices.to_numpy(zero_copy_only=False)[code]
        n = len(length)
        key, tf = np.unique(code.astype(np.int64) * n + np.repeat(np.arange(n), length), return_counts=True)
        term, place = key // max(n, 1), key % max(n, 1)
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        ends = np.append(starts, len(term))
        # of a block's documents by falling count, those shorter than all before them
        order = np.lexsort((length[place], -tf, term))
        short = length[place][order] - term[order] * (int(length.max(initial=0)) + 1)  # starts anew with every term
        best = np.ones(len(short), bool)
        best[1:] = short[1:] < np.minimum.accumulate(short)[:-1]
        top = order[best]
        top_ends = np.append(np.searchsorted(term[top], term[starts]), len(top))
        m = len(starts)
        none = pa.nulls(1)
        columns = [
            names.take(pa.array(term[starts])).cast(pa.string()),
            pa.array([segment] * m, pa.string()),
            pa.array(np.full(m, number)),
            lists(ends, pa.array(place), schema.field("place")),
            lists(ends, pa.array(tf), schema.field("tf")),
            lists(top_ends, pa.array(tf[top]), schema.field("top_tf")),
            lists(top_ends, pa.array(length[place][top]), schema.field("top_length")),
            pa.array(np.diff(ends)),
            *[pa.nulls(m)] * 3,
        ]
        all_ids = lists(np.array([0, n]), ids, schema.field("ids"))
        all_lengths = lists(np.array([0, n]), pa.array(length), schema.field("length"))
        totals = [none, pa.array([segment]), pa.array([number]), *[none] * 4, pa.array([n]), pa.array([int(length.sum())])]
        totals += [all_ids, all_lengths]
        whole = [pa.concat_arrays([c.cast(f.type), t.cast(f.type)]) for c, t, f in zip(columns, totals, schema)]
        return pa.RecordBatch.from_arrays(whole, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, lengths, words, docs, size = [], [], [], 0, 0
        for batch in batches:
            whole = np.nan_to_num(batch.column(1).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            first = 0
            while first < batch.num_rows:
                room = np.searchsorted(np.cumsum(whole[first : first + range_docs - docs]), RANGE_WORDS - size) + 1
                step = int(min(room, range_docs - docs, batch.num_rows - first))
                # what waits for a range's end are copies and numbers, not the batch with its texts
                ids.append(batch.column(0).take(pa.array(np.arange(first, first + step))))
                lengths.append(whole[first : first + step])
                words.append(batch.column(1).slice(first, step).flatten().dictionary_encode())
                docs, size = docs + step, size + int(lengths[-1].sum())
                first += step
                if docs >= range_docs or size >= RANGE_WORDS:
                    yield block(number, ids, lengths, words)
                    ids, lengths, words, docs, size, number = [], [], [], 0, 0, number + 1
            del batch
        if docs:
            yield block(number, ids, lengths, words)

    rows = spread_small(df.select(doc, text.alias("_text"))).select(doc, tokens("_text").alias("_w"))
    return rows.mapInArrow(run, ddl)


def bm25_weight(tf: Any, length: Any, idf: Any, mean: float) -> Any:
    return idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean))


def _scorer(ddl: str, k: int, every: bool, weight: Weight) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores a range: from its blocks and own row, and the terms of some queries, the ``k`` best documents of each.

    A range holds ``RANGE_WORDS`` words or one long document, so what comes together is bounded.
    """
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(lists: pa.Table, wanted: pa.Table) -> pa.Table:
        lists, wanted = lists.combine_chunks(), wanted.combine_chunks()
        own = lists.filter(pc.is_null(lists["term"]))
        lists = lists.filter(pc.is_valid(lists["term"]))
        row = pc.index_in(wanted["term"], value_set=lists["term"].combine_chunks())
        wanted, row = wanted.filter(row.is_valid()), row.drop_null().to_numpy().astype(np.int64)
        out = []
        if len(row):
            ids, length = pc.list_flatten(own["ids"]), pc.list_flatten(own["length"]).to_numpy()
            place, tf = (pc.list_flatten(lists[c]).to_numpy() for c in ("place", "tf"))
            sizes = pc.list_value_length(lists["place"]).to_numpy().astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            idf = np.zeros(len(sizes))
            idf[row] = wanted["idf"].to_numpy()
            adds = weight(tf.astype(float), length[place].astype(float), np.repeat(idf, sizes))
            coded = wanted["_q"].combine_chunks().dictionary_encode(null_encoding="encode")
            code = coded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            want = wanted["n_terms"].to_numpy()
            for mine in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                at = np.concatenate([np.arange(starts[r], starts[r] + sizes[r]) for r in row[mine]])
                hits = np.bincount(place[at], minlength=len(length))
                some = np.flatnonzero(hits == want[mine[0]] if every else hits)
                if not len(some):
                    continue
                d = np.round(-np.bincount(place[at], weights=adds[at], minlength=len(length))[some], DIGITS)
                if len(some) > k:
                    near = d <= np.partition(d, k - 1)[k - 1]
                    some, d = some[near], d[near]
                best = pa.table({"q": coded.dictionary.take(pa.array(np.repeat(code[mine[0]], len(some)))), "id": ids.take(pa.array(some)), "d": d})
                first = pc.sort_indices(best, [("d", "ascending"), ("id", "ascending")], null_placement="at_start")
                out.append(best.take(first[:k]))
        columns = pa.concat_tables(out).columns if out else [pa.array([], f.type) for f in schema]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    run.ddl = ddl
    return run


@dataclass(frozen=True)
class TextIndex:
    """An index of documents below ``path``, a folder all executors share.

    Documents are rows: rows that share an id are documents of their own. With
    ``stem`` English word stems are compared. ``buckets`` is fixed by the first segment.
    """

    path: str
    doc: str
    stem: bool = False
    buckets: int = 64
    range_docs: int = RANGE_DOCS

    def _pointer(self, spark: SparkSession) -> Pointer:
        return Pointer(spark, self.path)

    def add(self, df: DataFrame, columns: list[str]) -> None:
        """Add documents; the text of ``columns`` is searchable once this returns."""
        segment = uuid.uuid4().hex
        blocks = _blocks(df, self.doc, joined_text(columns), self.stem, segment, self.range_docs)
        bucket = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(self.buckets)))
        self._write(blocks.withColumn("bucket", bucket.cast("int")), segment)
        if not self._pointer(df.sparkSession).exists(segment, "bucket=-1"):  # there was no document
            return
        sums = self._read(df.sparkSession, [segment]).where("bucket = -1").agg(F.sum("docs"), F.sum("words")).first()

        def more(state: dict) -> dict:
            state["folders"] = [*state.get("folders", ()), segment]
            state["docs"] = state.get("docs", 0) + (sums[0] or 0)
            state["words"] = state.get("words", 0) + (sums[1] or 0)
            return state

        self._pointer(df.sparkSession).change(more)

    def _write(self, blocks: DataFrame, segment: str) -> None:
        # adaptive execution cuts big buckets and joins small ones; blocks are made once, not also for a sample
        sorted_ = blocks.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "part", "range")
        sorted_.write.partitionBy("bucket").parquet(f"{self.path}/{segment}")

    def _read(self, spark: SparkSession, segments: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [spark.read.parquet(f"{self.path}/{s}") for s in segments])

    def compact(self, spark: SparkSession) -> None:
        """Merge all segments into one; documents added meanwhile stay in segments of their own."""
        _, state = self._pointer(spark).read()
        old = state.get("folders", [])
        if len(old) < 2:
            return
        merged = uuid.uuid4().hex
        self._write(self._read(spark, old), merged)

        def swap(state: dict) -> dict | None:
            if not set(old) <= set(state["folders"]):  # somebody else has merged them
                return None
            state["folders"] = [merged, *[f for f in state["folders"] if f not in old]]
            return state

        self._pointer(spark).change(swap)

    def bm25(
        self, queries: DataFrame, qid: str, query_text: str, k: int = 5, match: str = "all", seen: dict | None = None
    ) -> DataFrame:
        """The ``k`` best documents per query, as ``text.bm25`` gives them: (query, document, rank, distance).

        ``seen`` is filled with how many (query, range) pairs match and were scored.
        """
        if match not in ("all", "any"):
            raise ValueError(f"unknown match {match!r}")
        _, state = self._pointer(queries.sparkSession).read()
        mean = state.get("words", 0) / max(state.get("docs", 0), 1) or 1.0

        def weight(tf: Any, length: Any, idf: Any) -> Any:
            return bm25_weight(tf, length, idf, mean)

        found = self._search(queries, qid, query_text, k, match == "all", weight, state, seen)
        return top_rows(found, [qid], [F.asc("distance"), F.asc(self.doc)], k, "rank")

    def match_all(self, queries: DataFrame, qid: str, query_text: str, k: int = 5, seen: dict | None = None) -> DataFrame:
        """The ``k`` documents per query that hold all its terms, by their share of matching words."""
        _, state = self._pointer(queries.sparkSession).read()
        found = self._search(queries, qid, query_text, k, True, lambda tf, length, idf: tf / length, state, seen)
        ranked = found.select(qid, self.doc, (-F.col("distance")).alias("text_rank"))
        return top_rows(ranked, [qid], [F.desc("text_rank"), F.asc(self.doc)], k, "rank")

    def _search(
        self, queries: DataFrame, qid: str, query_text: str, k: int, every: bool, weight: Weight, state: dict, seen: dict | None
    ) -> DataFrame:
        """At least the ``k`` best documents per query: (query, document, distance)."""
        spark = queries.sparkSession
        asked = query_terms(queries, qid, query_text, self.stem)
        if not state.get("folders"):
            kind = queries.schema[qid].dataType.simpleString()
            return spark.createDataFrame([], f"`{qid}` {kind}, `{self.doc}` long, distance double")
        asked = reliable(asked.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")))
        some = asked.select("term", "bucket").distinct().limit(FEW_TERMS + 1).collect()
        few = len(some) <= FEW_TERMS
        wanted = {r["bucket"] for r in (some if few else asked.select("bucket").distinct().collect())}  # at most all buckets
        stored = self._read(spark, state["folders"])
        blocks = stored.where(F.col("bucket").isin(sorted(wanted)))
        if few:
            blocks = blocks.where(F.col("term").isin([r["term"] for r in some]))
        docs = float(state["docs"])
        size = asked.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct(qid).alias("queries")).first()

        def sent(df: DataFrame) -> DataFrame:
            return F.broadcast(df) if size["pairs"] <= BROADCAST_PAIRS else df

        terms = sent(asked.select("term").distinct())
        have = blocks.select("term", F.col("docs").alias("_n")).join(terms, "term", "left_semi").groupBy("term").agg(F.sum("_n").alias("df"))
        idf = F.greatest(F.log((docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(BM25_MIN_IDF))
        asked = reliable(asked.join(have.select("term", idf.alias("idf")), "term"))

        best = F.array_max(F.zip_with("top_tf", "top_length", lambda tf, length: weight(tf, length, F.col("idf"))))
        ranges = (
            blocks.select("term", "bucket", "part", "range", "top_tf", "top_length")
            .join(sent(asked), ["term", "bucket"])
            .groupBy(qid, "part", "range")
            .agg(F.sum(best).alias("bound"), F.count(F.lit(1)).alias("_hit"), F.first("n_terms").alias("_want"))
        )
        if every:
            ranges = ranges.where("_hit = _want")
        ranges = reliable(top_rows(ranges, [qid], [F.desc("bound"), F.asc("part"), F.asc("range")], 1 << 30, "_turn"))

        kinds = queries.schema[qid].dataType.simpleString(), stored.schema["ids"].dataType.elementType.simpleString()
        group = _scorer(f"`{qid}` {kinds[0]}, `{self.doc}` {kinds[1]}, distance double", k, every, weight)
        slices = -(-max(size["queries"], 1) // GROUP_QUERIES)
        def scored(part: DataFrame) -> DataFrame:
            part = part.select(qid, "part", "range")
            lists = blocks.join(terms, "term", "left_semi").unionByName(stored.where("bucket = -1"))
            lists = lists.select("part", "range", "term", "place", "tf", "ids", "length")
            lists = lists.join(part.select("part", "range").distinct(), ["part", "range"], "left_semi")
            lists = lists.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
            wanted = part.join(sent(asked.select(qid, "term", "idf", "n_terms")), qid)
            here = [F.col("part"), F.col("range"), F.pmod(F.xxhash64(qid), F.lit(slices)).cast("int")]
            wanted = wanted.select(*[c.alias(f"_at{n}") for n, c in enumerate(here)], F.col(qid).alias("_q"), "term", "idf", "n_terms")
            pairs = lists.groupBy("part", "range", "slice").cogroup(wanted.groupBy("_at0", "_at1", "_at2"))
            found = pairs.applyInArrow(group, group.ddl)
            return top_rows(found, [qid], [F.asc("distance"), F.asc(self.doc)], k, "_rank")

        if (ranges.agg(F.max("_turn")).first()[0] or 0) <= FIRST_RANGES:  # nothing to pass over
            if seen is not None:
                seen |= dict.fromkeys(("ranges", "scored"), ranges.count())
            return scored(ranges).drop("_rank")
        first = reliable(scored(ranges.where(F.col("_turn") <= FIRST_RANGES)))
        worst = first.where(F.col("_rank") == k).select(qid, (-F.col("distance")).alias("_worst"))
        rest = ranges.where(F.col("_turn") > FIRST_RANGES).join(worst, qid, "left")
        rest = reliable(rest.where(F.col("_worst").isNull() | (F.col("bound") + SLACK >= F.col("_worst"))))
        if seen is not None:
            early = ranges.where(F.col("_turn") <= FIRST_RANGES).count()
            seen |= {"ranges": ranges.count(), "scored": early + rest.count()}
        both = first if rest.isEmpty() else first.unionByName(scored(rest))
        return both.drop("_rank")
