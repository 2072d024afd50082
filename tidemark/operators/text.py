"""Keyword filters and ranked text search."""

from __future__ import annotations

import unicodedata
from collections import Counter
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.columns import as_col
from ..functions.stem import porter
from ..session import reliable, spread_small, written
from .latest import top_rows
from .topk import DIGITS, Best

# The usual BM25 parameters and the floor for very common terms.
BM25_K1 = 1.2
BM25_B = 0.75
BM25_MIN_IDF = 1e-6

# A terms x queries matrix up to this many bytes goes to every executor.
MATRIX_BYTES = 16 * 1024 * 1024
BROADCAST_PAIRS = 500_000  # (query, term) pairs that go to every executor one by one


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the same letters without."""
    marked = [chr(c) for c in range(0xC0, 0x250) if chr(c).islower() and len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(marked), "".join(unicodedata.normalize("NFD", c)[0] for c in marked)


MARKED, PLAIN = _accents()


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits, Latin letters without their accents."""
    folded = F.translate(F.lower(as_col(text)), MARKED, PLAIN)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def joined_text(columns: list[str]) -> Column:
    """Several string columns as one searchable text."""
    return F.concat_ws(" ", *columns)


def contains_any(columns: list[str], needle: str) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).contains(needle), F.lit(False))
    return found


def keyword_search(df: DataFrame, columns: list[str], needle: str, order: list[str], k: int | None = None) -> DataFrame:
    """Rows with ``needle`` as a substring of any of the columns."""
    hits = df.filter(contains_any(columns, needle))
    return hits if k is None else hits.orderBy(*order).limit(k)


def stems(words: Column) -> Column:
    """The English stems of an array of words."""

    @F.pandas_udf("array<string>")
    def run(found: pd.Series) -> pd.Series:
        return found.map(lambda ws: None if ws is None else [porter(w) for w in ws])

    return run(words)


def query_terms(queries: DataFrame, qid: str, text: str, stem: bool = False) -> DataFrame:
    """Distinct (query, term) with the query's number of distinct terms."""
    words = stems(tokens(text)) if stem else tokens(text)
    terms = queries.select(qid, F.array_distinct(words).alias("_terms"))
    return terms.select(qid, F.size("_terms").alias("n_terms"), F.explode("_terms").alias("term"))


def postings(df: DataFrame, doc: str, text: Column, vocabulary: DataFrame, stem: bool = False) -> DataFrame:
    """(document, row, length, term, tf) for the terms in ``vocabulary`` only.

    Words are counted within their row, so nothing is shuffled for it; ``row`` tells
    rows of equal document id apart.
    """
    words = df.select(F.col(doc), tokens(text).alias("_w"))
    ddl = f"`{doc}` {df.schema[doc].dataType.simpleString()}, row long, length int, term string, tf long"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for found in batch.column(1).to_pylist():
                counts = Counter(map(porter, found or ()) if stem else found or ())
                out.append((row, len(found or ()), list(counts), list(counts.values())))
                row += 1
            sizes = [len(o[2]) for o in out]
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(len(out)), sizes))),
                pa.array(np.repeat([o[0] for o in out], sizes)),
                pa.array(np.repeat([o[1] for o in out], sizes).astype("int32")),
                pa.array([t for o in out for t in o[2]], pa.string()),
                pa.array([n for o in out for n in o[3]], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return words.mapInArrow(run, ddl).join(vocabulary, "term", "left_semi")


def _query_matrix(asked: DataFrame, qid: str, limit: int):
    """Queries as a term table and a terms x queries 0/1 matrix, or None above ``limit`` bytes."""
    size = asked.agg(F.count_distinct("term").alias("terms"), F.count_distinct(qid).alias("queries")).first()
    if size["terms"] * size["queries"] * 8 > limit:
        return None
    pairs = asked.select(qid, "term").collect()
    terms = {term: i for i, term in enumerate(sorted({r["term"] for r in pairs}))}
    qids = sorted({r[qid] for r in pairs})
    at = {q: j for j, q in enumerate(qids)}
    matrix = np.zeros((len(terms), len(qids)))
    for r in pairs:
        matrix[terms[r["term"]], at[r[qid]]] = 1.0
    return terms, qids, matrix


def _bags(
    df: DataFrame, doc: str, text: Column, terms: dict[str, int], stem: bool = False, also: tuple[str, ...] = ()
) -> DataFrame:
    """Per row its length and the numbers of its words that some query asks for, and the columns ``also``.

    The words are looked up batch by batch where the rows lie; nothing is shuffled
    and every row stays a document of its own.
    """
    rows = spread_small(df.select(doc, text.alias("_text"), *also)).select(doc, tokens("_text").alias("_w"), *also)
    # bounded by the check of the query matrix
    sent = df.sparkSession.sparkContext.broadcast(list(terms))
    ddl = f"`{doc}` {df.schema[doc].dataType.simpleString()}, length int, words array<int>"
    ddl = ", ".join([ddl, *[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in also]])
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(sent.value, pa.string())
        for batch in batches:
            words = batch.column(1)
            length = np.nan_to_num(words.value_lengths().to_numpy(zero_copy_only=False)).astype("int32")
            distinct = words.flatten().dictionary_encode()
            names = distinct.dictionary
            if stem:
                names = pa.array([porter(w) for w in names.to_pylist()], pa.string())
            flat = pc.index_in(names, value_set=wanted).take(distinct.indices)
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            per_row = np.bincount(np.repeat(np.arange(len(length)), length)[known], minlength=len(length))
            ends = pa.array(np.concatenate(([0], np.cumsum(per_row))).astype("int32"))
            found = pa.ListArray.from_arrays(ends, flat.drop_null().cast(pa.int32()))
            columns = (batch.column(0), pa.array(length), found, *batch.columns[2:])
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(run, ddl)


def _score_bags(
    bags: DataFrame, doc: str, qid: str, id_types: tuple[str, str], qids: list, matrix: np.ndarray, k: int | None,
    every_term: bool, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray],
) -> DataFrame:
    """Documents' word weights times the query matrix, best ``k`` per query and task.

    ``weigh(tf, length)`` turns word counts into weights; smaller is better.
    """
    sent = bags.sparkSession.sparkContext.broadcast((qids, matrix))
    ddl = f"`{qid}` {id_types[0]}, `{doc}` {id_types[1]}, distance double"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix = sent.value
        width = len(matrix)
        wanted = matrix.sum(axis=0)
        best = Best(qids, k)
        for big in batches:
            step = max(1, 4_000_000 // max(matrix.shape))
            for first in range(0, big.num_rows, step):
                batch = big.slice(first, step)
                n = batch.num_rows
                words = batch.column(2)
                row = np.repeat(np.arange(n), words.value_lengths().to_numpy(zero_copy_only=False))
                flat = row * width + words.flatten().to_numpy(zero_copy_only=False)
                tf = np.bincount(flat.astype("int64"), minlength=n * width).reshape(n, width).astype("float64")
                ids = np.array(batch.column(0).to_pylist())
                length = batch.column(1).to_numpy(zero_copy_only=False).astype("float64")
                hits = (tf > 0).astype("float32") @ matrix.astype("float32")
                ok = hits == wanted if every_term else hits > 0
                some = ok.any(axis=1)
                if not some.any():
                    continue
                d = np.round(weigh(tf[some], length[some]) @ matrix, DIGITS)
                ids, ok = ids[some], ok[some]
                for j in np.flatnonzero(ok.any(axis=0)):
                    best.offer(j, ids[ok[:, j]], d[ok[:, j], j])
            if k is None:  # nothing to compare with later rows
                yield pa.RecordBatch.from_arrays(best.columns(schema), schema=schema)
                best = Best(qids, k)
        yield pa.RecordBatch.from_arrays(best.columns(schema), schema=schema)

    return bags.mapInArrow(run, ddl)


def _types(queries: DataFrame, qid: str, df: DataFrame, doc: str) -> tuple[str, str]:
    return queries.schema[qid].dataType.simpleString(), df.schema[doc].dataType.simpleString()


def bm25(
    df: DataFrame,
    doc: str,
    columns: list[str],
    queries: DataFrame,
    qid: str,
    query_text: str,
    k: int = 5,
    match: str = "all",
    matrix_bytes: int = MATRIX_BYTES,
    stem: bool = False,
) -> DataFrame:
    """The ``k`` best documents per query: (query, document, rank, distance).

    ``distance`` is the negated BM25 score over all columns with equal weight, so
    the smallest is best. ``match="all"`` wants every query term in the document,
    ``"any"`` at least one. ``stem`` compares English word stems.

    Queries whose term matrix fits ``matrix_bytes`` are scored inside the document
    tasks, which emit k rows per query each; more of them by a join on terms.
    Runs jobs for the query terms and the document frequencies.
    """
    if match not in ("all", "any"):
        raise ValueError(f"unknown match {match!r}")
    asked = query_terms(queries, qid, query_text, stem)
    known = _query_matrix(asked, qid, matrix_bytes)
    if known is None:
        ranked = _bm25_join(df, doc, joined_text(columns), asked, qid, match, stem)
    else:
        terms, qids, matrix = known
        bags = reliable(_bags(df, doc, joined_text(columns), terms, stem))
        corpus = bags.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("length")).first()
        have = bags.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").count().collect()
        df_ = np.zeros(len(terms))
        for r in have:
            df_[r["term"]] = r["count"]
        docs, mean = corpus["docs"], corpus["length"] or 1.0
        idf = np.maximum(np.log((docs - df_ + 0.5) / (df_ + 0.5)), BM25_MIN_IDF)

        def weigh(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
            slack = BM25_K1 * (1 - BM25_B + BM25_B * length / mean)
            return -idf * tf * (BM25_K1 + 1) / (tf + slack[:, None])

        ranked = _score_bags(bags, doc, qid, _types(queries, qid, df, doc), qids, matrix, k, match == "all", weigh)
    return top_rows(ranked, [qid], [F.asc("distance"), F.asc(doc)], k, "rank")


def _bm25_join(df: DataFrame, doc: str, text: Column, asked: DataFrame, qid: str, match: str, stem: bool) -> DataFrame:
    """The same by joining postings with the queries' terms.

    Up to ``BROADCAST_PAIRS`` (query, term) pairs, far more than fit a matrix, go to the
    postings, of which only those of asked terms are kept and dealt out by row: a
    row's scores are summed, and all but k per query and task dropped, where it lies.
    """
    asked = reliable(asked)
    few = asked.count() <= BROADCAST_PAIRS
    vocabulary = asked.select("term").distinct()
    found = written(postings(df, doc, text, F.broadcast(vocabulary) if few else vocabulary, stem), "postings")
    corpus = df.select(F.size(tokens(text)).alias("n")).agg(
        F.struct(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("length"))
    ).scalar()
    have = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((corpus["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(BM25_MIN_IDF))
    weighted = asked.join(have.select("term", idf.alias("idf")), "term")
    tf = F.col("tf")
    part = F.col("idf") * tf * (BM25_K1 + 1) / (
        tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / corpus["length"])
    )
    scored = (
        (found.repartition("row").join(F.broadcast(weighted), "term") if few else found.join(weighted, "term"))
        .groupBy(qid, doc, "row")
        .agg(F.sum(part).alias("_score"), F.count(F.lit(1)).alias("_hit"), F.first("n_terms").alias("_want"))
    )
    if match == "all":
        scored = scored.filter("_hit = _want")
    return scored.select(qid, doc, F.round(-F.col("_score"), DIGITS).alias("distance"))


def match_all(
    df: DataFrame, doc: str, columns: list[str], queries: DataFrame, qid: str, query_text: str, k: int | None = None,
    matrix_bytes: int = MATRIX_BYTES, stem: bool = False,
) -> DataFrame:
    """Documents holding every term of a query, ranked by the share of matching words."""
    asked = query_terms(queries, qid, query_text, stem)
    known = _query_matrix(asked, qid, matrix_bytes)
    if known is None:
        found = postings(df, doc, joined_text(columns), asked.select("term").distinct(), stem)
        hits = (
            found.join(asked, "term")
            .groupBy(qid, doc, "row")
            .agg(
                (F.sum("tf") / F.first("length")).alias("_share"),
                F.count(F.lit(1)).alias("_hit"),
                F.first("n_terms").alias("_want"),
            )
            .filter("_hit = _want")
            .select(qid, doc, F.round("_share", DIGITS).alias("text_rank"))
        )
    else:
        terms, qids, matrix = known
        found = _score_bags(
            _bags(df, doc, joined_text(columns), terms, stem), doc, qid, _types(queries, qid, df, doc), qids, matrix, k, True,
            lambda tf, length: -tf / length[:, None],
        )
        hits = found.select(qid, doc, (-F.col("distance")).alias("text_rank"))
    if k is None:
        return hits
    return top_rows(hits, [qid], [F.desc("text_rank"), F.asc(doc)], k, "rank")
