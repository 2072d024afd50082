"""Documents: overlapping chunks, embeddings, context assembly."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import spread_small
from .skew import running_totals
from .text import tokens

# Where a chunk may end, most wanted first.
BREAKS = (". ", "\n\n", "\n", " ")

# Of chunks that leave a task at a time.
BATCH_CHARS = 2_000_000
BATCH_CHUNKS = 10_000


def chunk_spans(text: str, size: int, overlap: int, tail: bool = False) -> list[tuple[int, int]]:
    """Character ranges of a text's chunks.

    The places of every break are found once. A chunk that does not reach the end
    of the text is cut behind the last occurrence of the first break that lies
    past the chunk's middle, looked up by bisection. The next
    chunk starts ``overlap`` characters before the cut, but at least one character
    further on. The chunk that reaches the end is the last one, unless ``tail``
    asks for the ever shorter rests that the stepping rule alone produces.
    """
    breaks = [(len(mark), [m.start() for m in re.finditer(f"(?={re.escape(mark)})", text)]) for mark in BREAKS]

    def cut(start: int, limit: int) -> int:
        """Where a chunk from ``start`` that may go up to ``limit`` ends."""
        for width, places in breaks:
            before = bisect_right(places, limit - width)
            if before and places[before - 1] > start + size // 2:
                return places[before - 1] + width
        return limit

    def spans(start: int) -> Iterator[tuple[int, int]]:
        while start < len(text):
            reaches_end = start + size >= len(text)
            end = len(text) if reaches_end else cut(start, start + size)
            yield start, end
            start = max(end - overlap, start + 1) if tail or not reaches_end else len(text)

    return list(spans(0))


def _pieces(
    batches: Iterator[pa.RecordBatch], spans: Callable[[str], list[tuple[int, int]]], schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """Chunks of the texts in the last column, behind the other columns' values.

    What leaves at a time is bounded, however many texts a batch holds and however long they are.
    """

    def whole(batch: pa.RecordBatch, rows: list[int], found: list[tuple[int, str, int, int]]) -> pa.RecordBatch:
        kept = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
        made = [pa.array(c, f.type) for c, f in zip(zip(*found), list(schema)[len(kept) :])]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*kept, *made], schema)], schema=schema)

    for batch in batches:
        rows, found, chars = [], [], 0
        for i, value in enumerate(batch.columns[-1]):
            t = value.as_py()
            for pos, (a, b) in enumerate(spans(t) if t is not None else ()):
                rows.append(i)
                found.append((pos, t[a:b].strip(), a, b))
                chars += b - a
                if chars >= BATCH_CHARS or len(found) >= BATCH_CHUNKS:
                    yield whole(batch, rows, found)
                    rows, found, chars = [], [], 0
        if found:
            yield whole(batch, rows, found)


def chunk(
    df: DataFrame, text: str, size: int = 1000, overlap: int = 200, tail: bool = False, keep: list[str] | None = None
) -> DataFrame:
    """One row per chunk: ``keep`` columns, ``pos`` in the document, text and offsets.

    A document is one row, so documents spread over tasks as the scan splits them;
    no shuffle.
    """
    if size <= 0 or overlap < 0:
        raise ValueError("size must be positive and overlap not negative")

    keep = keep if keep is not None else [c for c in df.columns if c != text]
    names = [f"_k{i}" for i in range(len(keep))]
    kept = [f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, keep)]
    ddl = ", ".join([*kept, "pos int, text string, start_char int, end_char int"])
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pieces(batches, lambda t: chunk_spans(t, size, overlap, tail), schema)

    rows = spread_small(df.select(*dict.fromkeys([*keep, text])))
    rows = rows.select(*[F.col(c).alias(n) for n, c in zip(names, keep)], F.col(text).alias("_text"))
    out = rows.mapInArrow(split, ddl)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "pos", "text", "start_char", "end_char")


def number_chunks(chunks: DataFrame, doc: str, pos: str = "pos", name: str = "chunk_id") -> DataFrame:
    """Dense chunk numbers over all documents in ``doc`` order, from 0.

    Per-document counts get running totals; a chunk adds its position. Give chunks
    read from a table, as they are used twice.
    """
    counts = chunks.groupBy(doc).agg(F.count(F.lit(1)).alias("_n"))
    ends = running_totals(counts, [F.col(doc)], {"_end": F.col("_n")})
    starts = ends.select(doc, (F.col("_end") - F.col("_n")).alias("_start"))
    return chunks.join(starts, doc).withColumn(name, F.col("_start") + F.col(pos)).drop("_start")


Model = Callable[[], Callable[[list[str]], list[list[float]]]]


def embed(df: DataFrame, text: str, model: Model | None = None, name: str = "embedding", dim: int = 256) -> DataFrame:
    """Add an embedding column.

    ``model()`` is called once per task and returns a function from a list of
    texts to vectors. Without a model: hashed word counts of unit length, computed
    inside the JVM.
    """
    if model is None:
        words = spread_small(df).withColumn("_words", F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")))
        counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(words)
        unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counted)
        return unit.withColumn(name, vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in encode(texts.fillna("").tolist())])

    return df.withColumn(name, run(F.col(text)))


def build_context(
    hits: DataFrame, query: list[str], text: str, rank: str, n: int, separator: str = "\n\n"
) -> DataFrame:
    """Per query, the texts of its first ``n`` hits joined in rank order."""
    top = hits.filter(F.col(rank) <= n)
    gathered = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t"))))
    return top.groupBy(*query).agg(gathered.alias("_h")).select(
        *query,
        F.array_join(F.transform("_h", lambda h: h["t"]), separator).alias("context"),
        F.size("_h").alias("passages"),
    )
