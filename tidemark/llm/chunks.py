"""Documents as chunks of numbered words, and questions chunks put to the whole corpus.

Counting what nearly every position of a corpus brings (every window, every word
pair) would shuffle a row per position. Here a task first reduces a chunk of
documents to its distinct keys, so a key that fills the corpus is one entry per
chunk. The keys of a chunk are sorted and sent as one packed row to each range of
keys (a bucket); a bucket merges what all chunks sent and answers every chunk
entry by entry, in the order asked. Chunks are written once, bucketed by their
number, so only questions and answers move afterwards.

Both sides are bounded: a chunk by its number of words (a longer document ends its
chunk), a bucket by the number of buckets. Both grow with the square root of the
corpus, up to a bound: at 100 TB, with chunks and buckets of 20 million words, a
row still carries dozens of keys.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import estimated_bytes, scratch_root, shuffle_partitions

from .common import rows_to_arrow

CHUNK_WORDS = 500_000  # at least, and
BUCKET_WORDS = 2_000_000  # words of the corpus per bucket of keys, at least
MOST_WORDS = 30_000_000  # of either; a task holds about 100 bytes for each
CELL_KEYS = 32  # chunks and buckets grow so that a chunk has about this many keys for a bucket
CHUNK_DOCS = 100_000
NO_ID = -(1 << 63)  # stands for a null id

CHUNKS = "chunk long, n_words long, ids binary, sizes binary, vocabulary binary, words binary"
ASKED = "chunk long, bucket int, keys binary, values array<binary>"
ANSWERED = "kind string, chunk long, bucket int, keys binary, values array<binary>, sums array<long>"


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def pack(values: np.ndarray) -> bytes:
    """An array as compressed planes of bytes."""
    import zstandard

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    import zstandard

    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, len(raw) // dtype.itemsize).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def mix(keys: np.ndarray) -> np.ndarray:
    """Spread keys over all 64 bits."""
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


class Chunk:
    """Documents of a chunk: ids, words per document, the distinct words, and all words by number."""

    def __init__(self, row: dict):
        import zstandard

        self.number = row["chunk"]
        self.ids, self.sizes = unpack(row["ids"], np.int64), unpack(row["sizes"], np.int64)
        raw = zstandard.ZstdDecompressor().decompress(row["vocabulary"])
        self.vocabulary = raw.split(b" ") if raw else []
        self.words = unpack(row["words"], np.uint32)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def hashes(self, *more: bytes) -> np.ndarray:
        """64-bit hashes of the distinct words, and of ``more`` behind them."""
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        return np.array([digest(w) for w in [*self.vocabulary, *more]], np.uint64)


def chunked(docs: DataFrame, id_col: str, text_col: str, lower: bool) -> DataFrame:
    """``docs`` as a table of chunks, bucketed by chunk; words are split at ASCII white space.

    With ``lower``, A to Z become lower-case. A null text has no words.
    """
    schema = _arrow(CHUNKS)
    size = estimated_bytes(docs.select(text_col))
    most = sized(CHUNK_WORDS, size / 4 if size < 1e16 else 0)  # of a size nobody knows, the least

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        number = count(first)

        def new():
            return defaultdict(count().__next__), [], [], [], 0

        def row(index, ids, sizes, words, n):
            words = np.concatenate(words) if words else np.empty(0, np.uint32)
            order = np.argsort(-np.bincount(words, minlength=len(index)), kind="stable")  # common words get small numbers
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            names = list(index)
            vocabulary = zstandard.ZstdCompressor(level=3).compress(b" ".join(names[k] for k in order.tolist()))
            ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
            packed = (pack(ids), pack(np.array(sizes, np.int64)), vocabulary, pack(rank[words]))
            return rows_to_arrow([(next(number), n, *packed)], schema)

        index, ids, sizes, words, n = new()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                found = (data.lower() if lower else data).split()
                ids.append(i)
                sizes.append(len(found))
                words.append(np.fromiter(map(index.__getitem__, found), np.uint32, len(found)))
                n += len(found)
                if n >= most or len(ids) >= CHUNK_DOCS:
                    yield row(index, ids, sizes, words, n)
                    index, ids, sizes, words, n = new()
        if ids:
            yield row(index, ids, sizes, words, n)

    spark = docs.sparkSession
    made = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, CHUNKS)
    name = f"chunks_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark).rstrip('/')}/tidemark/{name}"
    writer = made.write.option("path", path).option("compression", "none")
    writer.bucketBy(shuffle_partitions(spark), "chunk").saveAsTable(name)
    return spark.table(name)


def sized(least: int, corpus_words: float) -> int:
    """Words of a chunk or bucket: with the root of the corpus, so that cells do not become empty."""
    return int(min(max(least, math.sqrt(CELL_KEYS * corpus_words)), MOST_WORDS))


def buckets_for(chunks: DataFrame) -> int:
    """How many buckets (a power of two) the keys of this corpus need."""
    words = chunks.agg(F.sum("n_words")).first()[0] or 0
    return 1 << (words // sized(BUCKET_WORDS, words)).bit_length()


def requests(number: int, keys: np.ndarray, values: list[np.ndarray], buckets: int) -> list[tuple]:
    """Rows for sorted ``keys`` with ``values``, one per bucket that has any."""
    bits = buckets.bit_length() - 1
    edges = np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    return [
        (number, b, pack_sorted(keys[s:e]), [pack(v[s:e]) for v in values])
        for b, (s, e) in enumerate(zip(cuts, cuts[1:]))
        if s < e
    ]


def ask(chunks: DataFrame, make: Callable[[Chunk], list[tuple]]) -> DataFrame:
    """Requests that depend on the chunk alone."""
    schema = _arrow(ASKED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for row in make(Chunk(batch.slice(k, 1).to_pylist()[0])):
                    yield rows_to_arrow([row], schema)

    return chunks.mapInArrow(run, ASKED)


def answer(asked: DataFrame, dtypes: list, merge: Callable) -> DataFrame:
    """Merge the requests of every bucket and answer them.

    ``merge(keys, slot, values)`` gets the distinct keys, the place among them of
    every requested entry, and the values of all entries. It returns an answer per
    entry, and either None or (the choice of keys to put on record, arrays recorded
    with them, sums).
    """
    schema = _arrow(ANSWERED)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        keys = [unpack_sorted(r["keys"]) for r in rows]
        values = [np.concatenate([unpack(r["values"][j], d) for r in rows]) for j, d in enumerate(dtypes)]
        ends = np.cumsum([len(k) for k in keys])
        distinct, slot = np.unique(np.concatenate(keys), return_inverse=True)
        answers, record = merge(distinct, slot, values)
        bucket = rows[0]["bucket"]
        out = [
            ("answer", r["chunk"], bucket, None, [pack(answers[e - len(k) : e])], None)
            for r, k, e in zip(rows, keys, ends)
        ]
        if record is not None:
            chosen, arrays, sums = record
            out.append(("record", None, bucket, pack_sorted(distinct[chosen]), [pack(a[chosen]) for a in arrays], sums))
        return pa.Table.from_batches([rows_to_arrow(out, schema)])

    return asked.groupBy("bucket").applyInArrow(run, ANSWERED)


def answers_of(rows: list[dict], topic: str, dtype) -> np.ndarray:
    """A chunk's answers on a topic, in the order of its sorted keys."""
    own = sorted((r for r in rows if r["topic"] == topic), key=lambda r: r["bucket"])
    return np.concatenate([unpack(r["values"][0], dtype) for r in own]) if own else np.empty(0, dtype)


def with_answers(chunks: DataFrame, topics: dict[str, DataFrame], make: Callable[[Chunk, list[dict]], list[tuple]], ddl: str) -> DataFrame:
    """Rows of ``make(chunk, answers)``; ``topics`` are answered questions by name."""
    schema = _arrow(ddl)
    all_answers = None
    for topic, answered in topics.items():
        part = answered.where("kind = 'answer'").select("chunk", F.lit(topic).alias("topic"), "bucket", "values")
        all_answers = part if all_answers is None else all_answers.unionByName(part)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        out = [row for chunk in left.to_pylist() for row in make(Chunk(chunk), rows)]
        return pa.Table.from_batches([rows_to_arrow(out, schema)])

    return chunks.groupBy("chunk").cogroup(all_answers.groupBy("chunk")).applyInArrow(run, ddl)
