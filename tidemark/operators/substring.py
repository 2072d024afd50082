"""A substring index: trigram signatures per file, so a keyword scan opens only files that may hold it.

A file's signature is a bitmap of hashes of all three-byte pieces of its texts. A file
whose bitmap lacks a piece of the keyword can't hold the keyword; every other file is
scanned, so the answers are those of a scan of everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import contains_any

BITS = 1 << 18  # of a signature; 32 KB a file
_SPREAD = np.uint32(2654435761)  # Knuth's multiplier


def pieces(text: bytes) -> np.ndarray:
    """Places in a signature of the three-byte pieces of a text."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    return ((code * _SPREAD) >> np.uint32(32 - BITS.bit_length() + 1)).astype(np.int64)


@dataclass(frozen=True)
class SubstringIndex:
    """Rows below ``path``/rows with signatures of ``columns`` below ``path``/signatures."""

    path: str
    columns: tuple[str, ...]

    def build(self, df: DataFrame, files: int, *order: str) -> None:
        """Write the rows in about ``files`` files, by ``order``, and each file's signature.

        Files of rows that are alike (the same site, the same time) have sparse signatures.
        """
        df.repartitionByRange(files, *order).write.parquet(f"{self.path}/rows")
        self._sign(df.sparkSession.read.parquet(f"{self.path}/rows")).write.parquet(f"{self.path}/signatures")

    def add(self, df: DataFrame) -> None:
        """Append rows as further files and sign those."""
        spark, place = df.sparkSession, f"{self.path}/rows"
        before = {r[0] for r in spark.read.parquet(f"{self.path}/signatures").select("file").collect()}  # a name per file
        df.write.mode("append").parquet(place)
        new = [f for f in spark.read.parquet(place).inputFiles() if f not in before]
        if new:
            self._sign(spark.read.parquet(*new)).write.mode("append").parquet(f"{self.path}/signatures")

    def _sign(self, rows: DataFrame) -> DataFrame:
        """(file, signature); a task adds its part of a file, parts are joined by or."""
        text = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(f"c{i}") for i, c in enumerate(self.columns)]
        named = rows.select(F.col("_metadata.file_path").alias("file"), *text)
        schema = pa.schema([("file", pa.string()), ("signature", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[str, np.ndarray] = {}
            for batch in batches:
                names = batch.column(0).dictionary_encode()
                at = names.indices.to_numpy(zero_copy_only=False)
                for k, name in enumerate(names.dictionary.to_pylist()):
                    bits = seen.setdefault(name, np.zeros(BITS, bool))
                    for column in batch.columns[1:]:
                        for text in column.filter(pa.array(at == k)).cast(pa.binary()).to_pylist():
                            bits[pieces(text)] = True
            for name, bits in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([np.packbits(bits).tobytes()])], schema=schema)

        def join(table: pa.Table) -> pa.Table:
            parts = [np.frombuffer(s, np.uint8) for s in table.column("signature").to_pylist()]
            whole = np.bitwise_or.reduce(parts).tobytes()
            return pa.table([[table.column("file")[0].as_py()], [whole]], schema=schema)

        parts = named.mapInArrow(run, "file string, signature binary")
        return parts.groupBy("file").applyInArrow(join, "file string, signature binary")

    def files(self, spark: SparkSession, needle: str) -> tuple[list[str], int]:
        """Files that may hold ``needle``, and how many files there are."""
        at = np.unique(pieces(needle.encode()))
        signed = spark.read.parquet(f"{self.path}/signatures")
        # one byte of the bitmap per piece of the needle, looked at where the signatures lie
        byte = [F.conv(F.hex(F.substring("signature", int(p) // 8 + 1, 1)), 16, 10).cast("int") for p in at]
        may = F.lit(True)
        for p, b in zip(at.tolist(), byte):
            may = may & (b.bitwiseAND(F.lit(1 << (7 - p % 8))) > 0)
        return [r[0] for r in signed.where(may).select("file").collect()], signed.count()

    def search(self, spark: SparkSession, needle: str, seen: dict | None = None) -> DataFrame:
        """Rows with ``needle`` as a substring of any of the columns; ``seen`` is filled with the files scanned and there."""
        files, there = self.files(spark, needle)
        if seen is not None:
            seen |= {"scanned": len(files), "files": there}
        rows = spark.read.parquet(f"{self.path}/rows")
        hits = rows.sparkSession.read.schema(rows.schema).parquet(*files) if files else rows.limit(0)
        return hits.where(contains_any(list(self.columns), needle))
