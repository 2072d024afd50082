"""A table of chunked and embedded documents that follows its source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.docs import Model, chunk, embed
from ..session import reliable, written
from ..sources.buckets import BROADCAST_KEYS, BucketTable


@dataclass(frozen=True)
class DocumentTable:
    """Chunks and embeddings of documents below ``path``, a folder all executors share.

    A document is known by its id and the hash of its text, a chunk's embedding by the
    hash of the chunk's text. An update chunks new and changed documents only and
    embeds only texts no chunk had before, wherever they stood; documents and texts
    that are gone are removed. The table then equals one made afresh.
    """

    path: str
    doc: str
    doc_type: str = "string"
    size: int = 1000
    overlap: int = 200
    tail: bool = False
    model: Model | None = None
    dim: int = 256
    buckets: int = 32

    def _table(self, name: str, keys: tuple[str, ...], columns: str) -> BucketTable:
        return BucketTable(f"{self.path}/{name}", keys, columns, self.buckets)

    @property
    def documents(self) -> BucketTable:
        return self._table("documents", (self.doc,), f"`{self.doc}` {self.doc_type}, text_hash string")

    @property
    def chunks(self) -> BucketTable:
        columns = f"`{self.doc}` {self.doc_type}, pos int, start_char int, end_char int, text string, hash string"
        return self._table("chunks", (self.doc,), columns)

    @property
    def embeddings(self) -> BucketTable:
        return self._table("embeddings", ("hash",), "hash string, embedding array<float>")

    def update(self, docs: DataFrame, text: str) -> dict[str, int]:
        """Make the table that of ``docs``, all documents there are now; returns what there was to do.

        Rows without an id are passed over; of rows that share an id the one with the
        greatest text hash counts. An update that was cut short is completed by the
        next one.
        """
        spark = docs.sparkSession
        given = docs.select(F.col(self.doc).cast(self.doc_type).alias(self.doc), F.col(text).alias("_text")).dropna(subset=[self.doc])
        given = given.withColumn("text_hash", F.sha2(F.coalesce("_text", F.lit("")), 256))
        now = reliable(given.groupBy(self.doc).agg(F.max("text_hash").alias("text_hash"), F.count(F.lit(1)).alias("_rows")))
        before = self.documents.read(spark)
        changed = reliable(now.join(before, [self.doc, "text_hash"], "left_anti"))
        gone = reliable(before.join(now, self.doc, "left_anti").select(self.doc))
        pieces = chunk(self._rows_of(given, now, changed), "_text", self.size, self.overlap, self.tail, keep=[self.doc])
        pieces = written(pieces.withColumn("hash", F.sha2("text", 256)), "pieces")

        # embeddings first, then chunks, then what is known: each is right without the next
        texts = pieces.groupBy("hash").agg(F.first("text").alias("text"))
        fresh = texts.join(self.embeddings.read_keys(pieces).select("hash"), "hash", "left_anti")
        made = written(embed(fresh, "text", self.model, dim=self.dim).select("hash", "embedding"), "made")
        self.embeddings.replace(made, made)
        touched = changed.select(self.doc).unionByName(gone)
        dropped = reliable(self.chunks.read_keys(touched).select("hash").distinct())
        self.chunks.replace(touched, pieces)
        unused = reliable(dropped.join(self.chunks.read(spark).select("hash"), "hash", "left_anti"))
        self.embeddings.replace(unused, made.limit(0))
        self.documents.replace(touched, changed)
        names = {"changed": changed, "removed": gone, "chunks": pieces, "embedded": made, "forgotten": unused}
        return {name: df.count() for name, df in names.items()}

    def _rows_of(self, given: DataFrame, now: DataFrame, changed: DataFrame) -> DataFrame:
        """One row per changed document; texts move only where ids repeat or the changed ones are neither few nor all."""
        repeated = not changed.where("_rows > 1").isEmpty()
        if repeated:
            return given.join(changed, [self.doc, "text_hash"], "left_semi").dropDuplicates([self.doc]).select(self.doc, "_text")
        n = changed.count()
        if n == now.count():
            return given.select(self.doc, "_text")
        ids = changed.select(self.doc)
        return given.select(self.doc, "_text").join(F.broadcast(ids) if n <= BROADCAST_KEYS else ids, self.doc, "left_semi")

    def read(self, spark: SparkSession) -> DataFrame:
        """(doc, pos, start_char, end_char, text, embedding)."""
        return self.chunks.read(spark).join(self.embeddings.read(spark), "hash").drop("hash")
