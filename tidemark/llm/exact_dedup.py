"""Exact deduplication against a persistent index of text digests.

The index is a table bucketed and sorted by digest. A batch is first reduced to
one row per digest (partial aggregation, so a text that fills a third of the rows
is one row per map task), anti-joined with the index bucket by bucket, and what is
new is appended. An index row names the document that owns the digest, so running
a batch again after a crash gives the same decisions.

Defined cases: a null text is an empty text; a null id counts as smaller than any
id; rows that repeat both id and text are one document, of which ``keep_unique``
returns one row; an empty batch appends nothing and gives no rows. Extra columns
of any name pass through ``keep_unique`` unread.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_root, shuffle_partitions

from .common import MARK, join_groups, stored


def text_digest(text: str | Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes, as 32 bytes."""
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class DigestIndex:
    """Digests seen so far and the document that owns each: (digest, keep_id).

    ``location`` is a folder every executor reaches. The table's name lives in the
    session's catalog only, so a later session attaches the same folder again; it
    must use the same number of buckets, which is why that is part of the path.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.location = f"{location.rstrip('/')}/buckets-{buckets}"
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.location).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.location}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append_unseen(self, groups: DataFrame) -> None:
        """Add the rows of ``groups`` (digest, keep_id; one per digest) whose digest is not there yet."""
        new = groups.repartition(self.buckets, "digest").hint("merge")
        new = new.join(self.read().select("digest"), "digest", "left_anti")
        new.select("digest", "keep_id").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def own_index(spark: SparkSession) -> DigestIndex:
    """A fresh index below the shared folder."""
    where = f"{scratch_root(spark).rstrip('/')}/tidemark/digests-{uuid.uuid4().hex}"
    return DigestIndex(spark, where, shuffle_partitions(spark))


def decide(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, keep_id, group_size, kept) for every row of ``docs``; registers what is new.

    Among equal texts of the batch the largest id stays, unless the index already
    has the text; then the index's owner is the one that stays, and the batch's
    rows go (``kept`` is true only for the owner itself).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_digest(text_col).alias("digest"))
    groups = rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = stored(groups, "digests")
    index.append_unseen(groups)
    owners = index.read().join(groups.select("digest", "group_size"), "digest")
    owned = join_groups(rows, owners.select("digest", "keep_id", "group_size"), "digest", "group_size")
    return owned.select(
        "id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")
    )


def keep_unique(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    What goes is joined against the rows by (id, digest), so no text is moved for a
    group's sake and a group of any size is spread by its ids.
    """
    d, i, n = f"{MARK}digest", f"{MARK}id", f"{MARK}copies"
    tagged = docs.withColumn(i, F.col(id_col).cast("long")).withColumn(d, text_digest(text_col))
    decided = decide(docs, index, id_col, text_col)
    counts = decided.groupBy(F.col("id").alias(f"{i}2"), F.col("digest").alias(f"{d}2")).agg(
        F.count(F.lit(1)).alias(n), F.first("kept").alias(f"{MARK}kept")
    )
    odd = stored(counts.where(f"not {MARK}kept or {n} > 1"), "goes")  # what goes, and rows that occur again
    same = F.col(i).eqNullSafe(F.col(f"{i}2")) & (F.col(d) == F.col(f"{d}2"))
    out = tagged.join(odd, same, "left_anti")
    repeated = odd.where(f"{MARK}kept")
    if not repeated.isEmpty():
        out = out.unionByName(tagged.join(repeated, same, "left_semi").dropDuplicates([i, d]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
