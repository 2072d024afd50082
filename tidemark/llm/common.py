"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import reliable, scratch_root, shuffle_partitions

MARK = "_tm_"  # prefix of columns the operators add beside a caller's own


def stored(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """Write ``df`` below the shared folder once, partitioned by some columns, and read it back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_to_arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def per_text(docs: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Rows of ``make()(id, text)`` for every document, computed in Arrow batches.

    ``make`` runs once per task and may load a vocabulary; the function it
    returns gives a list of tuples for one document. A null text counts as empty.
    Only the id and the text leave the scan.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = make()
        for batch in batches:
            out: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                out += rows_of(i, text.as_py() or "")
                if len(out) >= 20_000:
                    yield rows_to_arrow(out, arrow)
                    out = []
            if out:
                yield rows_to_arrow(out, arrow)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def held_out(id_col: str, folds: int) -> Column:
    """True for ids whose crc32, taken of the id as text, is divisible by ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row per key and the key's number of rows in ``size``.

    Keys with over a thousandth of the rows, of which there are under a thousand, are
    broadcast by name; their rows are dealt out by a hash and meet copies of their
    group, so no key is one task.
    """
    spark = rows.sparkSession
    n, salt = f"{MARK}n", f"{MARK}salt"
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) > max(1000, total // 1000)
    salts = shuffle_partitions(spark)
    named = F.broadcast(groups.where(hot).select(key, F.lit(salts).alias(n)))
    dealt = rows.join(named, key, "left").withColumn(
        salt, F.when(F.col(n).isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).cast("int")
    )
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.drop(n).join(groups.withColumn(salt, F.explode(copies)), [key, salt]).drop(salt)


def _ends(hook: DataFrame) -> DataFrame:
    """(n, p) with p followed to its end; every p is an n, and not greater than its n."""
    hook = reliable(hook)
    while True:
        further = hook.select(F.col("n").alias("p"), F.col("p").alias("to"))
        jumped = reliable(hook.join(further, "p").select("n", F.col("to").alias("p"), (F.col("to") < F.col("p")).alias("moved")))
        hook = jumped.select("n", "p")
        if jumped.where("moved").isEmpty():
            return hook


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the hooks to
    where they end, by jumps that double their reach, and replaces the ends of all
    edges by that. Of every group of linked nodes at least half are gone after a round,
    whatever the ids' order along a chain, so both rounds and jumps are logarithmic.
    Rounds are kept in the shared folder. No edges give no rows.
    """
    live = reliable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    roots = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = _ends(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("p")))
        if roots is None:
            roots = hook.select(F.col("n").alias("node"), F.col("p").alias("root"))
        else:
            moved = roots.join(hook, roots.root == hook.n, "left")
            roots = reliable(moved.select("node", F.coalesce("p", "root").alias("root")))
        left = live.join(hook, live.a == hook.n).select(F.col("p").alias("a"), "b")
        ends = left.join(hook, left.b == hook.n).select("a", F.col("p").alias("b"))
        live = reliable(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if roots is None:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    return roots
