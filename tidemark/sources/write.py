"""Batch sinks: offline appends, saved datasets, exports, logs, latest-value tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date
from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import ts_range
from ..operators.joins import NOT_FOUND, PRESENT
from ..operators.latest import latest_per_key, top_rows
from ..operators.project import conform
from ..session import fits_one_task
from .pointer import Pointer


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "overwrite", properties: dict | None = None) -> None:
    df.write.jdbc(url, table, mode=mode, properties=properties or {})


def offline_append(df: DataFrame, target: str, is_path: bool = False) -> None:
    """Append after an exact column check, in the target's order and types."""
    spark = df.sparkSession
    schema = (spark.read.parquet(target) if is_path else spark.table(target)).schema
    rows = conform(df, schema)
    if is_path:
        rows.write.mode("append").parquet(target)
    else:
        rows.write.mode("append").insertInto(target)


def save_dataset(df: DataFrame, name: str, ts: str, path: str | None = None, allow_overwrite: bool = False) -> DataFrame:
    """Persist a retrieval as a table (or parquet path); returns its name and time range."""
    writer = df.write.mode("overwrite" if allow_overwrite else "errorifexists")
    if path:
        writer.parquet(path)
        stored = df.sparkSession.read.parquet(path)
    else:
        writer.saveAsTable(name)
        stored = df.sparkSession.table(name)
    return ts_range(stored, ts).select(F.lit(name).alias("name"), "min_ts", "max_ts")


def export_parquet(df: DataFrame, uri: str) -> DataFrame:
    """Write to staged parquet; returns the files (file, rows), read from what was written."""
    df.write.mode("errorifexists").parquet(uri)
    written = df.sparkSession.read.parquet(uri)
    return written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def feature_log(
    df: DataFrame, view: str, keys: list[str], features: list[str], ts: str, log_ts: str, request_id: str
) -> DataFrame:
    """Log rows: per feature its value, time and status, plus log time, date and request id."""
    cols = [F.col(k) for k in keys]
    for f in features:
        cols += [
            F.col(f).alias(f"{view}__{f}"),
            F.col(ts).alias(f"{view}__{f}__timestamp"),
            F.when(F.col(f).isNull(), NOT_FOUND).otherwise(PRESENT).alias(f"{view}__{f}__status"),
        ]
    return df.select(
        *cols,
        F.col(log_ts).alias("__log_timestamp"),
        F.to_date(log_ts).alias("__log_date"),
        F.col(request_id).cast("string").alias("__request_id"),
    )


def write_feature_log(log: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = log.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def upsert_latest(
    current: DataFrame, updates: DataFrame, keys: list[str], ts: str, created: str | None = None
) -> DataFrame:
    """Latest values after an update; a row not newer than the stored one is ignored."""
    both = current.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    order = [F.desc(ts), F.asc("_new")] + ([F.desc(created)] if created else [])
    return top_rows(both, keys, order).drop("_new")


def merge_latest(updates: DataFrame, table: str, keys: list[str], ts: str) -> None:
    """The same upsert by MERGE, for a table format that supports it."""
    rows = latest_per_key(updates, keys, ts)
    same = " and ".join(f"{table}.{k} <=> source.{k}" for k in keys)
    newer = F.expr(f"source.{ts} > {table}.{ts}")
    rows.alias("source").mergeInto(table, F.expr(same)).whenMatched(newer).updateAll().whenNotMatched().insertAll().merge()


PUSHES = "pushes"  # stands for all writers that don't number their batches
FOLDED = "folded"


def one_off() -> int:
    """A batch number nobody else has."""
    return uuid.uuid4().int >> 66


def write_batch(df: DataFrame, path: str, writer: str, batch: int, approve: Callable[[], None] | None = None) -> None:
    """Write rows as one partition named by who writes and by the writer's own batch number.

    Writing a batch again replaces just that partition, so a replay changes nothing
    and no two writers touch each other's rows. When ``approve`` raises, the partition
    is removed again.
    """
    (
        _named(df, writer, batch).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_writer", "batch_number")
        .parquet(path)
    )
    if approve:
        try:
            approve()
        except Exception:
            Pointer(df.sparkSession, path).remove(f"{path}/batch_writer={writer}/batch_number={batch}")
            raise


def append_batch(df: DataFrame, path: str, today: date | None = None) -> None:
    """Add rows of a writer that doesn't number its batches to the partition of the day."""
    day = int((today or date.today()).strftime("%Y%m%d"))
    _named(df, PUSHES, day).write.mode("append").partitionBy("batch_writer", "batch_number").parquet(path)


def _named(df: DataFrame, writer: str, batch: int) -> DataFrame:
    return df.withColumn("batch_writer", F.lit(writer)).withColumn("batch_number", F.lit(batch).cast("long"))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark.read.option("mergeSchema", False).parquet(path))


def _typed(df: DataFrame) -> DataFrame:
    """Names of partitions as text and numbers, whatever they look like."""
    return df.withColumn("batch_writer", F.col("batch_writer").cast("string")).withColumn("batch_number", F.col("batch_number").cast("long"))


@dataclass(frozen=True)
class LatestTable:
    """A latest-value table on parquet: a base bucketed by key, and a few batches written since.

    Each upsert adds one small partition, see ``write_batch``, and names it in the
    table's ``Pointer``; several streams, pushes and materialisations may write at
    once. Reading keeps the newest row per key. The batch that makes ``most`` folds
    them all into one, or into the base once together they have a quarter of its rows,
    so a read lists a bounded number of folders however many upserts there were. What
    was folded is removed a few versions later. ``read_keys`` reads the buckets of the
    keys asked for, and of the base nothing else.
    """

    path: str
    keys: tuple[str, ...]
    ts: str
    created: str | None = None
    buckets: int = 32
    most: int = 16

    def _pointer(self, spark: SparkSession) -> Pointer:
        return Pointer(spark, f"{self.path}-state")

    def _folder(self, batch: list) -> str:
        return f"{self.path}/batch_writer={batch[0]}/batch_number={batch[1]}"

    def upsert(
        self, df: DataFrame, batch: int | None = None, writer: str | None = None, approve: Callable[[], None] | None = None
    ) -> None:
        """Write the newest row per key of ``df``; a stream gives its own id and its batch number.

        A batch its writer has already written changes nothing, nor does one that
        ``approve``, called once it is written, refuses by raising.
        """
        spark = df.sparkSession
        pointer = self._pointer(spark)
        if writer is not None and pointer.read()[1].get("writers", {}).get(writer, -1) >= (batch or 0):
            return
        name = [writer or PUSHES, (batch or 0) if writer else one_off()]
        rows = latest_per_key(df, list(self.keys), self.ts, self.created)
        write_batch(rows.withColumn("batch_time", F.current_timestamp()), self.path, *name, approve)
        there = pointer.exists(self._folder(name))  # no rows, no folder

        def more(state: dict) -> dict:
            if writer is not None:
                state.setdefault("writers", {})[writer] = batch or 0
            if there and name not in state.setdefault("batches", []):
                state["batches"].append(name)
            return self._listed(state)

        if len(pointer.change(more).get("batches", [])) >= self.most:
            self._fold(spark, whole=False)

    def _listed(self, state: dict) -> dict:
        """The state with all its folders, so that those it drops are removed."""
        state["folders"] = [f for f in (state.get("base"),) if f] + [self._folder(b) for b in state.get("batches", [])]
        return state

    def _parts(self, spark: SparkSession, state: dict) -> tuple[DataFrame | None, DataFrame | None]:
        """The base and the batches in force."""
        base = batches = None
        if state.get("base"):
            base = _typed(spark.read.parquet(f"{self.path}-state/{state['base']}"))
        if state.get("batches"):
            folders = [self._folder(b) for b in state["batches"]]
            batches = _typed(spark.read.option("basePath", self.path).option("mergeSchema", False).parquet(*folders))
        return base, batches

    def batches(self, spark: SparkSession, state: dict | None = None) -> DataFrame:
        """All rows in force."""
        base, batches = self._parts(spark, self._pointer(spark).read()[1] if state is None else state)
        if base is None:
            return read_batches(spark, self.path) if batches is None else batches
        base = base.drop("bucket")
        return base if batches is None else base.unionByName(batches, allowMissingColumns=True)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._newest(self.batches(spark)).drop("batch_writer", "batch_number", "batch_time")

    def read_keys(self, asked: DataFrame) -> DataFrame:
        """The rows of the keys in ``asked``, from the buckets they lie in."""
        spark = asked.sparkSession
        base, batches = self._parts(spark, self._pointer(spark).read()[1])
        known = next((df for df in (batches, base) if df is not None), None)
        schema = (read_batches(spark, self.path) if known is None else known).schema
        # a value hashes by its type, so the keys take the table's
        wanted = asked.select(*[F.col(k).cast(schema[k].dataType).alias(k) for k in self.keys]).dropna().distinct()
        parts = [] if batches is None else [batches]
        if base is not None:
            numbers = [r[0] for r in wanted.select(self._bucket().alias("b")).distinct().collect()]  # at most all buckets
            parts.append(base.where(F.col("bucket").isin(numbers)).drop("bucket"))
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts or [read_batches(spark, self.path)])
        found = rows.join(wanted, list(self.keys), "left_semi")
        return self._newest(found).drop("batch_writer", "batch_number", "batch_time")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _newest(self, rows: DataFrame) -> DataFrame:
        # among equal event times the row that was written first stands
        order = [F.desc(self.ts), F.asc("batch_time"), F.asc("batch_number")] + ([F.desc(self.created)] if self.created else [])
        return top_rows(rows, list(self.keys), order)

    def compact(self, spark: SparkSession) -> None:
        """Fold all batches in force into the base; batches written meanwhile stay as they are."""
        self._fold(spark, whole=True)

    def _fold(self, spark: SparkSession, whole: bool) -> None:
        """Fold the batches into one, or with the base into a new one.

        What was folded counts until the pointer names the new folder, which holds no
        value it lacks, so a crash in between changes no answer.
        """
        pointer = self._pointer(spark)
        state = pointer.read()[1]
        old, base = state.get("batches", []), state.get("base")
        if not old:
            return
        if not whole:
            held, added = (0 if df is None else df.count() for df in self._parts(spark, state))
            whole = 4 * added >= held
        rows = self.batches(spark, state if whole else state | {"base": None})
        newest = self._newest(rows).drop("batch_writer", "batch_number")
        batch, folder = [FOLDED, one_off()], f"base-{uuid.uuid4().hex}"
        if whole:
            named = _named(newest, *batch).withColumn("bucket", self._bucket())
            order = ["bucket", *self.keys]
            spread = named.coalesce(1) if fits_one_task(named) else named.repartitionByRange(*order)
            spread.sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{self.path}-state/{folder}")
        else:
            write_batch(newest, self.path, *batch)

        def swap(now: dict) -> dict | None:
            if now.get("base") != base or not all(b in now["batches"] for b in old):
                return None  # somebody else has folded them
            left = [b for b in now["batches"] if b not in old]
            now |= {"base": folder, "batches": left} if whole else {"batches": [batch, *left]}
            return self._listed(now)

        if (folder if whole else self._folder(batch)) not in pointer.change(swap).get("folders", []):
            pointer.remove(folder if whole else self._folder(batch))
