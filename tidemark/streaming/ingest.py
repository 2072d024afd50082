"""Structured Streaming: ingest into views, windowed aggregates, incremental tiles."""

from __future__ import annotations

import os
from datetime import timedelta
from functools import cache
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.aggregate import Aggregation, seconds
from ..operators.latest import latest_per_key
from ..operators.project import to_utc
from ..operators.tiles import build_tiles, merge_tiles, windowed_from_tiles
from ..plans.workspace import Workspace
from ..sources.write import read_batches, write_batch
from .state import stream_windows, timer_store


def _start(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None
) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    # without an interval the run ends once all input present at its start is read
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gave the stream of a checkpoint; it outlives restarts, a new checkpoint has another."""
    return spark.read.schema("id string").json(os.path.join(checkpoint, "metadata")).first()["id"]


def ingest(
    workspace: Workspace,
    view: str,
    stream: DataFrame,
    to: str = "online",
    transform: Callable[[DataFrame], DataFrame] | None = None,
    every: str | None = None,
    checkpoint: str | None = None,
    created: str = "created",
) -> StreamingQuery:
    """Keep a view's tables up to date from a stream.

    Every micro-batch is transformed, reduced to its newest row per key, stamped
    with the time of writing and written under the stream's id and its batch
    number, so a replay after a failure leaves the same tables and other streams,
    pushes and materialisations are left alone. Rows not newer than the stored ones
    lose.
    """
    v = workspace.views[view]
    columns = [*v.keys, *v.features, v.ts]
    rows = transform(stream) if transform else stream
    place = checkpoint or os.path.join(workspace.root, "checkpoints", view)

    named = cache(lambda: stream_id(workspace.spark, place))  # Spark names a stream before its first batch

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = latest_per_key(batch.select(*columns), list(v.keys), v.ts)
        stamped = newest.withColumn(created, F.current_timestamp())
        workspace.write_view(stamped, view, to, batch_id, named())

    return _start(rows, write, place, every)


def run_view(
    workspace: Workspace, view: str, to: str = "online", every: str | None = None, checkpoint: str | None = None
) -> StreamingQuery:
    """Feed a stream view's tables from its stream: rows as they come, or windows as they close."""
    v, spark = workspace.views[view], workspace.spark
    rows = v.stream_rows(spark)
    if not v.aggregations:
        return ingest(workspace, view, rows, to, None, every, checkpoint)
    if not v.hop:
        raise ValueError(f"view {view}: windows over a stream need a hop")
    place = checkpoint or os.path.join(workspace.root, "checkpoints", view)
    windows = stream_windows(rows, list(v.keys), list(v.aggregations), v.ts, v.hop, v.watermark).withColumnRenamed("window_end", v.ts)
    named = cache(lambda: stream_id(spark, place))

    def write(batch: DataFrame, batch_id: int) -> None:
        workspace.write_view(batch, view, to, batch_id, named())

    with timer_store(spark):
        return _start(windows, write, place, every)


def stream_aggregate(
    stream: DataFrame, keys: list[str], specs: list[Aggregation], ts: str, watermark: str = "0 seconds"
) -> DataFrame:
    """Tumbling or sliding window aggregates; state older than the watermark is dropped.

    All specs share one window and slide, as a stream has one windowed state.
    """
    shapes = {(s.time_window, s.slide_interval) for s in specs}
    if len(shapes) != 1 or None in {w for w, _ in shapes}:
        raise ValueError("stream aggregates need one common time window")
    ((window, slide),) = shapes
    span = F.window(F.col(ts), f"{seconds(window)} seconds", f"{seconds(slide)} seconds" if slide else None)
    grouped = to_utc(stream, ts).withWatermark(ts, watermark).groupBy(*keys, span.alias("_w"))
    return (
        grouped.agg(*[s.expr() for s in specs])
        .withColumns({"window_start": F.col("_w.start"), "window_end": F.col("_w.end")})
        .drop("_w")
    )


def write_stream(
    stream: DataFrame, path: str, checkpoint: str, every: str | None = None, mode: str = "append"
) -> StreamingQuery:
    """Append finished windows to parquet."""
    writer = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start(path)


def stream_tiles(
    stream: DataFrame, keys: list[str], specs: list[Aggregation], ts: str, hop: timedelta, path: str,
    checkpoint: str, every: str | None = None,
) -> StreamingQuery:
    """Reduce each micro-batch to tiles, written under the stream's id and its batch number.

    Tiles merge, so late rows just add a tile to an old hop and need no state.
    """

    named = cache(lambda: stream_id(stream.sparkSession, checkpoint))

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(build_tiles(batch, keys, specs, ts, hop), path, named(), batch_id)

    return _start(stream, write, checkpoint, every)


def read_tiles(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return merge_tiles(read_batches(spark, path).drop("batch_writer", "batch_number"), keys)


def windows_from_stream(
    spark: SparkSession, path: str, keys: list[str], specs: list[Aggregation], hop: timedelta
) -> DataFrame:
    """Sliding-window values from the tiles written so far."""
    return windowed_from_tiles(read_tiles(spark, path, keys), keys, specs, hop)
