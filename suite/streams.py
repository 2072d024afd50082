"""Structured Streaming over the events table, run until all input is read."""

from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.aggregate import Aggregation
from tidemark.plans.views import View
from tidemark.plans.workspace import Workspace
from tidemark.session import scratch_path
from tidemark.sources.read import BatchSource, decode, read_file_stream
from tidemark.sources.write import read_batches
from tidemark.streaming.ingest import ingest, stream_aggregate, stream_tiles, windows_from_stream, write_stream

from . import near, query

HOUR, DAY = timedelta(hours=1), timedelta(days=1)
MICROS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def event_stream(t):
    """The events table read as a stream of files."""
    # a pattern, as a stream's path must be a folder or a pattern
    return read_file_stream(t.spark, f"{t.folder}/event[s].parquet", t.events.schema)


def finish(running):
    running.awaitTermination()
    return running


@query("select user_id, value, ts from events qualify row_number() over (partition by user_id order by ts desc) = 1")
def stream_latest(t):
    """Ingest into an online table, then read it."""
    view = View("activity", ("user_id",), ("value",), BatchSource(frame=t.events), ts="ts")
    space = Workspace(t.spark, scratch_path(t.spark, "stream"), [view])
    finish(ingest(space, "activity", event_stream(t)))
    return space.online("activity").read(t.spark).select("user_id", "value", "ts")


@query("select user_id, value, ts from events qualify row_number() over (partition by user_id order by ts desc) = 1")
def stream_offline(t):
    """The same into the offline table; a bounded run reads everything once."""
    view = View("activity", ("user_id",), ("value",), BatchSource(frame=t.events), ts="ts")
    space = Workspace(t.spark, scratch_path(t.spark, "stream"), [view])
    finish(ingest(space, "activity", event_stream(t), to="offline"))
    return space.offline("activity").select("user_id", "value", "ts")


@query(
    """
    select cast(json_extract(props, '$.k') as bigint) as k, max(ts) as ts from events group by 1
    """
)
def stream_json(t):
    """Messages decoded from JSON, newest row per key."""
    stream = event_stream(t).select(
        F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), "ts", "event_id"), MICROS).alias("value")
    )
    view = View("props", ("k",), ("event_id",), BatchSource(frame=t.events), ts="ts")
    space = Workspace(t.spark, scratch_path(t.spark, "stream"), [view])
    finish(ingest(space, "props", decode(stream, "json", "k long, ts timestamp_ntz, event_id long", MICROS)))
    return space.online("props").read(t.spark).select("k", "ts")


def _windows(t, specs):
    place = scratch_path(t.spark, "windows")
    out = stream_aggregate(event_stream(t), ["user_id"], specs, "ts", "1 hour")
    finish(write_stream(out, place + "/data", place + "/checkpoint"))
    done = t.spark.read.parquet(place + "/data")
    return done.withColumns(
        {
            **{c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")},
            **{s.output: near(s.output, 4) for s in specs if s.function == "sum"},
        }
    )


@query(
    """
    select user_id, day as window_start, day + interval 1 day as window_end,
        round(1e-9 + sum(value), 4) as sum_value_86400s, count(value) as count_value_86400s
    from (select *, date_trunc('day', ts) as day from events)
    where day + interval 1 day <= (select max(ts) - interval 1 hour from events) group by user_id, day
    """
)
def stream_tumbling(t):
    """Windows the watermark has closed."""
    return _windows(t, [Aggregation("value", f, DAY) for f in ("sum", "count")])


@query(
    """
    with w as (select user_id, value, time_bucket(interval 6 hour, ts) + interval (i * 6) hour as window_end
               from events, (select unnest(range(1, 5)) as i))
    select user_id, window_end - interval 1 day as window_start, window_end, round(1e-9 + sum(value), 4) as sum_value_86400s,
        max(value) as max_value_86400s
    from w group by all having window_end <= (select max(ts) - interval 1 hour from events)
    """
)
def stream_sliding(t):
    return _windows(t, [Aggregation("value", f, DAY, timedelta(hours=6)) for f in ("sum", "max")])


@query(
    """
    with h as (select distinct user_id, date_trunc('hour', ts) + interval 1 hour as window_end from events)
    select h.user_id, h.window_end, count(value) as count_value_86400s, round(1e-9 + avg(value), 4) as avg_value_86400s,
        min(value) as min_value_86400s
    from h join events e on e.user_id = h.user_id and e.ts < h.window_end and e.ts >= h.window_end - interval 1 day
    group by all
    """
)
def stream_tiled(t):
    """Hourly tiles per micro-batch, merged into day windows."""
    specs = [Aggregation("value", f, DAY) for f in ("count", "avg", "min")]
    place = scratch_path(t.spark, "tiles")
    finish(stream_tiles(event_stream(t), ["user_id"], specs, "ts", HOUR, place + "/data", place + "/checkpoint"))
    out = windows_from_stream(t.spark, place + "/data", ["user_id"], specs, HOUR)
    return out.withColumns(
        {"window_end": F.col("window_end").cast("timestamp_ntz"), "avg_value_86400s": near("avg_value_86400s", 4)}
    )


NEWEST = "select user_id, value, ts from events qualify row_number() over (partition by user_id order by ts desc) = 1"
HALF = datetime(2024, 1, 15)


def _space(t):
    view = View("activity", ("user_id",), ("value",), BatchSource(frame=t.events), ts="ts", online=True, offline=True)
    return Workspace(t.spark, scratch_path(t.spark, "stream"), [view])


@query(NEWEST)
def stream_after_materialize(t):
    """A stream after a materialised range; neither overwrites the other's rows."""
    space = _space(t)
    space.materialize(HALF, datetime(2100, 1, 1))
    older = event_stream(t).filter(F.col("ts") < F.lit(HALF))
    finish(ingest(space, "activity", older, to="online_and_offline"))
    return space.online("activity").read(t.spark).select("user_id", "value", "ts")


@query("select event_type, count(distinct user_id) as rows from events group by 1 union all select 'online', count(distinct user_id) from events")
def stream_new_checkpoint(t):
    """Streams with checkpoints of their own into one view: all their rows are kept."""
    space = _space(t)
    kinds = sorted(r[0] for r in t.events.select("event_type").distinct().collect())
    for kind in kinds:  # the event types, a handful
        rows = event_stream(t).filter(F.col("event_type") == kind)
        place = scratch_path(t.spark, f"checkpoint-{kind}")
        finish(ingest(space, "activity", rows, to="online_and_offline", checkpoint=place))
    stored = read_batches(t.spark, space.offline_path("activity"))
    per_stream = stored.groupBy("batch_writer").agg(F.count("*").alias("rows"))
    newest = t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("rows"))
    n = per_stream.count()
    if n != len(kinds):
        raise AssertionError(f"{n} streams are stored")
    ranked = lambda df, by: df.withColumn("at", F.row_number().over(Window.orderBy("rows", by)))
    both = ranked(per_stream, "batch_writer").drop("batch_writer").join(ranked(newest, "event_type").drop("rows"), "at")
    online = space.online("activity").read(t.spark).agg(F.lit("online").alias("event_type"), F.count("*").alias("rows"))
    return both.select("event_type", "rows").unionByName(online)


@query(NEWEST)
def stream_many_batches(t):
    """A file per micro-batch, newest first, so later batches are late."""
    place = scratch_path(t.spark, "files")
    parts = t.events.withColumn("late", F.when(F.col("ts") >= F.lit(HALF), 0).otherwise(1))
    for late in (0, 1):
        parts.filter(F.col("late") == late).drop("late").repartition(2).write.mode("append").parquet(place)
    space = _space(t)
    finish(ingest(space, "activity", read_file_stream(t.spark, place, t.events.schema, files_per_batch=1)))
    batches = space.online("activity").batches(t.spark).select("batch_number").distinct().count()
    if batches != 4:
        raise AssertionError(f"{batches} micro-batches")
    return space.online("activity").read(t.spark).select("user_id", "value", "ts")
