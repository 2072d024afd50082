"""Sinks and stored tables, written below the shared scratch folder and read back."""

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators.aggregate import output_stats
from tidemark.plans.flows import ingest_rows
from tidemark.plans.views import OnDemandView, View
from tidemark.plans.workspace import Workspace
from tidemark.session import scratch_path
from tidemark.sources.read import BatchSource, read_csv
from tidemark.sources.write import (
    LatestTable, export_parquet, feature_log, offline_append, save_dataset, write_feature_log,
)

from . import near, query
from .documents import sql_chunk_rows

START, HALF, END = datetime(2024, 1, 1), datetime(2024, 1, 15), datetime(2024, 1, 31)


def activity(t, **more):
    return View("activity", ("user_id",), ("value",), BatchSource(frame=t.events), ts="ts", **more)


def space_of(t, *views, **more):
    return Workspace(t.spark, scratch_path(t.spark, "space"), list(views), **more)


LAST_VALUE = "select user_id, value, ts from events {where} qualify row_number() over (partition by user_id order by ts desc) = 1"


@query(LAST_VALUE.format(where="where ts between timestamp '2024-01-13' and timestamp '2024-01-31'"))
def incremental_views(t):
    """A first run one time to live back, then a run from where it ended."""
    space = space_of(t, activity(t, ttl=timedelta(days=2)))
    space.materialize_incremental(HALF)
    space.materialize_incremental(END)
    return space.online("activity").read(t.spark).select("user_id", "value", "ts")


@query(LAST_VALUE.format(where=""))
def pushed_online(t):
    """Two batches pushed in the wrong order leave the newest values."""
    space = space_of(t, activity(t))
    rows = t.events.select("user_id", "value", "ts")
    space.push(["activity"], rows.filter(F.col("ts") >= F.lit(HALF)), "online")
    space.push(["activity"], rows.filter(F.col("ts") < F.lit(HALF)), "online")
    return space.online("activity").read(t.spark).select("user_id", "value", "ts")


@query("select user_id, value, ts from events")
def pushed_offline(t):
    space = space_of(t, activity(t))
    rows = t.events.select("user_id", "value", "ts")
    space.push(["activity"], rows.filter(F.col("ts") >= F.lit(HALF)), "offline")
    space.push(["activity"], rows.filter(F.col("ts") < F.lit(HALF)), "offline")
    return space.offline("activity").select("user_id", "value", "ts")


@query(LAST_VALUE.format(where=""))
def compacted_table(t):
    """Upserts by event type, a compaction, and one upsert more; the read scans two partitions."""
    table = LatestTable(scratch_path(t.spark, "latest"), ("user_id",), "ts")
    kinds = [["click", "view"], ["purchase"], ["click", "view", "purchase"]]
    rows = t.events.select("user_id", "value", "ts", "event_type")
    for batch, kind in enumerate(kinds):
        part = rows.filter(F.col("event_type").isin(kind) if batch < 2 else ~F.col("event_type").isin(kind))
        if batch == 2:
            table.compact(t.spark)
        table.upsert(part.drop("event_type"))
    if table.batches(t.spark).select("batch_writer").distinct().count() != 2:
        raise AssertionError("a compacted partition is still read")
    return table.read(t.spark).select("user_id", "value", "ts")


@query(
    """
    select user_id, round(1e-9 + value * 2, 4) as doubled from (
        select * from events where ts between timestamp '2024-01-01' and timestamp '2024-01-15'
        qualify row_number() over (partition by user_id order by ts desc) = 1)
    """
)
def on_demand_table(t):
    """An on-demand view computed for every key and kept online."""
    double = OnDemandView(
        "double", ("activity:value",), lambda df: df.withColumn("doubled", near(F.col("value") * 2, 4)), "doubled double",
        "spark", keys=("user_id",),
    )
    space = space_of(t, activity(t), on_demand=[double])
    space.materialize_on_demand("double", START, HALF)
    return space.online("double").read(t.spark).select("user_id", "doubled")


@query("select 'orders' as name, min(o_orderdate) as min_ts, max(o_orderdate) as max_ts from orders")
def saved_range(t):
    return save_dataset(t.orders, "orders", "o_orderdate", scratch_path(t.spark, "saved"))


@query("select o_orderpriority, count(*) as n, round(1e-9 + sum(o_totalprice), 2) as total from orders group by 1")
def exported_orders(t):
    """Staged parquet files, listed and read back."""
    place = scratch_path(t.spark, "export")
    listed = export_parquet(t.orders, place).agg(F.sum("rows")).first()[0]
    back = t.spark.read.parquet(place)
    if back.count() != listed:
        raise AssertionError("the list of files is not whole")
    return back.groupBy("o_orderpriority").agg(F.count("*").alias("n"), near(F.sum("o_totalprice"), 2).alias("total"))


@query("select o_orderkey, o_custkey, round(1e-9 + o_totalprice, 2) as o_totalprice from orders")
def appended_orders(t):
    """Appends are reordered and cast to the target's columns."""
    path = scratch_path(t.spark, "offline")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    rows.filter("o_orderstatus = 'F'").write.parquet(path)
    rest = t.orders.filter("o_orderstatus <> 'F'")
    offline_append(
        rest.select(F.col("o_totalprice").cast("string").alias("o_totalprice"), "o_custkey", "o_orderkey"), path, is_path=True
    )
    return t.spark.read.parquet(path).withColumn("o_totalprice", near("o_totalprice", 2))


@query("select c_custkey, c_name, c_nationkey, round(1e-9 + c_acctbal, 2) as c_acctbal, c_mktsegment from customer")
def csv_round_trip(t):
    """CSV with a header and inferred types."""
    path = scratch_path(t.spark, "csv")
    t.customer.write.option("header", True).csv(path)
    back = read_csv(t.spark, path)
    return back.select(
        F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_nationkey", near("c_acctbal", 2).alias("c_acctbal"),
        "c_mktsegment",
    )


@query("select event_id, user_id, value, ts from events where ts between timestamp '2024-01-08' and timestamp '2024-01-15'")
def partitioned_range(t):
    """A time range that also prunes the date partitions of its source."""
    path = scratch_path(t.spark, "days")
    t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).write.partitionBy("day").parquet(path)
    source = BatchSource(path=path, ts="ts", partition="day", schema=t.events.schema.add("day", "string"))
    view = View("days", ("user_id",), ("value",), source, ts="ts")
    return view.rows(t.spark, datetime(2024, 1, 8), HALF).select("event_id", "user_id", "value", "ts")


@query(f"select count(*) as row_count, sum(length(text)) as size from ({sql_chunk_rows(1000, 200)})")
def ingested_documents(t):
    """Chunk, embed, write, number; what was written."""
    table = ingest_rows(t.documents, "doc_id", "text", scratch_path(t.spark, "documents"), keep=["source"])
    return output_stats(table, "text")


@query(LAST_VALUE.format(where=""))
def push_sql_view(t):
    """A push goes through the view's SQL transform."""
    view = activity(t, transform=lambda rows: f"select user_id, value * 2 as value, ts from {rows}", mode="sql")
    space = space_of(t, view)
    space.push(["activity"], t.events.select("user_id", (F.col("value") / 2).alias("value"), "ts"))
    return space.online("activity").read(t.spark).select("user_id", "value", "ts")


@query(
    """
    select event_type, cast(ts as date) as day, count(*) as rows, count(value) as present from events group by all
    """
)
def partitioned_feature_log(t):
    """A feature log written by date and read back from its partitions."""
    path = scratch_path(t.spark, "log")
    log = feature_log(t.events, "activity", ["user_id", "event_type"], ["value"], "ts", "ts", "event_id")
    write_feature_log(log, path, ["__log_date"])
    back = t.spark.read.parquet(path)
    return back.groupBy("event_type", F.col("__log_date").alias("day")).agg(
        F.count("*").alias("rows"), F.count_if(F.col("activity__value__status") == "PRESENT").alias("present")
    )


@query(
    """
    with w as (select user_id, value, ts from events where ts between timestamp '2024-01-01' and timestamp '2024-01-15'
               qualify row_number() over (partition by user_id order by ts desc) = 1)
    select 'online' as place, user_id, value, ts from w union all select 'offline', user_id, value, ts from w
    """
)
def materialized_both(t):
    """One range into the online and the offline table."""
    space = space_of(t, activity(t, online=True, offline=True))
    space.materialize(START, HALF)
    stored = {"online": space.online("activity").read(t.spark), "offline": space.offline("activity")}
    parts = [df.select(F.lit(place).alias("place"), "user_id", "value", "ts") for place, df in stored.items()]
    return parts[0].unionByName(parts[1])


@query(
    """
    select user_id, value, ts, (select count(*) from events) as rows from events
    where ts between timestamp '2024-01-08' and timestamp '2024-01-15'
    """
)
def table_source(t):
    """A dataset saved as a table, and a view that reads a range of it."""
    name = f"saved_events_{uuid.uuid4().hex}"
    save_dataset(t.events, name, "ts")
    view = View("saved", ("user_id",), ("value",), BatchSource(table=name, ts="ts"), ts="ts")
    rows = view.rows(t.spark, datetime(2024, 1, 8), HALF).select("user_id", "value", "ts")
    return rows.withColumn("rows", F.lit(t.spark.table(name).count()))
