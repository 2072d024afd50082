"""Grouped aggregates, tumbling and sliding windows, tiles."""

from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.operators.aggregate import Aggregation, aggregate, ts_range
from tidemark.operators.tiles import aggregate_tiled, build_tiles, densify
from tidemark.plans.views import View
from tidemark.sources.read import BatchSource

from . import near, query

HOUR, DAY = timedelta(hours=1), timedelta(days=1)


def rounded(df, *names, digits=4):
    return df.withColumns({n: near(n, digits) for n in names})


def plain_time(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query(
    """
    select user_id, event_type, round(1e-9 + sum(value), 4) as sum_value, count(value) as count_value, round(1e-9 + avg(value), 4) as avg_value,
           min(value) as min_value, max(value) as max_value, round(1e-9 + stddev_samp(value), 4) as std_value,
           round(1e-9 + var_samp(value), 4) as var_value
    from events group by all
    """
)
def agg_all_functions(t):
    specs = [Aggregation("value", f) for f in ("sum", "count", "avg", "min", "max", "std", "var")]
    out = aggregate(t.events, ["user_id", "event_type"], specs)
    return rounded(out, "sum_value", "avg_value", "std_value", "var_value")


@query(
    """
    select l_returnflag, l_linestatus, round(1e-9 + sum(l_quantity), 2) as sum_l_quantity, round(1e-9 + sum(l_extendedprice), 2) as sum_l_extendedprice,
           round(1e-9 + avg(l_discount), 6) as mean_l_discount, count(l_tax) as count_l_tax
    from lineitem group by all
    """
)
def agg_lineitem(t):
    specs = [
        Aggregation("l_quantity", "sum"), Aggregation("l_extendedprice", "sum"),
        Aggregation("l_discount", "mean"), Aggregation("l_tax", "count"),
    ]
    out = aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], specs)
    return rounded(rounded(out, "sum_l_quantity", "sum_l_extendedprice", digits=2), "mean_l_discount", digits=6)


@query("select round(1e-9 + sum(value), 4) as sum_value, count(value) as count_value, max(value) as max_value from events")
def agg_without_keys(t):
    """Request-batch aggregation over everything."""
    out = aggregate(t.events, [], [Aggregation("value", f) for f in ("sum", "count", "max")])
    return rounded(out, "sum_value")


@query(
    """
    select user_id, date_trunc('day', ts) as window_start, date_trunc('day', ts) + interval 1 day as window_end,
           round(1e-9 + sum(value), 4) as sum_value_86400s, count(value) as count_value_86400s, max(value) as max_value_86400s
    from events group by all
    """
)
def tumbling_day(t):
    out = aggregate(t.events, ["user_id"], [Aggregation("value", f, DAY) for f in ("sum", "count", "max")], "ts")
    return rounded(plain_time(out, "window_start", "window_end"), "sum_value_86400s")


@query(
    """
    with w as (select user_id, value, time_bucket(interval 6 hour, ts) + interval (i * 6) hour as window_end
               from events, (select unnest(range(1, 5)) as i))
    select user_id, window_end - interval 1 day as window_start, window_end, round(1e-9 + sum(value), 4) as sum_value_86400s,
           count(value) as count_value_86400s
    from w group by all
    """
)
def sliding_day(t):
    """A day sliding by six hours, straight from the rows."""
    specs = [Aggregation("value", f, DAY, timedelta(hours=6)) for f in ("sum", "count")]
    out = aggregate(t.events, ["user_id"], specs, "ts")
    return rounded(plain_time(out, "window_start", "window_end"), "sum_value_86400s")


@query(
    """
    with d as (select user_id, date_trunc('day', ts) + interval 1 day as window_end, round(1e-9 + sum(value), 4) as sum_value_86400s
               from events group by all),
    h as (select user_id, date_trunc('hour', ts) + interval 1 hour as window_end, max(value) as max_value_3600s
          from events group by all)
    select user_id, window_end, sum_value_86400s, max_value_3600s from d full join h using (user_id, window_end)
    """
)
def two_window_lengths(t):
    """Aggregates of different window lengths, outer joined on window end."""
    out = aggregate(
        t.events, ["user_id"], [Aggregation("value", "sum", DAY), Aggregation("value", "max", HOUR)], "ts"
    )
    return rounded(plain_time(out, "window_end"), "sum_value_86400s")


SLIDING_SPECS = [
    *[Aggregation("value", f, DAY) for f in ("sum", "count", "avg", "std", "min", "max")],
    *[Aggregation("value", f, timedelta(hours=6)) for f in ("sum", "var", "max")],
]
SLIDING_SQL = """
    with span as (select date_trunc('hour', min(ts)) as lo, date_trunc('hour', max(ts)) as hi from events),
    ends as (select unnest(generate_series(lo, hi, interval 1 hour)) + interval 1 hour as window_end from span),
    grid as (select user_id, window_end from (select distinct user_id from events), ends)
    select g.user_id, g.window_end,
        round(1e-9 + coalesce(sum(value), 0), 6) as sum_value_86400s, count(value) as count_value_86400s,
        round(1e-9 + avg(value), 6) as avg_value_86400s, round(1e-9 + stddev_samp(value), 6) as std_value_86400s,
        min(value) as min_value_86400s, max(value) as max_value_86400s,
        round(1e-9 + coalesce(sum(value) filter (e.ts >= g.window_end - interval 6 hour), 0), 6) as sum_value_21600s,
        round(1e-9 + var_samp(value) filter (e.ts >= g.window_end - interval 6 hour), 6) as var_value_21600s,
        max(value) filter (e.ts >= g.window_end - interval 6 hour) as max_value_21600s
    from grid g left join events e on e.user_id = g.user_id and e.ts < g.window_end and e.ts >= g.window_end - interval 1 day
    group by all
"""
INEXACT = (
    "sum_value_86400s", "avg_value_86400s", "std_value_86400s", "sum_value_21600s", "var_value_21600s",
)


@query(SLIDING_SQL)
def sliding_tiled(t):
    """Nine aggregates over two window lengths at every hour, from hourly tiles."""
    out = aggregate_tiled(t.events, ["user_id"], SLIDING_SPECS, "ts", HOUR)
    return rounded(plain_time(out, "window_end"), *INEXACT, digits=6)


@query(f"select * from ({SLIDING_SQL}) qualify row_number() over (partition by user_id order by window_end desc) = 1")
def sliding_tiled_latest(t):
    view = View(
        "activity", ("user_id",), (), BatchSource(frame=t.events), ts="ts", aggregations=tuple(SLIDING_SPECS), hop=HOUR
    )
    out = view.build(t.spark).withColumnRenamed("ts", "window_end")
    return rounded(plain_time(out, "window_end"), *INEXACT, digits=6)


@query(
    """
    select user_id, cast(floor(epoch(ts) / 3600) as bigint) as hop, count(value) as value__count, round(1e-9 + avg(value), 6) as value__mean,
           round(1e-9 + var_pop(value) * count(value), 6) as value__m2, min(value) as value__min
    from events group by all
    """
)
def tiles_hourly(t):
    specs = [Aggregation("value", "std", DAY), Aggregation("value", "min", DAY)]
    return rounded(build_tiles(t.events, ["user_id"], specs, "ts", HOUR), "value__mean", "value__m2", digits=6)


@query(
    """
    with tile as (select user_id, cast(floor(epoch(ts) / 21600) as bigint) as hop, count(value) as n from events group by all),
    grid as (select user_id, unnest(range(lo, hi + 1)) as hop
             from (select distinct user_id from tile), (select min(hop) as lo, max(hop) as hi from tile))
    select user_id, hop, coalesce(n, 0) as value__count from grid left join tile using (user_id, hop)
    """
)
def tiles_dense(t):
    tiles = build_tiles(t.events, ["user_id"], [Aggregation("value", "count", DAY)], "ts", timedelta(hours=6))
    return densify(tiles, ["user_id"])


@query("select min(ts) as min_ts, max(ts) as max_ts from events")
def time_range(t):
    return ts_range(t.events, "ts")


@query(
    """
    with daily as (select user_id, date_trunc('day', ts) as ts, sum(value) as spend from events group by all)
    select user_id, max(spend) as max_spend, count(spend) as count_spend
    from (select user_id, round(1e-9 + 2 * spend, 4) as spend from daily) group by 1
    """
)
def view_over_view(t):
    """An aggregating view over a transforming view over a source."""
    days = View(
        "days", ("user_id",), ("spend",), BatchSource(frame=t.events), ts="ts",
        transform=lambda df: df.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("spend")),
    )
    doubled = View(
        "doubled", ("user_id",), ("spend",), days, mode="sql",
        transform=lambda source: f"select user_id, round(1e-9 + 2 * spend, 4) as spend from {source}",
    )
    top = View(
        "top", ("user_id",), (), doubled,
        aggregations=(Aggregation("spend", "max"), Aggregation("spend", "count")),
    )
    return top.build(t.spark)


@query(
    """
    with ends as (select distinct user_id, date_trunc('hour', ts) + interval 1 hour as window_end from events)
    select g.user_id, g.window_end, round(1e-9 + var_samp(floor(value)), 6) as var_value_86400s, round(1e-9 + stddev_samp(floor(value)), 6) as std_value_86400s
    from ends g join events e on e.user_id = g.user_id and e.ts < g.window_end and e.ts >= g.window_end - interval 1 day group by all
    """
)
def sliding_spread_of_large_values(t):
    """Variance over tiles of values far from zero: nothing cancels."""
    far = t.events.withColumn("value", F.floor("value") + F.lit(1e8))
    specs = [Aggregation("value", f, DAY) for f in ("var", "std")]
    out = aggregate_tiled(far, ["user_id"], specs, "ts", HOUR, dense=False)
    return rounded(plain_time(out, "window_end"), "var_value_86400s", "std_value_86400s", digits=6)
