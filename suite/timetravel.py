"""Point-in-time retrieval and latest values."""

from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators.aggregate import Aggregation
from tidemark.operators.asof import Side, asof_join, entityless_join
from tidemark.operators.joins import attach_label, join_aggregates, join_views, lookup
from tidemark.operators.latest import first_per_key, latest_per_key, pull_latest
from tidemark.operators.quality import Check, ValidationError
from tidemark.plans.views import OnDemandView, View, batch_view, on_demand_view
from tidemark.plans.workspace import Workspace, aliased
from tidemark.session import scratch_path
from tidemark.sources.read import BatchSource
from tidemark.sources.write import upsert_latest

from . import near, query

START, END = datetime(2024, 1, 8), datetime(2024, 1, 20)


def purchases(t):
    return t.events.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("as_of"))


def of_type(t, kind):
    return t.events.filter(F.col("event_type") == kind)


def sql_asof(features: str, outputs: str, on: str, order: str = "f.ts desc", entity: str | None = None) -> str:
    """Range join + row_number form, independent of the operator's plan."""
    entity = entity or "select event_id, user_id, ts as as_of from events where event_type = 'purchase'"
    return f"""
        with e as ({entity}), f as ({features}),
        j as (select e.*, f.* exclude (user_id),
                     row_number() over (partition by e.event_id order by {order}) as rn
              from e left join f on {on})
        select event_id, user_id, as_of, {outputs} from j where rn = 1
    """


@query(
    sql_asof(
        "select user_id, ts, value from events where event_type = 'click'",
        "value as click_value, ts as click_ts",
        "e.user_id = f.user_id and f.ts <= e.as_of and f.ts >= e.as_of - interval 6 hour",
    )
)
def asof_ttl(t):
    side = Side(of_type(t, "click"), ("user_id",), "ts", {"value": "click_value"}, timedelta(hours=6), ts_as="click_ts")
    return asof_join(purchases(t), side, "as_of")


@query(
    sql_asof(
        "select user_id, ts, value, props from events where event_type <> 'purchase'",
        "value as last_value, props as last_props",
        "e.user_id = f.user_id and f.ts <= e.as_of",
    )
)
def asof_no_ttl(t):
    rest = t.events.filter("event_type <> 'purchase'")
    return asof_join(purchases(t), Side(rest, ("user_id",), "ts", {"value": "last_value", "props": "last_props"}), "as_of")


BACKFILLED = """
    select user_id, date_trunc('day', ts) as ts, ts as created, value
    from events where event_type <> 'purchase'
"""


@query(
    sql_asof(
        BACKFILLED,
        "value as day_value",
        "e.user_id = f.user_id and f.ts <= e.as_of and f.ts >= e.as_of - interval 3 day",
        "f.ts desc, f.created desc",
    )
)
def asof_created(t):
    """Many rows share an event time; the one created last wins."""
    rows = t.events.filter("event_type <> 'purchase'").select(
        "user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), F.col("ts").alias("created"), "value"
    )
    side = Side(rows, ("user_id",), "ts", {"value": "day_value"}, timedelta(days=3), created="created")
    return asof_join(purchases(t), side, "as_of")


@query(
    """
    with e as (select event_id, user_id, ts as as_of from events where event_type = 'purchase')
    select e.*, c.value as click__value, v.value as view__value, r.value as error__value
    from e
    left join lateral (select value from events f where f.event_type = 'click' and f.user_id = e.user_id
        and f.ts <= e.as_of and f.ts >= e.as_of - interval 12 hour order by ts desc limit 1) c on true
    left join lateral (select value from events f where f.event_type = 'view' and f.user_id = e.user_id
        and f.ts <= e.as_of and f.ts >= e.as_of - interval 2 day order by ts desc limit 1) v on true
    left join lateral (select value from events f where f.event_type = 'error' and f.user_id = e.user_id
        and f.ts <= e.as_of order by ts desc limit 1) r on true
    """
)
def asof_multi_view(t):
    """Three views on the same keys share one shuffle and one sort."""
    ttl = {"click": timedelta(hours=12), "view": timedelta(days=2), "error": timedelta(0)}
    views = [
        View(k, ("user_id",), ("value",), BatchSource(frame=of_type(t, k)), ts="ts", ttl=ttl[k]) for k in ttl
    ]
    space = Workspace(t.spark, "", views)
    return space.historical([f"{k}:value" for k in ttl], purchases(t), full_names=True)


@query(
    """
    with e as (select event_id, user_id, ts as as_of from events where event_type = 'purchase'),
    d as (select date_trunc('day', ts) + interval 1 day as ts, count(*) as n, sum(value) as v from events group by 1)
    select e.*, d.n as day_events, round(1e-9 + d.v, 4) as day_value
    from e left join lateral (select * from d where d.ts <= e.as_of and d.ts >= e.as_of - interval 1 day
                              order by d.ts desc limit 1) d on true
    """
)
def asof_global(t):
    """Features without an entity key."""
    days = t.events.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    days = days.select(F.col("w.end").cast("timestamp_ntz").alias("ts"), "n", near("v", 4).alias("v"))
    side = Side(days, (), "ts", {"n": "day_events", "v": "day_value"}, timedelta(days=1))
    return asof_join(purchases(t), side, "as_of")


@query(ORACLE_SLICED := sql_asof(
    "select user_id, ts, value from events where event_type <> 'purchase'",
    "value as last_value",
    "e.user_id = f.user_id and f.ts <= e.as_of and f.ts >= e.as_of - interval 1 day",
))
def asof_hot_keys(t):
    """Key slicing switched on: busy users are cut into time slices."""
    rest = t.events.filter("event_type <> 'purchase'")
    side = Side(rest, ("user_id",), "ts", {"value": "last_value"}, timedelta(days=1))
    return asof_join(purchases(t), side, "as_of", strategy="window", slices=64)


@query(ORACLE_SLICED)
def asof_broadcast(t):
    """A feature side below the broadcast limit is looked up without a shuffle."""
    rest = t.events.filter("event_type <> 'purchase'")
    side = Side(rest, ("user_id",), "ts", {"value": "last_value"}, timedelta(days=1))
    return asof_join(purchases(t), side, "as_of", strategy="broadcast")


@query(
    """
    with e as (select l_orderkey, l_linenumber, l_partkey, o_orderdate as as_of
               from lineitem join orders on l_orderkey = o_orderkey),
    f as (select l_partkey, l_shipdate as ts, l_orderkey * 10 + l_linenumber as tie, l_extendedprice as last_price
          from lineitem),
    best as (select l_partkey, ts, arg_max(last_price, tie) as last_price from f group by all)
    select e.l_orderkey, e.l_linenumber, e.l_partkey, e.as_of, b.last_price
    from e asof left join best b on e.l_partkey = b.l_partkey and e.as_of >= b.ts
    """
)
def asof_part_price(t):
    """Last shipped price of a part when it is ordered again."""
    lines, orders = t.lineitem, t.orders
    entity = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("o_orderdate").alias("as_of")
    )
    prices = lines.select(
        "l_partkey",
        F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"),
        F.col("l_extendedprice").alias("last_price"),
    )
    return asof_join(entity, Side(prices, ("l_partkey",), "ts", {"last_price": "last_price"}, tie="tie"), "as_of")


@query(
    """
    with s as (select s_suppkey, s_nationkey from supplier), c as (select c_custkey, c_nationkey from customer),
    e as (select l_orderkey, l_linenumber, s_nationkey as seller, c_nationkey as buyer, l_shipdate as as_of
          from lineitem join orders on l_orderkey = o_orderkey join s on l_suppkey = s_suppkey join c on o_custkey = c_custkey),
    f as (select c_nationkey as nation, o_orderdate as ts, max(o_totalprice) as top
          from orders join c on o_custkey = c_custkey group by all)
    select e.*, a.top as seller__top, b.top as buyer__top
    from e asof left join f a on e.seller = a.nation and e.as_of >= a.ts
           asof left join f b on e.buyer = b.nation and e.as_of >= b.ts
    """
)
def asof_alias(t):
    """One view joined twice under two names and entity columns."""
    lines, orders = t.lineitem, t.orders
    home = t.customer.select("c_custkey", "c_nationkey")
    sold = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(home, F.col("o_custkey") == F.col("c_custkey"))
    )
    entity = sold.select(
        "l_orderkey", "l_linenumber", F.col("s_nationkey").alias("seller"), F.col("c_nationkey").alias("buyer"),
        F.col("l_shipdate").alias("as_of"),
    )
    tops = (
        orders.join(home, orders.o_custkey == home.c_custkey)
        .groupBy(F.col("c_nationkey").alias("nation"), F.col("o_orderdate").alias("ts"))
        .agg(F.max("o_totalprice").alias("top"))
    )
    base = View("nation_orders", ("nation",), ("top",), BatchSource(frame=tops), ts="ts")
    roles = [aliased(base, r, {"nation": r}) for r in ("seller", "buyer")]
    return Workspace(t.spark, "", roles).historical(["seller:top", "buyer:top"], entity, full_names=True)


ODFV_SQL = sql_asof(
    "select user_id, ts, value from events where event_type = 'click'",
    "value as click_value, round(1e-9 + coalesce(value, 0) * 2 + event_id % 10, 6) as boosted",
    "e.user_id = f.user_id and f.ts <= e.as_of and f.ts >= e.as_of - interval 1 day",
)


def _on_demand(t, mode, fn, singleton=False):
    clicks = of_type(t, "click").withColumnRenamed("value", "click_value")
    view = View("clicks", ("user_id",), ("click_value",), BatchSource(frame=clicks), ts="ts", ttl=timedelta(days=1))
    boost = OnDemandView("boost", ("clicks:click_value",), fn, "boosted double", mode, singleton)
    space = Workspace(t.spark, "", [view], [boost])
    return space.historical(["clicks:click_value", "boost:boosted"], purchases(t))


@query(ODFV_SQL)
def on_demand_pandas(t):
    """A pandas function over retrieved features and request columns."""

    def boost(df):
        return (df["click_value"].fillna(0) * 2 + df["event_id"] % 10).round(6).to_frame("boosted")

    return _on_demand(t, "pandas", boost)


@query(ODFV_SQL)
def on_demand_python(t):
    def boost(row):
        value = row["click_value"]
        value = 0.0 if value is None or value != value else value
        return {"boosted": round(1e-9 + value * 2 + row["event_id"] % 10, 6)}

    return _on_demand(t, "python", boost, singleton=True)


@query(ODFV_SQL)
def on_demand_columns(t):
    """The same as column expressions, which stay in the JVM."""
    return _on_demand(
        t,
        "spark",
        lambda df: df.withColumn(
            "boosted", near(F.coalesce("click_value", F.lit(0.0)) * 2 + F.col("event_id") % 10, 6)
        ),
    )


def _two_sides(t):
    return [
        Side(of_type(t, "click"), ("user_id",), "ts", {"value": "click_value"}, timedelta(days=3)),
        Side(of_type(t, "view"), ("user_id",), "ts", {"value": "view_value"}, timedelta(days=1)),
    ]


@query(
    """
    with k as (select distinct user_id, timestamp '2024-01-20 00:00:00' as entity_ts from events
               where event_type in ('click', 'view') and ts between timestamp '2024-01-08' and timestamp '2024-01-20')
    select k.*, c.value as click_value, v.value as view_value from k
    left join lateral (select value from events f where event_type = 'click' and f.user_id = k.user_id
        and f.ts <= k.entity_ts and f.ts >= k.entity_ts - interval 3 day order by ts desc limit 1) c on true
    left join lateral (select value from events f where event_type = 'view' and f.user_id = k.user_id
        and f.ts <= k.entity_ts and f.ts >= k.entity_ts - interval 1 day order by ts desc limit 1) v on true
    """
)
def entityless_end(t):
    return entityless_join(_two_sides(t), END, START)


@query(
    """
    with d as (select * from events where ts between timestamp '2024-01-08' and timestamp '2024-01-20'),
    k as (select distinct user_id, ts as entity_ts from d where event_type in ('click', 'view'))
    select k.*, c.value as click_value, v.value as view_value from k
    left join lateral (select value from d f where event_type = 'click' and f.user_id = k.user_id
        and f.ts <= k.entity_ts and f.ts >= k.entity_ts - interval 3 day order by ts desc limit 1) c on true
    left join lateral (select value from d f where event_type = 'view' and f.user_id = k.user_id
        and f.ts <= k.entity_ts and f.ts >= k.entity_ts - interval 1 day order by ts desc limit 1) v on true
    """
)
def entityless_all(t):
    return entityless_join(_two_sides(t), END, START, mode="all_timestamps")


LATEST = "select event_id, user_id, event_type, ts, value from (select *, row_number() over (partition by {keys} order by {order}) rn from events {where}) where rn = 1"
LATEST_COLS = ("event_id", "user_id", "event_type", "ts", "value")


@query(LATEST.format(keys="user_id", order="ts desc", where=""))
def latest_per_user(t):
    return latest_per_key(t.events.select(*LATEST_COLS), ["user_id"], "ts")


@query(LATEST.format(keys="user_id", order="ts", where=""))
def first_per_user(t):
    return first_per_key(t.events.select(*LATEST_COLS), ["user_id"], "ts")


@query(LATEST.format(
    keys="user_id, event_type", order="ts desc",
    where="where ts between timestamp '2024-01-08' and timestamp '2024-01-20'",
))
def latest_in_range(t):
    return pull_latest(
        t.events, ["user_id", "event_type"], "ts", ["event_id", "value"], start=START, end=END
    ).select(*LATEST_COLS)


@query("select event_id, user_id, event_type, ts, value from events order by ts desc, event_id desc limit 1")
def latest_overall(t):
    """Latest row of a source without keys."""
    return latest_per_key(t.events.select(*LATEST_COLS), [], "ts", tie=["event_id"])


@query(
    """
    select o_custkey, o_orderdate, o_orderkey, o_totalprice from (
        select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders)
    where rn = 1
    """
)
def latest_order(t):
    """Orders share dates; the larger key was written later."""
    return latest_per_key(t.orders, ["o_custkey"], "o_orderdate", created="o_orderkey").select(
        "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"
    )


@query(
    """
    with l as (select user_id, ts, value, case when event_type = 'error' then value end as error_value
               from (select *, row_number() over (partition by user_id order by ts desc) rn from events) where rn = 1),
    j as (select o_orderkey, o_custkey as user_id, l.* exclude (user_id) from orders left join l on o_custkey = l.user_id)
    select o_orderkey, user_id, value, ts,
        case when value is null then 'NOT_FOUND'
             when epoch(timestamp '2024-01-31') - floor(epoch(ts)) > 86400 then 'OUTSIDE_MAX_AGE' else 'PRESENT' end as value__status,
        error_value,
        case when error_value is null then 'NOT_FOUND'
             when epoch(timestamp '2024-01-31') - floor(epoch(ts)) > 86400 then 'OUTSIDE_MAX_AGE' else 'PRESENT' end as error_value__status
    from j
    """
)
def lookup_status(t):
    """A batch of keys, many repeated and many unknown."""
    rows = t.events.withColumn("error_value", F.when(F.col("event_type") == "error", F.col("value")))
    latest = latest_per_key(rows.select("user_id", "ts", "value", "error_value"), ["user_id"], "ts")
    asked = t.orders.select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return lookup(latest, asked, ["user_id"], ["value", "error_value"], "ts", datetime(2024, 1, 31), timedelta(days=1))


@query(
    """
    with d as (select event_id, user_id, event_type, date_trunc('day', ts) as ts, value from events),
    s as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from d
          where event_type in ('click', 'view', 'purchase')),
    b as (select event_id, user_id, event_type, ts, value, 0 as new from s where rn = 1 union all
          select event_id, user_id, event_type, ts, value, 1 from d where event_type not in ('click', 'view', 'purchase'))
    select event_id, user_id, event_type, ts, value
    from (select *, row_number() over (partition by user_id order by ts desc, new, event_id desc) rn from b) where rn = 1
    """
)
def upsert_newer(t):
    """An update only wins with a strictly newer event time."""
    days = t.events.select(
        "event_id", "user_id", "event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), "value"
    )
    first = F.col("event_type").isin("click", "view", "purchase")
    stored = latest_per_key(days.filter(first), ["user_id"], "ts", "event_id")
    return upsert_latest(stored, days.filter(~first), ["user_id"], "ts", "event_id")


@query(
    """
    with w as (select user_id, value, row_number() over (partition by user_id order by ts desc) rn from events
          where ts between timestamp '2024-01-08' and timestamp '2024-01-20')
    select user_id, value from w where rn = 1
    """
)
def materialized_view(t):
    """A range materialised into an online table, read back."""
    events = View("activity", ("user_id",), ("value",), BatchSource(frame=t.events.select("user_id", "ts", "value")), ts="ts")
    space = Workspace(t.spark, scratch_path(t.spark, "online"), [events])
    space.materialize(START, END)
    return space.online("activity").read(t.spark).select("user_id", "value")


@query(
    """
    with a as (select user_id, sum(value) as total from events where event_type = 'click' group by 1),
    b as (select user_id, count(*) as n from events where event_type = 'error' group by 1)
    select a.user_id, round(1e-9 + a.total, 4) as clicks__total, b.n as errors__n from a left join b on a.user_id = b.user_id
    """
)
def joined_views(t):
    clicks = of_type(t, "click").groupBy("user_id").agg(near(F.sum("value"), 4).alias("total"))
    errors = of_type(t, "error").groupBy("user_id").agg(F.count("*").alias("n"))
    return join_views({"clicks": clicks, "errors": errors}, ["user_id"])


@query(
    """
    select o_orderkey, o_custkey, n, round(1e-9 + total, 4) as total
    from orders left join (select user_id, count(*) as n, sum(value) as total from events group by 1) on o_custkey = user_id
    """
)
def joined_aggregates(t):
    totals = t.events.groupBy(F.col("user_id").alias("o_custkey")).agg(
        F.count("*").alias("n"), near(F.sum("value"), 4).alias("total")
    )
    return join_aggregates(t.orders.select("o_orderkey", "o_custkey"), totals, ["o_custkey"])


@query(
    """
    select e.event_id, e.user_id, e.ts, e.value, l.quality
    from events e left join (select doc_id as event_id, quality from labels) l using (event_id)
    """
)
def labelled_events(t):
    """The label of a row comes back on key and time."""
    events = t.events.select("event_id", "user_id", "ts", "value")
    labels = t.labels.select(F.col("doc_id").alias("event_id"), "quality").join(events.select("event_id", "ts"), "event_id")
    return attach_label(events, labels, ["event_id"], "ts", "quality")


@query(
    """
    select event_id, case when event_id % 3 = 0 then null else 9007199254740993 + event_id end as wide,
        case when event_id % 4 = 0 then 'NaN'::double when event_id % 4 = 1 then null else value end as rough,
        round(1e-9 + value + 1, 6) as boosted
    from events
    """
)
def on_demand_exact(t):
    """A pandas function reads its declared input; long ids, nulls and NaN beside it stay as they are."""
    e = F.col("event_id")
    rows = t.events.select(
        "event_id",
        F.when(e % 3 != 0, F.lit(9007199254740993) + e).alias("wide"),
        F.when(e % 4 == 0, F.lit(float("nan"))).when(e % 4 != 1, F.col("value")).alias("rough"),
        "value",
        "props",
    )
    view = OnDemandView("boost", (), lambda df: (df["value"] + 1).to_frame("boosted"), "boosted double", inputs=("value",))
    out = view.apply(rows).select("event_id", "wide", "rough", near("boosted", 6).alias("boosted"))
    if "props" in out._jdf.queryExecution().executedPlan().toString():
        raise AssertionError("an unused column is read")
    return out


@query(
    sql_asof(
        "select user_id, day + interval 1 day as ts, total, n from (select user_id, date_trunc('day', ts) as day, "
        "round(1e-9 + sum(value), 4) as total, count(value) as n from events group by all)",
        "total as sum_value_86400s, n as count_value_86400s",
        "e.user_id = f.user_id and f.ts <= e.as_of and f.ts >= e.as_of - interval 3 day",
    )
)
def historical_aggregate_view(t):
    """Daily aggregates of a view as of each purchase: the last finished day within three."""
    day = timedelta(days=1)
    specs = (Aggregation("value", "sum", day), Aggregation("value", "count", day))
    view = View("daily", ("user_id",), (), BatchSource(frame=t.events), ts="ts", ttl=3 * day, aggregations=specs)
    space = Workspace(t.spark, "", [view])
    out = space.historical(["daily:sum_value_86400s", "daily:count_value_86400s"], purchases(t))
    return out.withColumn("sum_value_86400s", near("sum_value_86400s", 4))


@query("select user_id, count(*) as count_value, true as refused from events group by 1")
def view_checks_after_aggregate(t):
    """Checks see the aggregated rows; one that fails stops the build."""
    specs = (Aggregation("value", "count", name="count_value"),)
    view = View("totals", ("user_id",), (), BatchSource(frame=t.events.fillna(0.0, ["value"])), ts="ts", aggregations=specs)
    good = replace(view, checks=(Check("between", "count_value", 1, 10**9),)).build(t.spark)
    refused = False
    try:
        replace(view, checks=(Check("between", "count_value", 0, 0),)).build(t.spark)
    except ValidationError:
        refused = True
    return good.withColumn("refused", F.lit(refused))


@query(
    """
    with w as (select user_id, value * 2 as value from events qualify row_number() over (partition by user_id order by ts desc) = 1)
    select user_id, round(1e-9 + value, 6) as value, round(1e-9 + value + 1, 6) as more from w
    """
)
def decorated_views(t):
    """Views made from functions by decorators."""

    @batch_view(keys=("user_id",), features=("value",), source=BatchSource(frame=t.events), ts="ts")
    def doubled(df):
        return df.withColumn("value", F.col("value") * 2)

    @on_demand_view(sources=("doubled:value",), outputs="more double", inputs=("value",))
    def plus(df):
        return (df["value"] + 1).to_frame("more")

    if (doubled.name, plus.name) != ("doubled", "plus"):
        raise AssertionError("a decorated view has another name")
    out = plus.apply(doubled.build(t.spark))
    return out.select("user_id", near("value", 6).alias("value"), near("more", 6).alias("more"))
