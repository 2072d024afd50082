"""Row-wise projections, filters, encodings and type inference."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators.aggregate import impute_median, minmax
from tidemark.operators.ml import in_test, label_encode
from tidemark.operators.project import (
    apply_field_mapping, coerce_numeric, derive_ratios, encode_fixed, filter_expr, fresh_only, jsonify_complex, project,
    split_uri, to_utc,
)
from tidemark.plans.flows import clean_and_scale, training_set
from tidemark.operators.asof import Side
from tidemark.sources.read import infer_types

from . import near, query


@query(
    """
    select l_orderkey, l_linenumber,
        round(1e-9 + l_extendedprice / case when l_quantity - 1 = 0 then 1 else l_quantity - 1 end, 6) as price_per_other,
        round(1e-9 + l_tax / case when l_discount = 0 then 1 else l_discount end, 6) as tax_per_discount
    from lineitem
    """
)
def ratios(t):
    """Divisors that can be zero."""
    rows = t.lineitem.withColumn("others", F.col("l_quantity") - 1)
    out = derive_ratios(
        rows, {"price_per_other": ("l_extendedprice", "others"), "tax_per_discount": ("l_tax", "l_discount")}
    )
    return out.select(
        "l_orderkey", "l_linenumber", *[near(c, 6).alias(c) for c in ("price_per_other", "tax_per_discount")]
    )


@query(
    """
    select o_orderkey, case o_orderstatus when 'O' then 1.0 when 'P' then 2.0 else 0.0 end as o_orderstatus,
        case o_orderpriority when '1-URGENT' then 3.0 when '2-HIGH' then 2.0 when '3-MEDIUM' then 1.0 else 0.0 end as o_orderpriority,
        o_totalprice
    from orders
    """
)
def encode_known(t):
    codes = {
        "o_orderstatus": {"F": 0, "O": 1, "P": 2},
        "o_orderpriority": {"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 1},
    }
    out = encode_fixed(t.orders, codes, ["o_totalprice"])
    return out.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


@query(
    """
    select o_orderkey, dense_rank() over (order by o_orderpriority) - 1 as o_orderpriority,
        dense_rank() over (order by o_orderstatus) - 1 as o_orderstatus
    from orders
    """
)
def encode_labels(t):
    out = label_encode(t.orders, ["o_orderpriority", "o_orderstatus"])
    return out.select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("select c_custkey, dense_rank() over (order by c_name) - 1 as code from customer")
def encode_many_labels(t):
    """A category per row."""
    return label_encode(t.customer, ["c_name"], "_code").select("c_custkey", F.col("c_name_code").alias("code"))


@query(
    """
    with m as (select c_custkey, case when c_mktsegment <> 'HOUSEHOLD' then c_acctbal end as c_acctbal, c_nationkey from customer),
    f as (select c_custkey, coalesce(c_acctbal, (select median(c_acctbal) from m)) as c_acctbal, c_nationkey from m)
    select c_custkey, round(1e-9 + (c_acctbal - min(c_acctbal) over ()) / (max(c_acctbal) over () - min(c_acctbal) over ()), 6) as c_acctbal,
        round(1e-9 + (c_nationkey - min(c_nationkey) over ()) / (max(c_nationkey) over () - min(c_nationkey) over ()), 6) as c_nationkey
    from f
    """
)
def impute_and_scale(t):
    """Median fill, then scaling to [0, 1]."""
    known = F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_acctbal"))
    filled = impute_median(t.customer.withColumn("c_acctbal", known), ["c_acctbal"])
    out = minmax(filled, ["c_acctbal", "c_nationkey"])
    return out.select("c_custkey", *[near(c, 6).alias(c) for c in ("c_acctbal", "c_nationkey")])


@query(
    """
    with raw as (select o_custkey, o_orderdate, case when o_orderstatus = 'P' then null else o_totalprice end as o_totalprice,
                        o_orderkey, 7 as same, o_orderstatus = 'F' as done,
                        row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders),
    one as (select * from raw where rn = 1),
    f as (select *, coalesce(o_totalprice, (select median(o_totalprice) from one)) as price from one)
    select o_custkey, o_orderdate, cast(done as int) as done, 0.0 as same,
        round(1e-9 + (price - min(price) over ()) / (max(price) over () - min(price) over ()), 6) as o_totalprice
    from f
    """
)
def clean_first_orders(t):
    """Duplicates, bad numbers, missing values, a constant column."""
    raw = t.orders.select(
        "o_custkey", "o_orderdate", "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.lit("7").alias("same"), (F.col("o_orderstatus") == "F").alias("done"),
    )
    out = clean_and_scale(raw, "o_custkey", "o_orderdate", ["o_totalprice", "same"], "done", tie=["o_orderkey"])
    return out.select(
        "o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "done", "same",
        near("o_totalprice", 6).alias("o_totalprice"),
    )


@query(
    """
    with e as (select event_id, user_id, ts, value as label from events where event_type = 'purchase'),
    j as (select e.*, c.value as clicks, v.value as views from e
        left join lateral (select value from events f where event_type = 'click' and f.user_id = e.user_id
            and f.ts <= e.ts and f.ts >= e.ts - interval 6 hour order by ts desc limit 1) c on true
        left join lateral (select value from events f where event_type = 'view' and f.user_id = e.user_id
            and f.ts <= e.ts and f.ts >= e.ts - interval 6 hour order by ts desc limit 1) v on true)
    select event_id, user_id, ts, label, coalesce(clicks, 0) as clicks, coalesce(views, 0) as views,
        round(1e-9 + coalesce(clicks, 0) / case when coalesce(views, 0) = 0 then 1 else views end, 6) as clicks_per_view
    from j
    """
)
def training_rows(t):
    """Point-in-time features with label, null repair and a derived ratio."""
    entity = t.events.filter("event_type = 'purchase'").withColumnRenamed("value", "label")
    sides = [
        Side(t.events.filter(F.col("event_type") == kind), ("user_id",), "ts", {"value": name}, timedelta(hours=6))
        for kind, name in (("click", "clicks"), ("view", "views"))
    ]
    out = training_set(
        entity, sides, ["event_id", "user_id"], "ts", "label", ["clicks", "views"], {"clicks_per_view": ("clicks", "views")}
    )
    return out.withColumn("clicks_per_view", near("clicks_per_view", 6))


@query(
    """
    select page_id,
        case when regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') then lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) else 'file' end as namespace,
        coalesce(nullif(trim(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*:', ''), '[?#].*$', ''), '/'), ''), 'unknown') as name
    from pages
    """
)
def split_dataset_uri(t):
    return split_uri(t.pages, "url").select("page_id", "namespace", "name")


@query(
    """
    select * from (values ('o_orderkey', 'INTEGER'), ('o_totalprice', 'FLOAT'), ('o_orderdate', 'TIMESTAMP'),
        ('o_orderstatus', 'STRING'), ('blank', 'STRING'),
        ('mixed', (select case when count(*) > 0 then 'FLOAT' else 'STRING' end from orders))) v(name, type)
    """
)
def infer_column_types(t):
    text = t.orders.select(
        *[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")],
        F.lit("  ").alias("blank"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("")).otherwise(F.col("o_totalprice").cast("string")).alias("mixed"),
    )
    return infer_types(text)


@query(
    """
    select page_id, try_cast(regexp_extract(url, '/([0-9]+)', 1) as double) as number,
        try_cast(nullif(regexp_extract(url, '//([^/]*)', 1), '') as double) as host_number
    from pages
    """
)
def numbers_from_text(t):
    """Text that is no number becomes null."""
    parts = t.pages.select(
        "page_id", F.regexp_extract("url", "/([0-9]+)", 1).alias("number"), F.regexp_extract("url", "//([^/]*)", 1).alias("host_number")
    )
    return coerce_numeric(parts, ["number", "host_number"])


@query(
    """
    select event_id, ts, ts - interval 1 hour as paris_ts from events
    """
)
def times_to_utc(t):
    """Text without a zone means UTC; another zone is converted."""
    text = t.events.select("event_id", F.col("ts").cast("string").alias("ts"), F.col("ts").cast("string").alias("paris_ts"))
    out = to_utc(to_utc(text, "ts"), "paris_ts", "Europe/Paris")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "paris_ts")})


@query("select user_id, ts, value as activity__value, event_type as activity__kind from events where ts >= timestamp '2024-01-30' - interval 36 hour and value > 10")
def recent_features(t):
    """Field mapping, freshness against a given now, a filter and full names."""
    rows = apply_field_mapping(t.events, {"event_type": "kind"})
    rows = filter_expr(fresh_only(rows, "ts", timedelta(hours=36), datetime(2024, 1, 30)), "value > 10")
    return project(rows, ["activity:value", "activity:kind"], full_names=True, keep=["user_id", "ts"])


@query(
    """
    select event_id, '{"user":' || user_id || ',"kind":"' || event_type || '"}' as who,
           '{"' || event_type || '":' || user_id || '}' as tally
    from events
    """
)
def structs_to_json(t):
    rows = t.events.select(
        "event_id",
        F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("who"),
        F.create_map("event_type", "user_id").alias("tally"),
    )
    target = t.spark.createDataFrame([], "event_id long, who string, tally string").schema
    return jsonify_complex(rows, target)


@query(
    """
    select doc_id, quality, cast(concat('0x', substr(md5('42:' || doc_id), 1, 8)) as bigint) % 10000 < 2000 as is_test from labels
    """
)
def split_rows(t):
    """Which rows a 20 % test split holds."""
    return t.labels.select("doc_id", "quality", in_test("doc_id").alias("is_test"))
