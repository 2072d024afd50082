"""Data checks, profiles, statuses and column statistics."""

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators.aggregate import class_weight, column_stats, output_stats
from tidemark.operators.quality import (
    Check, check_schema, check_vector, constant_columns, json_stats, profile, profile_table, remediate, validate,
    validate_against,
    validate_log, with_status,
)
from tidemark.sources.write import feature_log

from . import near, query


def sql_row(kind, column, success, total, missing, bad, base, seen="null::double") -> str:
    percent = f"case when ({base}) > 0 then round(100.0 * ({bad}) / ({base}) + 1e-9, 4) else 0.0 end"
    return (
        f"select '{kind}' as kind, '{column}' as column_name, {success} as success, {total} as element_count, "
        f"{missing} as missing_count, {bad} as unexpected_count, {percent} as unexpected_percent, {seen} as observed_value"
    )


def sql_suite(table: str) -> str:
    n = "count(*)"

    def row(kind, col, bad, base, mostly=None, ok=None, seen="null::double"):
        missing = f"count(*) - count({col})"
        ok = ok or f"({base}) = 0 or (({base}) - ({bad})) / ({base}) >= {mostly}"
        return sql_row(kind, col, ok, n, missing, bad, base, seen) + f" from {table}"

    rows = [
        row("exists", "ts", "0", "count(ts)", ok="true"),
        row("not_null", "user_id", "count(*) - count(user_id)", "count(*)", 0.95),
        row("not_null", "rare", "count(*) - count(rare)", "count(*)", 0.95),
        row("between", "value", "count(value) filter (not (value >= 0 and value <= 100))", "count(value)", 0.99),
        row("between", "rare", "count(rare) filter (not (rare >= 5))", "count(rare)", 0.5),
        row("distinct_in_set", "event_type", "count(*) filter (event_type not in ('click', 'view'))", "count(event_type)",
            ok="count(*) filter (event_type not in ('click', 'view')) = 0"),
        row("in_set", "event_type", "count(*) filter (event_type not in ('click', 'view', 'purchase', 'error'))", "count(event_type)", 0.7),
        row("min_between", "value", "0", "count(value)", ok="min(value) >= 0 and min(value) <= 1", seen="min(value)"),
        row("max_between", "value", "0", "count(value)", ok="max(value) <= 50", seen="max(value)"),
        "select 'not_null', 'absent', false, (select count(*) from events), null, null, null, null",
    ]
    return " union all ".join(rows)


SUITE = [
    Check("exists", "ts"),
    Check("not_null", "user_id", mostly=0.95),
    Check("not_null", "rare", mostly=0.95),
    Check("between", "value", 0, 100, mostly=0.99),
    Check("between", "rare", 5, mostly=0.5),
    Check("distinct_in_set", "event_type", values=("click", "view")),
    Check("in_set", "event_type", values=("click", "view", "purchase", "error"), mostly=0.7),
    Check("min_between", "value", 0, 1),
    Check("max_between", "value", None, 50),
    Check("not_null", "absent"),
]
RARE = "(select *, case when event_type = 'error' then value end as rare from events)"


@query(sql_suite(RARE))
def dq_suite(t):
    """Ten checks in one pass, one of them over a missing column."""
    rows = t.events.withColumn("rare", F.when(F.col("event_type") == "error", F.col("value")))
    return validate(rows, SUITE).withColumn("unexpected_percent", near("unexpected_percent", 4))


@query(
    " union all ".join(
        f"""select '{c}' as column_name, count(*) as row_count, round(1e-9 + (count(*) - count({c})) / count(*), 6) as null_share,
            min({c})::double as min_value, max({c})::double as max_value, round(1e-9 + avg({c}), 4) as mean_value from lineitem"""
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    )
)
def dq_profile(t):
    out = profile_table(t.lineitem)
    return out.withColumns({"null_share": near("null_share", 6), "mean_value": near("mean_value", 4)})


@query(
    """
    with r as (select min(value) as lo, max(value) as hi, list(distinct event_type) as kinds from events where ts < timestamp '2024-01-16'),
    l as (select * from events, r where ts >= timestamp '2024-01-16')
    select 'not_null' as kind, 'event_type' as column_name, true as success, count(*) as element_count, 0 as unexpected_count from l union all
    select 'in_set', 'event_type', count(*) filter (not list_contains(kinds, event_type)) = 0, count(*), count(*) filter (not list_contains(kinds, event_type)) from l union all
    select 'not_null', 'value', true, count(*), 0 from l union all
    select 'between', 'value', count(*) filter (value < lo or value > hi) = 0, count(*), count(*) filter (value < lo or value > hi) from l
    """
)
def dq_against_profile(t):
    """A suite learnt from the first half of the month checks the second."""
    halfway = datetime(2024, 1, 16)
    columns = ["event_type", "value"]
    learnt = profile(t.events.filter(F.col("ts") < F.lit(halfway)), columns)
    out = validate(t.events.filter(F.col("ts") >= F.lit(halfway)), learnt)
    return out.select("kind", "column_name", "success", "element_count", "unexpected_count")


@query(
    " union all ".join(
        f"""select '{c}' as column_name, count(*) as row_count, count(*) - count({c}) as null_count,
            count(*) filter (json_valid({c})) as valid_count, count(*) filter (not json_valid({c})) as invalid_count from events"""
        for c in ("props", "event_type")
    )
)
def dq_json(t):
    return json_stats(t.events, ["props", "event_type"])


@query(
    """
    select 'error' as level, 'absent' as column_name, 'missing column' as message, 1 as n union all
    select 'warning', 'ts', 'expected string, found timestamp_ntz', 1 union all
    select 'error', 'event_type', 'malformed JSON', count(*) from events where not json_valid(event_type)
    """
)
def dq_schema(t):
    expected = t.spark.createDataFrame([], "event_id double, ts string, absent int, props string").schema
    return check_schema(t.events, expected, ["props", "event_type"])


@query(
    """
    select o_orderkey, user_id, value, ts as value__timestamp, case when value is null then 'NOT_FOUND' else 'PRESENT' end as value__status
    from (select o_orderkey, o_custkey as user_id from orders)
    left join (select * from events qualify row_number() over (partition by user_id order by ts desc) = 1) using (user_id)
    """
)
def dq_status(t):
    from tidemark.operators.latest import latest_per_key

    last = latest_per_key(t.events.select("user_id", "ts", "value"), ["user_id"], "ts")
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("user_id")).join(last, "user_id", "left")
    return with_status(rows, ["value"], "ts").drop("ts")


@query(
    """
    select 'not_null' as kind, 'activity__value' as column_name, count(value) / count(*) >= 0.5 as success, count(*) as element_count,
        count(*) - count(value) as missing_count, count(*) - count(value) as unexpected_count
    from (select ts, case when event_type <> 'error' then value end as value from events)
    where ts between timestamp '2024-01-08' and timestamp '2024-01-20'
    """
)
def dq_logged(t):
    """Feature log rows of a time range, checked with missing values as null."""
    rows = t.events.withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    log = feature_log(rows, "activity", ["user_id"], ["value"], "ts", "ts", "event_id")
    out = validate_log(
        log, "__log_timestamp", datetime(2024, 1, 8), datetime(2024, 1, 20), [Check("not_null", "activity__value", mostly=0.5)]
    )
    return out.select("kind", "column_name", "success", "element_count", "missing_count", "unexpected_count")


@query(
    """
    select event_id as request_id, user_id, value, ts as value_ts, case when value is null then 'NOT_FOUND' else 'PRESENT' end as status,
           cast(ts as date)::varchar as log_date
    from (select * replace (case when event_type <> 'error' then value end as value) from events)
    """
)
def feature_log_rows(t):
    rows = t.events.withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    log = feature_log(rows, "a", ["user_id"], ["value"], "ts", "ts", "event_id")
    return log.select(
        F.col("__request_id").cast("long").alias("request_id"), "user_id", F.col("a__value").alias("value"),
        F.col("a__value__timestamp").alias("value_ts"), F.col("a__value__status").alias("status"),
        F.col("__log_date").cast("string").alias("log_date"),
    )


@query(
    """
    select event_id, user_id, coalesce(case when event_type <> 'error' then value end, 0) as value from events
    """
)
def dq_remediate(t):
    rows = t.events.select("event_id", "user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return remediate(rows, ["value"])


@query("select 'same' as column_name union all select 'void' union all select 'one_day' where (select min(ts::date) = max(ts::date) from events)")
def dq_constant(t):
    """Columns that carry no information."""
    rows = t.events.select(
        "event_id", "value", F.lit(3).alias("same"), F.lit(None).cast("int").alias("void"),
        F.unix_date(F.to_date("ts")).alias("one_day"),
    )
    return constant_columns(rows)


@query(
    " union all ".join(
        f"select '{c}' as column_name, count(*) - count({c}) as null_count, count(distinct {c}) as distinct_count, count(distinct {c}) <= 1 as is_constant from orders"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    )
)
def dq_column_stats(t):
    return column_stats(t.orders)


@query("select count(*) as row_count, count(*) filter (embedding is null or len(embedding) <> 64) as bad_count from embeddings")
def dq_vector_length(t):
    return check_vector(t.embeddings, "embedding", 64)


@query("select count(*) as row_count, sum(length(text)) as size from documents")
def text_stats(t):
    return output_stats(t.documents, "text")


@query(
    """
    select count(*) filter (quality = 1) as positives, count(*) filter (quality = 0) as negatives,
        round(1e-9 + count(*) filter (quality = 0) / count(*) filter (quality = 1), 2) as pos_weight
    from labels
    """
)
def label_weight(t):
    return class_weight(t.labels, "quality")


@query(
    """
    with r as (select max(value) as top, min(value) as low from events where ts < timestamp '2024-01-15'),
    n as (select count(value) as n, count(value) filter (value between low and top) as inside from events, r)
    select 'between' as kind, 'value' as column_name, inside = n as success from n
    """
)
def dq_own_profile(t):
    """Checks that a caller's function derives from a reference, applied to all rows."""

    def extremes(df):
        low, top = df.agg(F.min("value"), F.max("value")).first()
        return [Check("between", "value", low, top)]

    found = validate_against(t.events, t.events.filter("ts < timestamp_ntz '2024-01-15'"), extremes)
    return found.select("kind", "column_name", "success")
