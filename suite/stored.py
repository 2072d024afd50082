"""Structures that are stored and kept up to date: indexes, latest values, profiles, documents, traces, windows."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators.aggregate import Aggregation
from tidemark.operators.lineage import edges
from tidemark.operators.lineage_table import LineageTable
from tidemark.operators.profiles import StoredProfile
from tidemark.operators.quality import Check
from tidemark.operators.substring import SubstringIndex
from tidemark.operators.text_index import TextIndex
from tidemark.operators.tiles import aggregate_tiled
from tidemark.operators.timeline import TimeLine
from tidemark.operators.vector import vector_search
from tidemark.operators.vector_index import VectorIndex
from tidemark.plans.documents import DocumentTable
from tidemark.plans.views import View, stream_view
from tidemark.plans.workspace import Workspace
from tidemark.session import scratch_path, written
from tidemark.sources.read import BatchSource
from tidemark.sources.write import LatestTable
from tidemark.streaming.ingest import run_view
from tidemark.streaming.state import stream_windows, write_windows

from . import near, query
from .documents import SQL_CENTRES, SQL_MATCH, centres, sql_bm25, sql_chunk_rows, sql_nearest
from .lineage import SQL_LINKS, run_events
from .storage import LAST_VALUE
from .streams import event_stream, finish
from .timetravel import of_type, purchases, sql_asof
from .windows import plain_time, rounded

MINUTE, HOUR, DAY = timedelta(minutes=1), timedelta(hours=1), timedelta(days=1)


# -- text ------------------------------------------------------------------------


def text_index(t, **more):
    return TextIndex(scratch_path(t.spark, "postings"), "doc_id", **more)


def _ranked(index, t, match):
    out = index.bm25(t.benchmark, "item_id", "text", 5, match)
    return out.withColumn("distance", near("distance", 5))


@query(sql_bm25(""))
def bm25_stored(t):
    """Ranked search on stored postings; no text is read."""
    index = text_index(t)
    index.add(t.documents, ["text", "lang"])
    return _ranked(index, t, "any")


@query(sql_bm25("where hit = n_terms"))
def bm25_stored_all(t):
    index = text_index(t)
    index.add(t.documents, ["text", "lang"])
    return _ranked(index, t, "all")


@query(sql_bm25(""))
def bm25_added_documents(t):
    """Documents added in three parts, two of them merged; averages are those of all."""
    index = text_index(t, range_docs=64)
    for part in range(3):
        index.add(t.documents.where(F.col("doc_id") % 3 == part), ["text", "lang"])
        if part == 1:
            index.compact(t.spark)
    return _ranked(index, t, "any")


@query(
    SQL_MATCH + """
    select item_id, doc_id, rank, round(1e-9 + text_rank, 6) as text_rank from
        (select *, row_number() over (partition by item_id order by text_rank desc, doc_id) as rank from hits) where rank <= 5
    """
)
def match_all_stored(t):
    index = text_index(t)
    index.add(t.documents, ["text", "lang"])
    out = index.match_all(t.benchmark, "item_id", "text", 5)
    return out.withColumn("text_rank", near("text_rank", 6))


@query("select doc_id, source, n_chars from documents where contains(text, 'AKIA') or contains(source, 'AKIA')")
def keyword_indexed(t):
    """A keyword scan that passes over the files whose signature lacks a piece of it."""
    index = SubstringIndex(scratch_path(t.spark, "signatures"), ("text", "source"))
    index.build(t.documents, 16, "doc_id")
    return index.search(t.spark, "AKIA").select("doc_id", "source", "n_chars")


# -- vectors ---------------------------------------------------------------------


@query(sql_nearest("l2", 10))
def ivf_exact_pruned(t):
    """Exact search through lists, reading only those that can hold something nearer."""
    index = VectorIndex(scratch_path(t.spark, "vectors"), "vec_id", "embedding", "l2")
    index.build(t.embeddings, nlist=32)
    found = index.search(centres(t), "query", "centre", 10)
    return found.withColumn("distance", near("distance", 6))


@query(sql_nearest("cosine", 10))
def ivf_exact_cosine(t):
    index = VectorIndex(scratch_path(t.spark, "vectors"), "vec_id", "embedding", "cosine")
    index.build(t.embeddings, nlist=32)
    found = index.search(centres(t), "query", "centre", 10)
    return found.withColumn("distance", near("distance", 6))


@query(f"with {SQL_CENTRES} select label as query, 10 as found, true as recalled from centres")
def pq_topk(t):
    """Search by codes of 32 bytes, re-ranked: found rows per query, and whether at least nine of the ten true ones are among them."""
    index = VectorIndex(scratch_path(t.spark, "vectors"), "vec_id", "embedding", "l2")
    index.build(t.embeddings, nlist=8, parts=32)
    asked = centres(t)
    found = index.search_coded(asked, "query", "centre", 10, nprobe=8, refine=20)
    exact = vector_search(t.embeddings, asked, "vec_id", "embedding", "query", "centre", "l2")
    both = found.select("query", "vec_id").join(exact.select("query", "vec_id", F.lit(1).alias("hit")), ["query", "vec_id"], "left")
    return both.groupBy("query").agg(F.count("*").cast("int").alias("found"), (F.count("hit") >= 9).alias("recalled"))


# -- latest values ---------------------------------------------------------------


@query(LAST_VALUE.format(where=""))
def many_upserts(t):
    """Small upserts in no order of time; a read lists a bounded number of folders."""
    table = LatestTable(scratch_path(t.spark, "latest"), ("user_id",), "ts", most=4)
    rows = t.events.select("user_id", "value", "ts", F.pmod(F.xxhash64("event_id"), F.lit(12)).alias("part"))
    for part in range(12):
        table.upsert(rows.where(F.col("part") == part).drop("part"))
    state = table._pointer(t.spark).read()[1]
    if len(state.get("batches", [])) >= 4:
        raise AssertionError("the batches in force are not bounded")
    return table.read(t.spark).select("user_id", "value", "ts")


@query(
    """
    with k as (select distinct user_id from events where user_id % 50 = 0)
    select k.user_id, e.value, e.ts from k join events e using (user_id) qualify row_number() over (partition by k.user_id order by e.ts desc) = 1
    """
)
def lookup_buckets(t):
    """A lookup of some keys reads their buckets, the rest of the table stays unread."""
    table = LatestTable(scratch_path(t.spark, "latest"), ("user_id",), "ts")
    table.upsert(t.events.select("user_id", "value", "ts"))
    table.compact(t.spark)
    asked = t.events.where(F.col("user_id") % 50 == 0).select("user_id")
    return table.read_keys(asked).select("user_id", "value", "ts")


@query(LAST_VALUE.format(where="where ts between timestamp '2024-01-01' and timestamp '2024-01-15'"))
def checked_materialization(t):
    """Checks made by the run that writes the rows."""
    checks = (Check("not_null", "user_id"), Check("min_between", "value", low=-1e9))
    view = View("activity", ("user_id",), ("value",), BatchSource(frame=t.events), ts="ts", checks=checks)
    space = Workspace(t.spark, scratch_path(t.spark, "space"), [view])
    space.materialize(datetime(2024, 1, 1), datetime(2024, 1, 15))
    return space.online("activity").read(t.spark).select("user_id", "value", "ts")


@query(
    sql_asof(
        "select user_id, ts, value from events where event_type = 'click'",
        "value as click_value",
        "e.user_id = f.user_id and f.ts <= e.as_of and f.ts >= e.as_of - interval 6 hour",
    )
)
def asof_stored(t):
    """A point-in-time join against a stored time line, a later batch included."""
    line = TimeLine(scratch_path(t.spark, "timeline"), ("user_id",), "ts", ("value",), buckets=8)
    late = F.col("event_id") % 4 == 0
    line.add(of_type(t, "click").where(~late))
    line.add(of_type(t, "click").where(late))
    return line.join(purchases(t), "as_of", timedelta(hours=6), {"value": "click_value"})


# -- windows ---------------------------------------------------------------------

SPARSE_SQL = """
    with ends as (select distinct user_id, date_trunc('minute', ts) + interval 1 minute as window_end from events)
    select g.user_id, g.window_end, round(1e-9 + sum(value), 4) as sum_value_600000s, count(value) as count_value_600000s,
        min(value) as min_value_600000s, max(value) as max_value_600000s, round(1e-9 + stddev_samp(value), 4) as std_value_600000s
    from ends g join events e on e.user_id = g.user_id and e.ts < g.window_end and e.ts >= g.window_end - interval 10000 minute
    group by all
"""


@query(SPARSE_SQL)
def sliding_sparse(t):
    """Windows of 10,000 hops over a key's own tiles, without a grid."""
    specs = [Aggregation("value", f, 10_000 * MINUTE) for f in ("sum", "count", "min", "max", "std")]
    out = aggregate_tiled(t.events, ["user_id"], specs, "ts", MINUTE, dense=False)
    return rounded(plain_time(out, "window_end"), "sum_value_600000s", "std_value_600000s")


@query(
    """
    with last as (select max(date_trunc('hour', ts)) + interval 1 hour as last_end from events),
    own as (select distinct user_id, date_trunc('hour', ts) + interval 1 hour as first_end from events),
    ends as (select distinct user_id, first_end + interval (i) hour as window_end from own, (select unnest(range(0, 25)) as i), last
             where first_end + interval (i) hour <= last_end)
    select g.user_id, g.window_end, round(1e-9 + coalesce(sum(value), 0), 4) as sum_value_86400s, max(value) as max_value_86400s
    from ends g left join events e on e.user_id = g.user_id and e.ts < g.window_end and e.ts >= g.window_end - interval 1 day
    group by all
    """
)
def sliding_span(t):
    """Every hour at which a window of the key still holds a row, and the first at which none does."""
    specs = [Aggregation("value", f, DAY) for f in ("sum", "max")]
    out = aggregate_tiled(t.events, ["user_id"], specs, "ts", HOUR, dense="span")
    return rounded(plain_time(out, "window_end"), "sum_value_86400s")


STATE_SQL = """
    with h as (select distinct user_id, date_trunc('hour', ts) + interval 1 hour as window_end from events)
    select h.user_id, h.window_end, count(value) as count_value_86400s, round(1e-9 + avg(value), 4) as avg_value_86400s,
        min(value) as min_value_86400s, round(1e-9 + stddev_samp(value) filter (e.ts >= h.window_end - interval 6 hour), 4) as std_value_21600s
    from h join events e on e.user_id = h.user_id and e.ts < h.window_end and e.ts >= h.window_end - interval 1 day
    where h.window_end <= (select max(ts) - interval 1 hour from events)
    group by all
"""
STATE_SPECS = [*[Aggregation("value", f, DAY) for f in ("count", "avg", "min")], Aggregation("value", "std", 6 * HOUR)]


@query(STATE_SQL)
def stream_state_tiles(t):
    """Tiles as stream state; a window is emitted when its hop closes."""
    place = scratch_path(t.spark, "rings")
    windows = stream_windows(event_stream(t), ["user_id"], STATE_SPECS, "ts", HOUR, "1 hour")
    finish(write_windows(windows, place + "/data", place + "/checkpoint"))
    out = t.spark.read.parquet(place + "/data")
    return rounded(plain_time(out, "window_end"), "avg_value_86400s", "std_value_21600s")


@query(f"select * from ({STATE_SQL}) qualify row_number() over (partition by user_id order by window_end desc) = 1")
def stream_view_windows(t):
    """A decorated stream view with windows, fed into its online table."""

    @stream_view(
        keys=("user_id",), features=(), ts="ts", source=BatchSource(frame=t.events), stream=lambda spark: event_stream(t),
        aggregations=tuple(STATE_SPECS), hop=HOUR, watermark="1 hour",
    )
    def activity(df):
        return df.select("user_id", "value", "ts")

    space = Workspace(t.spark, scratch_path(t.spark, "stream"), [activity])
    finish(run_view(space, "activity"))
    out = space.online("activity").read(t.spark).withColumnRenamed("ts", "window_end")
    return rounded(plain_time(out, "window_end"), "avg_value_86400s", "std_value_21600s")


# -- profiles --------------------------------------------------------------------


@query(
    """
    with d as (select * from events where cast(ts as date) between date '2024-01-05' and date '2024-01-20')
    select 'value' as column_name, count(*) as row_count, count(*) - count(value) as null_count, min(value) as min_value, max(value) as max_value,
        round(1e-9 + avg(value), 6) as mean_value, true as distinct_close, true as median_close from d
    union all select 'user_id', count(*), count(*) - count(user_id), min(user_id), max(user_id), round(1e-9 + avg(user_id), 6), true, true from d
    """
)
def merged_profile(t):
    """Days' partials merged for a range; distinct counts within 3 %, medians within 1 % of the ranks."""
    stored = StoredProfile(scratch_path(t.spark, "profile"), ("value", "user_id"), "ts")
    stored.add(t.events.where(F.col("ts") < F.lit(datetime(2024, 1, 10))))
    stored.add(t.events.where(F.col("ts") >= F.lit(datetime(2024, 1, 10))))
    first, last = date(2024, 1, 5), date(2024, 1, 20)
    found = stored.merged(t.spark, first, last, (0.49, 0.51))
    inside = t.events.where(F.to_date("ts").between(F.lit(first), F.lit(last)))
    true = None
    for c in ("value", "user_id"):
        v = F.col(c).cast("double")
        part = inside.agg(F.lit(c).alias("column_name"), F.count_distinct(c).alias("d"), F.percentile(v, F.lit(0.48)).alias("lo"), F.percentile(v, F.lit(0.52)).alias("hi"))
        true = part if true is None else true.unionByName(part)
    both = found.join(true, "column_name")
    low, high = F.get("quantiles", F.lit(0)), F.get("quantiles", F.lit(1))
    return both.select(
        "column_name", "row_count", "null_count", "min_value", "max_value", near("mean_value", 6).alias("mean_value"),
        (F.abs(F.col("distinct_count") - F.col("d")) <= F.ceil(F.col("d") * 0.03)).alias("distinct_close"),
        ((low >= F.col("lo")) & (high <= F.col("hi"))).alias("median_close"),
    )


@query("select 'between' as kind, 'value' as column_name, true as success union all select 'not_null', 'value', true")
def day_against_profile(t):
    """A new day checked against the bounds of the days before it, by one scan of that day."""
    stored = StoredProfile(scratch_path(t.spark, "profile"), ("value",), "ts")
    new = F.to_date("ts") >= F.lit(date(2024, 1, 25))
    stored.add(t.events.where(~new))
    return stored.check_day(t.events.where(new), tolerance=0.05).select("kind", "column_name", "success")


# -- documents and traces --------------------------------------------------------


@query(f"select doc_id, pos, start_char, end_char, text from ({sql_chunk_rows(1000, 200)})")
def documents_updated(t):
    """A document table brought up to date: texts that changed, documents that came and went."""
    table = DocumentTable(scratch_path(t.spark, "documents"), "doc_id", "long")
    old = t.documents.where(F.col("doc_id") % 7 != 3)
    old = old.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Old. "), "text")).otherwise(F.col("text")))
    gone = t.documents.where(F.col("doc_id") % 11 == 0).withColumn("doc_id", F.col("doc_id") + 10_000_000)
    table.update(old.select("doc_id", "text").unionByName(gone.select("doc_id", "text")), "text")
    done = table.update(t.documents, "text")
    if not 0 < done["embedded"] < done["chunks"]:
        raise AssertionError("known texts were embedded again")
    return table.read(t.spark).drop("embedding")


@query(
    f"""
    with {SQL_LINKS},
    hop as (select o as node, min(j) as job, min(i) as input_dataset from links group by o),
    t1 as (select node as dataset, 1 as step, job, input_dataset from hop),
    t2 as (select t1.dataset, 2, hop.job, hop.input_dataset from t1 join hop on t1.input_dataset = hop.node),
    t3 as (select t2.dataset, 3, hop.job, hop.input_dataset from t2 join hop on t2.input_dataset = hop.node)
    select * from t1 union all select * from t2 union all select * from t3
    """
)
def lineage_kept(t):
    """Traces kept up to date while run events arrive in no order."""
    links = written(edges(run_events(t)), "links")
    table = LineageTable(scratch_path(t.spark, "traces"))
    for part in range(2):
        table.update(links.where(F.pmod(F.xxhash64("src", "dst"), F.lit(2)) == part))
    return table.trace_all(t.spark)
