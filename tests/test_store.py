"""Sinks, latest-value tables, views and the workspace."""

from datetime import datetime, timedelta

import pytest
from helpers import rows, small
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.operators.aggregate import Aggregation
from tidemark.operators.project import conform
from tidemark.operators.quality import Check, ValidationError
from tidemark.plans.flows import training_set, training_set_relabelled
from tidemark.operators.asof import Side
from tidemark.plans.views import OnDemandView, Service, View, batch_view, on_demand_view, resolve
from tidemark.plans.workspace import Workspace
from tidemark.sources.read import BatchSource, infer_types, read_csv
from tidemark.sources.write import (
    LatestTable, export_parquet, feature_log, offline_append, save_dataset, write_feature_log,
)

T0 = datetime(2024, 1, 1)


def at(h):
    return T0 + timedelta(hours=h)


DDL = "k int, event_timestamp timestamp, v int"


def test_latest_table_ignores_older_and_replayed(spark, tmp_path):
    table = LatestTable(str(tmp_path / "t"), ("k",), "event_timestamp")
    table.upsert(small(spark, [(1, at(1), 10), (2, at(1), 20), (2, at(2), 21)], DDL), 0, "stream")
    second = small(spark, [(1, at(0), 99), (2, at(2), 98), (3, at(5), 30)], DDL)
    table.upsert(second, 1, "stream")
    want = [(1, 10), (2, 21), (3, 30)]
    assert rows(table.read(spark), "k", "v") == want
    table.upsert(second, 1, "stream")  # a replay
    assert spark.read.parquet(table.path).count() == 5 and rows(table.read(spark), "k", "v") == want
    table.compact(spark)
    assert table.batches(spark).count() == 3 and rows(table.read(spark), "k", "v") == want
    table.upsert(small(spark, [(1, at(9), 11)], DDL))
    assert table.batches(spark).count() == 4 and rows(table.read(spark), "k", "v") == [(1, 11), *want[1:]]
    table.compact(spark)
    assert table.batches(spark).count() == 3
    plan = table.batches(spark)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len(table.batches(spark).select("batch_writer").distinct().collect()) == 1


def test_writers_leave_each_other_alone(spark, tmp_path):
    view = View("act", ("k",), ("v",), source(spark, [(1, at(0), 1), (2, at(0), 2)]))
    space = Workspace(spark, str(tmp_path), [view])
    one = lambda k: small(spark, [(k, at(0), k)], DDL)
    space.write_view(one(3), "act", "online_and_offline", 0, "stream-a")
    space.write_view(one(4), "act", "online_and_offline", 0, "stream-b")
    space.materialize(at(0), at(1))
    space.push(["act"], one(5), "online_and_offline")
    space.push(["act"], one(6), "online_and_offline")
    assert [r[0] for r in rows(space.online("act").read(spark), "k")] == [1, 2, 3, 4, 5, 6]
    assert [r[0] for r in rows(space.offline("act"), "k")] == [3, 4, 5, 6]


def test_offline_append_checks_and_casts(spark, tmp_path):
    path = str(tmp_path / "offline")
    small(spark, [(1, 1.5)], "a long, b double").write.parquet(path)
    offline_append(small(spark, [("2.5", 2)], "b string, a int"), path, is_path=True)
    assert rows(spark.read.parquet(path), "a", "b") == [(1, 1.5), (2, 2.5)]
    with pytest.raises(ValueError, match="missing"):
        offline_append(small(spark, [(2,)], "a int"), path, is_path=True)
    spark.sql("create table target (a long, b double) using parquet")
    offline_append(small(spark, [(2.5, 2)], "b double, a int"), "target")
    assert rows(spark.table("target")) == [(2, 2.5)]


def test_conform_writes_maps_as_json(spark):
    df = spark.createDataFrame([({"x": 1},)], "m map<string,int>")
    assert conform(df, spark.createDataFrame([], "m string").schema).first()["m"] == '{"x":1}'


def test_saved_dataset_and_export(spark, tmp_path):
    df = small(spark, [(1, at(1), 10), (2, at(4), 20)], DDL)
    info = save_dataset(df, "saved", "event_timestamp", str(tmp_path / "d")).first()
    assert tuple(info) == ("saved", at(1), at(4))
    with pytest.raises(AnalysisException):
        save_dataset(df, "saved", "event_timestamp", str(tmp_path / "d"))
    save_dataset(df, "saved", "event_timestamp", str(tmp_path / "d"), allow_overwrite=True)
    files = export_parquet(df, str(tmp_path / "e")).collect()
    assert all(f["file"].endswith(".parquet") for f in files) and sum(f["rows"] for f in files) == 2


def test_feature_log_partitions(spark, tmp_path):
    df = small(spark, [(1, at(1), 10), (2, at(30), None)], DDL)
    log = feature_log(df, "v1", ["k"], ["v"], "event_timestamp", "event_timestamp", "k")
    write_feature_log(log, str(tmp_path), ["__log_date"])
    days = sorted(p.name for p in tmp_path.iterdir() if p.is_dir())
    assert days == ["__log_date=2024-01-01", "__log_date=2024-01-02"]
    back = spark.read.parquet(*[f"{tmp_path}/{d}" for d in days])
    assert rows(back, "k", "v1__v__status") == [(1, "PRESENT"), (2, "NOT_FOUND")]


def test_sources(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write("a,b\n1,x\n2,\n")
    assert rows(read_csv(spark, path)) == [(1, "x"), (2, None)]
    assert rows(BatchSource(path=path, fmt="csv", schema="a long, b string").load(spark)) == [(1, "x"), (2, None)]
    assert BatchSource(query="select 1 as one").load(spark).first()["one"] == 1
    small(spark, [(1,)], "j int").write.json(str(tmp_path / "j"))
    assert rows(BatchSource(path=str(tmp_path / "j"), fmt="json").load(spark)) == [(1,)]
    for bad in ({}, {"table": "a", "query": "b"}, {"path": "p", "fmt": "xml"}, {"table": "a", "table_format": "other"}):
        with pytest.raises(ValueError):
            BatchSource(**bad)


def test_infer_types(spark):
    df = small(
        spark,
        [("1", "1", "2024-01-01 10:00", "a", ""), (" 2 ", "1.5e3", "01/02/2024", "1", None), ("", "nan", "2024-01-01T10:00Z", "", " ")],
        "i string, f string, t string, s string, n string",
    )
    want = {"i": "INTEGER", "f": "FLOAT", "t": "TIMESTAMP", "s": "STRING", "n": "STRING"}
    assert dict(map(tuple, infer_types(df).collect())) == want


def source(spark, data):
    return BatchSource(frame=small(spark, data, DDL))


def test_incremental_materialisation(spark, tmp_path):
    data = [(1, at(h), h) for h in range(0, 100, 10)]
    view = View("act", ("k",), ("v",), source(spark, data), ttl=timedelta(hours=15))
    never = View("never", ("k",), ("v",), source(spark, data))
    space = Workspace(spark, str(tmp_path), [view, never])
    with pytest.raises(ValueError, match="after end"):
        space.materialize(at(2), at(1))
    with pytest.raises(ValueError, match="time to live"):
        space.materialize_incremental(at(50), ["never"])
    space.materialize_incremental(at(45), ["act"])
    assert rows(space.online("act").read(spark), "k", "v") == [(1, 40)]
    assert space.last_end("act") == at(45)
    space.materialize_incremental(at(75), ["act"])
    assert rows(space.online("act").read(spark), "k", "v") == [(1, 70)]


def test_push_lookup_and_offline(spark, tmp_path):
    view = View("act", ("k",), ("v",), source(spark, [(1, at(0), 0)]), ttl=timedelta(hours=2))
    total = OnDemandView("plus", ("act:v",), lambda df: df[["v"]].add(df["add"], axis=0).rename(columns={"v": "w"}), "w double")
    space = Workspace(spark, str(tmp_path), [view], [total], [Service("svc", ("act:v", "plus:w"))])
    space.push(["act"], small(spark, [(1, at(5), 7), (2, at(1), 8)], DDL), "online_and_offline")
    space.push(["act"], small(spark, [(1, at(4), 6)], DDL), "online_and_offline")
    assert space.offline("act").count() == 3
    asked = small(spark, [(1, 1.0), (1, 2.0), (2, 0.0), (9, 0.0)], "k int, add double")
    out = rows(space.lookup("svc", asked, at(6)), "k", "add", "v", "v__status", "w")
    assert out == [
        (1, 1.0, 7, "PRESENT", 8.0), (1, 2.0, 7, "PRESENT", 9.0),
        (2, 0.0, 8, "OUTSIDE_MAX_AGE", 8.0), (9, 0.0, None, "NOT_FOUND", None),
    ]
    with pytest.raises(ValueError, match="unknown target"):
        space.write_view(asked, "act", "nowhere")


def test_on_demand_materialisation(spark, tmp_path):
    view = View("act", ("k",), ("v",), source(spark, [(1, at(0), 1), (1, at(3), 4), (2, at(1), 2)]))
    double = OnDemandView("double", ("act:v",), lambda df: df.withColumn("d", F.col("v") * 2), "d int", "spark", keys=("k",))
    space = Workspace(spark, str(tmp_path), [view], [double])
    space.materialize_on_demand("double", at(0), at(10))
    assert rows(space.online("double").read(spark), "k", "d") == [(1, 8), (2, 4)]


def test_on_demand_aggregation_and_batch_python(spark):
    df = small(spark, [(1, 1.0), (1, 3.0), (2, 5.0)], "k int, v double")
    batch = on_demand_view(sources=(), outputs="w double", mode="python", aggregations=(Aggregation("w", "sum"),), group_by=("k",))(
        lambda rows: {"w": [v * 10 for v in rows["v"]]}
    )
    assert rows(batch.apply(df)) == [(1, 40.0), (2, 50.0)]
    with pytest.raises(ValueError, match="time window"):
        OnDemandView("x", (), lambda d: d, "w double", "spark", aggregations=(Aggregation("v", "sum", timedelta(1)),)).apply(df)


def test_views_over_views(spark):
    base = View("base", ("k",), ("v",), source(spark, [(1, at(0), 1), (1, at(1), 2), (2, at(0), 3)]))
    other = View("other", ("k",), ("v",), source(spark, [(1, at(0), 5)]))
    both = View("both", ("k",), ("base__v", "other__v"), (base, other), ts="base__event_timestamp")
    assert rows(both.build(spark), "k", "base__v", "other__v") == [(1, 2, 5), (2, 3, None)]

    @batch_view(name="doubled", keys=("k",), features=("v",), source=base)
    def doubled(df):
        return df.withColumn("v", F.col("v") * 2)

    assert rows(doubled.build(spark), "k", "v") == [(1, 4), (2, 6)]
    assert [v.name for v in resolve([both, doubled])] == ["base", "other", "both", "doubled"]


def test_view_cycles_are_found(spark):
    a = View("a", ("k",), (), BatchSource(table="t"))
    b = View("b", ("k",), (), a)
    object.__setattr__(a, "source", b)
    with pytest.raises(ValueError, match="cycle"):
        resolve([b])


def test_view_checks_and_filters(spark):
    src = source(spark, [(1, at(0), 1), (2, at(1), 50)])
    bad = View("bad", ("k",), ("v",), src, checks=(Check("between", "v", 0, 10),))
    with pytest.raises(ValidationError, match="between"):
        bad.build(spark)
    good = View("good", ("k",), ("v",), src, where="v < 10", checks=(Check("between", "v", 0, 10),))
    assert rows(good.build(spark), "k", "v") == [(1, 1)]


def test_partition_bounds(spark, tmp_path):
    path = str(tmp_path / "p")
    df = small(spark, [(1, at(24 * d), d) for d in range(10)], DDL).withColumn("day", F.date_format("event_timestamp", "yyyy-MM-dd"))
    df.write.partitionBy("day").parquet(path)
    schema = "k int, event_timestamp timestamp, v int, day string"
    view = View("p", ("k",), ("v",), BatchSource(path=path, partition="day", schema=schema))
    out = view.rows(spark, at(48), at(100))
    assert rows(out, "v") == [(2,), (3,), (4,)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and len(out.inputFiles()) == 10


def test_historical_argument_rules(spark):
    view = View("act", ("k",), ("v",), source(spark, [(1, at(0), 1)]))
    space = Workspace(spark, "", [view])
    entity = small(spark, [(1, at(1))], "k int, event_timestamp timestamp")
    for bad in (lambda: space.historical(["act:v"]), lambda: space.historical(["act:v"], entity, end=at(3))):
        with pytest.raises(ValueError, match="either"):
            bad()
    with pytest.raises(ValueError, match="no feature"):
        space.historical(["act:x"], entity)
    with pytest.raises(ValueError, match="unknown view"):
        space.historical(["other:x"], entity)
    with pytest.raises(ValueError, match="lacks"):
        space.historical(["act:v"], entity.drop("k"))
    entity.createOrReplaceTempView("asked")
    assert rows(space.historical(["act:v"], "select * from asked"), "k", "v") == [(1, 1)]
    assert rows(space.historical(["act:v"], end=at(3), start=at(-1)), "k", "v") == [(1, 1)]


def test_training_set_forms_agree(spark):
    feats = small(spark, [(1, at(0), 4), (2, at(0), 6)], DDL)
    entity = small(spark, [(1, at(1), 1), (2, at(1), 0), (3, at(1), 1)], "k int, event_timestamp timestamp, y int")
    args = (entity, [Side(feats, ("k",), "event_timestamp", {"v": "v"})], ["k"], "event_timestamp", "y", ["v"], {"r": ("v", "y")})
    want = [(1, 1, 4, 4.0), (2, 0, 6, 6.0), (3, 1, 0, 0.0)]
    assert rows(training_set(*args), "k", "y", "v", "r") == want
    assert rows(training_set_relabelled(*args), "k", "y", "v", "r") == want
