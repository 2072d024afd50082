"""Paths for inputs beyond one task give the same answers; plans stay clean."""

import random
import statistics

import pytest
from helpers import rows
from pyspark.sql import functions as F

import suite
from tidemark.operators import aggregate
from tidemark.operators.aggregate import column_stats, exact_medians, medians
from tidemark.operators.docs import chunk, number_chunks
from tidemark.operators.ml import label_encode, roc_auc
from tidemark.operators.quality import constant_columns
from tidemark.operators.skew import hot_keys, running_totals

suite.load_all()
FOLDER = "/root/testdata/sf0.001"


def test_running_totals(spark, always_big):
    values = list(range(500))
    random.Random(3).shuffle(values)
    df = spark.createDataFrame([(v, v % 7) for v in values], "v int, n int").repartition(5)
    out = {r["v"]: r["total"] for r in running_totals(df, [F.col("v")], {"total": F.col("n")}).collect()}
    total = 0
    for v in range(500):
        total += v % 7
        assert out[v] == total


def test_hot_keys(spark):
    df = spark.createDataFrame([(0 if i % 3 == 0 else i,) for i in range(900)] + [(None,)] * 500, "k int")
    found, n = hot_keys(df, ["k"], 10, 0)
    assert found == [(0,)] and n == 300


@pytest.mark.parametrize(
    "values",
    [
        list(range(1001)),
        [random.Random(5).gauss(0, 1) for _ in range(2000)],
        [1.0] * 700 + [2.0] * 700,
        [5.0] * 900 + list(map(float, range(300))),
        [3.0],
        [1.0, 2.0],
        [7.0] * 50,
        [],
    ],
)
def test_exact_medians(spark, values):
    df = spark.createDataFrame([(v, -v) for v in map(float, values)], "a double, b double").union(
        spark.createDataFrame([(None, None)], "a double, b double")
    )
    got = exact_medians(df, ["a", "b"], bracket_rows=20)
    if not values:
        assert got == {"a": None, "b": None}
    else:
        assert got["a"] == pytest.approx(statistics.median(values))
        assert got["b"] == pytest.approx(-statistics.median(values))


def test_medians_big_path(spark, always_big):
    df = spark.createDataFrame([(float(v),) for v in range(100)], "a double")
    assert medians(df, ["a"]).first()["a"] == 49.5


def test_column_stats_big_path(spark, always_big):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "y"), (1, 3, None)], "a int, b int, c string")
    want = [("a", 0, 1, True), ("b", 2, 1, True), ("c", 1, 2, False)]
    assert rows(column_stats(df), "column_name", "null_count", "distinct_count", "is_constant") == want
    assert rows(constant_columns(df)) == [("a",), ("b",)]


def test_label_codes_big_path(spark, always_big):
    df = spark.createDataFrame([(c,) for c in "banana"], "c string")
    assert rows(label_encode(df, ["c"])) == [(0,), (0,), (0,), (1,), (2,), (2,)]


def test_auc_big_path(spark, always_big):
    rnd = random.Random(8)
    data = [(rnd.randint(0, 20) / 20, int(rnd.random() < 0.4)) for _ in range(400)]
    df = spark.createDataFrame(data, "s double, y int")
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert roc_auc(df, "s", "y").first()["roc_auc"] == pytest.approx(wins / len(pos) / len(neg))


def test_chunk_numbers_big_path(spark, always_big):
    docs = spark.createDataFrame([(i, "word " * (50 * (i % 4))) for i in range(30)], "d int, text string")
    out = number_chunks(chunk(docs, "text", 100, 10), "d").orderBy("d", "pos").collect()
    assert [r["chunk_id"] for r in out] == list(range(len(out)))


def test_bracket_limit_is_what_one_task_may_sort():
    assert aggregate.BRACKET_ROWS <= 1_000_000


def test_filters_and_columns_reach_the_scan(spark):
    df = suite.QUERIES["latest_in_range"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
    assert "props" not in plan
    assert "WindowGroupLimit" in plan  # one row per key leaves each map task
