"""Checks, profiles, schemas; edge tables and walks with cycles."""

import json

import pytest
from helpers import rows, small

from tidemark.functions.columns import dataset_parts
from tidemark.operators.lineage import (
    edges, indirect, parse_events, namespaces_of, relations, subgraph, trace_all_upstream, trace_upstream, walk,
)
from tidemark.operators.ml import class_report, evaluate, in_test, predict, roc_auc, split, train
from tidemark.operators.project import derive_ratios, encode_fixed, project, to_utc
from tidemark.operators.quality import (
    Check, ValidationError, check_schema, check_vector, mask_not_found, profile, require, validate, validate_against, with_status,
)


def success(df, *checks):
    found = validate(df, list(checks)).collect()
    by = {(r["kind"], r["column_name"]): r["success"] for r in found}
    return [by[c.kind, c.column] for c in checks]


def test_checks(spark):
    df = small(spark, [(i, float(i), None if i % 4 == 0 else "ab"[i % 2]) for i in range(20)], "i int, x double, s string")
    assert success(
        df, Check("exists", "i"), Check("not_null", "s", mostly=0.75), Check("between", "x", 0, 18, mostly=0.95),
        Check("in_set", "s", values=("a", "b")), Check("min_between", "i", 0, 0), Check("exists", "gone"),
    ) == [True, True, True, True, True, False]
    assert success(
        df, Check("not_null", "s", mostly=0.76), Check("between", "x", 0, 18), Check("distinct_in_set", "s", values=("a",)),
        Check("max_between", "i", 0, 5),
    ) == [False, False, False, False]
    with pytest.raises(ValueError):
        validate(df, [Check("other", "i")])


def test_checks_on_nothing(spark):
    df = small(spark, [], "x double")
    assert success(df, Check("not_null", "x"), Check("between", "x", 0, 1)) == [True, True]
    assert success(df, Check("min_between", "x", 0, 1)) == [False]


def test_profile_round_trip(spark):
    good = small(spark, [(i, "xyz"[i % 3], None if i == 0 else 1.0) for i in range(30)], "i int, s string, m double")
    suite = profile(good)
    assert Check("in_set", "s", values=("x", "y", "z")) in suite and Check("between", "i", 0.0, 29.0) in suite
    require(validate(good, suite))
    worse = small(spark, [(99, "w", None)], "i int, s string, m double")
    with pytest.raises(ValidationError) as error:
        require(validate_against(worse, good))
    for part in ("between(i)", "in_set(s)", "not_null(m)"):
        assert part in str(error.value)


def test_schema_findings(spark):
    df = small(spark, [(1, '{"a": 1}'), (2, "{broken"), (3, None)], "i int, j string")
    expected = spark.createDataFrame([], "i long, j string, k int").schema
    found = rows(check_schema(df, expected, ["j"]))
    assert found == [("error", "j", "malformed JSON", 1), ("error", "k", "missing column", 1)]


def test_status_round_trip(spark):
    df = small(spark, [(1, None), (2, 5)], "k int, v int")
    marked = with_status(df, ["v"])
    assert rows(marked, "k", "v__status") == [(1, "NOT_FOUND"), (2, "PRESENT")]
    hidden = marked.replace("PRESENT", "NOT_FOUND", subset=["v__status"])
    assert rows(mask_not_found(hidden), "v") == [(None,), (None,)]
    vec = small(spark, [([1.0],), ([1.0, 2.0],), (None,)], "v array<double>")
    assert rows(check_vector(vec, "v", 1)) == [(3, 2)]


def test_row_functions(spark):
    uris = ["s3://bucket/path/x.parquet", "postgresql://host:5432/db/t", "/local/a.csv", "S3://b/k?x#y", "plain/name", "file:///", ""]
    df = small(spark, [(u,) for u in uris], "u string")
    got = [tuple(r["p"]) for r in df.select(dataset_parts("u").alias("p")).collect()]
    assert got == [
        ("s3", "bucket/path/x.parquet"), ("postgresql", "host:5432/db/t"), ("file", "local/a.csv"), ("s3", "b/k"),
        ("file", "plain/name"), ("file", "unknown"), ("file", "unknown"),
    ]
    df = small(spark, [("a", 4.0, 0.0), ("z", float("inf"), 2.0), (None, None, 1.0)], "c string, n double, d double")
    assert rows(derive_ratios(df, {"r": ("n", "d")}), "r") == [(0.0,), (4.0,), (None,)]
    assert rows(encode_fixed(df, {"c": {"a": 3}}, ["n"]), "c", "n") == [(0.0, 0.0), (0.0, float("inf")), (3.0, 4.0)]
    with pytest.raises(ValueError):
        project(df, ["nocolon"])
    assert to_utc(small(spark, [("junk",)], "t string"), "t").first()["t"] is None


def graph(spark, pairs):
    return small(spark, pairs, "src string, dst string")


CHAIN = [
    ("dataset:a:raw", "job:n1:load"), ("job:n1:load", "dataset:a:clean"),
    ("dataset:a:clean", "job:n2:join"), ("dataset:b:other", "job:n2:join"), ("job:n2:join", "dataset:a:final"),
]


def test_edges_from_events(spark):
    event = {
        "eventType": "COMPLETE", "run": {"runId": "r"}, "job": {"namespace": "n1", "name": "load", "facets": {}},
        "inputs": [{"namespace": "a", "name": "raw", "facets": {}}], "outputs": [{"namespace": "a", "name": "clean"}],
    }
    df = small(spark, [(json.dumps(event),), (json.dumps({**event, "eventType": "START"}),), ("broken",)], "e string")
    assert rows(edges(parse_events(df, "e"))) == sorted(CHAIN[:2])


def test_trace(spark):
    table = graph(spark, CHAIN)
    want = [
        (0, "dataset:a:raw", "job:n1:load", "dataset:a:clean"),
        (1, "dataset:a:clean", "job:n2:join", "dataset:a:final"),
    ]
    assert rows(trace_upstream(table, "dataset:a:final")) == want
    assert trace_upstream(table, "dataset:a:raw").count() == 0
    everything = rows(trace_all_upstream(table).filter("dataset = 'dataset:a:final'"), "step", "job", "input_dataset")
    assert everything == [(1, "job:n2:join", "dataset:a:clean"), (2, "job:n1:load", "dataset:a:raw")]


def test_long_traces_are_whole(spark):
    n = 300
    pairs = [e for k in range(n) for e in ((f"dataset:a:{k}", f"job:a:{k}"), (f"job:a:{k}", f"dataset:a:{k + 1}"))]
    chain = rows(trace_upstream(spark.createDataFrame(pairs, "src string, dst string"), f"dataset:a:{n}"), "step", "input_dataset")
    assert sorted(chain) == [(k, f"dataset:a:{k}") for k in range(n)]


def test_ids_with_colons_do_not_collide(spark):
    events = [("j", "pg://h", "5432:t"), ("k:l", "pg://h:5432", "t"), ("k:l", "100%3A", "u")]
    lines = [
        (f'{{"eventType":"COMPLETE","job":{{"namespace":"n:{j}","name":"x:y"}},"inputs":[{{"namespace":"{ns}","name":"{name}"}}],"outputs":[]}}',)
        for j, ns, name in events
    ]
    table = edges(parse_events(spark.createDataFrame(lines, "e string"), "e"))
    assert table.count() == 3
    start = table.where("src like '%5432'").first() or table.where("src like '%5432:t'").first()
    assert rows(namespaces_of(table, start["src"], 1)) == [("n:k:l",)]


def test_trace_ends_in_a_cycle(spark):
    table = graph(spark, [("dataset:x:a", "job:n:f"), ("job:n:f", "dataset:x:b"), ("dataset:x:b", "job:n:g"), ("job:n:g", "dataset:x:a")])
    assert trace_upstream(table, "dataset:x:a").count() == 2
    assert trace_all_upstream(table).groupBy("dataset").count().filter("count <> 2").count() == 0


def test_walks(spark):
    table = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("z", "a")])
    start = small(spark, [("a",)], "node string")
    assert rows(walk(table, start, 5), "node", "distance") == [("a", 0), ("b", 1), ("c", 1)]
    assert rows(walk(table, start, 1, "in"), "node", "distance") == [("a", 0), ("c", 1), ("z", 1)]
    assert rows(walk(table, start, 0)) == [("a", 0)]
    assert rows(subgraph(table, "z", 1), "src", "dst", "distance") == [("a", "b", 1), ("a", "c", 1), ("z", "a", 0)]
    assert rows(namespaces_of(graph(spark, CHAIN), "dataset:a:final", 10)) == [("n1",), ("n2",)]
    assert rows(namespaces_of(graph(spark, CHAIN), "dataset:a:final", 2)) == [("n2",)]


def test_indirect_relations(spark):
    direct = small(
        spark,
        [("entity", "e", "featureView", "v"), ("dataSource", "s", "featureView", "v"), ("featureView", "v", "featureService", "f")],
        "src_type string, src string, dst_type string, dst string",
    )
    want = [("dataSource", "s", "featureService", "f"), ("entity", "e", "dataSource", "s"), ("entity", "e", "featureService", "f")]
    assert rows(indirect(direct)) == want
    assert relations(direct, "entity", "e").count() == 1
    assert relations(direct, "entity", "e", include_indirect=True).count() == 3


def test_split_is_stable_and_stratified(spark):
    df = small(spark, [(i, i % 4 == 0) for i in range(4000)], "i long, y boolean")
    first, second = split(df, "i"), split(df.repartition(7), "i")
    assert first[0].count() + first[1].count() == 4000
    assert rows(first[1], "i") == rows(second[1], "i")
    for y in (True, False):
        whole = df.filter(df.y == y).count()
        assert abs(first[1].filter(df.y == y).count() / whole - 0.2) < 0.04
    assert rows(df.filter(in_test("i", seed=1)), "i") != rows(first[1], "i")


def test_models_learn_and_metrics_hold(spark):
    df = small(spark, [(float(i % 50), float(i % 7), int(i % 50 > 40)) for i in range(800)], "a double, b double, y int")
    for kind, params in (("boosted", {"maxIter": 3}), ("forest", {"numTrees": 5})):
        out = predict(train(df, ["a", "b"], "y", kind, **params), df)
        m = evaluate(out, "probability", "prediction", "y").first()
        assert m["roc_auc"] > 0.95 and m["f1"] > 0.9 and m["accepted"]
    report = class_report(small(spark, [(1, 1), (1, 0), (0, 0), (0, 0)], "p int, y int"), "p", "y")
    assert rows(report, "class", "precision", "recall", "support") == [(0, 1.0, 2 / 3, 3), (1, 0.5, 1.0, 1)]
    assert roc_auc(small(spark, [(0.5, 1)], "s double, y int"), "s", "y").first()["roc_auc"] is None
    with pytest.raises(ValueError):
        train(df, ["a"], "y", "linear")
