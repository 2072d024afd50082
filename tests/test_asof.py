"""Point-in-time joins: fixed cases and brute force over skewed, tied data."""

import random
from datetime import datetime, timedelta

import pytest
from helpers import rows, small

from tidemark.operators import asof
from tidemark.operators.asof import Side, asof_join, entity_time_column, entityless_join, retrieval_start

T0 = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def at(h):
    return T0 + h * HOUR


def test_backfill_tie_break(spark):
    feats = small(
        spark,
        [
            (1001, at(0), at(0), 10), (1001, at(0), at(1), 20),
            (1002, at(0), at(1), 30), (1002, at(1), at(0), 40),
        ],
        "k long, ts timestamp, created timestamp, v int",
    )
    entity = small(spark, [(1001, at(2)), (1002, at(2))], "k long, t timestamp")
    for strategy in ("window", "broadcast"):
        out = asof_join(entity, Side(feats, ("k",), "ts", {"v": "v"}, created="created"), "t", strategy)
        assert rows(out, "k", "v") == [(1001, 20), (1002, 40)]


def test_ttl_is_inclusive_and_zero_means_none(spark):
    feats = small(spark, [(1, at(0), 5)], "k int, ts timestamp, v int")
    entity = small(spark, [(1, at(0)), (1, at(3)), (1, at(4)), (1, at(-1))], "k int, t timestamp")
    for strategy in ("window", "broadcast"):
        out = asof_join(entity, Side(feats, ("k",), "ts", {"v": "v"}, ttl=3 * HOUR), "t", strategy)
        assert rows(out, "t", "v") == [(at(-1), None), (at(0), 5), (at(3), 5), (at(4), None)]
        out = asof_join(entity, Side(feats, ("k",), "ts", {"v": "v"}, ttl=timedelta(0)), "t", strategy)
        assert rows(out, "t", "v") == [(at(-1), None), (at(0), 5), (at(3), 5), (at(4), 5)]


def test_keys_do_not_collide_nulls_do_not_match_duplicates_stay(spark):
    feats = small(
        spark, [(1, 11, at(0), 1), (11, 1, at(0), 2), (None, 1, at(0), 3)], "a int, b int, ts timestamp, v int"
    )
    entity = small(
        spark, [(1, 11, at(1)), (11, 1, at(1)), (11, 1, at(1)), (None, 1, at(1)), (1, None, at(1))], "a int, b int, t timestamp"
    )
    want = [(1, 11, 1), (1, None, None), (11, 1, 2), (11, 1, 2), (None, 1, None)]
    for strategy in ("window", "broadcast"):
        out = asof_join(entity, Side(feats, ("a", "b"), "ts", {"v": "v"}), "t", strategy)
        assert rows(out, "a", "b", "v") == want


def test_empty_sides(spark):
    feats = small(spark, [], "k int, ts timestamp, v int")
    entity = small(spark, [(1, at(0))], "k int, t timestamp")
    assert rows(asof_join(entity, Side(feats, ("k",), "ts", {"v": "v"}), "t")) == [(1, at(0), None)]
    assert rows(asof_join(entity.limit(0), Side(feats, ("k",), "ts", {"v": "v"}), "t")) == []


def test_a_null_feature_is_a_value(spark):
    feats = small(spark, [(1, at(0), 5), (1, at(1), None)], "k int, ts timestamp, v int")
    entity = small(spark, [(1, at(2))], "k int, t timestamp")
    assert rows(asof_join(entity, Side(feats, ("k",), "ts", {"v": "v"}), "t"), "v") == [(None,)]


def test_map_features_and_map_entities(spark):
    feats = small(spark, [(1, at(0), {"x": "y"})], "k int, ts timestamp, m map<string,string>")
    entity = small(spark, [(1, at(1), {"a": 1})], "k int, t timestamp, request map<string,int>")
    out = asof_join(entity, Side(feats, ("k",), "ts", {"m": "m"}), "t").first()
    assert out["m"] == {"x": "y"} and out["request"] == {"a": 1}


def test_colliding_names_are_rejected(spark):
    feats = small(spark, [(1, at(0), 5)], "k int, ts timestamp, v int")
    entity = small(spark, [(1, at(2), 1)], "k int, t timestamp, v int")
    with pytest.raises(ValueError, match="collide"):
        asof_join(entity, Side(feats, ("k",), "ts", {"v": "v"}), "t")


def test_entity_time_column(spark):
    two = small(spark, [], "a timestamp, b timestamp")
    assert entity_time_column(small(spark, [], "event_timestamp timestamp, b timestamp")) == "event_timestamp"
    assert entity_time_column(small(spark, [], "k int, b timestamp")) == "b"
    with pytest.raises(ValueError):
        entity_time_column(two)


def skewed(seed, n, with_created):
    """Key 0 holds over a third of the rows; one instant holds a third of those."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if rnd.random() < 0.4 else rnd.randint(1, 12)
        hour = 50 if rnd.random() < 0.33 else rnd.randint(0, 99)
        out.append((key, at(hour), at(rnd.randint(0, 5)) if with_created else at(0), i))
    return out


def brute_force(entity, feats, ttl):
    want = []
    for i, (k, t) in enumerate(entity):
        best = None
        for key, ts, created, v in feats:
            if key == k and ts <= t and (ttl is None or ts >= t - ttl):
                if best is None or (ts, created, v) > best:
                    best = (ts, created, v)
        want.append((i, best[2] if best else None))
    return sorted(want)


@pytest.mark.parametrize("ttl", [None, 4 * HOUR])
@pytest.mark.parametrize("how", ["window", "broadcast", "slices", "big"])
def test_skewed_keys_and_ties(spark, how, ttl, request):
    feats = skewed(1, 3000, True)
    entity = [(k, t) for k, t, _, _ in skewed(2, 2000, False)]
    f = small(spark, feats, "k int, ts timestamp, created timestamp, v int")
    e = small(spark, [(i, k, t) for i, (k, t) in enumerate(entity)], "i int, k int, t timestamp")
    side = Side(f, ("k",), "ts", {"v": "v"}, ttl, created="created", tie="v")
    if how == "big":
        request.getfixturevalue("always_big")
    out = asof_join(e, side, "t", "broadcast" if how == "broadcast" else "window", slices=37 if how == "slices" else None)
    assert sorted(map(tuple, out.select("i", "v").collect())) == brute_force(entity, feats, ttl)


def test_slices_spread_a_hot_key_and_a_hot_instant(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.skew import micros, plan_time_slices

    f = small(spark, skewed(1, 6000, False), "k int, ts timestamp, created timestamp, v int")
    plan = plan_time_slices(f, ["k"], "ts", 40)
    tagged = plan.tag(f.withColumn("salt", F.xxhash64("v")), micros(F.col("ts")), F.col("salt"), entity_side=False)
    sizes = [r["count"] for r in tagged.filter("k = 0").groupBy("_slice").count().collect()]
    # equal-depth slices hold 60 rows each; a tied instant fills half of its slices
    assert max(sizes) <= 200 and len(sizes) > 15
    cold = tagged.filter("k > 0").select("k").distinct().count()
    assert cold == 12


def test_no_keys_on_the_big_path(spark, always_big):
    f = small(spark, [(at(h), h) for h in range(0, 100, 3)], "ts timestamp, v int")
    e = small(spark, [(at(h),) for h in range(-2, 110)], "t timestamp")
    out = dict(map(tuple, asof_join(e, Side(f, (), "ts", {"v": "v"}, ttl=2 * HOUR), "t").collect()))
    for h in range(-2, 110):
        last = h - h % 3
        assert out[at(h)] == (last if 0 <= last <= 99 and h - last <= 2 else None)


def test_a_long_history_is_not_walked_per_row(spark, monkeypatch):
    f = small(spark, [(1, at(h), h) for h in range(50)], "k int, ts timestamp, v int")
    e = small(spark, [(1, at(7))], "k int, t timestamp")
    side = Side(f, ("k",), "ts", {"v": "v"})
    assert asof._use_intervals(1, e, side, "broadcast")
    monkeypatch.setattr(asof, "LONG_HISTORY", 10)
    assert not asof._use_intervals(1, e, side, "broadcast")


def test_two_key_sets_share_no_columns(spark):
    e = small(spark, [(1, 2, at(5))], "a int, b int, t timestamp")
    fa = small(spark, [(1, at(1), 10)], "a int, ts timestamp, v int")
    fb = small(spark, [(2, at(2), 20)], "b int, ts timestamp, v int")
    sides = [Side(fa, ("a",), "ts", {"v": "va"}, ts_as="ta"), Side(fb, ("b",), "ts", {"v": "vb"}), Side(fb, (), "ts", {"v": "vg"})]
    assert rows(asof_join(e, sides, "t")) == [(1, 2, at(5), 10, at(1), 20, 20)]


def test_entityless_pads_missing_keys(spark):
    fa = small(spark, [(1, at(1), 10), (3, at(90), 1)], "a int, ts timestamp, v int")
    fb = small(spark, [(2, at(2), 20)], "b int, ts timestamp, v int")
    sides = [Side(fa, ("a",), "ts", {"v": "va"}), Side(fb, ("b",), "ts", {"v": "vb"})]
    out = entityless_join(sides, at(50), at(0))
    assert rows(out, "a", "b", "va", "vb") == [(1, None, 10, None), (None, 2, None, 20)]
    assert retrieval_start(sides, at(0)) == at(0) - timedelta(days=30)


def test_multi_view_needs_one_shuffle(spark):
    feats = [small(spark, [(1, at(h), h)], "k int, ts timestamp, v int") for h in (0, 1, 2)]
    e = small(spark, [(1, at(7))], "k int, t timestamp")
    out = asof_join(e, [Side(f, ("k",), "ts", {"v": f"v{i}"}) for i, f in enumerate(feats)], "t", "window")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and plan.count("Window [") == 1 and plan.count("Sort [") == 1


def test_wide_features_are_not_sent(spark):
    f = small(spark, [(k, at(0), "x" * 1000) for k in range(2000)], "k int, ts timestamp, v string")
    e = small(spark, [(1, at(7))], "k int, t timestamp")
    side = Side(f, ("k",), "ts", {"v": "v"})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        assert not asof._use_intervals(1, e, side, "broadcast")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    assert asof._use_intervals(1, e, side, "broadcast")
