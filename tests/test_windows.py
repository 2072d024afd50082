"""Aggregates and tiles against brute force."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from helpers import rows, small

from tidemark.operators import tiles as tiles_module
from tidemark.operators.aggregate import Aggregation, aggregate, impute_median, minmax
from tidemark.operators.latest import first_per_key, in_range, latest_per_key
from tidemark.operators.tiles import aggregate_tiled, build_tiles, merge_tiles, windowed_from_tiles

T0 = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)
FUNCTIONS = ("sum", "count", "avg", "std", "var", "min", "max")


def events(seed, n, hours):
    rnd = random.Random(seed)
    return [
        (rnd.randint(1, 3), T0 + timedelta(minutes=rnd.randint(0, hours * 60 - 1)), round(rnd.uniform(-50, 50), 2))
        for _ in range(n)
    ]


def brute(data, specs, dense):
    hop_of = lambda ts: int((ts - T0) / HOUR)
    hops = [hop_of(ts) for _, ts, _ in data]
    out = {}
    for key in {k for k, _, _ in data}:
        own = {hop_of(ts) for k, ts, _ in data if k == key}
        for hop in range(min(hops), max(hops) + 1) if dense else own:
            row = []
            for s in specs:
                back = int(s.time_window / HOUR)
                v = [x for k, ts, x in data if k == key and hop - back < hop_of(ts) <= hop]
                row.append(
                    {
                        "sum": lambda: sum(v), "count": lambda: len(v),
                        "avg": lambda: sum(v) / len(v) if v else None,
                        "std": lambda: statistics.stdev(v) if len(v) > 1 else None,
                        "var": lambda: statistics.variance(v) if len(v) > 1 else None,
                        "min": lambda: min(v, default=None), "max": lambda: max(v, default=None),
                    }[s.function]()
                )
            out[key, T0 + (hop + 1) * HOUR] = row
    return out


@pytest.mark.parametrize("dense", [True, False])
@pytest.mark.parametrize("short", [0, 8, 1000])
def test_tiled_windows(spark, dense, short, monkeypatch):
    monkeypatch.setattr(tiles_module, "SHORT_WINDOW", short)
    data = events(1, 150, 60)
    specs = [Aggregation("v", f, h * HOUR) for f in FUNCTIONS for h in (3, 10)]
    df = small(spark, data, "k int, ts timestamp, v double")
    got = aggregate_tiled(df, ["k"], specs, "ts", HOUR, dense=dense).collect()
    want = brute(data, specs, dense)
    assert {(r["k"], r["window_end"]) for r in got} == set(want)
    for r in got:
        for s, w in zip(specs, want[r["k"], r["window_end"]]):
            assert r[s.output] == (None if w is None else pytest.approx(w, abs=1e-6)), s.output


def test_tiles_merge(spark):
    data = events(2, 80, 20)
    specs = [Aggregation("v", f, 5 * HOUR) for f in FUNCTIONS]
    df = small(spark, data, "k int, ts timestamp, v double")
    first, second = small(spark, data[:30], "k int, ts timestamp, v double"), small(spark, data[30:], "k int, ts timestamp, v double")
    whole = build_tiles(df, ["k"], specs, "ts", HOUR)
    parts = merge_tiles(build_tiles(first, ["k"], specs, "ts", HOUR).unionByName(build_tiles(second, ["k"], specs, "ts", HOUR)), ["k"])

    def values(t):
        out = windowed_from_tiles(t, ["k"], specs, HOUR).orderBy("k", "window_end").collect()
        return [[round(x, 6) if isinstance(x, float) else x for x in r] for r in out]

    assert values(whole) == values(parts)


def test_times_before_the_epoch(spark):
    df = small(spark, [(1, datetime(1969, 12, 31, 23, 30), 1.0)], "k int, ts timestamp, v double")
    assert build_tiles(df, ["k"], [Aggregation("v", "sum", 2 * HOUR)], "ts", HOUR).first()["hop"] == -1


def test_windows_must_fit_hops(spark):
    df = small(spark, [(1, T0, 1.0)], "k int, ts timestamp, v double")
    for window in (HOUR, timedelta(minutes=90), None):
        with pytest.raises(ValueError):
            aggregate_tiled(df, ["k"], [Aggregation("v", "sum", window)], "ts", HOUR)
    with pytest.raises(ValueError):
        Aggregation("v", "mode")
    with pytest.raises(ValueError):
        aggregate(df, ["k"], [Aggregation("v", "sum"), Aggregation("v", "max", HOUR)], "ts")


def test_latest_only_and_names(spark):
    df = small(spark, [(1, T0, 1.0), (1, T0 + 5 * HOUR, 2.0), (2, T0, 7.0)], "k int, ts timestamp, v double")
    out = aggregate_tiled(df, ["k"], [Aggregation("v", "sum", 2 * HOUR)], "ts", HOUR, latest_only=True)
    assert rows(out, "k", "sum_v_7200s", "window_end") == [(1, 2.0, T0 + 6 * HOUR), (2, 0.0, T0 + 6 * HOUR)]
    assert rows(aggregate(df, ["k"], [Aggregation("v", "count")])) == [(1, 2), (2, 1)]


def test_first_and_latest(spark):
    df = small(
        spark, [(1, T0, 1, "a"), (1, T0, 2, "b"), (1, T0 + HOUR, 0, "c"), (None, T0, 5, "n")], "k int, ts timestamp, made int, v string"
    )
    assert rows(latest_per_key(df, ["k"], "ts", "made"), "k", "v") == [(1, "c"), (None, "n")]
    assert rows(latest_per_key(in_range(df, "ts", T0, T0), ["k"], "ts", "made"), "k", "v") == [(1, "b"), (None, "n")]
    assert rows(first_per_key(df, ["k"], "ts", ["made"]), "k", "v") == [(1, "a"), (None, "n")]
    assert rows(latest_per_key(df, [], "ts", "made"), "v") == [("c",)]


def test_impute_and_scale_edges(spark):
    df = small(spark, [(1.0, 5.0, None), (None, 5.0, None), (4.0, 5.0, None)], "a double, same double, none double")
    filled = impute_median(df, ["a", "same", "none"])
    assert rows(filled, "a") == [(1.0,), (2.5,), (4.0,)]
    assert rows(minmax(filled, ["a", "same", "none"])) == [(0.0, 0.0, 0.0), (0.5, 0.0, 0.0), (1.0, 0.0, 0.0)]
    assert rows(impute_median(df, ["a"], exact=False), "a") == [(1.0,), (1.0,), (4.0,)]


@pytest.mark.parametrize("hops", [9, 50, 10_000])
def test_long_windows_over_few_tiles(spark, hops):
    rnd = random.Random(hops)
    at = sorted(rnd.sample(range(-3 * hops, 3 * hops), 40))
    data = [(k, T0 + h * HOUR, round(rnd.uniform(-9, 9), 2)) for k in (1, 2) for h in at if rnd.random() < 0.8]
    data += [(3, T0, None), (3, T0 + HOUR, 5.0)]
    specs = [Aggregation("v", f, h * HOUR) for f in FUNCTIONS for h in (hops, 3)]
    got = aggregate_tiled(small(spark, data, "k int, ts timestamp, v double"), ["k"], specs, "ts", HOUR, dense=False).collect()
    hop_of = lambda ts: int((ts - T0) / HOUR)
    assert len(got) == len(data)
    for r in got:
        end = hop_of(r["window_end"])
        for h in (hops, 3):
            v = [x for k, ts, x in data if k == r["k"] and end - h <= hop_of(ts) < end and x is not None]
            name = f"{{}}_v_{h * 3600}s".format
            assert r[name("sum")] == pytest.approx(sum(v)) and r[name("count")] == len(v)
            assert (r[name("min")], r[name("max")]) == (min(v, default=None), max(v, default=None))
            want = statistics.variance(v) if len(v) > 1 else None
            assert r[name("var")] == (want if want is None else pytest.approx(want, abs=1e-9))
    plan = aggregate_tiled(small(spark, data, "k int, ts timestamp, v double"), ["k"], specs, "ts", HOUR, dense=False)
    assert "RangeFrame, -9999" not in plan._jdf.queryExecution().executedPlan().toString()


def test_span_holds_every_change(spark):
    data = events(5, 25, 400)
    specs = [Aggregation("v", f, h * HOUR) for f in FUNCTIONS for h in (3, 10)]
    df = small(spark, data, "k int, ts timestamp, v double")
    dense = {(r["k"], r["window_end"]): tuple(r)[2:] for r in aggregate_tiled(df, ["k"], specs, "ts", HOUR).collect()}
    span = {(r["k"], r["window_end"]): tuple(r)[2:] for r in aggregate_tiled(df, ["k"], specs, "ts", HOUR, dense="span").collect()}
    assert len(span) < len(dense) / 2
    for key in {k for k, _ in dense}:
        last = None
        for end in sorted(e for k, e in dense if k == key):
            last = span.get((key, end), last)
            if last is None:  # before the key's first row
                assert dense[key, end][0] == 0.0
            else:
                assert last == pytest.approx(dense[key, end], abs=1e-6, nan_ok=True)


def test_latest_spread_needs_no_lists(spark):
    data = [(k, T0 + h * HOUR, 1e8 + (h * 7 + k) % 5) for k in (1, 2) for h in range(30)]
    specs = [Aggregation("v", f, 20 * HOUR) for f in ("std", "var", "avg")]
    df = small(spark, data, "k int, ts timestamp, v double")
    out = aggregate_tiled(df, ["k"], specs, "ts", HOUR, latest_only=True)
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        v = [x for k, ts, x in data if k == r["k"]][-20:]
        assert r["var_v_72000s"] == pytest.approx(statistics.variance(v), rel=1e-9)
