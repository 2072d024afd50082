"""Streams over several files: late rows, restarts, replays."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from helpers import rows, small

from tidemark.operators.aggregate import Aggregation
from tidemark.operators.tiles import build_tiles, windowed_from_tiles
from tidemark.plans.views import View, stream_view
from tidemark.plans.workspace import Workspace
from tidemark.sources.read import BatchSource, decode, read_file_stream
from tidemark.streaming.ingest import (
    ingest, read_tiles, run_view, stream_aggregate, stream_tiles, windows_from_stream, write_stream,
)
from tidemark.streaming.state import stream_windows, write_windows

T0 = datetime(2024, 1, 1)
DDL = "k int, ts timestamp, v double"


def at(h):
    return T0 + timedelta(hours=h)


def drop_file(spark, folder, data):
    small(spark, data, DDL).coalesce(1).write.mode("append").parquet(folder)


def test_ingest_restarts_and_ignores_late_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    view = View("act", ("k",), ("v",), BatchSource(table="unused"), ts="ts")
    space = Workspace(spark, str(tmp_path / "root"), [view])

    def run():
        ingest(space, "act", read_file_stream(spark, folder, DDL, files_per_batch=1), "online_and_offline").awaitTermination()

    drop_file(spark, folder, [(1, at(1), 1.0), (1, at(2), 2.0), (2, at(1), 5.0)])
    run()
    drop_file(spark, folder, [(1, at(0), 9.0), (2, at(3), 6.0)])
    drop_file(spark, folder, [(3, at(0), 7.0)])
    run()  # goes on from its checkpoint
    run()  # nothing new
    assert rows(space.online("act").read(spark), "k", "v") == [(1, 2.0), (2, 6.0), (3, 7.0)]
    assert space.offline("act").count() == 5
    assert "created" in space.offline("act").columns


def test_replayed_batch_changes_nothing(spark, tmp_path):
    view = View("act", ("k",), ("v",), BatchSource(table="unused"), ts="ts")
    space = Workspace(spark, str(tmp_path), [view])
    batch = small(spark, [(1, at(1), 1.0)], DDL)
    for _ in range(2):
        space.write_view(batch, "act", "online_and_offline", 4, "stream")
    assert space.offline("act").count() == 1 and space.online("act").read(spark).count() == 1


def test_watermark_drops_late_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    drop_file(spark, folder, [(1, at(0.5), 1.0), (1, at(5), 1.0)])
    out = stream_aggregate(
        read_file_stream(spark, folder, DDL), ["k"], [Aggregation("v", "sum", timedelta(hours=1))], "ts", "1 hour"
    )

    def run():
        write_stream(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return rows(spark.read.parquet(str(tmp_path / "out")), "window_start", "sum_v_3600s")

    assert run() == [(at(0), 1.0)]
    drop_file(spark, folder, [(1, at(0.6), 50.0), (1, at(9), 1.0)])  # the first is too late
    assert run() == [(at(0), 1.0), (at(5), 1.0)]
    with pytest.raises(ValueError):
        stream_aggregate(out, ["k"], [Aggregation("v", "sum")], "ts")


def test_tiles_take_late_rows(spark, tmp_path):
    folder, place = str(tmp_path / "in"), str(tmp_path / "tiles")
    hour = timedelta(hours=1)
    specs = [Aggregation("v", f, 3 * hour) for f in ("sum", "std", "max")]
    parts = [[(1, at(0.5), 1.0), (1, at(5), 4.0)], [(1, at(0.2), 8.0), (2, at(1), 3.0)], [(1, at(5.5), 6.0)]]
    for p in parts:
        drop_file(spark, folder, p)
        stream = read_file_stream(spark, folder, DDL, files_per_batch=1)
        stream_tiles(stream, ["k"], specs, "ts", hour, place, str(tmp_path / "cp")).awaitTermination()
    whole = build_tiles(small(spark, sum(parts, []), DDL), ["k"], specs, "ts", hour)
    want = rows(windowed_from_tiles(whole, ["k"], specs, hour))
    assert rows(windows_from_stream(spark, place, ["k"], specs, hour)) == want
    assert read_tiles(spark, place, ["k"]).count() == 3


def test_decode(spark):
    df = small(spark, [('{"a": 1}',), ("junk",)], "value string")
    assert rows(decode(df, "json", "a int")) == [(1,), (None,)]
    with pytest.raises(ValueError):
        decode(df, "xml", "a int")


def test_windows_of_state_are_those_of_all_rows(spark, tmp_path):
    """Late rows meet open hops; a stream that is stopped and started again goes on."""
    folder, place = str(tmp_path / "in"), str(tmp_path / "out")
    hour = timedelta(hours=1)
    specs = [Aggregation("v", f, 3 * hour) for f in ("sum", "count", "avg", "std", "min", "max")] + [Aggregation("v", "max", 30 * hour)]
    parts = [
        [(1, at(0.5), 1.0), (1, at(3.2), 4.0), (2, at(3.1), None)],
        [(1, at(1.9), 8.0), (2, at(2.0), 3.0), (2, at(4.5), 7.0)],  # late by less than two hours
        [(1, at(3.4), 6.0), (1, at(9.0), 2.0), (None, at(9.5), 1.0)],
        [(1, at(0.1), 50.0), (2, at(40.0), 1.0)],  # the first is too late
        [(1, at(80.0), 1.0)],
    ]
    for p in parts:
        drop_file(spark, folder, p)
        windows = stream_windows(read_file_stream(spark, folder, DDL, files_per_batch=1), ["k"], specs, "ts", hour, "2 hours")
        write_windows(windows, place, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(place)
    kept = [r for p in parts for r in p if r != (1, at(0.1), 50.0)]
    tiles = build_tiles(small(spark, kept, DDL), ["k"], specs, "ts", hour)
    want = windowed_from_tiles(tiles, ["k"], specs, hour).where("window_end <= timestamp'2024-01-04 06:00:00'")
    columns = [s.output for s in specs]
    both = [{(r["k"], r["window_end"]): [r[c] for c in columns] for r in df.collect()} for df in (got, want)]
    assert both[0].keys() == both[1].keys() and got.count() == len(both[0])
    for name, values in both[0].items():
        assert values == [None if x is None else pytest.approx(x) for x in both[1][name]], name


def test_stream_view_feeds_its_tables(spark, tmp_path):
    folder = str(tmp_path / "in")
    drop_file(spark, folder, [(1, at(0.5), 1.0), (1, at(1.5), 4.0), (2, at(1.1), -2.0), (1, at(9), 1.0)])

    @stream_view(
        keys=("k",), features=("v",), ts="ts", source=BatchSource(table="unused"), stream=lambda s: read_file_stream(s, folder, DDL), where="v > 0"
    )
    def doubled(df):
        return df.withColumn("v", df["v"] * 2)

    @stream_view(
        keys=("k",), features=(), ts="ts", source=BatchSource(table="unused"), stream=lambda s: read_file_stream(s, folder, DDL),
        aggregations=(Aggregation("v", "sum", timedelta(hours=2)),), hop=timedelta(hours=1),
    )
    def sums(df):
        return df

    space = Workspace(spark, str(tmp_path / "root"), [doubled, sums])
    run_view(space, "doubled").awaitTermination()
    assert rows(space.online("doubled").read(spark), "k", "v") == [(1, 2.0)]
    run_view(space, "sums", "online_and_offline").awaitTermination()
    assert rows(space.offline("sums"), "k", "ts", "sum_v_7200s") == [(1, at(1), 1.0), (1, at(2), 5.0), (2, at(2), -2.0)]
    assert rows(space.online("sums").read(spark), "k", "sum_v_7200s") == [(1, 5.0), (2, -2.0)]
    with pytest.raises(ValueError, match="hop"):
        run_view(Workspace(spark, "", [replace(sums, hop=None)]), "sums")
