"""Sliding windows kept as stream state: a ring of tiles and a timer per key.

Rows of a micro-batch are merged into their key's tiles, one per hop, which are the
only state. A hop closes when the watermark passes its end. A key has one timer, for the
first of its open hops; it emits the windows of all hops closed by then, from the tiles
they span, so a key costs a call per micro-batch and not one per window. Rows that are late by less
than the watermark's delay meet a hop that is still open, so a window is emitted once
and is final; tiles no later window can reach are dropped. Reading the result reads
windows, not batches of tiles, however long the stream runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.aggregate import Aggregation
from ..operators.project import to_utc
from ..operators.tiles import PARTIALS, _back, _micros

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTS = 6  # of a tile and column: count, sum, least, greatest, mean, squared distances from the mean


def merged(tiles: np.ndarray) -> np.ndarray:
    """One tile out of several (tiles x PARTS); their means and distances add up without cancelling."""
    n = tiles[:, 0].sum()
    some = tiles[tiles[:, 0] > 0]
    if not n:
        return np.array([0, 0, np.nan, np.nan, np.nan, 0.0])
    mean = (some[:, 0] * some[:, 4]).sum() / n
    spread = some[:, 5].sum() + (some[:, 0] * (some[:, 4] - mean) ** 2).sum()
    return np.array([n, some[:, 1].sum(), some[:, 2].min(), some[:, 3].max(), mean, spread])


def value_of(function: str, tile: np.ndarray) -> float | int | None:
    """What a window function gives for a merged tile; see ``tiles`` for the same in bulk."""
    n, total, least, greatest, mean, spread = tile
    if function == "sum":
        return total
    if function == "count":
        return int(n)
    if not n or (function not in ("min", "max", "mean", "avg") and n < 2):
        return None
    if function in ("min", "max"):
        return least if function == "min" else greatest
    if function in ("mean", "avg"):
        return mean
    variance = spread / (n - 1)
    return variance**0.5 if function in ("std", "stddev") else variance


NEVER = np.iinfo(np.int64).max


class Ring(StatefulProcessor):
    """Tiles of one key, by hop, and which hops are open; one timer, for the first of those."""

    def __init__(self, keys: list[str], ts: str, columns: list[str], windows: list[tuple[str, int, str, int]], hop: int):
        self.keys, self.ts, self.columns, self.windows, self.hop = keys, ts, columns, windows, hop
        self.longest = max(back for *_, back in windows)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("tiles", "hops array<bigint>, parts array<double>, open array<bigint>")

    def _load(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hops, parts, open_ = self.ring.get() if self.ring.exists() else ([], [], [])
        return np.array(hops, np.int64), np.array(parts, float).reshape(-1, len(self.columns), PARTS), np.array(open_, np.int64)

    def _save(self, hops: np.ndarray, parts: np.ndarray, open_: np.ndarray) -> None:
        if len(hops):
            self.ring.update((hops.tolist(), parts.ravel().tolist(), open_.tolist()))
        else:
            self.ring.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        hops, parts, open_ = self._load()
        first = open_.min(initial=NEVER)
        for batch in rows:
            at = batch[self.ts].to_numpy().astype("datetime64[us]").astype(np.int64) // self.hop
            new, place = np.unique(at, return_inverse=True)
            tiles = np.stack([self._tiles(batch[c].to_numpy(float), place, len(new)) for c in self.columns], axis=1)
            known = np.isin(new, hops)
            for hop, tile in zip(new[known].tolist(), tiles[known]):
                at = np.flatnonzero(hops == hop)[0]
                parts[at] = [merged(np.stack([a, b])) for a, b in zip(parts[at], tile)]
            hops, parts = np.append(hops, new[~known]), np.concatenate([parts, tiles[~known]])
            open_ = np.append(open_, new[~known])
        self._save(hops, parts, open_)
        now = open_.min(initial=NEVER)
        if now < first:
            if first < NEVER:
                self.handle.deleteTimer(self._end(first))
            self.handle.registerTimer(self._end(now))
        return iter(())

    def _end(self, hop: int) -> int:
        """When a hop closes, in milliseconds."""
        return (int(hop) + 1) * self.hop // 1000

    def _tiles(self, values: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        """One column's tiles (n x PARTS); NaN counts as null."""
        there = ~np.isnan(values)
        values, place = values[there], place[there]
        count = np.bincount(place, minlength=n).astype(float)
        total = np.bincount(place, values, n)
        least, greatest = np.full(n, np.nan), np.full(n, np.nan)
        np.fmin.at(least, place, values)
        np.fmax.at(greatest, place, values)
        mean = np.divide(total, count, out=np.full(n, np.nan), where=count > 0)
        spread = np.bincount(place, (values - mean[place]) ** 2, n)
        return np.stack([count, total, least, greatest, mean, spread], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All windows of the key that have closed by now, in one go."""
        hops, parts, open_ = self._load()
        order = np.argsort(hops)
        hops, parts = hops[order], parts[order]
        ends = (open_ + 1) * self.hop // 1000
        closed = (ends <= expiredTimerInfo.getExpiryTimeInMs()) | (ends < timerValues.getCurrentWatermarkInMs())
        due, open_ = np.sort(open_[closed]), open_[~closed]
        if not len(due):
            return
        behind = np.searchsorted(hops, due, "right")
        out: dict = {name: [value] * len(due) for name, value in zip(self.keys, key)}
        out["window_end"] = ((due + 1) * self.hop).astype("datetime64[us]")  # far years included
        tiles: dict = {}  # of a column and window length, one per window
        for function, column, output, back in self.windows:
            if (column, back) not in tiles:
                begins = np.searchsorted(hops, due - back, "right")
                tiles[column, back] = [merged(parts[a:b, column]) for a, b in zip(begins, behind)]
            values = [value_of(function, tile) for tile in tiles[column, back]]
            out[output] = pd.Series(values, dtype=object if None in values else None)
        # the next window to close ends at least one hop later
        needed = hops >= due[-1] + 2 - self.longest
        self._save(hops[needed], parts[needed], open_)
        if len(open_):
            self.handle.registerTimer(self._end(open_.min()))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def stream_windows(
    stream: DataFrame, keys: list[str], specs: list[Aggregation], ts: str, hop: timedelta, watermark: str = "0 seconds"
) -> DataFrame:
    """Every window that ends where a key's tile ends, once that hop is closed: (keys, window_end, outputs).

    The values are those of ``tiles.windowed_from_tiles`` over the same rows. Windows of any
    length share the state; numbers come back as doubles, counts as long. Start it with
    ``write_windows`` or within ``timer_store``.
    """
    if _micros(hop) % 1000:
        raise ValueError("hops are whole milliseconds")
    columns = list(dict.fromkeys(s.column for s in specs))
    windows = [(s.function, columns.index(s.column), s.output, _back(s, hop)) for s in specs if PARTIALS[s.function]]
    kinds = [f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys]
    outputs = [f"`{s.output}` {'long' if s.function == 'count' else 'double'}" for s in specs]
    rows = to_utc(stream, ts).withWatermark(ts, watermark)
    slim = rows.select(*keys, ts, *[F.col(c).cast("double").alias(c) for c in columns])
    return slim.groupBy(*keys).transformWithStateInPandas(
        Ring(keys, ts, columns, windows, _micros(hop)),
        outputStructType=StructType.fromDDL(", ".join([*kinds, "window_end timestamp", *outputs])),
        outputMode="append",
        timeMode="eventTime",
    )


@contextmanager
def timer_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in a store that holds timers."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # a query keeps the store it was started with
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def write_windows(windows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append closed windows to parquet; without an interval the run ends with the input there is."""
    writer = windows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    with timer_store(windows.sparkSession):
        return writer.start(path)
