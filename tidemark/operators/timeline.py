"""Stored time lines: feature rows kept by key and time, so a retrieval moves the entity rows only.

A segment is a bucketed table of blocks: one row holds up to some hundred feature rows
of a key, sorted by event time, with the time from which and until which the block
answers. An entity row meets one block of its key per segment, by a join for which the
segment lies ready in its buckets, and finds its row within the block. Rows that arrive
later make segments of their own; of several segments' answers the newest counts, by
the rules of the point-in-time join. ``compact`` makes one segment of all.

A key with more than ``SLICE_BLOCKS`` blocks is cut into slices of time that are
buckets' keys as well, so a hot key is spread over tasks; entity rows learn their slice
from a table of the slices' bounds.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import reliable
from ..sources.pointer import Pointer
from .asof import interval
from .latest import top_rows
from .skew import content_hash, micros

BLOCK_ROWS = 256
SLICE_BLOCKS = 4096
NONE = -(1 << 63)  # stands for a row without a creation time


@dataclass(frozen=True)
class TimeLine:
    """Feature rows below ``path``, a folder all executors share."""

    path: str
    keys: tuple[str, ...]
    ts: str
    features: tuple[str, ...]
    created: str | None = None
    buckets: int = 32
    block_rows: int = BLOCK_ROWS
    slice_blocks: int = SLICE_BLOCKS

    def _pointer(self, spark: SparkSession) -> Pointer:
        return Pointer(spark, self.path)

    def add(self, df: DataFrame) -> None:
        """Store rows as a segment; rows without a key or an event time are passed over."""
        rows = df.dropna(subset=[*self.keys, self.ts]).select(
            *self.keys,
            micros(F.col(self.ts)).alias("_at"),
            (F.coalesce(micros(F.col(self.created)), F.lit(NONE)) if self.created else F.lit(NONE)).alias("_created"),
            content_hash(df, list(self.features)).alias("_tie"),
            F.struct(F.col(self.ts).alias("at"), F.struct(*self.features).alias("f")).alias("_row"),
        )
        self._store(rows, [])

    def _store(self, rows: DataFrame, replaces: list[dict]) -> None:
        """Write rows (keys, _at, _created, _tie, _row) as a segment in the place of others."""
        spark, keys = rows.sparkSession, list(self.keys)
        # of rows at the same instant the last one stands
        rows = top_rows(rows, [*keys, "_at"], [F.desc("_created"), F.desc("_tie")])
        # a partition number must stay true when a task is run again
        ranged = reliable(rows.repartitionByRange(*keys, "_at")).withColumn("_part", F.spark_partition_id())
        at = W.partitionBy(*keys, "_part").orderBy("_at")
        number = F.floor((F.row_number().over(at) - 1) / self.block_rows)
        item = F.struct("_at", "_created", "_tie", "_row")
        blocks = ranged.withColumn("_block", number).groupBy(*keys, "_part", "_block").agg(F.sort_array(F.collect_list(item)).alias("rows"))
        blocks = blocks.select(*keys, F.get("rows", F.lit(0))["_at"].alias("from_us"), "rows")
        along = W.partitionBy(*keys).orderBy("from_us")
        blocks = blocks.withColumn("until_us", F.lead("from_us").over(along))
        blocks = blocks.withColumn("slice", F.floor((F.row_number().over(along) - 1) / self.slice_blocks))
        name = f"timeline_{uuid.uuid4().hex}"
        folder = f"{self.path}/{name}"
        blocks = reliable(blocks)
        hot = blocks.where("slice > 0").select(*keys).distinct()
        sliced = not hot.isEmpty()
        by = [*keys, "slice"] if sliced else keys
        writer = blocks.repartition(self.buckets, *by).write.option("path", folder).bucketBy(self.buckets, *by).sortBy(*by, "from_us")
        writer.saveAsTable(name)
        if sliced:  # a row per slice of a key that has several
            starts = blocks.join(hot, keys, "left_semi").groupBy(*keys, "slice").agg(F.min("from_us").alias("slice_from"))
            ends = F.lead("slice_from").over(W.partitionBy(*keys).orderBy("slice"))
            starts.withColumn("slice_until", ends).write.parquet(f"{folder}-slices")
        segment = {"name": name, "sliced": sliced}

        def swap(state: dict) -> dict | None:
            segments = state.get("segments", [])
            if not all(s in segments for s in replaces):
                return None
            segments = [segment, *[s for s in segments if s not in replaces]]
            names = [s["name"] for s in segments] + [f"{s['name']}-slices" for s in segments if s["sliced"]]
            return state | {"segments": segments, "folders": names}

        if segment not in self._pointer(spark).change(swap).get("segments", []):
            self._pointer(spark).remove(name)
            return
        for s in replaces:
            spark.sql(f"drop table if exists {s['name']}")  # its files go a few versions later

    def _segments(self, spark: SparkSession) -> list[dict]:
        return self._pointer(spark).read()[1].get("segments", [])

    def _blocks(self, spark: SparkSession, segment: dict) -> DataFrame:
        name = segment["name"]
        if not spark.catalog.tableExists(name):  # a session whose catalog has not seen it
            folder = f"{self.path}/{name}"
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema)
            by = ", ".join(f"`{k}`" for k in [*self.keys, *(["slice"] if segment["sliced"] else [])])
            place = folder.replace("\\", "\\\\").replace("'", "\\'")
            spark.sql(
                f"create table {name} ({columns}) using parquet clustered by ({by}) "
                f"sorted by ({by}, from_us) into {self.buckets} buckets location '{place}'"
            )
        return spark.table(name)

    def rows(self, spark: SparkSession) -> DataFrame:
        """All stored rows: keys, event time and features."""
        parts = [self._blocks(spark, s).select(*self.keys, F.explode("rows").alias("r")) for s in self._segments(spark)]
        both = reduce(DataFrame.unionByName, parts)
        return both.select(*self.keys, F.col("r._row.at").alias(self.ts), "r._row.f.*")

    def compact(self, spark: SparkSession) -> None:
        """Make one segment of all; rows added meanwhile stay in segments of their own."""
        old = self._segments(spark)
        if len(old) > 1:
            parts = [self._blocks(spark, s).select(*self.keys, F.explode("rows").alias("r")) for s in old]
            self._store(reduce(DataFrame.unionByName, parts).select(*self.keys, "r.*"), old)

    def join(self, entity: DataFrame, ets: str, ttl: timedelta | None = None, names: dict[str, str] | None = None) -> DataFrame:
        """``entity`` with the features as of its column ``ets``, as ``asof.asof_join`` gives them.

        ``names`` maps features to output names.
        """
        spark = entity.sparkSession
        names = names or {f: f for f in self.features}
        clash = set(entity.columns).intersection(names.values())
        if clash:
            raise ValueError(f"feature names collide: {sorted(clash)}; use full names")
        segments = self._segments(spark)
        if not segments:
            raise ValueError(f"{self.path} holds no rows")
        out = entity.withColumn("_t", micros(F.col(ets)))
        for i, segment in enumerate(segments):
            out = self._hit(out, segment, f"_hit{i}")
        hits = [f"_hit{i}" for i in range(len(segments))]
        newest = F.array_max(F.array(*[F.when(F.col(h).isNotNull(), F.struct(f"{h}._at", f"{h}._created", f"{h}._tie", F.lit(i).alias("i"))) for i, h in enumerate(hits)]))
        row = F.coalesce(*[F.when(newest["i"] == i, F.col(f"{h}._row")) for i, h in enumerate(hits)])
        out = out.withColumn("_found", row)
        live = F.col("_found.at").isNotNull()
        if ttl is not None and ttl.total_seconds() > 0:
            live = live & (F.col("_found.at") >= F.col(ets) - interval(ttl))
        return out.select(*entity.columns, *[F.when(live, F.col("_found.f")[c]).alias(n) for c, n in names.items()])

    def _hit(self, out: DataFrame, segment: dict, name: str) -> DataFrame:
        """Adds the segment's last row at or before ``_t``; its blocks are disjoint, so no row is doubled."""
        spark = out.sparkSession
        blocks = self._blocks(spark, segment).withColumnsRenamed({k: f"_key_{k}" for k in self.keys})
        if segment["sliced"]:
            bounds = spark.read.parquet(f"{self.path}/{segment['name']}-slices")
            bounds = bounds.withColumnsRenamed({k: f"_slice_{k}" for k in self.keys} | {"slice": "_of"})
            inside = (F.col("_t") >= F.col("slice_from")) & (F.col("slice_until").isNull() | (F.col("_t") < F.col("slice_until")))
            out = out.join(bounds, self._same("_slice_") & inside, "left")
            out = out.withColumn("_slice", F.coalesce("_of", F.lit(0)))
        else:
            blocks = blocks.drop("slice")
        met = self._same("_key_") & (F.col("from_us") <= F.col("_t")) & (F.col("until_us").isNull() | (F.col("_t") < F.col("until_us")))
        if segment["sliced"]:
            met = met & (F.col("_slice") == F.col("slice"))
        joined = out.join(blocks, met, "left")
        before = F.size(F.filter("rows", lambda r: r["_at"] <= F.col("_t")))
        joined = joined.withColumn(name, F.when(before > 0, F.get("rows", before - 1)))
        extra = ["slice", "slice_from", "slice_until", "_of", "_slice", *[f"_slice_{k}" for k in self.keys]]
        return joined.drop("from_us", "until_us", "rows", *[f"_key_{k}" for k in self.keys], *extra)

    def _same(self, prefix: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(k) == F.col(f"{prefix}{k}") for k in self.keys])
