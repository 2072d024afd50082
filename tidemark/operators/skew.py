"""Building blocks that keep any one key or group from landing in one task."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import fits_one_task, reliable, shuffle_partitions

INF = float("inf")

# A key with fewer rows than this is no burden for one task.
HOT_ROWS = 100_000


def micros(col: Column) -> Column:
    """Microseconds since the epoch; exact for both timestamp types in a UTC session."""
    return F.unix_micros(col.cast("timestamp"))


def content_hash(df: DataFrame, columns: list[str]) -> Column:
    """A stable hash of some columns; maps, which Spark does not hash, as JSON."""
    return F.xxhash64(
        *[F.to_json(c) if "map<" in df.schema[c].dataType.simpleString() else F.col(c) for c in columns]
    )


def hot_keys(df: DataFrame, keys: list[str], share: int, floor: int = HOT_ROWS) -> tuple[list[tuple], int]:
    """Keys holding more than 1/``share`` of the rows (and over ``floor``), and their rows in all.

    A first scan counts rows per hash bucket of the key, which shuffles next to
    nothing however many keys there are. Only a bucket over the limit can hold
    such a key, and only the rows of those buckets are then counted per key.
    Fewer than ``share`` buckets and keys can pass, which bounds what is collected.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(min(64 * share, 1 << 20))).cast("int")
    rows = df.select(*keys).dropna().withColumn("_bucket", bucket)
    counts = rows.groupBy("_bucket").count()
    top = counts.orderBy(F.desc("count")).limit(share)
    whole = counts.agg(F.sum("count").alias("count"))
    found = top.unionByName(whole, allowMissingColumns=True).collect()  # both sides reuse one shuffle
    total = next(r["count"] for r in found if r["_bucket"] is None) or 0
    limit = max(total / share, floor)
    full = [r["_bucket"] for r in found if r["_bucket"] is not None and r["count"] > limit]
    if not full:
        return [], 0
    hot = rows.filter(F.col("_bucket").isin(full)).groupBy(*keys).count().filter(F.col("count") > limit).collect()
    return [tuple(r[k] for k in keys) for r in hot], sum(r["count"] for r in hot)


def _slots(spread: int) -> int:
    return 1 if spread == 1 else 2 * spread


@dataclass
class TimeSlices:
    """Equal-depth cuts of the time line, used for hot keys only.

    ``edges`` are strictly increasing instants. An instant so frequent that it
    fills several slices gets a slice range of its own: its feature rows spread
    by hash over the first half, its entity rows over the second half.
    """

    keys: list[str]
    hot: DataFrame | None
    edges: list[float] = field(default_factory=list)
    base: list[int] = field(default_factory=list)
    spread: list[int] = field(default_factory=list)

    @property
    def last(self) -> int:
        """Number of the last slice."""
        return self.base[-1] + _slots(self.spread[-1]) - 1

    def tag(self, df: DataFrame, ts: Column, salt: Column, entity_side: bool) -> DataFrame:
        """Add ``_slice`` (0 for keys that are not hot)."""
        if self.hot is None:
            return df.withColumn("_slice", F.lit(0))
        cut = Bucketizer(
            splits=[-INF, *self.edges, INF], inputCol="_at", outputCol="_cell", handleInvalid="keep"
        )
        cells = cut.transform(
            df.join(F.broadcast(self.hot), self.keys, "left").withColumn("_at", ts.cast("double"))
        )
        cell = F.col("_cell").cast("int") + 1
        first = F.element_at(F.array(*map(F.lit, self.base)), cell)
        width = F.element_at(F.array(*map(F.lit, self.spread)), cell)
        within = F.pmod(salt, width).cast("int")
        if entity_side:
            within = F.when(width > 1, width + within).otherwise(F.lit(0))
        return cells.withColumn(
            "_slice", F.when(F.col("_hot"), first + within).otherwise(F.lit(0))
        ).drop("_hot", "_at", "_cell")


def plan_time_slices(rows: DataFrame, keys: list[str], ts: str, pieces: int | None = None) -> TimeSlices:
    """Find hot keys in ``rows`` and cut time so no slice of them is oversized.

    Runs two scans of the key and time columns. What comes back to the driver is
    bounded by the number of shuffle partitions.
    """
    spark = rows.sparkSession
    floor = 0 if pieces else HOT_ROWS
    pieces = pieces or max(shuffle_partitions(spark), 2)
    found, _ = hot_keys(rows, keys, pieces, floor)
    if not found:
        return TimeSlices(keys, None)
    schema = rows.select(*keys).schema
    hot = spark.createDataFrame(found, schema).withColumn("_hot", F.lit(True))
    marks = [i / pieces for i in range(1, pieces)]
    at = (
        rows.join(F.broadcast(hot), keys, "left_semi")
        .agg(F.percentile_approx(micros(F.col(ts)), marks, 10 * max(pieces, 1000)).alias("q"))
        .first()["q"]
    )
    edges: list[float] = []
    spread = [1]
    for instant in sorted(set(at)):
        times = at.count(instant)
        if times > 1:
            if edges and edges[-1] == float(instant):
                spread[-1] = times
            else:
                edges.append(float(instant))
                spread.append(times)
            edges.append(float(instant + 1))
            spread.append(1)
        elif not edges or edges[-1] < instant:
            edges.append(float(instant))
            spread.append(1)
    base, at_slice = [], 0
    for width in spread:
        base.append(at_slice)
        at_slice += _slots(width)
    return TimeSlices(keys, hot, edges, base, spread)


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums over the total order ``order`` (one row per position).

    Small inputs use one window. Otherwise rows are range partitioned and kept in
    the shared folder, so a partition's number stays true when a task is run
    again; each partition then adds the total of those before it.
    """
    if fits_one_task(df):
        w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(c).over(w) for name, c in sums.items()})
    valued = df.withColumns({f"_v_{name}": c for name, c in sums.items()})
    ranged = reliable(valued.repartitionByRange(*order)).withColumn("_part", F.spark_partition_id())
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part")
        .agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
        .select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    )
    # one row per shuffle partition, so the broadcast is bounded by that setting
    w = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "_part")
    out = out.withColumns({n: F.sum(f"_v_{n}").over(w) + F.col(f"_o_{n}") for n in sums})
    return out.drop("_part", *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums])
