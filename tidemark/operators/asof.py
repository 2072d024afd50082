"""Point-in-time joins.

For each entity row the join finds, per view, the newest feature row with the
same keys whose event time is not after the entity time and not older than the
view's time to live. Entity rows are never dropped or multiplied.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import ONE_TASK_BYTES, broadcast_limit, estimated_bytes, fits_one_task, row_bytes, row_width, written
from .skew import TimeSlices, content_hash, micros, plan_time_slices


# Feature rows per key up to which a broadcast lookup may walk them.
LONG_HISTORY = 4096


@dataclass(frozen=True)
class Side:
    """The feature side of an as-of join.

    ``columns`` maps source columns to output names. Rows with equal event time
    are decided by ``created``, then by ``tie`` (a content hash by default).
    """

    df: DataFrame
    keys: tuple[str, ...]
    ts: str
    columns: dict[str, str]
    ttl: timedelta | None = None
    created: str | None = None
    tie: str | None = None
    ts_as: str | None = None

    def tie_break(self) -> Column:
        return F.col(self.tie).cast("long") if self.tie else content_hash(self.df, list(self.columns))


def interval(delta: timedelta) -> Column:
    return F.expr(f"make_dt_interval({delta.days}, 0, 0, {delta.seconds + delta.microseconds / 1e6:.6f}BD)")


def ttl_of(side: Side) -> timedelta | None:
    """A zero time to live means no expiry."""
    return side.ttl if side.ttl and side.ttl.total_seconds() > 0 else None


def asof_join(
    entity: DataFrame,
    sides: Side | list[Side],
    ets: str,
    strategy: str = "auto",
    slices: int | None = None,
) -> DataFrame:
    """Join every side to ``entity`` as of column ``ets``.

    ``strategy``:
      * ``window``: union entity and feature rows, shuffle once per distinct key
        set, carry the last feature row forward in time order. Keys that hold more
        rows than a shuffle partition should are cut into time slices, each
        seeded with the last feature row before it.
      * ``broadcast``: turn a small feature side into validity intervals and look
        them up without shuffling the entities. Used only when the side, by estimate
        and by row count, is below Spark's broadcast threshold and no key has a long
        history; otherwise ``window``.
      * ``auto``: ``broadcast`` for a small side next to a big entity frame.

    ``slices`` forces slicing into that many pieces even for small inputs.
    """
    todo = [sides] if isinstance(sides, Side) else list(sides)
    taken = set(entity.columns)
    for side in todo:
        new = [*side.columns.values(), *([side.ts_as] if side.ts_as else [])]
        clash = taken.intersection(new)
        if clash:
            raise ValueError(f"feature names collide: {sorted(clash)}; use full names")
        taken.update(new)
    # keys and times of the entity rows, which planning reads; a frame that may be big
    # runs once for them and once for the result
    probe, span, n = entity, None, None
    if strategy == "broadcast" or not fits_one_task(entity, *[s.df for s in todo]):
        probe = written(entity.select(*dict.fromkeys([*(k for s in todo for k in s.keys), ets])), "entity-keys")
        at = micros(F.col(ets))
        *span, n = probe.agg(F.min(ets), F.max(ets), F.min(at), F.max(at), F.count(F.lit(1))).first()
    out = entity
    by_keys: dict[tuple[str, ...], list[Side]] = {}
    for side in todo:
        if _use_intervals(n, entity, side, strategy):
            out = _interval_join(out, side, ets, span)
        else:
            by_keys.setdefault(side.keys, []).append(side)
    cut = bool(slices)
    if by_keys and span:
        feats = sum(estimated_bytes(s.df.select(*s.keys, s.ts, *s.columns)) for g in by_keys.values() for s in g)
        cut = cut or n * row_bytes(entity) + feats > ONE_TASK_BYTES
    for keys, group in by_keys.items():
        out = _window_join(out, probe, list(keys), group, ets, span, cut, slices)
    order = [*entity.columns]
    for side in todo:
        order += [*side.columns.values(), *([side.ts_as] if side.ts_as else [])]
    return out.select(*order)


def _use_intervals(n: int | None, entity: DataFrame, side: Side, strategy: str) -> bool:
    if strategy not in ("auto", "window", "broadcast"):
        raise ValueError(f"unknown strategy {strategy!r}")
    limit = broadcast_limit(side.df.sparkSession)
    if strategy == "window" or n is None or not limit:
        return False
    if strategy == "auto" and n * row_bytes(entity) <= ONE_TASK_BYTES:
        return False
    # an estimate of a join or of compressed files says little, so rows are counted and
    # measured, up to as many as may be sent if they are narrow; a lookup walks the rows
    # of its key, so a long history is better sorted once
    rows = side.df.select(*dict.fromkeys([*side.keys, side.ts, *side.columns]))
    most = limit // (8 * len(rows.columns))
    per_key = rows.limit(most + 1).groupBy(*side.keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(row_width(rows)).alias("_width"))
    n, longest, width = (x or 0 for x in per_key.agg(F.sum("_n"), F.max("_n"), F.sum("_width")).first())
    return n <= most and width <= limit and (longest <= LONG_HISTORY or not side.keys)


def _interval_join(entity: DataFrame, side: Side, ets: str, span: list) -> DataFrame:
    """Give every feature row the time it is valid until, then look it up by broadcast.

    Validity intervals of one key are disjoint, so an entity row meets at most one.
    Time is cut into as many cells as a key has intervals on average, and a row looks
    only at the intervals of its key and cell, not at the key's whole history; cells
    at most double the intervals.
    """
    order = [side.ts, *([side.created] if side.created else [])]
    rows = side.df.dropna(subset=[*side.keys, side.ts]).withColumn("_tie", side.tie_break())
    # of rows with equal event time only the last has a non-empty interval
    until = F.lead(side.ts).over(W.partitionBy(*side.keys).orderBy(*order, "_tie"))
    spans = rows.select(
        *[F.col(k).alias(f"_key_{k}") for k in side.keys],
        F.struct(
            F.col(side.ts).alias("at"), F.struct(*[F.col(c).alias(o) for c, o in side.columns.items()]).alias("f")
        ).alias("_hit"),
        until.alias("_until"),
    )
    valid = (F.col("_hit.at") <= F.col(ets)) & (F.col("_until").isNull() | (F.col(ets) < F.col("_until")))
    keys = list(side.keys)
    each = spans.groupBy(*[f"_key_{k}" for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    cells = int(each.agg(F.avg("n")).first()[0] or 1)
    if not keys or cells > 1:
        keys.append("_cell")
        lo, hi = span[2] or 0, span[3] or 0
        cells = max(1, cells)
        width = max(1, (hi - lo) // cells)

        def cell(c: Column) -> Column:
            return F.floor((micros(c) - F.lit(lo)) / F.lit(width))

        last = F.lit((hi - lo) // width).cast("long")
        inside = F.sequence(F.greatest(cell(F.col("_hit.at")), F.lit(0).cast("long")), F.least(F.coalesce(cell(F.col("_until")), last), last))
        seen = (cell(F.col("_hit.at")) <= last) & (F.coalesce(cell(F.col("_until")), last) >= 0)
        spans = spans.where(seen).withColumn("_key__cell", F.explode(inside))
        entity = entity.withColumn("_cell", cell(F.col(ets)))
    for k in keys:
        valid = valid & (F.col(k) == F.col(f"_key_{k}"))
    joined = entity.join(F.broadcast(spans), valid, "left")
    return _emit(joined, side, ets, "_hit").drop("_hit", "_until", "_cell", *[f"_key_{k}" for k in keys])


def _emit(df: DataFrame, side: Side, ets: str, hit: str) -> DataFrame:
    live = F.col(f"{hit}.at").isNotNull()
    ttl = ttl_of(side)
    if ttl is not None:
        live = live & (F.col(f"{hit}.at") >= F.col(ets) - interval(ttl))
    new = {o: F.when(live, F.col(f"{hit}.f").getField(o)) for o in side.columns.values()}
    if side.ts_as:
        new[side.ts_as] = F.when(live, F.col(f"{hit}.at"))
    return df.withColumns(new)


def _prefilter(entity: DataFrame, side: Side, keys: list[str], span: list | None) -> DataFrame:
    """Drop feature rows no entity row can see, before they reach the shuffle.

    ``span`` is the entity time range; as literals the bounds reach the scan.
    """
    df = side.df.dropna(subset=[*keys, side.ts])
    if span is None or span[0] is None:
        return df
    ttl = ttl_of(side)
    df = df.filter(F.col(side.ts) <= F.lit(span[1]))
    if ttl is not None:
        df = df.filter(F.col(side.ts) >= F.lit(span[0] - ttl))
    if keys and estimated_bytes(entity.select(*keys)) <= broadcast_limit(df.sparkSession):
        df = df.join(entity.select(*keys), keys, "left_semi")
    return df


def _window_join(
    out: DataFrame, entity: DataFrame, keys: list[str], sides: list[Side], ets: str, span: list | None,
    cut: bool, slices: int | None,
) -> DataFrame:
    """Add the features of ``sides`` to ``out``.

    ``entity`` has the same keys and times as ``out``; planning reads it, so a
    chain of joins is not run again for it.
    """
    feats = [_prefilter(entity, s, keys, span) for s in sides]
    if not keys:  # features without an entity: one shared key, which slicing then splits
        one = {"_all": F.lit(1)}
        out, entity, feats = out.withColumns(one), entity.withColumns(one), [f.withColumns(one) for f in feats]
        keys = ["_all"]
    plan = TimeSlices(keys, None)
    if cut:
        time_type = entity.schema[ets].dataType
        probe = entity.select(*keys, F.col(ets).alias("_t"))
        for s, f in zip(sides, feats):
            probe = probe.unionByName(f.select(*keys, F.col(s.ts).cast(time_type).alias("_t")))
        plan = plan_time_slices(probe, keys, "_t", slices)
    entity = out
    time_type = entity.schema[ets].dataType
    rest = [c for c in entity.columns if c not in keys]
    left = entity.select(
        *keys,
        F.col(ets).alias("_t"),
        F.lit(1).alias("_side"),
        F.lit(None).cast("long").alias("_created"),
        F.lit(None).cast("long").alias("_tie"),
        F.struct(*rest).alias("_row"),
        content_hash(entity, rest).alias("_salt"),
    )
    salt = F.col("_salt")
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    left = plan.tag(left, micros(F.col("_t")), salt, entity_side=True)
    # rows without a key match nothing, so they may go anywhere
    left = left.withColumn("_slice", F.when(no_key, F.pmod(salt, F.lit(1024)).cast("int")).otherwise(F.col("_slice")))
    left = left.drop("_salt")
    stacked = left
    for i, (s, f) in enumerate(zip(sides, feats)):
        hit = F.struct(
            F.col(s.ts).cast(time_type).alias("at"),
            F.struct(*[F.col(c).alias(o) for c, o in s.columns.items()]).alias("f"),
        )
        right = f.select(
            *keys,
            F.col(s.ts).cast(time_type).alias("_t"),
            F.lit(0).alias("_side"),
            (micros(F.col(s.created)) if s.created else F.lit(None).cast("long")).alias("_created"),
            s.tie_break().alias("_tie"),
            hit.alias(f"_hit{i}"),
        )
        right = plan.tag(right, micros(F.col("_t")), F.col("_tie"), entity_side=False)
        stacked = stacked.unionByName(right, allowMissingColumns=True)
        if plan.hot is not None:
            stacked = stacked.unionByName(_seeds(right, plan, f"_hit{i}"), allowMissingColumns=True)
    w = (
        W.partitionBy(*keys, "_slice")
        .orderBy("_t", "_side", "_created", "_tie")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    out = stacked.withColumns(
        {f"_hit{i}": F.last(f"_hit{i}", ignorenulls=True).over(w) for i in range(len(sides))}
    ).filter(F.col("_side") == 1)
    out = out.select(*[k for k in keys if k != "_all"], "_row.*", *[f"_hit{i}" for i in range(len(sides))])
    for i, s in enumerate(sides):
        out = _emit(out, s, ets, f"_hit{i}")
    return out.drop("_all", *[f"_hit{i}" for i in range(len(sides))])


def _seeds(right: DataFrame, plan: TimeSlices, hit: str) -> DataFrame:
    """For each hot key and slice, the last feature row of the slices before it."""
    keys = plan.keys
    hot = right.join(F.broadcast(plan.hot.select(*keys)), keys, "left_semi")
    newest = W.partitionBy(*keys, "_slice").orderBy(F.desc("_t"), F.desc("_created"), F.desc("_tie"))
    tops = (
        hot.withColumn("_n", F.row_number().over(newest))
        .filter("_n = 1")
        .select(*keys, "_slice", F.struct("_t", "_created", "_tie", hit).alias("_top"))
    )
    every = plan.hot.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(plan.last))).alias("_slice"))
    so_far = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    order = F.struct("_top._t", "_top._created", "_top._tie")
    return (
        every.join(tops, [*keys, "_slice"], "left")
        .withColumn("_seed", F.max_by("_top", order).over(so_far))
        .filter("_seed is not null")
        .select(
            *keys,
            "_slice",
            F.col("_seed._t").alias("_t"),
            F.lit(0).alias("_side"),
            F.col("_seed._created").alias("_created"),
            F.col("_seed._tie").alias("_tie"),
            F.col(f"_seed.{hit}").alias(hit),
        )
    )


def entity_time_column(df: DataFrame, default: str = "event_timestamp") -> str:
    """The entity frame's time column: the default name, else the only timestamp."""
    if default in df.columns:
        return default
    times = [f.name for f in df.schema if f.dataType.typeName() in ("timestamp", "timestamp_ntz")]
    if len(times) != 1:
        raise ValueError(f"no {default!r} column and {len(times)} timestamp columns to choose from")
    return times[0]


def union_entities(sides: list[Side], start: object, end: object, with_time: str | None = None) -> DataFrame:
    """Distinct keys (and event times, when named) seen by any view in [start, end].

    Keys a view lacks are null in its rows.
    """
    out = None
    for s in sides:
        seen = s.df.filter(F.col(s.ts).between(F.lit(start), F.lit(end)))
        cols = [F.col(k) for k in s.keys] + ([F.col(s.ts).alias(with_time)] if with_time else [])
        part = seen.select(*cols).distinct()
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.distinct() if len(sides) > 1 else out


def retrieval_start(sides: list[Side], end, start=None):
    """Given start, else end minus the longest time to live, else 30 days before end."""
    if start is not None:
        return start
    ttls = [t for t in map(ttl_of, sides) if t]
    return end - (max(ttls) if ttls else timedelta(days=30))


def entityless_join(
    sides: list[Side], end, start=None, ets: str = "entity_ts", mode: str = "end", **how
) -> DataFrame:
    """Retrieval without an entity frame.

    ``end``: every key seen in the range, as of the end date.
    ``all_timestamps``: every observed (key, event time) in the range.
    """
    start = retrieval_start(sides, end, start)
    if mode == "end":
        entity = union_entities(sides, start, end).withColumn(ets, F.lit(end).cast(sides[0].df.schema[sides[0].ts].dataType))
        return asof_join(entity, sides, ets, **how)
    if mode != "all_timestamps":
        raise ValueError(f"unknown mode {mode!r}")
    entity = union_entities(sides, start, end, with_time=ets)
    ranged = [replace(s, df=s.df.filter(F.col(s.ts).between(F.lit(start), F.lit(end)))) for s in sides]
    return asof_join(entity, ranged, ets, **how)
