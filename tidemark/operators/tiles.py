"""Sliding-window aggregates from per-hop partial aggregates ("tiles").

Raw rows are reduced once to one tile per key and hop, so window size no longer
matters for the work: every window over every aggregate is a range frame over
hop numbers in a single window operator.
"""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import written
from .aggregate import Aggregation
from .skew import micros

# Partials a function needs, and how partials of the same kind merge.
PARTIALS = {
    "sum": ("sum",),
    "count": ("count",),
    "min": ("min",),
    "max": ("max",),
    "mean": ("sum", "count"),
    "avg": ("sum", "count"),
    "std": ("count", "mean", "m2"),
    "stddev": ("count", "mean", "m2"),
    "var": ("count", "mean", "m2"),
    "variance": ("count", "mean", "m2"),
}
# Windows of up to this many hops are merged row by row.
SHORT_WINDOW = 8
MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "dev": F.sum, "dev_sq": F.sum}
# Within one key, mean and m2 (the sum of squared distances from the mean) become sums of
# distances from one value of the key, which add up and do not cancel for large means.
SHIFTED = {"mean": "dev", "m2": "dev_sq"}


def _micros(delta: timedelta) -> int:
    return round(delta.total_seconds() * 1_000_000)


def _needed(specs: list[Aggregation]) -> list[tuple[str, str]]:
    return list(dict.fromkeys((s.column, p) for s in specs for p in PARTIALS[s.function]))


def build_tiles(
    df: DataFrame, keys: list[str], specs: list[Aggregation], ts: str, hop: timedelta
) -> DataFrame:
    """One row per key and hop with the partials the specs need.

    ``hop`` counts hops since the epoch; the partial of kind p over column c is
    named ``c__p``. Tiles of different batches merge with ``merge_tiles``.
    """
    make = {
        "sum": lambda c: F.sum(F.col(c).cast("double")),
        "count": F.count,
        "mean": lambda c: F.avg(F.col(c).cast("double")),
        "m2": lambda c: F.var_pop(F.col(c).cast("double")) * F.count(c),
        "min": F.min,
        "max": F.max,
    }
    size = F.lit(_micros(hop))
    at = F.call_function("div", micros(F.col(ts)) - F.pmod(micros(F.col(ts)), size), size)
    return df.groupBy(*keys, at.alias("hop")).agg(
        *[make[p](c).alias(f"{c}__{p}") for c, p in _needed(specs)]
    )


def merge_tiles(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Combine several tiles of the same key and hop."""
    partials = [c for c in tiles.columns if c not in (*keys, "hop")]
    moments = {c.rsplit("__", 1)[0] for c in partials if c.endswith("__m2")}
    merged = [MERGE[_kind(c)](c).alias(c) for c in partials if _kind(c) in MERGE]
    out = tiles.groupBy(*keys, "hop").agg(*merged, *[_moments(c).alias(f"_m_{c}") for c in moments])
    spread = {f"{c}__{p}": F.col(f"_m_{c}")[p] for c in moments for p in ("mean", "m2")}
    return out.withColumns(spread).select(*keys, "hop", *partials)


def _kind(partial: str) -> str:
    return partial.rsplit("__", 1)[1]


def _moments(column: str) -> Column:
    """Aggregate: count, mean and m2 of several tiles of a group, merged pairwise.

    The tiles of a group are those of one hop and its batches.
    """
    part = F.struct(*[F.col(f"{column}__{p}").cast("double").alias(p) for p in ("count", "mean", "m2")])
    used = F.col(f"{column}__count") > 0
    parts = F.collect_list(F.when(used, part))

    def merge(a: Column, b: Column) -> Column:
        n, d = a["count"] + b["count"], b["mean"] - a["mean"]
        return F.struct(
            n.alias("count"),
            (a["mean"] + d * b["count"] / n).alias("mean"),
            (a["m2"] + b["m2"] + d * d * a["count"] * b["count"] / n).alias("m2"),
        )

    return F.when(F.size(parts) > 0, F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.get(parts, F.lit(0)), merge))


# Rows of a filled grid per task, whose windows sort them several times.
GRID_ROWS = 200_000


def _dealt(tiles: DataFrame, keys: list[str], longest: int | None = None) -> DataFrame:
    """The tiles, kept, in as many parts as the rows need that they are about to be filled up to.

    A grid is many times its tiles, so the size of what is shuffled says little about a
    task's memory. ``longest`` is how many hops a tile makes at most, without it up to
    all there are.
    """
    tiles = written(tiles, "tiles")
    per_key = tiles.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("hop").alias("lo"), F.max("hop").alias("hi"))
    n, held, lo, hi = per_key.agg(F.count(F.lit(1)), F.sum("n"), F.min("lo"), F.max("hi")).first()
    filled = n * (hi - lo + 1) if n else 0
    if longest is not None:
        filled = min(filled, (held or 0) * (longest + 1))
    parts = math.ceil(filled / GRID_ROWS)
    return tiles.repartition(parts, *keys) if parts > 1 else tiles


def _span(tiles: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """Every key's own hops: from its first one on, as long as a window of ``longest`` hops holds a tile, and one more.

    The one more is where all windows have become empty; up to the next tile nothing
    changes any more. No hop lies after the newest of all tiles.
    """
    last = tiles.agg(F.max("hop")).scalar()
    after = F.lead("hop").over(W.partitionBy(*keys).orderBy("hop")) - 1
    stop = F.least(after, last, F.col("hop") + longest)  # ignores the null of a key's last tile
    partials = [c for c in tiles.columns if c not in (*keys, "hop")]
    spread = tiles.withColumn("_stop", stop).withColumn("_at", F.explode(F.sequence("hop", "_stop")))
    own = F.col("_at") == F.col("hop")
    return spread.select(*keys, F.col("_at").alias("hop"), *_own_partials(partials, own))


def _own_partials(partials: list[str], own: Column) -> list[Column]:
    """A tile's partials at its own hop; at others those of no rows."""
    return [
        (F.coalesce(F.when(own, F.col(p)), F.lit(0)) if MERGE.get(_kind(p)) is F.sum else F.when(own, F.col(p))).alias(p)
        for p in partials
    ]


def densify(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Fill every key's missing hops between the first and last hop of all tiles.

    A tile produces the empty hops up to its successor, so the grid needs no join.
    """
    return _grid(tiles, keys).drop("_index")


def _grid(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """The dense grid with each hop's position in it."""
    ends = tiles.agg(F.struct(F.min("hop").alias("lo"), F.max("hop").alias("hi"))).scalar()
    w = W.partitionBy(*keys).orderBy("hop")
    first = F.row_number().over(w) == 1
    start = F.when(first, ends["lo"]).otherwise(F.col("hop"))
    stop = F.coalesce(F.lead("hop").over(w) - 1, ends["hi"])
    partials = [c for c in tiles.columns if c not in (*keys, "hop")]
    spread = tiles.withColumn("_start", start).withColumn("_stop", stop)
    spread = spread.withColumn("_at", F.explode(F.sequence("_start", "_stop")))
    own = F.col("_at") == F.col("hop")
    return spread.select(
        *keys,
        F.col("_at").alias("hop"),
        (F.col("_at") - ends["lo"]).alias("_index"),
        *_own_partials(partials, own),
    )


def _combine(function: str, part: dict[str, Column]) -> Column:
    if function == "sum":
        return F.coalesce(part["sum"], F.lit(0.0))  # of no values
    if function in ("count", "min", "max"):
        return part[function]
    n = F.nullif(part["count"], F.lit(0))
    if function in ("mean", "avg"):
        return part["sum"] / n
    if "m2" in part:
        spread = part["m2"]
    else:
        spread = F.greatest(part["dev_sq"] - part["dev"] * part["dev"] / n, F.lit(0.0))
    var = F.when(part["count"] > 1, spread / F.nullif(part["count"] - 1, F.lit(0)))
    return F.sqrt(var) if function in ("std", "stddev") else var


def _back(spec: Aggregation, hop: timedelta) -> int:
    """How many hops the window of a spec spans."""
    if spec.time_window is None:
        raise ValueError(f"{spec.output} has no time window")
    if spec.time_window <= hop or _micros(spec.time_window) % _micros(hop):
        raise ValueError(f"window of {spec.output} must be a larger multiple of the hop")
    return _micros(spec.time_window) // _micros(hop)


def windowed_from_tiles(
    tiles: DataFrame,
    keys: list[str],
    specs: list[Aggregation],
    hop: timedelta,
    ts_as: str = "window_end",
    dense: bool = False,
) -> DataFrame:
    """The value of every spec over the window that ends where each tile ends.

    Each partial is merged once per window length. Long windows take constant work
    per row, on a dense grid (``_grid``, see ``_merge_dense``) and on a key's own tiles
    (``_merge_sparse``); a short one is a range frame over hop numbers.
    """
    needs = {s: [SHIFTED.get(p, p) for p in PARTIALS[s.function]] for s in specs}
    parts = list(dict.fromkeys((_back(s, hop), f"{s.column}__{p}") for s in specs for p in needs[s]))
    name = {part: f"_w{part[0]}_{part[1]}" for part in parts}
    out = _shifted(tiles, keys, specs)
    for hops in dict.fromkeys(h for h, _ in parts):
        mine = [c for h, c in parts if h == hops]
        if hops > SHORT_WINDOW:
            out = (_merge_dense if dense else _merge_sparse)(out, keys, hops, {c: name[hops, c] for c in mine})
        else:
            w = W.partitionBy(*keys).orderBy("hop").rangeBetween(-(hops - 1), 0)
            out = out.withColumns({name[hops, c]: MERGE[c.rsplit("__", 1)[1]](c).over(w) for c in mine})
    cols = [
        _combine(s.function, {p: F.col(name[_back(s, hop), f"{s.column}__{p}"]) for p in needs[s]}).alias(s.output)
        for s in specs
    ]
    end = F.timestamp_micros((F.col("hop") + 1) * F.lit(_micros(hop)))
    return out.select(*keys, end.alias(ts_as), *cols)


def _shifted(tiles: DataFrame, keys: list[str], specs: list[Aggregation]) -> DataFrame:
    """Adds, for columns whose spread is asked for, sums of distances from one mean of the key (see ``SHIFTED``)."""
    for c in dict.fromkeys(s.column for s in specs if "m2" in PARTIALS[s.function]):
        n, mean, m2 = (F.col(f"{c}__{p}") for p in ("count", "mean", "m2"))
        off = mean - F.first(mean, ignorenulls=True).over(W.partitionBy(*keys).orderBy("hop"))
        tiles = tiles.withColumn("_off", off).withColumns(
            {
                f"{c}__dev": F.coalesce(n * F.col("_off"), F.lit(0.0)),
                f"{c}__dev_sq": F.coalesce(m2 + n * F.col("_off") * F.col("_off"), F.lit(0.0)),
            }
        ).drop("_off")
    return tiles


def _merge_dense(tiles: DataFrame, keys: list[str], hops: int, columns: dict[str, str]) -> DataFrame:
    """Merge partials over the last ``hops`` rows of a dense grid, any length at the same cost.

    The grid is cut into blocks as long as the window, from its first hop on. A window then is the start
    of its own block up to the row plus the rest of the block before it behind the
    row ``hops`` earlier. Both are running merges within one block, so nothing
    grows with the history.
    """
    block = F.call_function("div", F.col("_index"), F.lit(hops))
    start = W.partitionBy(*keys, "_block").orderBy("hop").rowsBetween(W.unboundedPreceding, 0)
    rest = W.partitionBy(*keys, "_block").orderBy(F.desc("hop")).rowsBetween(W.unboundedPreceding, -1)
    along = W.partitionBy(*keys).orderBy("_block", "hop")  # the order ``start`` leaves behind
    merge = {c: MERGE[c.rsplit("__", 1)[1]] for c in columns}
    out = tiles.withColumn("_block", block)
    out = out.withColumns({f"_r_{c}": merge[c](c).over(rest) for c in columns})
    out = out.withColumns({f"_s_{c}": merge[c](c).over(start) for c in columns})
    out = out.withColumns({f"_r_{c}": F.lag(f"_r_{c}", hops).over(along) for c in columns})
    both = {}
    for c, to in columns.items():
        a, b = F.col(f"_s_{c}"), F.col(f"_r_{c}")
        if merge[c] is F.sum:
            both[to] = a + F.coalesce(b, F.lit(0))
        else:
            both[to] = (F.least if merge[c] is F.min else F.greatest)(a, b)  # both ignore nulls
    return out.withColumns(both).drop("_block", *[f"_{x}_{c}" for x in "rs" for c in columns])


def _merge_sparse(tiles: DataFrame, keys: list[str], hops: int, columns: dict[str, str]) -> DataFrame:
    """The same over a key's own tiles, whatever lies between them: linear in the tiles.

    Blocks are as long as the window and counted from hop zero. The rest of the block
    before is that of its first tile inside the window, found by one pass from the end
    over tiles and over the places where windows begin.
    """
    def block(at: Column) -> Column:
        return F.call_function("div", at - F.pmod(at, F.lit(hops)), F.lit(hops))

    merge = {c: MERGE[c.rsplit("__", 1)[1]] for c in columns}
    start = W.partitionBy(*keys, "_block").orderBy("hop").rowsBetween(W.unboundedPreceding, 0)
    rest = W.partitionBy(*keys, "_block").orderBy(F.desc("hop")).rowsBetween(W.unboundedPreceding, 0)
    out = tiles.withColumn("_block", block(F.col("hop")))
    out = out.withColumns({f"_r_{c}": merge[c](c).over(rest) for c in columns})
    out = out.withColumns({f"_s_{c}": merge[c](c).over(start) for c in columns})
    out = out.withColumn("_rest", F.struct(*[f"_r_{c}" for c in columns]))
    begins = F.col("hop") - (hops - 1)
    place = [F.struct(F.lit(1).alias("tile"), F.col("hop").alias("at")), F.struct(F.lit(0).alias("tile"), begins.alias("at"))]
    both = out.withColumn("_place", F.explode(F.array(*place)))
    both = both.withColumn("_part", block(F.col("_place.at")))
    back = W.partitionBy(*keys, "_part").orderBy(F.desc("_place.at"), F.desc("_place.tile")).rowsBetween(W.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_place.tile") == 1, F.col("_rest")), ignorenulls=True).over(back)
    both = both.withColumn("_found", found).where(F.col("_place.tile") == 0)
    before = F.when(F.col("_part") < F.col("_block"), F.col("_found"))  # else the window is the block
    merged = {}
    for c, to in columns.items():
        a, b = F.col(f"_s_{c}"), before[f"_r_{c}"]
        if merge[c] is F.sum:
            merged[to] = F.coalesce(a + b, a, b)
        else:
            merged[to] = (F.least if merge[c] is F.min else F.greatest)(a, b)  # both ignore nulls
    drop = ["_block", "_rest", "_place", "_part", "_found", *[f"_{x}_{c}" for x in "rs" for c in columns]]
    return both.withColumns(merged).drop(*drop)


def latest_from_tiles(
    tiles: DataFrame, keys: list[str], specs: list[Aggregation], hop: timedelta, ts_as: str = "window_end", dense: bool = True
) -> DataFrame:
    """The newest window of every key: one aggregate over the tiles, no grid and no earlier windows.

    ``dense`` ends every key's window at the newest hop of all; else each at its own.
    """
    if dense:
        tiles = tiles.withColumn("_last", tiles.agg(F.max("hop")).scalar())
    else:
        tiles = tiles.withColumn("_last", F.max("hop").over(W.partitionBy(*keys)))
    tiles = _shifted(tiles, keys, specs)
    aggs, cols = {}, []
    for s in specs:
        hops = _back(s, hop)
        inside = F.col("hop") > F.col("_last") - hops
        part = {}
        for p in [SHIFTED.get(p, p) for p in PARTIALS[s.function]]:
            aggs[f"_w{hops}_{s.column}__{p}"] = MERGE[p](F.when(inside, F.col(f"{s.column}__{p}")))
            part[p] = F.col(f"_w{hops}_{s.column}__{p}")
            part[p] = F.coalesce(part[p], F.lit(0)) if p == "count" else part[p]
        cols.append(_combine(s.function, part).alias(s.output))
    out = tiles.groupBy(*keys, "_last").agg(*[a.alias(n) for n, a in aggs.items()])
    end = F.timestamp_micros((F.col("_last") + 1) * F.lit(_micros(hop)))
    return out.select(*keys, end.alias(ts_as), *cols)


def aggregate_tiled(
    df: DataFrame,
    keys: list[str],
    specs: list[Aggregation],
    ts: str,
    hop: timedelta = timedelta(minutes=5),
    dense: bool | str = True,
    latest_only: bool = False,
    ts_as: str = "window_end",
) -> DataFrame:
    """All windows of all specs in one result, one row per key and tile end.

    ``dense`` also gives the tile ends without own data: all there are among all keys,
    or with ``"span"`` those of a key at which some window still holds a row of it,
    and the first at which none does. ``latest_only`` keeps the newest tile end per key.
    """
    tiles = build_tiles(df, keys, specs, ts, hop)
    if latest_only:
        return latest_from_tiles(tiles, keys, specs, hop, ts_as, bool(dense))
    if dense == "span":
        longest = max(_back(s, hop) for s in specs)
        return windowed_from_tiles(_span(_dealt(tiles, keys, longest), keys, longest), keys, specs, hop, ts_as)
    if dense:
        tiles = _grid(_dealt(tiles, keys), keys)
    return windowed_from_tiles(tiles, keys, specs, hop, ts_as, dense)
