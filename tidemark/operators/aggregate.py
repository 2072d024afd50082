"""Grouped, time-window and whole-column aggregates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..session import fits_one_task

FUNCTIONS = {
    "sum": F.sum,
    "count": F.count,
    "mean": F.avg,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "stddev": F.stddev_samp,
    "var": F.var_samp,
    "variance": F.var_samp,
    "nunique": F.count_distinct,
}

# Values strictly inside a median bracket that one task may sort.
BRACKET_ROWS = 100_000


@dataclass(frozen=True)
class Aggregation:
    """A column, a function and, for time windows, their length and slide."""

    column: str
    function: str
    time_window: timedelta | None = None
    slide_interval: timedelta | None = None
    name: str | None = None

    def __post_init__(self):
        if self.function not in FUNCTIONS:
            raise ValueError(f"unknown aggregate {self.function!r}")

    @property
    def output(self) -> str:
        if self.name:
            return self.name
        tail = f"_{seconds(self.time_window)}s" if self.time_window else ""
        return f"{self.function}_{self.column}{tail}"

    def expr(self) -> Column:
        return FUNCTIONS[self.function](self.column).alias(self.output)


def seconds(delta: timedelta) -> int:
    return int(delta.total_seconds())


def aggregate(df: DataFrame, keys: list[str], specs: list[Aggregation], ts: str | None = None) -> DataFrame:
    """Group by keys and, where the specs carry a time window, by that window.

    Each distinct (window, slide) is one aggregate; several are outer joined on
    keys and window end.
    """
    windows = list(dict.fromkeys((s.time_window, s.slide_interval) for s in specs))
    if windows == [(None, None)]:
        return df.groupBy(*keys).agg(*[s.expr() for s in specs])
    if any(w is None for w, _ in windows):
        raise ValueError("give all aggregations a time window, or none")
    if ts is None:
        raise ValueError("windowed aggregations need the time column")
    out = None
    for window, slide in windows:
        span = F.window(F.col(ts), f"{seconds(window)} seconds", f"{seconds(slide)} seconds" if slide else None)
        mine = [s.expr() for s in specs if (s.time_window, s.slide_interval) == (window, slide)]
        part = df.groupBy(*keys, span.alias("_w")).agg(*mine)
        part = part.withColumns({"window_end": F.col("_w.end")}).drop("_w") if len(windows) > 1 else (
            part.withColumns({"window_start": F.col("_w.start"), "window_end": F.col("_w.end")}).drop("_w")
        )
        out = part if out is None else out.join(part, [*keys, "window_end"], "full")
    return out


def ts_range(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))


def output_stats(df: DataFrame, text: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("size"),
    )


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Positive class weight: negatives / positives, two decimals."""
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    return df.agg(
        pos.alias("positives"),
        neg.alias("negatives"),
        F.round(neg / F.nullif(pos, F.lit(0)), 2).alias("pos_weight"),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: null count, distinct count, constant flag.

    For big inputs each column's distinct count is planned on its own: several in
    one aggregate would multiply every row by the number of columns.
    """
    columns = columns or df.columns
    if fits_one_task(df):
        one_pass = df.agg(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.count_if(F.col(c).isNull()).alias("null_count"),
                    F.count_distinct(c).alias("distinct_count"),
                ).alias(c)
                for c in columns
            ]
        )
        stats = one_pass.select(F.explode(F.array(*columns)).alias("s")).select("s.*")
    else:
        stats = None
        for c in columns:
            per_value = df.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
            part = per_value.agg(
                F.lit(c).alias("column_name"),
                F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("_n"))), F.lit(0)).alias("null_count"),
                F.count(c).alias("distinct_count"),
            )
            stats = part if stats is None else stats.unionByName(part)
    return stats.withColumn("is_constant", F.col("distinct_count") <= 1)


def medians(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """One row holding the median of every column (mean of the middle two)."""
    if not exact:
        return df.agg(*[F.percentile_approx(c, 0.5, 10000).cast("double").alias(c) for c in columns])
    if fits_one_task(df):
        return df.agg(*[F.percentile(F.col(c).cast("double"), F.lit(0.5)).alias(c) for c in columns])
    found = exact_medians(df, columns)
    return df.sparkSession.range(1).select(*[F.lit(found[c]).cast("double").alias(c) for c in columns])


def exact_medians(df: DataFrame, columns: list[str], bracket_rows: int = BRACKET_ROWS) -> dict[str, float | None]:
    """Exact medians by narrowing a bracket around the middle; scans, no shuffle.

    Each pass reads the columns once for all of them, counts what lies below the
    bracket and narrows it to the approximate quantiles just around the middle.
    Once few values lie strictly inside, they are sorted and the middle is read.
    """
    accuracy = 10_000
    first = df.agg(
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in columns],
        *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in columns],
    ).first()
    state = {c: (first[f"n_{c}"], first[f"lo_{c}"], first[f"hi_{c}"]) for c in columns}
    done: dict[str, float | None] = {}
    open_ = {}
    for c, (n, lo, hi) in state.items():
        if n == 0 or lo == hi:
            done[c] = lo if n else None
        else:
            open_[c] = (n, lo, hi)
    while open_:
        aggs = []
        for c, (n, lo, hi) in open_.items():
            v = F.col(c).cast("double")
            inside = (v > lo) & (v < hi)
            aggs += [
                F.count_if(v < lo).alias(f"below_{c}"),
                F.count_if(v == lo).alias(f"at_lo_{c}"),
                F.count_if(inside).alias(f"inside_{c}"),
            ]
        counts = df.agg(*aggs).first()
        sort_now, narrow = {}, {}
        for c, (n, lo, hi) in open_.items():
            below, at_lo, inside = (counts[f"{k}_{c}"] for k in ("below", "at_lo", "inside"))
            target = sort_now if inside <= bracket_rows else narrow
            target[c] = (n, lo, hi, below, at_lo, inside)
        if sort_now:
            picked = df.agg(
                *[
                    F.sort_array(
                        F.collect_list(F.when((F.col(c).cast("double") > lo) & (F.col(c).cast("double") < hi), F.col(c).cast("double")))
                    ).alias(c)
                    for c, (_, lo, hi, *_rest) in sort_now.items()
                ]
            ).first()
            for c, (n, lo, hi, below, at_lo, inside) in sort_now.items():
                middle = []
                for k in {(n - 1) // 2, n // 2}:
                    k -= below + at_lo
                    middle.append(lo if k < 0 else picked[c][k] if k < inside else hi)
                done[c] = sum(middle) / len(middle)
        open_ = {}
        if narrow:
            marks = []
            for c, (n, lo, hi, below, at_lo, inside) in narrow.items():
                # position of the middle among the values strictly inside
                at = ((n - 1) / 2 - below - at_lo) / inside
                v = F.col(c).cast("double")
                p = [min(max(at - 2 / accuracy, 0.0), 1.0), min(max(at + 2 / accuracy, 0.0), 1.0)]
                marks.append(F.percentile_approx(F.when((v > lo) & (v < hi), v), p, accuracy).alias(c))
            quantiles = df.agg(*marks).first()
            for c, (n, lo, hi, below, at_lo, inside) in narrow.items():
                low, high = quantiles[c]
                rank = (n - 1) / 2 - below - at_lo
                # the middle may sit on the old edge itself
                low = lo if rank <= 0 or rank < 3 * inside / accuracy else low
                high = hi if rank >= inside - 1 or rank > inside - 3 * inside / accuracy else high
                open_[c] = (n, low, high)
                if low == high:
                    done[c] = low
                    del open_[c]
    return done


def impute_median(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Replace nulls by the column's median; all medians are found first, as one row."""
    mid = medians(df, columns, exact).first()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(mid[c]).cast("double")) for c in columns})


def minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scale to [0, 1]; a constant column becomes 0. All ranges are found first, as one row."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = {}
    for c in columns:
        lo, hi = ends[f"lo_{c}"], ends[f"hi_{c}"]
        flat = lo is None or not hi - lo > 0
        scaled[c] = F.lit(0.0) if flat else (F.col(c) - F.lit(lo)) / F.lit(hi - lo)
    return df.withColumns(scaled)
