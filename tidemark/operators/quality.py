"""Declarative data checks, profiles, schema checks and remediation."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, NumericType, StringType, StructType

from ..functions.columns import is_json
from ..session import fits_one_task
from .aggregate import column_stats, numeric_columns
from .joins import NOT_FOUND, PRESENT
from .latest import in_range


@dataclass(frozen=True)
class Check:
    """One expectation about a column.

    Kinds: ``exists``, ``not_null``, ``between``, ``in_set``, ``distinct_in_set``,
    ``min_between``, ``max_between``. ``mostly`` is the share of evaluated values
    that must pass.
    """

    kind: str
    column: str
    low: float | None = None
    high: float | None = None
    values: tuple = ()
    mostly: float = 1.0


RESULT_COLUMNS = (
    "kind", "column_name", "success", "element_count", "missing_count",
    "unexpected_count", "unexpected_percent", "observed_value",
)


def _within(value: Column, low, high) -> Column:
    ok = F.lit(True)
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return ok


def _result(check: Check, present: bool) -> Column:
    """The check's row as one struct of aggregates."""
    total = F.count(F.lit(1))
    nothing = F.lit(None).cast("double")
    if not present:
        missing, bad, ok, seen = F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(False), nothing
        percent = nothing
    else:
        col = F.col(check.column)
        missing = F.count_if(col.isNull())
        filled = F.count(col)
        bad, seen = F.lit(0).cast("long"), nothing
        base = filled
        if check.kind == "exists":
            ok = F.lit(True)
        elif check.kind == "not_null":
            bad, base = missing, total
        elif check.kind == "between":
            bad = F.count_if(col.isNotNull() & ~_within(col, check.low, check.high))
        elif check.kind in ("in_set", "distinct_in_set"):
            bad = F.count_if(col.isNotNull() & ~col.isin(*check.values))
        elif check.kind in ("min_between", "max_between"):
            seen = (F.min(col) if check.kind == "min_between" else F.max(col)).cast("double")
            ok = F.coalesce(_within(seen, check.low, check.high), F.lit(False))
        else:
            raise ValueError(f"unknown check {check.kind!r}")
        percent = F.when(base > 0, F.lit(100.0) * bad / base).otherwise(F.lit(0.0))
        if check.kind == "distinct_in_set":
            ok = bad == 0
        elif check.kind in ("not_null", "between", "in_set"):
            ok = F.when(base == 0, F.lit(True)).otherwise((base - bad) / base >= check.mostly)
    parts = (F.lit(check.kind), F.lit(check.column), ok, total, missing, bad, percent, seen)
    return F.struct(*[p.alias(n) for p, n in zip(parts, RESULT_COLUMNS)])


def validate(df: DataFrame, suite: list[Check]) -> DataFrame:
    """One row per check; the whole suite is a single aggregate over the data."""
    results = [_result(c, c.column in df.columns).alias(f"c{i}") for i, c in enumerate(suite)]
    return (
        df.agg(*results)
        .select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(suite))])).alias("r"))
        .select("r.*")
    )


def profile_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column: row count, null share, minimum, maximum, mean; one pass."""
    columns = columns or numeric_columns(df)
    per_column = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count(F.lit(1)).alias("row_count"),
            (F.count_if(F.col(c).isNull()) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("null_share"),
            F.min(c).cast("double").alias("min_value"),
            F.max(c).cast("double").alias("max_value"),
            F.avg(c).alias("mean_value"),
        ).alias(c)
        for c in columns
    ]
    return df.agg(*per_column).select(F.explode(F.array(*columns)).alias("p")).select("p.*")


def profile(
    df: DataFrame, columns: list[str] | None = None, max_set: int = 20, tolerance: float = 0.0
) -> list[Check]:
    """Learn a suite from a reference dataset (runs two jobs).

    Numbers get bounds, columns with at most ``max_set`` values a value set, every
    column its null share. Values are gathered only for columns whose estimated
    distinct count is near the limit, so the gathered sets stay small.
    """
    columns = columns or df.columns
    numeric = set(numeric_columns(df))
    first = df.agg(
        *[F.approx_count_distinct(c, 0.02).alias(f"d_{c}") for c in columns],
        *[F.avg(F.col(c).isNull().cast("int")).alias(f"n_{c}") for c in columns],
        *[F.min(c).alias(f"lo_{c}") for c in columns if c in numeric],
        *[F.max(c).alias(f"hi_{c}") for c in columns if c in numeric],
    ).first()
    small = [c for c in columns if first[f"d_{c}"] <= 2 * max_set]
    sets = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in small]).first() if small else {}
    suite = []
    for c in columns:
        share = 1.0 - (first[f"n_{c}"] or 0.0)
        suite.append(Check("not_null", c, mostly=max(share - tolerance, 0.0)))
        if c in numeric and first[f"lo_{c}"] is not None:
            suite.append(Check("between", c, float(first[f"lo_{c}"]), float(first[f"hi_{c}"]), mostly=1.0 - tolerance))
        if c in small and 0 < len(sets[c]) <= max_set:
            suite.append(Check("in_set", c, values=tuple(sets[c]), mostly=1.0 - tolerance))
    return suite


Profiler = Callable[[DataFrame], list[Check]]


class ValidationError(ValueError):
    """Raised by ``require`` with the failed rows."""


def require(results: DataFrame) -> None:
    """Raise when a check failed; reads the (suite-sized) result table."""
    failed = results.filter(~F.col("success")).collect()
    if failed:
        raise ValidationError("; ".join(f"{r['kind']}({r['column_name']})" for r in failed))


def observed(df: DataFrame, suite: list[Check]) -> tuple[DataFrame, Observation]:
    """``df`` with the suite's results gathered by the run that writes its rows.

    A stage that is run again after a lost executor counts its rows again, which can
    move a share but not make a value that is out of bounds.
    """
    found = Observation()
    results = [_result(c, c.column in df.columns).alias(f"c{i}") for i, c in enumerate(suite)]
    return df.observe(found, *results), found


def require_observed(found: Observation) -> None:
    """Raise when a check failed, once the run that gathers the results has ended."""
    failed = [r for r in found.get.values() if not r["success"]]
    if failed:
        raise ValidationError("; ".join(f"{r['kind']}({r['column_name']})" for r in failed))


def validate_against(df: DataFrame, reference: DataFrame, profiler: Profiler = profile) -> DataFrame:
    return validate(df, profiler(reference))


def _compatible(want, have) -> bool:
    if want == have or (isinstance(want, NumericType) and isinstance(have, NumericType)):
        return True
    if isinstance(want, ArrayType) and isinstance(have, ArrayType):
        return _compatible(want.elementType, have.elementType)
    return isinstance(want, (MapType, StructType)) and isinstance(have, (MapType, StructType))


def check_schema(df: DataFrame, expected: StructType, json_columns: list[str] = ()) -> DataFrame:
    """Schema findings: a missing column or bad JSON is an error, another type a warning."""
    spark = df.sparkSession
    rows = []
    for f in expected:
        if f.name not in df.columns:
            rows.append(("error", f.name, "missing column", 1))
        elif not _compatible(f.dataType, df.schema[f.name].dataType):
            have = df.schema[f.name].dataType.simpleString()
            rows.append(("warning", f.name, f"expected {f.dataType.simpleString()}, found {have}", 1))
    out = spark.createDataFrame(rows, "level string, column_name string, message string, n long")
    texts = [c for c in json_columns if c in df.columns and isinstance(df.schema[c].dataType, StringType)]
    if texts:
        bad = df.agg(
            *[
                F.struct(
                    F.lit("error").alias("level"),
                    F.lit(c).alias("column_name"),
                    F.lit("malformed JSON").alias("message"),
                    F.count_if(~is_json(c)).alias("n"),
                ).alias(c)
                for c in texts
            ]
        )
        found = bad.select(F.explode(F.array(*texts)).alias("r")).select("r.*").filter("n > 0")
        out = out.unionByName(found)
    return out


def json_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column: rows, nulls, well-formed and malformed values."""
    per_column = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(F.col(c).isNull()).alias("null_count"),
            F.count_if(is_json(c)).alias("valid_count"),
            F.count_if(~is_json(c)).alias("invalid_count"),
        ).alias(c)
        for c in columns
    ]
    return df.agg(*per_column).select(F.explode(F.array(*columns)).alias("r")).select("r.*")


def with_status(df: DataFrame, columns: list[str], ts: str | None = None) -> DataFrame:
    """Add ``column__status`` and, given a time column, ``column__timestamp``."""
    cols = {}
    for c in columns:
        if ts:
            cols[f"{c}__timestamp"] = F.col(ts)
        cols[f"{c}__status"] = F.when(F.col(c).isNull(), NOT_FOUND).otherwise(PRESENT)
    return df.withColumns(cols)


def mask_not_found(df: DataFrame) -> DataFrame:
    """Null every value whose status column says it was not found."""
    named = [c for c in df.columns if f"{c}__status" in df.columns]
    return df.withColumns({c: F.when(F.col(f"{c}__status") != NOT_FOUND, F.col(c)) for c in named})


def validate_log(log: DataFrame, ts: str, start, end, suite: list[Check]) -> DataFrame:
    """Check logged features whose log time lies in [start, end]."""
    return validate(mask_not_found(in_range(log, ts, start, end)), suite)


def remediate(df: DataFrame, critical: list[str]) -> DataFrame:
    """Nulls in critical numeric columns become 0."""
    return df.fillna(0, subset=[c for c in critical if c in numeric_columns(df)])


def constant_columns(df: DataFrame) -> DataFrame:
    """Numeric columns with at most one distinct value; min = max says so in one pass."""
    columns = numeric_columns(df)
    if fits_one_task(df):
        return column_stats(df, columns).filter("is_constant").select("column_name")
    flags = df.agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns])
    names = F.array(*[F.when(F.col(c), F.lit(c)) for c in columns])
    return flags.select(F.explode(F.array_compact(names)).alias("column_name"))


def check_vector(df: DataFrame, column: str, length: int) -> DataFrame:
    """How many vectors there are and how many differ from the declared length."""
    size = F.size(column)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col(column).isNull() | (size != length)).alias("bad_count"),
    )
