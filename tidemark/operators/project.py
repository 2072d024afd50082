"""Projections and row-wise predicates."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from ..functions.columns import as_col, dataset_parts, safe_ratio
from .asof import interval


def apply_field_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename source columns to feature names; the rest stays as it is."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def project(df: DataFrame, refs: list[str], full_names: bool = False, keep: list[str] = ()) -> DataFrame:
    """Select ``view:feature`` references, named ``feature`` or ``view__feature``."""
    cols = []
    for ref in refs:
        view, _, feature = ref.partition(":")
        if not feature:
            raise ValueError(f"feature reference {ref!r} is not view:feature")
        full = f"{view}__{feature}"
        source = full if full in df.columns else feature
        cols.append(F.col(source).alias(full if full_names else feature))
    return df.select(*keep, *cols)


def filter_expr(df: DataFrame, expr: str | Column | None) -> DataFrame:
    return df if expr is None else df.filter(expr)


def fresh_only(df: DataFrame, ts: str, ttl: timedelta, now: datetime) -> DataFrame:
    """Rows no older than ``ttl`` at the given time."""
    return df.filter(F.col(ts) >= F.lit(now) - interval(ttl))


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cast to double; text that is no number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def to_utc(df: DataFrame, column: str, zone: str | None = None) -> DataFrame:
    """Read a time column as UTC: text and naive times mean UTC unless ``zone`` is given."""
    kind = df.schema[column].dataType.typeName()
    at = F.try_to_timestamp(F.col(column)) if kind == "string" else F.col(column).cast("timestamp")
    if zone:
        at = F.to_utc_timestamp(at, zone)
    return df.withColumn(column, at)


def derive_ratios(df: DataFrame, ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """Add ``name = numerator / denominator`` columns, safe for zero and infinity."""
    return df.withColumns({name: safe_ratio(n, d) for name, (n, d) in ratios.items()})


def jsonify_complex(df: DataFrame, target: StructType) -> DataFrame:
    """Serialise map, struct and array columns whose target type is text."""
    complex_types = (MapType, StructType, ArrayType)
    cols = {
        f.name: F.to_json(f.name)
        for f in df.schema
        if isinstance(f.dataType, complex_types)
        and f.name in target.names
        and isinstance(target[f.name].dataType, StringType)
    }
    return df.withColumns(cols) if cols else df


def encode_fixed(df: DataFrame, codes: dict[str, dict[str, int]], numeric: list[str] = ()) -> DataFrame:
    """Categories to fixed codes, unknown and null to 0; null numbers to 0."""
    cols = {}
    for c, table in codes.items():
        pairs = [F.lit(x) for kv in table.items() for x in kv]
        found = F.create_map(*pairs)[F.col(c).cast("string")] if pairs else F.lit(None)
        cols[c] = F.coalesce(found.cast("double"), F.lit(0.0))
    for c in numeric:
        cols[c] = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return df.withColumns(cols)


def split_uri(df: DataFrame, column: str, namespace: str = "namespace", name: str = "name") -> DataFrame:
    parts = dataset_parts(column)
    return df.withColumns({namespace: parts["namespace"], name: parts["name"]})


def conform(df: DataFrame, target: StructType) -> DataFrame:
    """Exact column-set check, then reorder and cast to the target types."""
    missing = sorted(set(target.names) - set(df.columns))
    extra = sorted(set(df.columns) - set(target.names))
    if missing or extra:
        raise ValueError(f"columns differ from the target: missing {missing}, unexpected {extra}")
    return jsonify_complex(df, target).select(*[_cast(f.name, f.dataType) for f in target])


def _cast(name: str, to: DataType) -> Column:
    return as_col(name).cast(to).alias(name)
