"""Equi-joins: views with views, aggregates, labels, and batch lookups."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def join_views(views: dict[str, DataFrame], keys: list[str], how: str = "left") -> DataFrame:
    """Join views on their keys; other columns are named ``view__column``."""
    out = None
    for name, df in views.items():
        named = df.select(*keys, *[F.col(c).alias(f"{name}__{c}") for c in df.columns if c not in keys])
        out = named if out is None else out.join(named, keys, how)
    if out is None:
        raise ValueError("nothing to join")
    return out


def join_aggregates(entity: DataFrame, aggregated: DataFrame, keys: list[str]) -> DataFrame:
    """Attach already aggregated features to every entity row; no time logic."""
    return entity.join(aggregated, keys, "left")


def attach_label(features: DataFrame, labels: DataFrame, keys: list[str], ts: str, label: str) -> DataFrame:
    """Bring the label back on keys and time."""
    return features.join(labels.select(*keys, ts, label), [*keys, ts], "left")


# The status names a lookup reports.
PRESENT, NOT_FOUND, OUTSIDE_MAX_AGE = "PRESENT", "NOT_FOUND", "OUTSIDE_MAX_AGE"


def lookup(
    latest: DataFrame,
    requests: DataFrame,
    keys: list[str],
    features: list[str],
    ts: str,
    now: datetime,
    ttl: timedelta | None = None,
) -> DataFrame:
    """Answer a batch of key lookups against a latest-value table.

    Adds each feature with ``feature__status``: NOT_FOUND for an unknown key or a
    null value, OUTSIDE_MAX_AGE for a value older than ``ttl`` in whole seconds at
    ``now`` (the value is still given), else PRESENT. Repeated keys are each
    answered; the join carries them, and adaptive execution splits a key that is
    asked for very often.
    """
    stored = latest.select(*keys, *features, F.col(ts).alias("_at"))
    out = requests.join(stored, keys, "left")
    stale = F.lit(False)
    if ttl and ttl.total_seconds() > 0:
        age = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("_at").cast("timestamp"))
        stale = age > int(ttl.total_seconds())
    cols = [*requests.columns]
    for f in features:
        status = F.when(F.col(f).isNull(), NOT_FOUND).when(stale, OUTSIDE_MAX_AGE).otherwise(PRESENT)
        cols += [F.col(f), status.alias(f"{f}__status")]
    return out.select(*cols, F.col("_at").alias(ts))
