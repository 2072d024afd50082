"""First and latest row per key.

``row_number() = 1`` lets Spark keep one row per key in every map task before the
shuffle (a partial group limit), so a hot key never travels whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank_as: str | None = None) -> DataFrame:
    """The first ``n`` rows per key in ``order``; over the whole frame without keys."""
    if not keys:
        return df.orderBy(*order).limit(n)
    name = rank_as or "_rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank_as else kept.drop(name)


def first_per_key(df: DataFrame, keys: list[str], ts: str, tie: list[str] = ()) -> DataFrame:
    return top_rows(df, keys, [F.asc(ts), *map(F.asc, tie)])


def latest_per_key(
    df: DataFrame, keys: list[str], ts: str, created: str | None = None, tie: list[str] = ()
) -> DataFrame:
    """Newest event time per key; the later ``created`` wins among equal event times."""
    order = [F.desc(ts)] + ([F.desc(created)] if created else []) + [F.desc(t) for t in tie]
    return top_rows(df, keys, order)


def in_range(
    df: DataFrame,
    ts: str,
    start=None,
    end=None,
    partition: str | None = None,
    partition_format: str = "yyyy-MM-dd",
) -> DataFrame:
    """Keep rows with start <= ts <= end; either end may be missing.

    ``partition`` names a date partition column stored as text in
    ``partition_format``; the same bounds on it let Spark skip whole partitions.
    """
    for bound, sign in ((start, ">="), (end, "<=")):
        if bound is None:
            continue
        at = F.lit(bound)
        df = df.filter(F.col(ts) >= at if sign == ">=" else F.col(ts) <= at)
        if partition:
            day = F.date_format(at, partition_format)
            df = df.filter(F.col(partition) >= day if sign == ">=" else F.col(partition) <= day)
    return df


def pull_latest(
    df: DataFrame,
    keys: list[str],
    ts: str,
    features: list[str] | None = None,
    created: str | None = None,
    start=None,
    end=None,
    tie: list[str] = (),
    **partition,
) -> DataFrame:
    """Latest row per key within a time range, projected to keys, features and times."""
    rows = in_range(df, ts, start, end, **partition)
    if features is not None:
        rows = rows.select(*dict.fromkeys([*keys, *features, ts, *([created] if created else []), *tie]))
    return latest_per_key(rows, keys, ts, created, tie)
