"""Registered queries over the provided tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The provided tables as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def near(c: Column | str, digits: int) -> Column:
    """Round; the nudge makes exact halves go up in every engine."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, digits)


def query(sql: str | None = None):
    """Register a function of the tables under its own name."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, folder))

        QUERIES[fn.__name__] = run
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def load_all() -> None:
    from . import documents, lineage, models, quality, rows, storage, stored, streams, timetravel, windows  # noqa: F401
