"""Declarative views over sources, streams and other views.

A view is a recipe; building it yields a lazy DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import timedelta
from typing import Any, Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.aggregate import Aggregation, aggregate
from ..operators.asof import Side
from ..operators.joins import join_views
from ..operators.latest import in_range, latest_per_key
from ..operators.project import apply_field_mapping, filter_expr
from ..operators.quality import Check, check_schema, require, validate
from ..operators.tiles import aggregate_tiled
from ..sources.read import BatchSource


@dataclass(frozen=True)
class View:
    """Keys, features and time columns over a source or over other views.

    ``transform`` takes one DataFrame per source; with ``mode="sql"`` it takes one
    temporary view name per source and returns a query. ``aggregations`` turn the
    view into (tiled, when ``hop`` is set) window aggregates.
    """

    name: str
    keys: tuple[str, ...]
    features: tuple[str, ...]
    source: BatchSource | View | tuple[View, ...]
    ts: str = "event_timestamp"
    created: str | None = None
    ttl: timedelta | None = None
    transform: Callable[..., Any] | None = None
    mode: str = "spark"
    where: str | Column | None = None
    aggregations: tuple[Aggregation, ...] = ()
    hop: timedelta | None = None
    checks: tuple[Check, ...] = ()
    schema: StructType | None = None
    how: str = "left"
    tie: str | None = None
    online: bool = True
    offline: bool = False
    key_map: dict[str, str] = field(default_factory=dict)
    alias: str | None = None

    @property
    def label(self) -> str:
        return self.alias or self.name

    def with_key_map(self, key_map: dict[str, str]) -> View:
        """The same view joined on differently named entity columns."""
        return replace(self, key_map=dict(key_map))

    def with_name(self, alias: str) -> View:
        return replace(self, alias=alias)

    def parents(self) -> tuple[View, ...]:
        if isinstance(self.source, View):
            return (self.source,)
        return self.source if isinstance(self.source, tuple) else ()

    def rows(self, spark: SparkSession, start=None, end=None, memo: dict | None = None) -> DataFrame:
        """Source rows in the time range, mapped and transformed."""
        memo = {} if memo is None else memo
        if isinstance(self.source, BatchSource):
            src = self.source
            raw = src.load(spark)
            ts = src.ts or self.ts
            raw = in_range(raw, ts, start, end, src.partition, src.partition_format)
            inputs = [apply_field_mapping(raw, src.field_mapping)]
        else:
            for p in self.parents():
                if p.name not in memo:
                    memo[p.name] = p.build(spark, start, end, memo)
            inputs = [memo[p.name] for p in self.parents()]
        if self.transform is None and len(inputs) > 1:
            inputs = [join_views({p.name: memo[p.name] for p in self.parents()}, list(self.keys), self.how)]
        return filter_expr(self.transformed(inputs, spark), self.where)

    def transformed(self, inputs: list[DataFrame], spark: SparkSession) -> DataFrame:
        """The view's transform of its inputs; without one, its single input."""
        return inputs[0] if self.transform is None else _apply(self.transform, self.mode, self.name, inputs, spark)

    def build(self, spark: SparkSession, start=None, end=None, memo: dict | None = None, checked: bool = True) -> DataFrame:
        """Source → transform or join → filter → aggregate or latest row → projection.

        Without ``checked`` the declared checks are left to the run that writes the rows.
        """
        out = self.rows(spark, start, end, memo)
        if self.aggregations:
            return self.check(self.aggregated(out, latest_only=True), checked)
        if self.ts in out.columns:
            out = latest_per_key(out, list(self.keys), self.ts, self.created, [self.tie] if self.tie else [])
        named = dict.fromkeys([*self.keys, *self.features, self.ts, self.created])
        return self.check(out.select(*[c for c in named if c in out.columns or c in self.features]), checked)

    def aggregated(self, rows: DataFrame, latest_only: bool = False) -> DataFrame:
        """The window aggregates of the view's rows; tiled ones of every hop unless only the latest is asked for."""
        specs, keys = list(self.aggregations), list(self.keys)
        if self.hop:
            # past values of a key need the ends at which one of its windows changes
            dense = True if latest_only else "span"
            return aggregate_tiled(rows, keys, specs, self.ts, self.hop, dense, latest_only, ts_as=self.ts)
        return aggregate(rows, keys, specs, self.ts)

    def provides(self) -> tuple[str, ...]:
        """Names that may be asked for: the declared features, or the outputs of the aggregations."""
        return tuple(dict.fromkeys((*self.features, *(a.output for a in self.aggregations))))

    def check(self, df: DataFrame, checked: bool = True) -> DataFrame:
        """Raise on a wrong schema and, if ``checked``, on a failed declared check (which runs a job)."""
        if self.schema is not None:
            errors = check_schema(df, self.schema).filter("level = 'error'")
            if not errors.isEmpty():
                raise ValueError(f"view {self.name}: missing columns")
        if self.checks and checked:
            require(validate(df, list(self.checks)))
        return df

    def side(
        self, spark: SparkSession, features: list[str], full_names: bool, start=None, end=None, memo: dict | None = None
    ) -> Side:
        """This view as the feature side of a point-in-time join.

        A view of window aggregates gives a row per key and window, valid from the
        window's end on.
        """
        df = self.rows(spark, start, end, memo)
        if self.aggregations:
            if not self.hop and any(a.time_window is None for a in self.aggregations):
                raise ValueError(f"view {self.name}: aggregates without a time window have no past values")
            df = self.aggregated(df)
            if not self.hop:
                df = df.drop("window_start").withColumnRenamed("window_end", self.ts)
        df = df.withColumnsRenamed(self.key_map)
        keys = tuple(self.key_map.get(k, k) for k in self.keys)
        names = {f: f"{self.label}__{f}" if full_names else f for f in features}
        return Side(df, keys, self.ts, names, self.ttl, self.created, self.tie)


def _apply(fn: Callable, mode: str, name: str, inputs: list[DataFrame], spark: SparkSession) -> DataFrame:
    if mode == "spark":
        return fn(*inputs)
    if mode != "sql":
        raise ValueError(f"unknown transform mode {mode!r}")
    names = []
    for i, df in enumerate(inputs):
        names.append(f"{name}_input_{i}")
        df.createOrReplaceTempView(names[-1])
    return spark.sql(fn(*names))


def resolve(views: list[View]) -> list[View]:
    """Views and their parents, parents first; a cycle is an error."""
    order: dict[str, View] = {}
    open_: list[str] = []

    def visit(v: View) -> None:
        if v.name in open_:
            raise ValueError("views form a cycle: " + " -> ".join([*open_, v.name]))
        if v.name in order:
            return
        open_.append(v.name)
        for p in v.parents():
            visit(p)
        open_.pop()
        order[v.name] = v

    for v in views:
        visit(v)
    return list(order.values())


@dataclass(frozen=True)
class OnDemandView:
    """Row-wise features computed from retrieved features and request columns.

    ``mode``: ``spark`` (DataFrame in and out), ``pandas`` (a function of batches)
    or ``python`` (dict of lists, or dict of values with ``singleton``).
    ``outputs`` is the DDL of the new columns. ``inputs`` are the columns a pandas or
    python function reads (all when not given); nothing else leaves the JVM, so all
    other columns stay as they are. With ``aggregations`` the result is grouped by
    ``group_by``.
    """

    name: str
    sources: tuple[str, ...]
    fn: Callable[..., Any]
    outputs: str
    mode: str = "pandas"
    singleton: bool = False
    keys: tuple[str, ...] = ()
    aggregations: tuple[Aggregation, ...] = ()
    group_by: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        out = self._transformed(df)
        if self.aggregations:
            if any(a.time_window for a in self.aggregations):
                raise ValueError("on-demand aggregations take no time window")
            out = aggregate(out, list(self.group_by), list(self.aggregations))
        return out

    def _transformed(self, df: DataFrame) -> DataFrame:
        if self.mode == "spark":
            return self.fn(df)
        if self.mode not in ("pandas", "python"):
            raise ValueError(f"unknown on-demand mode {self.mode!r}")
        fn, mode, singleton = self.fn, self.mode, self.singleton
        made = StructType.fromDDL(self.outputs)
        names = made.names

        @F.pandas_udf(made)
        def run(batch: pd.DataFrame) -> pd.DataFrame:
            if mode == "pandas":
                out = fn(batch)
            elif singleton:
                out = pd.DataFrame([fn(r) for r in batch.to_dict("records")], columns=names)
            else:
                out = pd.DataFrame(fn(batch.to_dict("list")))
            return out[names].reset_index(drop=True)

        given = [F.col(f"`{c}`") for c in (self.inputs or df.columns)]
        with_made = df.withColumn("_made", run(F.struct(*given)))
        return with_made.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], *[F.col(f"_made.`{n}`") for n in names])


@dataclass(frozen=True)
class StreamView(View):
    """A view whose rows come from a stream; its batch source holds the past.

    ``stream`` opens the stream. Windows of ``aggregations`` close when the watermark,
    ``watermark`` behind the newest event, passes their end; see ``streaming.ingest.run_view``.
    """

    stream: Callable[[SparkSession], DataFrame] | None = None
    watermark: str = "0 seconds"

    def stream_rows(self, spark: SparkSession) -> DataFrame:
        """The stream, transformed and filtered as the batch source's rows are."""
        if self.stream is None:
            raise ValueError(f"view {self.name} has no stream")
        return filter_expr(self.transformed([self.stream(spark)], spark), self.where)


@dataclass(frozen=True)
class Service:
    """A named bundle of ``view:feature`` references."""

    name: str
    refs: tuple[str, ...]


def batch_view(**spec) -> Callable[[Callable], View]:
    """Decorator: the function becomes the view's transform."""
    return lambda fn: View(name=spec.pop("name", fn.__name__), transform=fn, **spec)


def stream_view(**spec) -> Callable[[Callable], StreamView]:
    """Decorator: the function becomes the transform of a view fed by a stream, and of its batch source."""
    return lambda fn: StreamView(name=spec.pop("name", fn.__name__), transform=fn, **spec)


def on_demand_view(**spec) -> Callable[[Callable], OnDemandView]:
    """Decorator: the function computes the on-demand features."""
    return lambda fn: OnDemandView(name=spec.pop("name", fn.__name__), fn=fn, **spec)
