"""A set of views with retrieval, materialisation, push and lookup."""

from __future__ import annotations

import os
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.asof import asof_join, entity_time_column, entityless_join
from ..operators.joins import lookup
from ..operators.latest import pull_latest
from ..operators.project import conform
from ..operators.quality import Check, observed, require_observed
from ..session import written
from ..sources.write import PUSHES, LatestTable, append_batch, one_off, read_batches, write_batch
from .views import OnDemandView, Service, View, resolve

PUSH_TARGETS = ("online", "offline", "online_and_offline")


class Workspace:
    """Views, on-demand views and services over one storage root.

    ``root`` is a folder all executors share; online tables, offline tables and
    the record of materialised ranges live below it.
    """

    def __init__(self, spark: SparkSession, root: str, views=(), on_demand=(), services=()):
        self.spark, self.root = spark, root
        resolve(list(views))
        self.views: dict[str, View] = {v.label: v for v in views}
        self.on_demand: dict[str, OnDemandView] = {v.name: v for v in on_demand}
        self.services: dict[str, Service] = {s.name: s for s in services}

    # -- storage -----------------------------------------------------------------

    def online(self, view: str) -> LatestTable:
        v = self.views.get(view)
        keys, ts, created = (v.keys, v.ts, v.created) if v else (self.on_demand[view].keys, "event_timestamp", None)
        return LatestTable(os.path.join(self.root, "online", view), tuple(keys), ts, created)

    def offline_path(self, view: str) -> str:
        return os.path.join(self.root, "offline", view)

    def write_view(
        self, df: DataFrame, view: str, to: str = "online", batch: int = 0, writer: str | None = None, suite: tuple[Check, ...] = ()
    ) -> None:
        """Write rows to the view's online and/or offline table.

        A ``writer`` that numbers its batches, such as a stream, may write one again
        without effect, and vouches for the columns. Without one the rows are checked
        against the table and added. The checks of ``suite`` are made by the run that
        writes the rows; when one fails, what was written is withdrawn.
        """
        if to not in PUSH_TARGETS:
            raise ValueError(f"unknown target {to!r}")
        approve = None
        if suite:
            df, found = observed(df, list(suite))

            def approve() -> None:
                require_observed(found)

        if to == "online_and_offline" and writer is None:  # the rows are computed once
            df = written(df, "view")
            if approve:
                approve()
                approve = None
        if to != "offline":
            self.online(view).upsert(df, batch, writer, approve)
        if to != "online":
            path = self.offline_path(view)
            if writer is None and (schema := self._schema(path)):  # the first write defines the table
                df = conform(df, schema)
            if writer is None and approve is None:
                append_batch(df, path)
            else:
                write_batch(df, path, writer or PUSHES, batch if writer else one_off(), approve)

    def _schema(self, path: str) -> StructType | None:
        try:
            return self._stored(path).schema
        except AnalysisException:
            return None

    def _stored(self, path: str) -> DataFrame:
        return read_batches(self.spark, path).drop("batch_writer", "batch_number")

    def offline(self, view: str) -> DataFrame:
        return self._stored(self.offline_path(view))

    # -- retrieval ---------------------------------------------------------------

    def _refs(self, refs: list[str] | str) -> list[str]:
        return list(self.services[refs].refs) if isinstance(refs, str) else list(refs)

    def historical(
        self, refs: list[str] | str, entity: DataFrame | str | None = None, start=None, end=None,
        full_names: bool = False, mode: str = "end", strategy: str = "auto",
    ) -> DataFrame:
        """Point-in-time features for an entity frame, or for a date range without one.

        ``refs`` is a service name or ``view:feature`` references. ``entity`` may be
        a query. On-demand features are computed after the join.
        """
        if (entity is None) == (end is None):
            raise ValueError("give either an entity frame or an end date")
        refs = self._refs(refs)
        demanded: dict[str, list[str]] = {}
        wanted: dict[str, list[str]] = {}
        shown = []
        for ref in refs:
            view, _, feature = ref.partition(":")
            if view in self.on_demand:
                demanded.setdefault(view, []).append(feature)
                shown.append(feature)
            elif view in self.views:
                if feature not in self.views[view].provides():
                    raise ValueError(f"view {view} has no feature {feature}")
                wanted.setdefault(view, []).append(feature)
                shown.append(f"{view}__{feature}" if full_names else feature)
            else:
                raise ValueError(f"unknown view {view!r}")
        for name in demanded:
            for ref in self.on_demand[name].sources:
                view, _, feature = ref.partition(":")
                if feature not in wanted.setdefault(view, []):
                    wanted[view].append(feature)
        memo: dict = {}
        sides = [self.views[v].side(self.spark, fs, full_names, memo=memo) for v, fs in wanted.items()]
        if entity is None:
            out = entityless_join(sides, end, start, mode=mode, strategy=strategy)
            base = [c for c in out.columns if c not in {n for s in sides for n in s.columns.values()}]
        else:
            entity = self.spark.sql(entity) if isinstance(entity, str) else entity
            missing = {k for s in sides for k in s.keys} - set(entity.columns)
            if missing:
                raise ValueError(f"the entity frame lacks {sorted(missing)}")
            out = asof_join(entity, sides, entity_time_column(entity), strategy=strategy)
            base = entity.columns
        for name in demanded:
            out = self.on_demand[name].apply(out)
        if any(self.on_demand[n].aggregations for n in demanded):
            return out
        return out.select(*base, *dict.fromkeys(shown))

    def lookup(self, refs: list[str] | str, requests: DataFrame, now: datetime, full_names: bool = False) -> DataFrame:
        """Latest online values with status for a batch of keys, then on-demand features."""
        out, demanded, wanted = requests, [], {}
        for ref in self._refs(refs):
            view, _, feature = ref.partition(":")
            if view in self.on_demand:
                demanded.append(view)
                for source in self.on_demand[view].sources:
                    v, _, f = source.partition(":")
                    wanted.setdefault(v, []).append(f)
            else:
                wanted.setdefault(view, []).append(feature)
        for view, features in wanted.items():
            v = self.views[view]
            keys = [v.key_map.get(k, k) for k in v.keys]
            asked = requests.select(*[F.col(named).alias(k) for k, named in zip(v.keys, keys)])
            stored = self.online(view).read_keys(asked).withColumnsRenamed(v.key_map)
            features = list(dict.fromkeys(features))
            found = lookup(stored, out, keys, features, v.ts, now, v.ttl).drop(v.ts)
            if full_names:
                found = found.withColumnsRenamed(
                    {n: f"{view}__{n}" for f in features for n in (f, f"{f}__status")}
                )
            out = found
        for name in dict.fromkeys(demanded):
            out = self.on_demand[name].apply(out)
        return out

    # -- materialisation -----------------------------------------------------------

    def materialize(self, start, end, views: list[str] | None = None) -> None:
        """Write each view's latest rows in [start, end] to its tables."""
        if start > end:
            raise ValueError("start lies after end")
        memo: dict = {}
        for name in views or list(self.views):
            v = self.views[name]
            df = v.build(self.spark, start, end, memo, checked=False)
            to = "online_and_offline" if v.online and v.offline else "offline" if v.offline else "online"
            self.write_view(df, name, to, suite=v.checks)
            self._record(name, start, end)

    def materialize_incremental(self, end: datetime, views: list[str] | None = None, now: datetime | None = None) -> None:
        """Continue from the last recorded end; the first run goes back one time to live.

        A zero time to live means 52 weeks; an unset one is an error on the first run.
        """
        now = now or end
        for name in views or list(self.views):
            v, start = self.views[name], self.last_end(name)
            if start is None:
                if v.ttl is None:
                    raise ValueError(f"view {name} has no time to live and was never materialised")
                start = now - (v.ttl if v.ttl.total_seconds() > 0 else timedelta(weeks=52))
            self.materialize(start, end, [name])

    def materialize_on_demand(self, name: str, start, end, event_time: str = "event_timestamp") -> None:
        """Latest sources → distinct keys and times → point-in-time join → transform → online table."""
        view = self.on_demand[name]
        entity = None
        for source in dict.fromkeys(r.partition(":")[0] for r in view.sources):
            v = self.views[source]
            part = pull_latest(
                v.rows(self.spark), list(v.keys), v.ts, [], v.created, start, end
            ).select(*view.keys, F.col(v.ts).alias(event_time))
            entity = part if entity is None else entity.unionByName(part, allowMissingColumns=True)
        entity = entity.distinct()
        joined = self.historical(list(view.sources), entity)
        self.online(name).upsert(view.apply(joined))

    def _state_path(self) -> str:
        return os.path.join(self.root, "materialized_ranges")

    def _record(self, view: str, start, end) -> None:
        row = self.spark.createDataFrame([(view, start, end)], "view string, start timestamp, end timestamp")
        row.coalesce(1).write.mode("append").parquet(self._state_path())

    def last_end(self, view: str):
        try:
            ranges = self.spark.read.parquet(self._state_path())
        except AnalysisException:
            return None
        return ranges.filter(F.col("view") == view).agg(F.max("end")).first()[0]

    # -- push ----------------------------------------------------------------------

    def push(self, source_views: list[str], df: DataFrame, to: str = "online") -> None:
        """Write a caller's rows to every view fed by a push source, through the view's transform."""
        for name in source_views:
            v = self.views[name]
            rows = v.transformed([df], self.spark)
            columns = [*v.keys, *v.features, v.ts, *([v.created] if v.created else [])]
            self.write_view(rows.select(*columns), name, to)


def aliased(view: View, alias: str, key_map: dict[str, str]) -> View:
    """A view under another name and other entity columns (used twice in one retrieval)."""
    return replace(view.with_name(alias), key_map=key_map)
