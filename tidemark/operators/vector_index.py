"""A stored vector index: exact search that reads few lists, and coded search re-ranked by whole vectors.

Vectors lie in lists around learnt centres, one folder per list, sorted by their
distance from the centre. A list's radius is the distance of its furthest vector, so
by the triangle inequality no vector of a list is nearer to a query than the query's
distance from the centre less the radius. The exact search reads each query's most
promising lists, takes the worst distance it would keep, and then reads the lists that
can hold something nearer, and of those only the shell of vectors that can be nearer.

Every vector also has a product-quantised code: one byte for each part of the vector,
naming the nearest of up to 256 learnt entries. The coded search reads ids and codes of
the probed lists, sums distances out of one table per query, and re-ranks the best by
their whole vectors.

Centres and entries are learnt from a bounded sample (``SAMPLE`` rows, by a hash of the
id); every row is in the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reliable
from .latest import top_rows
from .topk import DIGITS, Best
from .vector import METRICS, QUERY_BYTES, _arrow_schema, _distances, _matrix, _out_schema, _search_broadcast, ivf_build

SAMPLE = 50_000
ENTRIES = 256
FIRST_LISTS = 2  # read per query before any list is passed over
ROOM = 1e-6  # distances are rounded; stored ones to double


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1)[:, None]
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _entries(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Centres of one part of the vectors: Lloyd's rounds from evenly spaced rows."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.linspace(0, len(distinct) - 1, min(n, len(distinct))).astype(int)]
    for _ in range(rounds):
        near = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(c))[:, None]
        c = np.where(count > 0, sums / np.maximum(count, 1), c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1)


def _parts(dim: int, parts: int) -> list[slice]:
    cuts = np.linspace(0, dim, min(parts, dim) + 1).astype(int)
    return [slice(int(a), int(b)) for a, b in zip(cuts, cuts[1:])]


@dataclass(frozen=True)
class VectorIndex:
    """An index below ``path``, a folder all executors share."""

    path: str
    id_: str
    vec: str
    metric: str = "l2"

    def build(
        self, df: DataFrame, nlist: int = 128, parts: int = 16, seed: int = 7, sample: int = SAMPLE
    ) -> None:
        """Write every row with a vector to its list, with its code and its distance from the centre."""
        if self.metric not in METRICS:
            raise ValueError(f"unknown metric {self.metric!r}")
        spark, unit = df.sparkSession, self.metric == "cosine"
        rows = df.select(self.id_, self.vec).dropna()
        place = F.col("_place")
        length = F.sqrt(F.aggregate(self.vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        scaled = F.transform(F.col(self.vec), lambda x: x.cast("double") / length) if unit else F.col(self.vec).cast("array<double>")
        if unit:
            rows = rows.where(length > 0)  # without a direction there is no cosine
        placed = rows.withColumn("_place", scaled)
        some = reliable(placed.orderBy(F.xxhash64(self.id_), self.id_).limit(sample))
        learnt = np.array([r[0] for r in some.select(place).collect()], float)
        if not len(learnt):
            raise ValueError("there are no vectors to index")
        cuts = _parts(learnt.shape[1], parts)
        books = [_entries(learnt[:, cut], ENTRIES) for cut in cuts]
        listed, centres = ivf_build(placed, "_place", min(nlist, len(learnt)), seed, learn_from=some)
        sent = spark.sparkContext.broadcast((np.array(centres), books))  # nlist and parts bound its size
        kind = rows.schema[self.id_].dataType.simpleString()
        values = rows.schema[self.vec].dataType.simpleString()
        ddl = f"`{self.id_}` {kind}, `{self.vec}` {values}, list int, off double, code binary"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, books = sent.value
            for batch in batches:
                x = _matrix(batch.column(2), centres.shape[1])
                at = batch.column(3).to_numpy(zero_copy_only=False)
                off = np.linalg.norm(x - centres[at], axis=1)
                code = np.stack([_nearest(x[:, cut], book) for cut, book in zip(cuts, books)], axis=1).astype(np.uint8)
                codes = pa.array([row.tobytes() for row in code], pa.binary())
                named = [self.id_, self.vec, "list", "off", "code"]
                columns = [batch.column(0), batch.column(1), batch.column(3), pa.array(off), codes]
                yield pa.RecordBatch.from_arrays(columns, names=named)

        coded = listed.select(self.id_, self.vec, "_place", "list").mapInArrow(run, ddl)
        coded.repartitionByRange("list", "off").sortWithinPartitions("list", "off").write.partitionBy("list").parquet(f"{self.path}/rows")
        stored = spark.read.parquet(f"{self.path}/rows")
        lists = stored.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("radius"))
        middles = spark.createDataFrame([(k, list(map(float, c))) for k, c in enumerate(centres)], "list int, centre array<double>")
        middles.join(lists, "list", "left").coalesce(1).write.parquet(f"{self.path}/lists")
        entries = [(k, cut.start, cut.stop, book.tolist()) for k, (cut, book) in enumerate(zip(cuts, books))]
        ddl = "part int, start int, stop int, entries array<array<double>>"
        spark.createDataFrame(entries, ddl).coalesce(1).write.parquet(f"{self.path}/entries")

    def _lists(self, spark: SparkSession) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centres, radii and sizes by list."""
        rows = spark.read.parquet(f"{self.path}/lists").orderBy("list").collect()  # as many as lists
        return (
            np.array([r["centre"] for r in rows]),
            np.array([r["radius"] or 0.0 for r in rows]),
            np.array([r["n"] or 0 for r in rows]),
        )

    def _rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def _blocks(self, queries: DataFrame, qid: str, qvec: str, query_bytes: int) -> Iterator[tuple[DataFrame, list, np.ndarray]]:
        """Query vectors in blocks of bounded size: the block, its ids and its vectors."""
        asked = reliable(queries.select(qid, qvec).dropna())
        size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(qvec)).alias("dim")).first()
        blocks = math.ceil((size["n"] or 0) * (size["dim"] or 0) * 8 / query_bytes)
        for k in range(blocks):
            block = asked.where(F.pmod(F.xxhash64(qid, qvec), F.lit(blocks)) == k)
            rows = block.collect()
            if rows:
                yield block, [r[0] for r in rows], np.array([r[1] for r in rows], float)

    def _nothing(self, spark: SparkSession, queries: DataFrame, qid: str) -> DataFrame:
        schema = _out_schema(queries, qid, self._rows(spark), self.id_)
        return spark.createDataFrame([], f"{schema}, rank int")

    def least(self, q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """For queries and lists, a distance below which no vector of the list lies."""
        if self.metric == "cosine":
            return 1 - (_unit(q) @ centres.T + radii[None, :])
        if self.metric == "inner_product":
            return -(q @ centres.T + np.linalg.norm(q, axis=1)[:, None] * radii[None, :])
        # the sum of differences is at least the length of the difference
        return _distances(centres, q, "l2") - radii[None, :]

    def search(
        self, queries: DataFrame, qid: str, qvec: str, k: int = 10, seen: dict | None = None, query_bytes: int = QUERY_BYTES
    ) -> DataFrame:
        """Exact top ``k`` per query, as ``vector.vector_search`` gives them: (query, document, distance, rank).

        ``seen`` is filled with how many (query, list) pairs there are and were read.
        """
        spark = queries.sparkSession
        centres, radii, sizes = self._lists(spark)
        rows, out = self._rows(spark), self._nothing(spark, queries, qid)
        counts = {"lists": 0, "read": 0}
        for block, ids, q in self._blocks(queries, qid, qvec, query_bytes):
            least = np.where(sizes[None, :] > 0, self.least(q, centres, radii), np.inf)
            turn = np.argsort(least, axis=1, kind="stable")
            enough = np.cumsum(sizes[turn], axis=1) < k  # lists before the one that makes k rows
            early = np.maximum(enough.sum(axis=1) + 1, FIRST_LISTS)
            first = {one: turn[j, : early[j]].tolist() for j, one in enumerate(ids)}
            found = reliable(self._within(rows, block, qid, qvec, k, first, None))
            ranked = top_rows(found, [qid], [F.asc("distance"), F.asc(self.id_)], k, "rank")
            worst = {r[0]: r[1] for r in ranked.where(F.col("rank") == k).select(qid, "distance").collect()}
            limit = np.array([worst.get(one, np.inf) for one in ids])
            then, shells = {}, {}
            for j, one in enumerate(ids):
                near = [n for n in turn[j, early[j] :].tolist() if least[j, n] <= limit[j] + ROOM]
                then[one] = near
                for n in near:
                    low, high = self._shell(q[j], centres[n], limit[j])
                    before = shells.get(n, (np.inf, -np.inf))
                    shells[n] = (min(before[0], low), max(before[1], high))
            counts["lists"] += int((sizes > 0).sum()) * len(ids)
            counts["read"] += sum(map(len, first.values())) + sum(map(len, then.values()))
            if shells:
                found = found.unionByName(self._within(rows, block, qid, qvec, k, then, shells))
            best = top_rows(found, [qid], [F.asc("distance"), F.asc(self.id_)], k, "rank")
            out = out.unionByName(best.select(*out.columns))
        if seen is not None:
            seen |= counts
        return out

    def _shell(self, q: np.ndarray, centre: np.ndarray, limit: float) -> tuple[float, float]:
        """Distances from the centre at which a vector can be within ``limit`` of the query."""
        if self.metric == "inner_product" or not np.isfinite(limit):
            return 0.0, np.inf
        if self.metric == "cosine":  # of unit vectors the squared distance is twice the cosine distance
            q, limit = _unit(q[None, :])[0], math.sqrt(max(2 * limit, 0.0))
        far = float(np.linalg.norm(q - centre))
        return far - limit - ROOM, far + limit + ROOM

    def _within(self, rows, block, qid, qvec, k, probes: dict, shells: dict | None) -> DataFrame:
        """The best ``k`` per query and task, of the lists each query probes."""
        wanted = sorted({n for near in probes.values() for n in near})
        part = rows.where(F.col("list").isin(wanted))
        if shells:
            ddl = "list int, low double, high double"
            bounds = rows.sparkSession.createDataFrame([(n, *map(float, b)) for n, b in shells.items()], ddl)
            part = part.join(F.broadcast(bounds), "list").where("off between low and high")  # a row per list
        return _search_broadcast(part.select(self.id_, self.vec, "list"), block, self.id_, self.vec, qid, qvec, self.metric, k, probes)

    def search_coded(
        self, queries: DataFrame, qid: str, qvec: str, k: int = 10, nprobe: int = 16, refine: int = 20, query_bytes: int = QUERY_BYTES // 16
    ) -> DataFrame:
        """Approximate top ``k``: the best ``k * refine`` by code in the ``nprobe`` nearest lists, re-ranked by their vectors."""
        spark = queries.sparkSession
        centres, radii, sizes = self._lists(spark)
        books = spark.read.parquet(f"{self.path}/entries").orderBy("part").collect()
        rows, out = self._rows(spark), self._nothing(spark, queries, qid)
        for block, ids, q in self._blocks(queries, qid, qvec, query_bytes):
            place = _unit(q) if self.metric == "cosine" else q
            far = np.where(sizes[None, :] > 0, _distances(centres, place, self.metric), np.inf)
            near = np.argsort(far, axis=1, kind="stable")[:, :nprobe]
            tables = []
            for b in books:
                x, entries = place[:, b["start"] : b["stop"]], np.array(b["entries"])
                if self.metric == "l1":
                    tables.append(np.abs(x[:, None, :] - entries[None]).sum(axis=2))
                elif self.metric == "inner_product":
                    tables.append(-x @ entries.T)
                else:
                    tables.append(((x[:, None, :] - entries[None]) ** 2).sum(axis=2))
            found = self._by_code(rows, queries, qid, ids, near, tables, k * refine)
            chosen = reliable(top_rows(found, [qid], [F.asc("distance"), F.asc(self.id_)], k * refine).drop("distance"))
            wanted = sorted({int(n) for n in near.ravel()})
            whole = rows.where(F.col("list").isin(wanted)).select(self.id_, self.vec, "list")
            pairs = whole.join(chosen, [self.id_, "list"]).join(block, qid)
            from .vector import distance

            exact = pairs.select(qid, self.id_, F.round(distance(self.vec, qvec, self.metric), DIGITS).alias("distance"))
            best = top_rows(exact.where("distance is not null"), [qid], [F.asc("distance"), F.asc(self.id_)], k, "rank")
            out = out.unionByName(best.select(*out.columns))
        return out

    def _by_code(self, rows, queries, qid, ids: list, near: np.ndarray, tables: list[np.ndarray], k: int) -> DataFrame:
        """(query, document, distance, list): the best ``k`` per query and task by the sum of their codes' distances."""
        asking: dict[int, list[int]] = {}
        for j, lists in enumerate(near.tolist()):
            for n in lists:
                asking.setdefault(n, []).append(j)
        codes = rows.where(F.col("list").isin(sorted(asking))).select(self.id_, "code", "list")
        sent = rows.sparkSession.sparkContext.broadcast((ids, asking, tables))  # a block of queries
        schema = _arrow_schema(queries, qid, rows, self.id_).append(pa.field("list", pa.int32()))
        ddl = f"{_out_schema(queries, qid, rows, self.id_)}, list int"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asking, tables = sent.value
            best: dict[int, Best] = {}  # by list, as the list is part of the answer
            for batch in batches:
                if not batch.num_rows:
                    continue
                code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, len(tables))
                own = np.array(batch.column(0).to_pylist())
                at = batch.column(2).to_numpy(zero_copy_only=False)
                for one in np.unique(at).tolist():
                    mine = at == one
                    some = code[mine]
                    for j in asking.get(one, ()):
                        total = sum(table[j][some[:, m]] for m, table in enumerate(tables))
                        best.setdefault(one, Best(ids, k)).offer(j, own[mine], np.round(total, DIGITS))
            for one, kept in best.items():
                columns = kept.columns(pa.schema(list(schema)[:3]))
                yield pa.RecordBatch.from_arrays([*columns, pa.array([one] * len(columns[0]), pa.int32())], schema=schema)

        return codes.mapInArrow(run, ddl)
