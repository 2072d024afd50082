"""Hard negatives: rows of another label that score just below an anchor's positives.

Scores are inner products of integer vectors, each component ``floor(scale * x)``.
An anchor's positives are the best other rows of its label; for each positive the best
rows of other labels whose score lies in a window below the positive's are returned.

Rows are scored by angular triangle filtering. Every row is stored with its angles to
some reference directions, sorted by label, nearest direction and angle to it. If t
is a row's angle to a direction and p the anchor's, the angle between the two lies
between |p - t| and min(p + t, 2 pi - p - t). The tightest of these intervals over all
directions, widened by more than the rounding of the stored angles, gives an interval
of the cosine and, times the norms, of the score. That is worked out for runs of
neighbouring rows at once; only runs whose interval overlaps a window that can still
be improved by it are scored, in integers.

Anchors are taken in blocks of bounded size: a block goes to every task, and rows are
read once per block for positives and once for negatives. A task keeps the best rows
per anchor and window, and no pair of rows is ever written. The reference directions
only make the filter tight, so they are learnt from a bounded sample (``SAMPLE`` rows);
every row is in the stored table and the result is exact.

Defined cases: rows with a null id, label or vector, or any null or non-finite
component, take no part, nor do vectors whose scaled squares add up to 2^60 or more (scores
then always fit 64 bits). Rows of different lengths have no score. An empty or zero
vector scores 0. Another row is one with another id: rows that repeat under an id are
no positives of each other, and repeated candidates count as often as they occur;
repeated anchors count once. Ties go to the smaller id. Empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import shuffle_partitions

from .common import stored

SAMPLE = 4096  # rows the reference directions are learnt from
DIRECTIONS = 16
RUN = 256  # neighbouring rows filtered together
BLOCK_BYTES = 32 * 1024 * 1024  # of anchors sent to every task
TASK_BYTES = 32 * 1024 * 1024
SLACK = 4e-6  # radians; stored angles are rounded to about a tenth of this
NONE = -(1 << 62)  # below every score
BUFFER = 500_000

READY = "id long, label long, vec array<long>, norm double, near int, angle float, angles array<float>, anchor boolean"
FOUND = "anchor int, slot int, score long, id long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def usable(rows: DataFrame, id_col: str, vec_col: str, label_col: str, anchor: Column, scale: int) -> DataFrame:
    """(id, label, vec as integers, norm, anchor) of the rows that take part."""
    vec = F.col("_v")
    square = F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x * float(scale * scale))
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    picked = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vec_col).cast("array<double>").alias("_v"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & vec.isNotNull())
    whole = picked.where(F.coalesce(fine, F.lit(False))).where(square < float(1 << 60))
    whole = whole.withColumn("vec", F.transform("_v", lambda x: F.floor(x * scale).cast("long")))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return whole.select("id", "label", "vec", norm.alias("norm"), "anchor")


def directions(sample: list[list[int]], n: int = DIRECTIONS) -> np.ndarray:
    """Unit reference directions: centres of the sample's directions, of the usual length among them."""
    lengths = [len(v) for v in sample if any(v)]
    if not lengths:
        return np.zeros((0, 0))
    dim = max(set(lengths), key=lambda d: (lengths.count(d), d))
    x = np.array([v for v in sample if len(v) == dim and any(v)], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    centres = [x[0]]
    for _ in range(min(n, len(x)) - 1):  # the row furthest from all centres so far
        centres.append(x[np.argmin((x @ np.array(centres).T).max(axis=1))])
    c = np.array(centres)
    for _ in range(5):
        nearest = np.argmax(x @ c.T, axis=1)
        sums = np.array([x[nearest == k].sum(axis=0) for k in range(len(c))])
        size = np.linalg.norm(sums, axis=1)
        c = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], c)
    return c


def _angles(x: np.ndarray, norm: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Angles of rows to the directions; a zero vector, which scores 0 with everything, is at right angles."""
    cosine = x @ refs.T / np.where(norm > 0, norm, 1)[:, None]
    return np.arccos(np.clip(cosine, -1, 1))


def with_angles(rows: DataFrame, refs: np.ndarray) -> DataFrame:
    """Rows with their angles to the directions, the nearest one, and the angle to that."""
    schema = _arrow(READY)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(2)
            size = vec.value_lengths().to_numpy(zero_copy_only=False)
            flat = vec.flatten().to_numpy(zero_copy_only=False).astype(float)
            norm = batch.column(3).to_numpy(zero_copy_only=False)
            angles = np.full((len(size), len(refs)), np.nan)
            usual = size == refs.shape[1]
            if len(refs) and usual.any():
                at = np.repeat(usual, size)
                angles[usual] = _angles(flat[at].reshape(-1, refs.shape[1]), norm[usual], refs)
            near = np.where(usual, np.argmin(np.nan_to_num(angles, nan=9.0), axis=1) if len(refs) else 0, -1).astype(np.int32)
            angle = np.where(usual, angles.min(axis=1, initial=9.0), 0).astype(np.float32)
            ends = np.arange(0, angles.size + 1, max(len(refs), 1))[: len(size) + 1] if len(refs) else np.zeros(len(size) + 1)
            lists = pa.ListArray.from_arrays(ends.astype(np.int32), angles.astype(np.float32).ravel())
            columns = [*batch.columns[:4], pa.array(near), pa.array(angle), lists, batch.column(4)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.select("id", "label", "vec", "norm", "anchor").mapInArrow(run, READY)


def stored_rows(rows: DataFrame) -> DataFrame:
    """All rows with their angles, sorted so that neighbours have the same label and like angles."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("id", "vec"), "id").limit(SAMPLE).select("vec").collect()
    known = stored(with_angles(rows, directions([r["vec"] for r in sample])), "negatives-angles")
    total = known.agg(F.sum(F.size("vec"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), math.ceil(total * 8 / TASK_BYTES))
    order = ["label", "near", "angle", "id"]  # ids cut a group of equal vectors
    return stored(known.repartitionByRange(parts, *order).sortWithinPartitions(*order), "negatives-rows")


class Anchors:
    """A block of anchors with, per anchor, windows of scores whose best rows are sought."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("id").to_numpy()
        self.labels = table.column("label").to_numpy()
        self.norms = table.column("norm").to_numpy()
        self.vectors = [np.array(v, np.int64) for v in table.column("vec").to_pylist()]
        self.dims = np.array([len(v) for v in self.vectors], np.int64)
        self.angles = np.array(table.column("angles").to_pylist(), float).reshape(len(self.ids), -1)

    def of(self, label: int, dim: int, same: bool) -> np.ndarray:
        return np.flatnonzero((self.dims == dim) & ((self.labels == label) == same))


def score_bounds(norms, angles, low, high, least_norm, most_norm) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor with any row whose angles lie within [low, high] and norm between the two."""
    if angles.shape[1]:
        closest = np.maximum(angles - high, low - angles).max(axis=1) - SLACK
        furthest = np.minimum(angles + high, 2 * math.pi - angles - low).min(axis=1) + SLACK
        most, least = np.cos(np.clip(closest, 0, math.pi)), np.cos(np.clip(furthest, 0, math.pi))
    else:
        most, least = np.ones(len(norms)), -np.ones(len(norms))
    top = norms * np.where(most >= 0, most_norm, least_norm) * most
    bottom = norms * np.where(least >= 0, least_norm, most_norm) * least
    room = 1 + 1e-9 * norms * most_norm
    return bottom - room, top + room


def best_rows(rows: DataFrame, anchors: Anchors, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> DataFrame:
    """(anchor, slot, score, id): per task the best ``k`` rows of every window ``low`` to ``high`` (anchors x slots).

    Rows of an anchor's own label (``same``) with another id, or of other labels.
    """
    sent = rows.sparkSession.sparkContext.broadcast((anchors, low, high))  # a block of bounded size
    schema = _arrow(FOUND)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, low, high = sent.value
        slots = low.shape[1]
        need = low.copy()  # a row must score this to be among the best of a window
        top_of_all, known = high.max(axis=1), {}
        kept: list[list[np.ndarray]] = [[], [], []]  # window, score, id

        def tidy():
            window, score, ids = (np.concatenate(c) if c else np.empty(0, np.int64) for c in kept)
            order = np.lexsort((ids, -score, window))
            window, score, ids = window[order], score[order], ids[order]
            rank = np.arange(len(window)) - np.searchsorted(window, window)
            for c, values in zip(kept, (window, score, ids)):
                c[:] = [values[rank < k]]
            full = rank == k - 1
            need.reshape(-1)[window[full]] = np.maximum(need.reshape(-1)[window[full]], score[full])

        def offer(which: np.ndarray, x: np.ndarray, ids: np.ndarray, exact: bool):
            a = np.stack([anchors.vectors[i] for i in which.tolist()])
            scores = (a @ x.T) if exact else (a.astype(float) @ x.T.astype(float)).astype(np.int64)
            if np.isin(ids, anchors.ids[which]).any():
                scores[anchors.ids[which][:, None] == ids[None, :]] = NONE
            for slot in range(slots):
                inside = np.where(scores <= high[which, slot][:, None], scores, NONE)
                some = np.flatnonzero(inside.max(axis=1) >= need[which, slot])
                if not len(some):
                    continue
                inside, who = inside[some], which[some]
                if inside.shape[1] > k:
                    cut = np.partition(inside, -k, axis=1)[:, -k]
                    need[who, slot] = np.maximum(need[who, slot], cut)  # k rows score that much
                r, c = np.nonzero(inside >= np.maximum(need[who, slot], NONE + 1)[:, None])
                for column, values in zip(kept, (who[r] * slots + slot, inside[r, c], ids[c])):
                    column.append(values)
            if sum(map(len, kept[0])) > BUFFER:
                tidy()

        for batch in batches:
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            vec, norms = batch.column(2), batch.column(3).to_numpy(zero_copy_only=False)
            sizes = vec.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = vec.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            angles = batch.column(6).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
            cuts = np.flatnonzero((np.diff(labels) != 0) | (np.diff(sizes) != 0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if s == e:
                    continue
                label, dim = int(labels[s]), int(sizes[s])
                if (label, dim) not in known:
                    known[label, dim] = anchors.of(label, dim, same)
                partners = known[label, dim]
                for f in range(s, e if len(partners) else s, RUN):
                    t = min(f + RUN, e)
                    bare = np.isnan(angles[f:t]).any() or not angles.shape[1]
                    seen = anchors.angles[partners][:, :0] if bare else anchors.angles[partners]
                    bottom, top = score_bounds(
                        anchors.norms[partners], seen, angles[f:t].min(axis=0, initial=9), angles[f:t].max(axis=0, initial=-9),
                        norms[f:t].min(), norms[f:t].max(),
                    )
                    open_ = (top[:, None] >= need[partners]) & (bottom <= top_of_all[partners])[:, None]
                    which = partners[open_.any(axis=1)]
                    x = flat[starts[f] : starts[f] + (t - f) * dim].reshape(t - f, dim)
                    for part in range(0, len(which), 4096):
                        some = which[part : part + 4096]
                        exact = anchors.norms[some].max() * norms[f:t].max() >= 1 << 52
                        offer(some, x, ids[f:t], exact)
        tidy()
        window, score, ids = (c[0] for c in kept)
        for first in range(0, len(window), 50_000):
            w = window[first : first + 50_000]
            columns = [w // slots, w % slots, score[first : first + 50_000], ids[first : first + 50_000]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc("id"))
    found = rows.select("id", "label", "vec", "norm", "near", "angle", "angles").mapInArrow(run, FOUND)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    scale: int = 256, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A negative's score is between ``window`` per cent of its positive's.
    """
    spark = rows.sparkSession
    ready = stored_rows(usable(rows, id_col, vec_col, label_col, anchor, scale))
    asked = ready.where("anchor").dropDuplicates(["id", "label", "vec"])
    size = asked.agg(F.count(F.lit(1)), F.sum(F.size("vec"))).first()
    bytes_ = (size[1] or 0) * 8 + size[0] * (4 * DIRECTIONS + 48 * positives)
    blocks = bytes_ // block_bytes + 1
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int")), "negatives-anchors", "block")
    out = spark.createDataFrame([], RESULT)
    for block in range(blocks if size[0] else 0):
        table = asked.where(F.col("block") == block).orderBy("id").toArrow()
        if not table.num_rows:
            continue
        anchors = Anchors(table)
        anywhere = np.full((table.num_rows, 1), NONE + 1), np.full((table.num_rows, 1), -NONE)
        first = best_rows(ready, anchors, *anywhere, same=True, k=positives).toArrow()  # a few rows per anchor
        who, score = first.column("anchor").to_numpy(), first.column("score").to_pylist()
        place = first.column("rank").to_numpy() - 1
        low = np.full((table.num_rows, positives), -NONE)
        high = np.full((table.num_rows, positives), NONE)
        low[who, place] = [-(-window[0] * s // 100) for s in score]
        high[who, place] = [window[1] * s // 100 for s in score]
        low[low > high] = -NONE  # of a negative score nothing is between
        named = spark.createDataFrame(
            pa.table(
                {
                    "anchor": pa.array(who, pa.int32()),
                    "slot": pa.array(place, pa.int32()),
                    "anchor_id": pa.array(anchors.ids[who], pa.int64()),
                    "positive_id": first.column("id"),
                    "positive_score": first.column("score"),
                }
            )
        )
        below = best_rows(ready, anchors, low, high, same=False, k=negatives).join(F.broadcast(named), ["anchor", "slot"])
        columns = ["anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")]
        out = out.unionByName(stored(below.select(*columns), "negatives-found"))
    return out
