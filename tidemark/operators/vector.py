"""Nearest-neighbour search over array columns."""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.columns import cosine, dot, l1, l2
from ..session import ONE_TASK_BYTES, shuffle_partitions
from .latest import top_rows
from .text import MATRIX_BYTES, _bags, _query_matrix, contains_any, joined_text, query_terms
from .topk import DIGITS, Best

METRICS = ("cosine", "l2", "l1", "inner_product")

# Query vectors up to this many bytes go to every executor in one broadcast.
QUERY_BYTES = 64 * 1024 * 1024


def distance(a: Column | str, b: Column | str, metric: str) -> Column:
    """Smaller is nearer: 1 - cosine, L2, L1 or the negated inner product."""
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric == "inner_product":
        return -dot(a, b)
    if metric in ("l2", "l1"):
        return (l2 if metric == "l2" else l1)(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def score(dist: Column | str, metric: str) -> Column:
    """Similarity scores from distances: cosine + 1, dot product, 1 / (1 + L2)."""
    d = F.col(dist) if isinstance(dist, str) else dist
    if metric == "cosine":
        return 2 - d
    if metric == "inner_product":
        return -d
    if metric == "l2":
        return 1 / (1 + d)
    raise ValueError(f"no score for metric {metric!r}")


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def nearest(df: DataFrame, id_: str, vec: str, query: list[float], metric: str = "cosine", k: int = 10) -> DataFrame:
    """Top ``k`` rows for one query vector, with every column of the row.

    Only ids and vectors are ranked; the k winners are then joined back.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    near = df.select(id_, F.round(distance(vec, q, metric), DIGITS).alias("distance"))
    best = top_k(near.filter("distance is not null"), [F.asc("distance"), F.asc(id_)], k)
    return df.join(F.broadcast(best), id_)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    if flat.size != len(column) * dim:
        raise ValueError(f"vectors are not all {dim} long")
    return flat.reshape(len(column), dim)


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of ``x`` to each row of ``q``: shape (queries, rows)."""
    if metric == "l1":
        return np.stack([np.abs(x - one).sum(axis=1) for one in q])
    if metric == "l2":
        return np.stack([np.sqrt(((x - one) ** 2).sum(axis=1)) for one in q])
    product = q @ x.T
    if metric == "inner_product":
        return -product
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - product / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :]


def _offer(best: Best, q: np.ndarray, metric: str, ids: np.ndarray, x: np.ndarray, which: list[int] | None = None) -> None:
    """Score rows against the queries ``q``; ``which`` are their places in ``best`` when they are not all."""
    step = max(1, 4_000_000 // max(len(ids), 1))
    for first in range(0, len(q), step):
        block = np.round(_distances(x, q[first : first + step], metric), DIGITS)
        for j, d in enumerate(block, first):
            ok = ~np.isnan(d)
            if ok.any():
                best.offer(j if which is None else which[j], ids[ok], d[ok])


def _out_schema(queries: DataFrame, qid: str, docs: DataFrame, id_: str) -> str:
    qt, it = queries.schema[qid].dataType.simpleString(), docs.schema[id_].dataType.simpleString()
    return f"`{qid}` {qt}, `{id_}` {it}, distance double"


def _arrow_schema(queries: DataFrame, qid: str, docs: DataFrame, id_: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    qt, it = (to_arrow_type(df.schema[c].dataType) for df, c in ((queries, qid), (docs, id_)))
    return pa.schema([(qid, qt), (id_, it), ("distance", pa.float64())])


def vector_search(
    docs: DataFrame,
    queries: DataFrame,
    id_: str,
    vec: str,
    qid: str,
    qvec: str,
    metric: str = "cosine",
    k: int = 10,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """Exact top ``k`` per query: (query, document, distance, rank).

    Each task scores its rows against all queries with one matrix product per
    batch and emits at most k rows per query. Queries that fit ``query_bytes`` are
    sent to every task; more of them are split over a grid with the documents.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    asked = queries.select(qid, qvec).dropna()
    docs = docs.select(id_, vec).dropna()
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(qvec)).alias("dim")).first()
    if not size["n"]:
        return docs.sparkSession.createDataFrame([], _out_schema(queries, qid, docs, id_) + ", rank int")
    if size["n"] * size["dim"] * 8 <= query_bytes:
        found = _search_broadcast(docs, asked, id_, vec, qid, qvec, metric, k)
    else:
        found = _search_grid(docs, asked, id_, vec, qid, qvec, metric, k, size["n"] * size["dim"] * 8, query_bytes)
    return top_rows(found, [qid], [F.asc("distance"), F.asc(id_)], k, "rank")


def _search_broadcast(docs, queries, id_, vec, qid, qvec, metric, k, lists: dict | None = None) -> DataFrame:
    """``lists`` maps a query to the document lists it probes (column ``list``).

    The rows of a list are then scored against that list's queries only.
    """
    table = queries.toArrow()  # checked against the byte limit by the caller
    qids = table.column(0).to_pylist()
    vectors = table.column(1).combine_chunks()
    asking: dict[int, list[int]] | None = None if lists is None else {}
    for j, query in enumerate(qids if lists else ()):
        for one in lists[query]:
            asking.setdefault(one, []).append(j)
    sent = docs.sparkSession.sparkContext.broadcast((qids, _matrix(vectors, len(vectors[0])), asking))
    schema = _arrow_schema(queries, qid, docs, id_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, asking = sent.value
        best = Best(qids, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch.column(1), q.shape[1]), np.array(batch.column(0).to_pylist())
            if asking is None:
                _offer(best, q, metric, ids, x)
                continue
            at = batch.column(2).to_numpy(zero_copy_only=False)
            for one in np.unique(at).tolist():
                if which := asking.get(one):
                    _offer(best, q[which], metric, ids[at == one], x[at == one], which)
        yield pa.RecordBatch.from_arrays(best.columns(schema), schema=schema)

    return docs.mapInArrow(run, _out_schema(queries, qid, docs, id_))


def _search_grid(docs, queries, id_, vec, qid, qvec, metric, k, need, query_bytes, cells=()) -> DataFrame:
    """Queries and documents hashed to the rows and columns of a grid.

    A cell sees one block of queries and one block of documents, both of bounded
    size, and emits its k best per query. ``cells`` names columns that must also
    be equal on both sides.
    """
    across = math.ceil(need / query_bytes)
    # rows are counted, as an estimate of a join is a product of sizes
    if cells:
        most, largest = docs.groupBy(*cells).count().agg(F.count("count"), F.max("count")).first()
    else:
        most, largest = 1, docs.count()
    dim = queries.agg(F.max(F.size(qvec))).first()[0] or 1
    down = max(math.ceil((largest or 0) * dim * 8 / ONE_TASK_BYTES), math.ceil(shuffle_partitions(docs.sparkSession) / across / max(most, 1)), 1)
    left = docs.withColumns(
        {
            "_d": F.pmod(F.xxhash64(id_), F.lit(down)).cast("int"),
            "_q": F.explode(F.sequence(F.lit(0), F.lit(across - 1))),
        }
    )
    right = queries.withColumns(
        {
            "_q": F.pmod(F.xxhash64(qid), F.lit(across)).cast("int"),
            "_d": F.explode(F.sequence(F.lit(0), F.lit(down - 1))),
        }
    )
    schema = _arrow_schema(queries, qid, docs, id_)

    def run(found: pa.Table, asked: pa.Table) -> pa.Table:
        if not found.num_rows or not asked.num_rows:
            return schema.empty_table()
        vectors = asked.column(qvec).combine_chunks()
        q = _matrix(vectors, len(vectors[0]))
        best = Best(asked.column(qid).to_pylist(), k)
        for batch in found.to_batches():
            ids = np.array(batch.column(id_).to_pylist())
            _offer(best, q, metric, ids, _matrix(batch.column(vec), q.shape[1]))
        return pa.table(best.columns(schema), schema=schema)

    keys = [*cells, "_d", "_q"]
    return (
        left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, _out_schema(queries, qid, docs, id_))
    )


def ivf_build(
    df: DataFrame, vec: str, nlist: int = 128, seed: int = 7, iterations: int = 20, learn_from: DataFrame | None = None
) -> tuple[DataFrame, list]:
    """Assign each vector to one of ``nlist`` lists; returns (rows with ``list``, centroids).

    Every row is assigned. The centroids are learnt from all rows, or from
    ``learn_from`` when passing over everything several times is too much. Write the
    rows partitioned by ``list`` so a search reads only probed lists.
    """

    def ready(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))

    means = KMeans(k=nlist, seed=seed, maxIter=iterations, featuresCol="_v", predictionCol="list").fit(
        ready(df if learn_from is None else learn_from)
    )
    return means.transform(ready(df)).drop("_v"), [c.tolist() for c in means.clusterCenters()]


def ivf_search(
    indexed: DataFrame, centroids: list, queries: DataFrame, id_: str, vec: str, qid: str, qvec: str,
    metric: str = "cosine", k: int = 10, nprobe: int = 10, query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """Approximate top ``k``: exact search within each query's ``nprobe`` nearest lists.

    A bounded query set is sent to every task, and only lists some query probes
    are read. A larger one meets the documents list by list, each list split
    further so a list that holds much of the data is no single task.
    """
    asked = queries.select(qid, qvec).dropna()
    centres = np.array(centroids, dtype="float64")

    def nearest_lists(vectors) -> list[list[int]]:
        far = _distances(centres, np.array(vectors, dtype="float64"), metric)
        return [[int(i) for i in np.argsort(d, kind="stable")[:nprobe]] for d in far]

    need = asked.count() * len(centroids[0]) * 8
    docs = indexed.select(id_, vec, "list").dropna()
    if not need:
        return docs.sparkSession.createDataFrame([], _out_schema(queries, qid, indexed, id_) + ", rank int")
    if need <= query_bytes:
        rows = asked.collect()
        probes = dict(zip([r[0] for r in rows], nearest_lists([r[1] for r in rows])))
        wanted = sorted({p for ps in probes.values() for p in ps})
        found = _search_broadcast(
            docs.filter(F.col("list").isin(wanted)), asked, id_, vec, qid, qvec, metric, k, probes
        )
    else:

        @F.pandas_udf("array<int>")
        def probe(v: pd.Series) -> pd.Series:
            return pd.Series(nearest_lists(v.tolist()))

        probing = asked.withColumn("list", F.explode(probe(F.col(qvec).cast("array<double>"))))
        found = _search_grid(docs, probing, id_, vec, qid, qvec, metric, k, need, query_bytes, ["list"])
    return top_rows(found, [qid], [F.asc("distance"), F.asc(id_)], k, "rank")


def hybrid_search(
    docs: DataFrame, columns: list[str], needle: str, queries: DataFrame,
    id_: str, vec: str, qid: str, qvec: str, metric: str = "cosine", k: int = 10,
) -> DataFrame:
    """Keyword filter, then exact vector ranking of what is left."""
    return vector_search(docs.filter(contains_any(columns, needle)), queries, id_, vec, qid, qvec, metric, k)


def hybrid_ranked(
    docs: DataFrame, columns: list[str], queries: DataFrame, id_: str, vec: str,
    qid: str, qtext: str, qvec: str, metric: str = "cosine", k: int = 10, query_bytes: int = MATRIX_BYTES,
) -> DataFrame:
    """Documents with every term of the query, nearest vector first, with text rank.

    Terms are matched and distances taken in the document's task, which emits k rows
    per query however many documents match. Queries whose terms or vectors pass
    ``query_bytes`` are asked in parts, each with a scan of the documents.
    """
    asked = queries.select(qid, qtext, qvec).dropna()
    found = _ranked_in_parts(docs.dropna(subset=[vec]), joined_text(columns), asked, id_, vec, qid, qtext, qvec, metric, k, query_bytes, 0)
    return top_rows(found, [qid], [F.asc("distance"), F.asc(id_)], k, "rank")


def _ranked_in_parts(docs, text, asked, id_, vec, qid, qtext, qvec, metric, k, query_bytes, depth) -> DataFrame:
    terms = query_terms(asked, qid, qtext)
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(qvec)).alias("dim")).first()
    known = None
    if (size["n"] or 0) * (size["dim"] or 0) * 8 <= query_bytes:
        known = _query_matrix(terms, qid, query_bytes)
    if known is None and size["n"] > 1:
        parts = [asked.where(F.pmod(F.shiftright(F.xxhash64(qid), depth), F.lit(2)) == b) for b in (0, 1)]
        halves = [_ranked_in_parts(docs, text, p, id_, vec, qid, qtext, qvec, metric, k, query_bytes, depth + 1) for p in parts]
        return halves[0].unionByName(halves[1])
    known = known or _query_matrix(terms, qid, 1 << 62)  # of a single query
    numbers, qids, matrix = known
    vectors = {r[0]: r[1] for r in asked.select(qid, qvec).collect()}  # within the limit
    q = [np.array(vectors[one], float) for one in qids]
    bags = _bags(docs, id_, text, numbers, also=(vec,))
    sent = docs.sparkSession.sparkContext.broadcast((qids, matrix, q))
    kinds = asked.schema[qid].dataType.simpleString(), docs.schema[id_].dataType.simpleString()
    ddl = f"`{qid}` {kinds[0]}, `{id_}` {kinds[1]}, text_rank double, distance double"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix, q = sent.value
        width, wanted = len(matrix), matrix.sum(axis=0)
        best = [(np.empty(0), np.empty(0), None)] * len(qids)  # distance, share, id
        for big in batches:
            step = max(1, 4_000_000 // max(*matrix.shape, 1))
            for first in range(0, big.num_rows, step):
                batch = big.slice(first, step)
                n, words = batch.num_rows, batch.column(2)
                row = np.repeat(np.arange(n), words.value_lengths().to_numpy(zero_copy_only=False))
                flat = row * width + words.flatten().to_numpy(zero_copy_only=False)
                tf = np.bincount(flat.astype("int64"), minlength=n * width).reshape(n, width).astype("float64")
                ok = (tf > 0).astype("float32") @ matrix.astype("float32") == wanted
                if not ok.any():
                    continue
                some = np.flatnonzero(ok.any(axis=1))
                share = (tf[some] @ matrix) / batch.column(1).to_numpy(zero_copy_only=False)[some].astype("float64")[:, None]
                kept = batch.take(pa.array(some))
                ids, x = np.array(kept.column(0).to_pylist()), _matrix(kept.column(3), len(q[0]))
                for j in np.flatnonzero(ok.any(axis=0)):
                    mine = ok[some, j]
                    d = np.round(_distances(x[mine], q[j][None, :], metric)[0], DIGITS)
                    there = ~np.isnan(d)
                    old_d, old_share, old_ids = best[j]
                    own = ids[mine][there]
                    d = np.concatenate([old_d, d[there]])
                    rank = np.concatenate([old_share, np.round(share[mine, j][there], DIGITS)])
                    own = own if old_ids is None else np.concatenate([old_ids, own])
                    order = np.lexsort((own, d))[:k]
                    best[j] = d[order], rank[order], own[order]
        rows = [(one, i, s, d) for one, (ds, shares, ids) in zip(qids, best) if ids is not None for i, s, d in zip(ids.tolist(), shares, ds)]
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return bags.mapInArrow(run, ddl)
