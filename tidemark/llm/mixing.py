"""Mixing sources to target weights by fitting each source's budget of words.

Sources weigh in turn as ``weights`` say and share the words of all documents. No
document is taken more than ``most`` times, so a source stops at ``most`` times its
own size; what it can't take is shared again by weight until no source is above.

A source whose target is over its size takes all of its documents as often as they fit
whole. What is left of its budget is fitted exactly where it can be: documents are
counted by length, and a bounded-knapsack dynamic program picks how many documents of
each length come once more, so that their words come nearest to the budget. A budget
over ``CELLS`` words is first filled with the same share of every length and then with
the longest that fit; the program settles the rest.

Which documents of a length are picked is decided by a seeded hash of their id and
text, so reruns agree. Documents of one length are ranked within parts of about
``PART_ROWS`` rows, so a length that holds much of the corpus is no single task.

Defined cases: a null text has no words; a null source is a source of its own, the
last one. Documents without words are in the result and take nothing. Rows that
repeat are documents of their own. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import running_totals

from .common import join_groups, stored

CELLS = 1 << 17  # words the dynamic program settles
PART_ROWS = 1_000  # documents of one length ranked together
EXACT = "decimal(38,0)"


def n_words(text: str) -> Column:
    """Runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fitted(sizes: np.ndarray, docs: np.ndarray, budget: float, seed: int = 0, cells: int = CELLS) -> np.ndarray:
    """How many of the ``docs`` documents of each of the ``sizes`` come nearest to ``budget`` words.

    Exact up to ``cells`` words; above, the same share of every length and then the
    longest that fit bring the rest below that.
    """
    order = np.argsort(sizes, kind="stable")
    size, there = sizes[order].astype(np.int64), docs[order].astype(np.int64)
    there = np.where(size > 0, there, 0)
    picked = np.zeros(len(size), np.int64)
    if budget > cells:
        picked = np.minimum(np.floor(there * min(1.0, budget / max(int((size * there).sum()), 1))).astype(np.int64), there)
        while int((picked * size).sum()) > budget:  # by a rounded share
            picked = np.maximum(picked - 1, 0)
    left = budget - int((picked * size).sum())
    if left > cells:
        for k in range(len(size) - 1, -1, -1):
            if left <= cells:
                break
            if size[k]:
                more = min(int(there[k] - picked[k]), int(left // size[k]))
                picked[k] += more
                left -= more * int(size[k])
    picked += _nearest(size, there - picked, left, seed, cells)
    out = np.empty(len(picked), np.int64)
    out[order] = picked
    return out


def _nearest(size: np.ndarray, there: np.ndarray, left: float, seed: int, cells: int) -> np.ndarray:
    """Bounded knapsack: the numbers per length whose words are nearest to ``left``, ties to fewer words."""
    picked = np.zeros(len(size), np.int64)
    if left <= 0:
        return picked
    if left > cells:  # every document still there is longer than what is left
        longer = np.flatnonzero((there > 0) & (size > 0))
        if len(longer) and size[longer[0]] - left < left:
            picked[longer[0]] = 1
        return picked
    most = int(2 * left)  # more is further away than nothing
    items: list[tuple[int, int]] = []  # (length, documents), by halves, so that any number can be made
    for k in np.random.default_rng(seed).permutation(len(size)).tolist():
        n = min(int(there[k]), most // int(size[k])) if size[k] else 0
        half = 1
        while n > 0:
            items.append((k, min(half, n)))
            n -= half
            half *= 2
    by = np.full(most + 1, -1, np.int64)  # the item that first reached a sum
    by[0] = len(items)
    aim = min(round(left), most)
    for i, (k, n) in enumerate(items):
        if by[aim] >= 0:
            break
        words = int(size[k]) * n
        reached = np.flatnonzero((by[: most + 1 - words] >= 0) & (by[words:] < 0)) + words
        by[reached] = i
    sums = np.flatnonzero(by >= 0)
    at = int(sums[np.argmin(np.abs(sums - left))])
    while at:
        k, n = items[by[at]]
        picked[k] += n
        at -= int(size[k]) * n
    return picked


def _targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``sizes`` (source, source_size) with ``no``, ``weight`` and ``target``.

    Sources at their limit stay there; the words left and the weights left decide
    which ones are next. One small aggregate per round, in exact arithmetic.
    """
    known = sizes.withColumn("_null", F.col("source").isNull())
    known = running_totals(known, [F.asc("_null"), F.asc("source")], {"no": F.lit(1)}).drop("_null")
    turn = F.pmod(F.col("no") - 1, F.lit(len(weights))) + 1
    known = stored(known.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("long")), "mix-sources")
    limit = F.col("source_size") * most
    first = known.agg(F.sum("source_size"), F.sum("weight"), F.count(F.lit(1))).first()
    words, weight, open_ = first[0] or 0, first[1] or 0, first[2]

    def full() -> Column:
        return limit.cast(EXACT) * F.lit(weight).cast("decimal(18,0)") <= F.lit(words).cast(EXACT) * F.col("weight").cast("decimal(18,0)")

    while weight:
        row = known.agg(
            F.sum(F.when(full(), limit)), F.sum(F.when(~full(), F.col("weight"))), F.count(F.when(~full(), 1))
        ).first()
        if row[2] == open_:
            break
        words, weight, open_ = first[0] - (row[0] or 0), row[1] or 0, row[2]
    share = F.lit(float(words)) * F.col("weight") / F.lit(float(weight or 1))
    at_limit = full() if weight else F.lit(True)
    return known.withColumn("target", F.when(at_limit, limit.cast("double")).otherwise(share))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0,
) -> DataFrame:
    """(id, size, source_size, target, taken): words of every document, and how many of them the mix takes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = stored(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(source_col).cast("string").alias("source"),
            n_words(text_col).alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), text).alias("draw"),
        ),
        "mix-sizes",
    )
    sources = _targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))
    sources = stored(sources.withColumn("whole", F.when(F.col("source_size") > 0, whole).otherwise(0).cast("long")), "mix-targets")
    lengths = (
        slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs"))
        .join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    )

    def fit(table: pa.Table) -> pa.Table:
        size, count = (table.column(c).to_numpy() for c in ("size", "docs"))
        more = fitted(size, count, table.column("budget")[0].as_py(), seed)
        return table.drop_columns(["budget"]).append_column("more", pa.array(more))

    ddl = "no long, source string, size long, docs long, source_size long, target double, whole long, more long"
    kept = ["no", "source", "size", "docs", "source_size", "target", "whole", "budget"]
    # a source's distinct lengths are at most about the root of twice its words
    plan = lengths.select(F.col("no").cast("long").alias("no"), *kept[1:]).groupBy("no").applyInArrow(fit, ddl)
    plan = stored(plan.withColumn("parts", F.ceil(F.col("docs") / PART_ROWS)), "mix-plan")

    group = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"), "size")
    rows = join_groups(slim.withColumn("group", group), plan.withColumn("group", group).drop("source", "size"), "group", "docs")
    rows = rows.withColumn("part", F.pmod("draw", "parts"))
    some = (F.col("more") > 0) & (F.col("more") < F.col("docs"))
    # parts of a length come one after the other; a length of one part needs no counts
    in_parts = rows.where(some & (F.col("parts") > 1)).groupBy("no", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("no", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = in_parts.select("no", "size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = rows.where(some).join(earlier, ["no", "size", "part"], "left")
    rank = F.row_number().over(Window.partitionBy("no", "size", "part").orderBy("draw", "id"))
    ranked = ranked.withColumn("again", rank + F.coalesce("before", F.lit(0)) <= F.col("more"))
    sure = rows.where(~some).withColumn("again", F.col("more") > 0)
    out = ["id", "size", "source_size", "target", "whole", "again"]
    taken = F.col("size") * (F.col("whole") + F.col("again").cast("long"))
    return ranked.select(*out).unionByName(sure.select(*out)).select("id", "size", "source_size", "target", taken.alias("taken"))
