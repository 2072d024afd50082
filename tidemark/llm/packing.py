"""Packing tokenised documents into fixed-length sequences.

A document becomes its token ids and one end id, cut from the back into pieces of
the sequence length (only the first piece may be shorter). What a packing has to
know about a piece is its length, so the instance is the count of pieces of every
length: at most ``capacity`` numbers, however large the corpus.

On these counts the Martello-Toth reduction first fixes sets that dominate every
other way to fill a sequence with the same longest piece: the piece alone when
nothing fits beside it, the piece with one that fills the rest exactly, and the
piece with the longest that fits when no two or more others could use the rest
better. The remainder is packed by best fit in decreasing length. Both work on
runs of equal pieces, so the answer is a short list of placements: pieces number
r to r+n of a length go to consecutive sequences at one offset.

Pieces get their number within their length in parallel: counts per (length, hash
slice) give each slice its start, and rows are numbered within a slice. Neither a
common length nor a common text meets in one task.

Defined cases: a null or empty text is one piece holding the end id. Repeated rows
are packed separately. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import per_text, stored
from .vocabulary import IdsOf

SLICE_ROWS = 10_000  # pieces numbered together


def pieces(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    end_id: int,
    capacity: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) per piece; ``tokenizer`` and ``pattern`` as in ``IdsOf``."""

    def make() -> Callable:
        ids_of, end = IdsOf(tokenizer, pattern), np.uint32(end_id).tobytes()

        def rows(i, text):
            data = memoryview(ids_of(text) + end)
            n = len(data) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            out = []
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                part = data[4 * a : 4 * b]
                out.append((i, k, a, b - a, zlib.crc32(part)) + ((np.frombuffer(part, "<u4").tolist(),) if with_ids else ()))
            return out

        return rows

    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return per_text(docs, id_col, text_col, make, schema)


def reduce_and_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, first, n, sequence, per, offset) for ``counts`` pieces of each length.

    Pieces number ``first`` to ``first + n - 1`` of ``length`` go to sequences
    ``sequence`` onwards, ``per`` of them to each, the first at ``offset``.
    """
    left = {s: c for s, c in counts.items() if c}
    sizes = sorted(left)
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def take(size: int, n: int, base: int, per: int, offset: int) -> None:
        out.append((size, used[size], n, base, per, offset))
        used[size] += n
        left[size] -= n
        if not left[size]:
            del left[size], sizes[bisect_left(sizes, size)]

    changed = True
    while changed:  # the reduction
        changed = False
        for size in sorted(left, reverse=True):
            # fixing a set takes pieces away, which never helps the sets it dominates,
            # so a rule that holds once holds until one of its pieces is used up
            while size in left and (other := _dominant(left, sizes, size, capacity)) is not None:
                if other == size:
                    n = left[size] // 2
                    take(size, 2 * n, bins, 2, 0)
                else:
                    n = min(left[size], left.get(other, left[size]))
                    take(size, n, bins, 1, 0)
                    if other:
                        take(other, n, bins, 1, size)
                bins += n
                changed = True

    room: list[int] = []  # free space of open sequences, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # free space -> runs of sequences (first, count)

    def put_back(space: int, base: int, n: int) -> None:
        if n and space:
            if space not in groups:
                groups[space] = []
                insort(room, space)
            groups[space].append((base, n))

    for size in sorted(left, reverse=True):
        while size in left:
            at = bisect_left(room, size)
            n = left[size]
            if at < len(room):
                space = room[at]
                base, k = groups[space].pop()
                if not groups[space]:
                    del groups[space], room[at]
            else:
                space, base, k = capacity, bins, -(-n // (capacity // size))
                bins += k
            per = space // size
            full = min(k, n // per)
            if full:
                take(size, full * per, base, per, capacity - space)
                put_back(space - per * size, base, full)
            if full < k and (rest := n - full * per):
                take(size, rest, base + full, rest, capacity - space)
                put_back(space - rest * size, base + full, 1)
                full += 1
            put_back(space, base + full, k - full)
    return out


def _dominant(left: dict[int, int], sizes: list[int], size: int, capacity: int) -> int | None:
    """The piece that, with one of ``size``, dominates all other sets holding that one.

    0 when the piece is best alone; None when no small set is known to dominate.
    """
    rest = capacity - size

    def held(s: int) -> int:
        return left.get(s, 0) - (s == size)

    if held(rest) > 0:
        return rest
    fits = sizes[: bisect_right(sizes, rest)]
    if size <= rest and not held(size):
        fits.remove(size)
    if not fits:
        return 0
    smallest = [s for s in fits[:3] for _ in range(min(held(s), 3))][:3]
    longest = fits[-1]
    if len(smallest) < 2 or smallest[0] + smallest[1] > rest:
        return longest  # one more piece at most fits
    if len(smallest) < 3 or sum(smallest) > rest:
        best = 0  # two more at most: the fullest pair against the longest single piece
        lo, hi = 0, len(fits) - 1
        while lo <= hi:
            both = fits[lo] + fits[hi]
            if both > rest or lo == hi and held(fits[lo]) < 2:
                hi -= 1
            else:
                best = max(best, both)
                lo += 1
        if longest >= best:
            return longest
    return None


def pack(items: DataFrame, capacity: int = 1024) -> DataFrame:
    """``items`` (id, piece, length, ...) with sequence_id and offset."""
    spark = items.sparkSession
    items = stored(items, "pieces")
    counts = items.groupBy("length").count().collect()  # at most one row per length, so at most ``capacity``
    total = sum(r["count"] for r in counts)
    if any(not 0 < r["length"] <= capacity for r in counts):
        raise ValueError("a piece is longer than a sequence, or empty")
    placed = spark.createDataFrame(
        reduce_and_fit({r["length"]: r["count"] for r in counts}, capacity),
        "at_length long, first long, n long, sequence long, per long, at long",
    )
    slices = max(1, -(-total // SLICE_ROWS))
    cut = items.withColumn("slice", F.pmod(F.xxhash64("id", "piece", "start"), F.lit(slices)))
    starts = cut.groupBy("length", "slice").count()
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("length", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "slice").orderBy("id", "piece")
    ranked = (
        cut.withColumn("local", F.row_number().over(within) - 1)
        .join(starts, ["length", "slice"])
        .withColumn("rank", F.col("base") + F.col("local"))
    )
    # the placements: a few for each of at most ``capacity`` lengths
    step = F.col("rank") - F.col("first")
    found = ranked.join(
        F.broadcast(placed), (F.col("length") == F.col("at_length")) & step.between(0, F.col("n") - 1)
    )
    return found.select(
        *[c for c in items.columns],
        (F.col("sequence") + F.floor(step / F.col("per"))).alias("sequence_id"),
        (F.col("at") + F.col("length") * (step % F.col("per"))).alias("offset"),
    )
