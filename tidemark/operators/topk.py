"""Best rows per query within one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Equal distances must tie whatever the order of additions.
DIGITS = 9


class Best:
    """The ``k`` rows with the smallest distance per query (all rows when k is None).

    Ties are decided by row id.
    """

    def __init__(self, qids: list, k: int | None):
        self.qids, self.k = qids, k
        self.ids: list[np.ndarray | None] = [None] * len(qids)
        self.dist: list[np.ndarray] = [np.empty(0)] * len(qids)

    def offer(self, j: int, ids: np.ndarray, d: np.ndarray) -> None:
        """Offer rows to the query at position ``j``."""
        if self.k is not None and len(d) > self.k:
            edge = np.partition(d, self.k - 1)[self.k - 1]
            near = d <= edge
            ids, d = ids[near], d[near]
        if self.ids[j] is not None:
            d = np.concatenate([self.dist[j], d])
            ids = np.concatenate([self.ids[j], ids])
        order = np.lexsort((ids, d))[: self.k]
        self.ids[j], self.dist[j] = ids[order], d[order]

    def columns(self, schema: pa.Schema) -> list[pa.Array]:
        """Query ids, row ids and distances, for a schema of those three columns."""
        qids = [q for q, d in zip(self.qids, self.dist) for _ in d]
        ids = [i for ids in self.ids if ids is not None for i in ids.tolist()]
        dist = np.concatenate(self.dist) if self.dist else np.empty(0)
        return [pa.array(c, t) for c, t in zip((qids, ids, dist), schema.types)]
