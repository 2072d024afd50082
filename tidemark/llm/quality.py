"""Text quality by a regularised quadratic discriminant on document statistics.

A document is a handful of transformed statistics of its whole text. Each class is
a normal distribution of these with its own mean and covariance; covariances are
shrunk toward what the classes share and toward the diagonal, so that statistics
with hardly any spread in one class do not decide alone. The score is the
probability of class 1, from the difference of the log densities (Mahalanobis
distances by the Cholesky factors, which are computed once) and the class shares.

Fitting takes one pass: counts, sums and products of the labelled rows are summed
per task and then by Spark, and only these sums reach the driver. All labelled rows
outside the held-out fold are used.

Defined cases: a null or empty text has the statistics of the empty text. Labels
that are null, or whose document is absent, are not used; a document labelled
several times counts as often. With fewer than two rows of a class the score is the
share of class 1 among the labels (0.5 without labels). Repeated rows are scored
separately; an empty table gives no rows. Label, language, source and id are never
part of the statistics.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, per_text, stored

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_ABOVE = _BYTES >= 128
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_STOP = np.isin(_BYTES, list(b".,;:"))
_LOUD = np.isin(_BYTES, list(b"!?"))
_LETTER = _UPPER | _LOWER | _ABOVE
_SIGN = ~(_LETTER | _DIGIT | _SPACE | _STOP | _LOUD)
CLASSES = np.stack([_LETTER, _UPPER, _DIGIT, _SPACE, _STOP, _LOUD, _SIGN]).astype(np.float64)
# Ordinary prose: a short text is taken as so many bytes, words or lines of it and itself.
PROSE_BYTES, PROSE_WORDS, PROSE_LINES = 150, 25, 3
N_STATS = 12


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text; shares enter as the log of share plus a little."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data) + PROSE_BYTES
    counts = CLASSES @ np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters, upper, digits, space, stop, loud, sign = counts + PROSE_BYTES * np.array([0.82, 0.02, 0.002, 0.15, 0.02, 0, 0.003])
    words = text.split()
    lines = [line for line in text.split("\n") if line]
    n_words, n_lines = len(words) + PROSE_WORDS, len(lines) + PROSE_LINES
    share = lambda part, whole, little=0.003: float(np.log(part / whole + little))
    runs = sum(map(data.count, (b"!!", b"###", b"$$$", b"%%%", b"&&&", b"***", b" | ")))
    twice = sum(map(eq, words, words[1:]))
    return [
        share(letters, n, 0.05),
        share(upper, letters),
        share(digits, n),
        share(space, n, 0.01),
        share(stop, n),
        share(loud, n),
        share(sign, n),
        share(runs, n_words),
        share(twice, n_words, 0.01),
        float(np.log((letters + 5 * PROSE_WORDS) / (n_words + PROSE_WORDS))),
        share(len(set(lines)) + PROSE_LINES, n_lines, 0.05),
        float(np.log((len(set(words)) + PROSE_WORDS) / n_words**0.8)),
    ]


@dataclass
class Discriminant:
    """Class means, Cholesky factors of the covariances, and log shares."""

    means: np.ndarray
    factors: np.ndarray
    log_share: np.ndarray
    constant: float | None = None  # the score where the classes could not be told apart

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        log_density = []
        for mean, factor, share in zip(self.means, self.factors, self.log_share):
            z = np.linalg.solve(factor, (x - mean).T)
            log_density.append(share - np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -700, 700)))


def from_sums(n: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: float, flatten: float) -> Discriminant:
    """The discriminant of two classes' counts, sums and sums of products.

    ``shrink`` is the weight of the pooled covariance, ``flatten`` that of the
    diagonal of the mixture.
    """
    if min(n) < 2:
        return Discriminant(sums, products, n, float(n[1] / n.sum()) if n.sum() else 0.5)
    means = sums / n[:, None]
    own = products / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (own * n[:, None, None]).sum(axis=0) / n.sum()
    floor = 1e-3 * np.trace(pooled) / len(pooled) + 1e-9
    factors = []
    for cov in own:
        mixed = (1 - shrink) * cov + shrink * pooled
        mixed = (1 - flatten) * mixed + flatten * np.diag(np.diag(mixed)) + floor * np.eye(len(cov))
        factors.append(np.linalg.cholesky(mixed))
    return Discriminant(means, np.array(factors), np.log(n / n.sum()))


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every row."""
    return per_text(docs, id_col, text_col, lambda: lambda i, text: [(i, statistics(text))], "id long, x array<double>")


def fit(described: DataFrame, labels: DataFrame, folds: int = 5, shrink: float = 0.2, flatten: float = 0.1) -> Discriminant:
    """Fit on the labelled rows whose crc32 of the id is not divisible by ``folds``.

    ``labels`` is (id, label) with label 0 or 1.
    """
    known = labels.where("id is not null and label in (0, 1)").where(~held_out("id", folds)).select("id", "label")
    rows = described.join(known, "id").select(F.col("label").cast("int").alias("label"), "x")
    size = 1 + N_STATS + N_STATS * N_STATS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size))
        for batch in batches:
            label = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(-1, N_STATS)
            for c in (0, 1):
                own = x[label == c]
                total[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        where = np.arange(2 * size)
        yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(total.ravel())], names=["at", "value"])

    sums = rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(2 * size)
    for row in sums:  # 2 x (1 + 12 + 144) numbers
        total[row["at"]] = row["value"]
    total = total.reshape(2, size)
    products = total[:, 1 + N_STATS :].reshape(2, N_STATS, N_STATS)
    return from_sums(total[:, 0], total[:, 1 : 1 + N_STATS], products, shrink, flatten)


def score(described: DataFrame, model: Discriminant) -> DataFrame:
    """(id, score) for every row of statistics."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["id", "score"])

    return described.mapInArrow(run, "id long, score double")


def score_texts(model: Discriminant, text: Column) -> Column:
    """The score of a text column, for filters: no row is moved."""

    @F.pandas_udf("double")
    def run(texts):
        import pandas as pd

        return pd.Series(model.scores(np.array([statistics(t or "") for t in texts]).reshape(-1, N_STATS)))

    return run(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """(id, held_out, score, predicted) for every document."""
    described = stored(describe(docs), "statistics")
    found = score(described, fit(described, labels, folds))
    return found.select(
        "id",
        F.coalesce(held_out("id", folds), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """The rows of ``docs`` scored at ``threshold`` or more, with all their columns."""
    model = fit(describe(docs), labels, folds)
    return docs.where(score_texts(model, F.col("text")) >= threshold)
