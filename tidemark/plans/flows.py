"""End-to-end flows composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.aggregate import impute_median, minmax, output_stats
from ..operators.asof import Side, asof_join
from ..operators.docs import Model, chunk, embed, number_chunks
from ..operators.joins import attach_label
from ..operators.latest import first_per_key
from ..operators.project import coerce_numeric, derive_ratios, to_utc
from ..operators.quality import remediate
from ..session import written
from ..sources.read import read_documents


def clean_and_scale(
    df: DataFrame, key: str, ts: str, numeric: list[str], label: str | None = None, tie: list[str] = (),
    exact_median: bool = True,
) -> DataFrame:
    """First row per key → UTC times → numbers → median fill → [0, 1] scaling.

    The cleaned rows are written once; medians and ranges are then found by scans of
    the numeric columns, and enter the result as plain numbers.
    """
    out = first_per_key(df, [key], ts, tie)
    out = written(coerce_numeric(to_utc(out, ts), numeric), "cleaned")
    out = impute_median(out, numeric, exact_median)
    if label:
        out = out.withColumn(label, out[label].cast("int"))
    return minmax(out, numeric)


def training_set(
    entity: DataFrame,
    sides: list[Side],
    keys: list[str],
    ts: str,
    label: str,
    critical: list[str],
    ratios: dict[str, tuple[str, str]],
) -> DataFrame:
    """Point-in-time features, label, remediation and derived ratios.

    The label travels with the entity rows, so it needs no second join.
    """
    joined = asof_join(entity.select(*keys, ts, label), sides, ts)
    return derive_ratios(remediate(joined, critical), ratios)


def training_set_relabelled(
    entity: DataFrame, sides: list[Side], keys: list[str], ts: str, label: str, critical: list[str],
    ratios: dict[str, tuple[str, str]],
) -> DataFrame:
    """The same with the label joined back on keys and time, for labels kept elsewhere."""
    features = asof_join(entity.select(*keys, ts), sides, ts)
    joined = attach_label(features, entity, keys, ts, label)
    return derive_ratios(remediate(joined, critical), ratios)


def ingest_rows(
    docs: DataFrame, doc: str, text: str, target: str, size: int = 1000, overlap: int = 200, model: Model | None = None,
    tail: bool = False, keep: list[str] = (),
) -> DataFrame:
    """Chunk, embed, number and write documents; returns the written table.

    Embedded chunks are written once; the written table is then numbered in
    ``doc`` order.
    """
    spark = docs.sparkSession
    pieces = chunk(docs, text, size, overlap, tail, keep=[doc, *keep])
    embed(pieces, "text", model).write.mode("overwrite").parquet(target + "/chunks")
    number_chunks(spark.read.parquet(target + "/chunks"), doc).write.mode("overwrite").parquet(target + "/numbered")
    return spark.read.parquet(target + "/numbered")


def ingest_documents(
    spark: SparkSession, path: str, target: str, size: int = 1000, overlap: int = 200, model: Model | None = None,
    tail: bool = False,
) -> DataFrame:
    """Read files and ingest them; returns row count and total characters."""
    docs = read_documents(spark, path)
    return output_stats(ingest_rows(docs, "source", "content", target, size, overlap, model, tail, ["filename"]), "text")
