"""Batch and stream scans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import FLOAT_SHAPE, INTEGER_SHAPE, TIMESTAMP_SHAPES

FILE_FORMATS = ("csv", "json", "parquet", "avro")
TABLE_FORMATS = ("delta", "iceberg", "hudi")


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header; give a schema to save the pass that infers one."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


@dataclass(frozen=True)
class BatchSource:
    """A table, a query or a path, with the roles of its columns.

    ``table_format`` (delta, iceberg, hudi) is passed through to a reader whose
    package must be on the class path.
    """

    ts: str | None = None
    table: str | None = None
    query: str | None = None
    path: str | None = None
    fmt: str = "parquet"
    frame: DataFrame | None = None
    created: str | None = None
    field_mapping: dict[str, str] = field(default_factory=dict)
    partition: str | None = None
    partition_format: str = "yyyy-MM-dd"
    table_format: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    schema: StructType | str | None = None

    def __post_init__(self):
        if sum(x is not None for x in (self.table, self.query, self.path, self.frame)) != 1:
            raise ValueError("give exactly one of table, query, path and frame")
        if self.path and not self.table_format and self.fmt not in FILE_FORMATS:
            raise ValueError(f"file format {self.fmt!r} is not one of {FILE_FORMATS}")
        if self.table_format and self.table_format not in TABLE_FORMATS:
            raise ValueError(f"table format {self.table_format!r} is not one of {TABLE_FORMATS}")

    def load(self, spark: SparkSession) -> DataFrame:
        if self.frame is not None:
            return self.frame
        if self.query:
            return spark.sql(self.query)
        reader = spark.read.options(**self.options)
        if self.table_format:
            reader = reader.format(self.table_format)
            return reader.load(self.path) if self.path else reader.table(self.table)
        if self.table:
            return spark.table(self.table)
        if self.schema:
            reader = reader.schema(self.schema)
        if self.fmt == "csv":
            reader = reader.option("header", True)
            if not self.schema:
                reader = reader.option("inferSchema", True)
        return reader.format(self.fmt).load(self.path)


def read_documents(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".txt", ".md")) -> DataFrame:
    """Whole files as rows: source, content, size in characters, filename."""
    glob = "*{" + ",".join(suffixes) + "}"
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    source = F.col("_metadata.file_path")
    return files.text(path, wholetext=True).select(
        source.alias("source"),
        F.col("value").alias("content"),
        F.length("value").alias("size"),
        F.regexp_extract(source, r"([^/]+)$", 1).alias("filename"),
    )


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None, **ranges) -> DataFrame:
    """A database table; ``column, lowerBound, upperBound, numPartitions`` read it in parallel."""
    return spark.read.jdbc(url, table, properties=properties or {}, **ranges)


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Simplest type that fits every non-blank value: INTEGER, FLOAT, TIMESTAMP or STRING.

    One aggregate over all columns and all rows.
    """
    columns = columns or df.columns
    found = []
    for c in columns:
        text = F.col(c).cast("string")
        blank = F.coalesce(F.trim(text) == "", F.lit(True))
        value = F.when(~blank, F.trim(text))
        dated = F.lit(False)
        for shape in TIMESTAMP_SHAPES:
            dated = dated | text.rlike(shape)
        kind = (
            F.when(F.count(value) == 0, "STRING")
            .when(F.bool_and(F.when(~blank, value.rlike(INTEGER_SHAPE))), "INTEGER")
            .when(F.bool_and(F.when(~blank, F.lower(value).rlike(FLOAT_SHAPE))), "FLOAT")
            .when(F.bool_and(F.when(~blank, dated)), "TIMESTAMP")
            .otherwise("STRING")
        )
        found.append(F.struct(F.lit(c).alias("name"), kind.alias("type")).alias(c))
    return df.agg(*found).select(F.explode(F.array(*columns)).alias("t")).select("t.*")


def decode(
    df: DataFrame, fmt: str, schema: str, options: dict[str, str] | None = None, column: str = "value"
) -> DataFrame:
    """Rows from a binary or text message column, as JSON or Avro."""
    if fmt == "json":
        message = F.from_json(F.col(column).cast("string"), schema, options or {})
    elif fmt == "avro":
        from pyspark.sql.avro.functions import from_avro

        message = from_avro(F.col(column), schema, options or {})
    else:
        raise ValueError(f"unknown message format {fmt!r}")
    return df.select(message.alias("_m")).select("_m.*")


def read_kafka(spark: SparkSession, options: dict[str, str], fmt: str, schema: str) -> DataFrame:
    """A Kafka topic as a stream of decoded rows."""
    stream = spark.readStream.format("kafka").options(**options).load()
    return decode(stream, fmt, schema)


def read_file_stream(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """New files under a path as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(path)
