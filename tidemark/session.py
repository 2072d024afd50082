"""Session settings, size checks and shared scratch space."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Inputs estimated below this fit one task; above it, no operator lets a single
# key, group or window hold an unbounded share of the rows.
ONE_TASK_BYTES = 64 * 1024 * 1024


def build_session(app: str = "tidemark", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators expect.

    On a cluster leave ``master`` unset; pass any further setting as
    ``{"spark.some.key": value}``.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # call sites of every column expression cost more than most plans here
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def estimated_bytes(df: DataFrame) -> float:
    """The optimizer's size estimate (what ``explain("cost")`` prints); no job.

    Infinity when there is no estimate, so callers take the path for big data.
    """
    try:
        return float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except (AttributeError, ValueError):
        return math.inf


def row_bytes(df: DataFrame) -> int:
    """A rough width of one row: eight bytes per number, more for text and nesting."""
    wide = {"string": 32, "binary": 256, "array": 512, "map": 256, "struct": 256}
    return 8 + sum(wide.get(f.dataType.typeName(), 8) for f in df.schema)


def row_width(df: DataFrame) -> Column:
    """The measured width of a row: eight bytes per number, texts and nested values by their length."""
    width = F.lit(8)
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif kind in ("array", "map", "struct"):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(f"`{f.name}`"))), F.lit(0))
        else:
            width = width + 8
    return width.cast("long")


def fits_one_task(*dfs: DataFrame) -> bool:
    return sum(estimated_bytes(df) for df in dfs) <= ONE_TASK_BYTES


def spread_small(df: DataFrame) -> DataFrame:
    """Give a small input, which a scan leaves in a split or two, several tasks.

    For work that is heavy per row; big inputs already have many splits and are
    never moved.
    """
    if not fits_one_task(df):
        return df
    return df.repartition(min(df.sparkSession.sparkContext.defaultParallelism, 32))


def broadcast_limit(spark: SparkSession) -> int:
    """Spark's own broadcast threshold in bytes (0 when broadcasting is off)."""
    raw = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")).strip().lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = raw.rstrip("bkmg")
    scale = next((units[c] for c in raw[len(digits):] if c in units), 1)
    return max(int(digits) * scale, 0)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Taken from ``spark.checkpoint.dir``. Without that setting a session in a single
    process, as in tests, gets a temporary folder; any other is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = spark.conf.get("tidemark.scratch", None)
        if not root:
            root = tempfile.mkdtemp(prefix="tidemark-")
            spark.conf.set("tidemark.scratch", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(scratch_root(spark), "tidemark", f"{name}-{uuid.uuid4().hex}")


def reliable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage (runs a job)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back, so its size is known and it never runs again."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
