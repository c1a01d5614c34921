"""Session settings and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster leave ``master`` empty so spark-submit decides. Shuffle
    partitions are left to AQE, which coalesces small ones and splits skewed
    join partitions at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by spark.checkpoint.dir; fall back only if unset."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    context.setCheckpointDir(configured)
    return configured


def durable(df: DataFrame) -> DataFrame:
    """Write once as Parquet to the shared folder and read back.

    Lineage is cut, a lost executor costs a re-read only, and a reader takes just the columns it needs. The
    folder's owner removes the files when the session is over.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    empty = [f.name for f in df.schema.fields if isinstance(f.dataType, NullType)]  # Parquet has no such type
    kept = df.drop(*empty)
    kept.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(kept.schema).parquet(path)
    return back.select(*[F.lit(None).alias(c) if c in empty else F.col(f"`{c}`") for c in df.columns])


MAX_BROADCAST_ROWS = 200_000  # rows of a few numbers each, so tens of megabytes at most


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Stage a summary table and broadcast it if its counted size allows; otherwise leave the join to Spark."""
    staged = durable(df)
    return F.broadcast(staged) if staged.count() <= max_rows else staged


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out before per-row work that is heavy on the CPU, if the input has too few splits.

    A small table may sit in one file split and so in one task. Large inputs
    have more splits than cores and pass through without a shuffle. Meant for
    plain scans, whose split count is known without running anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
