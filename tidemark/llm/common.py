"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd", **written: str) -> DataFrame:
    """Write once to the shared folder and read back: lineage is cut, lost executors cost a re-read only.

    ``written`` are further options of the writer.
    """
    path = shared_path(df.sparkSession, name)
    df.write.options(**written).option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, **read: str) -> DataFrame:
    """A table of the folder; ``read`` are options of the reader."""
    return spark.read.options(**read).parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = 500  # whole texts handed to Python at once


def small_batches(df: DataFrame) -> DataFrame:
    """Hand whole texts to Python in small batches, so that long ones fit a worker's memory.

    This lowers the session's Arrow batch size, which changes no result.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def dealt(df: DataFrame) -> DataFrame:
    """Deal the rows of a few splits out over all cores; inputs with enough splits pass through."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def pinned(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Memo(dict):
    """A function's results by key, at most ``limit`` of them; later keys are computed each time."""

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) < self.limit:
            self[key] = value
        return value
