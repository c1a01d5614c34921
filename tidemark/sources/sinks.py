"""Writers (K1-K9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.pit import DEFAULT_SOURCE_VERSION, FEATURE_SCHEMA, prepare_batch, upsert


class FeatureStore:
    """Append-only Parquet feature table, read through latest-wins dedup.

    Writing appends one batch with its own sequence number, so writers never
    rewrite each other's files and a failed write leaves readers unharmed.
    ``compact`` folds the history into a new folder.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write_batch(self, batch: DataFrame, batch_seq: int) -> None:
        """K2: required columns checked, defaults filled; later rows of a batch win via ``row_seq`` if given."""
        rows = prepare_batch(batch)
        if "row_seq" not in rows.columns:
            rows = rows.withColumn("row_seq", F.lit(0).cast("long"))
        rows = rows.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in FEATURE_SCHEMA.fields],
            F.col("row_seq").cast("long").alias("row_seq"), F.lit(batch_seq).cast("long").alias("batch_seq"),
        )
        rows.write.mode("append").partitionBy("feature_name").parquet(self.path)

    def write(
        self, entity_id: str, feature_name: str, known_at, value: float, batch_seq: int, period_end=None,
        source_version: str = DEFAULT_SOURCE_VERSION,
    ) -> None:
        """K1: a single feature value."""
        row = [(entity_id, feature_name, period_end, known_at, float(value), source_version)]
        self.write_batch(self.spark.createDataFrame(row, FEATURE_SCHEMA), batch_seq)

    def read(self) -> DataFrame:
        """K3: the current value of every primary key."""
        raw = self.spark.read.parquet(self.path)
        current = upsert(raw, ["batch_seq", "row_seq"])
        return current.select(*[f.name for f in FEATURE_SCHEMA.fields])

    def compact(self, target: str) -> None:
        rows = self.read().withColumn("row_seq", F.lit(0).cast("long")).withColumn("batch_seq", F.lit(0).cast("long"))
        rows.write.mode("errorifexists").partitionBy("feature_name").parquet(target)


def write_csv(df: DataFrame, path: str) -> None:
    """K4: result table as CSV part files with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """K5/K7/K9: report frames as JSON lines."""
    df.write.mode("overwrite").json(path)


def with_ticker_replaced(prices: DataFrame, new_rows: DataFrame) -> DataFrame:
    """K6: the tickers of ``new_rows`` lose their old rows and get the new ones."""
    tickers = new_rows.select("ticker").distinct()
    kept = prices.join(tickers, "ticker", "left_anti")
    return kept.unionByName(new_rows, allowMissingColumns=True)


def replace_ticker(prices: DataFrame, new_rows: DataFrame, path: str) -> None:
    """K6 into a new folder, so the old one stays readable while this job runs."""
    with_ticker_replaced(prices, new_rows).write.mode("errorifexists").parquet(path)


def request_log(spark: SparkSession, records: list[dict]) -> DataFrame:
    """K8: per-request records of one run as a table (append it to the log)."""
    from tidemark.operators.reports import REQUEST_LOG_SCHEMA

    return spark.createDataFrame(records, REQUEST_LOG_SCHEMA)
