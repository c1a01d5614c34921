"""Point-in-time feature store reads and writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.gates import require_columns
from tidemark.operators.asof import asof_join
from tidemark.operators.ordered import latest, typed_lit

FEATURE_SCHEMA = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("feature_name", T.StringType()),
        T.StructField("period_end", T.TimestampNTZType()),
        T.StructField("known_at", T.TimestampNTZType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("source_version", T.StringType()),
    ]
)
PRIMARY_KEY = ("entity_id", "feature_name", "known_at")
REQUIRED = ("entity_id", "feature_name", "known_at", "value")
DEFAULT_SOURCE_VERSION = "v1"


def prepare_batch(df: DataFrame) -> DataFrame:
    """K2: check the required columns and fill the optional ones."""
    require_columns(df, REQUIRED)
    if "period_end" not in df.columns:
        df = df.withColumn("period_end", F.lit(None).cast("timestamp_ntz"))
    if "source_version" not in df.columns:
        df = df.withColumn("source_version", F.lit(DEFAULT_SOURCE_VERSION))
    df = df.withColumn("source_version", F.coalesce("source_version", F.lit(DEFAULT_SOURCE_VERSION)))
    return df


def upsert(df: DataFrame, sequence: Sequence[str]) -> DataFrame:
    """K3: last write wins per primary key; ``sequence`` orders the writes."""
    rest = [c for c in df.columns if c not in PRIMARY_KEY]
    return latest(df, PRIMARY_KEY, list(sequence), rest)


def as_of(
    features: DataFrame,
    query_time,
    entity_ids: Sequence[str] | DataFrame | None = None,
    feature_names: Sequence[str] | None = None,
    extra: Sequence[str] = (),
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Per (entity, feature) the latest value with known_at <= query_time."""
    when = typed_lit(query_time, features.schema["known_at"].dataType)
    rows = _scoped(features, entity_ids, feature_names).where(F.col("known_at") <= when)
    keep = ["known_at", "value", *extra]
    return latest(rows, ["entity_id", "feature_name"], ["known_at", *tie_break], keep)


def panel_as_of(
    features: DataFrame,
    query_times: Sequence,
    entity_ids: Sequence[str] | DataFrame | None = None,
    feature_names: Sequence[str] | None = None,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """``as_of`` at many query times, tagged ``query_time``.

    Each row is mapped to the first query time that can see it, reduced to one
    row per (entity, feature, query slot) by partial aggregation, and then
    copied to the slots up to the next change. History never reaches a window,
    so an entity holding most of the table is no special case.
    """
    times = sorted(set(query_times))
    if not times:
        raise ValueError("at least one query time is needed")
    stamps = [typed_lit(t, features.schema["known_at"].dataType) for t in times]
    rows = _scoped(features, entity_ids, feature_names).where(F.col("known_at") <= stamps[-1])
    rows = rows.withColumn("_slot", _slot(stamps))
    seen = latest(rows, ["entity_id", "feature_name", "_slot"], ["known_at", *tie_break], ["known_at", "value"])
    after = F.lead("_slot").over(Window.partitionBy("entity_id", "feature_name").orderBy("_slot"))
    spans = seen.withColumn("_until", F.coalesce(after, F.lit(len(times))))
    return spans.select(
        "entity_id",
        "feature_name",
        "known_at",
        "value",
        F.explode(F.slice(F.array(*stamps), F.col("_slot") + 1, F.col("_until") - F.col("_slot"))).alias("query_time"),
    )


def panel_at(features: DataFrame, times: DataFrame, time: str = "query_time", tie_break: Sequence[str] = ()) -> DataFrame:
    """J2 for any number of query times, given as a column of ``times``.

    The result has a row for every (entity, feature) and every time from its first version on. Those rows are laid
    out first and then walked together with the versions in one as-of join. Missing keys match nothing.
    """
    key = ["entity_id", "feature_name"]
    firsts = features.where(F.col("known_at").isNotNull()).groupBy(*key).agg(F.min("known_at").alias("_first"))
    asked = times.agg(F.array_sort(F.collect_set(F.col(time))).alias("_times"))  # one row
    due = F.filter("_times", lambda t: t >= F.col("_first"))
    wanted = firsts.dropna(subset=key).join(asked).select(*key, F.explode(due).alias("query_time"))
    found = asof_join(wanted, features, key, "query_time", "known_at", ["value"], tie_break=tie_break, matched_ts="known_at")
    return found.select(*key, "known_at", "value", "query_time")


def _slot(stamps: Sequence[Column]) -> Column:
    """Count of query times strictly before known_at, as a balanced CASE tree."""

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("known_at") > stamps[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(stamps))


def _scoped(features, entity_ids, feature_names) -> DataFrame:
    if feature_names is not None:
        features = features.where(F.col("feature_name").isin(list(feature_names)))
    if entity_ids is None:
        return features
    if isinstance(entity_ids, DataFrame):
        return features.join(entity_ids.select("entity_id").distinct(), "entity_id", "left_semi")
    return features.where(F.col("entity_id").isin(list(entity_ids)))
