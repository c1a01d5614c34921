"""Report tables over logs, panels and probe outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUEST_LOG_SCHEMA = (
    "endpoint string, http_status int, response_size_bytes long, timestamp string, elapsed_seconds double, "
    "retry_count int, rate_limit_headers map<string,string>, error string"
)


def _failed() -> Column:
    return F.col("error").isNotNull() | F.coalesce(F.col("http_status") >= 400, F.lit(False))


def request_summary(log: DataFrame) -> DataFrame:
    """Totals over a request log, one row; the status distribution is a map."""
    status = F.coalesce(F.col("http_status").cast("string"), F.lit("no_response"))
    per_status = log.groupBy(status.alias("_status")).agg(
        F.count("*").alias("_n"),
        F.count_if(_failed()).alias("_f"),
        F.max(F.coalesce(F.size("rate_limit_headers"), F.lit(0)) > 0).alias("_limited"),
        F.sum(F.coalesce("response_size_bytes", F.lit(0))).alias("_bytes"),
        F.sum("elapsed_seconds").alias("_seconds"),
    )
    # one row per status code from here on
    return per_status.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_requests"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_status", "_n")))).alias("status_distribution"),
        F.coalesce(F.sum("_f"), F.lit(0)).alias("failed_requests"),
        F.coalesce(F.max("_limited"), F.lit(False)).alias("any_rate_limit_headers"),
        F.coalesce(F.sum("_bytes"), F.lit(0)).alias("total_bytes"),
        F.round(F.coalesce(F.sum("_seconds"), F.lit(0.0)), 3).alias("total_seconds"),
    )


def constituent_report(wanted: DataFrame, prices: DataFrame, notes: DataFrame | None = None, min_rows: int = 100) -> DataFrame:
    """Per mapped ticker its status, rows, first day, note, and stub flag.

    ``wanted`` (group, ticker), ``prices`` (ticker, date), ``notes`` (ticker, note).
    """
    spans = prices.groupBy("ticker").agg(F.count("*").alias("n_obs"), F.min("date").alias("first_obs"))
    out = wanted.join(spans, "ticker", "left")
    out = out.withColumn("status", F.when(F.col("n_obs").isNotNull(), "usable").otherwise("MISSING"))
    out = out.withColumn("n_obs", F.coalesce("n_obs", F.lit(0).cast("long")))
    out = out.withColumn("is_stub", (F.col("n_obs") > 0) & (F.col("n_obs") < min_rows))
    if notes is None:
        return out.withColumn("note", F.lit(""))
    return out.join(notes, "ticker", "left").withColumn("note", F.coalesce("note", F.lit("")))


def usable_per_group(report: DataFrame, group: str) -> DataFrame:
    """Usable constituents per group, groups without any included."""
    return report.groupBy(group).agg(
        F.count_if(F.col("status") == "usable").alias("n_usable"), F.count("*").alias("n_mapped")
    )


def late_starters(report: DataFrame, after: str) -> DataFrame:
    """Tickers whose history begins after a given day."""
    return report.where(F.col("first_obs") > F.to_date(F.lit(after))).select("ticker", "first_obs")


def missing_series(wanted: DataFrame, prices: DataFrame, key: str = "ticker", min_rows: int = 1) -> DataFrame:
    """Wanted series that have fewer than ``min_rows`` rows."""
    have = prices.groupBy(key).count().where(F.col("count") >= min_rows)
    return wanted.select(key).distinct().join(have, key, "left_anti")


def ticker_resolution_review(submissions: DataFrame, tickers: DataFrame, prices: DataFrame, min_days: int = 100) -> DataFrame:
    """Names, exchanges and price coverage per CIK, for a reviewer."""
    days = prices.groupBy("ticker").agg(F.count("*").alias("trading_days"))
    out = submissions.join(tickers.select("cik", "ticker"), "cik", "left").join(days, "ticker", "left")
    return out.select(
        "cik", "ticker", "name",
        F.array_join(F.transform("former_names", lambda f: f["name"]), "; ").alias("former_names"),
        F.array_join("exchanges", "; ").alias("exchanges"),
        F.coalesce("trading_days", F.lit(0).cast("long")).alias("trading_days"),
        (F.coalesce("trading_days", F.lit(0)) < min_days).alias("low_trading_days"),
    )


def probe_report(
    attempts: DataFrame, tickers: DataFrame, filings: DataFrame, item202: DataFrame, eps: DataFrame,
    tag_rate: DataFrame, outcomes: DataFrame,
) -> DataFrame:
    """The data-quality figures of one probe run as a single row.

    Each input is reduced to one row by its own aggregate; the rows are then put side by side.
    """
    wanted = attempts.select("cik").distinct()
    resolved = wanted.join(tickers.where(F.col("ticker").isNotNull()).select("cik").distinct(), "cik", "left_semi")
    announced = item202.join(wanted, "cik", "left_semi")
    parts = [
        wanted.agg(F.count("*").alias("ciks_attempted")),
        resolved.agg(F.count("*").alias("ciks_ticker_resolved")),
        filings.agg(F.count("*").alias("filings_retrieved")),
        announced.agg(F.count("*").alias("item202_filings")),
        eps.agg(F.count("*").alias("eps_records")),
        tag_rate.select((1 - F.col("custom_rate")).alias("standard_tag_rate"), F.col("custom_rate").alias("custom_tag_rate")),
        outcomes.agg(F.count_if(F.col("reason").isNull()).alias("events_identified")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part)  # one row each
    return out.withColumn("resolution_failures", F.col("ciks_attempted") - F.col("ciks_ticker_resolved"))


def probe_counters(candidates: DataFrame) -> DataFrame:
    """Counts over market-cap candidates in one aggregate."""
    return candidates.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("known_at").isNull()).alias("n_unresolved"),
        F.count_if(F.col("market_cap").isNotNull()).alias("n_usable"),
        F.count_if(F.col("low_trading_days")).alias("n_low_trading_days"),
        F.count_if(F.col("qualifies")).alias("n_qualifying"),
        F.count_if(F.col("implausible_jump")).alias("n_jump_flag"),
        F.count_if(F.col("qualification_differs")).alias("n_differs"),
    )


def breakdown(df: DataFrame, column: str) -> DataFrame:
    """Rows per source or provenance label."""
    return df.groupBy(column).agg(F.count("*").alias("n_rows"))


def coverage_per_release(df: DataFrame, release: str, unit: str) -> DataFrame:
    """Least and median number of distinct units per release."""
    per = df.groupBy(release).agg(F.countDistinct(unit).alias("n"))
    # one row per release date
    return per.agg(F.min("n").alias("min_units"), F.percentile("n", F.lit(0.5)).alias("median_units"))


def decide(metrics: DataFrame, criteria: dict[str, Column]) -> DataFrame:
    """One boolean per named criterion and their conjunction; an undefined one fails."""
    out = metrics
    for name, rule in criteria.items():
        out = out.withColumn(name, F.coalesce(rule, F.lit(False)))
    verdict = F.lit(True)
    for name in criteria:
        verdict = verdict & F.col(name)
    return out.withColumn("passes", verdict)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; absent columns become NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
