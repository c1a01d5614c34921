"""From filings and prices to control-adjusted, cost-adjusted event returns.

Instants are UTC wall-clock ``timestamp_ntz`` columns, so results do not
depend on the session time zone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import (
    EASTERN_END_OF_DAY, LEGACY_UTC_MIDNIGHT, ControlConfig, CostSchedule, EventStudyConfig, UniverseConfig,
)
from tidemark.operators.asof import HotKeys, asof_join, find_hot_keys
from tidemark.operators.gates import Check, gate, gate_rows, require_columns
from tidemark.operators.ordered import MAX_PERCENTILE_ROWS, grouped_percentile
from tidemark.operators.panel import Calendar, next_trading_day, trailing_median_dollar_volume
from tidemark.session import small_side

EASTERN = "America/New_York"
NO_LIMIT = float("inf")


# ---------------------------------------------------------------- time


def to_eastern(utc: Column) -> Column:
    """UTC wall clock to Eastern wall clock, DST included."""
    return F.convert_timezone(F.lit("UTC"), F.lit(EASTERN), utc.cast("timestamp_ntz"))


def to_utc(eastern: Column) -> Column:
    return F.convert_timezone(F.lit(EASTERN), F.lit("UTC"), eastern.cast("timestamp_ntz"))


def yyyymmdd(value: Column) -> Column:
    """Integer-coded date to DATE; NULL when it is not a date."""
    return F.try_to_date(value.cast("long").cast("string"), "yyyyMMdd")


def filed_instant(filed: Column, convention: str = LEGACY_UTC_MIDNIGHT) -> Column:
    """Date-only ``filed`` to a UTC instant under a named convention."""
    day = yyyymmdd(filed).cast("timestamp_ntz")
    if convention == LEGACY_UTC_MIDNIGHT:
        return day
    if convention == EASTERN_END_OF_DAY:
        return to_utc(day + F.expr("INTERVAL '23:59:59' HOUR TO SECOND"))
    raise ValueError(f"unknown filed-date convention {convention!r}")


def price_bound(known_at: Column, close_hour: int = 16) -> tuple[Column, Column]:
    """P10: (Eastern calendar date, has that day's close printed? 16:00 counts as yes)."""
    local = to_eastern(known_at)
    return F.to_date(local), F.hour(local) >= close_hour


def choose_known_at(filing: Column, announcement: Column, window_days: int = 5) -> tuple[Column, Column]:
    """The announcement if 0..window_days whole days before the filing, else the filing, with its label.

    Whole days are completed 24-hour days, so five days and 23 hours still count as five.
    """
    limit = announcement + F.make_dt_interval(days=F.lit(window_days + 1))
    primary = F.coalesce((announcement <= filing) & (filing < limit), F.lit(False))
    return (
        F.when(primary, announcement).otherwise(filing),
        F.when(primary, F.lit("8k_item202")).otherwise(F.lit("10q_fallback")),
    )


# ---------------------------------------------------------------- prices


def price_as_of(
    requests: DataFrame, prices: DataFrame, as_of: str, out: str = "price", hot: HotKeys | None = None
) -> DataFrame:
    """Close of the last bar on or before ``as_of``."""
    px = prices.select("ticker", "date", F.col("close").alias(out))
    return asof_join(requests, px, ["ticker"], as_of, "date", [out], hot=hot)


def last_printed_close(
    requests: DataFrame, prices: DataFrame, known_at: str = "known_at", out: str = "last_close", hot: HotKeys | None = None
) -> DataFrame:
    """Close of the last bar that had printed at ``known_at``."""
    day, printed = price_bound(F.col(known_at))
    bound = requests.withColumn("_bound", F.when(printed, day).otherwise(F.date_sub(day, 1)))
    return price_as_of(bound, prices, "_bound", out, hot).drop("_bound")


def entry_bar_close(
    requests: DataFrame, prices: DataFrame, known_at: str = "known_at", out: str = "entry_close", hot: HotKeys | None = None
) -> DataFrame:
    """Close of the first bar that prints after ``known_at``."""
    day, printed = price_bound(F.col(known_at))
    bound = requests.withColumn("_bound", F.when(printed, F.date_add(day, 1)).otherwise(day))
    px = prices.select("ticker", "date", F.col("close").alias(out))
    return asof_join(bound, px, ["ticker"], "_bound", "date", [out], direction="forward", hot=hot).drop("_bound")


def entry_date(
    events: DataFrame, calendar: Calendar, known_at: str = "known_at", cutoff_hour: int = 16, exhausted: str = "null"
) -> DataFrame:
    """First session on or after the candidate day; known by 16:00:00 means the same day.

    Events past the calendar's last session have no entry: ``exhausted='raise'`` stops there, 'null' keeps them.
    """
    if exhausted not in ("null", "raise"):
        raise ValueError("exhausted must be 'null' or 'raise'")
    local = to_eastern(F.col(known_at))
    day = F.to_date(local)
    cutoff = day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(cutoff_hour))
    candidate = events.withColumn("_c", F.when(local <= cutoff, day).otherwise(F.date_add(day, 1)))
    placed = next_trading_day(candidate, "_c", calendar, strict=False).drop("_c", "entry_idx")
    if exhausted == "null":
        return placed
    beyond = F.raise_error(F.concat(F.lit("calendar exhausted: no session on or after "), F.coalesce(F.col(known_at).cast("string"), F.lit("NULL"))))
    return placed.withColumn("entry_date", F.coalesce("entry_date", beyond.cast("date")))


# ---------------------------------------------------------------- universe

UNIVERSE_COLUMNS = (
    "entity_id", "ticker", "date", "market_cap", "sic_code", "adv_20d", "listing_exchange",
    "consecutive_quarters_history",
)


def qualification(cap: Column, adv: Column, listing: Column, quarters: Column, config: UniverseConfig) -> Column:
    """The first failed rule, or NULL when the row qualifies.

    A missing cap counts as above the band and a missing volume passes the
    floor: both outcomes the study defines, written out as NULL branches.
    """
    low, high = F.lit(float(config.min_market_cap)), F.lit(float(config.max_market_cap))
    allowed = F.coalesce(listing.isin(list(config.allowed_listings)), F.lit(False))
    rules = F.when(~allowed, "listing_not_allowed").when(cap < low, "market_cap_below_min")
    rules = rules.when(cap.isNull() | F.isnan(cap) | (cap > high), "market_cap_above_max")
    if config.min_adv is not None:
        rules = rules.when(adv < F.lit(float(config.min_adv)), "adv_below_floor")
    return rules.when(quarters < F.lit(config.min_quarters), "insufficient_history")


def build_universe(candidates: DataFrame, config: UniverseConfig) -> DataFrame:
    """P3 over a candidate table: every row stays, with ``qualifies`` and the reason."""
    require_columns(candidates, UNIVERSE_COLUMNS)
    reason = qualification(
        F.col("market_cap").cast("double"), F.col("adv_20d").cast("double"), F.col("listing_exchange"),
        F.col("consecutive_quarters_history"), config,
    )
    out = candidates.withColumn("disqualification_reason", reason)
    return out.withColumn("qualifies", F.col("disqualification_reason").isNull())


def attrition(df: DataFrame, reason: str, label: str = "qualifies") -> DataFrame:
    """Rows and percentage (2 dp) per reason; NULL means the row passed."""
    counts = df.groupBy(F.coalesce(F.col(reason), F.lit(label)).alias("reason")).agg(F.count("*").alias("n_rows"))
    # one row per reason from here on
    total = F.sum("n_rows").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("pct", F.round(F.col("n_rows") * 100.0 / total, 2))


def quantile_edges(universe: DataFrame, by: Sequence[str], cap: str, n: int, max_rows: int = MAX_PERCENTILE_ROWS) -> DataFrame:
    """The n+1 linear quantile edges of ``cap`` per group, as array ``edges``.

    One small row per group, staged because several tables are bucketed by it;
    broadcast when the groups are as few as dates are.
    """
    return small_side(grouped_percentile(universe, by, cap, [i / n for i in range(n + 1)], "edges", max_rows))


def quantile_bucket(cap: Column, edges: Column, n: int) -> Column:
    """Number of edges <= cap, kept within [1, n]."""
    below = F.size(F.filter(edges, lambda e: e <= cap))
    return F.when(cap.isNotNull() & edges.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(n), below)))


# ---------------------------------------------------------------- events


def build_events(df: DataFrame, prefix: str = "h11") -> DataFrame:
    """P5: event rows with their id, after the P4 gate on a point-in-time violation."""
    require_columns(df, ("entity_id", "ticker", "period_end", "known_at"))
    name = F.concat_ws("_", F.lit(prefix), F.col("entity_id"), F.date_format("period_end", "yyyyMMdd"))
    early = F.concat(F.lit("known_at_after_period_end: known no later than the period's end: "), name)
    # raised while the rows are computed, so the check costs no extra pass
    checked = F.when(known_too_early(F.col("known_at"), F.col("period_end")), F.raise_error(early).cast("string")).otherwise(name)
    return df.withColumn("event_id", checked)


def known_too_early(known_at: Column, period_end: Column) -> Column:
    """Known, on the Eastern wall clock, no later than the end of the period described."""
    return to_eastern(known_at) <= period_end.cast("timestamp_ntz")


def check_known_after_period(events: DataFrame) -> Check:
    """P4 as a hard gate: one such event stops the pipeline."""
    return gate_rows(events, "known_at_after_period_end", known_too_early(F.col("known_at"), F.col("period_end")))


# ---------------------------------------------------------------- controls and costs


def matched_control(
    events: DataFrame, pool: DataFrame, universe: DataFrame, config: ControlConfig = ControlConfig(), date: str = "date",
    max_rows: int = MAX_PERCENTILE_ROWS,
) -> DataFrame:
    """Mean forward return of candidates sharing date, sector and size bucket.

    ``universe`` supplies the size edges of each date. Candidates are reduced
    to one row per (date, sector, bucket) before they meet the events, so no
    event-candidate pair is ever built. An event without controls keeps a NULL
    return; an event whose date has no edges keeps a NULL bucket.
    """
    n = config.n_quantiles
    edges = quantile_edges(universe, [date], "market_cap", n, max_rows)
    extra = [config.extra_key] if config.extra_key else []
    sized_pool = pool.join(edges, date).withColumn("size_bucket", quantile_bucket(F.col("market_cap"), F.col("edges"), n))
    groups = sized_pool.groupBy(date, "sic_code", "size_bucket", *extra).agg(
        F.avg("forward_return").alias("control_return"), F.count("*").alias("control_n")
    )
    sized_events = events.join(edges, date, "left").withColumn(
        "size_bucket", quantile_bucket(F.col("market_cap"), F.col("edges"), n)
    )
    out = sized_events.drop("edges").join(groups, [date, "sic_code", "size_bucket", *extra], "left")
    out = out.withColumn("control_n", F.coalesce("control_n", F.lit(0).cast("long")))
    return out.withColumn("thin_control", F.col("control_n") < config.min_controls)


def cost_band(adv: Column, schedule: CostSchedule) -> Column:
    """(label, bps) of the band holding ``adv``; NULL outside every band.

    The schedule is configuration, so it becomes a CASE and needs no join.
    """
    out = None
    for label, low, high, bps in schedule.buckets:
        inside = adv >= F.lit(low)
        if high != NO_LIMIT:
            inside = inside & (adv < F.lit(high))
        value = F.struct(F.lit(label).alias("label"), F.lit(float(bps)).alias("bps"))
        out = F.when(inside & ~F.isnan(adv), value) if out is None else out.when(inside & ~F.isnan(adv), value)
    return out


def apply_costs(df: DataFrame, schedule: CostSchedule = CostSchedule(), adv: str = "adv_20d") -> DataFrame:
    """net = control-adjusted return minus the band's cost."""
    out = df.withColumn("_band", cost_band(F.col(adv).cast("double"), schedule))
    out = out.withColumn("adv_bucket", F.col("_band.label")).withColumn("cost_bps", F.col("_band.bps")).drop("_band")
    return out.withColumn("net_return", F.col("control_adjusted_return") - F.col("cost_bps") / 10_000)


def band_distribution(df: DataFrame, adv: str, schedule: CostSchedule = CostSchedule()) -> DataFrame:
    """Rows per cost band."""
    label = cost_band(F.col(adv).cast("double"), schedule)["label"]
    return df.groupBy(label.alias("adv_bucket")).agg(F.count("*").alias("n_rows"))


def band_gaps(buckets: DataFrame) -> DataFrame:
    """W18 for a schedule held as a table: bands whose end is not the next band's start."""
    after = F.lead("min_adv").over(Window.orderBy("min_adv"))
    spaced = buckets.withColumn("next_min", after)
    return spaced.where(F.col("next_min").isNotNull() & (F.col("max_adv") != F.col("next_min")))


def run_event_study(
    events: DataFrame, pool: DataFrame, universe: DataFrame, returns: DataFrame,
    schedule: CostSchedule = CostSchedule(), config: ControlConfig = ControlConfig(), max_rows: int = MAX_PERCENTILE_ROWS,
) -> DataFrame:
    """Every event with its control, cost and net return, or the stage it left at.

    ``events`` and ``pool`` carry ``date`` (the event's known day); ``returns``
    has (event_id, raw_return). ``exclusion`` is NULL for complete rows,
    otherwise ``no_pool_for_date`` or ``no_forward_return``.
    """
    # a date is covered when it has both a pool and a universe
    covered = pool.select("date").distinct().join(universe.select("date").distinct(), "date").withColumn("_ok", F.lit(True))
    rows = events.join(covered, "date", "left").join(returns, "event_id", "left")
    rows = matched_control(rows, pool, universe, config, max_rows=max_rows)
    rows = rows.withColumn("control_adjusted_return", F.col("raw_return") - F.col("control_return"))
    rows = apply_costs(rows, schedule)
    reason = F.when(F.col("_ok").isNull(), "no_pool_for_date").when(F.col("raw_return").isNull(), "no_forward_return")
    return rows.withColumn("exclusion", reason).drop("_ok")


def event_study_gates(results: DataFrame) -> list[Check]:
    """At least one control (hard), thin rate < 10 % (soft), every priced row has a band (hard)."""
    n, n_control, thin, n_done, no_band = results.agg(
        F.count("*"),
        F.count_if(F.coalesce(F.col("exclusion"), F.lit("")) != "no_pool_for_date"),
        F.count_if((F.coalesce(F.col("exclusion"), F.lit("")) != "no_pool_for_date") & F.col("thin_control")),
        F.count_if(F.col("exclusion").isNull()),
        F.count_if(F.col("exclusion").isNull() & F.col("adv_bucket").isNull()),
    ).first()
    return [
        gate("control_group_computed", n_control > 0 or n == 0, n_control),
        gate("thin_control_rate_below_10pct", n_control == 0 or thin / n_control < 0.10, thin, hard=False),
        gate("every_row_has_a_cost_band", no_band == 0, n_done),
    ]


# ---------------------------------------------------------------- SUE


def standardized_surprise(
    eps: DataFrame, key: str = "cik", date: str = "period_end", value: str = "eps_value",
    config: EventStudyConfig = EventStudyConfig(), require_consecutive: bool = False,
) -> DataFrame:
    """Seasonal difference over the sd of the last eight, for every quarter.

    ``eps`` has one row per (key, period), as EPS extraction leaves it, so the
    window is bounded by the number of quarters. Rows that cannot be scored
    keep a reason.
    """
    lag, full = config.sue_lag, config.sue_window
    w = Window.partitionBy(key).orderBy(date)
    trailing = w.rowsBetween(-(full - 1), 0)
    out = eps.withColumn("n_quarters", F.row_number().over(w))
    diff = F.col(value) - F.lag(value, lag).over(w)
    if require_consecutive:
        months = F.months_between(F.col(date), F.lag(date, lag).over(w))
        diff = F.when(F.abs(months - 3 * lag) < 1, diff)
    out = out.withColumn("seasonal_diff", diff)
    out = out.withColumn("n_diffs", F.count("seasonal_diff").over(trailing))
    out = out.withColumn("diff_sd", F.stddev_samp("seasonal_diff").over(trailing))
    reason = (
        F.when(F.col("n_quarters") <= lag, "insufficient_history_for_any_seasonal_diff")
        .when(F.col("n_diffs") < config.min_seasonal_diffs, "insufficient_seasonal_diffs")
        .when(F.col("diff_sd").isNull() | F.isnan("diff_sd") | (F.col("diff_sd") == 0), "zero_or_undefined_volatility")
    )
    if require_consecutive:
        reason = F.coalesce(reason, F.when(F.col("seasonal_diff").isNull(), "quarters_not_consecutive"))
    out = out.withColumn("sue_reason", reason)
    return out.withColumn("sue", F.when(F.col("sue_reason").isNull(), F.col("seasonal_diff") / F.col("diff_sd")))


# ---------------------------------------------------------------- market-cap candidates


def printed_figures(requests: DataFrame, prices: DataFrame, window: int = 20, known_at: str = "known_at") -> DataFrame:
    """J4, J5 and W12 at once: last_close, entry_close and adv_20d of each request.

    Every bar is given its successor's close and the volume figure before it, in one window over the
    ticker's daily bars. Then one as-of lookup of the distinct (ticker, last printed day) answers all three:
    the entry bar is the successor, or the ticker's first bar where nothing had printed.
    """
    own = Window.partitionBy("ticker").orderBy("date")
    bars = trailing_median_dollar_volume(prices, window, "_adv").select(
        "ticker", "date", "close", F.lead("close").over(own).alias("_next"), F.col("_adv"), F.lag("_adv").over(own).alias("_before")
    )
    firsts = prices.groupBy("ticker").agg(F.min_by("close", "date").alias("_first"))
    day, printed = price_bound(F.col(known_at))
    dated = requests.withColumn("_day", day).withColumn("_bound", F.when(printed, day).otherwise(F.date_sub(day, 1)))
    probes = dated.select("ticker", "_bound").where(F.col("ticker").isNotNull() & F.col("_bound").isNotNull()).distinct()
    # one bar for a ticker and day, and one probe: a key is bounded by the calendar
    hits = asof_join(probes, bars, ["ticker"], "_bound", "date", ["close", "_next", "_adv", "_before"], matched_ts="_at", hot=HotKeys(None, 0))
    out = dated.join(hits, ["ticker", "_bound"], "left").join(firsts, "ticker", "left")
    entry = F.when(F.col("_at").isNotNull(), F.col("_next")).when(F.col("_bound").isNotNull(), F.col("_first"))
    volume = F.when(F.col("_at") < F.col("_day"), F.col("_adv")).otherwise(F.col("_before"))
    return out.select(*requests.columns, F.col("close").alias("last_close"), entry.alias("entry_close"), volume.alias("adv_20d"))


def market_cap_candidates(
    shares: DataFrame, known: DataFrame, prices: DataFrame, listings: DataFrame,
    config: UniverseConfig, window: int = 20, min_days: int = 100,
) -> DataFrame:
    """Shares x printed price per firm-quarter, qualified under both price readings.

    ``shares`` (cik, period_end, shares_outstanding, implausible_jump, ...),
    ``known`` (cik, period_end, known_at, event_source, ...), ``prices``
    (ticker, date, close, volume) and ``listings`` (cik, ticker, sic_code,
    listing_exchange). Rows are kept whatever is missing.
    """
    rows = shares.join(known, ["cik", "period_end"], "left").join(listings, "cik", "left")
    days = prices.groupBy("ticker").agg(F.count("*").alias("trading_days"))
    rows = rows.join(days, "ticker", "left").withColumn("trading_days", F.coalesce("trading_days", F.lit(0).cast("long")))
    rows = rows.withColumn("low_trading_days", F.col("trading_days") < min_days)
    rows = printed_figures(rows, prices, window)
    rows = rows.withColumn("market_cap", F.col("shares_outstanding") * F.col("last_close"))
    rows = rows.withColumn("entry_market_cap", F.col("shares_outstanding") * F.col("entry_close"))

    def verdict(cap: str) -> tuple[Column, Column]:
        judged = F.col(cap).isNotNull() & F.col("listing_exchange").isNotNull()
        return judged, qualification(F.col(cap), F.col("adv_20d"), F.col("listing_exchange"), F.lit(0), config)

    judged, reason = verdict("market_cap")
    entry_judged, entry_reason = verdict("entry_market_cap")
    rows = rows.withColumn("qualifies", F.when(judged, reason.isNull()))
    rows = rows.withColumn(
        "qualification_differs",
        F.coalesce(judged & entry_judged & (reason.isNull() != entry_reason.isNull()), F.lit(False)),
    )
    missing = F.when(F.col("known_at").isNull(), "no_periodic_filing_for_period_end_so_no_known_at").otherwise(
        "market_cap_or_listing_unavailable"
    )
    return rows.withColumn("disqualification_reason", F.when(judged, reason).otherwise(missing))


def exclusion_window(events: DataFrame, others: DataFrame, calendar: Calendar, days: int, key: str = "entity_id", date: str = "date") -> DataFrame:
    """Drop rows of ``others`` within ``days`` sessions of an event of the same entity.

    Each event marks its sessions, which turns the range anti join into an equi one.
    """
    marked = (
        events.select(key, F.col(date).alias("date")).distinct().join(calendar.days, "date")
        .select(key, F.explode(F.sequence(F.col("idx") - days, F.col("idx") + days)).alias("idx"))
        .distinct()
    )
    dated = others.join(calendar.days.withColumnRenamed("date", date), date)
    return dated.join(marked, [key, "idx"], "left_anti").drop("idx")
