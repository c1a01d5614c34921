"""Daily panels on a shared calendar: returns, baskets, trailing and forward windows.

Contract: a panel holds at most one row per (entity, date). ``daily_bars``
enforces it with a partial aggregate, so a window over one entity is bounded
by the length of the calendar no matter how many raw rows that entity had.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date as Date
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.gates import gate


def daily_bars(rows: DataFrame, entity: str, ts: str, value: str, tie: str) -> DataFrame:
    """S10-shaped bars: last value of the day as close, row count as volume."""
    return (
        rows.groupBy(F.col(entity).alias("ticker"), F.to_date(ts).alias("date"))
        .agg(F.max_by(value, F.struct(ts, tie)).alias("close"), F.count("*").alias("volume"))
    )


# ---------------------------------------------------------------- calendar


MAX_DAYS = 200_000  # five centuries of days; more means the column is no date


@dataclass(frozen=True)
class Calendar:
    """Ordered trading days ``(date, idx)``.

    A calendar is bounded by time, not by data, so it is read once, checked
    against ``MAX_DAYS`` and kept as a local table that every join broadcasts.
    """

    spark: SparkSession
    dates: tuple[Date, ...]

    @property
    def size(self) -> int:
        return len(self.dates)

    @property
    def days(self) -> DataFrame:
        numbers = pa.array(range(1, self.size + 1), pa.int64())
        return self._local({"date": pa.array(self.dates, pa.date32()), "idx": numbers})

    def rolled_forward(self, strict: bool) -> DataFrame:
        """Every natural day up to the last session with the session it rolls to."""
        day, session, number = [], [], []
        before = self.dates[0] - timedelta(days=1)
        for i, current in enumerate(self.dates, 1):
            # strict: days [before, current) roll to current; else (before, current]
            shift = 0 if strict else 1
            for k in range((current - before).days):
                day.append(before + timedelta(days=k + shift))
                session.append(current)
                number.append(i)
            before = current
        return self._local(
            {"_day": pa.array(day, pa.date32()), "_date": pa.array(session, pa.date32()), "_idx": pa.array(number, pa.int64())}
        )

    def _local(self, columns: dict) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(pa.table(columns)))


def trading_calendar(rows: DataFrame, date: str = "date") -> Calendar:
    """Shared row index of a panel, from the distinct days of any date or instant column."""
    distinct = rows.select(F.to_date(date).alias("date")).where(F.col("date").isNotNull()).distinct()
    found = sorted(r[0] for r in distinct.limit(MAX_DAYS + 1).collect())
    if len(found) > MAX_DAYS:
        raise ValueError(f"{date} has more than {MAX_DAYS} distinct days")
    if found and (found[-1] - found[0]).days > MAX_DAYS:
        raise ValueError(f"{date} spans more than {MAX_DAYS} days, from {found[0]} to {found[-1]}")
    if not found:
        raise ValueError(f"{date} has no days to build a calendar from")
    return Calendar(rows.sparkSession, tuple(found))


def next_trading_day(
    df: DataFrame, date: str, calendar: Calendar, strict: bool = True, out: str = "entry_date", out_idx: str = "entry_idx"
) -> DataFrame:
    """First trading day after (or on) ``date``; NULL past the calendar's end.

    A forward as-of against days is an equi-join once the calendar is unrolled
    to natural days, and that table is small enough to broadcast.
    """
    by_day = calendar.rolled_forward(strict).withColumnsRenamed({"_date": out, "_idx": out_idx})
    # anything earlier than the calendar rolls forward to its first day
    floor = calendar.dates[0] - timedelta(days=1) if strict else calendar.dates[0]
    probe = F.greatest(F.to_date(date), F.lit(floor))
    return df.withColumn("_day", F.when(F.col(date).isNotNull(), probe)).join(by_day, "_day", "left").drop("_day")


def densify(panel: DataFrame, calendar: Calendar, entity: str = "ticker", date: str = "date") -> DataFrame:
    """One row per entity and calendar day from the entity's first day on (the wide matrix, kept long)."""
    placed = panel.join(calendar.days.withColumnRenamed("date", date), date)
    spine = placed.groupBy(entity).agg(F.min("idx").alias("_lo")).select(
        entity, F.explode(F.sequence(F.col("_lo"), F.lit(calendar.size).cast("long"))).alias("idx")
    )
    spine = spine.join(calendar.days.withColumnRenamed("date", date), "idx")
    return spine.join(panel, [entity, date], "left")


# ---------------------------------------------------------------- trailing windows


def _by(entity: str, date: str):
    return Window.partitionBy(entity).orderBy(date)


def forward_fill(panel: DataFrame, column: str, entity: str, date: str, limit: int | None = None, out: str | None = None):
    """Last non-null value, at most ``limit`` rows old (None = unbounded)."""
    frame = _by(entity, date).rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return panel.withColumn(out or column, F.last(column, ignorenulls=True).over(frame))


def simple_return(panel: DataFrame, entity="ticker", date="date", close="close", out="ret", pad: bool = True) -> DataFrame:
    """Close / previous close - 1 over the panel's rows; ``pad`` fills missing closes first."""
    if pad:
        panel = forward_fill(panel, close, entity, date, None, "_px")
    else:
        panel = panel.withColumn("_px", F.col(close))
    previous = F.lag("_px").over(_by(entity, date))
    return panel.withColumn(out, F.try_divide("_px", previous) - 1).drop("_px")


def change_over(panel: DataFrame, column: str, h: int, entity: str, date: str, out: str, relative: bool = True) -> DataFrame:
    """H-row relative change, or difference with ``relative=False``."""
    past = F.lag(column, h).over(_by(entity, date))
    value = F.try_divide(F.col(column), past) - 1 if relative else F.col(column) - past
    return panel.withColumn(out, value)


def forward_change(panel: DataFrame, column: str, h: int, entity: str, date: str, out: str) -> DataFrame:
    """Relative change over the next h rows."""
    ahead = F.lead(column, h).over(_by(entity, date))
    return panel.withColumn(out, F.try_divide(ahead, F.col(column)) - 1)


def trailing_zscore(panel: DataFrame, column: str, n: int, entity: str, date: str, out: str = "z") -> DataFrame:
    """(x - mean) / sd of the previous ``n`` rows, all of which must exist."""
    w = _by(entity, date).rowsBetween(-n, -1)
    full = F.count(column).over(w) == n
    z = F.try_divide(F.col(column) - F.avg(column).over(w), F.stddev_samp(column).over(w))
    return panel.withColumn(out, F.when(full, z))


def change(panel: DataFrame, column: str, entity: str, date: str, out: str = "chg") -> DataFrame:
    """Difference to the previous row."""
    return panel.withColumn(out, F.col(column) - F.lag(column).over(_by(entity, date)))


def trailing_median_dollar_volume(bars: DataFrame, window: int = 20, out: str = "adv") -> DataFrame:
    """W12 per bar: median close*volume of the last ``window`` bars ending at this bar."""
    w = _by("ticker", "date").rowsBetween(-(window - 1), 0)
    dollars = F.col("close") * F.col("volume")
    median = F.percentile(dollars, F.lit(0.5)).over(w)
    return bars.withColumn(out, F.when(F.count(dollars).over(w) == window, median))


def median_adv_as_of(requests: DataFrame, bars: DataFrame, as_of: str, window: int = 20, out: str = "adv") -> DataFrame:
    """The figure known strictly before ``as_of``; short histories give NULL."""
    return asof_join(
        requests, trailing_median_dollar_volume(bars, window, out), ["ticker"], as_of, "date", [out], strict=True
    )


# ---------------------------------------------------------------- baskets


def equal_weight_basket(returns: DataFrame, group: str, date="date", ret="ret", out="basket_ret") -> DataFrame:
    """Mean return of the constituents that traded that day."""
    return returns.groupBy(date, group).agg(F.avg(ret).alias(out))


WEIGHT_MODES = ("weighted", "equal", "subset")


def weighted_basket(
    returns: DataFrame, group: str, weight: str, mode: str = "weighted", min_weight: float | None = None,
    date: str = "date", ret: str = "ret",
) -> DataFrame:
    """A12/A13 per day: sum(r*w)/sum(w) over names with a return, and breadth 1/sum(w^2).

    ``equal`` gives every weighted name weight 1; ``subset`` does so only for
    weights of at least ``min_weight``. A day without weight yields NULL.
    """
    if mode not in WEIGHT_MODES:
        raise ValueError(f"mode must be one of {WEIGHT_MODES}")
    w = F.col(weight)
    if mode == "equal":
        w = F.when(w.isNotNull(), F.lit(1.0))
    elif mode == "subset":
        w = F.when(w >= F.lit(min_weight), F.lit(1.0))
    rows = returns.withColumn("_w", F.when(F.col(ret).isNotNull(), w))
    total, squares = F.sum("_w"), F.sum(F.col("_w") * F.col("_w"))
    positive = total > 0
    return rows.groupBy(date, group).agg(
        F.when(positive, F.try_divide(F.sum(F.col(ret) * F.col("_w")), total)).alias("basket_ret"),
        F.when(positive & (squares > 0), F.try_divide(total * total, squares)).alias("breadth"),
        F.count("_w").alias("n_names"),
    )


def mean_breadth(basket: DataFrame, group: str) -> DataFrame:
    """Mean effective breadth over the days that carry weight."""
    return basket.groupBy(group).agg(F.avg("breadth").alias("eff_n"))


def vintage(ts: Column, first: int = 2009, last: int = 2025) -> Column:
    """Survey year Y is usable from 1 October of Y."""
    ripe = F.when((F.month(ts) >= 10), F.year(ts)).otherwise(F.year(ts) - 1)
    return F.greatest(F.lit(first), F.least(F.lit(last), ripe))


def join_vintage(daily: DataFrame, weights: DataFrame, date: str = "date", first: int = 2009, last: int = 2025) -> DataFrame:
    """Yearly weights as known on each day; ``weights`` has (ticker, year, weight)."""
    keyed = daily.withColumn("_v", vintage(F.col(date), first, last))
    known = weights.withColumnRenamed("year", "_v")
    return keyed.join(known, ["ticker", "_v"], "left").withColumnRenamed("_v", "vintage")


# ---------------------------------------------------------------- forward returns


def forward_compound(daily: DataFrame, h: int, entity: str, date: str = "date", ret: str = "ret", out: str | None = None) -> DataFrame:
    """W5 leg: product of the next h daily growth factors; missing return = flat, short tail = NULL."""
    ahead = _by(entity, date).rowsBetween(1, h)
    growth = F.product(F.lit(1.0) + F.coalesce(F.col(ret), F.lit(0.0))).over(ahead)
    return daily.withColumn(out or f"fwd_{h}", F.when(F.count(F.lit(1)).over(ahead) == h, growth - 1))


def forward_excess(
    baskets: DataFrame, benchmark: DataFrame, horizons: Sequence[int], entity: str,
    date: str = "date", ret: str = "ret", bench_ret: str = "bench_ret",
) -> DataFrame:
    """Forward compounded return minus the benchmark's over the same days.

    The benchmark has one row per day, so it is joined as a day table and its
    forward leg is computed once per day.
    """
    bench = benchmark.withColumn("_b", F.lit(0))
    out = baskets
    for h in horizons:
        bench = forward_compound(bench, h, "_b", date, bench_ret, f"_bench_{h}")
        out = forward_compound(out, h, entity, date, ret, f"_leg_{h}")
    out = out.join(bench.select(date, *[f"_bench_{h}" for h in horizons]), date, "left")
    for h in horizons:
        out = out.withColumn(f"fwd_{h}", F.col(f"_leg_{h}") - F.col(f"_bench_{h}"))
    return out.drop(*[f"_leg_{h}" for h in horizons], *[f"_bench_{h}" for h in horizons])


def fixed_horizon_return(
    events: DataFrame, panel: DataFrame, calendar: Calendar, date: str, horizons: Sequence[int], strict: bool = True
) -> DataFrame:
    """Entry on the calendar, exit ``h`` sessions later, on the shared index.

    One row per event and horizon. Two equi-joins on (ticker, idx); NULL when a
    price is missing or the entry price is zero.
    """
    placed = next_trading_day(events, date, calendar, strict)
    px = panel.join(calendar.days, "date").select("ticker", F.col("idx"), "close")
    legs = placed.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    legs = legs.withColumn("exit_idx", F.col("entry_idx") + F.col("horizon"))
    entry = px.select("ticker", F.col("idx").alias("entry_idx"), F.col("close").alias("p0"))
    leave = px.select("ticker", F.col("idx").alias("exit_idx"), F.col("close").alias("p1"))
    joined = legs.join(entry, ["ticker", "entry_idx"], "left").join(leave, ["ticker", "exit_idx"], "left")
    return joined.withColumn("fwd_ret", F.try_divide("p1", "p0") - 1)


def excess_over_benchmark(
    events: DataFrame, panel: DataFrame, benchmark: DataFrame, calendar: Calendar, date: str, horizons: Sequence[int]
) -> DataFrame:
    """Asset minus benchmark over the identical window; ``benchmark`` has (date, close)."""
    asset = fixed_horizon_return(events, panel, calendar, date, horizons)
    days = benchmark.join(calendar.days, "date")
    b0 = days.select(F.col("idx").alias("entry_idx"), F.col("close").alias("_b0"))
    b1 = days.select(F.col("idx").alias("exit_idx"), F.col("close").alias("_b1"))
    out = asset.join(b0, "entry_idx", "left").join(b1, "exit_idx", "left")
    out = out.withColumn("bench_ret", F.try_divide("_b1", "_b0") - 1)
    return out.withColumn("excess", F.col("fwd_ret") - F.col("bench_ret")).drop("_b0", "_b1")


def complete_dates(series: DataFrame, required: Sequence[str], key="series_id", date="date", value="value") -> DataFrame:
    """Keep the dates on which every required series has a value."""
    present = series.where(F.col(key).isin(list(required)) & F.col(value).isNotNull())
    full = present.groupBy(date).agg(F.countDistinct(key).alias("_k")).where(F.col("_k") == len(set(required)))
    return series.join(full, date, "left_semi")


def differentials(series: DataFrame, base: DataFrame, signs: dict[str, int], date: str = "date") -> DataFrame:
    """Value minus the base series of the day, and the value under each series' quoting sign.

    ``signs`` holds -1 for series quoted the other way round (a short spec, kept as a CASE).
    """
    sign = F.lit(1)
    for name, s in signs.items():
        sign = F.when(F.col("series_id") == name, F.lit(s)).otherwise(sign)
    out = series.join(base, date)
    return out.withColumn("differential", F.col("value") - F.col("base")).withColumn("usd_value", sign * F.col("value")).drop("base")


def publication_lag_join(daily: DataFrame, monthly: DataFrame, by: Sequence[str], date: str, value: str, days: int) -> DataFrame:
    """A monthly figure becomes visible ``days`` after its own date."""
    visible = monthly.withColumn("_visible", F.date_add(date, days))
    return asof_join(daily, visible, by, date, "_visible", [value])


def to_wide(df: DataFrame, index: str, key: str, value: str, names: Sequence[str]) -> DataFrame:
    """Pivot with the column list given, so Spark needs no extra pass to find it."""
    return df.groupBy(index).pivot(key, list(names)).agg(F.first(value))


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], key: str, value: str) -> DataFrame:
    """Unpivot and drop missing cells."""
    return df.unpivot(list(ids), list(columns), key, value).where(F.col(value).isNotNull())


def drop_short_series(df: DataFrame, key: str = "ticker", min_rows: int = 100) -> DataFrame:
    """Keep series with at least ``min_rows`` rows."""
    long_enough = df.groupBy(key).count().where(F.col("count") >= min_rows)
    return df.join(long_enough, key, "left_semi")


# ---------------------------------------------------------------- holdings and maps


def sum_holdings(holdings: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A10: one row per key; split positions are added up."""
    return holdings.groupBy(*keys).agg(F.sum(value).alias(value))


def mapped_with_prices(mapping: DataFrame, prices: DataFrame, key: str = "ticker") -> DataFrame:
    """Keep mapping rows whose ticker has at least one price."""
    return mapping.join(prices.select(key).distinct(), key, "left_semi")


def active_with_prices(rows: DataFrame, prices: DataFrame, status: str = "status", wanted: str = "active", key: str = "ticker") -> DataFrame:
    """Active rows that also have prices."""
    return mapped_with_prices(rows.where(F.col(status) == wanted), prices, key)


def benchmark_series(returns: DataFrame, ticker: str, date: str = "date", ret: str = "ret") -> DataFrame:
    """The benchmark's daily return; a missing benchmark stops the study."""
    series = returns.where(F.col("ticker") == ticker).select(date, F.col(ret).alias("bench_ret"))
    gate("benchmark_present", bool(series.take(1)), ticker)
    return series


def attach_forward(features: DataFrame, forward: DataFrame, unit: str, horizons: Sequence[int], date: str = "date") -> DataFrame:
    """Forward returns on (entry_date, unit); rows without one stay with NULL."""
    legs = forward.select(F.col(date).alias("entry_date"), unit, *[f"fwd_{h}" for h in horizons])
    return features.join(legs, ["entry_date", unit], "left")


def ordered_output(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """O1: totally ordered by ``keys`` (range partitioned, so every task sorts its own range)."""
    return df.orderBy(*keys)
