"""Whole studies: operators chained the way a research run uses them.

Each study takes DataFrames and returns a dict of named result DataFrames.
Stages that are read several times are staged on reliable storage once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import EQUITY_ROUND_TRIP_BPS, FX_ROUND_TRIP_BPS
from tidemark.operators import bootstrap as bs
from tidemark.operators import cv
from tidemark.operators import evaluate as ev
from tidemark.operators import identity as idn
from tidemark.operators import models as md
from tidemark.operators import panel as pn
from tidemark.operators import reports
from tidemark.operators.ordered import top_n
from tidemark.session import durable


@dataclass(frozen=True)
class SentimentConfig:
    baseline: int = 8
    horizons: tuple[int, ...] = (5, 21, 42)
    primary: int = 21
    legs: int = 3
    periods: int = 8
    prior_trials: int = 52
    min_pooled: int = 100
    min_district: int = 30
    fdr: float = 0.10
    folds: int = 5
    cost_bps: float = EQUITY_ROUND_TRIP_BPS

    def label_horizon(self, h: int) -> timedelta:
        """Trading days to a safe number of calendar days."""
        return timedelta(days=int(h * 1.45) + 7)


def sentiment_panel(
    sentiment: DataFrame, prices: DataFrame, districts: DataFrame, benchmark: str, config: SentimentConfig = SentimentConfig(),
    weights: DataFrame | None = None, min_weight: float | None = None,
) -> DataFrame:
    """Features, entry dates and forward excess returns, one row per release and district.

    ``sentiment`` (release_date, district, polarity), ``prices`` (ticker, date,
    close), ``districts`` (ticker, district). With ``weights`` (ticker, year,
    weight) baskets use the weights known on each day; ``min_weight`` makes
    them equal weights of the names reaching it.
    """
    calendar = pn.trading_calendar(prices)
    returns = pn.simple_return(pn.densify(prices, calendar))
    bench = pn.benchmark_series(returns, benchmark)
    members = returns.join(pn.mapped_with_prices(districts, prices), "ticker")
    if weights is None:
        baskets = pn.equal_weight_basket(members, "district")
    else:
        mode = "weighted" if min_weight is None else "subset"
        baskets = pn.weighted_basket(pn.join_vintage(members, weights), "district", "weight", mode, min_weight)
    forward = pn.forward_excess(baskets, bench, config.horizons, "district", ret="basket_ret")
    s = pn.trailing_zscore(sentiment, "polarity", config.baseline, "district", "release_date", "z8")
    s = pn.change(s, "polarity", "district", "release_date", "chg")
    s = pn.next_trading_day(s, "release_date", calendar).where(F.col("entry_date").isNotNull()).drop("entry_idx")
    panel = pn.attach_forward(s, forward, "district", config.horizons)
    for c in ("z8", "chg", *(f"fwd_{h}" for h in config.horizons)):
        panel = panel.withColumn(c, ev.clean(c))
    return panel


def sentiment_study(panel: DataFrame, config: SentimentConfig = SentimentConfig(), feature: str = "z8") -> dict[str, DataFrame]:
    """Pooled and per-district ICs, walk-forward folds, long/short strategy, deflated Sharpe, verdict."""
    panel = durable(panel)
    y = f"fwd_{config.primary}"
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("y")) for h in config.horizons])
    long = panel.select("release_date", "district", "z8", "chg", F.explode(pairs).alias("_p"))
    long = long.select("release_date", "district", "z8", "chg", "_p.*").unpivot(
        ["release_date", "district", "horizon", "y"], ["z8", "chg"], "feature", "x"
    )
    by = ["feature", "horizon"]
    pooled = ev.information_coefficient(long, "x", "y", by, config.min_pooled).drop("t")
    rank = ev.rank_information_coefficient(long, "x", "y", by, config.min_pooled)
    rank = rank.select(*by, F.col("ic").alias("ic_spearman"), F.col("p").alias("p_spearman"))
    pooled = durable(ev.benjamini_hochberg(pooled.join(rank, by), "p", fdr=config.fdr, out="survives"))
    districts = ev.information_coefficient(panel, feature, y, ["district"], config.min_district, "one").drop("t")
    districts = durable(ev.benjamini_hochberg(districts, "p", fdr=config.fdr, out="survives"))
    folds = durable(
        ev.walk_forward_ic(
            panel.select("entry_date", "release_date", "district", feature, y), feature, y, "entry_date",
            ["release_date", "district"], config.folds, config.label_horizon(config.primary), timedelta(days=5),
        )
    )
    strategy = ev.long_short(panel, feature, y, ["release_date", "entry_date"], "district", config.legs)
    strategy = durable(strategy.withColumn("net", ev.transaction_costs(F.col("ls"), config.cost_bps)))
    trials = config.prior_trials + len(config.horizons) * 2 + 1
    sharpes = reports.union_all(
        [
            ev.deflated_sharpe(strategy, "net", 1, periods=config.periods),
            ev.deflated_sharpe(strategy, "net", trials, periods=config.periods),
        ]
    )
    primary = pooled.where((F.col("feature") == feature) & (F.col("horizon") == config.primary))
    facts = (
        primary.agg(F.max("ic").alias("ic"), F.max("survives").alias("survives"))
        .join(districts.agg(F.count_if("survives").alias("n_districts")))
        .join(ev.sign_stability(folds, "ic").select("sign_agrees"))
        .join(strategy.agg(F.avg("net").alias("mean_net")))
    )  # one row each
    verdict = reports.decide(
        facts,
        {
            "pooled_survives": F.col("survives"), "folds_agree": F.col("sign_agrees"),
            "net_positive": F.col("mean_net") > 0,
        },
    )
    return {
        "pooled": pooled, "districts": districts, "folds": folds, "strategy": strategy, "sharpes": sharpes,
        "stability": ev.sign_stability(folds, "ic"), "strategy_t": ev.one_sample_t(strategy, "ls"), "verdict": verdict,
    }


def stress_test(panel: DataFrame, feature: str, horizon: int, n_boot: int = 10_000) -> dict[str, DataFrame]:
    """Second pass on one finding: block bootstrap by release and every-second-release subsamples."""
    panel = durable(panel)
    y = f"fwd_{horizon}"
    return {
        "bootstrap": bs.block_bootstrap_ic(panel, "release_date", feature, y, n_boot),
        "alternate": ev.alternate_subsamples(panel, "release_date", feature, y),
        "naive": ev.information_coefficient(panel, feature, y),
    }


def holdings_study(
    holdings: DataFrame, cusip_map: DataFrame, prices: DataFrame, top: int = 20, horizons: Sequence[int] = (20, 60, 120),
    benchmark: DataFrame | None = None, cost_bps: float = EQUITY_ROUND_TRIP_BPS, fdr: float = 0.10,
) -> dict[str, DataFrame]:
    """Copycat portfolios of the largest reported positions, gross and net, by manager and horizon.

    ``benchmark`` (date, close) switches the returns to excess over it.
    """
    keys = ["manager", "filing_date", "period_of_report", "cusip", "name_of_issuer"]
    summed = pn.sum_holdings(holdings, keys, "value_thousands")
    largest = top_n(summed, ["manager", "filing_date"], [F.desc("value_thousands"), F.asc("cusip")], top)
    mapped = idn.map_tickers(largest, cusip_map)
    kept = pn.active_with_prices(mapped, prices)
    calendar = pn.trading_calendar(prices)
    if benchmark is None:
        legs, ret = pn.fixed_horizon_return(kept, prices, calendar, "filing_date", horizons), "fwd_ret"
    else:
        legs, ret = pn.excess_over_benchmark(kept, prices, benchmark, calendar, "filing_date", horizons), "excess"
    portfolio = durable(ev.portfolio_return(legs, ["manager", "filing_date", "horizon"], ret))
    summary = ev.horizon_summary(portfolio, "ret", ["manager"], "horizon")
    halves = ev.split_halves(portfolio, ["filing_date"], ["manager", "horizon"])
    return {
        "portfolio": portfolio,
        "summary": ev.benjamini_hochberg(summary, "p", fdr=fdr, out="survives"),
        "net": ev.net_summary(portfolio, "ret", ["manager", "horizon"], cost_bps),
        "halves": ev.one_sample_t(halves, "ret", ["manager", "horizon", "half"], p_value=False),
        "unpriced": mapped.where(F.col("status") == "active").join(prices.select("ticker").distinct(), "ticker", "left_anti")
        .select("ticker").distinct(),
    }


def head_to_head(portfolio: DataFrame, first: str, second: str) -> DataFrame:
    """A8 between two managers, per horizon."""
    rows = portfolio.where(F.col("manager").isin(first, second))
    return ev.welch_t(rows, "ret", F.col("manager") == first, ["horizon"])


def rate_study(
    series: DataFrame, rate: str, pairs: Sequence[str], horizons: Sequence[int] = (5, 20, 60), change: int = 60,
    fill: int = 5, min_n: int = 200, fdr: float = 0.10,
) -> dict[str, DataFrame]:
    """Rate level and change against forward currency returns.

    ``series`` (series_id, date, value). Gaps of up to ``fill`` rows are
    carried, then only dates on which all series have a value stay.
    """
    names = [rate, *pairs]
    wanted = series.where(F.col("series_id").isin(names))
    calendar = pn.trading_calendar(wanted)
    dense = pn.densify(wanted, calendar, "series_id")
    filled = pn.forward_fill(dense, "value", "series_id", "date", fill)
    aligned = durable(pn.complete_dates(filled, names).select("series_id", "date", "value"))
    level = aligned.where(F.col("series_id") == rate)
    feats = pn.change_over(level, "value", change, "series_id", "date", "rate_change", relative=False)
    feats = feats.select("date", F.col("value").alias("rate_level"), "rate_change").unpivot(
        ["date"], ["rate_level", "rate_change"], "feature", "x"
    )
    quotes = aligned.where(F.col("series_id").isin(list(pairs)))
    legs = None
    for h in horizons:
        leg = pn.forward_change(quotes, "value", h, "series_id", "date", "y")
        leg = leg.select(F.col("series_id").alias("pair"), "date", F.lit(h).alias("horizon"), "y")
        legs = leg if legs is None else legs.unionByName(leg)
    grid = durable(feats.join(legs, "date"))
    ics = durable(ev.information_coefficient(grid, "x", "y", ["pair", "feature", "horizon"], min_n).drop("t"))
    return {
        "grid": grid, "ics": ics, "corrected": ev.benjamini_hochberg(ics, "p", fdr=fdr, out="survives"),
        "scan": ev.naive_scan(ics, "p"),
    }


def carry_backtest(
    grid: DataFrame, pair: str, feature: str, horizon: int, n_trials: int, alpha: float = 1.0, folds: int = 5
) -> dict[str, DataFrame]:
    """Purged-fold ridge on one cell of the rate grid, and the deflated Sharpe of the median-sign rule."""
    cell = grid.where((F.col("pair") == pair) & (F.col("feature") == feature) & (F.col("horizon") == horizon))
    rows = durable(cell.select("pair", "date", "x", "y").dropna())
    split = cv.purged_kfold(rows, "date", [], folds)
    rule = ev.median_sign_strategy(rows, "x", "y", ["pair"])
    rule = rule.withColumn("net", ev.transaction_costs(F.col("strategy"), FX_ROUND_TRIP_BPS))
    return {
        "fold_ics": md.out_of_sample_ic(split, ["x"], "y", alpha, p_value=True),
        "sharpes": reports.union_all([ev.deflated_sharpe(rule, c, n) for c in ("strategy", "net") for n in (1, n_trials)]),
    }
