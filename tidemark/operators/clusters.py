"""Insider clusters and the tests specified alongside them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.bootstrap import block_bootstrap_ic
from tidemark.operators.evaluate import clean, rank_information_coefficient
from tidemark.operators.eventstudy import quantile_bucket, quantile_edges
from tidemark.operators.ordered import MAX_GROUP_ROWS, MAX_PERCENTILE_ROWS, average_rank, top_n
from tidemark.operators.panel import Calendar, next_trading_day


BLOCK_WINDOWS = 4  # windows of sessions in a block of trades


def insider_clusters(
    trades: DataFrame, calendar: Calendar, window: int = 5, min_insiders: int = 3, max_sale_share: float = 0.25
) -> DataFrame:
    """First session at which enough distinct insiders bought within ``window`` sessions.

    ``trades`` (issuer, insider, code P or S, value, known_at). Trades are dealt by issuer and block of sessions,
    those of a block's last ``window`` sessions to the next block too, so about one row in four is copied and a
    heavily traded issuer is spread over its blocks. Within a block an insider counts from a purchase until the next
    one or until it leaves the window, so the state is known from the sessions at which trades come or leave.
    ``known_at`` costs a second pass over the purchases, which Spark leaves out where the column is not read.
    """
    span = BLOCK_WINDOWS * window
    placed = next_trading_day(trades.withColumn("_d", F.to_date("known_at")), "_d", calendar, strict=False, out="session", out_idx="idx")
    placed = placed.where(F.col("idx").isNotNull() & F.col("issuer").isNotNull() & F.col("code").isin("P", "S"))
    own, last = F.floor(F.col("idx") / span), F.floor((F.col("idx") + window) / span)
    dealt = placed.select(
        "issuer", "insider", "idx", "value", "known_at", (F.col("code") == "P").alias("_buy"),
        F.explode(F.when(own < last, F.array(own, last)).otherwise(F.array(own))).alias("_block"),
    ).repartition("issuer", "_block")
    block = Window.partitionBy("issuer", "_block")
    leaves = F.col("idx") + window
    again = F.lead("idx").over(Window.partitionBy("issuer", "_block", "insider", "_buy").orderBy("idx"))
    seen = dealt.withColumn("_until", F.when(F.col("_buy"), F.least(leaves, again)).otherwise(leaves))
    # fewer purchases than insiders wanted: no cluster in this block
    seen = seen.withColumn("_buys", F.count_if("_buy").over(block)).where(F.col("_buys") >= min_insiders)

    def change(at: Column, n: Column, bought: Column, sold: Column) -> Column:
        return F.struct(at.alias("end_idx"), n.alias("n"), bought.alias("bought"), sold.alias("sold"))

    one, none = F.col("_buy").cast("long"), F.lit(0.0)
    value = F.coalesce(F.col("value").cast("double"), none)
    comes = change(F.col("idx"), one, F.when(F.col("_buy"), value).otherwise(none), F.when(F.col("_buy"), none).otherwise(value))
    ends, goes = change(F.col("_until"), -one, none, none), change(leaves, F.lit(0).cast("long"), none, none)
    changes = F.when(F.col("_until") < leaves, F.array(comes, ends, goes)).otherwise(F.array(comes, ends))
    daily = seen.select("issuer", "_block", F.inline(changes)).groupBy("issuer", "_block", "end_idx").agg(
        F.sum("n").alias("n"), F.sum("bought").alias("bought"), F.sum("sold").alias("sold")
    )
    # one row per session of the block
    order = block.orderBy("end_idx")
    within = order.rangeBetween(-(window - 1), 0)
    state = daily.select(
        "issuer", "_block", "end_idx", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("n_buyers"),
        F.sum("bought").over(within).alias("bought"), F.sum("sold").over(within).alias("sold"),
    )
    state = state.withColumn("_ok", (F.col("n_buyers") >= min_insiders) & (F.col("sold") <= max_sale_share * F.col("bought")))
    # nothing changes between two rows, so the row before tells the session before
    state = state.withColumn("_before", F.coalesce(F.lag("_ok").over(order), F.lit(False)))
    inside = (F.floor(F.col("end_idx") / span) == F.col("_block")) & (F.col("end_idx") <= calendar.size)
    starts = state.where(F.col("_ok") & ~F.col("_before") & inside).select("issuer", "_block", "end_idx", "n_buyers", "bought", "sold")
    buyers = dealt.where("_buy").select("issuer", "_block", "insider", "idx", "known_at").join(
        starts.select("issuer", "_block", "end_idx"), ["issuer", "_block"]
    ).where(F.col("idx").between(F.col("end_idx") - (window - 1), F.col("end_idx")))
    buyers = buyers.groupBy("issuer", "end_idx", "insider").agg(F.min("known_at").alias("first_buy"))
    completing = top_n(buyers, ["issuer", "end_idx"], ["first_buy", "insider"], min_insiders).where(F.col("rn") == min_insiders)
    completing = completing.groupBy("issuer", "end_idx").agg(F.min("first_buy").alias("known_at"))
    out = starts.drop("_block").join(completing, ["issuer", "end_idx"], "left")
    return out.join(calendar.days.select(F.col("idx").alias("end_idx"), F.col("date").alias("session")), "end_idx")


def routine_trades(trades: DataFrame, years: int = 5, min_years: int = 3) -> DataFrame:
    """Purchases whose insider also bought in the same month in enough of the prior years.

    Each (insider, month, year) with a purchase counts towards the following
    ``years`` years, so no trade is compared with another trade.
    """
    keyed = trades.withColumn("_y", F.year("known_at")).withColumn("_m", F.month("known_at"))
    bought = keyed.where(F.col("code") == "P").select("issuer", "insider", "_m", "_y").distinct()
    credit = bought.withColumn("_y", F.explode(F.sequence(F.col("_y") + 1, F.col("_y") + years)))
    habit = credit.groupBy("issuer", "insider", "_m", "_y").agg(F.count("*").alias("prior_years"))
    out = keyed.join(habit, ["issuer", "insider", "_m", "_y"], "left")
    out = out.withColumn("prior_years", F.coalesce("prior_years", F.lit(0).cast("long")))
    return out.withColumn("is_routine", (F.col("code") == "P") & (F.col("prior_years") >= min_years)).drop("_m", "_y")


def announcement_car(events: DataFrame, abnormal: DataFrame, calendar: Calendar, around: int = 1) -> DataFrame:
    """Abnormal return summed over sessions -around..+around; NULL unless all are present.

    ``events`` (event_id, ticker, date), ``abnormal`` (ticker, date, ret).
    """
    placed = next_trading_day(events, "date", calendar, strict=False, out="session", out_idx="_e")
    legs = placed.withColumn("idx", F.explode(F.sequence(F.col("_e") - around, F.col("_e") + around)))
    days = abnormal.join(calendar.days, "date").select("ticker", "idx", "ret")
    joined = legs.join(days, ["ticker", "idx"], "left")
    full = F.count("ret") == 2 * around + 1
    return joined.groupBy("event_id", "ticker").agg(F.when(full, F.sum("ret")).alias("car"))


def rank_ic_bootstrap(
    df: DataFrame, x: str, y: str, date: str, n_boot: int = 10_000, seed: int = 20260731, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Rank IC with a block bootstrap by week."""
    pairs = df.select(F.trunc(F.to_date(date), "week").alias("week"), clean(x).alias("_x"), clean(y).alias("_y"))
    pairs = pairs.dropna(subset=["_x", "_y"])
    ranked = average_rank(average_rank(pairs, "_x", (), "_rx", max_rows), "_y", (), "_ry", max_rows)
    return block_bootstrap_ic(ranked, "week", "_rx", "_ry", n_boot, seed)


def decile_spread(
    df: DataFrame, signal: str, net: str, keys: Sequence[str] = (), band: str = "adv_bucket", n: int = 10,
    max_rows: int = MAX_PERCENTILE_ROWS,
) -> DataFrame:
    """Top-minus-bottom signal decile of net returns, by cost band."""
    edges = quantile_edges(df, keys, signal, n, max_rows)
    rows = df.join(edges, list(keys)) if keys else df.join(edges)  # a single row without keys
    sized = rows.withColumn("decile", quantile_bucket(F.col(signal), F.col("edges"), n))
    out = sized.groupBy(*keys, band).agg(
        F.avg(F.when(F.col("decile") == n, F.col(net))).alias("top"),
        F.avg(F.when(F.col("decile") == 1, F.col(net))).alias("bottom"),
        F.count_if(F.col("decile").isin(1, n)).alias("n_legs"),
    )
    return out.withColumn("spread", F.col("top") - F.col("bottom"))


def momentum_tercile(df: DataFrame, date: str, momentum: str, n: int = 3, max_rows: int = MAX_PERCENTILE_ROWS) -> DataFrame:
    """Momentum bucket per date, to be used as the extra control key."""
    edges = quantile_edges(df, [date], momentum, n, max_rows)
    out = df.join(edges, date, "left")
    return out.withColumn("momentum_tercile", quantile_bucket(F.col(momentum), F.col("edges"), n)).drop("edges")


def screen_features(
    folds: DataFrame, features: Sequence[str], target: str, row_id: Sequence[str], max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Rank IC of every feature inside each fold's training rows, with sign stability."""
    train = folds.where(F.col("role") == "train")
    long = train.unpivot(["fold", *row_id, target], list(features), "feature", "x")
    ics = rank_information_coefficient(long, "x", target, ["fold", "feature"], 3, p_value=False, max_rows=max_rows)
    return ics.groupBy("feature").agg(
        F.count("ic").alias("n_folds"), F.avg("ic").alias("mean_ic"),
        F.greatest(F.avg((F.col("ic") > 0).cast("double")), F.avg((F.col("ic") < 0).cast("double"))).alias("sign_stability"),
    )


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 5, max_rows: int = MAX_PERCENTILE_ROWS) -> DataFrame:
    """Mutual information (nats) of two columns over quantile bins."""
    rows = df.select(clean(x).alias("_x"), clean(y).alias("_y")).dropna()
    for c in ("_x", "_y"):
        edges = quantile_edges(rows, [], c, bins, max_rows)  # a single row
        rows = rows.join(edges).withColumn(f"{c}b", quantile_bucket(F.col(c), F.col("edges"), bins)).drop("edges")
    # at most bins * bins rows from here on
    cells = rows.groupBy(F.lit(1).alias("_all"), "_xb", "_yb").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("_all"))
    px, py = F.sum("n").over(Window.partitionBy("_all", "_xb")), F.sum("n").over(Window.partitionBy("_all", "_yb"))
    share = F.col("n") / total
    return cells.select((share * F.log(F.col("n") * total / (px * py))).alias("_t")).agg(F.sum("_t").alias("mutual_information"))


def residualize(df: DataFrame, feature: str, factors: Sequence[str], by: Sequence[str], out: str = "residual") -> DataFrame:
    """Feature minus its least-squares fit on the factors, per group (intercept included).

    Groups are reduced to their cross-product sums, solved as small systems,
    and the coefficients are joined back.
    """
    names = ["_one", *factors]
    rows = df.withColumn("_one", F.lit(1.0))
    complete = F.lit(True)
    for c in [feature, *factors]:
        complete = complete & clean(c).isNotNull()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in pairs]
    sums += [F.sum(F.col(n) * F.col(feature)).alias(f"h{i}") for i, n in enumerate(names)]
    grams = rows.where(complete).groupBy(*by).agg(*sums)
    k = len(names)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(g: pd.Series, h: pd.Series) -> pd.Series:
        answers = []
        for upper, right in zip(g, h):
            m = np.zeros((k, k))
            for (i, j), v in zip(pairs, upper):
                m[i, j] = m[j, i] = v
            answers.append(np.linalg.lstsq(m, np.asarray(right, dtype=float), rcond=None)[0])
        return pd.Series(answers)

    g = F.array(*[F.col(f"g{i}_{j}") for i, j in pairs])
    h = F.array(*[F.col(f"h{i}") for i in range(k)])
    betas = grams.select(*by, solve(g, h).alias("_beta"))
    fitted = F.col("_beta")[0]
    for i, c in enumerate(factors):
        fitted = fitted + F.col("_beta")[i + 1] * F.col(c)
    return df.join(betas, list(by), "left").withColumn(out, F.col(feature) - fitted).drop("_beta")


def residualize_one(df: DataFrame, feature: str, factor: str, by: Sequence[str], out: str = "residual") -> DataFrame:
    """X8 with a single factor: slope and intercept are built-in aggregates."""
    both = clean(feature).isNotNull() & clean(factor).isNotNull()
    fit = df.where(both).groupBy(*by).agg(
        F.regr_slope(feature, factor).alias("_b"), F.regr_intercept(feature, factor).alias("_a")
    )
    line = F.col("_a") + F.col("_b") * F.col(factor)
    return df.join(fit, list(by), "left").withColumn(out, F.col(feature) - line).drop("_a", "_b")


def shrink_ics(ics: DataFrame, prior_n: float = 100.0, ic: str = "ic", n: str = "n") -> DataFrame:
    """Pull each signal's IC towards the grand mean, less so with more observations."""
    mean = ics.agg(F.try_divide(F.sum(F.col(ic) * F.col(n)), F.sum(n)).alias("grand_mean"))
    w = F.col(n) / (F.col(n) + F.lit(float(prior_n)))
    return ics.join(mean).withColumn("shrunk_ic", w * F.col(ic) + (1 - w) * F.col("grand_mean"))



