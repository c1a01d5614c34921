"""Judging results: Sharpe, IC, t-tests, false-discovery control."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.distributions import expected_max_z, norm_cdf, t_p_value
from tidemark.operators.cv import purged_kfold
from tidemark.operators.ordered import MAX_GROUP_ROWS, MAX_PERCENTILE_ROWS, average_rank, grouped_percentile, ordinal
from tidemark.session import small_side


def clean(column: str) -> Column:
    """P17 + NaN-as-null: one missing value for NULL, NaN and infinities."""
    c = F.col(column).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def sharpe_ratio(df: DataFrame, ret: str, keys: Sequence[str] = (), periods: int = 252) -> DataFrame:
    """A1: annualised Sharpe; 0.0 when there are fewer than two returns or no spread."""
    m, s, n = F.avg("_r"), F.stddev_samp("_r"), F.count("_r")
    value = F.when((n >= 2) & (s > 0), m / s * math.sqrt(periods)).otherwise(F.lit(0.0))
    return df.withColumn("_r", clean(ret)).groupBy(*keys).agg(n.alias("n_obs"), value.alias("sharpe"))


def return_moments(df: DataFrame, ret: str, keys: Sequence[str] = ()) -> DataFrame:
    """Moments the deflated Sharpe needs, in one aggregate (population skew, non-excess kurtosis)."""
    return df.withColumn("_r", clean(ret)).groupBy(*keys).agg(
        F.count("_r").alias("n_obs"),
        F.avg("_r").alias("mean"),
        F.stddev_samp("_r").alias("sd"),
        F.skewness("_r").alias("skew"),
        (F.kurtosis("_r") + 3).alias("kurtosis"),
    )


def deflated_sharpe(
    df: DataFrame, ret: str, n_trials: int, keys: Sequence[str] = (), sr_benchmark: float = 0.0, periods: int = 252
) -> DataFrame:
    """A2: probability that the true Sharpe beats the benchmark after ``n_trials`` tries.

    One schema for every group; below three observations the Sharpe fields are
    0 and the moments are NULL.
    """
    m = return_moments(df, ret, keys)
    enough = F.col("n_obs") >= 3
    sr = F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")).otherwise(F.lit(0.0))
    skew, kurt = F.coalesce("skew", F.lit(0.0)), F.coalesce("kurtosis", F.lit(0.0))
    m = m.withColumn("_sr", sr)
    variance = (1 - skew * F.col("_sr") + (kurt - 1) / 4 * F.col("_sr") * F.col("_sr")) / F.greatest(
        F.col("n_obs") - 1, F.lit(1)
    )
    m = m.withColumn("_sigma", F.sqrt(F.greatest(variance, F.lit(1e-12))))
    m = m.withColumn("_emax", F.col("_sigma") * F.lit(expected_max_z(n_trials)))
    z = (F.col("_sr") - F.lit(float(sr_benchmark)) - F.col("_emax")) / F.col("_sigma")
    return m.select(
        *keys,
        "n_obs",
        F.lit(n_trials).alias("n_trials"),
        F.when(enough, F.col("_sr") * math.sqrt(periods)).otherwise(0.0).alias("sr_annualized"),
        F.when(enough, norm_cdf(z)).otherwise(0.0).alias("dsr_probability"),
        F.when(enough, F.col("_emax")).otherwise(0.0).alias("expected_max_sr"),
        F.when(enough, F.col("skew")).alias("skew"),
        F.when(enough, F.col("kurtosis")).alias("kurtosis"),
    )


def overfitting_share(df: DataFrame, sharpe: str, keys: Sequence[str] = ()) -> DataFrame:
    """A3: share of out-of-sample Sharpe ratios below zero; NULL without any."""
    s = clean(sharpe)
    return df.groupBy(*keys).agg(F.avg(F.when(s.isNotNull(), (s < 0).cast("double"))).alias("pbo"))


def correlation_t(ic: Column, n: Column) -> Column:
    """P20: t statistic of a correlation on n - 2 degrees of freedom."""
    return F.when(F.abs(ic) < 1, ic * F.sqrt(F.try_divide(n - 2, 1 - ic * ic)))


def information_coefficient(
    df: DataFrame, x: str, y: str, keys: Sequence[str] = (), min_n: int = 3, below: str = "skip", p_value: bool = True
) -> DataFrame:
    """Pearson IC per group over complete pairs.

    Groups under ``min_n`` are dropped (``below='skip'``) or kept with NULL IC
    and p = 1 (``below='one'``).
    """
    if below not in ("skip", "one"):
        raise ValueError("below must be 'skip' or 'one'")
    a, b = clean(x), clean(y)
    both = a.isNotNull() & b.isNotNull()
    out = df.groupBy(*keys).agg(
        F.count(F.when(both, 1)).alias("n"), F.corr(F.when(both, a), F.when(both, b)).alias("ic")
    )
    out = out.withColumn("ic", F.when(~F.isnan("ic"), F.col("ic")))
    small = F.col("n") < min_n
    if below == "skip":
        out = out.where(~small)
    else:
        out = out.withColumn("ic", F.when(~small, F.col("ic")))
    out = out.withColumn("t", correlation_t(F.col("ic"), F.col("n")))
    if not p_value:
        return out
    exact = F.when(F.abs(F.col("ic")) >= 1, F.lit(0.0))
    p = F.coalesce(t_p_value(F.col("t"), F.col("n") - 2), exact)
    return out.withColumn("p", F.when(small, F.lit(1.0)).otherwise(p))


def rank_information_coefficient(
    df: DataFrame, x: str, y: str, keys: Sequence[str] = (), min_n: int = 3, p_value: bool = True,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """A5: Spearman IC: average ranks of both columns, then A4."""
    pairs = df.select(*keys, clean(x).alias("_x"), clean(y).alias("_y")).dropna(subset=["_x", "_y"])
    ranked = average_rank(pairs, "_x", keys, "_rx", max_rows)
    ranked = average_rank(ranked, "_y", keys, "_ry", max_rows)
    return information_coefficient(ranked, "_rx", "_ry", keys, min_n, p_value=p_value)


def one_sided_p(ic: Column, p: Column) -> Column:
    """One-sided p for a predicted positive sign."""
    return F.when(ic > 0, p / 2).otherwise(1 - p / 2)


def one_sample_t(df: DataFrame, value: str, keys: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """Test of mean zero."""
    v = clean(value)
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    out = out.withColumn("t", F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n"))))
    return out.withColumn("p", t_p_value(F.col("t"), F.col("n") - 1)) if p_value else out


def welch_t(df: DataFrame, value: str, is_first: Column, keys: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """Unequal-variance two-sample test, both samples in one aggregate."""
    v = clean(value)
    a, b = F.when(is_first, v), F.when(~is_first, v)
    out = df.groupBy(*keys).agg(
        F.count(a).alias("n1"), F.avg(a).alias("mean1"), F.var_samp(a).alias("_v1"),
        F.count(b).alias("n2"), F.avg(b).alias("mean2"), F.var_samp(b).alias("_v2"),
    )
    q1, q2 = F.try_divide("_v1", "n1"), F.try_divide("_v2", "n2")
    out = out.withColumn("t", F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(q1 + q2)))
    spread = F.try_divide(q1 * q1, F.col("n1") - 1) + F.try_divide(q2 * q2, F.col("n2") - 1)
    out = out.withColumn("dof", F.try_divide((q1 + q2) * (q1 + q2), spread)).drop("_v1", "_v2")
    return out.withColumn("p", t_p_value(F.col("t"), F.col("dof"))) if p_value else out


def horizon_summary(df: DataFrame, value: str, keys: Sequence[str], horizon: str, p_value: bool = True) -> DataFrame:
    """N, mean, sd, annualised mean (mean*252/h), t and p per group and horizon."""
    out = one_sample_t(df, value, [*keys, horizon], p_value)
    return out.withColumn("annualized", F.col("mean") * 252 / F.col(horizon))


def portfolio_return(df: DataFrame, keys: Sequence[str], ret: str, out: str = "ret") -> DataFrame:
    """Equal-weight mean over the names that have a return."""
    return df.groupBy(*keys).agg(F.avg(clean(ret)).alias(out))


def walk_forward_ic(
    df: DataFrame, x: str, y: str, ts: str, tie: Sequence[str], n_splits: int = 5,
    horizon: timedelta = timedelta(days=28), embargo: timedelta = timedelta(days=5), min_test: int = 30,
    p_value: bool = True, max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Per purged fold its sizes, test span and test IC; folds with too few test rows are left out."""
    rows = df.withColumn("_x", clean(x)).withColumn("_y", clean(y)).dropna(subset=["_x", "_y"])
    folds = purged_kfold(rows, ts, tie, n_splits, horizon, embargo, max_rows)
    test = F.col("role") == "test"
    sizes = folds.groupBy("fold").agg(
        F.count_if(~test).alias("n_train"), F.count_if(test).alias("n_test"),
        F.min(F.when(test, F.col(ts))).alias("test_start"), F.max(F.when(test, F.col(ts))).alias("test_end"),
    )
    ic = information_coefficient(folds.where(test), "_x", "_y", ["fold"], min_test, p_value=p_value)
    return sizes.join(ic.drop("n"), "fold")


def benjamini_hochberg(
    df: DataFrame, p: str, keys: Sequence[str] = (), fdr: float = 0.10, out: str = "rejected", max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Reject every rank up to the last one with p <= rank/n*fdr; NULL p counts as 1."""
    keys = list(keys)
    held = df.withColumn("_p", F.coalesce(F.col(p), F.lit(1.0)))
    ranked = ordinal(held, ["_p"], keys, "_i", max_rows)
    sizes = held.groupBy(*keys).agg(F.count("*").alias("_n"))
    passed = F.col("_p") <= F.col("_i") / F.col("_n") * F.lit(fdr)
    last = F.max(F.when(passed, F.col("_i"))).alias("_cut")

    def attach(table: DataFrame) -> DataFrame:
        # without keys the side is a single row
        return ranked.join(table, keys) if keys else ranked.join(F.broadcast(table))

    cutoff = attach(sizes).groupBy(*keys).agg(last)
    verdict = F.coalesce(F.col("_i") <= F.col("_cut"), F.lit(False))
    return attach(cutoff).withColumn(out, verdict).drop("_p", "_i", "_cut")


def harvey_liu_zhu_bar(n_tests: Column) -> Column:
    """T-stat bar 3.0, plus 0.15 per doubling of tests beyond 400."""
    n = n_tests.cast("double")
    return F.when(n <= 400, F.lit(3.0)).otherwise(F.lit(3.0) + 0.15 * F.log2(n / 400))


def naive_scan(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """How many look significant, and how many would by chance alone."""
    n = F.count(p)
    return df.agg(
        n.alias("n_tests"),
        F.count_if(F.col(p) < alpha).alias("n_significant"),
        (F.lit(alpha) * (n - 1)).alias("expected_false"),
    )


def sign_stability(df: DataFrame, ic: str, keys: Sequence[str] = ()) -> DataFrame:
    """Positive folds, mean and sd of fold ICs, and whether all signs agree."""
    v = clean(ic)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n_folds"),
        F.count_if(v > 0).alias("n_positive"),
        F.avg(v).alias("mean_ic"),
        F.stddev_samp(v).alias("sd_ic"),
        ((F.count_if(v > 0) == F.count(v)) | (F.count_if(v < 0) == F.count(v))).alias("sign_agrees"),
    )


def long_short(df: DataFrame, feature: str, ret: str, keys: Sequence[str], tie: str, n_leg: int = 3) -> DataFrame:
    """Mean return of the top ``n_leg`` minus the bottom ``n_leg`` by feature.

    ``keys`` name a release, whose rows are one per unit (district, ticker of
    one day); groups with fewer than 2*n_leg complete rows are left out.
    """
    rows = df.select(*keys, tie, clean(feature).alias("_f"), clean(ret).alias("_r")).dropna(subset=["_f", "_r"])
    up = Window.partitionBy(*keys).orderBy("_f", tie)
    down = Window.partitionBy(*keys).orderBy(F.desc("_f"), F.desc(tie))
    low = rows.withColumn("_lo", F.row_number().over(up)).withColumn("_hi", F.row_number().over(down))
    return (
        low.groupBy(*keys)
        .agg(
            F.avg(F.when(F.col("_hi") <= n_leg, F.col("_r"))).alias("long"),
            F.avg(F.when(F.col("_lo") <= n_leg, F.col("_r"))).alias("short"),
            F.count("*").alias("_n"),
        )
        .where(F.col("_n") >= 2 * n_leg)
        .withColumn("ls", F.col("long") - F.col("short"))
        .drop("_n")
    )


def alternate_subsamples(df: DataFrame, release: str, x: str, y: str, p_value: bool = True) -> DataFrame:
    """IC over every second release, for both offsets."""
    rows = df.select(release, clean(x).alias("_x"), clean(y).alias("_y")).dropna(subset=["_x", "_y"])
    # one row per release date: a calendar-sized window
    order = rows.select(release).distinct().withColumn("offset", (F.row_number().over(Window.orderBy(release)) - 1) % 2)
    return information_coefficient(rows.join(order, release), "_x", "_y", ["offset"], 3, p_value=p_value)


def split_halves(df: DataFrame, order: Sequence[str], keys: Sequence[str], out: str = "half", max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """First and second half of each group by filing order (first gets floor(n/2))."""
    ranked = ordinal(df, list(order), keys, "_i", max_rows)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return (
        ranked.join(sizes, list(keys))
        .withColumn(out, F.when(F.col("_i") <= F.floor(F.col("_n") / 2), "first").otherwise("second"))
        .drop("_i", "_n")
    )


def diversity_weights(df: DataFrame, predictions: Sequence[str], target: str) -> DataFrame:
    """weight = positive IC over mean correlation with the other models, normalised.

    All correlations come from one aggregate; the rest runs on one row per model.
    """
    names = list(predictions)
    aggs = [F.corr(n, target).alias(f"ic_{i}") for i, n in enumerate(names)]
    aggs += [F.corr(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i < j]

    def pair(i: int, j: int) -> Column:
        c = F.lit(1.0) if i == j else F.col(f"c_{min(i, j)}_{max(i, j)}")
        return F.coalesce(c, F.lit(0.0))

    rows = []
    for i, name in enumerate(names):
        mean_corr = (sum((pair(i, j) for j in range(len(names))), F.lit(0.0)) - 1) / max(len(names) - 1, 1)
        ic = F.coalesce(F.when(~F.isnan(f"ic_{i}"), F.col(f"ic_{i}")), F.lit(0.0))
        raw = F.greatest(ic, F.lit(0.0)) / F.greatest(mean_corr, F.lit(0.05))
        rows.append(F.struct(F.lit(name).alias("model"), ic.alias("ic"), mean_corr.alias("mean_corr"), raw.alias("_raw")))
    table = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("m")).select("m.*")
    total = F.sum("_raw").over(Window.partitionBy(F.lit(1)))
    weight = F.when(total > 0, F.col("_raw") / total).otherwise(F.lit(1.0 / len(names)))
    return table.withColumn("weight", weight).drop("_raw")


def sign_strategy(feature: Column, ret: Column) -> Column:
    """Hold in the direction of the feature's sign."""
    return F.signum(feature) * ret


def long_or_short(feature: Column, ret: Column) -> Column:
    """Long above zero, short otherwise."""
    return F.when(feature > 0, ret).otherwise(-ret)


def median_sign_strategy(df: DataFrame, feature: str, ret: str, keys: Sequence[str], out: str = "strategy", max_rows: int = MAX_PERCENTILE_ROWS) -> DataFrame:
    """Hold in the direction of (feature - group median)."""
    med = small_side(grouped_percentile(df, keys, feature, [0.5], "_m", max_rows).withColumn("_m", F.col("_m")[0]))
    return df.join(med, list(keys), "left").withColumn(out, F.signum(F.col(feature) - F.col("_m")) * F.col(ret)).drop("_m")


def transaction_costs(ret: Column, bps: float, turnover: float = 1.0) -> Column:
    """Flat round-trip cost."""
    return ret - F.lit(bps / 10_000 * turnover)


def breakeven_turnover(mean_return: Column, bps: float) -> Column:
    """Turnover that eats the mean return; infinite when trading is free."""
    if bps == 0:
        return F.lit(float("inf"))
    return mean_return / F.lit(bps / 10_000)


def net_summary(df: DataFrame, value: str, keys: Sequence[str], bps: float, p_value: bool = True) -> DataFrame:
    """Gross and net means with both t tests, and the break-even turnover."""
    gross = one_sample_t(df, value, keys, p_value)
    net = F.col("mean") - F.lit(bps / 10_000)
    out = gross.withColumn("net_mean", net)
    # a constant cost shifts the mean and leaves the spread alone
    out = out.withColumn("net_t", F.when(F.col("sd") > 0, net / (F.col("sd") / F.sqrt("n"))))
    if p_value:
        out = out.withColumn("net_p", t_p_value(F.col("net_t"), F.col("n") - 1))
    return out.withColumn("breakeven_turnover", breakeven_turnover(F.col("mean"), bps))


def series_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Min, mean and max per series."""
    return df.groupBy(key).agg(F.min(value).alias("lo"), F.avg(value).alias("mean"), F.max(value).alias("hi"))


def cross_sectional_sd(df: DataFrame, date: str, value: str) -> DataFrame:
    """Spread across entities per date."""
    return df.groupBy(date).agg(F.stddev_samp(value).alias("xs_sd"))
