"""Sharpe ratios, information coefficients, tests, splits and bootstraps."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.config import EQUITY_ROUND_TRIP_BPS
from tidemark.functions.distributions import expected_max_z
from tidemark.operators import bootstrap as bs
from tidemark.operators import clusters as cl
from tidemark.operators import cv
from tidemark.operators import evaluate as ev
from tidemark.operators import reports
from tidemark.operators.ordered import average_rank
from tidemark.plans import bindings as b
from tidemark.plans import sqlparts as q
from tidemark.plans.registry import query, rnd, text

DAY = timedelta(days=1)


def _ret(spark, sf):
    return b.padded_returns(spark, sf)


@query(
    "A1_sharpe",
    f"""WITH {q.RET} SELECT ticker, count(ret) AS n_obs, round(CASE WHEN count(ret) >= 2 AND stddev_samp(ret) > 0
      THEN avg(ret) / stddev_samp(ret) * sqrt(252) ELSE 0 END, 5) + 0 AS sharpe FROM ret GROUP BY 1""",
)
def a1(spark, sf):
    return ev.sharpe_ratio(_ret(spark, sf), "ret", ["ticker"]).withColumn("sharpe", rnd("sharpe", 5))


@query(
    "A2_return_moments",
    f"""WITH {q.RET}, m AS (SELECT *, avg(ret) OVER (PARTITION BY ticker) AS mu FROM ret WHERE ret IS NOT NULL)
    SELECT ticker, count(*) AS n_obs, round(avg(ret), 8) + 0 AS mean, round(stddev_samp(ret), 8) AS sd,
      round(avg(power(ret - mu, 3)) / power(avg(power(ret - mu, 2)), 1.5), 5) + 0 AS skew,
      round(avg(power(ret - mu, 4)) / power(avg(power(ret - mu, 2)), 2), 5) AS kurtosis FROM m GROUP BY 1""",
)
def a2_moments(spark, sf):
    m = ev.return_moments(_ret(spark, sf).where(F.col("ret").isNotNull()), "ret", ["ticker"])
    return m.select("ticker", "n_obs", rnd("mean", 8), rnd("sd", 8), rnd("skew", 5), rnd("kurtosis", 5))


@query(
    "A2_deflated_sharpe",
    f"""WITH {q.RET}, m AS (SELECT *, avg(ret) OVER (PARTITION BY ticker) AS mu FROM ret WHERE ret IS NOT NULL),
    g AS (SELECT ticker, count(*) AS n_obs, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(power(ret - mu, 3)) / nullif(power(avg(power(ret - mu, 2)), 1.5), 0) AS skew,
      avg(power(ret - mu, 4)) / nullif(power(avg(power(ret - mu, 2)), 2), 0) AS kurtosis FROM m GROUP BY 1),
    r AS (SELECT *, CASE WHEN sd > 0 THEN mean / sd ELSE 0 END AS sr FROM g),
    v AS (SELECT *, sqrt(greatest((1 - coalesce(skew, 0) * sr + (coalesce(kurtosis, 0) - 1) / 4 * sr * sr) / greatest(n_obs - 1, 1), 1e-12)) AS sigma FROM r),
    z AS (SELECT *, (sr - sigma * {expected_max_z(75)!r}) / sigma AS z FROM v),
    u AS (SELECT ret.ticker FROM ret GROUP BY 1)
    SELECT u.ticker, coalesce(n_obs, 0) AS n_obs, 75 AS n_trials, round(CASE WHEN n_obs >= 3 THEN sr * sqrt(252) ELSE 0 END, 5) + 0 AS sr_annualized,
      round(CASE WHEN n_obs >= 3 THEN {q.normal_cdf("z")} ELSE 0 END, 6) + 0 AS dsr_probability,
      round(CASE WHEN n_obs >= 3 THEN sigma * {expected_max_z(75)!r} ELSE 0 END, 6) AS expected_max_sr,
      round(CASE WHEN n_obs >= 3 THEN skew END, 5) + 0 AS skew, round(CASE WHEN n_obs >= 3 THEN kurtosis END, 5) AS kurtosis
    FROM u LEFT JOIN z USING (ticker)""",
)
def a2(spark, sf):
    out = ev.deflated_sharpe(_ret(spark, sf), "ret", 75, ["ticker"])
    return out.select(
        "ticker", "n_obs", "n_trials", rnd("sr_annualized", 5), rnd("dsr_probability"), rnd("expected_max_sr"), rnd("skew", 5), rnd("kurtosis", 5)
    )


@query(
    "A3_overfitting_share",
    f"""WITH {q.RET}, s AS (SELECT ticker, avg(ret) / nullif(stddev_samp(ret), 0) AS sharpe FROM ret GROUP BY 1)
    SELECT round(avg(CASE WHEN sharpe < 0 THEN 1.0 ELSE 0.0 END), 8) AS pbo FROM s WHERE sharpe IS NOT NULL""",
)
def a3(spark, sf):
    s = ev.sharpe_ratio(_ret(spark, sf), "ret", ["ticker"])
    return ev.overfitting_share(s, "sharpe").select(rnd("pbo", 8))


_PAIRS = "x IS NOT NULL AND y IS NOT NULL"


@query(
    "A4_pearson_ic",
    f"""WITH {q.PANEL}, g AS (SELECT feature, horizon, count(*) AS n, corr(x, y) AS ic FROM longp WHERE {_PAIRS} GROUP BY 1, 2)
    SELECT feature, horizon, n, round(ic, 6) + 0 AS ic, round(ic * sqrt((n - 2) / (1 - ic * ic)), 5) + 0 AS t FROM g WHERE n >= 100""",
)
def a4(spark, sf):
    ic = ev.information_coefficient(b.long_panel(spark, sf), "x", "y", ["feature", "horizon"], 100, p_value=False)
    return ic.select("feature", "horizon", "n", rnd("ic"), rnd("t", 5))


@query(
    "A4_ic_p_values",
    f"""WITH {q.PANEL}, g AS (SELECT feature, horizon, count(*) AS n, corr(x, y) AS ic FROM longp WHERE {_PAIRS} GROUP BY 1, 2),
    s AS (SELECT *, ic * sqrt((n - 2) / (1 - ic * ic)) AS t, n - 2 AS dof FROM g WHERE n >= 100),
    w AS (SELECT *, {q.t_tail("t", "dof")} AS p FROM s)
    SELECT feature, horizon, n, round(ic, 6) + 0 AS ic, round(t, 5) + 0 AS t, round(p, 6) AS p, round(CASE WHEN ic > 0 THEN p / 2 ELSE 1 - p / 2 END, 6) AS one_sided_p FROM w""",
)
def a4_p(spark, sf):
    ic = ev.information_coefficient(b.long_panel(spark, sf), "x", "y", ["feature", "horizon"], 100)
    one = rnd(ev.one_sided_p(F.col("ic"), F.col("p")), 6, "one_sided_p")
    return ic.select("feature", "horizon", "n", rnd("ic"), rnd("t", 5), rnd("p"), one)


@query(
    "P23_one_sided_p",
    f"""WITH {q.RET}, s AS (SELECT ticker, avg(ret) AS ic, count(ret) / 100.0 AS p FROM ret GROUP BY 1)
    SELECT ticker, round(CASE WHEN ic > 0 THEN p / 2 ELSE 1 - p / 2 END, 6) AS p_one FROM s""",
)
def p23(spark, sf):
    s = _ret(spark, sf).groupBy("ticker").agg(F.avg("ret").alias("ic"), (F.count("ret") / 100.0).alias("p"))
    return s.select("ticker", rnd(ev.one_sided_p(F.col("ic"), F.col("p")), 6, "p_one"))


_RANKS = """r AS (
  SELECT feature, horizon, x, y,
    rank() OVER (PARTITION BY feature, horizon ORDER BY x) + (count(*) OVER (PARTITION BY feature, horizon, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY feature, horizon ORDER BY y) + (count(*) OVER (PARTITION BY feature, horizon, y) - 1) / 2.0 AS ry
  FROM longp WHERE x IS NOT NULL AND y IS NOT NULL)"""


@query(
    "A5_spearman_ic",
    f"WITH {q.PANEL}, {_RANKS} SELECT feature, horizon, count(*) AS n, round(corr(rx, ry), 5) + 0 AS ic FROM r GROUP BY 1, 2 HAVING count(*) >= 100",
)
def a5(spark, sf):
    ic = ev.rank_information_coefficient(b.long_panel(spark, sf), "x", "y", ["feature", "horizon"], 100, p_value=False)
    return ic.select("feature", "horizon", "n", rnd("ic", 5))


@query(
    "W14_average_rank",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
      rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
        + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rank_avg FROM lineitem""",
)
def w14(spark, sf):
    out = average_rank(b.table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "rank_avg")


@query(
    "A6_grouped_ic",
    f"""WITH {q.PANEL}, g AS (SELECT district, count(CASE WHEN z8 IS NOT NULL AND fwd_5 IS NOT NULL THEN 1 END) AS n,
      corr(z8, fwd_5) FILTER (z8 IS NOT NULL AND fwd_5 IS NOT NULL) AS ic FROM panel GROUP BY 1)
    SELECT district, n, CASE WHEN n >= 16 THEN round(ic, 6) + 0 END AS ic FROM g""",
)
def a6(spark, sf):
    ic = ev.information_coefficient(b.staged_panel(spark, sf), "z8", "fwd_5", ["district"], 16, "one", p_value=False)
    return ic.select("district", "n", rnd("ic"))


@query(
    "A7_one_sample_t",
    f"""WITH {q.RET} SELECT ticker, count(ret) AS n, round(avg(ret), 8) + 0 AS mean, round(stddev_samp(ret), 8) AS sd,
      round(avg(ret) / (stddev_samp(ret) / sqrt(count(ret))), 5) + 0 AS t FROM ret GROUP BY 1""",
)
def a7(spark, sf):
    out = ev.one_sample_t(_ret(spark, sf), "ret", ["ticker"], p_value=False)
    return out.select("ticker", "n", rnd("mean", 8), rnd("sd", 8), rnd("t", 5))


@query(
    "A7_t_test_p",
    f"""WITH {q.RET}, g AS (SELECT ticker, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd FROM ret GROUP BY 1),
    s AS (SELECT *, CASE WHEN sd > 0 THEN mean / (sd / sqrt(n)) END AS t, n - 1 AS dof FROM g)
    SELECT ticker, n, round(mean, 8) + 0 AS mean, round(sd, 8) AS sd, round(t, 5) + 0 AS t, round(CASE WHEN t IS NOT NULL THEN {q.t_tail("t", "dof")} END, 6) AS p FROM s""",
)
def a7_p(spark, sf):
    out = ev.one_sample_t(_ret(spark, sf), "ret", ["ticker"])
    return out.select("ticker", "n", rnd("mean", 8), rnd("sd", 8), rnd("t", 5), rnd("p"))


@query(
    "A8_welch_t",
    """WITH m AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS n1, avg(l_discount) FILTER (l_returnflag = 'A') AS m1,
        var_samp(l_discount) FILTER (l_returnflag = 'A') AS v1, count(*) FILTER (l_returnflag <> 'A') AS n2,
        avg(l_discount) FILTER (l_returnflag <> 'A') AS m2, var_samp(l_discount) FILTER (l_returnflag <> 'A') AS v2 FROM lineitem GROUP BY 1)
    SELECT l_suppkey, n1, n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 5) + 0 AS t,
      round(power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)), 4) AS dof FROM m""",
)
def a8(spark, sf):
    out = ev.welch_t(b.table(spark, sf, "lineitem"), "l_discount", F.col("l_returnflag") == "A", ["l_suppkey"], p_value=False)
    return out.select("l_suppkey", "n1", "n2", rnd("t", 5), rnd("dof", 4))


@query(
    "A8_welch_p",
    f"""WITH m AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS n1, avg(l_discount) FILTER (l_returnflag = 'A') AS m1,
        var_samp(l_discount) FILTER (l_returnflag = 'A') AS v1, count(*) FILTER (l_returnflag <> 'A') AS n2,
        avg(l_discount) FILTER (l_returnflag <> 'A') AS m2, var_samp(l_discount) FILTER (l_returnflag <> 'A') AS v2 FROM lineitem GROUP BY 1),
    s AS (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
      power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)) AS dof FROM m)
    SELECT l_suppkey, n1, n2, round(t, 5) + 0 AS t, round(dof, 4) AS dof, round(CASE WHEN t IS NOT NULL THEN {q.t_tail("t", "dof")} END, 6) AS p FROM s""",
)
def a8_p(spark, sf):
    out = ev.welch_t(b.table(spark, sf, "lineitem"), "l_discount", F.col("l_returnflag") == "A", ["l_suppkey"])
    return out.select("l_suppkey", "n1", "n2", rnd("t", 5), rnd("dof", 4), rnd("p"))


_FORWARD = f"""{q.CAL}, ev AS (
  SELECT event_id, user_id, CAST(ts AS DATE) AS filing_date, event_type AS manager, CAST(user_id AS VARCHAR) AS ticker,
         (SELECT min(idx) FROM cal WHERE date > CAST(ts AS DATE)) AS entry_idx FROM events
), px AS (SELECT ticker, idx, close FROM bars JOIN cal USING (date)),
fwd AS (
  SELECT e.*, h AS horizon, p1.close / nullif(p0.close, 0) - 1 AS fwd_ret
  FROM ev e, (VALUES (1), (5), (20)) t(h)
  LEFT JOIN px p0 ON p0.ticker = e.ticker AND p0.idx = e.entry_idx
  LEFT JOIN px p1 ON p1.ticker = e.ticker AND p1.idx = e.entry_idx + h
), port AS (SELECT manager, filing_date, horizon, avg(fwd_ret) AS ret FROM fwd GROUP BY 1, 2, 3)"""


def _portfolio(spark, sf):
    """Mean forward return per (manager, filing, horizon), managers being event types."""
    from tidemark.operators.panel import fixed_horizon_return

    px = b.bars(spark, sf)
    e = b.table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("manager"), F.to_date("ts").alias("filing_date"),
        F.col("user_id").cast("string").alias("ticker"),
    )
    fwd = fixed_horizon_return(e, px, b.calendar(spark, sf), "filing_date", [1, 5, 20])
    return ev.portfolio_return(fwd, ["manager", "filing_date", "horizon"], "fwd_ret")


@query(
    "A41_portfolio_return",
    f"WITH {_FORWARD} SELECT manager, CAST(filing_date AS VARCHAR) AS filing_date, horizon, round(ret, 8) + 0 AS ret FROM port",
)
def a41(spark, sf):
    return _portfolio(spark, sf).select("manager", text("filing_date"), "horizon", rnd("ret", 8))


@query(
    "A9_horizon_summary",
    f"""WITH {_FORWARD} SELECT manager, horizon, count(ret) AS n, round(avg(ret), 8) + 0 AS mean, round(stddev_samp(ret), 8) AS sd,
      round(avg(ret) * 252 / horizon, 6) + 0 AS annualized, round(avg(ret) / (stddev_samp(ret) / sqrt(count(ret))), 5) + 0 AS t
    FROM port GROUP BY 1, 2""",
)
def a9(spark, sf):
    out = ev.horizon_summary(_portfolio(spark, sf), "ret", ["manager"], "horizon", p_value=False)
    return out.select("manager", "horizon", "n", rnd("mean", 8), rnd("sd", 8), rnd("annualized"), rnd("t", 5))


@query(
    "A42_net_summary",
    f"""WITH {_FORWARD} SELECT manager, horizon, round(avg(ret), 8) + 0 AS mean, round(avg(ret) - 0.002, 8) + 0 AS net_mean,
      round((avg(ret) - 0.002) / (stddev_samp(ret) / sqrt(count(ret))), 5) + 0 AS net_t, round(avg(ret) / 0.002, 5) + 0 AS breakeven_turnover
    FROM port GROUP BY 1, 2""",
)
def a42(spark, sf):
    out = ev.net_summary(_portfolio(spark, sf), "ret", ["manager", "horizon"], EQUITY_ROUND_TRIP_BPS, p_value=False)
    return out.select("manager", "horizon", rnd("mean", 8), rnd("net_mean", 8), rnd("net_t", 5), rnd("breakeven_turnover", 5))


@query(
    "A31_split_halves",
    f"""WITH {_FORWARD}, r AS (SELECT *, row_number() OVER (PARTITION BY manager, horizon ORDER BY filing_date) AS i,
      count(*) OVER (PARTITION BY manager, horizon) AS n FROM port)
    SELECT manager, horizon, CASE WHEN i <= n // 2 THEN 'first' ELSE 'second' END AS half, count(ret) AS n, round(avg(ret), 8) + 0 AS mean
    FROM r GROUP BY 1, 2, 3""",
)
def a31(spark, sf):
    halves = ev.split_halves(_portfolio(spark, sf), ["filing_date"], ["manager", "horizon"])
    return halves.groupBy("manager", "horizon", "half").agg(F.count("ret").alias("n"), rnd(F.avg("ret"), 8, "mean"))


@query(
    "P1_transaction_costs",
    f"WITH {q.RET} SELECT ticker, CAST(date AS VARCHAR) AS date, round(ret - 0.002 * 0.5, 8) + 0 AS net FROM ret",
)
def p1(spark, sf):
    net = ev.transaction_costs(F.col("ret"), EQUITY_ROUND_TRIP_BPS, 0.5)
    return _ret(spark, sf).select("ticker", text("date"), rnd(net, 8, "net"))


@query(
    "P2_breakeven_turnover",
    f"WITH {q.RET} SELECT ticker, round(avg(ret) / 0.002, 5) + 0 AS breakeven, CAST('inf' AS DOUBLE) AS free FROM ret GROUP BY 1",
)
def p2(spark, sf):
    m = F.avg("ret")
    return _ret(spark, sf).groupBy("ticker").agg(
        rnd(ev.breakeven_turnover(m, EQUITY_ROUND_TRIP_BPS), 5, "breakeven")
    ).withColumn("free", ev.breakeven_turnover(F.lit(1.0), 0))


@query(
    "P16_sign_strategies",
    f"""WITH {q.PANEL}, m AS (SELECT district, quantile_cont(chg, 0.5) AS med FROM panel WHERE chg IS NOT NULL GROUP BY 1)
    SELECT p.district, CAST(release_date AS VARCHAR) AS release_date, round(sign(chg) * fwd_5, 6) + 0 AS by_sign,
      round(CASE WHEN chg > 0 THEN fwd_5 ELSE -fwd_5 END, 6) + 0 AS long_or_short, round(sign(chg - med) * fwd_5, 6) + 0 AS by_median
    FROM panel p LEFT JOIN m USING (district)""",
)
def p16(spark, sf):
    p = b.staged_panel(spark, sf)
    p = ev.median_sign_strategy(p, "chg", "fwd_5", ["district"], "by_median")
    return p.select(
        "district", text("release_date"), rnd(ev.sign_strategy(F.col("chg"), F.col("fwd_5")), 6, "by_sign"),
        rnd(ev.long_or_short(F.col("chg"), F.col("fwd_5")), 6, "long_or_short"), rnd("by_median"),
    )


@query(
    "P17_infinite_to_null",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount > 0 THEN round(l_tax / l_discount, 8) END AS ratio FROM lineitem""",
)
def p17(spark, sf):
    inf = F.when(F.col("l_discount") > 0, F.try_divide("l_tax", "l_discount")).otherwise(F.lit(float("inf")))
    li = b.table(spark, sf, "lineitem").withColumn("raw", inf)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rnd(ev.clean("raw"), 8, "ratio"))


@query(
    "P19_hurdle_t",
    """SELECT o_custkey, n, round(CASE WHEN n * 50 <= 400 THEN 3.0 ELSE 3.0 + 0.15 * log2(n * 50 / 400.0) END, 8) AS bar
    FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""",
)
def p19(spark, sf):
    n = b.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.withColumn("bar", rnd(ev.harvey_liu_zhu_bar(F.col("n") * 50), 8, "bar"))


@query(
    "P20_t_filter",
    f"""WITH {q.PANEL}, g AS (SELECT district, horizon, feature, count(*) AS n, corr(x, y) AS ic FROM longp WHERE {_PAIRS} GROUP BY 1, 2, 3)
    SELECT district, horizon, feature, round(ic * sqrt(n - 2) / sqrt(1 - ic * ic), 5) + 0 AS t FROM g
    WHERE abs(ic * sqrt(n - 2) / sqrt(1 - ic * ic)) > 1.5""",
)
def p20(spark, sf):
    ic = ev.information_coefficient(b.long_panel(spark, sf), "x", "y", ["district", "horizon", "feature"], 3, p_value=False)
    return ic.where(F.abs("t") > 1.5).select("district", "horizon", "feature", rnd("t", 5))


@query(
    "W15_long_short",
    f"""WITH {q.PANEL}, r AS (SELECT release_date, entry_date, fwd_5, row_number() OVER (w ORDER BY chg, district) AS lo,
      row_number() OVER (w ORDER BY chg DESC, district DESC) AS hi, count(*) OVER w AS n
      FROM panel WHERE chg IS NOT NULL AND fwd_5 IS NOT NULL WINDOW w AS (PARTITION BY release_date, entry_date))
    SELECT CAST(release_date AS VARCHAR) AS release_date, CAST(entry_date AS VARCHAR) AS entry_date,
      round(avg(fwd_5) FILTER (hi <= 3), 6) + 0 AS long, round(avg(fwd_5) FILTER (lo <= 3), 6) + 0 AS short,
      round(avg(fwd_5) FILTER (hi <= 3) - avg(fwd_5) FILTER (lo <= 3), 6) + 0 AS ls FROM r WHERE n >= 6 GROUP BY ALL""",
)
def w15(spark, sf):
    out = ev.long_short(b.staged_panel(spark, sf), "chg", "fwd_5", ["release_date", "entry_date"], "district", 3)
    return out.select(text("release_date"), text("entry_date"), rnd("long"), rnd("short"), rnd("ls"))


_PV = "SELECT o_custkey AS test_id, (min(o_totalprice) % 1000.0) / 20000 AS p FROM orders GROUP BY 1"


@query(
    "W16_benjamini_hochberg",
    f"""WITH t AS ({_PV}), r AS (SELECT *, row_number() OVER (ORDER BY p, test_id) AS i, count(*) OVER () AS n FROM t),
    c AS (SELECT max(i) AS cut FROM r WHERE p <= i / n * 0.04)
    SELECT test_id, coalesce(i <= cut, false) AS rejected FROM r, c""",
)
def w16(spark, sf):
    t = b.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("test_id")).agg(
        (F.pmod(F.min("o_totalprice"), F.lit(1000.0)) / 20000).alias("p")
    )
    return ev.benjamini_hochberg(t, "p", fdr=0.04).select("test_id", "rejected")


@query(
    "W16_by_batch",
    f"""WITH t AS ({_PV}), k AS (SELECT t.*, c_nationkey AS batch FROM t JOIN customer ON c_custkey = test_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY p, test_id) AS i, count(*) OVER (PARTITION BY batch) AS n FROM k),
    c AS (SELECT batch, max(i) FILTER (p <= i / n * 0.05) AS cut FROM r GROUP BY 1)
    SELECT test_id, batch, coalesce(i <= cut, false) AS rejected FROM r JOIN c USING (batch)""",
)
def w16_batch(spark, sf):
    t = b.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("test_id")).agg(
        (F.pmod(F.min("o_totalprice"), F.lit(1000.0)) / 20000).alias("p")
    )
    c = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("test_id"), F.col("c_nationkey").alias("batch"))
    return ev.benjamini_hochberg(t.join(c, "test_id"), "p", ["batch"], 0.05).select("test_id", "batch", "rejected")


@query(
    "A43_naive_scan",
    f"""WITH t AS ({_PV}) SELECT count(p) AS n_tests, count(*) FILTER (p < 0.01) AS n_significant,
      round(CAST(0.01 AS DOUBLE) * (count(p) - 1), 8) AS expected_false FROM t""",
)
def a43(spark, sf):
    t = b.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("test_id")).agg(
        (F.pmod(F.min("o_totalprice"), F.lit(1000.0)) / 20000).alias("p")
    )
    return ev.naive_scan(t, "p", 0.01).withColumn("expected_false", rnd("expected_false", 8))


@query(
    "A28_sign_stability",
    f"""WITH {q.PANEL}, g AS (SELECT feature, horizon, district, corr(x, y) AS ic FROM longp WHERE {_PAIRS} GROUP BY 1, 2, 3)
    SELECT feature, horizon, count(ic) AS n_folds, count(*) FILTER (ic > 0) AS n_positive, round(avg(ic), 6) + 0 AS mean_ic,
      round(stddev_samp(ic), 6) AS sd_ic, count(*) FILTER (ic > 0) = count(ic) OR count(*) FILTER (ic < 0) = count(ic) AS sign_agrees
    FROM g GROUP BY 1, 2""",
)
def a28(spark, sf):
    ic = ev.information_coefficient(b.long_panel(spark, sf), "x", "y", ["feature", "horizon", "district"], 3, p_value=False)
    out = ev.sign_stability(ic, "ic", ["feature", "horizon"])
    return out.withColumn("mean_ic", rnd("mean_ic")).withColumn("sd_ic", rnd("sd_ic"))


@query(
    "A30_alternate_releases",
    f"""WITH {q.PANEL}, c AS (SELECT * FROM panel WHERE chg IS NOT NULL AND fwd_5 IS NOT NULL),
    o AS (SELECT *, (dense_rank() OVER (ORDER BY release_date) - 1) % 2 AS k FROM c)
    SELECT CAST(k AS INTEGER) AS "offset", count(*) AS n, round(corr(chg, fwd_5), 6) + 0 AS ic FROM o GROUP BY 1""",
)
def a30(spark, sf):
    out = ev.alternate_subsamples(b.staged_panel(spark, sf), "release_date", "chg", "fwd_5", p_value=False)
    return out.select("offset", "n", rnd("ic"))


@query(
    "A29_block_sums",
    f"""WITH {q.PANEL} SELECT CAST(release_date AS VARCHAR) AS block, count(*) AS n, round(sum(chg), 6) + 0 AS sx, round(sum(fwd_5), 6) + 0 AS sy,
      round(sum(chg * chg), 5) AS sxx, round(sum(fwd_5 * fwd_5), 6) AS syy, round(sum(chg * fwd_5), 6) + 0 AS sxy
    FROM panel WHERE chg IS NOT NULL AND fwd_5 IS NOT NULL GROUP BY 1""",
)
def a29_sums(spark, sf):
    s = bs.block_sums(b.staged_panel(spark, sf), "release_date", "chg", "fwd_5")
    return s.select(text("block"), "n", rnd("sx"), rnd("sy"), rnd("sxx", 5), rnd("syy"), rnd("sxy"))


def _boot(out):
    return out.select("ic", "n_obs", "n_blocks", "ci_low", "ci_high", "se", "p", "naive_se", "se_inflation").select(
        rnd("ic"), "n_obs", "n_blocks", rnd("ci_low"), rnd("ci_high"), rnd("se"), rnd("p", 4), rnd("naive_se"), rnd("se_inflation", 5)
    )


_BOTH = "chg IS NOT NULL AND fwd_5 IS NOT NULL"


@query(
    "A29_block_bootstrap",
    f"""WITH {q.PANEL}, {q.bootstrap(f"SELECT release_date AS block, chg AS x, fwd_5 AS y FROM panel WHERE {_BOTH}")} {q.BOOT}""",
)
def a29(spark, sf):
    return _boot(bs.block_bootstrap_ic(b.staged_panel(spark, sf), "release_date", "chg", "fwd_5"))


@query(
    "A39_decision",
    f"""WITH {q.PANEL}, c AS (SELECT corr(chg, fwd_5) AS ic, count(*) AS n, avg(fwd_5) AS mean FROM panel WHERE chg IS NOT NULL AND fwd_5 IS NOT NULL)
    SELECT round(ic, 6) + 0 AS ic, n, n >= 100 AS enough, ic > 0 AS right_sign, mean > 0.002 AS beats_cost,
      n >= 100 AND ic > 0 AND mean > 0.002 AS passes FROM c""",
)
def a39(spark, sf):
    p = b.staged_panel(spark, sf).where(F.col("chg").isNotNull() & F.col("fwd_5").isNotNull())
    m = p.agg(F.corr("chg", "fwd_5").alias("ic"), F.count("*").alias("n"), F.avg("fwd_5").alias("mean"))
    rules = {"enough": F.col("n") >= 100, "right_sign": F.col("ic") > 0, "beats_cost": F.col("mean") > 0.002}
    return reports.decide(m, rules).drop("mean").withColumn("ic", rnd("ic"))


_PRED = "SELECT l_shipdate, l_quantity AS m1, l_extendedprice AS m2, l_quantity * 3 + l_extendedprice / 5000 AS m3, l_tax AS m4, l_extendedprice * (1 - l_discount) AS y FROM lineitem"


@query(
    "A32_diversity_weights",
    f"""WITH p AS ({_PRED}), c AS (SELECT corr(m1, y) AS i1, corr(m2, y) AS i2, corr(m3, y) AS i3, corr(m4, y) AS i4,
      corr(m1, m2) AS c12, corr(m1, m3) AS c13, corr(m1, m4) AS c14, corr(m2, m3) AS c23, corr(m2, m4) AS c24, corr(m3, m4) AS c34 FROM p),
    w AS (SELECT unnest(['m1', 'm2', 'm3', 'm4']) AS model, unnest([i1, i2, i3, i4]) AS ic,
      unnest([(c12 + c13 + c14) / 3, (c12 + c23 + c24) / 3, (c13 + c23 + c34) / 3, (c14 + c24 + c34) / 3]) AS mc FROM c),
    r AS (SELECT model, ic, mc, greatest(ic, 0) / greatest(mc, 0.05) AS raw FROM w)
    SELECT model, round(ic, 6) + 0 AS ic, round(mc, 6) + 0 AS mean_corr, round(raw / sum(raw) OVER (), 6) AS weight FROM r""",
)
def a32(spark, sf):
    li = b.table(spark, sf, "lineitem")
    p = li.select(
        F.col("l_quantity").alias("m1"), F.col("l_extendedprice").alias("m2"),
        (F.col("l_quantity") * 3 + F.col("l_extendedprice") / 5000).alias("m3"), F.col("l_tax").alias("m4"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"),
    )
    out = ev.diversity_weights(p, ["m1", "m2", "m3", "m4"], "y")
    return out.select("model", rnd("ic"), rnd("mean_corr"), rnd("weight"))


# ---------------------------------------------------------------- splits


def _blocks_sql(k: int, horizon: int, embargo: int) -> str:
    return f"""s AS (SELECT event_id, ts, ntile({k}) OVER (ORDER BY ts, event_id) - 1 AS blk FROM events),
    f AS (SELECT blk AS fold, min(ts) AS a, max(ts) AS z FROM s GROUP BY 1),
    shut AS (SELECT event_id, ts, blk, fold, (ts <= z AND ts + INTERVAL {horizon} DAY >= a)
        OR (ts > z AND ts <= z + INTERVAL {embargo} DAY) AS out FROM s, f)"""


@query(
    "C1_purged_kfold",
    f"""WITH {_blocks_sql(5, 2, 1)} SELECT event_id, CAST(fold AS INTEGER) AS fold, CASE WHEN blk = fold THEN 'test' ELSE 'train' END AS role
    FROM shut WHERE blk = fold OR NOT out""",
)
def c1(spark, sf):
    folds = cv.purged_kfold(b.table(spark, sf, "events").select("event_id", "ts"), "ts", ["event_id"], 5, 2 * DAY, DAY)
    return folds.select("event_id", "fold", "role")


_C2 = f"""{_blocks_sql(6, 2, 1)}, combos AS (
  SELECT row_number() OVER (ORDER BY a.fold, c.fold) - 1 AS combo, a.fold AS f1, c.fold AS f2 FROM f a JOIN f c ON a.fold < c.fold
), roles AS (
  SELECT combo, s.event_id, CASE WHEN any_value(s.blk) IN (any_value(f1), any_value(f2)) THEN 'test' WHEN NOT bool_or(out) THEN 'train' END AS role
  FROM combos JOIN shut s ON s.fold IN (f1, f2) GROUP BY 1, 2)"""


@query(
    "C2_combinatorial_purged",
    f"""WITH {_C2} SELECT CAST(combo AS INTEGER) AS combo, role, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum FROM roles WHERE role IS NOT NULL GROUP BY 1, 2""",
)
def c2(spark, sf):
    folds = cv.combinatorial_purged(b.table(spark, sf, "events").select("event_id", "ts"), "ts", ["event_id"], 6, 2, 2 * DAY, DAY)
    return folds.groupBy("combo", "role").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


def _walk_sql(anchored: bool) -> str:
    start = "lo" if anchored else "a - INTERVAL 240 HOUR"
    return f"""b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
    w AS (SELECT i AS fold, lo, lo + INTERVAL 240 HOUR + i * INTERVAL 72 HOUR AS a FROM b, range(0, 60) t(i)
          WHERE lo + INTERVAL 240 HOUR + i * INTERVAL 72 HOUR + INTERVAL 96 HOUR <= hi),
    r AS (SELECT fold, a, event_id, CASE WHEN ts >= a AND ts < a + INTERVAL 96 HOUR THEN 'test'
             WHEN ts >= {start} AND ts < a - INTERVAL 24 HOUR THEN 'train' END AS role FROM events, w)"""


@query(
    "C3_walk_forward_anchored",
    f"""WITH {_walk_sql(True)} SELECT CAST(fold AS INTEGER) AS fold, CAST(a AS VARCHAR) AS test_start, event_id, role FROM r WHERE role IS NOT NULL""",
)
def c3(spark, sf):
    e = b.table(spark, sf, "events").select("event_id", "ts")
    folds = cv.walk_forward(e, "ts", 10 * DAY, 4 * DAY, 3 * DAY, True, DAY)
    return folds.select("fold", text("test_start"), "event_id", "role")


@query(
    "C3_walk_forward_rolling",
    f"""WITH {_walk_sql(False)} SELECT CAST(fold AS INTEGER) AS fold, count(*) FILTER (role = 'train') AS n_train,
      count(*) FILTER (role = 'test') AS n_test FROM r WHERE role IS NOT NULL GROUP BY 1""",
)
def c3_rolling(spark, sf):
    e = b.table(spark, sf, "events").select("event_id", "ts")
    return cv.fold_sizes(cv.walk_forward(e, "ts", 10 * DAY, 4 * DAY, 3 * DAY, False, DAY))


_FOLD_ROLES = f"""WITH {q.PANEL}, c AS (SELECT * FROM panel WHERE chg IS NOT NULL AND fwd_5 IS NOT NULL),
    s AS (SELECT *, ntile(5) OVER (ORDER BY entry_date, release_date, district) - 1 AS blk FROM c),
    f AS (SELECT blk AS fold, min(entry_date) AS a, max(entry_date) AS z FROM s GROUP BY 1),
    r AS (SELECT fold, s.*, CASE WHEN blk = fold THEN 'test' WHEN NOT ((entry_date <= z AND entry_date + 4 >= a)
        OR (entry_date > z AND entry_date <= z + 1)) THEN 'train' END AS role FROM s, f)"""


@query(
    "A27_walk_forward_ic",
    f"""{_FOLD_ROLES}
    SELECT CAST(fold AS INTEGER) AS fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test,
      CAST(min(entry_date) FILTER (role = 'test') AS VARCHAR) AS test_start, CAST(max(entry_date) FILTER (role = 'test') AS VARCHAR) AS test_end,
      round(corr(chg, fwd_5) FILTER (role = 'test'), 6) + 0 AS ic FROM r GROUP BY 1 HAVING count(*) FILTER (role = 'test') >= 30""",
)
def a27(spark, sf):
    p = b.staged_panel(spark, sf).select("entry_date", "release_date", "district", "chg", "fwd_5")
    out = ev.walk_forward_ic(
        p, "chg", "fwd_5", "entry_date", ["release_date", "district"], 5, 4 * DAY, DAY, p_value=False
    )
    return out.select("fold", "n_train", "n_test", text("test_start"), text("test_end"), rnd("ic"))


@query(
    "A27_walk_forward_p",
    f"""{_FOLD_ROLES},
    g AS (SELECT CAST(fold AS INTEGER) AS fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test,
      corr(chg, fwd_5) FILTER (role = 'test') AS ic FROM r GROUP BY 1 HAVING count(*) FILTER (role = 'test') >= 30),
    w AS (SELECT *, ic * sqrt((n_test - 2) / (1 - ic * ic)) AS t, n_test - 2 AS dof FROM g)
    SELECT fold, n_train, n_test, round(ic, 6) + 0 AS ic, round(t, 5) + 0 AS t, round({q.t_tail("t", "dof")}, 6) AS p FROM w""",
)
def a27_p(spark, sf):
    p = b.staged_panel(spark, sf).select("entry_date", "release_date", "district", "chg", "fwd_5")
    out = ev.walk_forward_ic(p, "chg", "fwd_5", "entry_date", ["release_date", "district"], 5, 4 * DAY, DAY)
    return out.select("fold", "n_train", "n_test", rnd("ic"), rnd("t", 5), rnd("p"))


# ---------------------------------------------------------------- specified extras


@query(
    "X5_rank_ic_bootstrap",
    f"""WITH {q.PANEL}, c AS (SELECT date_trunc('week', release_date) AS block, chg, fwd_5 FROM panel WHERE {_BOTH}),
    rk AS (SELECT block, rank() OVER (ORDER BY chg) + (count(*) OVER (PARTITION BY chg) - 1) / 2.0 AS x,
      rank() OVER (ORDER BY fwd_5) + (count(*) OVER (PARTITION BY fwd_5) - 1) / 2.0 AS y FROM c),
    {q.bootstrap("SELECT block, x, y FROM rk")} {q.BOOT}""",
)
def x5(spark, sf):
    return _boot(cl.rank_ic_bootstrap(b.staged_panel(spark, sf), "chg", "fwd_5", "release_date"))


@query(
    "X7_feature_screen",
    f"""WITH {q.PANEL}, c AS (SELECT entry_date, release_date, district, z8, chg, fwd_5 FROM panel WHERE z8 IS NOT NULL AND chg IS NOT NULL AND fwd_5 IS NOT NULL),
    s AS (SELECT *, ntile(5) OVER (ORDER BY entry_date, release_date, district) - 1 AS blk FROM c),
    f AS (SELECT blk AS fold, min(entry_date) AS a, max(entry_date) AS z FROM s GROUP BY 1),
    tr AS (SELECT fold, s.* FROM s, f WHERE blk <> fold AND NOT ((entry_date <= z AND entry_date + 2 >= a) OR (entry_date > z AND entry_date <= z + 1))),
    l AS (SELECT fold, fwd_5, 'z8' AS feature, z8 AS x FROM tr UNION ALL SELECT fold, fwd_5, 'chg', chg FROM tr),
    r AS (SELECT fold, feature, rank() OVER (PARTITION BY fold, feature ORDER BY x) + (count(*) OVER (PARTITION BY fold, feature, x) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY fold, feature ORDER BY fwd_5) + (count(*) OVER (PARTITION BY fold, feature, fwd_5) - 1) / 2.0 AS ry FROM l),
    ic AS (SELECT fold, feature, corr(rx, ry) AS ic FROM r GROUP BY 1, 2)
    SELECT feature, count(ic) AS n_folds, round(avg(ic), 5) + 0 AS mean_ic,
      round(greatest(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN ic < 0 THEN 1.0 ELSE 0 END)), 6) AS sign_stability FROM ic GROUP BY 1""",
)
def x7(spark, sf):
    p = b.staged_panel(spark, sf).select("entry_date", "release_date", "district", "z8", "chg", "fwd_5").dropna()
    folds = cv.purged_kfold(p, "entry_date", ["release_date", "district"], 5, 2 * DAY, DAY)
    out = cl.screen_features(folds, ["z8", "chg"], "fwd_5", ["release_date", "district"])
    return out.select("feature", "n_folds", rnd("mean_ic", 5), rnd("sign_stability"))


@query(
    "X7_mutual_information",
    """WITH e AS (SELECT quantile_cont(l_quantity, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS ex, quantile_cont(l_extendedprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS ey FROM lineitem),
    s AS (SELECT greatest(1, least(5, len(list_filter(ex, lambda v: v <= l_quantity)))) AS xb,
      greatest(1, least(5, len(list_filter(ey, lambda v: v <= l_extendedprice)))) AS yb FROM lineitem, e),
    c AS (SELECT xb, yb, count(*) AS n FROM s GROUP BY 1, 2),
    t AS (SELECT n, sum(n) OVER () AS tot, sum(n) OVER (PARTITION BY xb) AS px, sum(n) OVER (PARTITION BY yb) AS py FROM c)
    SELECT round(sum(n / tot * ln(n * tot / (px * py))), 6) AS mutual_information FROM t""",
)
def x7_mi(spark, sf):
    return cl.mutual_information(b.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(rnd("mutual_information"))


@query(
    "X8_residualize",
    f"""WITH {q.PANEL}, m AS (SELECT *, regr_slope(z8, chg) OVER w AS s, regr_intercept(z8, chg) OVER w AS i FROM panel WINDOW w AS (PARTITION BY release_date))
    SELECT CAST(release_date AS VARCHAR) AS release_date, district, round(z8 - (i + s * chg), 4) + 0 AS residual FROM m""",
)
def x8(spark, sf):
    out = cl.residualize_one(b.staged_panel(spark, sf), "z8", "chg", ["release_date"])
    return out.select(text("release_date"), "district", rnd("residual", 4))


@query(
    "X8_residualize_many",
    f"""WITH {q.PANEL}, c AS (SELECT * FROM panel WHERE z8 IS NOT NULL AND chg IS NOT NULL AND fwd_5 IS NOT NULL),
    g AS (SELECT release_date, regr_sxx(fwd_5, z8) AS xx, regr_sxx(fwd_5, chg) AS zz, regr_sxy(chg, z8) AS xz, regr_sxy(fwd_5, z8) AS xy, regr_sxy(fwd_5, chg) AS zy,
      avg(z8) AS mx, avg(chg) AS mz, avg(fwd_5) AS my FROM c GROUP BY 1),
    k AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS bx, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS bz FROM g)
    SELECT CAST(p.release_date AS VARCHAR) AS release_date, district, round(fwd_5 - my - bx * (z8 - mx) - bz * (chg - mz), 6) + 0 AS residual
    FROM panel p LEFT JOIN k ON k.release_date = p.release_date""",
)
def x8_many(spark, sf):
    p = b.staged_panel(spark, sf)
    out = cl.residualize(p, "fwd_5", ["z8", "chg"], ["release_date"])
    return out.select(text("release_date"), "district", rnd("residual"))


@query(
    "X9_shrunk_ic",
    f"""WITH {q.PANEL}, g AS (SELECT district, feature, horizon, count(*) AS n, corr(x, y) AS ic FROM longp WHERE {_PAIRS} GROUP BY 1, 2, 3 HAVING count(*) >= 3),
    m AS (SELECT sum(ic * n) / sum(n) AS g FROM g)
    SELECT district, feature, horizon, round(n / (n + 100.0) * ic + (1 - n / (n + 100.0)) * m.g, 6) + 0 AS shrunk_ic FROM g, m""",
)
def x9(spark, sf):
    ic = ev.information_coefficient(b.long_panel(spark, sf), "x", "y", ["district", "feature", "horizon"], 3, p_value=False)
    return cl.shrink_ics(ic).select("district", "feature", "horizon", rnd("shrunk_ic"))
