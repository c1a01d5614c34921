"""Panel windows, baskets and series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import panel as pn
from tidemark.operators import reports
from tidemark.operators.evaluate import cross_sectional_sd, series_summary
from tidemark.operators.ordered import top_n
from tidemark.plans import bindings as b
from tidemark.plans import sqlparts as q
from tidemark.plans.registry import query, rnd, text

SPARSE = """sparse AS (
  SELECT ticker, date, idx, CASE WHEN volume > 1 THEN close END AS close FROM dense)"""


def _sparse(spark, sf):
    """Dense panel whose single-trade days count as gaps."""
    px = b.bars(spark, sf)
    dense = pn.densify(px, b.calendar(spark, sf))
    return dense.withColumn("close", F.when(F.col("volume") > 1, F.col("close")))


@query(
    "W1_simple_return",
    f"WITH {q.RET} SELECT ticker, CAST(date AS VARCHAR) AS date, round(ret, 6) + 0 AS ret FROM ret",
)
def w1(spark, sf):
    return b.padded_returns(spark, sf).select("ticker", text("date"), rnd("ret"))


@query(
    "W2_forward_change",
    f"""WITH {q.BARS} SELECT ticker, CAST(date AS VARCHAR) AS date,
      round(close / nullif(lag(close, 5) OVER w, 0) - 1, 6) + 0 AS chg_5, round(lead(close, 5) OVER w / nullif(close, 0) - 1, 6) + 0 AS fwd_5
    FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
)
def w2(spark, sf):
    df = pn.change_over(b.bars(spark, sf), "close", 5, "ticker", "date", "chg_5")
    df = pn.forward_change(df, "close", 5, "ticker", "date", "fwd_5")
    return df.select("ticker", text("date"), rnd("chg_5"), rnd("fwd_5"))


@query(
    "W3_difference",
    f"""WITH {q.BARS} SELECT ticker, CAST(date AS VARCHAR) AS date,
      round(close - lag(close, 10) OVER (PARTITION BY ticker ORDER BY date), 6) + 0 AS diff_10 FROM bars""",
)
def w3(spark, sf):
    df = pn.change_over(b.bars(spark, sf), "close", 10, "ticker", "date", "diff_10", relative=False)
    return df.select("ticker", text("date"), rnd("diff_10"))


@query(
    "W4_forward_fill",
    f"""WITH {q.RET}, {SPARSE}
    SELECT ticker, CAST(date AS VARCHAR) AS date,
      last_value(close IGNORE NULLS) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS filled_5,
      last_value(close IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled
    FROM sparse WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
)
def w4(spark, sf):
    df = pn.forward_fill(_sparse(spark, sf), "close", "ticker", "date", 5, "filled_5")
    df = pn.forward_fill(df, "close", "ticker", "date", None, "filled")
    return df.select("ticker", text("date"), "filled_5", "filled")


@query(
    "W5_forward_excess",
    f"""WITH {q.PANEL} SELECT CAST(l.date AS VARCHAR) AS date, l.district, round(l3 - b3, 6) + 0 AS fwd_3, round(l5 - b5, 6) + 0 AS fwd_5,
      round(l10 - b10, 6) + 0 AS fwd_10 FROM legs l LEFT JOIN blegs b ON b.date = l.date""",
)
def w5(spark, sf):
    out = pn.forward_excess(b.baskets(spark, sf), b.benchmark_returns(spark, sf), b.HORIZONS, "district", ret="basket_ret")
    return out.select(text("date"), "district", *[rnd(f"fwd_{h}") for h in b.HORIZONS])


@query(
    "W11_trailing_zscore",
    f"WITH {q.PANEL} SELECT district, CAST(release_date AS VARCHAR) AS release_date, round(z8, 5) + 0 AS z8, round(chg, 6) + 0 AS chg FROM feats",
)
def w11(spark, sf):
    s = pn.trailing_zscore(b.sentiment(spark, sf), "polarity", 8, "district", "release_date", "z8")
    s = pn.change(s, "polarity", "district", "release_date")
    return s.select("district", text("release_date"), rnd("z8", 5), rnd("chg"))


@query(
    "W13_top_holdings",
    """WITH agg AS (
      SELECT l_suppkey AS manager, CAST(date_trunc('month', l_shipdate) AS DATE) AS filing_date, l_partkey AS cusip, sum(l_extendedprice) AS value
      FROM lineitem GROUP BY 1, 2, 3)
    SELECT manager, CAST(filing_date AS VARCHAR) AS filing_date, cusip, round(value, 2) AS value,
      row_number() OVER (PARTITION BY manager, filing_date ORDER BY round(value, 2) DESC, cusip) AS rn
    FROM agg QUALIFY row_number() OVER (PARTITION BY manager, filing_date ORDER BY round(value, 2) DESC, cusip) <= 20""",
)
def w13(spark, sf):
    held = _holdings(spark, sf).withColumn("value", F.round("value", 2))
    out = top_n(held, ["manager", "filing_date"], [F.desc("value"), F.asc("cusip")], 20)
    return out.select("manager", text("filing_date"), "cusip", "value", "rn")


def _holdings(spark, sf):
    li = b.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("manager"), F.trunc(F.to_date("l_shipdate"), "month").alias("filing_date"),
        F.col("l_partkey").alias("cusip"), F.col("l_extendedprice").alias("value"),
    )
    return pn.sum_holdings(li, ["manager", "filing_date", "cusip"], "value")


@query(
    "A10_sum_holdings",
    """SELECT l_suppkey AS manager, CAST(CAST(date_trunc('month', l_shipdate) AS DATE) AS VARCHAR) AS filing_date, l_partkey AS cusip,
      round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1, 2, 3""",
)
def a10(spark, sf):
    return _holdings(spark, sf).select("manager", text("filing_date"), "cusip", rnd("value", 2))


@query(
    "A11_basket_return",
    f"WITH {q.BASKET} SELECT CAST(date AS VARCHAR) AS date, district, round(basket_ret, 6) + 0 AS basket_ret FROM basket",
)
def a11(spark, sf):
    return b.baskets(spark, sf).select(text("date"), "district", rnd("basket_ret"))


_WEIGHTED = f"""{q.RET}, {q.DEPOSITS}, weights AS (
  SELECT CAST(ticker AS VARCHAR) AS ticker, year, hq_deposits / total_deposits AS weight FROM locality
), daily AS (
  SELECT r.ticker, r.date, r.ret, year(o.od) AS y, c_nationkey AS district,
    greatest(1995, least(2001, CASE WHEN month(o.od) >= 10 THEN year(o.od) ELSE year(o.od) - 1 END)) AS vintage
  FROM ret r JOIN customer ON c_custkey = CAST(r.ticker AS BIGINT)
  JOIN (SELECT idx, DATE '1996-01-10' + CAST(idx * 60 AS INTEGER) AS od FROM cal) o ON o.idx = r.idx
), w AS (
  SELECT d.*, weight FROM daily d LEFT JOIN weights k ON k.ticker = d.ticker AND k.year = d.vintage)"""


def _weighted_rows(spark, sf):
    """Daily returns moved onto 60-day steps from 1996 on, so they cross survey vintages, with yearly weights."""
    from tidemark.operators.identity import locality

    r = b.padded_returns(spark, sf)
    r = r.withColumn("od", F.date_add(F.lit("1996-01-10").cast("date"), (F.col("idx") * 60).cast("int")))
    loc = locality(b.deposits(spark, sf), b.headquarters(spark, sf)).select(
        F.col("ticker").cast("string").alias("ticker"), "year", F.col("locality").alias("weight")
    )
    rows = pn.join_vintage(r, loc, "od", 1995, 2001)
    return rows.join(b.district_of(spark, sf), "ticker")


@query(
    "A12_weighted_basket",
    f"""WITH {_WEIGHTED}, kept AS (SELECT *, CASE WHEN ret IS NOT NULL THEN weight END AS k FROM w)
    SELECT CAST(date AS VARCHAR) AS date, district, round(CASE WHEN sum(k) > 0 THEN sum(ret * k) / sum(k) END, 6) + 0 AS basket_ret,
      round(CASE WHEN sum(k) > 0 AND sum(k * k) > 0 THEN sum(k) * sum(k) / sum(k * k) END, 6) AS breadth, count(k) AS n_names
    FROM kept GROUP BY 1, 2""",
)
def a12(spark, sf):
    out = pn.weighted_basket(_weighted_rows(spark, sf), "district", "weight")
    return out.select(text("date"), "district", rnd("basket_ret"), rnd("breadth"), "n_names")


@query(
    "A12_subset_basket",
    f"""WITH {_WEIGHTED}, kept AS (SELECT *, CASE WHEN ret IS NOT NULL AND weight >= 0.05 THEN 1.0::DOUBLE END AS k FROM w)
    SELECT CAST(date AS VARCHAR) AS date, district, round(CASE WHEN sum(k) > 0 THEN sum(ret * k) / sum(k) END, 6) + 0 AS basket_ret,
      count(k) AS n_names FROM kept GROUP BY 1, 2""",
)
def a12_subset(spark, sf):
    out = pn.weighted_basket(_weighted_rows(spark, sf), "district", "weight", "subset", 0.05)
    return out.select(text("date"), "district", rnd("basket_ret"), "n_names")


@query(
    "A13_effective_breadth",
    f"""WITH {_WEIGHTED}, kept AS (SELECT *, CASE WHEN ret IS NOT NULL THEN weight END AS k FROM w),
    per AS (SELECT date, district, CASE WHEN sum(k) > 0 AND sum(k * k) > 0 THEN sum(k) * sum(k) / sum(k * k) END AS breadth FROM kept GROUP BY 1, 2)
    SELECT district, round(avg(breadth), 6) AS eff_n FROM per GROUP BY 1""",
)
def a13(spark, sf):
    out = pn.mean_breadth(pn.weighted_basket(_weighted_rows(spark, sf), "district", "weight"), "district")
    return out.select("district", rnd("eff_n"))


@query(
    "J24_vintage_join",
    f"WITH {_WEIGHTED} SELECT ticker, CAST(date AS VARCHAR) AS date, CAST(vintage AS INTEGER) AS vintage, round(weight, 6) AS weight FROM w",
)
def j24(spark, sf):
    return _weighted_rows(spark, sf).select("ticker", text("date"), "vintage", rnd("weight"))


@query(
    "P12_vintage",
    """SELECT CAST(greatest(1996, least(2000, CASE WHEN month(o_orderdate) >= 10 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END)) AS INTEGER) AS vintage,
      count(*) AS n FROM orders GROUP BY 1""",
)
def p12(spark, sf):
    v = pn.vintage(F.col("o_orderdate"), 1996, 2000)
    return b.table(spark, sf, "orders").groupBy(v.alias("vintage")).agg(F.count("*").alias("n"))


@query(
    "P21_complete_dates",
    """WITH s AS (SELECT CAST(ts AS DATE) AS date, user_id, event_type AS series_id, max(value) AS value FROM events GROUP BY 1, 2, 3),
    ok AS (SELECT date, user_id FROM s WHERE series_id IN ('click', 'view') GROUP BY 1, 2 HAVING count(DISTINCT series_id) = 2)
    SELECT user_id || '|' || CAST(date AS VARCHAR) AS date, series_id, value FROM s JOIN ok USING (date, user_id)""",
)
def p21(spark, sf):
    key = F.concat_ws("|", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("date")
    s = b.table(spark, sf, "events").groupBy(key, F.col("event_type").alias("series_id")).agg(F.max("value").alias("value"))
    return pn.complete_dates(s, ["click", "view"])


@query(
    "P15_sign_normalised",
    """WITH s AS (SELECT CAST(ts AS DATE) AS date, event_type AS series_id, avg(value) AS value FROM events GROUP BY 1, 2)
    SELECT CAST(a.date AS VARCHAR) AS date, a.series_id, round(a.value - u.value, 6) + 0 AS differential,
      round(CASE WHEN a.series_id = 'view' THEN -a.value ELSE a.value END, 6) + 0 AS usd_value
    FROM s a JOIN s u ON u.date = a.date AND u.series_id = 'purchase' WHERE a.series_id <> 'purchase'""",
)
def p15(spark, sf):
    s = b.table(spark, sf, "events").groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("series_id")).agg(
        F.avg("value").alias("value")
    )
    base = s.where(F.col("series_id") == "purchase").select("date", F.col("value").alias("base"))
    return pn.differentials(s.where(F.col("series_id") != "purchase"), base, {"view": -1}).select(
        text("date"), "series_id", rnd("differential"), rnd("usd_value")
    )


@query(
    "O7_wide",
    """SELECT CAST(date AS VARCHAR) AS date, round(max(v) FILTER (e = 'click'), 6) AS click, round(max(v) FILTER (e = 'error'), 6) AS error,
      round(max(v) FILTER (e = 'view'), 6) AS "view" FROM (
      SELECT CAST(ts AS DATE) AS date, event_type AS e, avg(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def o7(spark, sf):
    wide = pn.to_wide(_daily_types(spark, sf), "date", "series_id", "value", ["click", "error", "view"])
    return wide.select(text("date"), rnd("click"), rnd("error"), rnd("view"))


def _daily_types(spark, sf):
    return b.table(spark, sf, "events").groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("series_id")).agg(
        F.avg("value").alias("value")
    )


@query(
    "O7_long",
    """SELECT CAST(date AS VARCHAR) AS date, e AS series_id, round(v, 6) AS value FROM (
      SELECT CAST(ts AS DATE) AS date, event_type AS e, avg(value) AS v FROM events GROUP BY 1, 2) WHERE e IN ('click', 'error', 'view')""",
)
def o7_long(spark, sf):
    names = ["click", "error", "view"]
    wide = pn.to_wide(_daily_types(spark, sf), "date", "series_id", "value", names)
    return pn.to_long(wide, ["date"], names, "series_id", "value").select(text("date"), "series_id", rnd("value"))


@query(
    "A40_cross_sectional_sd",
    f"WITH {q.BARS} SELECT CAST(date AS VARCHAR) AS date, round(stddev_samp(close), 5) AS xs_sd FROM bars GROUP BY 1",
)
def a40(spark, sf):
    return cross_sectional_sd(b.bars(spark, sf), "date", "close").select(text("date"), rnd("xs_sd", 5))


@query(
    "A46_series_summary",
    f"WITH {q.BARS} SELECT ticker, min(close) AS lo, round(avg(close), 6) AS mean, max(close) AS hi FROM bars GROUP BY 1",
)
def a46(spark, sf):
    return series_summary(b.bars(spark, sf), "ticker", "close").withColumn("mean", rnd("mean"))


@query(
    "J25_panel_join",
    f"""WITH {q.PANEL} SELECT CAST(release_date AS VARCHAR) AS release_date, CAST(entry_date AS VARCHAR) AS entry_date, district,
      round(z8, 5) + 0 AS z8, round(chg, 6) + 0 AS chg, round(fwd_5, 6) + 0 AS fwd_5 FROM panel""",
)
def j25(spark, sf):
    return b.study_panel(spark, sf).select(
        text("release_date"), text("entry_date"), "district", rnd("z8", 5), rnd("chg"), rnd("fwd_5")
    )


@query(
    "J28_mapped_with_prices",
    f"WITH {q.BARS} SELECT c_custkey AS ticker, c_nationkey AS district FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (SELECT ticker FROM bars)",
)
def j28(spark, sf):
    kept = pn.mapped_with_prices(b.district_of(spark, sf), b.bars(spark, sf))
    return kept.withColumn("ticker", F.col("ticker").cast("long"))


@query(
    "P13_status_filter",
    f"""WITH {q.BARS} SELECT o_orderkey, o_custkey FROM orders
    WHERE o_orderstatus = 'O' AND CAST(o_custkey AS VARCHAR) IN (SELECT ticker FROM bars)""",
)
def p13(spark, sf):
    o = b.table(spark, sf, "orders").withColumn("ticker", F.col("o_custkey").cast("string"))
    return pn.active_with_prices(o, b.bars(spark, sf), "o_orderstatus", "O").select("o_orderkey", "o_custkey")


@query(
    "O5_without_prices",
    f"WITH {q.BARS} SELECT CAST(c_custkey AS VARCHAR) AS ticker FROM customer EXCEPT SELECT ticker FROM bars",
)
def o5(spark, sf):
    return reports.missing_series(b.district_of(spark, sf), b.bars(spark, sf))


@query(
    "A36_constituent_report",
    f"""WITH {q.BARS}, s AS (SELECT ticker, count(*) AS n, min(date) AS d FROM bars GROUP BY 1)
    SELECT CAST(c_custkey AS VARCHAR) AS ticker, c_nationkey AS district, CASE WHEN n IS NULL THEN 'MISSING' ELSE 'usable' END AS status,
      coalesce(n, 0) AS n_obs, CAST(d AS VARCHAR) AS first_obs, coalesce(n, 0) > 0 AND coalesce(n, 0) < 27 AS is_stub
    FROM customer LEFT JOIN s ON s.ticker = CAST(c_custkey AS VARCHAR)""",
)
def a36(spark, sf):
    out = reports.constituent_report(b.district_of(spark, sf), b.bars(spark, sf), min_rows=27)
    return out.select("ticker", "district", "status", "n_obs", text("first_obs"), "is_stub")


@query(
    "A36_usable_per_group",
    f"""WITH {q.BARS} SELECT c_nationkey AS district, count(*) FILTER (CAST(c_custkey AS VARCHAR) IN (SELECT ticker FROM bars)) AS n_usable,
      count(*) AS n_mapped FROM customer GROUP BY 1""",
)
def a36_groups(spark, sf):
    return reports.usable_per_group(reports.constituent_report(b.district_of(spark, sf), b.bars(spark, sf)), "district")


@query(
    "A36_late_starters",
    f"""WITH {q.BARS} SELECT ticker, CAST(min(date) AS VARCHAR) AS first_obs FROM bars JOIN customer ON CAST(c_custkey AS VARCHAR) = ticker
    GROUP BY 1 HAVING min(date) > DATE '2024-01-01'""",
)
def a36_late(spark, sf):
    rep = reports.constituent_report(b.district_of(spark, sf), b.bars(spark, sf))
    return reports.late_starters(rep, "2024-01-01").select("ticker", text("first_obs"))


@query(
    "A44_coverage",
    f"""WITH {q.PANEL}, per AS (SELECT release_date, count(DISTINCT district) AS n FROM sent GROUP BY 1)
    SELECT min(n) AS min_units, quantile_cont(CAST(n AS DOUBLE), 0.5) AS median_units FROM per""",
)
def a44(spark, sf):
    return reports.coverage_per_release(b.sentiment(spark, sf), "release_date", "district")


@query(
    "O1_ordered",
    f"WITH {q.BARS} SELECT ticker, CAST(date AS VARCHAR) AS date, close FROM bars ORDER BY 1, 2",
)
def o1(spark, sf):
    return pn.ordered_output(b.bars(spark, sf), ["ticker", "date"]).select("ticker", text("date"), "close")


@query(
    "S11_long_prices",
    f"""WITH {q.BARS}, kept AS (SELECT ticker FROM bars GROUP BY 1 HAVING count(*) >= 27)
    SELECT ticker, CAST(date AS VARCHAR) AS date, close FROM bars WHERE ticker IN (SELECT ticker FROM kept)""",
)
def s11(spark, sf):
    return pn.drop_short_series(b.bars(spark, sf), "ticker", 27).select("ticker", text("date"), "close")


@query(
    "S10_daily_bars",
    f"WITH {q.BARS} SELECT ticker, CAST(date AS VARCHAR) AS date, close, volume FROM bars",
)
def s10(spark, sf):
    return b.bars(spark, sf).select("ticker", text("date"), "close", "volume")
