"""Shared CTEs of the DuckDB counterparts, mirroring ``bindings``."""

BARS = """bars AS (
  SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date, arg_max(value, (ts, event_id)) + 100 AS close,
         count(*) AS volume
  FROM events GROUP BY 1, 2)"""

CAL = f"""{BARS}, cal AS (
  SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM bars))"""

RET = f"""{CAL}, dense AS (
  SELECT f.ticker, c.date, c.idx, b.close, b.volume
  FROM (SELECT ticker, min(idx) AS lo FROM bars JOIN cal USING (date) GROUP BY 1) f
  JOIN cal c ON c.idx >= f.lo LEFT JOIN bars b ON b.ticker = f.ticker AND b.date = c.date
), padded AS (
  SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px FROM dense
), ret AS (
  SELECT *, px / nullif(lag(px) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM padded)"""

BASKET = f"""{RET}, basket AS (
  SELECT date, c_nationkey AS district, avg(ret) AS basket_ret
  FROM ret JOIN customer ON c_custkey = CAST(ticker AS BIGINT) GROUP BY 1, 2
), bench AS (SELECT date, avg(ret) AS bench_ret FROM ret GROUP BY 1)"""


def _leg(h: int, part: str, col: str, out: str) -> str:
    over = f"OVER ({part} ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"CASE WHEN count(*) {over} = {h} THEN product(1 + coalesce({col}, 0)) {over} - 1 END AS {out}"


PANEL = f"""{BASKET}, sent AS (
  SELECT c_nationkey AS district, CAST(ts AS DATE) AS release_date, avg(value) AS polarity
  FROM events JOIN customer ON c_custkey = user_id GROUP BY 1, 2
), feats AS (
  SELECT *, CASE WHEN count(polarity) OVER p8 = 8
              THEN (polarity - avg(polarity) OVER p8) / nullif(stddev_samp(polarity) OVER p8, 0) END AS z8,
         polarity - lag(polarity) OVER (PARTITION BY district ORDER BY release_date) AS chg
  FROM sent WINDOW p8 AS (PARTITION BY district ORDER BY release_date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)
), entered AS (
  SELECT f.*, (SELECT min(c.date) FROM cal c WHERE c.date > f.release_date) AS entry_date FROM feats f
), legs AS (
  SELECT date, district, {_leg(3, "PARTITION BY district", "basket_ret", "l3")},
         {_leg(5, "PARTITION BY district", "basket_ret", "l5")}, {_leg(10, "PARTITION BY district", "basket_ret", "l10")}
  FROM basket
), blegs AS (
  SELECT date, {_leg(3, "", "bench_ret", "b3")}, {_leg(5, "", "bench_ret", "b5")}, {_leg(10, "", "bench_ret", "b10")}
  FROM bench
), panel AS (
  SELECT e.*, l3 - b3 AS fwd_3, l5 - b5 AS fwd_5, l10 - b10 AS fwd_10
  FROM entered e LEFT JOIN legs l ON l.date = e.entry_date AND l.district = e.district
  LEFT JOIN blegs b ON b.date = e.entry_date
  WHERE e.entry_date IS NOT NULL
), longp AS (
  SELECT release_date, entry_date, district, feature, x, horizon, y FROM (
    SELECT release_date, entry_date, district, f.feature, CASE f.feature WHEN 'z8' THEN z8 ELSE chg END AS x, h.horizon,
           CASE h.horizon WHEN 3 THEN fwd_3 WHEN 5 THEN fwd_5 ELSE fwd_10 END AS y
    FROM panel, (VALUES ('z8'), ('chg')) f(feature), (VALUES (3), (5), (10)) h(horizon)))"""

QEND = "CAST(date_trunc('quarter', {0}) AS DATE) - 1"


def _coded(day: str) -> str:
    return f"CAST(strftime({day}, '%Y%m%d') AS INTEGER)"


SUB = f"""sub AS (
  SELECT o_orderkey AS adsh, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik,
         CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '10-Q' WHEN '3-MEDIUM' THEN '10-Q/A'
              WHEN '4-NOT SPECIFIED' THEN '8-K' ELSE '10-K/A' END AS form,
         {_coded(QEND.format('o_orderdate'))} AS period, {_coded('o_orderdate')} AS filed,
         {QEND.format('o_orderdate')} AS period_day, CAST(o_orderdate AS DATE) AS filed_day
  FROM orders)"""


def facts(name: str, a: str, n: str, other: str, low: int, high: int) -> str:
    return f"""{name} AS (
  SELECT l_orderkey AS adsh, CASE l_returnflag WHEN 'A' THEN '{a}' WHEN 'N' THEN '{n}' ELSE '{other}' END AS tag,
         CASE WHEN l_linestatus = 'O' THEN 'us-gaap/2022' ELSE 'ACME/2022' END AS version,
         {_coded(QEND.format('l_shipdate'))} AS ddate, {QEND.format('l_shipdate')} AS ddate_day,
         CASE WHEN l_linenumber <= 5 THEN {low} ELSE {high} END AS qtrs, l_quantity AS value, l_suppkey AS coreg
  FROM lineitem)"""


NUM = facts("num", "EarningsPerShareDiluted", "EarningsPerShareBasicAndDiluted", "EarningsPerShareBasic", 1, 4)
SHARES = facts("num", "CommonStockSharesOutstanding", "EntityCommonStockSharesOutstanding", "SharesIssued", 0, 1)


def eps(tags: list[str], name: str = "eps") -> str:
    listed = ", ".join(f"'{t}'" for t in tags)
    rank = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(tags))
    return f"""{name} AS (
  SELECT cik, ddate_day AS period_end, value AS eps_value, tag AS tag_used, form, filed_day AS filed, adsh
  FROM num JOIN sub USING (adsh) WHERE qtrs = 1 AND tag IN ({listed})
  QUALIFY row_number() OVER (PARTITION BY cik, ddate ORDER BY CASE tag {rank} END, filed, adsh, value) = 1)"""


EPS = f"{SUB}, {NUM}, {eps(['EarningsPerShareDiluted', 'EarningsPerShareBasicAndDiluted'])}"


def sue(source: str, name: str = "sue") -> str:
    return f"""{name}_d AS (
  SELECT *, row_number() OVER w AS n_quarters, eps_value - lag(eps_value, 4) OVER w AS seasonal_diff
  FROM {source} WINDOW w AS (PARTITION BY cik ORDER BY period_end)
), {name}_w AS (
  SELECT *, count(seasonal_diff) OVER w8 AS n_diffs, stddev_samp(seasonal_diff) OVER w8 AS diff_sd
  FROM {name}_d WINDOW w8 AS (PARTITION BY cik ORDER BY period_end ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)
), {name} AS (
  SELECT *, CASE WHEN n_quarters <= 4 THEN 'insufficient_history_for_any_seasonal_diff'
                 WHEN n_diffs < 4 THEN 'insufficient_seasonal_diffs'
                 WHEN diff_sd IS NULL OR diff_sd = 0 THEN 'zero_or_undefined_volatility' END AS sue_reason,
         CASE WHEN n_quarters > 4 AND n_diffs >= 4 AND diff_sd > 0 THEN seasonal_diff / diff_sd END AS sue
  FROM {name}_w)"""


SHARES_OUT = f"""{SUB}, {SHARES}, facts AS (
  SELECT DISTINCT adsh, tag, ddate, ddate_day, coreg, value FROM num
  WHERE qtrs = 0 AND tag IN ('CommonStockSharesOutstanding', 'EntityCommonStockSharesOutstanding')
), best AS (
  SELECT adsh, ddate, min(tag) AS tag FROM facts GROUP BY 1, 2
), summed AS (
  SELECT cik, f.ddate, f.ddate_day, f.adsh, f.tag, form, filed, filed_day, f.ddate = period AS own,
         sum(f.value) AS shares_outstanding
  FROM facts f JOIN best b ON b.adsh = f.adsh AND b.ddate = f.ddate AND b.tag = f.tag JOIN sub s ON s.adsh = f.adsh
  GROUP BY ALL
), shares AS (
  SELECT cik, ddate_day AS period_end, shares_outstanding, tag AS tag_used, form, filed_day AS filed, adsh, own AS is_own_period
  FROM summed QUALIFY row_number() OVER (PARTITION BY cik, ddate ORDER BY own DESC, filed, adsh) = 1)"""

ITEM202 = """item202 AS (
  SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, o_orderkey AS accession_number,
         o_orderdate + to_hours(o_orderkey % 24) AS acceptance_datetime
  FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED')"""

KNOWN = f"""{SUB}, {ITEM202}, firsts AS (
  SELECT cik, period, period_day, form, filed, filed_day, adsh,
         count(*) OVER (PARTITION BY cik, period) AS n_periodic
  FROM sub WHERE form IN ('10-K', '10-Q', '10-KT', '10-QT')
  QUALIFY row_number() OVER (PARTITION BY cik, period ORDER BY filed, adsh) = 1
), said AS (
  SELECT f.cik, f.period, max(i.acceptance_datetime) AS announced_at
  FROM firsts f JOIN item202 i ON i.cik = f.cik AND i.acceptance_datetime <= CAST(f.filed_day AS TIMESTAMP)
       AND i.acceptance_datetime >= CAST(f.filed_day AS TIMESTAMP) - INTERVAL 5 DAY
  GROUP BY 1, 2
), known AS (
  SELECT f.cik, f.period_day AS period_end, coalesce(s.announced_at, CAST(f.filed_day AS TIMESTAMP)) AS known_at,
         CASE WHEN s.announced_at IS NOT NULL THEN '8k_item202' ELSE '10q_fallback' END AS event_source,
         f.form, f.adsh, f.n_periodic
  FROM firsts f LEFT JOIN said s USING (cik, period))"""

ORDERS_SIZED = """sized AS (
  SELECT o.*, c_mktsegment AS sic_code, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_totalprice AS market_cap,
         (o_totalprice % 97.0) / 970 - 0.05 AS forward_return
  FROM orders o JOIN customer ON c_custkey = o_custkey
), edges AS (
  SELECT date, quantile_cont(CAST(market_cap AS DOUBLE), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS edges FROM sized GROUP BY 1
), bucketed AS (
  SELECT s.*, greatest(1, least(5, len(list_filter(edges, lambda e: e <= market_cap)))) AS size_bucket
  FROM sized s JOIN edges USING (date)
), pool AS (
  SELECT date, sic_code, size_bucket, avg(forward_return) AS control_return, count(*) AS control_n
  FROM bucketed WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2, 3
), controlled AS (
  SELECT b.o_orderkey AS event_id, b.date, b.sic_code, b.size_bucket, b.market_cap, b.market_cap * 30 AS adv_20d,
         control_return, coalesce(control_n, 0) AS control_n, coalesce(control_n, 0) < 5 AS thin_control
  FROM bucketed b LEFT JOIN pool USING (date, sic_code, size_bucket)
  WHERE b.o_orderpriority IN ('1-URGENT', '2-HIGH'))"""

DEPOSITS = """deposits AS (
  SELECT l_suppkey AS ticker, year(l_shipdate) AS year, c_nationkey AS state, l_extendedprice AS deposits, l_partkey AS cert
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
), bystate AS (
  SELECT ticker, year, state, sum(deposits) AS d, count(*) AS b FROM deposits GROUP BY ALL
), locality AS (
  SELECT s.ticker, s.year, s_nationkey AS hq_state, sum(d) AS total_deposits,
         sum(CASE WHEN state = s_nationkey THEN d ELSE 0 END) AS hq_deposits,
         count(*) FILTER (d > 0) AS n_states, CAST(sum(b) AS BIGINT) AS n_branches, arg_max(state, d) AS top_state, max(d) AS top_d,
         any_value(n_certs) AS n_certs
  FROM bystate s JOIN supplier ON s_suppkey = s.ticker
  JOIN (SELECT ticker, year, count(DISTINCT cert) AS n_certs FROM deposits GROUP BY ALL) c ON c.ticker = s.ticker AND c.year = s.year
  GROUP BY s.ticker, s.year, s_nationkey)"""


STEPS = 4_000  # intervals of a numerical integral, even
_SIMPSON = f"CASE WHEN k = 0 OR k = {STEPS} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"


def _integral(f: str, lo: str, hi: str) -> str:
    """Simpson's rule for an expression of u."""
    at = f.replace("[u]", f"({lo} + k * ({hi} - {lo}) / {STEPS})")
    return f"((SELECT sum({_SIMPSON} * {at}) FROM range({STEPS} + 1) tt(k)) * ({hi} - {lo}) / {STEPS} / 3)"


def t_tail(t: str, dof: str) -> str:
    """Two-sided Student-t tail: the share of the integral of cos^(dof - 1) beyond atan(t / sqrt(dof))."""
    density = f"exp(({dof} - 1) * ln(greatest(cos([u]), 1e-300)))"
    return f"({_integral(density, f'atan(abs({t}) / sqrt({dof}))', '(pi() / 2)')} / {_integral(density, '0', '(pi() / 2)')})"


def normal_cdf(z: str) -> str:
    """Standard normal distribution function, integrated from 0 to z; beyond 9 it is 0 or 1."""
    return f"(0.5 + {_integral('exp(-0.5 * power([u], 2))', '0', f'greatest(-9.0, least(9.0, {z}))')} / sqrt(2 * pi()))"


def bootstrap(pairs: str, draws: int = 10_000, seed: int = 20260731) -> str:
    """CTEs from ``pairs`` (block, x, y) to the one-row table ``boot`` of the block bootstrap."""
    ic = "(sum(n) * sum(sxy) - sum(sx) * sum(sy)) / sqrt(sum(n) * sum(sxx) - sum(sx) * sum(sx)) / sqrt(sum(n) * sum(syy) - sum(sy) * sum(sy))"
    return f"""bsum AS (SELECT row_number() OVER (ORDER BY block) - 1 AS slot, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy,
      sum(x * y) AS sxy FROM ({pairs}) GROUP BY block),
    kk AS (SELECT count(*) AS k FROM bsum),
    drawn AS (SELECT id // k AS b, CAST('0x' || left(md5('{seed}:' || id), 8) AS BIGINT) % k AS slot FROM (SELECT unnest(range({draws} * k)) AS id, k FROM kk)),
    dd AS (SELECT b, {ic} AS draw FROM drawn JOIN bsum USING (slot) GROUP BY 1),
    obs AS (SELECT {ic} AS ic, sum(n) AS n_obs, count(*) AS n_blocks FROM bsum),
    mid AS (SELECT avg(draw) AS mean FROM dd),
    boot AS (SELECT any_value(ic) AS ic, CAST(any_value(n_obs) AS BIGINT) AS n_obs, any_value(n_blocks) AS n_blocks, quantile_cont(draw, 0.025) AS ci_low,
      quantile_cont(draw, 0.975) AS ci_high, stddev_pop(draw) AS se, avg(CASE WHEN abs(draw - mean) >= abs(ic) THEN 1.0 ELSE 0.0 END) AS p FROM dd, mid, obs)"""


BOOT = """SELECT round(ic, 6) + 0 AS ic, n_obs, n_blocks, round(ci_low, 6) + 0 AS ci_low, round(ci_high, 6) + 0 AS ci_high, round(se, 6) AS se,
      round(p, 4) AS p, round(sqrt((1 - ic * ic) / (n_obs - 2)), 6) AS naive_se, round(se / sqrt((1 - ic * ic) / (n_obs - 2)), 5) AS se_inflation FROM boot"""
