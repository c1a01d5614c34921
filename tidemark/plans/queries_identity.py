"""Ticker histories, name matching, deposits and districts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import identity as idn
from tidemark.plans import bindings as b
from tidemark.plans import sqlparts as q
from tidemark.plans.registry import query, rnd, text

_HISTORY = """hist AS (
  SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS cik, CAST(o_custkey AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS valid_from,
    CAST(o_orderdate AS DATE) + CASE WHEN o_orderpriority <> '5-LOW' THEN 90 ELSE 400 END AS valid_to, 'Order ' || o_orderkey AS company_name FROM orders
), probes AS (
  SELECT DISTINCT o_custkey AS k, CAST(o_custkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS as_of
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
), cprobes AS (
  SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS cik, CAST(l_shipdate AS DATE) AS as_of, count(*) AS n FROM lineitem GROUP BY 1, 2)"""


def _probes(spark, sf):
    li = b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("as_of"))
    o = b.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("ticker"))
    return li.join(o, "o_orderkey").select("ticker", "as_of").distinct()


def _cik_probes(spark, sf):
    li = b.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").cast("string").alias("cik"), F.to_date("l_shipdate").alias("as_of")).agg(F.count("*").alias("n"))


@query(
    "J9_resolve_cik",
    f"""WITH {_HISTORY}, m AS (SELECT p.ticker, p.as_of, count(h.cik) AS n_matches, min(h.cik) AS c FROM probes p
      LEFT JOIN hist h ON h.ticker = p.ticker AND h.valid_from <= p.as_of AND p.as_of <= h.valid_to GROUP BY 1, 2)
    SELECT ticker, CAST(as_of AS VARCHAR) AS as_of, n_matches, CASE n_matches WHEN 0 THEN 'none' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status,
      CASE WHEN n_matches = 1 THEN c END AS cik FROM m""",
)
def j9(spark, sf):
    out = idn.resolve_cik(_probes(spark, sf), b.ticker_history(spark, sf))
    return out.select("ticker", text("as_of"), "n_matches", "status", "cik")


@query(
    "J10_resolve_ticker",
    f"""WITH {_HISTORY} SELECT p.cik, CAST(p.as_of AS VARCHAR) AS as_of, p.n, h.ticker, CASE WHEN h.ticker IS NULL THEN 'none' ELSE 'ok' END AS status
    FROM cprobes p LEFT JOIN hist h ON h.cik = p.cik AND h.valid_from <= p.as_of AND p.as_of <= h.valid_to""",
)
def j10(spark, sf):
    out = idn.resolve_for_cik(_cik_probes(spark, sf), b.ticker_history(spark, sf), "ticker")
    return out.select("cik", text("as_of"), "n", "ticker", "status")


@query(
    "J11_company_name",
    f"""WITH {_HISTORY} SELECT p.cik, CAST(p.as_of AS VARCHAR) AS as_of, p.n, h.company_name, CASE WHEN h.ticker IS NULL THEN 'none' ELSE 'ok' END AS status
    FROM cprobes p LEFT JOIN hist h ON h.cik = p.cik AND h.valid_from <= p.as_of AND p.as_of <= h.valid_to""",
)
def j11(spark, sf):
    out = idn.resolve_for_cik(_cik_probes(spark, sf), b.ticker_history(spark, sf), "company_name")
    return out.select("cik", text("as_of"), "n", "company_name", "status")


@query(
    "J12_find_conflicts",
    f"""WITH {_HISTORY} SELECT a.ticker, a.cik AS cik_a, c.cik AS cik_b, CAST(greatest(a.valid_from, c.valid_from) AS VARCHAR) AS overlap_start,
      CAST(least(a.valid_to, c.valid_to) AS VARCHAR) AS overlap_end
    FROM hist a JOIN hist c ON a.ticker = c.ticker AND a.cik <> c.cik AND (a.valid_from < c.valid_from OR (a.valid_from = c.valid_from AND a.cik < c.cik))
      AND greatest(a.valid_from, c.valid_from) <= least(a.valid_to, c.valid_to)""",
)
def j12(spark, sf):
    out = idn.find_conflicts(b.ticker_history(spark, sf))
    return out.select("ticker", "cik_a", "cik_b", text("overlap_start"), text("overlap_end"))


@query(
    "J22_map_tickers",
    """SELECT l_partkey AS cusip, count(*) AS n, p_brand AS ticker FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) ON p_partkey = l_partkey GROUP BY 1, 3""",
)
def j22(spark, sf):
    held = b.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("cusip")).agg(F.count("*").alias("n"))
    mapping = b.table(spark, sf, "part").where(F.col("p_size") <= 40).select(
        F.col("p_partkey").alias("cusip"), F.col("p_brand").alias("ticker")
    )
    return idn.map_tickers(held, mapping)


@query(
    "P14_renames",
    """SELECT CASE c_mktsegment WHEN 'MACHINERY' THEN 'HOUSEHOLD' ELSE c_mktsegment END AS ticker, c_nationkey, count(*) AS n
    FROM customer WHERE c_mktsegment <> 'FURNITURE' GROUP BY 1, 2""",
)
def p14(spark, sf):
    rows = b.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("ticker"), "c_nationkey")
    out = idn.apply_renames(rows, {"MACHINERY": "HOUSEHOLD"}, ["FURNITURE"])
    return out.groupBy("ticker", "c_nationkey").agg(F.count("*").alias("n"))


@query(
    "J26_compare_assignment",
    """WITH o AS (SELECT o_custkey AS k, min(s_nationkey) AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
    SELECT c_custkey AS ticker, c_nationkey AS hand_district, o.d AS official_district, CASE WHEN o.d IS NOT NULL THEN c_nationkey <> o.d END AS changed
    FROM customer LEFT JOIN o ON o.k = c_custkey""",
)
def j26(spark, sf):
    return _assignment(spark, sf).withColumn("ticker", F.col("ticker").cast("long"))


def _assignment(spark, sf):
    o = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("ticker"))
    s = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("district"))
    li = b.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    official = li.join(o, "l_orderkey").join(s, "l_suppkey").groupBy("ticker").agg(F.min("district").alias("district"))
    return idn.compare_assignment(b.district_of(spark, sf), official, "ticker", "district")


@query(
    "J26_emptied_groups",
    """WITH o AS (SELECT o_custkey AS k, min(s_nationkey) AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
    SELECT DISTINCT c_nationkey AS district FROM customer WHERE c_nationkey NOT IN (SELECT d FROM o JOIN customer ON c_custkey = k WHERE d IS NOT NULL)""",
)
def j26_empty(spark, sf):
    return idn.emptied_groups(_assignment(spark, sf), "district")


@query(
    "A14_locality",
    f"""WITH {q.DEPOSITS} SELECT ticker, CAST(year AS INTEGER) AS year, hq_state, round(total_deposits, 2) AS total_deposits, round(hq_deposits, 2) AS hq_deposits,
      n_states, n_branches, n_certs, top_state, round(hq_deposits / total_deposits, 8) AS locality, round(top_d / total_deposits, 8) AS top_state_share FROM locality""",
)
def a14(spark, sf):
    out = idn.locality(b.deposits(spark, sf), b.headquarters(spark, sf))
    return out.select(
        "ticker", "year", "hq_state", rnd("total_deposits", 2), rnd("hq_deposits", 2), "n_states", "n_branches", "n_certs",
        "top_state", rnd("locality", 8), rnd("top_state_share", 8),
    )


@query(
    "A17_locality_summary",
    f"""WITH {q.DEPOSITS}, l AS (SELECT *, hq_deposits / total_deposits AS loc FROM locality)
    SELECT ticker, any_value(hq_state) AS hq, round(avg(loc), 8) AS loc_mean, round(arg_min(loc, year), 8) AS loc_first, round(arg_max(loc, year), 8) AS loc_last,
      arg_max(n_states, year) AS states_last, max(n_certs) AS max_certs, arg_min(top_state, year) AS top_first, arg_max(top_state, year) AS top_last,
      count(*) AS vintages, count(*) FILTER (loc < 0 OR loc > 1) AS n_outside, count(*) FILTER (hq_deposits <= 0) AS n_zero_hq, count(*) < 8 AS incomplete FROM l GROUP BY 1""",
)
def a17(spark, sf):
    out = idn.locality_summary(idn.locality(b.deposits(spark, sf), b.headquarters(spark, sf)), 8)
    return out.withColumn("loc_mean", rnd("loc_mean", 8)).withColumn("loc_first", rnd("loc_first", 8)).withColumn("loc_last", rnd("loc_last", 8))


_HC = """own AS (
  SELECT c_custkey AS ticker, year(o_orderdate) AS year, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS hc
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'
), counted AS (SELECT ticker, year, hc, count(*) AS c FROM own GROUP BY 1, 2, 3
), mode AS (SELECT ticker, year, hc FROM counted QUALIFY row_number() OVER (PARTITION BY ticker, year ORDER BY hc = '', c DESC, hc) = 1
), spine AS (SELECT c_custkey AS ticker, y AS year, m.hc, CASE WHEN m.hc <> '' THEN m.hc END AS known, c_mktsegment AS seed
  FROM customer CROSS JOIN range(1995, 2002) t(y) LEFT JOIN mode m ON m.ticker = c_custkey AND m.year = y
), hcy AS (SELECT ticker, CAST(year AS INTEGER) AS year, coalesce(hc, last_value(known IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  first_value(known IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY year ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), seed, '') AS hc FROM spine)"""


def _hc_by_year(spark, sf):
    o = b.table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    own = o.select(
        F.col("o_custkey").alias("ticker"), F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("hc"),
    )
    seeds = b.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ticker"), F.col("c_custkey").alias("cert"), F.col("c_mktsegment").alias("seed")
    )
    return idn.holding_company_by_year(own, seeds, 1995, 2001)


@query("A15_holding_company", f"WITH {_HC} SELECT ticker, ticker AS cert, year, hc FROM hcy")
def a15(spark, sf):
    return _hc_by_year(spark, sf)


_FOOT = f"""{_HC}, branch AS (
  SELECT o_custkey AS cert, o_orderpriority || CAST(o_custkey // 3 AS VARCHAR) AS hc, year(o_orderdate) AS year, o_orderstatus AS state, o_totalprice AS deposits FROM orders
), banks AS (SELECT ticker, year, CASE WHEN hc = '' THEN '' ELSE hc || CAST(ticker // 3 AS VARCHAR) END AS hc FROM hcy),
via AS (SELECT k.ticker, k.year, r.state, r.deposits, r.cert AS branch_cert, r.hc FROM banks k JOIN branch r ON r.year = k.year AND r.hc = k.hc WHERE k.hc <> ''),
alone AS (SELECT k.ticker, k.year FROM banks k WHERE NOT EXISTS (SELECT 1 FROM via v WHERE v.ticker = k.ticker AND v.year = k.year)),
foot AS (SELECT DISTINCT * FROM (SELECT * FROM via UNION ALL SELECT a.ticker, a.year, r.state, r.deposits, r.cert, r.hc FROM alone a JOIN branch r ON r.year = a.year AND r.cert = a.ticker))"""


@query("A16_footprint", f"WITH {_FOOT} SELECT ticker, CAST(year AS INTEGER) AS year, state, deposits, branch_cert, hc FROM foot")
def a16(spark, sf):
    group = F.floor(F.col("cert") / 3).cast("string")
    hc = _hc_by_year(spark, sf).withColumn("hc", F.when(F.col("hc") == "", "").otherwise(F.concat("hc", group)))
    o = b.table(spark, sf, "orders").withColumn("cert", F.col("o_custkey"))
    branch = o.select(
        "cert", F.concat("o_orderpriority", group).alias("hc"), F.year("o_orderdate").alias("year"),
        F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("deposits"),
    )
    return idn.footprint(branch, hc)


@query(
    "W19_latest_vintage",
    """SELECT o_custkey AS cert, year(o_orderdate) AS year, o_orderpriority AS fed, o_orderkey AS ref FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, o_orderpriority DESC, o_orderkey DESC) = 1""",
)
def w19(spark, sf):
    o = b.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("cert"), F.year("o_orderdate").cast("long").alias("year"),
        F.col("o_orderpriority").alias("fed"), F.col("o_orderkey").alias("ref"),
    )
    return idn.latest_vintage(o, "cert", "year", ["fed", "ref"])


@query(
    "O8_source_waterfall",
    f"""WITH {q.BARS}, want AS (SELECT CAST(c_custkey AS VARCHAR) AS ticker, CAST(c_custkey // 2 AS VARCHAR) AS successor FROM customer),
    orig AS (SELECT CAST(o_custkey AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderstatus = 'P'),
    r1 AS (SELECT w.ticker, 'recovered' AS status, o.date, w.successor FROM want w JOIN orig o USING (ticker)),
    r2 AS (SELECT w.ticker, 'successor_only' AS status, s.date, w.successor FROM want w JOIN bars s ON s.ticker = w.successor WHERE w.ticker NOT IN (SELECT ticker FROM orig)),
    sp AS (SELECT ticker, status, count(*) AS n, min(date) AS f, max(date) AS l FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY 1, 2)
    SELECT w.ticker, coalesce(status, 'not_recovered') AS status, coalesce(n, 0) AS n_rows, CAST(f AS VARCHAR) AS "first", CAST(l AS VARCHAR) AS "last",
      CASE WHEN status = 'successor_only' THEN successor END AS successor FROM want w LEFT JOIN sp USING (ticker)""",
)
def o8(spark, sf):
    want = b.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("ticker"), F.floor(F.col("c_custkey") / 2).cast("string").alias("successor")
    )
    orig = b.table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(
        F.col("o_custkey").cast("string").alias("ticker"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("close")
    )
    _, report = idn.source_waterfall(want, orig, b.bars(spark, sf).select("ticker", "date", "close"))
    return report.withColumn("first", text("first")).withColumn("last", text("last"))


@query(
    "F1_normal_name",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '\\s+', ' ', 'g')) AS name
    FROM lineitem l JOIN part ON p_partkey = l_partkey""",
)
def f1(spark, sf):
    p = b.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_name", F.lit("  The "), "p_type", F.lit(", N.A.")).alias("raw"))
    li = b.table(spark, sf, "lineitem").join(p, "l_partkey")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", idn.normal_name(F.col("raw")).alias("name"))


def _grams_sql(name: str) -> str:
    padded = f"('  ' || {name} || ' ')"
    return f"list_distinct(list_transform(generate_series(1, length({name}) + 1), lambda i: substr({padded}, i, 3)))"


@query(
    "J27_match_names",
    f"""WITH w AS (SELECT DISTINCT p_name || ' ' || p_brand AS name, p_brand AS state FROM part),
    k AS (SELECT DISTINCT lower(p_type) || ' ' || p_name AS name, 'Brand#' || (p_size % 25 + 1) AS state FROM part),
    wg AS (SELECT *, {_grams_sql('lower(name)')} AS g FROM w), kg AS (SELECT *, {_grams_sql('lower(name)')} AS g, name || '|' || state AS id FROM k),
    s AS (SELECT wg.name, wg.state, kg.id, kg.name AS kn, kg.state AS ks, wg.state = kg.state AS same, 2.0::DOUBLE * len(list_intersect(wg.g, kg.g)) / (len(wg.g) + len(kg.g)) AS d FROM wg, kg),
    r AS (SELECT *, round(d, 3) AS sim, row_number() OVER (PARTITION BY name, state ORDER BY same DESC, round(d, 3) DESC, id) AS rn FROM s WHERE d >= 0.55)
    SELECT w.name || '|' || w.state AS key, r.id AS cert, r.sim AS similarity, CASE WHEN r.id IS NULL THEN 'not_found' WHEN r.same THEN 'ok' ELSE 'state_mismatch' END AS status
    FROM w LEFT JOIN r ON r.name = w.name AND r.state = w.state AND r.rn = 1""",
)
def j27(spark, sf):
    p = b.table(spark, sf, "part")
    wanted = p.select(F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.col("p_brand").alias("state")).distinct()
    wanted = wanted.withColumn("key", F.concat_ws("|", "name", "state"))
    known = p.select(
        F.concat_ws(" ", F.lower("p_type"), "p_name").alias("name"),
        F.concat(F.lit("Brand#"), F.pmod("p_size", F.lit(25)) + 1).alias("state"),
    ).distinct()
    known = known.withColumn("cert", F.concat_ws("|", "name", "state"))
    return idn.match_names(wanted, known).select("key", "cert", "similarity", "status")
