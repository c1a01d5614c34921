"""Universe, matched controls, costs and event-study queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import ControlConfig, CostSchedule, UniverseConfig
from tidemark.operators import clusters as cl
from tidemark.operators import eventstudy as es
from tidemark.operators import panel as pn
from tidemark.operators import reports
from tidemark.plans import bindings as b
from tidemark.plans import sqlparts as q
from tidemark.plans.registry import query, rnd, text

UNIVERSE = UniverseConfig(1000.0, 8000.0, min_adv=2_000_000.0, min_quarters=2)

_QUALIFY = """CASE WHEN c_mktsegment = 'BUILDING' THEN 'listing_not_allowed'
  WHEN c_acctbal > 0 AND c_acctbal < 1000 THEN 'market_cap_below_min'
  WHEN c_acctbal <= 0 OR c_acctbal IS NULL OR c_acctbal > 8000 THEN 'market_cap_above_max'
  WHEN abs(c_acctbal) * 1000 < 2000000 THEN 'adv_below_floor'
  WHEN c_nationkey % 13 < 2 THEN 'insufficient_history' END"""


@query(
    "P3_qualify",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS entity_id, {_QUALIFY} AS disqualification_reason, {_QUALIFY} IS NULL AS qualifies FROM customer""",
)
def p3(spark, sf):
    out = es.build_universe(b.universe_rows(spark, sf), UNIVERSE)
    return out.select("entity_id", "disqualification_reason", "qualifies")


@query(
    "A18_attrition",
    f"""SELECT coalesce({_QUALIFY}, 'qualifies') AS reason, count(*) AS n_rows,
      round(count(*) * 100.0 / sum(count(*)) OVER (), 2)::DOUBLE AS pct FROM customer GROUP BY 1""",
)
def a18(spark, sf):
    out = es.attrition(es.build_universe(b.universe_rows(spark, sf), UNIVERSE), "disqualification_reason")
    return out.withColumn("pct", F.col("pct").cast("double"))


@query(
    "A19_universe_counts",
    f"SELECT c_mktsegment AS sic_code, coalesce({_QUALIFY}, 'qualifies') AS reason, count(*) AS n_rows FROM customer GROUP BY 1, 2",
)
def a19(spark, sf):
    u = es.build_universe(b.universe_rows(spark, sf), UNIVERSE)
    return u.groupBy("sic_code", F.coalesce("disqualification_reason", F.lit("qualifies")).alias("reason")).agg(
        F.count("*").alias("n_rows")
    )


_BAND = """CASE WHEN {0} >= 0 AND {0} < 500000 THEN {1} WHEN {0} >= 500000 AND {0} < 2000000 THEN {2}
  WHEN {0} >= 2000000 AND {0} < 10000000 THEN {3} WHEN {0} >= 10000000 THEN {4} END"""
_LABEL = _BAND.format("adv", "'< $500K'", "'$500K-$2M'", "'$2M-$10M'", "'> $10M'")
_BPS = _BAND.format("adv", "150.0", "80.0", "40.0", "20.0")


@query(
    "J13_cost_band",
    f"SELECT c_custkey, {_LABEL} AS adv_bucket, CAST({_BPS} AS DOUBLE) AS cost_bps FROM (SELECT c_custkey, abs(c_acctbal) * 1000 AS adv FROM customer)",
)
def j13(spark, sf):
    band = es.cost_band(F.abs(F.col("c_acctbal")) * 1000, CostSchedule())
    return b.table(spark, sf, "customer").select("c_custkey", band["label"].alias("adv_bucket"), band["bps"].alias("cost_bps"))


@query(
    "A20_bucket_distribution",
    f"SELECT {_LABEL} AS adv_bucket, count(*) AS n_rows FROM (SELECT o_totalprice * 30 AS adv FROM orders) GROUP BY 1",
)
def a20(spark, sf):
    o = b.table(spark, sf, "orders").withColumn("adv", F.col("o_totalprice") * 30)
    return es.band_distribution(o, "adv")


@query(
    "J14_apply_costs",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST({_BPS} AS DOUBLE) AS cost_bps, round(l_discount - {_BPS} / 10000.0::DOUBLE, 8) + 0 AS net_return
    FROM (SELECT *, l_extendedprice * 30 AS adv FROM lineitem)""",
)
def j14(spark, sf):
    li = b.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_discount").alias("control_adjusted_return"),
        (F.col("l_extendedprice") * 30).alias("adv_20d"),
    )
    out = es.apply_costs(li)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cost_bps", rnd("net_return", 8))


@query(
    "W17_size_bucket",
    f"WITH {q.ORDERS_SIZED} SELECT o_orderkey AS event_id, CAST(size_bucket AS INTEGER) AS size_bucket FROM bucketed",
)
def w17(spark, sf):
    o = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.trunc(F.to_date("o_orderdate"), "month").alias("date"),
        F.col("o_totalprice").alias("market_cap"),
    )
    edges = es.quantile_edges(b.whole_universe(spark, sf), ["date"], "market_cap", 5)
    return o.join(edges, "date").select("event_id", es.quantile_bucket(F.col("market_cap"), F.col("edges"), 5).alias("size_bucket"))


@query(
    "W18_band_gaps",
    """WITH e AS (SELECT c_mktsegment AS label, min(c_acctbal) AS min_adv, max(c_acctbal) AS max_adv FROM customer GROUP BY 1),
    l AS (SELECT *, lead(min_adv) OVER (ORDER BY min_adv, label) AS next_min FROM e)
    SELECT * FROM l WHERE next_min IS NOT NULL AND next_min <> max_adv""",
)
def w18(spark, sf):
    bands = b.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(
        F.min("c_acctbal").alias("min_adv"), F.max("c_acctbal").alias("max_adv")
    )
    return es.band_gaps(bands)


@query(
    "J15_matched_control",
    f"""WITH {q.ORDERS_SIZED} SELECT event_id, CAST(size_bucket AS INTEGER) AS size_bucket, round(control_return, 6) + 0 AS control_return,
      control_n, thin_control FROM controlled""",
)
def j15(spark, sf):
    out = es.matched_control(b.study_events(spark, sf), b.control_pool(spark, sf), b.whole_universe(spark, sf))
    return out.select("event_id", "size_bucket", rnd("control_return"), "control_n", "thin_control")


_STUDY = f"""{q.ORDERS_SIZED}, priced AS (
  SELECT c.*, (o_totalprice % 89.0) / 890 - 0.04 AS raw_return FROM controlled c
  LEFT JOIN orders o ON o.o_orderkey = c.event_id AND o.o_orderstatus <> 'P'
), costed AS (SELECT *, adv_20d AS adv FROM priced)"""


@query(
    "J16_event_study",
    f"""WITH {_STUDY} SELECT event_id, round(raw_return, 6) + 0 AS raw_return, round(raw_return - control_return, 6) + 0 AS control_adjusted_return,
      {_LABEL} AS adv_bucket, round(raw_return - control_return - {_BPS} / 10000.0::DOUBLE, 6) + 0 AS net_return,
      CASE WHEN raw_return IS NULL THEN 'no_forward_return' END AS exclusion FROM costed""",
)
def j16(spark, sf):
    out = es.run_event_study(
        b.study_events(spark, sf), b.control_pool(spark, sf), b.whole_universe(spark, sf), b.event_returns(spark, sf)
    )
    return out.select("event_id", rnd("raw_return"), rnd("control_adjusted_return"), "adv_bucket", rnd("net_return"), "exclusion")


@query(
    "G3_study_gates",
    f"""WITH {_STUDY} SELECT count(*) AS n_events, count(*) FILTER (thin_control) AS n_thin, count(*) FILTER (raw_return IS NULL) AS n_excluded FROM costed""",
)
def g3(spark, sf):
    out = es.run_event_study(
        b.study_events(spark, sf), b.control_pool(spark, sf), b.whole_universe(spark, sf), b.event_returns(spark, sf)
    )
    return out.agg(
        F.count("*").alias("n_events"), F.count_if("thin_control").alias("n_thin"),
        F.count_if(F.col("exclusion").isNotNull()).alias("n_excluded"),
    )


@query(
    "X6_momentum_control",
    f"""WITH {q.ORDERS_SIZED}, me AS (SELECT date, quantile_cont(m, [0.0, 1/3.0, 2/3.0, 1.0]) AS em FROM
        (SELECT date, o_totalprice % 1000.0 AS m FROM sized) GROUP BY 1),
    t AS (SELECT s.*, greatest(1, least(3, len(list_filter(em, lambda e: e <= o_totalprice % 1000.0)))) AS terc FROM bucketed s JOIN me USING (date)),
    pool3 AS (SELECT date, sic_code, size_bucket, terc, avg(forward_return) AS control_return, count(*) AS control_n FROM t
        WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2, 3, 4)
    SELECT o_orderkey AS event_id, CAST(terc AS INTEGER) AS momentum_tercile, coalesce(p.control_n, 0) AS control_n, round(p.control_return, 6) + 0 AS control_return
    FROM t LEFT JOIN pool3 p USING (date, sic_code, size_bucket, terc) WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def x6(spark, sf):
    o = b._sized_orders(spark, sf, b.table(spark, sf, "orders")).withColumn("mom", F.pmod(F.col("o_totalprice"), F.lit(1000.0)))
    t = cl.momentum_tercile(o, "date", "mom")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    events = t.where(urgent).select(F.col("o_orderkey").alias("event_id"), "date", "market_cap", "sic_code", "momentum_tercile")
    pool = t.where(~urgent).select("date", "market_cap", "sic_code", "momentum_tercile", "forward_return")
    out = es.matched_control(events, pool, t.select("date", "market_cap"), ControlConfig(extra_key="momentum_tercile"))
    return out.select("event_id", "momentum_tercile", "control_n", rnd("control_return"))


@query(
    "X5_decile_spread",
    f"""WITH {_STUDY}, n AS (SELECT event_id, control_return AS signal, raw_return - control_return - {_BPS} / 10000.0::DOUBLE AS net, {_LABEL} AS adv_bucket
      FROM costed WHERE raw_return IS NOT NULL AND control_return IS NOT NULL),
    e AS (SELECT quantile_cont(CAST(event_id AS DOUBLE), [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS ed FROM n),
    d AS (SELECT n.*, greatest(1, least(10, len(list_filter(ed, lambda v: v <= event_id)))) AS dec FROM n, e)
    SELECT adv_bucket, round(avg(net) FILTER (dec = 10), 6) + 0 AS top, round(avg(net) FILTER (dec = 1), 6) + 0 AS bottom,
      count(*) FILTER (dec IN (1, 10)) AS n_legs FROM d GROUP BY 1""",
)
def x5(spark, sf):
    out = es.run_event_study(
        b.study_events(spark, sf), b.control_pool(spark, sf), b.whole_universe(spark, sf), b.event_returns(spark, sf)
    ).where(F.col("net_return").isNotNull())
    spread = cl.decile_spread(out, "event_id", "net_return")
    return spread.select("adv_bucket", rnd("top"), rnd("bottom"), "n_legs")


@query(
    "X1_insider_clusters",
    """WITH t AS (SELECT l_partkey AS issuer, l_suppkey AS insider, CASE WHEN l_returnflag = 'R' THEN 'S' ELSE 'P' END AS code,
        l_extendedprice AS value, l_shipdate AS known_at, CAST(l_shipdate AS DATE) AS d FROM lineitem),
    cal AS (SELECT d, row_number() OVER (ORDER BY d) AS idx FROM (SELECT DISTINCT d FROM t)),
    p AS (SELECT t.*, idx FROM t JOIN cal USING (d)),
    ends AS (SELECT DISTINCT issuer, idx + k AS e FROM p, range(0, 10) r(k) WHERE idx + k <= (SELECT max(idx) FROM cal)),
    st AS (SELECT ends.issuer, e, count(DISTINCT insider) FILTER (code = 'P') AS n_buyers, coalesce(sum(value) FILTER (code = 'P'), 0) AS bought,
        coalesce(sum(value) FILTER (code = 'S'), 0) AS sold FROM ends JOIN p ON p.issuer = ends.issuer AND p.idx BETWEEN e - 9 AND e GROUP BY 1, 2),
    ok AS (SELECT *, lag(e) OVER (PARTITION BY issuer ORDER BY e) AS pe FROM st WHERE n_buyers >= 3 AND sold <= 0.25 * bought)
    SELECT issuer, CAST(e AS BIGINT) AS end_idx, n_buyers, round(bought, 2) AS bought, round(sold, 2) AS sold FROM ok WHERE pe IS NULL OR pe < e - 1""",
)
def x1(spark, sf):
    t = b.trades(spark, sf)
    cal = pn.trading_calendar(t, "known_at")
    out = cl.insider_clusters(t, cal, window=10)
    return out.select("issuer", "end_idx", "n_buyers", rnd("bought", 2), rnd("sold", 2))


@query(
    "X2_routine_trades",
    """WITH t AS (SELECT o_custkey AS insider, o_orderkey, month(o_orderdate) AS m, year(o_orderdate) AS y, o_orderstatus <> 'P' AS buy FROM orders),
    k AS (SELECT DISTINCT insider, m, y FROM t WHERE buy)
    SELECT o_orderkey, (SELECT count(*) FROM k WHERE k.insider = t.insider AND k.m = t.m AND k.y BETWEEN t.y - 5 AND t.y - 1) AS prior_years,
      buy AND (SELECT count(*) FROM k WHERE k.insider = t.insider AND k.m = t.m AND k.y BETWEEN t.y - 5 AND t.y - 1) >= 2 AS is_routine FROM t""",
)
def x2(spark, sf):
    t = b.table(spark, sf, "orders").select(
        "o_orderkey", F.lit(1).alias("issuer"), F.col("o_custkey").alias("insider"), F.col("o_orderdate").alias("known_at"),
        F.when(F.col("o_orderstatus") == "P", "S").otherwise("P").alias("code"),
    )
    return cl.routine_trades(t, 5, 2).select("o_orderkey", "prior_years", "is_routine")


@query(
    "X3_exclusion_window",
    f"""WITH {q.CAL}, e AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS ticker, idx FROM events JOIN cal ON date = CAST(ts AS DATE) WHERE event_type = 'signup')
    SELECT b.ticker, CAST(b.date AS VARCHAR) AS date FROM bars b JOIN cal USING (date)
    WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.ticker = b.ticker AND abs(e.idx - cal.idx) <= 2)""",
)
def x3(spark, sf):
    px = b.bars(spark, sf)
    signups = b.table(spark, sf, "events").where(F.col("event_type") == "signup").select(
        F.col("user_id").cast("string").alias("ticker"), F.to_date("ts").alias("date")
    )
    out = es.exclusion_window(signups, px, b.calendar(spark, sf), 2, "ticker")
    return out.select("ticker", text("date"))


@query(
    "X4_announcement_car",
    f"""WITH {q.RET}, bm AS (SELECT date, avg(ret) AS m FROM ret GROUP BY 1), ab AS (SELECT ticker, idx, ret - m AS ab FROM ret JOIN bm USING (date)),
    e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS ticker, (SELECT min(idx) FROM cal WHERE date >= CAST(ts AS DATE)) AS i FROM events WHERE event_type = 'purchase')
    SELECT event_id, e.ticker, CASE WHEN count(ab) = 3 THEN round(sum(ab), 6) + 0 END AS car
    FROM e LEFT JOIN ab ON ab.ticker = e.ticker AND ab.idx BETWEEN e.i - 1 AND e.i + 1 GROUP BY 1, 2""",
)
def x4(spark, sf):
    r = b.padded_returns(spark, sf)
    ab = r.join(r.groupBy("date").agg(F.avg("ret").alias("m")), "date").select("ticker", "date", (F.col("ret") - F.col("m")).alias("ret"))
    events = b.requests(spark, sf).select("event_id", "ticker", F.col("as_of").alias("date"))
    return cl.announcement_car(events, ab, pn.trading_calendar(r)).withColumn("car", rnd("car"))


@query(
    "A33_request_summary",
    """SELECT count(*) AS total_requests, count(*) FILTER (value > 40 OR user_id % 7 = 0) AS failed_requests, bool_or(event_type = 'error') AS any_rate_limit_headers,
      CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_bytes, round(sum(value) / 100, 3) AS total_seconds,
      count(*) FILTER (value > 40) AS n_503, count(*) FILTER (value <= 40 AND value > 1) AS n_200, count(*) FILTER (value <= 1) AS n_no_response FROM events""",
)
def a33(spark, sf):
    e = b.table(spark, sf, "events")
    log = e.select(
        F.when(F.col("value") > 40, 503).when(F.col("value") > 1, 200).alias("http_status"),
        F.floor("value").alias("response_size_bytes"), (F.col("value") / 100).alias("elapsed_seconds"),
        F.when(F.pmod("user_id", F.lit(7)) == 0, "timeout").alias("error"),
        F.when(F.col("event_type") == "error", F.create_map(F.lit("retry-after"), F.lit("1"))).alias("rate_limit_headers"),
    )
    s = reports.request_summary(log)
    status = [F.coalesce(F.try_element_at("status_distribution", F.lit(k)), F.lit(0).cast("long")).alias(f"n_{k}") for k in ("503", "200", "no_response")]
    return s.select("total_requests", "failed_requests", "any_rate_limit_headers", "total_bytes", "total_seconds", *status)


@query(
    "P5_event_rows",
    """SELECT o_orderkey AS ref, 'h11_' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '_' || strftime(o_orderdate, '%Y%m%d') AS event_id FROM orders""",
)
def p5(spark, sf):
    from tidemark.operators.filings import pad_cik

    o = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ref"), pad_cik(F.col("o_custkey")).alias("entity_id"), F.lit("").alias("ticker"),
        F.to_date("o_orderdate").alias("period_end"), F.timestamp_add("DAY", F.lit(40), "o_orderdate").alias("known_at"),
    )
    return es.build_events(o).select("ref", "event_id")


@query(
    "P4_known_before_period",
    """SELECT l_returnflag, count(*) AS n, count(*) FILTER ((l_shipdate AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' <= o_orderdate) AS n_violations
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
)
def p4(spark, sf):
    o = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("period_end"))
    joined = b.table(spark, sf, "lineitem").withColumnRenamed("l_shipdate", "known_at").join(o, "l_orderkey")
    bad = es.known_too_early(F.col("known_at"), F.col("period_end"))
    return joined.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(bad).alias("n_violations"))


@query(
    "P18_sized_position",
    """SELECT o_orderkey, CASE WHEN (o_totalprice % 100.0) / 100 >= 0.55 THEN round((CASE WHEN o_orderstatus = 'P' THEN -1 ELSE 1 END) * (o_totalprice % 100.0) / 100, 6) ELSE 0 END AS position FROM orders""",
)
def p18(spark, sf):
    from tidemark.operators.models import sized_position

    call = F.when(F.col("o_orderstatus") == "P", -1).otherwise(1)
    conf = F.pmod(F.col("o_totalprice"), F.lit(100.0)) / 100
    return b.table(spark, sf, "orders").select("o_orderkey", rnd(sized_position(call, conf), 6, "position"))


@query(
    "K6_replace_ticker",
    f"""WITH {q.BARS} SELECT ticker, CAST(date AS VARCHAR) AS date, close FROM bars WHERE ticker NOT IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P')
    UNION ALL SELECT CAST(o_custkey AS VARCHAR), CAST(CAST(o_orderdate AS DATE) AS VARCHAR), o_totalprice FROM orders WHERE o_orderstatus = 'P'""",
)
def k6(spark, sf):
    from tidemark.sources.sinks import with_ticker_replaced

    new = b.table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(
        F.col("o_custkey").cast("string").alias("ticker"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("close")
    )
    out = with_ticker_replaced(b.bars(spark, sf).select("ticker", "date", "close"), new)
    return out.select("ticker", text("date"), "close")
