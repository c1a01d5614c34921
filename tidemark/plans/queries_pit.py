"""Point-in-time reads, writes and as-of price lookups."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import eventstudy as es
from tidemark.operators import panel as pn
from tidemark.operators import pit
from tidemark.operators.ordered import earliest
from tidemark.operators.reports import union_all
from tidemark.plans import bindings as b
from tidemark.plans import sqlparts as q
from tidemark.plans.registry import query, rnd, text
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources.files import read_features
from tidemark.sources.sinks import FeatureStore

QUERY_TIME = datetime(2024, 1, 15, 12)
QUERY_TIMES = [datetime(2024, 1, d, h) for d, h in ((1, 0), (3, 12), (8, 0), (15, 12), (20, 6), (28, 23), (31, 0))]


@query(
    "J1_as_of",
    """SELECT CAST(user_id AS VARCHAR) AS entity_id, event_type AS feature_name, CAST(ts AS VARCHAR) AS known_at, value
    FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00'
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def j1(spark, sf):
    out = pit.as_of(b.features(spark, sf), QUERY_TIME, tie_break=["event_id"])
    return out.select("entity_id", "feature_name", text("known_at"), "value")


@query(
    "J2_panel_as_of",
    """SELECT CAST(t.q AS VARCHAR) AS query_time, CAST(user_id AS VARCHAR) AS entity_id, event_type AS feature_name,
      CAST(ts AS VARCHAR) AS known_at, value
    FROM events JOIN (VALUES """
    + ", ".join(f"(TIMESTAMP '{t}')" for t in QUERY_TIMES)
    + """) t(q) ON ts <= t.q
    QUALIFY row_number() OVER (PARTITION BY t.q, user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def j2(spark, sf):
    out = pit.panel_as_of(b.features(spark, sf), QUERY_TIMES, tie_break=["event_id"])
    return out.select(text("query_time"), "entity_id", "feature_name", text("known_at"), "value")


@query(
    "K2_write_batch",
    """SELECT CAST(user_id AS VARCHAR) AS entity_id, event_type AS feature_name, CAST(ts AS VARCHAR) AS known_at, value,
      CAST(NULL AS VARCHAR) AS period_end, 'v1' AS source_version FROM events""",
)
def k2(spark, sf):
    out = pit.prepare_batch(b.features(spark, sf))
    return out.select("entity_id", "feature_name", text("known_at"), "value", text("period_end"), "source_version")


@query(
    "K3_upsert",
    """SELECT CAST(user_id AS VARCHAR) AS entity_id, event_type AS feature_name,
      CAST(CAST(ts AS DATE) AS VARCHAR) AS known_at, value
    FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id DESC) = 1""",
)
def k3(spark, sf):
    f = b.features(spark, sf).withColumn("known_at", F.to_date("known_at"))
    out = pit.upsert(f, ["event_id"])
    return out.select("entity_id", "feature_name", text("known_at"), "value")


@query(
    "S13_feature_reads",
    """SELECT CAST(user_id AS VARCHAR) AS entity_id, event_type AS feature_name, CAST(CAST(ts AS DATE) AS VARCHAR) AS known_at,
      CASE WHEN user_id % 3 = 0 THEN value + 1 ELSE value END AS value, CASE WHEN user_id % 3 = 0 THEN 'v2' ELSE 'v1' END AS source_version
    FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id DESC) = 1""",
)
def s13(spark, sf):
    """Two batches are written to a store, the second replacing a third of the entities' values; the store is read back."""
    f = b.features(spark, sf).select("entity_id", "feature_name", F.to_date("known_at").cast("timestamp").alias("known_at"), "value", F.col("event_id").alias("row_seq"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/features-{uuid.uuid4().hex}"
    store = FeatureStore(spark, path)
    store.write_batch(f, 1)
    revised = f.where(F.col("entity_id").cast("long") % 3 == 0)
    store.write_batch(revised.withColumn("value", F.col("value") + 1).withColumn("source_version", F.lit("v2")), 2)
    return read_features(spark, path).select("entity_id", "feature_name", text(F.to_date("known_at")).alias("known_at"), "value", "source_version")


_REQ = f"""{q.BARS}, req AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS ticker, ts AS known_at, CAST(ts AS DATE) AS as_of,
         (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local
  FROM events WHERE event_type = 'purchase'
), bound AS (
  SELECT *, CAST(local AS DATE) AS day, hour(local) >= 16 AS printed FROM req)"""


@query(
    "J3_price_as_of",
    f"""WITH {_REQ} SELECT r.event_id, r.ticker, b.close AS price
    FROM req r ASOF LEFT JOIN bars b ON r.ticker = b.ticker AND r.as_of - 1 >= b.date""",
)
def j3(spark, sf):
    req = b.requests(spark, sf).withColumn("as_of", F.date_sub("as_of", 1))
    return es.price_as_of(req, b.bars(spark, sf), "as_of").select("event_id", "ticker", "price")


@query(
    "J4_last_printed_close",
    f"""WITH {_REQ} SELECT r.event_id, r.ticker, b.close AS last_close
    FROM (SELECT *, CASE WHEN printed THEN day ELSE day - 1 END AS lim FROM bound) r
    ASOF LEFT JOIN bars b ON r.ticker = b.ticker AND r.lim >= b.date""",
)
def j4(spark, sf):
    return es.last_printed_close(b.requests(spark, sf), b.bars(spark, sf)).select("event_id", "ticker", "last_close")


@query(
    "J5_entry_bar_close",
    f"""WITH {_REQ} SELECT r.event_id, r.ticker, b.close AS entry_close
    FROM (SELECT *, CASE WHEN printed THEN day + 1 ELSE day END AS lim FROM bound) r
    ASOF LEFT JOIN bars b ON r.ticker = b.ticker AND r.lim <= b.date""",
)
def j5(spark, sf):
    return es.entry_bar_close(b.requests(spark, sf), b.bars(spark, sf)).select("event_id", "ticker", "entry_close")


@query(
    "J6_entry_date",
    f"""WITH {_REQ}, days AS (SELECT DISTINCT date FROM bars WHERE dayofweek(date) NOT IN (0, 6))
    SELECT event_id, CAST((SELECT min(date) FROM days WHERE date >= CASE WHEN local <= CAST(day AS TIMESTAMP) + INTERVAL 16 HOUR
        THEN day ELSE day + 1 END) AS VARCHAR) AS entry_date FROM bound""",
)
def j6(spark, sf):
    weekdays = b.bars(spark, sf).where(~F.dayofweek("date").isin(1, 7))
    out = es.entry_date(b.requests(spark, sf), pn.trading_calendar(weekdays))
    return out.select("event_id", text("entry_date"))


@query(
    "J7_next_trading_day",
    f"""WITH {q.BARS}, days AS (SELECT DISTINCT date FROM bars WHERE dayofweek(date) NOT IN (0, 6))
    SELECT * FROM (SELECT event_id, CAST((SELECT min(date) FROM days WHERE date > CAST(ts AS DATE)) AS VARCHAR) AS entry_date
    FROM events) WHERE entry_date IS NOT NULL""",
)
def j7(spark, sf):
    weekdays = b.bars(spark, sf).where(~F.dayofweek("date").isin(1, 7))
    out = pn.next_trading_day(b.table(spark, sf, "events"), "ts", pn.trading_calendar(weekdays))
    return out.where(F.col("entry_date").isNotNull()).select("event_id", text("entry_date"))


@query(
    "J8_forward_return",
    f"""WITH {q.CAL}, ev AS (
      SELECT event_id, CAST(user_id AS VARCHAR) AS ticker, (SELECT min(idx) FROM cal WHERE date > CAST(ts AS DATE)) AS entry_idx
      FROM events WHERE event_type = 'purchase'
    ), px AS (SELECT ticker, idx, close FROM bars JOIN cal USING (date))
    SELECT event_id, e.ticker, h AS horizon, round(p1.close / nullif(p0.close, 0) - 1, 6) + 0 AS fwd_ret
    FROM ev e, (VALUES (1), (5), (20)) t(h)
    LEFT JOIN px p0 ON p0.ticker = e.ticker AND p0.idx = e.entry_idx
    LEFT JOIN px p1 ON p1.ticker = e.ticker AND p1.idx = e.entry_idx + h""",
)
def j8(spark, sf):
    px = b.bars(spark, sf)
    out = pn.fixed_horizon_return(b.requests(spark, sf), px, b.calendar(spark, sf), "as_of", [1, 5, 20])
    return out.select("event_id", "ticker", "horizon", rnd("fwd_ret"))


@query(
    "P22_excess_over_benchmark",
    f"""WITH {q.CAL}, ev AS (
      SELECT event_id, CAST(user_id AS VARCHAR) AS ticker, (SELECT min(idx) FROM cal WHERE date > CAST(ts AS DATE)) AS entry_idx
      FROM events WHERE event_type = 'purchase'
    ), px AS (SELECT ticker, idx, close FROM bars JOIN cal USING (date)),
    bm AS (SELECT idx, avg(close) AS close FROM px GROUP BY 1)
    SELECT event_id, h AS horizon, round(p1.close / nullif(p0.close, 0) - b1.close / nullif(b0.close, 0), 6) + 0 AS excess
    FROM ev e, (VALUES (1), (5), (20)) t(h)
    LEFT JOIN px p0 ON p0.ticker = e.ticker AND p0.idx = e.entry_idx
    LEFT JOIN px p1 ON p1.ticker = e.ticker AND p1.idx = e.entry_idx + h
    LEFT JOIN bm b0 ON b0.idx = e.entry_idx LEFT JOIN bm b1 ON b1.idx = e.entry_idx + h""",
)
def p22(spark, sf):
    px = b.bars(spark, sf)
    bench = px.groupBy("date").agg(F.avg("close").alias("close"))
    out = pn.excess_over_benchmark(b.requests(spark, sf), px, bench, b.calendar(spark, sf), "as_of", [1, 5, 20])
    return out.select("event_id", "horizon", rnd("excess"))


@query(
    "J23_publication_lag",
    """WITH monthly AS (
      SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, c_nationkey AS series, max(o_totalprice) AS value
      FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2
    ), daily AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, c_nationkey AS series
      FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT CAST(d.date AS VARCHAR) AS date, d.series, m.value
    FROM daily d ASOF LEFT JOIN (SELECT date + 45 AS visible, series, value FROM monthly) m
    ON d.series = m.series AND d.date >= m.visible""",
)
def j23(spark, sf):
    o = b.table(spark, sf, "orders").join(
        b.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("series")), "o_custkey"
    )
    monthly = o.groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("date"), "series").agg(
        F.max("o_totalprice").alias("value")
    )
    daily = o.select(F.to_date("o_orderdate").alias("date"), "series").distinct()
    out = pn.publication_lag_join(daily, monthly, ["series"], "date", "value", 45)
    return out.select(text("date"), "series", "value")


@query(
    "W12_trailing_median_adv",
    f"""WITH {q.BARS}, adv AS (
      SELECT ticker, date, CASE WHEN count(*) OVER w = 20 THEN quantile_cont(close * volume, 0.5) OVER w END AS adv
      FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
    ), req AS (SELECT event_id, CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS as_of FROM events WHERE event_type = 'purchase')
    SELECT event_id, round(a.adv, 6) AS adv FROM req r ASOF LEFT JOIN adv a ON r.ticker = a.ticker AND r.as_of > a.date""",
)
def w12(spark, sf):
    out = pn.median_adv_as_of(b.requests(spark, sf), b.bars(spark, sf), "as_of")
    return out.select("event_id", rnd("adv"))


@query(
    "P10_price_bound",
    """SELECT event_id, CAST(CAST(local AS DATE) AS VARCHAR) AS day, hour(local) >= 16 AS printed FROM (
      SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local FROM events)""",
)
def p10(spark, sf):
    day, printed = es.price_bound(F.col("ts"))
    return b.table(spark, sf, "events").select("event_id", text(day, "day"), printed.alias("printed"))


@query(
    "O3_keep_first",
    """SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1""",
)
def o3(spark, sf):
    e = b.table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    return earliest(e, ["user_id", "date"], ["ts", "event_id"], ["event_id", "value"]).withColumn("date", text("date"))


@query(
    "O4_union_series",
    """SELECT 'events' AS source, CAST(user_id AS VARCHAR) AS entity_id, value, CAST(NULL AS VARCHAR) AS status FROM events
    UNION ALL SELECT 'orders', CAST(o_custkey AS VARCHAR), o_totalprice, o_orderstatus FROM orders""",
)
def o4(spark, sf):
    e = b.table(spark, sf, "events").select(F.lit("events").alias("source"), text("user_id", "entity_id"), "value")
    o = b.table(spark, sf, "orders").select(
        F.lit("orders").alias("source"), text("o_custkey", "entity_id"), F.col("o_totalprice").alias("value"),
        F.col("o_orderstatus").alias("status"),
    )
    return union_all([e, o])
