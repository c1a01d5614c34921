"""Landed-file parsers, run on JSON documents that Spark derives from the tables (one document per row)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import bindings as b
from tidemark.plans.registry import query, text
from tidemark.sources import files as fs

_FORM = """CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '10-Q' WHEN '3-MEDIUM' THEN '13F-HR'
  WHEN '4-NOT SPECIFIED' THEN '8-K' ELSE '8-K/A' END"""


def _submissions(spark, sf):
    """Each order as a submission holding two parallel filings: itself, and a 10-Q/A."""
    p = F.col("o_orderpriority")
    form = (
        F.when(p == "1-URGENT", "10-K").when(p == "2-HIGH", "10-Q").when(p == "3-MEDIUM", "13F-HR")
        .when(p == "4-NOT SPECIFIED", "8-K").otherwise("8-K/A")
    )
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    stamp = F.concat(day, F.lit("T"), F.lpad(F.pmod("o_orderkey", F.lit(24)).cast("string"), 2, "0"), F.lit(":30:00.000Z"))
    items = F.when(F.col("o_orderstatus") == "P", "5.02").otherwise("2.02,9.01")
    recent = F.struct(
        F.array(form, F.lit("10-Q/A")).alias("form"),
        F.array(F.col("o_orderkey").cast("string"), F.lit("amended")).alias("accessionNumber"),
        F.array(day, day).alias("filingDate"), F.array(day, day).alias("reportDate"),
        F.array(stamp, stamp).alias("acceptanceDateTime"), F.array(items, items).alias("items"),
    )
    former = F.when(
        F.col("o_orderstatus") == "F",
        F.array(F.struct(F.concat(F.lit("Old "), F.col("o_orderkey")).alias("name"), F.lit("2000").alias("from"), F.lit("2001").alias("to"))),
    )
    doc = F.to_json(
        F.struct(
            F.col("o_custkey").alias("cik"), F.concat(F.lit("Name "), F.col("o_custkey")).alias("name"), F.lit("35").alias("sic"),
            F.when(F.col("o_orderstatus") != "O", F.array(F.lit("NYSE"))).alias("exchanges"), former.alias("formerNames"),
            F.struct(recent.alias("recent")).alias("filings"),
        )
    )
    return b.table(spark, sf, "orders").select("o_orderkey", doc.alias("json"))


@query(
    "S3_company_tickers",
    "SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, c_mktsegment AS ticker, c_name AS company_name FROM customer",
)
def s3(spark, sf):
    entry = F.struct(F.col("c_custkey").alias("cik_str"), F.col("c_mktsegment").alias("ticker"), F.col("c_name").alias("title"))
    docs = b.table(spark, sf, "customer").select(F.to_json(F.create_map(F.col("c_custkey").cast("string"), entry)).alias("json"))
    return fs.parse_company_tickers(docs)


@query(
    "S4_submissions",
    """SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, 'Name ' || o_custkey AS name, '35' AS sic_code,
      CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END AS n_exchanges, CASE WHEN o_orderstatus = 'F' THEN 'Old ' || o_orderkey ELSE '' END AS former FROM orders""",
)
def s4(spark, sf):
    out = fs.parse_submissions(_submissions(spark, sf))
    return out.select(
        "cik", "name", "sic_code", F.size("exchanges").alias("n_exchanges"),
        F.array_join(F.transform("former_names", lambda f: f["name"]), ";").alias("former"),
    )


_ACCEPTED = "CAST(o_orderdate + to_hours(o_orderkey % 24) + INTERVAL 30 MINUTE AS TIMESTAMP)"


@query(
    "S5_item_202",
    f"""SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CAST(o_orderkey AS VARCHAR) AS accession_number, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filing_date,
      CAST(({_ACCEPTED} AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS VARCHAR) AS acceptance_eastern
    FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus <> 'P'""",
)
def s5(spark, sf):
    out = fs.parse_item_202(_submissions(spark, sf))
    return out.select("cik", "accession_number", text("filing_date"), text("acceptance_eastern"))


@query(
    "S6_periodic",
    f"""SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CAST(o_orderkey AS VARCHAR) AS accession_number, {_FORM} AS form,
      CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS report_date, CAST({_ACCEPTED} AS VARCHAR) AS acceptance_datetime
    FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def s6(spark, sf):
    out = fs.parse_periodic(_submissions(spark, sf))
    return out.select("cik", "accession_number", "form", text("report_date"), text("acceptance_datetime"))


@query(
    "S7_13f_index",
    """SELECT 'Name ' || o_custkey AS entity_id, CAST(o_orderkey AS VARCHAR) AS accession_number, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS known_at
    FROM orders WHERE o_orderpriority = '3-MEDIUM'""",
)
def s7(spark, sf):
    out = fs.parse_13f_index(_submissions(spark, sf))
    return out.select("entity_id", "accession_number", text(F.to_date("known_at"), "known_at"))


@query(
    "S8_observations",
    """SELECT event_type AS entity_id, event_type AS feature_name, CAST(CAST(ts AS DATE) AS VARCHAR) AS known_at, value, event_id FROM events WHERE user_id % 5 <> 0""",
)
def s8(spark, sf):
    shown = F.when(F.pmod("user_id", F.lit(5)) == 0, ".").otherwise(F.col("value").cast("string"))
    obs = F.array(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), shown.alias("value")))
    docs = b.table(spark, sf, "events").select(
        F.concat_ws("|", "event_type", "event_id").alias("series_id"), F.to_json(F.struct(obs.alias("observations"))).alias("json")
    )
    out = fs.parse_observations(docs)
    name = F.split("entity_id", "\\|")
    return out.select(
        name[0].alias("entity_id"), name[0].alias("feature_name"), text(F.to_date("known_at"), "known_at"), "value",
        name[1].cast("long").alias("event_id"),
    )


@query(
    "S9_pageviews",
    """SELECT CAST(page_id AS VARCHAR) AS entity_id, CAST(TIMESTAMP '2024-01-02' + to_hours(page_id % 24) AS VARCHAR) AS known_at, CAST(length(html) AS DOUBLE) AS value FROM pages""",
)
def s9(spark, sf):
    stamp = F.concat(F.lit("20240101"), F.lpad(F.pmod("page_id", F.lit(24)).cast("string"), 2, "0"))
    items = F.array(F.struct(stamp.alias("timestamp"), F.length("html").alias("views")))
    docs = b.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("page"), F.to_json(F.struct(items.alias("items"))).alias("json"))
    return fs.parse_pageviews(docs).select("entity_id", text("known_at"), "value")


@query(
    "S12_branch_pages",
    """SELECT year(o_orderdate)::INTEGER AS year, o_orderstatus AS state, o_totalprice AS deposits, o_orderkey AS cert,
      CASE WHEN o_custkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS hc FROM orders""",
)
def s12(spark, sf):
    hc = F.when(F.pmod("o_custkey", F.lit(3)) == 0, "0").otherwise(F.col("o_custkey").cast("string"))
    row = F.struct(
        F.year("o_orderdate").alias("YEAR"), F.col("o_orderstatus").alias("STALPBR"), F.col("o_totalprice").cast("string").alias("DEPSUMBR"),
        F.col("o_orderkey").alias("CERT"), hc.alias("RSSDHCR"),
    )
    docs = b.table(spark, sf, "orders").select(F.to_json(F.struct(F.array(F.struct(row.alias("data"))).alias("data"))).alias("json"))
    return fs.parse_branch_pages(docs)


@query(
    "A37_ticker_review",
    """WITH px AS (SELECT CAST(user_id AS VARCHAR) AS t, count(DISTINCT CAST(ts AS DATE)) AS d FROM events GROUP BY 1)
    SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CAST(o_custkey AS VARCHAR) AS ticker, 'Name ' || o_custkey AS name,
      CASE WHEN o_orderstatus = 'F' THEN 'Old ' || o_orderkey ELSE '' END AS former_names, CASE WHEN o_orderstatus <> 'O' THEN 'NYSE' ELSE '' END AS exchanges,
      coalesce(d, 0) AS trading_days, coalesce(d, 0) < 27 AS low_trading_days
    FROM orders LEFT JOIN px ON px.t = CAST(o_custkey AS VARCHAR)""",
)
def a37(spark, sf):
    from tidemark.operators.filings import pad_cik
    from tidemark.operators.reports import ticker_resolution_review

    tickers = b.table(spark, sf, "customer").select(
        pad_cik(F.col("c_custkey")).alias("cik"), F.col("c_custkey").cast("string").alias("ticker")
    )
    return ticker_resolution_review(fs.parse_submissions(_submissions(spark, sf)), tickers, b.bars(spark, sf), 27)
