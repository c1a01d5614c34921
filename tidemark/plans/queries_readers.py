"""Reader, writer, gate and scalar-function queries over text and records derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.distributions import norm_cdf, t_p_value
from tidemark.operators import evaluate as ev
from tidemark.operators import eventstudy as es
from tidemark.operators import gates
from tidemark.plans import bindings as b
from tidemark.plans import sqlparts as q
from tidemark.plans.registry import query, rnd, text
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import files as fs

# two quarters' layouts: other order, a column more, a column less
_OLD = ("adsh", "tag", "version", "coreg", "ddate", "qtrs", "uom", "value")
_NEW = ("adsh", "tag", "version", "ddate", "qtrs", "uom", "segments", "value")


def _filing_cells():
    """The cells of a lineitem row by name, and whether the row is of the old layout."""
    cells = {
        "adsh": F.col("l_orderkey").cast("string"), "tag": F.concat(F.lit("Tag"), F.col("l_linenumber")), "version": F.lit("us-gaap/2020"),
        "coreg": F.when(F.col("l_returnflag") == "A", "Parent"), "segments": F.lit("S"), "ddate": F.date_format("l_shipdate", "yyyyMMdd"),
        "qtrs": F.pmod("l_suppkey", F.lit(5)).cast("string"), "uom": F.lit("USD"), "value": F.col("l_extendedprice").cast("string"),
    }
    return cells, F.col("l_shipdate") < F.lit("1995-01-01").cast("date")


def _filing_lines(spark, sf):
    """lineitem as tab-separated lines of two layouts, each line with its file's header."""
    cells, old = _filing_cells()

    def line(names):
        return F.concat_ws("\t", *[F.coalesce(cells[n], F.lit("")) for n in names])

    return b.table(spark, sf, "lineitem").select(
        F.when(old, "\t".join(_OLD)).otherwise("\t".join(_NEW)).alias("header"), F.when(old, line(_OLD)).otherwise(line(_NEW)).alias("line")
    )


_FILING_SQL = """SELECT CAST(l_orderkey AS VARCHAR) AS adsh, 'Tag' || l_linenumber AS tag, CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) AS ddate,
      CAST(l_suppkey % 5 AS INTEGER) AS qtrs, 'USD' AS uom, round(l_extendedprice, 2) AS value,
      CASE WHEN l_returnflag = 'A' AND l_shipdate < DATE '1995-01-01' THEN 'Parent' END AS coreg FROM lineitem"""


@query("S2_filing_lines", _FILING_SQL)
def s2(spark, sf):
    out = fs.parse_delimited(_filing_lines(spark, sf), "header", "line", fs.NUM_SCHEMA)
    return out.select("adsh", "tag", "ddate", "qtrs", "uom", rnd("value", 2), "coreg")


@query("S2_landed_sets", _FILING_SQL)
def s2_landed(spark, sf):
    """The same rows landed as files of two layouts in the shared folder, then read by their headers."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
    cells, old = _filing_cells()
    for folder, names, rows in (("old", _OLD, old), ("new", _NEW, ~old)):
        part = b.table(spark, sf, "lineitem").where(rows).select(*[cells[n].alias(n) for n in names])
        part.write.option("header", True).option("sep", "\t").option("escape", '"').csv(f"{path}/{folder}")
    out = fs.read_csv(spark, f"{path}/*/*.csv", fs.NUM_SCHEMA, "\t")
    return out.select("adsh", "tag", "ddate", "qtrs", "uom", rnd("value", 2), "coreg")


@query(
    "S1_price_lines",
    """SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CASE WHEN value > 1 THEN round(value, 2) END AS close FROM events""",
)
def s1(spark, sf):
    e = b.table(spark, sf, "events")
    price = F.when(F.col("value") > 1, F.round("value", 2).cast("string")).otherwise("n/a")  # malformed becomes NULL
    lines = e.select(F.lit("date,close,ticker").alias("header"), F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd"), price, F.col("user_id")).alias("line"))
    out = fs.parse_delimited(lines, "header", "line", fs.PRICE_SCHEMA, ",")
    return out.select("ticker", text("date"), rnd("close", 2))


@query(
    "G1_malformed_values",
    "SELECT 'close' AS \"column\", count(*) FILTER (value <= 1) AS n FROM events UNION ALL SELECT 'ticker', 0 UNION ALL SELECT 'date', 0",
)
def g1(spark, sf):
    e = b.table(spark, sf, "events")
    raw = e.select(
        F.col("user_id").cast("string").alias("ticker"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.when(F.col("value") > 1, F.col("value").cast("string")).otherwise("n/a").alias("close"),
    )
    return fs.malformed(raw, fs.PRICE_SCHEMA)


@query(
    "G2_stage_records",
    """SELECT 'priced' AS stage, count(*) AS rows_in, count(*) FILTER (value > 1) AS rows_out, 'positive' AS check_name, true AS passed, '0' AS value FROM events""",
)
def g2(spark, sf):
    """A stage run under gates, its record as a row."""
    e = gates.require_columns(b.table(spark, sf, "events"), ["event_id", "value"])
    _, log = gates.run_stage(
        "priced", e.select("event_id", "value"), lambda d: d.where("value > 1"), lambda out: [gates.gate_rows(out, "positive", F.col("value") <= 0)]
    )
    rows = gates.stage_logs_frame(spark, [log])
    return rows.select("stage", "rows_in", "rows_out", F.explode("checks").alias("c")).select(
        "stage", "rows_in", "rows_out", F.col("c.name").alias("check_name"), F.col("c.passed").alias("passed"), F.col("c.value").alias("value")
    )


@query(
    "F5_coded_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y%m%d') END AS coded FROM orders""",
)
def f5(spark, sf):
    o = b.table(spark, sf, "orders")
    coded = F.when(F.col("o_orderkey") % 7 == 0, 99999999).otherwise(F.date_format("o_orderdate", "yyyyMMdd").cast("int"))  # no such day
    out = o.select("o_orderkey", es.yyyymmdd(coded).alias("day"))
    return out.select("o_orderkey", text("day"), F.date_format("day", "yyyyMMdd").alias("coded"))


@query(
    "F6_eastern_clock",
    """SELECT event_id, strftime(CAST(ts AS TIMESTAMP) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M:%S') AS eastern FROM events""",
)
def f6(spark, sf):
    e = b.table(spark, sf, "events")
    return e.select("event_id", F.date_format(es.to_eastern(F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias("eastern"))


@query(
    "F7_bar_and_compounding",
    """SELECT o_orderkey, round(CASE WHEN o_orderkey <= 400 THEN 3.0 ELSE 3.0 + 0.15 * log2(o_orderkey / 400.0) END, 6) AS bar,
      CAST(sign(o_totalprice - 150000) AS INTEGER) AS side, round(greatest(1000.0, least(100000.0, o_totalprice)), 2) AS clipped FROM orders""",
)
def f7(spark, sf):
    o = b.table(spark, sf, "orders")
    side = F.signum(F.col("o_totalprice") - 150000).cast("int").alias("side")
    clipped = F.greatest(F.lit(1000.0), F.least(F.lit(100000.0), F.col("o_totalprice")))
    return o.select("o_orderkey", rnd(ev.harvey_liu_zhu_bar(F.col("o_orderkey")), 6, "bar"), side, rnd(clipped, 2, "clipped"))


@query(
    "F8_tails",
    f"""WITH s AS (SELECT l_suppkey, (avg(l_tax) - 0.04) / stddev_samp(l_tax) * sqrt(count(*)) AS t, count(*) - 1 AS dof FROM lineitem GROUP BY 1 HAVING count(*) > 2 AND stddev_samp(l_tax) > 0)
    SELECT l_suppkey, round({q.t_tail("t", "dof")}, 6) AS p_t, round({q.normal_cdf("t")}, 6) AS phi FROM s""",
)
def f8(spark, sf):
    li = b.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_tax").alias("m"), F.stddev_samp("l_tax").alias("sd"), F.count("*").alias("n"))
    li = li.where("n > 2 AND sd > 0").withColumn("t", (F.col("m") - 0.04) / F.col("sd") * F.sqrt("n"))
    return li.select("l_suppkey", rnd(t_p_value(F.col("t"), F.col("n") - 1), 6, "p_t"), rnd(norm_cdf(F.col("t")), 6, "phi"))


@query(
    "F9_parallel_arrays",
    """SELECT '000' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS cik, CAST(o_orderkey AS VARCHAR) AS "accessionNumber",
      CAST(o_orderdate AS VARCHAR) AS "filingDate", o_orderstatus AS form FROM orders""",
)
def f9(spark, sf):
    """A customer's orders come as one document for each block of order keys, so no document grows without bound."""
    o = b.table(spark, sf, "orders").groupBy("o_custkey", F.expr("o_orderkey div 4096")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("a"), F.col("o_orderdate").cast("string").alias("d"), F.col("o_orderstatus").alias("f")))).alias("z")
    )
    recent = F.struct(F.col("z.f").alias("form"), F.col("z.a").alias("accessionNumber"), F.col("z.d").alias("filingDate"))
    docs = o.select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.struct(recent.alias("recent")).alias("filings"))).alias("json"))
    return fs.explode_filings(docs).select("cik", "accessionNumber", "filingDate", "form")


@query(
    "K8_request_records",
    """SELECT 'https://host/' || event_type AS endpoint, CASE WHEN value > 1 THEN 200 END AS http_status, CAST(floor(value) AS BIGINT) AS response_size_bytes,
      CAST(user_id % 4 AS INTEGER) AS retry_count, CASE WHEN value <= 1 THEN 'timeout' END AS error, count(*) AS n FROM events GROUP BY 1, 2, 3, 4, 5""",
)
def k8(spark, sf):
    """K7-K9: record rows written as JSON lines are read back under the log's schema."""
    from tidemark.operators.reports import REQUEST_LOG_SCHEMA

    e = b.table(spark, sf, "events")
    ok = F.col("value") > 1
    line = F.to_json(
        F.struct(
            F.concat(F.lit("https://host/"), F.col("event_type")).alias("endpoint"), F.when(ok, 200).alias("http_status"),
            F.floor("value").alias("response_size_bytes"), F.col("ts").cast("string").alias("timestamp"), F.lit(0.1).alias("elapsed_seconds"),
            F.pmod("user_id", F.lit(4)).cast("int").alias("retry_count"), F.create_map(F.lit("retry-after"), F.lit("1")).alias("rate_limit_headers"),
            F.when(~ok, "timeout").alias("error"),
        )
    )
    back = e.select(F.from_json(line, REQUEST_LOG_SCHEMA).alias("r")).select("r.*")
    return back.groupBy("endpoint", "http_status", "response_size_bytes", "retry_count", "error").agg(F.count("*").alias("n"))
