"""Stand-ins: the benchmark tables read as the inputs the operators expect.

Every frame is a plain projection or aggregate of the given tables, so each
query's work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.evaluate import clean
from tidemark.operators.panel import (
    attach_forward, change, daily_bars, densify, equal_weight_basket, forward_excess, next_trading_day, simple_return,
    trading_calendar, trailing_zscore,
)
from tidemark.session import durable

HORIZONS = (3, 5, 10)
BASELINE = 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def features(spark: SparkSession, sf: str) -> DataFrame:
    """events as a long feature table."""
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("feature_name"),
        F.col("ts").alias("known_at"), "value", "event_id",
    )


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """events as daily bars per user; the level of 100 keeps daily returns in a plausible range."""
    raw = daily_bars(table(spark, sf, "events"), "user_id", "ts", "value", "event_id")
    return raw.withColumn("ticker", F.col("ticker").cast("string")).withColumn("close", F.col("close") + 100)


def calendar(spark: SparkSession, sf: str):
    """Days on which anything traded."""
    return trading_calendar(table(spark, sf, "events"), "ts")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """purchase events as price requests."""
    return table(spark, sf, "events").where(F.col("event_type") == "purchase").select(
        "event_id", F.col("user_id").cast("string").alias("ticker"), F.col("ts").alias("known_at"),
        F.to_date("ts").alias("as_of"),
    )


def district_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("ticker"), F.col("c_nationkey").alias("district")
    )


def padded_returns(spark: SparkSession, sf: str, cal=None) -> DataFrame:
    return simple_return(densify(bars(spark, sf), cal or calendar(spark, sf)))


def baskets(spark: SparkSession, sf: str, returns: DataFrame | None = None) -> DataFrame:
    joined = (padded_returns(spark, sf) if returns is None else returns).join(district_of(spark, sf), "ticker")
    return equal_weight_basket(joined, "district")


def benchmark_returns(spark: SparkSession, sf: str, returns: DataFrame | None = None) -> DataFrame:
    return (padded_returns(spark, sf) if returns is None else returns).groupBy("date").agg(F.avg("ret").alias("bench_ret"))


def sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """mean event value per district and day."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("ticker"), "ts", "value")
    return e.join(district_of(spark, sf), "ticker").groupBy("district", F.to_date("ts").alias("release_date")).agg(
        F.avg("value").alias("polarity")
    )


def study_panel(spark: SparkSession, sf: str, horizons=HORIZONS) -> DataFrame:
    """One row per release and district: z-score, change, entry date and forward excess returns."""
    cal = calendar(spark, sf)
    s = trailing_zscore(sentiment(spark, sf), "polarity", BASELINE, "district", "release_date", "z8")
    s = change(s, "polarity", "district", "release_date", "chg")
    s = next_trading_day(s, "release_date", cal).where(F.col("entry_date").isNotNull()).drop("entry_idx")
    returns = durable(padded_returns(spark, sf, cal))  # read for baskets and for the benchmark
    fwd = forward_excess(baskets(spark, sf, returns), benchmark_returns(spark, sf, returns), horizons, "district", ret="basket_ret")
    out = attach_forward(s, fwd, "district", horizons)
    for c in ["z8", "chg", *[f"fwd_{h}" for h in horizons]]:
        out = out.withColumn(c, clean(c))
    return out


def staged_panel(spark: SparkSession, sf: str, horizons=HORIZONS) -> DataFrame:
    """study_panel written out once, for evaluations that pass over it several times."""
    return durable(study_panel(spark, sf, horizons))


def long_panel(spark: SparkSession, sf: str, horizons=HORIZONS) -> DataFrame:
    """study_panel unpivoted to one row per feature and horizon."""
    p = staged_panel(spark, sf, horizons)
    p = p.unpivot(["release_date", "entry_date", "district", *[f"fwd_{h}" for h in horizons]], ["z8", "chg"], "feature", "x")
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("y")) for h in horizons])
    return p.withColumn("_p", F.explode(pairs)).select(
        "release_date", "entry_date", "district", "feature", "x", "_p.horizon", "_p.y"
    )


def _prior_quarter_end(day):
    return F.date_sub(F.trunc(day, "quarter"), 1)


def _coded(day):
    return F.date_format(day, "yyyyMMdd").cast("int")


def sub(spark: SparkSession, sf: str) -> DataFrame:
    """orders as filing headers."""
    p = F.col("o_orderpriority")
    form = (
        F.when(p == "1-URGENT", "10-K").when(p == "2-HIGH", "10-Q").when(p == "3-MEDIUM", "10-Q/A")
        .when(p == "4-NOT SPECIFIED", "8-K").otherwise("10-K/A")
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("adsh"), F.col("o_custkey").alias("cik"), form.alias("form"),
        _coded(_prior_quarter_end("o_orderdate")).alias("period"), F.year("o_orderdate").alias("fy"),
        F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("fp"), _coded(F.col("o_orderdate")).alias("filed"),
    )


def _facts(spark: SparkSession, sf: str, tags: dict[str, str], default: str, qtrs) -> DataFrame:
    flag = F.col("l_returnflag")
    tag = F.lit(default)
    for value, name in tags.items():
        tag = F.when(flag == value, name).otherwise(tag)
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("adsh"), tag.alias("tag"),
        F.when(F.col("l_linestatus") == "O", "us-gaap/2022").otherwise("ACME/2022").alias("version"),
        _coded(_prior_quarter_end("l_shipdate")).alias("ddate"), qtrs.alias("qtrs"), F.lit("USD").alias("uom"),
        F.col("l_quantity").alias("value"), F.col("l_suppkey").cast("string").alias("coreg"),
    )


def num(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as EPS facts."""
    qtrs = F.when(F.col("l_linenumber") <= 5, 1).otherwise(4)
    tags = {"A": "EarningsPerShareDiluted", "N": "EarningsPerShareBasicAndDiluted"}
    return _facts(spark, sf, tags, "EarningsPerShareBasic", qtrs)


def num_shares(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as share counts."""
    qtrs = F.when(F.col("l_linenumber") <= 5, 0).otherwise(1)
    tags = {"A": "CommonStockSharesOutstanding", "N": "EntityCommonStockSharesOutstanding"}
    return _facts(spark, sf, tags, "SharesIssued", qtrs)


def item202(spark: SparkSession, sf: str) -> DataFrame:
    """8-K orders as announcements, spread over the hours of their day."""
    o = table(spark, sf, "orders").where(F.col("o_orderpriority") == "4-NOT SPECIFIED")
    return o.select(
        F.col("o_custkey").alias("cik"), F.col("o_orderkey").alias("accession_number"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=F.pmod(F.col("o_orderkey"), F.lit(24)).cast("int"))).alias(
            "acceptance_datetime"
        ),
    )


def deposits(spark: SparkSession, sf: str) -> DataFrame:
    """shipped value by supplier, year and customer nation as branch deposits."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_suppkey").alias("ticker"), F.year("l_shipdate").alias("year"),
        F.col("l_extendedprice").alias("deposits"), F.col("l_partkey").alias("cert"),
    )
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("state"))
    return li.join(o, "l_orderkey").join(c, "o_custkey").select("ticker", "year", "state", "deposits", "cert")


def headquarters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ticker"), F.col("s_nationkey").alias("hq_state"))


def ticker_history(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as validity intervals: a customer key is the ticker, each order a CIK for 90 days or open-ended."""
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("cik"), F.col("o_custkey").cast("string").alias("ticker"),
        day.alias("valid_from"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.date_add(day, 90)).otherwise(F.date_add(day, 400)).alias("valid_to"),
        F.concat(F.lit("Order "), F.col("o_orderkey")).alias("company_name"),
    )


def universe_rows(spark: SparkSession, sf: str) -> DataFrame:
    """customers as universe candidates."""
    seg = F.col("c_mktsegment")
    listing = F.when(seg == "BUILDING", "OTC").when(seg == "MACHINERY", "NYSE").otherwise("Nasdaq")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("entity_id"), F.col("c_name").alias("ticker"),
        F.lit("2024-01-01").cast("date").alias("date"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("market_cap"), seg.alias("sic_code"),
        (F.abs(F.col("c_acctbal")) * 1000).alias("adv_20d"), listing.alias("listing_exchange"),
        F.pmod(F.col("c_nationkey"), F.lit(13)).alias("consecutive_quarters_history"),
    )


def study_events(spark: SparkSession, sf: str) -> DataFrame:
    """Urgent and high-priority orders as events: size = order price, sector = segment, month as date."""
    o = table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return _sized_orders(spark, sf, o).select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("entity_id"), "date", "market_cap", "sic_code",
        (F.col("market_cap") * 30).alias("adv_20d"),
    )


def control_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Other orders as candidates; their forward return is a stand-in computed from the price."""
    o = table(spark, sf, "orders").where(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return _sized_orders(spark, sf, o).select("date", "market_cap", "sic_code", "forward_return")


def whole_universe(spark: SparkSession, sf: str) -> DataFrame:
    return _sized_orders(spark, sf, table(spark, sf, "orders")).select("date", "market_cap")


def _sized_orders(spark: SparkSession, sf: str, o: DataFrame) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("sic_code"))
    return (
        o.join(c, "o_custkey")
        .withColumn("date", F.trunc(F.to_date("o_orderdate"), "month"))
        .withColumn("market_cap", F.col("o_totalprice"))
        .withColumn("forward_return", F.pmod(F.col("o_totalprice"), F.lit(97.0)) / 970 - 0.05)
    )


def event_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Raw returns exist for fulfilled and open orders only."""
    o = table(spark, sf, "orders").where(F.col("o_orderstatus") != "P")
    return o.select(F.col("o_orderkey").alias("event_id"), (F.pmod(F.col("o_totalprice"), F.lit(89.0)) / 890 - 0.04).alias("raw_return"))


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as insider trades: the part is the issuer, the supplier the insider."""
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("issuer"), F.col("l_suppkey").alias("insider"),
        F.when(F.col("l_returnflag") == "R", "S").otherwise("P").alias("code"),
        F.col("l_extendedprice").alias("value"), F.col("l_shipdate").alias("known_at"),
    )
