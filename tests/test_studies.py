from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.gates import GateFailure
from tidemark.plans import studies as st

DAY = timedelta(days=1)


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(0)
    days = [date(2020, 1, 1) + DAY * i for i in range(160)]
    px = []
    for t in ["KRE", *(f"T{i}" for i in range(12))]:
        level = 100 * np.cumprod(1 + rng.normal(0, 0.01, len(days)))
        px += [(t, d, float(v)) for d, v in zip(days, level)]
    prices = spark.createDataFrame(px, "ticker string, date date, close double")
    districts = spark.createDataFrame([(f"T{i}", f"D{i // 2}") for i in range(12)], "ticker string, district string")
    sent = [(days[4 * k], f"D{g}", float(rng.normal())) for k in range(35) for g in range(6)]
    return prices, districts, spark.createDataFrame(sent, "release_date date, district string, polarity double")


CONFIG = st.SentimentConfig(horizons=(3, 5), primary=5, legs=2, min_pooled=20, min_district=10)


def test_sentiment_study(spark, market):
    prices, districts, sent = market
    panel = st.sentiment_panel(sent, prices, districts, "KRE", CONFIG)
    out = st.sentiment_study(panel, CONFIG)
    assert out["pooled"].count() == 4 and out["districts"].count() == 6
    assert out["strategy"].where("abs(ls - net - 0.002) > 1e-12").count() == 0
    probs = [r["dsr_probability"] for r in out["sharpes"].collect()]
    assert probs[1] <= probs[0]
    v = out["verdict"].first()
    assert v["passes"] == (v["pooled_survives"] and v["folds_agree"] and v["net_positive"])
    stress = st.stress_test(panel, "chg", 5, 300)
    assert stress["bootstrap"].first()["n_obs"] == stress["naive"].first()["n"] == sum(r["n"] for r in stress["alternate"].collect())
    with pytest.raises(GateFailure):
        st.sentiment_panel(sent, prices, districts, "SPY", CONFIG)


def test_weighted_panel(spark, market):
    prices, districts, sent = market
    weights = districts.select("ticker", F.lit(2019).alias("year"), F.lit(0.5).alias("weight"))
    plain = st.sentiment_panel(sent, prices, districts, "KRE", CONFIG)
    same = st.sentiment_panel(sent, prices, districts, "KRE", CONFIG, weights)
    key = ["release_date", "district"]
    gap = plain.select(*key, F.col("fwd_5").alias("a")).join(same.select(*key, F.col("fwd_5").alias("b")), key)
    # equal weights in every vintage reproduce the equal-weight basket until the next vintage starts
    assert gap.where("abs(a - b) > 1e-9").count() == 0 and gap.where("b is not null").count() > 100


def test_holdings_study(spark, market):
    prices = market[0]
    rng = np.random.default_rng(1)
    rows = [(m, date(2020, 1, 5) + DAY * 20 * q, date(2019, 12, 31), f"c{i}", "n", float(rng.integers(1, 99)))
            for m in ("A", "B") for q in range(5) for i in range(12) for _ in range(2)]
    held = spark.createDataFrame(rows, "manager string, filing_date date, period_of_report date, cusip string, name_of_issuer string, value_thousands double")
    cmap = spark.createDataFrame([(f"c{i}", f"T{i}" if i else "GONE", "active" if i != 1 else "dead") for i in range(12)], "cusip string, ticker string, status string")
    out = st.holdings_study(held, cmap, prices, 12, (5, 10))
    assert out["summary"].count() == 4 and [r["ticker"] for r in out["unpriced"].collect()] == ["GONE"]
    px = prices.toPandas().pivot(index="date", columns="ticker", values="close")
    entry = list(px.index).index(date(2020, 1, 6))
    want = np.mean([px[f"T{i}"].iloc[entry + 5] / px[f"T{i}"].iloc[entry] - 1 for i in range(2, 12)])
    got = out["portfolio"].where("manager = 'A' and horizon = 5").orderBy("filing_date").first()["ret"]
    assert got == pytest.approx(want)
    assert st.head_to_head(out["portfolio"], "A", "B").count() == 2
    bench = prices.where("ticker = 'KRE'").select("date", "close")
    excess = st.holdings_study(held, cmap, prices, 12, (5,), bench)
    assert excess["net"].where("net_mean < mean").count() == 2


def test_rate_study(spark):
    rng = np.random.default_rng(2)
    days = [date(2020, 1, 1) + DAY * i for i in range(150)]
    rows = [(s, d, float(v)) for s in ("R", "X", "Y") for d, v in zip(days, 5 + np.cumsum(rng.normal(0, 0.05, 150))) if rng.random() > 0.05]
    series = spark.createDataFrame(rows, "series_id string, date date, value double")
    out = st.rate_study(series, "R", ["X", "Y"], (5, 10), change=20, min_n=50)
    assert out["ics"].count() == 8 and out["corrected"].count() == 8 and out["scan"].first()["n_tests"] == 8
    back = st.carry_backtest(out["grid"], "X", "rate_level", 5, 8)
    assert back["fold_ics"].count() >= 1 and back["sharpes"].count() == 4
