from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import filings as fl
from tidemark.operators.eventstudy import to_eastern, to_utc

D, T = date, datetime
SUB = "adsh string, cik long, form string, period int, fy int, fp string, filed int"
NUM = "adsh string, tag string, version string, ddate int, qtrs int, uom string, value double, coreg string"
DIL, COMB, BASIC = "EarningsPerShareDiluted", "EarningsPerShareBasicAndDiluted", "EarningsPerShareBasic"
SHARES = "CommonStockSharesOutstanding"


def sub(spark, *rows_):
    return spark.createDataFrame([(a, c, f, p, 2020, "Q1", d) for a, c, f, p, d in rows_], SUB)


def num(spark, *rows_):
    return spark.createDataFrame([(a, t, "us-gaap/2020", d, q, "USD", float(v), g) for a, t, d, q, v, g in rows_], NUM)


def test_eps_prefers_diluted(spark):
    s = sub(spark, ("a", 1, "10-Q", 20200331, 20200501), ("b", 2, "10-Q", 20200331, 20200502))
    n = num(spark, ("a", COMB, 20200331, 1, 1.10, None), ("a", DIL, 20200331, 1, 1.15, None), ("b", COMB, 20200331, 1, 0.5, None),
            ("a", DIL, 20191231, 4, 9.0, None), ("b", "acme_EarningsPerShareDiluted", 20191231, 1, 9.0, None))
    got = rows(fl.extract_eps(s, n), "cik")
    assert [(r["cik"], r["eps_value"], r["tag_used"], r["period_end"]) for r in got] == [
        ("0000000001", 1.15, DIL, D(2020, 3, 31)), ("0000000002", 0.5, COMB, D(2020, 3, 31)),
    ]
    with pytest.raises(ValueError):
        fl.extract_eps(s.drop("filed"), n)


def test_eps_keeps_as_first_filed(spark):
    s = sub(spark, ("late", 1, "10-Q", 20200630, 20200801), ("first", 1, "10-Q", 20200331, 20200501))
    n = num(spark, ("late", DIL, 20200331, 1, 2.0, None), ("first", DIL, 20200331, 1, 1.0, None))
    assert [(r["adsh"], r["eps_value"]) for r in rows(fl.extract_eps(s, n))] == [("first", 1.0)]


def test_bad_dates_become_null(spark):
    s, n = sub(spark, ("a", 1, "10-Q", 20200331, 99999999)), num(spark, ("a", DIL, 20201399, 1, 1.0, None))
    got = fl.extract_eps(s, n).first()
    assert got["period_end"] is None and got["filed"] is None


def test_share_classes_are_summed(spark):
    s = sub(spark, ("a", 1, "10-Q", 20200331, 20200501))
    n = num(spark, ("a", SHARES, 20200331, 0, 7e6, "A"), ("a", SHARES, 20200331, 0, 3e6, "B"), ("a", SHARES, 20200331, 0, 3e6, "B"))
    got = rows(fl.extract_shares(s, n))
    assert [(r["shares_outstanding"], r["is_own_period"]) for r in got] == [(10e6, True)]


def test_comparative_echo_collapses(spark):
    s = sub(spark, ("k", 1, "10-K", 20191231, 20200301), ("q", 1, "10-Q", 20200331, 20200501), ("z", 1, "10-Q", 20200630, 20200801))
    n = num(spark, ("k", SHARES, 20191231, 0, 11_597_000, None), ("q", SHARES, 20191231, 0, 11_597_000, None),
            ("q", SHARES, 20200331, 0, 11_614_000, None), ("z", SHARES, 20181231, 0, 5.0, None), ("q", SHARES, 20181231, 0, 6.0, None))
    got = rows(fl.extract_shares(s, n), "period_end")
    assert [(str(r["period_end"]), r["adsh"], r["is_own_period"]) for r in got] == [
        ("2018-12-31", "q", False), ("2019-12-31", "k", True), ("2020-03-31", "q", True),
    ]


def test_jump_flag(spark):
    df = spark.createDataFrame(
        [("1", D(2020, 1, 31), 7_972_423.0), ("1", D(2020, 4, 30), 7_972_423_000.0), ("1", D(2020, 7, 31), 8_481_665.0),
         ("2", D(2020, 1, 31), 5.0), ("3", D(2020, 1, 31), 0.0), ("3", D(2020, 4, 30), 9.0)],
        "cik string, period_end date, shares_outstanding double")
    got = {(r["cik"], str(r["period_end"])): r["implausible_jump"] for r in fl.flag_jumps(df).collect()}
    assert got[("1", "2020-04-30")] and got[("1", "2020-01-31")] and got[("1", "2020-07-31")]
    assert not got[("2", "2020-01-31")] and not got[("3", "2020-04-30")] and got[("3", "2020-01-31")]


ITEM = "cik string, acceptance_datetime timestamp_ntz"


def item(spark, *eastern):
    df = spark.createDataFrame([("1", t) for t in eastern], "cik string, e timestamp_ntz")
    return df.select("cik", to_utc(F.col("e")).alias("acceptance_datetime"))


def acceptance(spark, *pairs):
    df = spark.createDataFrame([("1", a, t) for a, t in pairs], "cik string, accession_number string, e timestamp_ntz")
    return df.select("cik", "accession_number", to_utc(F.col("e")).alias("acceptance_datetime"))


def test_resolver_takes_first_original(spark):
    s = sub(spark, ("k", 1, "10-K", 20200331, 20200820), ("10q-first", 1, "10-Q", 20200331, 20200508),
            ("b", 2, "10-Q", 20200331, 20200508), ("a", 2, "10-Q", 20200331, 20200508), ("m", 3, "10-Q/A", 20200331, 20200508))
    got = rows(fl.resolve_known_at(s, item(spark)), "cik")
    assert [(r["disclosure_adsh"], r["n_periodic_filings_for_period"], r["event_source"]) for r in got] == [
        ("10q-first", 2, "10q_fallback"), ("a", 2, "10q_fallback"),
    ]
    assert [r["cik"] for r in fl.amendment_only_periods(s).collect()] == ["0000000003"]
    scoped = fl.resolve_known_at(s, item(spark), ciks=spark.createDataFrame([("2",)], "cik string"))
    assert scoped.count() == 1


def test_resolver_uses_acceptance_time(spark):
    s = sub(spark, ("a", 1, "10-Q", 20200331, 20200501))
    said = item(spark, T(2020, 5, 1, 7))
    acc = acceptance(spark, ("a", T(2020, 5, 1, 16, 31)))
    real = fl.resolve_known_at(s, said, acceptance=acc).withColumn("e", to_eastern(F.col("known_at"))).first()
    assert (real["event_source"], real["e"]) == ("8k_item202", T(2020, 5, 1, 7))
    assert real["disclosure_timestamp_source"] == "submissions_acceptance_datetime"
    blind = fl.resolve_known_at(s, said).first()
    assert blind["event_source"] == "10q_fallback"
    assert blind["disclosure_timestamp_source"] == "sub_txt_filed_date:legacy_utc_midnight"


def test_latest_announcement_in_window(spark):
    s = sub(spark, ("a", 1, "10-Q", 20200331, 20200601))
    said = item(spark, T(2020, 5, 20, 8), T(2020, 5, 28, 8))
    acc = acceptance(spark, ("a", T(2020, 6, 1, 17)))
    got = fl.resolve_known_at(s, said, acceptance=acc).withColumn("e", to_eastern(F.col("known_at"))).first()
    assert got["e"] == T(2020, 5, 28, 8)


def test_tags(spark):
    names = {
        "EarningsPerShareDiluted": "diluted_only", "EarningsPerShareBasic": "basic_only", COMB: "combined_basic_and_diluted",
        "Pro_Forma EarningsPerShareBasic": "pro_forma", "EarningsPerShareTemporaryEquity": "spac_redemption_pattern",
        "WeightedAverageEarningsPerShare": "share_count_or_exclusion_not_an_eps_value", "EarningsPerShareX": "other_eps_related",
    }
    df = spark.createDataFrame([(t,) for t in names], "tag string")
    got = {r["tag"]: r["c"] for r in df.select("tag", fl.classify_tag(F.col("tag")).alias("c")).collect()}
    assert got == names
    n = num(spark, *[("a", t, 20200331, 1, 1, None) for t in (DIL, DIL, BASIC, "earningspershareodd", "Revenue")])
    rate = fl.custom_tag_rate(n).first()
    assert (rate["n_eps_like"], rate["n_standard"], rate["n_custom"]) == (4, 2, 2)
    empty = fl.custom_tag_rate(n.where("tag = 'Revenue'")).first()
    assert empty["n_eps_like"] == 0 and empty["custom_rate"] is None
    rates = fl.tag_rates(fl.tag_counts(n)).first()
    assert (rates["rate_by_name"], rates["rate_by_namespace"], rates["agree_within_5pct"]) == (0.5, 0.0, False)
    counts = fl.tag_counts(n)
    assert fl.custom_examples(counts).count() == 2 and fl.top_tags(counts, 1).first()["tag"] == DIL


def test_probe_outcomes(spark):
    quarters = [(f"q{i}", 1, "10-Q", int((D(2018, 3, 31) + timedelta(days=91 * i)).strftime("%Y%m%d")), int((D(2018, 4, 30) + timedelta(days=91 * i)).strftime("%Y%m%d"))) for i in range(8)]
    short = [(f"s{i}", 3, "10-Q", p, f) for i, (_, _, _, p, f) in enumerate(quarters[:2])]
    s = sub(spark, *quarters, *short)
    eps = [1, 2, 4, 3, 6, 5, 9, 8]
    n = num(spark, *[(q[0], DIL, q[3], 1, v, None) for q, v in zip(quarters, eps)], *[(q[0], DIL, q[3], 1, 1, None) for q in short])
    said = item(spark, T(2020, 1, 23, 8))
    known = fl.resolve_known_at(s, said)
    attempts = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "cik string")
    failed = spark.createDataFrame([("4",)], "cik string")
    got = {r["cik"][-1]: r for r in fl.attempt_outcomes(attempts, fl.extract_eps(s, n), known, failed).collect()}
    assert got["1"]["reason"] is None and got["1"]["event_source"] == "8k_item202"
    assert got["2"]["reason"] == "no_eps_records_for_cik"
    assert got["3"]["reason"] == "insufficient_history_for_any_seasonal_diff"
    assert got["4"]["reason"] == "submission_fetch_failed"


def test_period_diagnostics(spark):
    s = sub(spark, ("a", 1, "10-Q", 20200331, 20200501), ("b", 1, "10-K", 20191231, 20200301), ("c", 1, "10-Q", 20150331, 20150501))
    got = {r["adsh"]: r["same_period"] for r in fl.period_diagnostics(s, "1", 20200331).collect()}
    assert got == {"a": True, "b": False}
