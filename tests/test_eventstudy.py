from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.config import ControlConfig, CostSchedule, EventStudyConfig, UniverseConfig
from tidemark.operators import eventstudy as es
from tidemark.operators import panel as pn
from tidemark.operators.gates import GateFailure, gate, require_columns, run_stage, stage_logs_frame

D, T = date, datetime


def utc(spark, eastern: list[datetime]):
    df = spark.createDataFrame([(i, "AAA", t) for i, t in enumerate(eastern)], "i int, ticker string, e timestamp_ntz")
    return df.withColumn("known_at", es.to_utc(F.col("e")))


@pytest.fixture(scope="module")
def prices(spark):
    return spark.createDataFrame(
        [("AAA", D(2020, 5, 4) + timedelta(days=i), 10.0 + i, 100.0) for i in range(5)],
        "ticker string, date date, close double, volume double",
    )


def test_printed_and_entry_close(spark, prices):
    req = utc(spark, [T(2020, 5, 6, 9, 15), T(2020, 5, 6, 16, 0), T(2020, 5, 6, 16, 31), T(2020, 5, 4, 9, 15)])
    got = rows(es.entry_bar_close(es.last_printed_close(req, prices), prices), "i")
    assert [r["last_close"] for r in got] == [11.0, 12.0, 12.0, None]
    assert [r["entry_close"] for r in got] == [12.0, 13.0, 13.0, 10.0]


def test_price_bound_across_daylight_saving(spark):
    req = utc(spark, [T(2020, 1, 15, 16, 31), T(2020, 7, 15, 16, 31)])
    day, printed = es.price_bound(F.col("known_at"))
    got = rows(req.select("i", day.alias("d"), printed.alias("p")), "i")
    assert [(r["d"], r["p"]) for r in got] == [(D(2020, 1, 15), True), (D(2020, 7, 15), True)]


def test_entry_date(spark):
    days = [D(2022, 10, 24) + timedelta(days=i) for i in range(12)]
    cal = pn.trading_calendar(spark.createDataFrame([(d,) for d in days if d.weekday() < 5], "date date"))
    req = utc(spark, [T(2022, 10, 25, 15), T(2022, 10, 25, 17), T(2022, 10, 29, 10), T(2023, 1, 1), T(2022, 10, 25, 16)])
    got = rows(es.entry_date(req, cal), "i")
    assert [r["entry_date"] for r in got] == [D(2022, 10, 25), D(2022, 10, 26), D(2022, 10, 31), None, D(2022, 10, 25)]


def test_trailing_median_adv(spark):
    start = D(2020, 1, 1)
    bars = [("A", start + timedelta(days=i), 10.0, 100.0) for i in range(20)] + [("A", start + timedelta(days=20), 999.0, 999.0)]
    bars += [("B", start + timedelta(days=i), 10.0, 100.0) for i in range(2)]
    px = spark.createDataFrame(bars, "ticker string, date date, close double, volume double")
    req = spark.createDataFrame(
        [("A", start + timedelta(days=20)), ("B", start + timedelta(days=20)), ("A", start + timedelta(days=25))],
        "ticker string, as_of date",
    )
    got = {(r["ticker"], r["as_of"]): r["adv"] for r in pn.median_adv_as_of(req, px, "as_of").collect()}
    assert got == {("A", D(2020, 1, 21)): 1000.0, ("B", D(2020, 1, 21)): None, ("A", D(2020, 1, 26)): 1000.0}


def test_choose_known_at(spark):
    said = T(2022, 10, 25, 20, 5)
    cases = [(said + timedelta(days=2), said), (said + timedelta(days=5), said), (said + timedelta(days=30), said),
             (said, None), (said - timedelta(hours=1), said), (said + timedelta(days=5, hours=23), said)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, f timestamp_ntz, a timestamp_ntz")
    known, label = es.choose_known_at(F.col("f"), F.col("a"))
    got = rows(df.select("i", known.alias("k"), label.alias("s")), "i")
    assert [r["s"] for r in got] == ["8k_item202", "8k_item202", "10q_fallback", "10q_fallback", "10q_fallback", "8k_item202"]


def test_filed_conventions(spark):
    df = spark.createDataFrame([(20200501,)], "filed int")
    legacy = df.select(es.to_eastern(es.filed_instant(F.col("filed"))).alias("t")).first()["t"]
    end = df.select(es.to_eastern(es.filed_instant(F.col("filed"), "eastern_end_of_day")).alias("t")).first()["t"]
    assert legacy == T(2020, 4, 30, 20) and end == T(2020, 5, 1, 23, 59, 59)
    with pytest.raises(ValueError):
        es.filed_instant(F.col("filed"), "whatever")


def _eps(spark, values):
    data = [("1", D(2019, 3, 31) + timedelta(days=91 * i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "cik string, period_end date, eps_value double")


def test_surprise(spark):
    got = rows(es.standardized_surprise(_eps(spark, [1 + i / 10 for i in range(11)] + [2.8])), "period_end")
    assert got[-1]["sue"] == pytest.approx(4.4447, abs=1e-4) and got[-1]["n_diffs"] == 8
    assert [r["sue_reason"] for r in got[:4]] == ["insufficient_history_for_any_seasonal_diff"] * 4
    assert got[4]["sue_reason"] == "insufficient_seasonal_diffs"
    flat = rows(es.standardized_surprise(_eps(spark, [1.5] * 12)), "period_end")
    assert flat[-1]["sue_reason"] == "zero_or_undefined_volatility" and flat[-1]["sue"] is None


def test_surprise_can_demand_consecutive_quarters(spark):
    df = _eps(spark, [1, 2, 3, 5, 4, 6, 9, 7, 12, 11]).where(F.col("period_end") != F.lit("2019-06-30"))
    got = rows(es.standardized_surprise(df, require_consecutive=True), "period_end")
    assert any(r["sue_reason"] == "quarters_not_consecutive" for r in got) or all(
        r["sue"] is None or r["seasonal_diff"] is not None for r in got
    )


BASE = dict(entity_id="e", ticker="t", date=D(2020, 1, 1), market_cap=500e6, sic_code="35", adv_20d=1e6,
            listing_exchange="Nasdaq", consecutive_quarters_history=8)


@pytest.mark.parametrize(
    "change, config, reason",
    [
        ({}, {}, None), ({"listing_exchange": "OTC"}, {}, "listing_not_allowed"), ({"listing_exchange": None}, {}, "listing_not_allowed"),
        ({"market_cap": 49e6}, {}, "market_cap_below_min"), ({"market_cap": 2.1e9}, {}, "market_cap_above_max"),
        ({"market_cap": 50e6}, {}, None), ({"market_cap": 2e9}, {}, None), ({"market_cap": None}, {}, "market_cap_above_max"),
        ({"market_cap": float("nan")}, {}, "market_cap_above_max"), ({"adv_20d": 1.0}, {}, None),
        ({"adv_20d": 499_999.0}, {"min_adv": 500_000.0}, "adv_below_floor"), ({"adv_20d": None}, {"min_adv": 500_000.0}, None),
        ({"consecutive_quarters_history": 3}, {"min_quarters": 4}, "insufficient_history"),
    ],
)
def test_qualification(spark, change, config, reason):
    schema = "entity_id string, ticker string, date date, market_cap double, sic_code string, adv_20d double, listing_exchange string, consecutive_quarters_history int"
    df = spark.createDataFrame([tuple({**BASE, **change}.values())], schema)
    got = es.build_universe(df, UniverseConfig(50e6, 2e9, **config)).first()
    assert got["disqualification_reason"] == reason and got["qualifies"] == (reason is None)


def test_cost_bands(spark):
    want = {100_000.0: 150, 499_999.0: 150, 500_000.0: 80, 1_999_999.0: 80, 2_000_000.0: 40, 10_000_000.0: 20, 1e12: 20}
    df = spark.createDataFrame([(a, 0.03) for a in want] + [(-1.0, 0.03)], "adv_20d double, control_adjusted_return double")
    got = {r["adv_20d"]: r for r in es.apply_costs(df).collect()}
    assert all(got[a]["cost_bps"] == bps for a, bps in want.items())
    assert got[500_000.0]["net_return"] == pytest.approx(0.022) and got[-1.0]["cost_bps"] is None
    with pytest.raises(ValueError, match="gap or overlap"):
        CostSchedule((("a", 0.0, 1.0, 5.0), ("b", 2.0, 3.0, 5.0)))
    dist = {r["adv_bucket"]: r["n_rows"] for r in es.band_distribution(spark.createDataFrame([(a,) for a in (1e5, 2e5, 1e6, 15e6)], "adv double"), "adv").collect()}
    assert dist["< $500K"] == 2


POOL = "date date, entity_id string, market_cap double, sic_code string, forward_return double, mom string"


def _study(spark):
    d = D(2020, 5, 1)
    universe = spark.createDataFrame([(d, float(c)) for c in (100e6, 300e6, 500e6, 900e6, 1900e6)], "date date, market_cap double")
    pool = spark.createDataFrame(
        [(d, "a", 500e6, "35", 0.02, "low"), (d, "b", 510e6, "35", 0.04, "low"), (d, "c", 500e6, "20", 0.5, "low"),
         (d, "x", 1900e6, "35", 0.9, "low"), (d, "h", 505e6, "35", 0.10, "high")], POOL)
    events = spark.createDataFrame(
        [("e1", "E", d, 500e6, "35", 1e6, "high"), ("e2", "E", d, 500e6, "99", 1e6, "high"), ("e3", "E", D(2020, 6, 1), 5e8, "35", 1e6, "high")],
        "event_id string, entity_id string, date date, market_cap double, sic_code string, adv_20d double, mom string")
    return events, pool, universe


def test_matched_control(spark):
    events, pool, universe = _study(spark)
    got = {r["event_id"]: r for r in es.matched_control(events, pool.where("mom = 'low'"), universe).collect()}
    assert (got["e1"]["control_n"], got["e1"]["thin_control"]) == (2, True)
    assert got["e1"]["control_return"] == pytest.approx(0.03)
    assert (got["e2"]["control_n"], got["e2"]["control_return"], got["e2"]["thin_control"]) == (0, None, True)
    keyed = es.matched_control(events, pool, universe, ControlConfig(extra_key="mom"))
    one = {r["event_id"]: r for r in keyed.collect()}["e1"]
    assert one["control_n"] == 1 and one["control_return"] == pytest.approx(0.10)


def test_event_study_and_gates(spark):
    events, pool, universe = _study(spark)
    returns = spark.createDataFrame([("e1", 0.05), ("e3", 0.02)], "event_id string, raw_return double")
    out = es.run_event_study(events, pool, universe, returns)
    got = {r["event_id"]: r for r in out.collect()}
    assert got["e1"]["net_return"] == pytest.approx(0.05 - (0.02 + 0.04 + 0.10) / 3 - 0.008)
    assert got["e2"]["exclusion"] == "no_forward_return" and got["e3"]["exclusion"] == "no_pool_for_date"
    checks = {c.name: c.passed for c in es.event_study_gates(out)}
    assert checks == {"control_group_computed": True, "thin_control_rate_below_10pct": False, "every_row_has_a_cost_band": True}


def test_quantile_bucket_is_monotone(spark):
    caps = spark.createDataFrame([(D(2020, 1, 1), float(i)) for i in range(1, 101)], "date date, market_cap double")
    edges = es.quantile_edges(caps, ["date"], "market_cap", 5)
    got = rows(caps.join(edges, "date").select("market_cap", es.quantile_bucket(F.col("market_cap"), F.col("edges"), 5).alias("b")))
    ordered = [r["b"] for r in sorted(got, key=lambda r: r["market_cap"])]
    assert ordered == sorted(ordered) and set(ordered) == {1, 2, 3, 4, 5}


def test_event_contract(spark):
    def events(known):
        df = spark.createDataFrame([("E", "T", D(2020, 3, 31), known)], "entity_id string, ticker string, period_end date, known_at timestamp_ntz")
        return es.build_events(df)

    assert events(T(2020, 5, 1)).first()["event_id"] == "h11_E_20200331"
    es.check_known_after_period(events(T(2020, 3, 31, 4, 0, 1)))  # 00:00:01 Eastern
    for known in (T(2020, 3, 30), T(2020, 3, 31, 4, 0, 0)):
        with pytest.raises(Exception, match="known_at_after_period_end"):
            events(known).collect()
        raw = spark.createDataFrame([(D(2020, 3, 31), known)], "period_end date, known_at timestamp_ntz")
        with pytest.raises(GateFailure):
            es.check_known_after_period(raw)


def test_exhausted_calendar_can_stop(spark):
    cal = pn.trading_calendar(spark.createDataFrame([(D(2022, 10, 24),), (D(2022, 10, 25),)], "date date"))
    inside, beyond = utc(spark, [T(2022, 10, 24, 15)]), utc(spark, [T(2022, 10, 26, 15)])
    assert es.entry_date(inside, cal, exhausted="raise").first()["entry_date"] == D(2022, 10, 24)
    with pytest.raises(Exception, match="calendar exhausted"):
        es.entry_date(beyond, cal, exhausted="raise").collect()


def test_gates_and_stage_log(spark, tmp_path):
    assert gate("soft", False, hard=False).passed is False
    with pytest.raises(GateFailure):
        gate("hard", False)
    with pytest.raises(ValueError):
        require_columns(spark.range(1), ["nope"])
    out, log = run_stage("demo", spark.range(10), lambda df: df.where("id > 3"), lambda o: [gate("soft", False, 3, hard=False)])
    assert out.count() == 6
    assert (log.rows_in, log.rows_out, log.all_hard_checks_passed) == (10, 6, True)
    with pytest.raises(GateFailure):
        run_stage("bad", spark.range(3), lambda df: df, lambda o: [gate("hard", o.count() > 5)])
    frame = stage_logs_frame(spark, [log])
    frame.write.json(str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).first()["stage"] == "demo"


def test_event_config_defaults():
    c = EventStudyConfig()
    assert (c.min_market_cap, c.max_market_cap, c.sue_lag, c.sue_window, c.min_seasonal_diffs, c.fallback_days) == (50e6, 2e9, 4, 8, 4, 5)
