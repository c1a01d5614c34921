import hashlib
import math
from datetime import date, timedelta

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions import distributions as ds
from tidemark.operators import bootstrap as bs
from tidemark.operators import clusters as cl
from tidemark.operators import evaluate as ev
from tidemark.operators import panel as pn
from tidemark.operators import reports

D = date


def series(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "r double")


@pytest.mark.parametrize(
    "t, df, p",
    # published two-sided critical values of Student's t
    [(12.706, 1, 0.05), (4.303, 2, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (2.042, 30, 0.05), (1.96, 1e7, 0.05), (0.0, 5, 1.0)],
)
def test_t_tail(t, df, p):
    assert float(ds.t_two_sided(t, df)) == pytest.approx(p, abs=2e-4)


def test_t_tail_missing():
    assert math.isnan(float(ds.t_two_sided(float("nan"), 3))) and math.isnan(float(ds.t_two_sided(1.0, 0)))
    assert float(ds.t_two_sided(float("inf"), 3)) == 0.0


def test_normal_column(spark):
    df = spark.createDataFrame([(0.0,), (1.959963985,), (None,)], "z double")
    got = [r["p"] for r in df.select(ds.norm_cdf(F.col("z")).alias("p")).collect()]
    assert got[0] == 0.5 and got[1] == pytest.approx(0.975, abs=1e-9) and got[2] is None


def test_sharpe(spark):
    assert ev.sharpe_ratio(series(spark, [0.01] * 4), "r").first()["sharpe"] == 0.0
    assert ev.sharpe_ratio(series(spark, [0.01]), "r").first()["sharpe"] == 0.0
    v = [0.01, -0.02, 0.03, float("nan"), 0.0]
    clean = np.array([0.01, -0.02, 0.03, 0.0])
    got = ev.sharpe_ratio(series(spark, v), "r").first()
    assert got["n_obs"] == 4 and got["sharpe"] == pytest.approx(clean.mean() / clean.std(ddof=1) * math.sqrt(252))


def test_deflated_sharpe_falls_with_trials(spark):
    rng = np.random.default_rng(0)
    df = series(spark, rng.normal(0.002, 0.01, 250))
    probs = [ev.deflated_sharpe(df, "r", n).first()["dsr_probability"] for n in (1, 10, 100, 1000)]
    assert probs == sorted(probs, reverse=True) and 0 <= probs[-1] <= probs[0] <= 1
    short = ev.deflated_sharpe(series(spark, [0.1, 0.2]), "r", 5).first()
    assert short["dsr_probability"] == 0.0 and short["skew"] is None and short["n_obs"] == 2


def test_deflated_sharpe_formula(spark):
    r = np.array([0.01, 0.02, -0.01, 0.015, 0.03, -0.02, 0.005])
    sr = r.mean() / r.std(ddof=1)
    z = (r - r.mean()) / r.std()
    var = (1 - (z**3).mean() * sr + ((z**4).mean() - 1) / 4 * sr**2) / 6
    got = ev.deflated_sharpe(series(spark, r), "r", 1).first()
    want = 0.5 * math.erfc(-(sr / math.sqrt(var)) / math.sqrt(2))
    assert got["dsr_probability"] == pytest.approx(want) and got["expected_max_sr"] == 0.0


@pytest.mark.parametrize("values, want", [([1, 2], 0.0), ([-1, -2], 1.0), ([1, -1], 0.5), ([], None)])
def test_overfitting_share(spark, values, want):
    assert ev.overfitting_share(series(spark, values), "r").first()["pbo"] == want


def test_benjamini_hochberg(spark):
    ps = [0.005, 0.011, 0.02, 0.04, 0.13, 0.28, 0.35, 0.5, 0.7, 0.9]
    df = spark.createDataFrame(list(enumerate(ps)), "i int, p double")
    flags = [r["rejected"] for r in rows(ev.benjamini_hochberg(df, "p", fdr=0.05), "i")]
    assert flags == [True] + [False] * 9
    every = spark.createDataFrame([(i, 0.99 * i / 9) for i in range(10)], "i int, p double")
    assert all(r["rejected"] for r in ev.benjamini_hochberg(every, "p", fdr=1.0).collect())
    none = spark.createDataFrame([(0, None), (1, 0.9)], "i int, p double")
    assert not any(r["rejected"] for r in ev.benjamini_hochberg(none, "p").collect())
    cut = [r["rejected"] for r in rows(ev.benjamini_hochberg(df, "p", fdr=0.05, max_rows=3), "i")]
    assert cut == flags


def test_hurdle_and_costs(spark):
    df = spark.createDataFrame([(100,), (400,), (800,)], "n int")
    assert [r["b"] for r in df.select(ev.harvey_liu_zhu_bar(F.col("n")).alias("b")).collect()] == pytest.approx([3.0, 3.0, 3.15])
    got = spark.range(1).select(
        ev.transaction_costs(F.lit(0.01), 20).alias("a"), ev.breakeven_turnover(F.lit(0.001), 20).alias("b"),
        ev.breakeven_turnover(F.lit(0.001), 0).alias("c")).first()
    assert got["a"] == pytest.approx(0.008) and got["b"] == pytest.approx(0.5) and got["c"] == math.inf


def test_ic_and_p(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=50)
    y = 0.4 * x + rng.normal(size=50)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(1.0, None), (float("inf"), 2.0)], "x double, y double")
    got = ev.information_coefficient(df, "x", "y").first()
    r = np.corrcoef(x, y)[0, 1]
    assert got["n"] == 50 and got["ic"] == pytest.approx(r)
    assert got["p"] == pytest.approx(float(ds.t_two_sided(r * math.sqrt(48 / (1 - r * r)), 48)))
    kept = ev.information_coefficient(df, "x", "y", min_n=100, below="one").first()
    assert kept["ic"] is None and kept["p"] == 1.0
    assert ev.information_coefficient(df, "x", "y", min_n=100).count() == 0
    perfect = spark.createDataFrame([(float(i), 2.0 * i) for i in range(5)], "x double, y double")
    assert ev.information_coefficient(perfect, "x", "y").first()["p"] == pytest.approx(0.0, abs=1e-9)


def test_rank_ic_paths_agree(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.integers(0, 9, size=(400, 2))], "x double, y double")
    a = ev.rank_information_coefficient(df, "x", "y").first()["ic"]
    c = ev.rank_information_coefficient(df, "x", "y", max_rows=3).first()["ic"]
    import pandas as pd

    pdf = df.toPandas().rank()
    assert a == pytest.approx(c) and a == pytest.approx(pdf["x"].corr(pdf["y"])) and isinstance(pdf, pd.DataFrame)


def test_t_tests(spark):
    v = np.array([0.1, 0.3, -0.2, 0.4, 0.05])
    got = ev.one_sample_t(series(spark, v), "r").first()
    assert got["t"] == pytest.approx(v.mean() / (v.std(ddof=1) / math.sqrt(5)))
    two = spark.createDataFrame([(float(a), i < 3) for i, a in enumerate(v)], "v double, first boolean")
    w = ev.welch_t(two, "v", F.col("first")).first()
    a, c = v[:3], v[3:]
    q1, q2 = a.var(ddof=1) / 3, c.var(ddof=1) / 2
    assert w["t"] == pytest.approx((a.mean() - c.mean()) / math.sqrt(q1 + q2))
    assert w["dof"] == pytest.approx((q1 + q2) ** 2 / (q1**2 / 2 + q2**2 / 1)) and 0 < w["p"] < 1


def test_long_short_needs_two_legs(spark):
    data = [(1, k, float(k), float(k)) for k in range(6)] + [(2, k, float(k), 1.0) for k in range(5)]
    df = spark.createDataFrame(data, "release int, district int, f double, y double")
    got = rows(ev.long_short(df, "f", "y", ["release"], "district", 3))
    assert [(r["release"], r["long"], r["short"], r["ls"]) for r in got] == [(1, 4.0, 1.0, 3.0)]


def test_block_bootstrap(spark):
    same = [(b, float(x), float(2 * x + (x % 2))) for b in range(6) for x in range(5)]
    df = spark.createDataFrame(same, "b int, x double, y double")
    got = bs.block_bootstrap_ic(df, "b", "x", "y", 200).first()
    assert got["se"] == pytest.approx(0.0, abs=1e-9) and got["p"] == 0.0 and got["n_blocks"] == 6
    assert got["ic"] == pytest.approx(np.corrcoef([r[1] for r in same], [r[2] for r in same])[0, 1])
    rng = np.random.default_rng(4)
    noise = spark.createDataFrame([(int(i // 10), float(a), float(c)) for i, (a, c) in enumerate(rng.normal(size=(400, 2)))], "b int, x double, y double")
    out = bs.block_bootstrap_ic(noise, "b", "x", "y", 500).first()
    assert out["ci_low"] < 0 < out["ci_high"] and out["se_inflation"] > 0
    again = bs.block_bootstrap_ic(noise.repartition(5), "b", "x", "y", 500).first()
    assert again["se"] == pytest.approx(out["se"])


def test_bootstrap_equals_pooled_resample(spark):
    """One draw must equal the correlation of the concatenated blocks."""
    rng = np.random.default_rng(8)
    data = [(int(i // 4), float(a), float(c)) for i, (a, c) in enumerate(rng.normal(size=(40, 2)))]
    sums = bs.block_sums(spark.createDataFrame(data, "b int, x double, y double"), "b", "x", "y")
    k = sums.count()
    picks = [int(hashlib.md5(f"9:{j}".encode()).hexdigest()[:8], 16) % k for j in range(k)]
    got = {r["b"]: r["ic"] for r in bs.bootstrap_draws(sums, 1, 9).collect()}[0]
    xs = [x for s in picks for b, x, _ in data if b == s]
    ys = [y for s in picks for b, _, y in data if b == s]
    assert got == pytest.approx(np.corrcoef(xs, ys)[0, 1])


def test_diversity_weights(spark):
    rng = np.random.default_rng(6)
    y = rng.normal(size=200)
    a, c, d = y + rng.normal(size=200), y + rng.normal(size=200), rng.normal(size=200) - y
    df = spark.createDataFrame([tuple(map(float, t)) for t in zip(a, c, d, y)], "a double, c double, d double, y double")
    got = {r["model"]: r["weight"] for r in ev.diversity_weights(df, ["a", "c", "d"], "y").collect()}
    m = np.corrcoef([a, c, d])
    ic = np.array([np.corrcoef(v, y)[0, 1] for v in (a, c, d)])
    raw = np.clip(ic, 0, None) / np.clip((m.sum(axis=1) - 1) / 2, 0.05, None)
    assert [got[k] for k in "acd"] == pytest.approx(list(raw / raw.sum()))
    flat = {r["model"]: r["weight"] for r in ev.diversity_weights(df, ["d"], "y").collect()}
    assert flat == {"d": 1.0}


def test_weighted_basket(spark):
    d = D(2020, 1, 1)
    df = spark.createDataFrame(
        [(d, "B", 0.28, 0.01), (d, "B", 0.35, 0.02), (d, "B", 0.24, 0.03), (d, "B", 0.13, 0.04), (d, "B", 9.0, None), (d, "E", None, 0.5)],
        "date date, district string, w double, ret double")
    got = {r["district"]: r for r in pn.weighted_basket(df, "district", "w").collect()}
    assert got["B"]["breadth"] == pytest.approx(3.631, abs=1e-3)
    assert got["B"]["basket_ret"] == pytest.approx(0.0028 + 0.007 + 0.0072 + 0.0052)
    assert got["E"]["basket_ret"] is None and got["E"]["breadth"] is None
    equal = {r["district"]: r for r in pn.weighted_basket(df, "district", "w", "equal").collect()}
    assert equal["B"]["basket_ret"] == pytest.approx(0.025)
    subset = {r["district"]: r for r in pn.weighted_basket(df, "district", "w", "subset", 0.28).collect()}
    assert subset["B"]["basket_ret"] == pytest.approx(0.015)


def test_padded_return(spark):
    df = spark.createDataFrame([("A", D(2020, 1, i), v) for i, v in ((1, 1.0), (2, None), (3, 2.0))], "ticker string, date date, close double")
    assert [r["ret"] for r in rows(pn.simple_return(df), "date")] == [None, 0.0, 1.0]
    assert [r["ret"] for r in rows(pn.simple_return(df, pad=False), "date")] == [None, None, None]


def test_forward_excess_counts_rows(spark):
    days = [D(2020, 1, 1) + timedelta(days=i) for i in range(5)]
    df = spark.createDataFrame([(d, "x", r) for d, r in zip(days, (0.5, 0.1, None, 0.2, -0.1))], "date date, g string, ret double")
    bench = spark.createDataFrame([(d, 0.01) for d in days], "date date, bench_ret double")
    got = [r["fwd_2"] for r in rows(pn.forward_excess(df, bench, [2], "g"), "date")]
    assert got[0] == pytest.approx(1.1 - 1.01**2) and got[1] == pytest.approx(1.2 - 1.01**2) and got[3:] == [None, None]


def test_calendar_rolls(spark):
    cal = pn.trading_calendar(spark.createDataFrame([(D(2020, 1, 3),), (D(2020, 1, 6),)], "date date"))
    req = spark.createDataFrame([(D(2019, 12, 1),), (D(2020, 1, 3),), (D(2020, 1, 4),), (D(2020, 1, 6),), (None,)], "d date")
    strict = {r["d"]: r["entry_idx"] for r in pn.next_trading_day(req, "d", cal).collect()}
    assert strict == {D(2019, 12, 1): 1, D(2020, 1, 3): 2, D(2020, 1, 4): 2, D(2020, 1, 6): None, None: None}
    loose = {r["d"]: r["entry_idx"] for r in pn.next_trading_day(req, "d", cal, strict=False).collect()}
    assert loose == {D(2019, 12, 1): 1, D(2020, 1, 3): 1, D(2020, 1, 4): 2, D(2020, 1, 6): 2, None: None}


def test_residualize_matches_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    y = 1 + x @ [0.5, -2.0] + rng.normal(size=60)
    df = spark.createDataFrame([(i % 2, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "g int, a double, b double, y double")
    out = cl.residualize(df, "y", ["a", "b"], ["g"]).toPandas()
    for g, part in out.groupby("g"):
        m = np.column_stack([np.ones(len(part)), part["a"], part["b"]])
        want = part["y"] - m @ np.linalg.lstsq(m, part["y"], rcond=None)[0]
        assert np.allclose(part["residual"], want)
    one = cl.residualize_one(df, "y", "a", ["g"]).toPandas()
    many = cl.residualize(df, "y", ["a"], ["g"]).toPandas()
    assert np.allclose(sorted(one["residual"]), sorted(many["residual"]))


def test_request_summary(spark):
    s = reports.REQUEST_LOG_SCHEMA
    log = [("e", c, 10, "t", 0.5, 0, {}, None) for c in (200, 200, 404, 200)]
    got = reports.request_summary(spark.createDataFrame(log, s)).first()
    assert got["status_distribution"] == {"200": 3, "404": 1} and got["failed_requests"] == 1 and got["total_bytes"] == 40
    late = reports.request_summary(spark.createDataFrame([("e", None, None, "t", 1.0, 2, None, "timeout")], s)).first()
    assert late["status_distribution"] == {"no_response": 1} and late["failed_requests"] == 1
    empty = reports.request_summary(spark.createDataFrame([], s)).first()
    assert empty["total_requests"] == 0 and empty["any_rate_limit_headers"] is False


def test_decision_and_attrition(spark):
    from tidemark.operators.eventstudy import attrition

    m = spark.createDataFrame([(0.1, None)], "ic double, p double")
    got = reports.decide(m, {"sign": F.col("ic") > 0, "sig": F.col("p") < 0.05}).first()
    assert got["sign"] and not got["sig"] and not got["passes"]
    a = {r["reason"]: (r["n_rows"], float(r["pct"])) for r in attrition(spark.createDataFrame([("x",), (None,), (None,)], "r string"), "r").collect()}
    assert a == {"x": (1, 33.33), "qualifies": (2, 66.67)}


def test_clusters(spark):
    days = [D(2020, 1, 1) + timedelta(days=i) for i in range(12)]
    cal = pn.trading_calendar(spark.createDataFrame([(d,) for d in days], "date date"))
    data = [("I", p, "P", 100.0, days[i]) for p, i in (("a", 0), ("a", 1), ("b", 2), ("c", 4), ("d", 5))]
    data += [("J", p, "P", 100.0, days[i]) for p, i in (("a", 0), ("b", 1), ("c", 2))] + [("J", "z", "S", 200.0, days[0])]
    data += [("K", p, "P", 100.0, days[i]) for p, i in (("a", 0), ("b", 4), ("c", 8))]
    t = spark.createDataFrame(data, "issuer string, insider string, code string, value double, known_at date")
    got = rows(cl.insider_clusters(t, cal), "issuer")
    assert [(r["issuer"], r["end_idx"], r["n_buyers"], r["known_at"]) for r in got][:1] == [("I", 5, 3, days[4])]
    assert "K" not in {r["issuer"] for r in got}
    # the sale weighs too much until it leaves the five-session window, by when only two buyers remain
    assert "J" not in {r["issuer"] for r in got}


def _clusters_by_hand(data, size, window, least, share):
    """(issuer, session, buyers, bought, sold, known_at) of the first session of every run, one window after another."""
    found = []
    for issuer in {r[0] for r in data}:
        before = False
        for e in range(1, size + 1):
            own = [r for r in data if r[0] == issuer and e - window < r[4] <= e]
            first = {}
            for _, who, code, _, i in own:
                if code == "P":
                    first[who] = min(first.get(who, i), i)
            bought, sold = (sum(r[3] for r in own if r[2] == c) for c in "PS")
            ok = len(first) >= least and sold <= share * bought
            if ok and not before:
                found.append((issuer, e, len(first), bought, sold, sorted(first.values())[least - 1]))
            before = ok
    return sorted(found)


@pytest.mark.parametrize("window", [1, 2, 5])
def test_insider_clusters_across_blocks(spark, window):
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(70)]
    cal = pn.Calendar(spark, tuple(days))
    rng = np.random.default_rng(window)
    data = [
        (int(rng.integers(3)), int(rng.integers(6)), "PPPS"[rng.integers(4)], float(rng.integers(1, 9)), int(rng.integers(1, 71)))
        for _ in range(420)
    ]
    t = spark.createDataFrame([(*r[:4], days[r[4] - 1]) for r in data], "issuer int, insider int, code string, value double, known_at date")
    got = [
        (r.issuer, r.end_idx, r.n_buyers, r.bought, r.sold, days.index(r.known_at) + 1)
        for r in cl.insider_clusters(t, cal, window, min_insiders=2).collect()
    ]
    assert sorted(got) == _clusters_by_hand(data, 70, window, 2, 0.25) and got


def test_insider_clusters_shuffle_is_bounded(spark):
    """Trades were copied to every session of the window before they were shuffled."""
    cal = pn.Calendar(spark, tuple(date(2020, 1, 1) + timedelta(days=i) for i in range(1000)))
    t = spark.range(20_000).select(
        (F.col("id") % 5000).alias("issuer"), "id", F.col("id").alias("insider"), F.lit("P").alias("code"), F.lit(1.0).alias("value"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7919 % 1000).cast("int")).alias("known_at"),
    )
    sc = spark.sparkContext

    def written():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()) if stages.apply(i).stageId() >= first)

    first = sc._jsc.sc().dagScheduler().nextStageId()
    cl.insider_clusters(t, cal, 10).select("issuer", "end_idx", "n_buyers", "bought", "sold").collect()
    assert 20_000 <= written() <= 2 * 20_000
