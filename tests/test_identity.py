from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import identity as idn
from tidemark.operators.gates import GateFailure

D = date
HIST = "cik string, ticker string, valid_from date, valid_to date, company_name string"


@pytest.fixture(scope="module")
def history(spark):
    return spark.createDataFrame(
        [("320193", "AAPL", D(1980, 12, 12), None, "Apple"), ("1111111", "OLDT", D(2010, 1, 1), D(2015, 6, 30), "Old"),
         ("1111111", "NEWT", D(2015, 7, 1), None, "New"), ("12345", "BRKL", D(2000, 1, 1), D(2020, 12, 31), "B1"),
         ("9999999", "BRKL", D(2020, 6, 1), None, "B2")], HIST)


def test_resolve_cik(spark, history):
    p = spark.createDataFrame(
        [("AAPL", D(2020, 1, 1)), ("OLDT", D(2015, 6, 30)), ("OLDT", D(2015, 7, 1)), ("BRKL", D(2020, 7, 1)), ("BRKL", D(2010, 1, 1)), ("ZZ", D(2010, 1, 1))],
        "ticker string, as_of date")
    got = {(r["ticker"], str(r["as_of"])): (r["status"], r["cik"]) for r in idn.resolve_cik(p, history).collect()}
    assert got == {
        ("AAPL", "2020-01-01"): ("ok", "0000320193"), ("OLDT", "2015-06-30"): ("ok", "0001111111"), ("OLDT", "2015-07-01"): ("none", None),
        ("BRKL", "2020-07-01"): ("ambiguous", None), ("BRKL", "2010-01-01"): ("ok", "0000012345"), ("ZZ", "2010-01-01"): ("none", None),
    }
    with pytest.raises(GateFailure):
        idn.require_resolved(idn.resolve_cik(p, history))


def test_resolve_ticker_and_name(spark, history):
    p = spark.createDataFrame([("1111111", D(2015, 6, 30)), ("1111111", D(2016, 1, 1)), ("1111111", D(2000, 1, 1))], "cik string, as_of date")
    got = [r["ticker"] for r in rows(idn.resolve_for_cik(p, history, "ticker"), "as_of")]
    assert got == [None, "OLDT", "NEWT"]
    assert [r["company_name"] for r in rows(idn.resolve_for_cik(p, history, "company_name"), "as_of")] == [None, "Old", "New"]


def test_conflicts(history):
    got = rows(idn.find_conflicts(history))
    assert [(r["ticker"], str(r["overlap_start"]), str(r["overlap_end"])) for r in got] == [("BRKL", "2020-06-01", "2020-12-31")]


def test_holding_company_years(spark):
    own = spark.createDataFrame([("t", 2009, ""), ("t", 2010, "X"), ("t", 2010, "X"), ("t", 2010, "A"), ("u", 2010, "B"), ("u", 2010, "A")], "ticker string, year int, hc string")
    seeds = spark.createDataFrame([("t", 1, "S"), ("u", 2, "S"), ("v", 3, "S")], "ticker string, cert int, seed string")
    got = {(r["ticker"], r["year"]): r["hc"] for r in idn.holding_company_by_year(own, seeds, 2009, 2011).collect()}
    assert [got["t", y] for y in (2009, 2010, 2011)] == ["", "X", "X"]
    assert [got["u", y] for y in (2009, 2010, 2011)] == ["A", "A", "A"]
    assert got["v", 2010] == "S"


def test_locality_and_summary(spark):
    dep = spark.createDataFrame(
        [("t", 2010, "PA", 60.0, 1), ("t", 2010, "NJ", 30.0, 2), ("t", 2010, "DE", 0.0, 2), ("t", 2010, "PA", 10.0, 1), ("z", 2010, "PA", 0.0, 9)],
        "ticker string, year int, state string, deposits double, cert int")
    hq = spark.createDataFrame([("t", "PA"), ("z", "PA")], "ticker string, hq_state string")
    table = idn.locality(dep, hq)
    got = table.first()
    assert table.count() == 1 and got["locality"] == pytest.approx(0.7)
    assert (got["n_states"], got["n_branches"], got["n_certs"], got["top_state"]) == (2, 4, 2, "PA")
    summary = idn.locality_summary(table, 1)
    expected = hq.select("ticker")
    with pytest.raises(GateFailure, match="all_banks_present"):
        idn.locality_gates(summary, expected)
    assert len(idn.locality_gates(summary, expected.where("ticker = 't'"))) == 4


def test_footprint_falls_back_to_charter(spark):
    branches = spark.createDataFrame(
        [(1, "H", 2010, "PA", 5.0), (2, "H", 2010, "NJ", 6.0), (2, "H", 2010, "NJ", 6.0), (1, "", 2011, "PA", 7.0), (1, "Q", 2012, "PA", 8.0)],
        "cert int, hc string, year int, state string, deposits double")
    hc = spark.createDataFrame([("t", 1, 2010, "H"), ("t", 1, 2011, ""), ("t", 1, 2012, "GONE")], "ticker string, cert int, year int, hc string")
    got = sorted((r["year"], r["branch_cert"], r["deposits"]) for r in idn.footprint(branches, hc).collect())
    assert got == [(2010, 1, 5.0), (2010, 2, 6.0), (2011, 1, 7.0), (2012, 1, 8.0)]


def test_name_matching(spark):
    wanted = spark.createDataFrame([("TFC", "Truist Bank", "NC"), ("KEY", "KeyBank National Association", "OH"), ("NO", "zzzzzz", "OH")], "key string, name string, state string")
    known = spark.createDataFrame(
        [(1, "Bank of America, National Association", "NC"), (2, "Truist Bank", "NC"), (3, "Truist Bank of Georgia", "GA"), (4, "KEYBANK", "NY"), (5, "Truist Bank South", "NC")],
        "cert int, name string, state string")
    got = {r["key"]: r for r in idn.match_names(wanted, known).collect()}
    assert (got["TFC"]["cert"], got["TFC"]["similarity"], got["TFC"]["status"]) == (2, 1.0, "ok")
    assert (got["KEY"]["cert"], got["KEY"]["status"]) == (4, "state_mismatch")
    assert got["NO"]["status"] == "not_found"
    # a name with a match at home is compared within its state only, runners-up included
    assert got["TFC"]["runners_up"] == "Truist Bank South(NC)"


def test_name_matching_finds_every_pair(spark):
    """The prefix filter must not lose pairs: compare with all pairs on a small fixture."""
    import itertools
    import random

    rng = random.Random(5)
    words = ["first", "bank", "trust", "savings", "of", "north", "river", "city"]
    names = sorted({" ".join(rng.sample(words, 3)) for _ in range(60)})
    left, right = names[::2], names[1::2]
    got = idn.match_names(
        spark.createDataFrame([(n, n, "A") for n in left], "key string, name string, state string"),
        spark.createDataFrame([(n, n, "B") for n in right], "cert string, name string, state string"), 0.6, 0)
    grams = lambda s: {f"  {s} "[i : i + 3] for i in range(len(s) + 1)}
    best = {}
    for a, c in itertools.product(left, right):
        d = 2 * len(grams(a) & grams(c)) / (len(grams(a)) + len(grams(c)))
        if d >= 0.6 and (a not in best or (-round(d, 3), c) < best[a]):
            best[a] = (-round(d, 3), c)
    assert {r["key"]: r["cert"] for r in got.collect()} == {a: best.get(a, (0, None))[1] for a in left}


def test_renames_and_waterfall(spark):
    rows_ = spark.createDataFrame([("FLG_SUCCESSOR_OF_NYCB", 1), ("BRKL", 2), ("KRE", 3)], "ticker string, v int")
    got = sorted(r["ticker"] for r in idn.apply_renames(rows_, {"FLG_SUCCESSOR_OF_NYCB": "NYCB"}, ["BRKL"]).collect())
    assert got == ["KRE", "NYCB"]
    px = "ticker string, date date, close double"
    wanted = spark.createDataFrame([("A", None), ("B", "C"), ("D", "E")], "ticker string, successor string")
    series, report = idn.source_waterfall(
        wanted, spark.createDataFrame([("A", D(2020, 1, 1), 1.0)], px), spark.createDataFrame([("C", D(2020, 1, 2), 2.0)], px))
    assert {r["ticker"]: r["status"] for r in report.collect()} == {"A": "recovered", "B": "successor_only", "D": "not_recovered"}
    assert sorted(r["ticker"] for r in series.collect()) == ["A", "C_SUCCESSOR_OF_B"]


def test_assignment_compare(spark):
    hand = spark.createDataFrame([("a", "Boston"), ("b", "Dallas"), ("c", "Atlanta")], "ticker string, district string")
    official = spark.createDataFrame([("a", "Boston"), ("b", "Boston")], "ticker string, district string")
    out = idn.compare_assignment(hand, official, "ticker", "district")
    assert {r["ticker"]: r["changed"] for r in out.collect()} == {"a": False, "b": True, "c": None}
    assert sorted(r["district"] for r in idn.emptied_groups(out, "district").collect()) == ["Atlanta", "Dallas"]


def test_a_probe_far_ahead_costs_nothing(spark):
    """An open interval is copied to the months that were asked for only."""
    from tidemark.operators import identity

    history = spark.createDataFrame([("1", "T", "1990-01-01", None, "One")], "cik string, ticker string, valid_from string, valid_to string, company_name string")
    probes = spark.createDataFrame([("T", "2020-05-05"), ("T", "9999-12-31")], "ticker string, as_of string")
    got = {str(r["as_of"]): r["status"] for r in identity.resolve_cik(probes, history).collect()}
    assert got == {"2020-05-05": "ok", "9999-12-31": "ok"}


def test_sweep_equals_looking_at_every_interval(spark):
    """Random intervals: nested, touching, repeated, reversed, open, without a ticker; probes repeated and missing."""
    import random
    from datetime import timedelta

    rng, first = random.Random(11), D(2020, 1, 1)
    spans = []
    for i in range(300):
        start = first + timedelta(days=rng.randint(0, 200))
        end = rng.choice([None, start, start + timedelta(days=rng.randint(0, 15)), start - timedelta(days=1), D(9999, 12, 31)] if i % 40 == 0 else [start, start + timedelta(days=rng.randint(0, 6))])
        spans.append((f"c{rng.randint(0, 9)}" if i % 3 else str(i), rng.choice(["T", "U", "V", None]), start, end, "n"))
    spans += spans[:5] + [("x", "W", None, None, "n"), (None, "Y", first, None, "n")]
    asked = [(rng.choice(["T", "U", "V", "W", "Y", "Z", None]), rng.choice([None, D(9999, 12, 31), *[first + timedelta(days=rng.randint(-3, 230)) for _ in range(8)]])) for _ in range(500)]
    got = idn.resolve_cik(spark.createDataFrame(asked, "ticker string, as_of date"), spark.createDataFrame(spans, HIST))

    def expect(ticker, day):
        hits = [c for c, t, a, z, _ in spans if ticker and day and t == ticker and a and a <= day <= (z or D(9999, 12, 31))]
        cik = hits[0].rjust(10, "0") if len(hits) == 1 and hits[0] else None
        return ticker, day, len(hits), ["none", "ok", "ambiguous"][min(len(hits), 2)], cik

    key = lambda r: tuple(map(str, r))
    assert sorted([(r["ticker"], r["as_of"], r["n_matches"], r["status"], r["cik"]) for r in got.collect()], key=key) == sorted([expect(*a) for a in asked], key=key)


def test_a_calendar_with_a_stray_day_is_refused(spark):
    import pytest

    from tidemark.operators.panel import trading_calendar

    with pytest.raises(ValueError, match="spans more than"):
        trading_calendar(spark.createDataFrame([("1900-01-01",), ("9999-12-31",)], "date string"))
