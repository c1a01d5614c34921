"""Sliced paths of the ordered primitives must equal the plain ones."""

import math
import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ordered as o
from tidemark.operators.asof import asof_join


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    data = [
        (i, "hot" if i % 3 == 0 else f"k{i % 11}", float(rng.randint(0, 40)), rng.randint(1, 5)) for i in range(3000)
    ]
    return spark.createDataFrame(data, "id long, k string, v double, w long").repartition(7)


def test_ordinal_global_and_keyed(skewed):
    for keys in ([], ["k"]):
        plain = o.ordinal(skewed, ["v", "id"], keys)
        cut = o.ordinal(skewed, ["v", "id"], keys, max_rows=100)
        assert rows(plain, "id") == rows(cut.select(*plain.columns), "id")


def test_running_total(skewed):
    for keys in ([], ["k"]):
        plain = o.running_total(skewed, ["v", "id"], "w", keys)
        cut = o.running_total(skewed, ["v", "id"], "w", keys, max_rows=100)
        assert rows(plain, "id") == rows(cut.select(*plain.columns), "id")


def test_grouped_percentile_of_hot_group(skewed):
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    plain = {r["k"]: r["pct"] for r in o.grouped_percentile(skewed, ["k"], "v", probs).collect()}
    cut = {r["k"]: r["pct"] for r in o.grouped_percentile(skewed, ["k"], "v", probs, max_rows=200).collect()}
    assert plain.keys() == cut.keys()
    for k in plain:
        assert plain[k] == pytest.approx(cut[k])


def test_global_percentile_without_keys(skewed):
    whole = o.grouped_percentile(skewed, [], "v", [0.25, 0.5], max_rows=200).first()["pct"]
    want = skewed.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5)))).first()[0]
    assert whole == pytest.approx(want)


def test_average_rank_with_hot_ties(skewed):
    w = Window.partitionBy("k").orderBy("v")
    want = skewed.withColumn(
        "rank_avg", F.rank().over(w) + (F.count("*").over(Window.partitionBy("k", "v")) - 1) / 2.0
    )
    for limit in (10_000, 20):
        got = o.average_rank(skewed, "v", ["k"], max_rows=limit)
        assert rows(want, "id") == rows(got.select(*want.columns), "id")


def test_order_statistics(skewed):
    ids = sorted((r["v"], r["id"]) for r in skewed.collect())
    for limit in (10_000, 100):
        got = o.order_statistics(skewed, ["v", "id"], [1, 1500, 3000], limit)
        assert got == {1: ids[0], 1500: ids[1499], 3000: ids[2999]}


def test_order_statistics_narrow_their_bands(skewed, monkeypatch):
    """Bands that are narrowed, values that hold most rows, and both ends; no range is sorted on the way."""
    monkeypatch.setattr(o, "ordinal", None)
    for order in (["v", "w", "id"], ["w"]):
        want = sorted(tuple(r) for r in skewed.select(*order).collect())
        places = [1, 2, 3, 700, 1499, 1500, 1501, 2999, 3000]
        for band in (3, 900):
            got = o.order_statistics(skewed, order, [*places, 0, 3001], band_rows=band)
            assert got == {p: want[p - 1] for p in places}, (order, band)


def test_order_statistics_of_missing_values_and_other_types(spark):
    """NULL comes first and NaN last, as in a sort; instants, dates, decimals and text take part."""
    data = [(None if i % 7 == 0 else float("nan") if i % 5 == 0 else float(i % 4), i) for i in range(400)]
    df = spark.createDataFrame(data, "v double, id int").select(
        "*", F.expr("timestamp '2020-03-28 22:00:00' + make_interval(0, 0, 0, 0, id % 50)").alias("t"),
        F.expr("timestamp_ntz '2020-03-28 22:00:00' + make_dt_interval(0, id % 60)").alias("n"), F.expr("date_add(date '2020-01-01', id % 90)").alias("d"),
        F.expr("cast(id % 30 as decimal(10, 2)) / 4").alias("x"), F.expr("concat('s', id % 20)").alias("s"),
    )
    for first in ("v", "t", "n", "d", "x", "s"):
        want = [r["id"] for r in df.orderBy(first, "id").collect()]
        for band in (30,):
            got = o.order_statistics(df, [first, "id"], range(1, 401, 19), max_rows=100, band_rows=band)
            assert {p: r[1] for p, r in got.items()} == {p: want[p - 1] for p in range(1, 401, 19)}, (first, band)
    assert o.order_statistics(df.limit(0), ["v"], [1]) == {}
    same = spark.range(500).select(F.lit(4).alias("v"), F.lit("a").alias("s"))
    assert o.order_statistics(same, ["v"], [1, 500], band_rows=10) == {1: (4,), 500: (4,)}


def test_bucket_of_counts_bounds(skewed):
    bounds = [(3.0, 10), (3.0, 500), (20.0, 0)]
    got = skewed.select("v", "id", o.bucket_of(["v", "id"], bounds).alias("b")).collect()
    assert all(r["b"] == sum(1 for x in bounds if x <= (r["v"], r["id"])) for r in got)


def _asof_brute(left, right, direction, strict, tolerance):
    out = {}
    for i, k, t in left:
        best = None
        for kk, tt, p in right:
            if k is None or t is None or kk != k or tt is None:
                continue
            ok = (tt < t if strict else tt <= t) if direction == "backward" else (tt > t if strict else tt >= t)
            if ok and tolerance is not None and abs(tt - t) > tolerance:
                ok = False
            if not ok:
                continue
            rank = (tt, p) if direction == "backward" else (-tt.timestamp(), -p)
            if best is None or rank > best[0]:
                best = (rank, p)
        out[i] = best[1] if best else None
    return out


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("max_rows", [10_000, 60])
def test_asof_join_against_brute_force(spark, direction, strict, max_rows):
    rng = random.Random(11)
    t0 = datetime(2024, 1, 1)

    def stamp():
        return t0 + timedelta(minutes=rng.randint(0, 400))

    def key():
        return rng.choice(["hot", "hot", "a", "b", None])

    left = [(i, key(), stamp() if rng.random() > 0.05 else None) for i in range(300)]
    right = [(key(), stamp() if rng.random() > 0.05 else None, i) for i in range(200)]
    l = spark.createDataFrame(left, "id int, k string, t timestamp_ntz")
    r = spark.createDataFrame(right, "k string, rt timestamp_ntz, p int")
    for tolerance in (None, timedelta(minutes=7)):
        got = asof_join(
            l, r, ["k"], "t", "rt", ["p"], direction, strict, tie_break=["p"],
            tolerance=None if tolerance is None else F.expr("INTERVAL 7 MINUTES"), max_rows=max_rows,
        )
        found = {x["id"]: x["p"] for x in got.collect()}
        assert found == _asof_brute(left, right, direction, strict, tolerance)


def test_asof_rejects_unknown_direction(spark):
    df = spark.createDataFrame([("a", 1)], "k string, t int")
    with pytest.raises(ValueError):
        asof_join(df, df, ["k"], "t", "t", [], direction="sideways")


def test_percentile_is_linear(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 4, 8)], "v double")
    got = o.grouped_percentile(df, [], "v", [0.5]).first()["pct"][0]
    assert math.isclose(got, 3.0)
