from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cv

DAY = timedelta(days=1)
T0 = datetime(2020, 1, 1)


def frame(spark, n, step=DAY, ties=1):
    return spark.createDataFrame([(i, T0 + step * (i // ties)) for i in range(n)], "id int, ts timestamp_ntz").repartition(5)


def blocks(n, k):
    return [list(map(int, b)) for b in np.array_split(np.arange(n), k)]


def brute(ts, test_sets, horizon, embargo):
    """Roles per fold by definition; ``test_sets`` lists the contiguous blocks of each fold."""
    out = set()
    for fold, parts in enumerate(test_sets):
        test = {i for p in parts for i in p}
        for i, t in enumerate(ts):
            if i in test:
                out.add((i, fold, "test"))
                continue
            shut = any(
                (t <= ts[p[-1]] and t + horizon >= ts[p[0]]) or (ts[p[-1]] < t <= ts[p[-1]] + embargo) for p in parts
            )
            if not shut:
                out.add((i, fold, "train"))
    return out


@pytest.mark.parametrize("n, k, h, e, ties, max_rows", [(97, 5, 28, 5, 1, 10**6), (50, 5, 0, 0, 1, 10**6), (60, 4, 3, 2, 7, 10)])
def test_purged_kfold(spark, n, k, h, e, ties, max_rows):
    df = frame(spark, n, ties=ties)
    got = cv.purged_kfold(df, "ts", ["id"], k, h * DAY, e * DAY, max_rows)
    ts = [T0 + DAY * (i // ties) for i in range(n)]
    want = brute(ts, [[b] for b in blocks(n, k)], h * DAY, e * DAY)
    assert {(r["id"], r["fold"], r["role"]) for r in got.collect()} == want


def test_kfold_fixture(spark):
    sizes = {r["fold"]: r["n_test"] for r in cv.fold_sizes(cv.purged_kfold(frame(spark, 97), "ts", ["id"])).collect()}
    assert sizes == {0: 20, 1: 20, 2: 19, 3: 19, 4: 19}
    # a zero label horizon and no embargo lose nothing but rows at the very test instants
    both = cv.fold_sizes(cv.purged_kfold(frame(spark, 50), "ts", ["id"], 5, 0 * DAY, 0 * DAY)).collect()
    assert all(r["n_train"] + r["n_test"] == 50 for r in both)
    with pytest.raises(ValueError):
        cv.purged_kfold(frame(spark, 3), "ts", ["id"], 5)


def test_combinatorial(spark):
    n, g, k = 300, 6, 2
    got = cv.combinatorial_purged(frame(spark, n), "ts", ["id"], g, k, 5 * DAY, 2 * DAY)
    parts = blocks(n, g)
    want = brute([T0 + DAY * i for i in range(n)], [[parts[i] for i in c] for c in combinations(range(g), k)], 5 * DAY, 2 * DAY)
    assert {(r["id"], r["combo"], r["role"]) for r in got.collect()} == want
    assert got.select("combo").distinct().count() == 15


def test_distant_test_blocks_keep_training_rows(spark):
    got = cv.combinatorial_purged(frame(spark, 400), "ts", ["id"], 10, 2)
    sizes = {r["combo"]: r["n_train"] for r in cv.fold_sizes(got, "combo").collect()}
    for i, (a, b) in enumerate(combinations(range(10), 2)):
        if b - a > 1:
            assert sizes[i] > 0.3 * 400


@pytest.mark.parametrize("anchored", [True, False])
def test_walk_forward(spark, anchored):
    df = frame(spark, 500)
    out = cv.walk_forward(df, "ts", 100 * DAY, 20 * DAY, 20 * DAY, anchored)
    per = out.groupBy("fold").agg(
        F.min(F.when(F.col("role") == "train", F.col("ts"))).alias("a"), F.max(F.when(F.col("role") == "train", F.col("ts"))).alias("z"),
        F.min("test_start").alias("s"), F.max("test_end").alias("e"), F.count_if(F.col("role") == "test").alias("n"),
    ).orderBy("fold").collect()
    assert len(per) == 19 and all(r["n"] == 20 for r in per)
    for r in per:
        assert r["z"] < r["s"] - 5 * DAY and (r["a"] == T0 if anchored else r["z"] - r["a"] <= 100 * DAY)
    with pytest.raises(ValueError):
        cv.walk_forward(df, "ts", 1000 * DAY, DAY, DAY)


def test_walk_forward_leaves_out_folds_without_rows(spark):
    df = frame(spark, 60).where((F.col("id") < 30) | (F.col("id") > 45))
    out = cv.walk_forward(df, "ts", 20 * DAY, 5 * DAY, 5 * DAY, True, DAY)
    assert sorted(r[0] for r in out.select("fold").distinct().collect()) == [0, 1, 5, 6]


def test_combinatorial_with_many_groups(spark):
    """More groups than one word of a mask has bits; the last combination tests the last two groups."""
    from datetime import datetime, timedelta

    from tidemark.operators import cv

    day = timedelta(days=1)
    df = spark.createDataFrame([(i, datetime(2020, 1, 1) + day * i) for i in range(70)], "id int, ts timestamp_ntz")
    out = cv.combinatorial_purged(df, "ts", ["id"], 70, 2, timedelta(0), timedelta(0))
    last = 70 * 69 // 2 - 1
    got = {r["id"]: r["role"] for r in out.where(f"combo = {last}").collect()}
    assert [i for i, role in got.items() if role == "test"] == [68, 69] and len(got) == 70
    first = {r["id"] for r in out.where("combo = 0 AND role = 'test'").collect()}
    assert first == {0, 1}
