import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tidemark.operators import cv
from tidemark.operators import models as md

DAY = timedelta(days=1)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 2))
    y = 0.7 * x[:, 0] - 0.2 * x[:, 1] + 0.3 * rng.normal(size=120)
    rows = [(i, datetime(2020, 1, 1) + DAY * i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, ts timestamp_ntz, a double, b double, y double")


def test_ridge_by_fold(data):
    folds = cv.purged_kfold(data, "ts", ["id"], 4, 2 * DAY, DAY)
    pdf = folds.toPandas()
    for r in md.ridge_by_fold(folds, ["a", "b"], "y", 3.0).collect():
        part = pdf[(pdf.fold == r["fold"]) & (pdf.role == "train")]
        x, y = part[["a", "b"]].to_numpy(), part["y"].to_numpy()
        xc, yc = x - x.mean(axis=0), y - y.mean()
        beta = np.linalg.solve(xc.T @ xc + 3.0 * np.eye(2), xc.T @ yc)
        assert np.allclose(r["beta"], beta) and r["n_train"] == len(part)
        assert r["intercept"] == pytest.approx(y.mean() - beta @ x.mean(axis=0))
    ics = [r["ic"] for r in md.out_of_sample_ic(folds, ["a", "b"], "y").collect()]
    assert len(ics) == 4 and min(ics) > 0.6


def test_path_sharpes(data):
    folds = cv.combinatorial_purged(data, "ts", ["id"], 5, 2, 2 * DAY, DAY)
    got = md.path_sharpes(folds, ["a"], "y").collect()
    assert len(got) == 10 and all(r["sharpe"] > 0 for r in got)


def test_stacking(data):
    x = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(data)
    folds = cv.purged_kfold(x, "ts", ["id"], 3, DAY, DAY)
    learners = {"one": LinearRegression(regParam=0.01), "two": LinearRegression(regParam=5.0)}
    model, oof = md.fit_stack(folds, ["id"], "y", learners)
    assert oof.count() == 120 and {len(m) for m in model.fold_models.values()} == {3}
    pred = model.predict(x).toPandas()
    assert np.corrcoef(pred["prediction"], pred["y"])[0, 1] > 0.8
    with pytest.raises(ValueError):
        md.fit_stack(folds, ["id"], "y", learners, task="ranking")


def test_stacking_classification(data):
    labelled = data.withColumn("up", (F.col("y") > 0).cast("double"))
    x = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(labelled)
    folds = cv.purged_kfold(x, "ts", ["id"], 3, DAY, DAY)
    model, oof = md.fit_stack(folds, ["id"], "up", {"lr": LogisticRegression(regParam=0.1)}, "classification")
    assert oof.where("lr between 0 and 1").count() == 120
    assert model.predict(x).where("prediction = up").count() > 80


def test_meta_labels(data):
    df = data.withColumn("call", F.when(F.col("id") % 10 == 0, 0).otherwise(F.signum("a")))
    model = md.fit_meta_label(df, ["a", "b"], "call", "y")
    out = md.size_positions(df, model, ["a", "b"], "call", 0.55).toPandas()
    held = out[out.confidence >= 0.55]
    assert np.allclose(held.position, held.call * held.confidence)
    assert (out[out.confidence < 0.55].position == 0).all() and (out[out.call == 0].position == 0).all()


def test_regimes_on_a_panel(spark):
    rng = np.random.default_rng(1)
    rows, truth = [], {}
    for e in range(6):
        state = 0
        for t in range(80):
            state = 1 - state if rng.random() < 0.05 else state
            rows.append((f"e{e}", date(2020, 1, 1) + DAY * t, float(rng.normal(4.0 * state, 0.5 + state))))
            truth[f"e{e}", rows[-1][1]] = state
    df = spark.createDataFrame(rows, "k string, d date, x double")
    params = md.fit_regimes(df, "k", "d", ["x"], 2, 12)
    assert params.means[:, 0] == pytest.approx([0.0, 4.0], abs=0.4)
    assert np.allclose(params.trans.sum(axis=1), 1) and params.start.sum() == pytest.approx(1)
    got = md.predict_regimes(df, "k", "d", ["x"], params).collect()
    assert np.mean([truth[r["k"], r["d"]] == r["regime"] for r in got]) > 0.95
    assert md.regime_means(params, ["x"])[1]["x"] > 3


def test_likelihood_rises(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([("a", date(2020, 1, 1) + DAY * i, float(v)) for i, v in enumerate(np.r_[rng.normal(0, 1, 60), rng.normal(3, 1, 60)])], "k string, d date, x double")
    likes = [md.fit_regimes(df, "k", "d", ["x"], 2, n).log_likelihood for n in (1, 4, 8)]
    assert likes == sorted(likes)


def _bocpd_full(x, lam=250.0):
    """The recursion with every run length kept, written out for one series."""
    w, mu, ka, al, be = np.ones(1), np.zeros(1), np.ones(1), np.ones(1), np.ones(1)
    out = []
    for v in x:
        df, s2 = 2 * al, be * (ka + 1) / (al * ka)
        pdf = np.array([math.gamma((d + 1) / 2) / math.gamma(d / 2) if d < 300 else (d / 2) ** 0.5 for d in df]) / np.sqrt(df * math.pi * s2) * (1 + (v - mu) ** 2 / (df * s2)) ** (-(df + 1) / 2)
        w = np.r_[(w * pdf).sum() / lam, w * pdf * (1 - 1 / lam)]
        w = w / w.sum()
        out.append(int(w.argmax()))
        be = np.r_[1.0, be + ka * (v - mu) ** 2 / (2 * (ka + 1))]
        mu, ka, al = np.r_[0.0, (ka * mu + v) / (ka + 1)], np.r_[1.0, ka + 1], np.r_[1.0, al + 0.5]
    return out


def test_changepoint_fixture(spark):
    x = [0.0] * 100 + [10.0] * 100
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "k string, t int, x double")
    got = [r["run_length"] for r in sorted(md.run_lengths(df, "k", "t", "x").collect(), key=lambda r: r["t"])]
    assert got[99] == 100 and got[100] == 1


def test_changepoints_match_full_recursion(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(0, 1, 60), rng.normal(6, 1, 60)]
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", 0, None)], "k string, t int, x double")
    got = [r["run_length"] for r in sorted(md.run_lengths(df, "k", "t", "x").collect(), key=lambda r: r["t"])]
    assert got == _bocpd_full(x)


def test_run_lengths_have_no_cap_and_series_do_not_mix(spark):
    rng = np.random.default_rng(9)
    long = rng.normal(size=1600)
    short = np.r_[rng.normal(0, 1, 30), rng.normal(8, 1, 20)]
    rows = [("long", i, float(v)) for i, v in enumerate(long)] + [("short", i, float(v)) for i, v in enumerate(short)]
    got = md.run_lengths(spark.createDataFrame(rows, "k string, t int, x double"), "k", "t", "x").toPandas().sort_values("t")
    assert got[got.k == "long"].run_length.iloc[-1] == 1600
    assert got[got.k == "short"].run_length.tolist() == _bocpd_full(short)


def test_penalty_is_chosen_by_leaving_one_out(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 2)) + 50.0
    y = x[:, 0] + rng.normal(size=30)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    for r in md.leave_one_out_errors(df, ["a", "b"], "y", [0.01, 1.0, 100.0]).collect():
        errors = []
        for k in range(30):
            keep = np.arange(30) != k
            # the row left out still counts in the centre, as in the closed form
            xc, yc = x - x.mean(axis=0), y - y.mean()
            aug, lab = np.c_[np.ones(30), xc], yc
            pen = np.diag([0.0, r["alpha"], r["alpha"]])
            beta = np.linalg.solve(aug[keep].T @ aug[keep] + pen, aug[keep].T @ lab[keep])
            errors.append((lab[k] - aug[k] @ beta) ** 2)
        assert r["error"] == pytest.approx(np.mean(errors))
    assert md.best_ridge(df, ["a", "b"], "y").getRegParam() > 0


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.changepoint import stream_run_lengths

    rng = np.random.default_rng(7)
    rows = [(k, i, float(rng.normal(0 if i < 20 else 5))) for k in ("a", "b", "c") for i in range(40)]
    schema = "k string, t int, x double"
    for part in range(4):
        chunk = [r for r in rows if r[1] // 10 == part]
        spark.createDataFrame(chunk, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    batch = {(r["k"], r["t"]): r["run_length"] for r in md.run_lengths(spark.createDataFrame(rows, schema), "k", "t", "x").collect()}
    got = {}
    # one micro-batch per arriving folder, resumed from its checkpoint each time
    import shutil

    landing = tmp_path / "landing"
    landing.mkdir()
    for part in range(4):
        for f in (tmp_path / "in" / f"p{part}").glob("*.parquet"):
            shutil.copy(f, landing / f"{part}_{f.name}")
        stream = spark.readStream.schema(schema).parquet(str(landing))
        q = (
            stream_run_lengths(stream, "k", "t", "x").writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        )
        q.awaitTermination(120)
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got[r["k"], r["t"]] = r["run_length"]
    assert got == batch
