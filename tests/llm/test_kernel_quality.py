import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import kernel_quality as kq
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op12_kernel_quality"](spark, SF).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    tested = [r for r in got if r.held_out and r.doc_id in marks]
    assert np.mean([r.predicted == marks[r.doc_id] for r in tested]) > 0.98
    low, high = ([r.score for r in tested if marks[r.doc_id] == k] for k in (0, 1))
    assert np.mean([a < b for a in low for b in high]) > 0.99
    assert abs(np.mean(low + high) - np.mean([marks[r.doc_id] for r in tested])) < 0.02  # calibrated


def test_held_out_labels_and_other_columns_are_not_inputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.withColumn("quality", F.when(kq.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    plain = {r.doc_id: r.score for r in kq.qualities(docs, labels).collect()}
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string"), "score": F.lit("x")})
    assert {r.doc_id: r.score for r in kq.qualities(other, turned).collect()} == plain


def test_cosines_approximate_the_kernel():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)).clip(-kq.REACH, kq.REACH)
    kernel = kq.Kernel.drawn(np.zeros(5), np.ones(5), cosines=20_000, width=2.0)
    z = kernel.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 2.0**2))
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_partition_sums_solve_the_whole_ridge(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(500, len(kq.STATISTICS))), rng.integers(0, 2, 500)
    df = spark.createDataFrame([(int(k % 2), [float(v) for v in r], int(t)) for k, (r, t) in enumerate(zip(x, y))], "fold int, stats array<double>, label int")
    kernel = kq.Kernel.drawn(x.mean(0), x.std(0), cosines=30)
    weights = kq.solved(kq.normal_equations(df.repartition(6), kernel))
    z = kernel.features(x)
    penalty = np.diag([kq.PENALTY] * 30 + [1e-9])
    assert np.allclose(weights, np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-8)


def test_edges(spark):
    good, bad = "Das ist ein ruhiger Satz, der gut endet. ", "##$$ %% && XX!! "
    docs = [(k, f"Satz {k} ist da. " + good * (3 + k % 5) if k % 2 else f"{k}## " + bad * (3 + k % 4)) for k in range(80)]
    docs += [(200, None), (201, ""), (202, " \n "), (203, good * 40_000), (204, "漢" * 300), (None, good * 4), (1, good * 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("predicted", F.lit("x"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(200, 0), (None, 1), (3, None), (5, 1)], "doc_id long, quality int")
    got = kq.qualities(df, labels).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == 1 and not by[None].held_out
    assert all(by[k].predicted == k % 2 for k in range(80))
    assert by[200].score == by[201].score == by[202].score
    assert {r.score for r in kq.qualities(df, labels.limit(0)).collect()} == {0.5}
    assert {r.predicted for r in kq.qualities(df, labels.withColumn("quality", F.lit(1))).collect()} == {0}
    assert kq.qualities(df.limit(0), labels).count() == 0
    mean = np.mean([kq.statistics(good * n) for n in (3, 4)], axis=0)
    assert np.isfinite(mean).all() and len(mean) == len(kq.STATISTICS)
