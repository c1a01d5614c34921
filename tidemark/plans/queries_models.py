"""Model queries: ridge by fold, stacking, meta-labels, regimes, changepoints."""

from __future__ import annotations

from datetime import timedelta

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from tidemark.operators import cv
from tidemark.operators import evaluate as ev
from tidemark.operators import models as md
from tidemark.plans import bindings as b
from tidemark.plans import sqlparts as q
from tidemark.plans.registry import query, rnd, text

DAY = timedelta(days=1)


def _rows(spark, sf):
    p = b.staged_panel(spark, sf).select("entry_date", "release_date", "district", "chg", "z8", "fwd_5")
    return p.dropna(subset=["chg", "fwd_5"])


def _folds(spark, sf):
    return cv.purged_kfold(_rows(spark, sf), "entry_date", ["release_date", "district"], 5, 4 * DAY, DAY)


_FOLDS = f"""{q.PANEL}, c AS (SELECT entry_date, release_date, district, chg AS x, fwd_5 AS y FROM panel WHERE chg IS NOT NULL AND fwd_5 IS NOT NULL),
s AS (SELECT *, ntile(5) OVER (ORDER BY entry_date, release_date, district) - 1 AS blk FROM c),
f AS (SELECT blk AS fold, min(entry_date) AS a, max(entry_date) AS z FROM s GROUP BY 1),
r AS (SELECT fold, s.*, CASE WHEN blk = fold THEN 'test' WHEN NOT ((entry_date <= z AND entry_date + 4 >= a)
    OR (entry_date > z AND entry_date <= z + 1)) THEN 'train' END AS role FROM s, f)"""
_RIDGE = """beta AS (SELECT {k}, regr_sxy(y, x) / (regr_sxx(y, x) + 1.0) AS b, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM r WHERE role = 'train' GROUP BY 1)"""


@query(
    "M2_ridge_by_fold",
    f"""WITH {_FOLDS}, {_RIDGE.format(k='fold')} SELECT CAST(fold AS INTEGER) AS fold, round(b, 8) + 0 AS beta, round(my - b * mx, 8) + 0 AS intercept, n AS n_train FROM beta""",
)
def m2(spark, sf):
    out = md.ridge_by_fold(_folds(spark, sf), ["chg"], "fwd_5", 1.0)
    return out.select("fold", rnd(F.col("beta")[0], 8, "beta"), rnd("intercept", 8), "n_train")


@query(
    "M2_out_of_sample_ic",
    f"""WITH {_FOLDS}, {_RIDGE.format(k='fold')} SELECT CAST(r.fold AS INTEGER) AS fold, count(*) AS n, round(corr(my + b * (x - mx), y), 6) + 0 AS ic
    FROM r JOIN beta USING (fold) WHERE role = 'test' GROUP BY 1""",
)
def m2_ic(spark, sf):
    return md.out_of_sample_ic(_folds(spark, sf), ["chg"], "fwd_5").select("fold", "n", rnd("ic"))


_TWO = _FOLDS.replace("chg AS x, fwd_5 AS y", "chg AS x, z8 AS w, fwd_5 AS y")


@query(
    "M2_ridge_two_features",
    f"""WITH {_TWO}, g AS (SELECT fold, regr_sxx(y, x) + 1 AS xx, regr_sxx(y, w) + 1 AS zz, regr_sxy(w, x) AS xz, regr_sxy(y, x) AS xy, regr_sxy(y, w) AS zy,
      avg(x) AS mx, avg(w) AS mz, avg(y) AS my FROM r WHERE role = 'train' AND w IS NOT NULL GROUP BY 1),
    k AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS bx, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS bz FROM g)
    SELECT CAST(r.fold AS INTEGER) AS fold, count(*) AS n, round(corr(my + bx * (x - mx) + bz * (w - mz), y), 6) + 0 AS ic
    FROM r JOIN k USING (fold) WHERE role = 'test' AND w IS NOT NULL GROUP BY 1 HAVING count(*) >= 2""",
)
def m2_two(spark, sf):
    return md.out_of_sample_ic(_folds(spark, sf), ["chg", "z8"], "fwd_5").select("fold", "n", rnd("ic"))


def _walk_sql(anchored: bool) -> str:
    start = "lo" if anchored else "a - 12"
    return f"""{q.PANEL}, c AS (SELECT entry_date, chg AS x, fwd_5 AS y FROM panel WHERE chg IS NOT NULL AND fwd_5 IS NOT NULL),
    g AS (SELECT min(entry_date) AS lo, max(entry_date) AS hi FROM c),
    w AS (SELECT i AS fold, lo, lo + 12 + CAST(i AS INTEGER) * 4 AS a FROM g, range(0, 20) t(i) WHERE lo + 12 + CAST(i AS INTEGER) * 4 + 4 <= hi),
    r AS (SELECT fold, x, y, CASE WHEN entry_date >= a AND entry_date < a + 4 THEN 'test' WHEN entry_date >= {start} AND entry_date < a - 1 THEN 'train' END AS role FROM c, w),
    {_RIDGE.format(k='fold')}
    SELECT CAST(r.fold AS INTEGER) AS fold, count(*) AS n, round(corr(my + b * (x - mx), y), 6) + 0 AS ic FROM r JOIN beta USING (fold) WHERE role = 'test' GROUP BY 1"""


@query("M3_walk_forward_anchored", f"WITH {_walk_sql(True)}")
def m3(spark, sf):
    folds = cv.walk_forward(_rows(spark, sf), "entry_date", 12 * DAY, 4 * DAY, 4 * DAY, True, DAY)
    return md.out_of_sample_ic(folds, ["chg"], "fwd_5").select("fold", "n", rnd("ic"))


@query("M3_walk_forward_rolling", f"WITH {_walk_sql(False)}")
def m3_rolling(spark, sf):
    folds = cv.walk_forward(_rows(spark, sf), "entry_date", 12 * DAY, 4 * DAY, 4 * DAY, False, DAY)
    return md.out_of_sample_ic(folds, ["chg"], "fwd_5").select("fold", "n", rnd("ic"))


_CPCV = f"""{q.PANEL}, c AS (SELECT entry_date, release_date, district, chg AS x, fwd_5 AS y FROM panel WHERE chg IS NOT NULL AND fwd_5 IS NOT NULL),
s AS (SELECT *, ntile(6) OVER (ORDER BY entry_date, release_date, district) - 1 AS blk FROM c),
f AS (SELECT blk AS fold, min(entry_date) AS a, max(entry_date) AS z FROM s GROUP BY 1),
combos AS (SELECT row_number() OVER (ORDER BY a.fold, c.fold) - 1 AS combo, a.fold AS f1, c.fold AS f2 FROM f a JOIN f c ON a.fold < c.fold),
shut AS (SELECT s.*, fold, (entry_date <= z AND entry_date + 3 >= a) OR (entry_date > z AND entry_date <= z + 1) AS out FROM s, f),
r AS (SELECT combo, entry_date, release_date, district, any_value(x) AS x, any_value(y) AS y,
  CASE WHEN any_value(blk) IN (any_value(f1), any_value(f2)) THEN 'test' WHEN NOT bool_or(out) THEN 'train' END AS role
  FROM combos JOIN shut ON fold IN (f1, f2) GROUP BY 1, 2, 3, 4),
{_RIDGE.format(k='combo')}, sc AS (SELECT combo, sign(my + b * (x - mx)) * y AS v FROM r JOIN beta USING (combo) WHERE role = 'test'),
paths AS (SELECT combo, count(v) AS n_obs, CASE WHEN stddev_samp(v) > 0 THEN avg(v) / stddev_samp(v) * sqrt(252) ELSE 0 END AS sharpe FROM sc GROUP BY 1)"""


def _paths(spark, sf):
    folds = cv.combinatorial_purged(_rows(spark, sf), "entry_date", ["release_date", "district"], 6, 2, 3 * DAY, DAY)
    return md.path_sharpes(folds, ["chg"], "fwd_5")


@query("M4_path_sharpes", f"WITH {_CPCV} SELECT CAST(combo AS INTEGER) AS combo, n_obs, round(sharpe, 5) + 0 AS sharpe FROM paths")
def m4(spark, sf):
    return _paths(spark, sf).select("combo", "n_obs", rnd("sharpe", 5))


@query("M4_overfitting", f"WITH {_CPCV} SELECT round(avg(CASE WHEN sharpe < 0 THEN 1.0 ELSE 0.0 END), 8) AS pbo FROM paths")
def m4_pbo(spark, sf):
    return ev.overfitting_share(_paths(spark, sf), "sharpe").select(rnd("pbo", 8))


@query("M1_stacked_ensemble")
def m1(spark, sf):
    rows = _rows(spark, sf).dropna()
    x = VectorAssembler(inputCols=["chg", "z8"], outputCol="features").transform(rows)
    folds = cv.purged_kfold(x, "entry_date", ["release_date", "district"], 3, 4 * DAY, DAY)
    learners = {
        "ridge": LinearRegression(regParam=0.01, standardization=False),
        "tree": DecisionTreeRegressor(maxDepth=3, seed=7),
    }
    model, oof = md.fit_stack(folds, ["entry_date", "release_date", "district"], "fwd_5", learners)
    scored = model.predict(x)
    return scored.select("entry_date", "release_date", "district", "ridge", "tree", "prediction")


_NEWTON = f"""WITH RECURSIVE {q.PANEL}, c AS (SELECT entry_date, release_date, district, chg AS a, z8 AS b, fwd_5, sign(chg) AS call FROM panel
  WHERE chg IS NOT NULL AND fwd_5 IS NOT NULL AND z8 IS NOT NULL),
d AS (SELECT *, CASE WHEN sign(fwd_5) = call THEN 1.0 ELSE 0.0 END AS y FROM c WHERE call <> 0),
fit(i, b0, b1, b2) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
  UNION ALL
  SELECT i + 1, b0 - (g0 * (h11 * h22 - h12 * h12) - g1 * (h01 * h22 - h02 * h12) + g2 * (h01 * h12 - h02 * h11)) / det,
    b1 - (-g0 * (h01 * h22 - h12 * h02) + g1 * (h00 * h22 - h02 * h02) - g2 * (h00 * h12 - h02 * h01)) / det,
    b2 - (g0 * (h01 * h12 - h11 * h02) - g1 * (h00 * h12 - h01 * h02) + g2 * (h00 * h11 - h01 * h01)) / det
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM (
    SELECT i, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(p - y) AS g0, sum((p - y) * a) + any_value(b1) AS g1, sum((p - y) * b) + any_value(b2) AS g2,
      sum(p * (1 - p)) AS h00, sum(p * (1 - p) * a) AS h01, sum(p * (1 - p) * b) AS h02, sum(p * (1 - p) * a * a) + 1 AS h11, sum(p * (1 - p) * a * b) AS h12,
      sum(p * (1 - p) * b * b) + 1 AS h22
    FROM (SELECT fit.*, a, b, y, 1 / (1 + exp(-(b0 + b1 * a + b2 * b))) AS p FROM fit, d WHERE i < 25) GROUP BY i))),
w AS (SELECT * FROM fit WHERE i = 25),
o AS (SELECT entry_date, release_date, district, call, 1 / (1 + exp(-(b0 + b1 * a + b2 * b))) AS confidence FROM c, w)
SELECT CAST(entry_date AS VARCHAR) AS entry_date, CAST(release_date AS VARCHAR) AS release_date, district, CAST(call AS DOUBLE) AS call, round(confidence, 5) AS confidence,
  round(CASE WHEN confidence >= 0.5 THEN call * confidence ELSE 0 END, 5) + 0 AS position FROM o"""


@query("M5_meta_labels", _NEWTON)
def m5(spark, sf):
    rows = _rows(spark, sf).dropna().withColumn("call", F.signum("chg"))
    model = md.fit_meta_label(rows, ["chg", "z8"], "call", "fwd_5")
    out = md.size_positions(rows, model, ["chg", "z8"], "call", 0.5)
    return out.select(text("entry_date"), text("release_date"), "district", "call", rnd("confidence", 5), rnd("position", 5))


@query("M6_regimes")
def m6(spark, sf):
    r = b.padded_returns(spark, sf).where(F.col("ret").isNotNull()).select("ticker", "date", "ret", F.abs("ret").alias("vol"))
    params = md.fit_regimes(r, "ticker", "date", ["ret", "vol"], 2)
    return md.predict_regimes(r, "ticker", "date", ["ret", "vol"], params)


_RUNS = f"""WITH RECURSIVE {q.BARS}, x AS (SELECT ticker, date, close - 100.0 AS g, row_number() OVER (PARTITION BY ticker ORDER BY date) AS t FROM bars WHERE close IS NOT NULL),
run(ticker, t, date, w, s, q) AS (
  SELECT DISTINCT ticker, CAST(0 AS BIGINT), CAST(NULL AS DATE), [CAST(1 AS DOUBLE)], [CAST(0 AS DOUBLE)], [CAST(0 AS DOUBLE)] FROM x
  UNION ALL
  SELECT ticker, t, date, list_transform(grown, lambda v: v / list_sum(grown)), s, q FROM (
    SELECT ticker, t, date, list_concat([list_sum(joint) / 250], list_transform(joint, lambda v: v * (1 - 1 / 250))) AS grown, s, q FROM (
      SELECT run.ticker, x.t, x.date, list_concat([CAST(0 AS DOUBLE)], list_transform(s, lambda v: v + g)) AS s, list_concat([CAST(0 AS DOUBLE)], list_transform(q, lambda v: v + g * g)) AS q,
        list_transform(range(len(w)), lambda r: w[r + 1] * exp(lgamma(1.5 + r / 2) - lgamma(1 + r / 2) - 0.5 * ln(pi() * 2 * (1 + 0.5 * (q[r + 1] - s[r + 1] * s[r + 1] / (1 + r))) * (1 + 1 / (1 + r)))
          - (1.5 + r / 2) * ln(1 + power(g - s[r + 1] / (1 + r), 2) / (2 * (1 + 0.5 * (q[r + 1] - s[r + 1] * s[r + 1] / (1 + r))) * (1 + 1 / (1 + r)))))) AS joint
      FROM run JOIN x ON x.ticker = run.ticker AND x.t = run.t + 1)))
SELECT ticker, CAST(date AS VARCHAR) AS date, CAST(list_position(w, list_max(w)) - 1 AS INTEGER) AS run_length FROM run WHERE t > 0"""


@query("M7_changepoints", _RUNS)
def m7(spark, sf):
    out = md.run_lengths(b.bars(spark, sf), "ticker", "date", "close", md.ChangepointPrior(mu0=100.0))
    return out.select("ticker", text("date"), "run_length")
