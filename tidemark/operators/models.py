"""Fold-parallel and entity-parallel models (M1-M7)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tidemark.operators.evaluate import clean, information_coefficient, sharpe_ratio
from tidemark.session import durable

# ---------------------------------------------------------------- ridge from sums


def _moments(names: Sequence[str]) -> list[Column]:
    aggs = [F.count("*").alias("n")]
    aggs += [F.sum(a).alias(f"s_{i}") for i, a in enumerate(names)]
    aggs += [
        F.sum(F.col(a) * F.col(b)).alias(f"q_{i}_{j}")
        for i, a in enumerate(names) for j, b in enumerate(names) if i <= j
    ]
    return aggs


def ridge_by_fold(
    folds: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0, fold: str = "fold"
) -> DataFrame:
    """M2/M3: one ridge per fold, solved from the training rows' cross products.

    All folds share one pass and one aggregation; what remains per fold is a
    system of the size of the feature list. Returns (fold, intercept, beta,
    n_train). The penalty is ``alpha * |beta|^2`` on centred data.
    """
    names = [*features, label]
    rows = folds.where(F.col("role") == "train").select(fold, *[clean(c).alias(c) for c in names]).dropna()
    p = len(features)
    # sums about a common centre keep their digits where a column's level is far above its spread
    centre = rows.agg(*[F.avg(c).alias(c) for c in names]).first()
    level = np.array([centre[c] or 0.0 for c in names], dtype=float)
    rows = rows.select(fold, *[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(names, level)])
    sums = rows.groupBy(fold).agg(*_moments(names))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                n = float(r["n"])
                mean = np.array([r[f"s_{i}"] for i in range(p + 1)], dtype=float) / n
                cross = np.empty((p + 1, p + 1))
                for i in range(p + 1):
                    for j in range(i, p + 1):
                        cross[i, j] = cross[j, i] = r[f"q_{i}_{j}"]
                cross = cross - n * np.outer(mean, mean)
                beta = np.linalg.solve(cross[:p, :p] + alpha * np.eye(p), cross[:p, p])
                at = mean + level
                out.append((r[fold], float(at[p] - beta @ at[:p]), beta.tolist(), int(n)))
            yield pd.DataFrame(out, columns=[fold, "intercept", "beta", "n_train"])

    kind = rows.schema[fold].dataType.simpleString()
    return sums.mapInPandas(solve, f"{fold} {kind}, intercept double, beta array<double>, n_train long")


def predict_linear(rows: DataFrame, coefficients: DataFrame, features: Sequence[str], fold: str = "fold", out: str = "prediction") -> DataFrame:
    """Score rows with their fold's coefficients: one row per configured fold, hence broadcast."""
    score = F.col("intercept")
    for i, c in enumerate(features):
        score = score + F.col("beta")[i] * F.col(c)
    return rows.join(F.broadcast(coefficients), fold).withColumn(out, score).drop("intercept", "beta", "n_train")


def out_of_sample_ic(
    folds: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0, fold: str = "fold", p_value: bool = False
) -> DataFrame:
    """M2/M3/M4: ridge on each fold's training rows, IC of its predictions on the test rows."""
    fitted = ridge_by_fold(folds, features, label, alpha, fold)
    scored = predict_linear(folds.where(F.col("role") == "test"), fitted, features, fold)
    return information_coefficient(scored, "prediction", label, [fold], 2, p_value=p_value)


def path_sharpes(
    folds: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0, fold: str = "combo", periods: int = 252
) -> DataFrame:
    """M4: Sharpe of sign(prediction) * label on each combination's test rows."""
    fitted = ridge_by_fold(folds, features, label, alpha, fold)
    scored = predict_linear(folds.where(F.col("role") == "test"), fitted, features, fold)
    return sharpe_ratio(scored.withColumn("_s", F.signum("prediction") * F.col(label)), "_s", [fold], periods)


# ---------------------------------------------------------------- stacking


@dataclass
class StackedModel:
    """M1: fold models per base learner plus a regularised combiner."""

    task: str
    fold_models: dict[str, list[Model]] = field(default_factory=dict)
    meta: Model | None = None

    def base_predictions(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """Mean prediction of each base learner's fold models, one column per learner."""
        for name, models in self.fold_models.items():
            parts = []
            for i, m in enumerate(models):
                column = f"_{name}_{i}"
                rows = _score(m, rows, features, column, self.task)
                parts.append(column)
            mean = sum((F.col(c) for c in parts), F.lit(0.0)) / len(parts)
            rows = rows.withColumn(name, mean).drop(*parts)
        return rows

    def predict(self, rows: DataFrame, features: str = "features", out: str = "prediction") -> DataFrame:
        stacked = VectorAssembler(inputCols=list(self.fold_models), outputCol="_stack").transform(
            self.base_predictions(rows, features)
        )
        return self.meta.transform(stacked).withColumnRenamed("prediction", out).drop("_stack", "rawPrediction", "probability")


def _score(model: Model, rows: DataFrame, features: str, out: str, task: str) -> DataFrame:
    keep = rows.columns
    scored = model.transform(rows)
    value = vector_to_array(F.col("probability"))[1] if task == "classification" else F.col("prediction")
    return scored.select(*keep, value.alias(out))


def fit_stack(
    folds: DataFrame, row_id: Sequence[str], label: str, learners: dict[str, Estimator], task: str = "regression",
    meta: Estimator | None = None, features: str = "features",
) -> tuple[StackedModel, DataFrame]:
    """M1: out-of-fold predictions per learner, then a combiner on rows predicted by all.

    ``folds`` carries (row_id..., features, label, fold, role). Returns the
    model and the out-of-fold table. Each fit is a distributed Spark ML job;
    the loop runs over folds and learners, never over rows.
    """
    if task not in ("regression", "classification"):
        raise ValueError("task must be regression or classification")
    model = StackedModel(task, {name: [] for name in learners})
    folds = durable(folds)  # read by every fit
    numbers = sorted(r[0] for r in folds.select("fold").distinct().collect())
    pieces = []
    for k in numbers:
        part = folds.where(F.col("fold") == k)
        train, test = part.where(F.col("role") == "train"), part.where(F.col("role") == "test")
        scored = test.select(*row_id, features, label)
        for name, learner in learners.items():
            fitted = learner.copy({learner.featuresCol: features, learner.labelCol: label}).fit(train)
            model.fold_models[name].append(fitted)
            scored = _score(fitted, scored, features, name, task)
        pieces.append(scored)
    oof = pieces[0]
    for piece in pieces[1:]:
        oof = oof.unionByName(piece)
    complete = oof.dropna(subset=list(learners))
    stacked = VectorAssembler(inputCols=list(learners), outputCol="_stack").transform(complete)
    if meta is None:
        meta = (
            LogisticRegression(regParam=1.0 / max(stacked.count(), 1), standardization=False)
            if task == "classification"
            else best_ridge(complete, list(learners), label)
        )
    model.meta = meta.copy({meta.featuresCol: "_stack", meta.labelCol: label}).fit(stacked)
    return model, oof.drop(features)


ALPHAS = tuple(float(a) for a in np.logspace(-3, 3, 25))


def leave_one_out_errors(rows: DataFrame, features: Sequence[str], label: str, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """(alpha, error): mean squared error of each ridge penalty when every row is predicted without itself.

    One pass sums the centred cross products, which give the coefficients of every penalty; a second adds up the
    squares of residual / (1 - leverage), both column expressions.
    """
    names = [*features, label]
    data = rows.select(*[clean(c).alias(f"_{i}") for i, c in enumerate(names)]).dropna()
    p = len(features)
    mean = data.agg(F.count("*").alias("n"), *[F.avg(f"_{i}").alias(f"m_{i}") for i in range(p + 1)]).first()
    n = mean["n"]
    if not n:
        raise ValueError("no complete rows")
    off = [F.col(f"_{i}") - F.lit(mean[f"m_{i}"]) for i in range(p + 1)]
    sums = data.agg(*[F.sum(off[i] * off[j]).alias(f"q_{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]).first()
    cross = np.array([[sums[f"q_{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)], dtype=float)
    errors = []
    for a in alphas:
        inverse = np.linalg.inv(cross[:p, :p] + a * np.eye(p))
        beta = inverse @ cross[:p, p]
        residual, leverage = off[p], F.lit(1.0 / n)
        for i in range(p):
            residual = residual - float(beta[i]) * off[i]
            for j in range(p):
                leverage = leverage + float(inverse[i, j]) * off[i] * off[j]
        left_out = residual / (1 - leverage)
        errors.append(F.struct(F.lit(float(a)).alias("alpha"), F.avg(left_out * left_out).alias("error")))
    return data.agg(F.array(*errors).alias("_e")).select(F.inline("_e"))


def best_ridge(rows: DataFrame, features: Sequence[str], label: str, alphas: Sequence[float] = ALPHAS) -> LinearRegression:
    """The ridge learner whose penalty has the smallest leave-one-out error; ties to the smaller penalty."""
    errors = leave_one_out_errors(rows, features, label, alphas).collect()  # one row for each penalty
    alpha = min((r["error"], r["alpha"]) for r in errors)[1]
    return LinearRegression(regParam=alpha / max(rows.dropna(subset=[*features, label]).count(), 1), elasticNetParam=0.0, standardization=False)


# ---------------------------------------------------------------- meta-labelling


def fit_meta_label(
    rows: DataFrame, features: Sequence[str], call: str, realized: str, c: float = 1.0
) -> Model:
    """M5: probability that a directional call is right, fitted on rows with a call."""
    live = rows.where(F.col(call) != 0).withColumn(
        "_correct", (F.signum(realized) == F.signum(call)).cast("double")
    )
    x = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(live)
    n = x.count()
    return LogisticRegression(
        featuresCol="_x", labelCol="_correct", regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=1000, tol=1e-12
    ).fit(x)


def sized_position(call: Column, confidence: Column, threshold: float = 0.55) -> Column:
    """Call times confidence where the confidence reaches the threshold, else 0."""
    return F.when(confidence >= threshold, call * confidence).otherwise(F.lit(0.0))


def size_positions(
    rows: DataFrame, model: Model, features: Sequence[str], call: str, threshold: float = 0.55, out: str = "position"
) -> DataFrame:
    """M5 then P18: score the rows and size each call by its confidence."""
    keep = rows.columns
    x = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep").transform(rows)
    conf = vector_to_array(F.col("probability"))[1]
    scored = model.transform(x).select(*keep, conf.alias("confidence"))
    return scored.withColumn(out, sized_position(F.col(call), F.col("confidence"), threshold))


# ---------------------------------------------------------------- regimes


@dataclass(frozen=True)
class Regimes:
    """M6 parameters: start and transition probabilities, means and covariances per regime."""

    start: np.ndarray
    trans: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    log_likelihood: float

    def ordered(self) -> "Regimes":
        """Regimes numbered by the mean of the first feature."""
        o = np.argsort(self.means[:, 0], kind="stable")
        return Regimes(self.start[o], self.trans[np.ix_(o, o)], self.means[o], self.covs[o], self.log_likelihood)


def _log_density(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    d = x.shape[1]
    out = np.empty((len(x), len(means)))
    for k, (m, c) in enumerate(zip(means, covs)):
        chol = np.linalg.cholesky(c)
        z = np.linalg.solve(chol, (x - m).T)
        out[:, k] = -0.5 * (z**2).sum(axis=0) - np.log(np.diag(chol)).sum() - 0.5 * d * math.log(2 * math.pi)
    return out


CHUNK_CELLS = 2_000_000  # series x days worked on at once inside a task


def regime_series(panel: DataFrame, entity: str, date: str, features: Sequence[str]) -> DataFrame:
    """One row per entity: its dates and features as arrays in date order.

    A series is one entity's daily panel, so an array is bounded by the
    calendar. Fitting then needs no further shuffle, whatever the iterations.
    """
    names = list(features)
    rows = panel.select(entity, date, *[clean(c).alias(c) for c in names]).dropna()
    lists = rows.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(date, *names))).alias("_s"))
    return lists.select(entity, *[F.col(f"_s.{c}").alias(c) for c in (date, *names)])


def _padded(pdf: pd.DataFrame, names: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, pd.DataFrame]]:
    """Cut a batch into chunks of similar work: (values E x T x d, lengths, rows)."""
    lengths = pdf[names[0]].map(len).to_numpy()
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        width = 1
        while at + width < len(order) and (width + 1) * lengths[order[at + width]] <= CHUNK_CELLS:
            width += 1
        part = pdf.iloc[order[at : at + width]]
        size = lengths[order[at : at + width]]
        x = np.zeros((len(part), size.max(), len(names)))
        for c, name in enumerate(names):
            for e, values in enumerate(part[name]):
                x[e, : size[e], c] = values
        yield x, size, part
        at += width


def fit_regimes(
    panel: DataFrame, entity: str, date: str, features: Sequence[str], n_regimes: int = 2, iterations: int = 200,
    ridge: float = 1e-4, tolerance: float = 1e-2, covariance: str = "full",
) -> Regimes:
    """M6: Gaussian HMM shared by a panel of series, fitted by Baum-Welch on Spark.

    Series are gathered once and staged. Each iteration is a map over them,
    vectorised across the series of an Arrow batch, plus a sum of expected
    counts; the driver sees one parameter-sized row. It ends when an iteration raises the log-likelihood by
    less than ``tolerance``, after ``iterations`` at the latest. ``covariance`` is full or diag.
    """
    if covariance not in ("full", "diag"):
        raise ValueError("covariance must be full or diag")
    d, k = len(features), n_regimes
    names = list(features)
    series = durable(regime_series(panel, entity, date, names))
    values = series.select(F.explode(F.arrays_zip(*names)).alias("v")).select("v.*")
    first = values.agg(
        F.array(*[F.avg(c) for c in names]).alias("m"), F.array(*[F.var_pop(c) for c in names]).alias("v")
    ).first()
    mean, var = np.array(first["m"], dtype=float), np.array(first["v"], dtype=float) + ridge
    # deterministic start: regimes spread along the pooled standard deviation
    steps = np.linspace(-1.0, 1.0, k)[:, None]
    stay = 0.9 if k > 1 else 1.0
    trans = np.full((k, k), (1 - stay) / max(k - 1, 1))
    np.fill_diagonal(trans, stay)
    params = Regimes(np.full(k, 1.0 / k), trans, mean + steps * np.sqrt(var), np.array([np.diag(var)] * k), -math.inf)
    for _ in range(iterations):
        before = params.log_likelihood
        params = _baum_welch_step(series, names, params, ridge, covariance)
        if params.log_likelihood - before < tolerance:
            break
    return params.ordered()


def _expected_counts(x: np.ndarray, size: np.ndarray, p: Regimes) -> np.ndarray:
    """Sums of one E-step over a padded chunk, flattened: start, moves, weight, x, xx, log-likelihood."""
    n, width, d = x.shape
    k = len(p.means)
    live = np.arange(width)[None, :] < size[:, None]
    log_b = _log_density(x.reshape(-1, d), p.means, p.covs).reshape(n, width, k)
    top = log_b.max(axis=2, keepdims=True)
    b = np.exp(log_b - top)
    fwd, scale = np.zeros((n, width, k)), np.ones((n, width))
    for t in range(width):
        prior = np.broadcast_to(p.start, (n, k)) if t == 0 else fwd[:, t - 1] @ p.trans
        a = prior * b[:, t]
        scale[:, t] = a.sum(axis=1)
        fwd[:, t] = a / scale[:, t, None]
    back = np.ones((n, width, k))
    moves = np.zeros((k, k))
    for t in range(width - 2, -1, -1):
        on = live[:, t + 1]
        ahead = b[:, t + 1] * back[:, t + 1] / scale[:, t + 1, None]
        back[:, t] = np.where(on[:, None], ahead @ p.trans.T, 1.0)
        moves += p.trans * (fwd[on, t].T @ ahead[on])
    post = fwd * back
    post = np.where(live[:, :, None], post / post.sum(axis=2, keepdims=True), 0.0)
    sums = np.einsum("ntk,ntd->kd", post, x)
    outer = np.einsum("ntk,nti,ntj->kij", post, x, x, optimize=True)
    ll = np.where(live, np.log(scale) + top[:, :, 0], 0.0).sum()
    return np.concatenate([post[:, 0].sum(axis=0), moves.ravel(), post.sum(axis=(0, 1)), sums.ravel(), outer.ravel(), [ll]])


def _baum_welch_step(series: DataFrame, names: Sequence[str], params: Regimes, ridge: float, covariance: str) -> Regimes:
    k, d = params.means.shape

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for x, size, _ in _padded(pdf, names):
                part = _expected_counts(x, size, params)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total), dtype="int32"), "v": total})

    stats = series.select(*names).mapInPandas(expect, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    at = np.cumsum([0, k, k * k, k, k * d, k * d * d])
    flat = np.zeros(at[-1] + 1)
    for r in stats.collect():  # parameter-sized, whatever the data
        flat[r["i"]] = r["v"]
    start, moves, weight = flat[: at[1]], flat[at[1] : at[2]].reshape(k, k), flat[at[2] : at[3]]
    sums, outer = flat[at[3] : at[4]].reshape(k, d), flat[at[4] : at[5]].reshape(k, d, d)
    means = sums / weight[:, None]
    covs = outer / weight[:, None, None] - np.einsum("ki,kj->kij", means, means) + ridge * np.eye(d)
    if covariance == "diag":
        covs = covs * np.eye(d)
    leave = moves.sum(axis=1, keepdims=True)
    trans = np.where(leave > 0, moves / np.where(leave > 0, leave, 1.0), params.trans)
    return Regimes(start / start.sum(), trans, means, covs, float(flat[-1]))


def predict_regimes(panel: DataFrame, entity: str, date: str, features: Sequence[str], params: Regimes) -> DataFrame:
    """M6: most likely regime path per entity (Viterbi), one row per entity and day."""
    names = list(features)
    series = regime_series(panel, entity, date, names)
    schema = series.select(entity, date).schema.add("_path", ArrayType(IntegerType()))
    with np.errstate(divide="ignore"):
        log_t, log_start = np.log(params.trans), np.log(params.start)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x, size, part in _padded(pdf, names):
                n, width, d = x.shape
                log_b = _log_density(x.reshape(-1, d), params.means, params.covs).reshape(n, width, -1)
                score = log_start + log_b[:, 0]
                came = np.zeros(log_b.shape, dtype="int32")
                final = score.copy()
                for t in range(1, width):
                    step = score[:, :, None] + log_t
                    came[:, t] = step.argmax(axis=1)
                    score = step.max(axis=1) + log_b[:, t]
                    final[size > t] = score[size > t]
                path = np.zeros((n, width), dtype="int32")
                state = final.argmax(axis=1)
                for t in range(width - 1, -1, -1):
                    inside = size > t
                    path[inside, t] = state[inside]
                    state = np.where(inside, came[np.arange(n), t, state], state) if t else state
                out = part[[entity, date]].copy()
                out["_path"] = [path[e, : size[e]] for e in range(n)]
                yield out

    decoded = series.mapInPandas(decode, schema)
    days = F.arrays_zip(F.col(date).alias("d"), F.col("_path").alias("p"))
    return decoded.select(entity, F.explode(days).alias("_z")).select(
        entity, F.col("_z.d").alias(date), F.col("_z.p").alias("regime")
    )


def regime_means(params: Regimes, features: Sequence[str]) -> list[dict]:
    """M6: mean of each feature per regime."""
    return [{"regime": i, **dict(zip(features, map(float, m)))} for i, m in enumerate(params.means)]


# ---------------------------------------------------------------- changepoints


@dataclass(frozen=True)
class ChangepointPrior:
    hazard_lambda: float = 250.0
    mu0: float = 0.0
    kappa0: float = 1.0
    alpha0: float = 1.0
    beta0: float = 1.0


_GAMMA_RATIOS: dict[float, np.ndarray] = {}


def _gamma_ratios(alpha0: float, n: int) -> np.ndarray:
    """log Gamma(a + 1/2) - log Gamma(a) for a = alpha0 + run/2; grown on demand, shared by all series of a task."""
    known = _GAMMA_RATIOS.get(alpha0)
    if known is None or len(known) < n:
        alphas = alpha0 + np.arange(max(n, 64, 0 if known is None else 2 * len(known))) / 2
        known = np.array([math.lgamma(a + 0.5) - math.lgamma(a) for a in alphas])
        _GAMMA_RATIOS[alpha0] = known
    return known[:n]


@dataclass
class RunLengths:
    """M7 state of several series at once, a row each and a column for every run length up to now.

    A run of r values is known by their sum and sum of squares about the prior mean; all parameters of
    its posterior follow from these and r. Every run length is kept.
    """

    weight: np.ndarray
    total: np.ndarray
    square: np.ndarray

    @staticmethod
    def fresh(n_series: int = 1) -> "RunLengths":
        return RunLengths(np.ones((n_series, 1)), np.zeros((n_series, 1)), np.zeros((n_series, 1)))

    def observe(self, values: np.ndarray, p: ChangepointPrior) -> np.ndarray:
        """Fold in one value of each series and return the most likely run lengths."""
        run = np.arange(self.weight.shape[1])
        gap = (np.asarray(values, dtype=float) - p.mu0)[:, None]
        held = p.kappa0 + run
        centre = self.total / held
        rate = np.maximum(p.beta0 + 0.5 * (self.square - centre * self.total), p.beta0)
        spread = 2 * rate * (1 + 1 / held)
        shape = p.alpha0 + run / 2
        # Student-t predictive with 2 * shape degrees of freedom
        fit = _gamma_ratios(p.alpha0, len(run)) - 0.5 * np.log(math.pi * spread) - (shape + 0.5) * np.log1p((gap - centre) ** 2 / spread)
        top = np.where(self.weight > 0, fit, -np.inf).max(axis=1, keepdims=True)
        joint = self.weight * np.exp(fit - top)
        hazard = 1.0 / p.hazard_lambda
        grown = np.hstack([joint.sum(axis=1, keepdims=True) * hazard, joint * (1.0 - hazard)])
        none = np.zeros_like(gap)
        self.weight = grown / grown.sum(axis=1, keepdims=True)
        self.total, self.square = np.hstack([none, self.total + gap]), np.hstack([none, self.square + gap * gap])
        return self.weight.argmax(axis=1)

    def rest(self, first: int) -> "RunLengths":
        """The series from ``first`` on."""
        return RunLengths(self.weight[first:], self.total[first:], self.square[first:])

    def pack(self) -> list[float]:
        return np.concatenate([self.weight[0], self.total[0], self.square[0]]).tolist()

    @staticmethod
    def unpack(flat: Sequence[float]) -> "RunLengths":
        return RunLengths(*[a[None, :].copy() for a in np.asarray(flat, dtype=float).reshape(3, -1)])


def run_lengths(
    panel: DataFrame, entity: str, date: str, value: str, prior: ChangepointPrior = ChangepointPrior()
) -> DataFrame:
    """M7: most likely run length after each day, per entity.

    The recursion is sequential in time, so a series is one row; the daily-panel contract bounds it by the
    calendar. A task steps through time once for all series of a batch.
    """
    series = regime_series(panel, entity, date, [value])
    schema = series.select(entity, date).schema.add("_run", ArrayType(IntegerType()))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x, size, part in _padded(pdf, [value]):
                state, found, first = RunLengths.fresh(len(part)), np.zeros(x.shape[:2], dtype="int32"), 0
                for t in range(x.shape[1]):
                    ended = int(np.searchsorted(size, t, side="right"))  # series come by length
                    state, first = state.rest(ended - first), ended
                    found[first:, t] = state.observe(x[first:, t, 0], prior)
                out = part[[entity, date]].copy()
                out["_run"] = [found[e, : size[e]] for e in range(len(part))]
                yield out

    days = F.arrays_zip(F.col(date).alias("d"), F.col("_run").alias("r"))
    walked = series.mapInPandas(walk, schema).select(entity, F.explode(days).alias("_z"))
    return walked.select(entity, F.col("_z.d").alias(date), F.col("_z.r").alias("run_length"))
