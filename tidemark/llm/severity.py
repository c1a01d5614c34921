"""Toxicity as an ordinal grade: cumulative-link regression over sparse text features.

P(grade <= k) = s(t_k - w.x): one weight vector serves all ordered thresholds t_k. Features are words
and word beginnings, chosen by how much more often they occur in graded texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dealt, small_batches, staged

SAMPLE_DOCS = 12_000  # labelled rows of each of the two classes that the model is fitted on, about
MAX_FEATURES = 20_000
MIN_SHARE = 0.01  # share of the graded or of the other texts that a feature occurs in at least
MIN_Z = 5.0  # standard errors between its rates in graded and other texts
BEGINNINGS = (4, 5)  # characters of a word's beginning that make a feature
STEPS, RATE, PENALTY = 400, 0.1, 1e-5

_WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    return [word] + [f"{word[:n]}+" for n in BEGINNINGS if len(word) > n]


@dataclass(frozen=True)
class Model:
    """Feature weights, the ordered thresholds between grades, and the features' places."""

    weights: np.ndarray
    thresholds: np.ndarray
    place: dict[str, int]

    def values(self, text: str | None) -> dict[int, float]:
        """Sparse features of a whole text: log2(1 + occurrences)."""
        n, place = Counter(), self.place
        for word, times in words_in(text).items():
            for f in features_of(word):
                if (k := place.get(f)) is not None:
                    n[k] += times
        return {k: float(np.log2(1 + v)) for k, v in n.items()}

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade = k) for k = 0 to the number of thresholds."""
        below = _sigmoid(self.thresholds[None, :] - score[:, None])
        edges = np.hstack([np.zeros((len(score), 1)), below, np.ones((len(score), 1))])
        return np.clip(np.diff(edges, axis=1), 0.0, 1.0)

    def score(self, text: str | None) -> float:
        """w.x; a text without any feature shows nothing and scores below all thresholds."""
        values = self.values(text)
        return float(sum(self.weights[k] * v for k, v in values.items())) if values else -np.inf


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_cumulative(rows: list[dict[int, float]], grades: np.ndarray, n_features: int, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the largest penalised likelihood, by Adam with fixed steps.

    The thresholds stay ordered as the first plus exponentials of free gaps.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([k for r in rows for k in r], np.int64)
    val = np.array([v for r in rows for v in r.values()], float)
    n, cuts = len(rows), n_grades - 1
    share = np.array([(grades <= k).mean() for k in range(cuts)]).clip(1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + np.arange(cuts) * 1e-3)
    params = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        w, t0, gaps = params[:n_features], params[n_features], np.exp(params[n_features + 1 :])
        t = t0 + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(at, val * w[col], n) if len(col) else np.zeros(n)
        upper = np.where(grades < cuts, _sigmoid(t[np.minimum(grades, cuts - 1)] - score), 1.0)
        lower = np.where(grades > 0, _sigmoid(t[np.maximum(grades - 1, 0)] - score), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p  # d log p / d upper cut, - d lower cut
        dscore = dl - du
        dt = np.zeros(cuts)
        np.add.at(dt, np.minimum(grades, cuts - 1), np.where(grades < cuts, du, 0.0))
        np.add.at(dt, np.maximum(grades - 1, 0), np.where(grades > 0, -dl, 0.0))
        later = np.cumsum(dt[::-1])[::-1]
        gw = np.bincount(col, val * dscore[at], n_features) / n - PENALTY * w if len(col) else -PENALTY * w
        g = np.concatenate([gw, [later[0] / n], later[1:] * gaps / n])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        params = params + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(params[n_features + 1 :])
    return params[:n_features], params[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])


def _sample(labelled: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows of each class, drawn by the text's hash; copies of a text count once. Staged in the shared folder."""
    sizes = {r["positive"]: r["count"] for r in labelled.groupBy("positive").count().collect()}
    share = F.lit(0.0)
    for k, n in sizes.items():
        share = F.when(F.col("positive") == k, F.lit(rows / n)).otherwise(share)
    drawn = F.pmod(F.xxhash64("text", F.lit("severity")), F.lit(1_000_000)) < share * 1_000_000
    return staged(labelled.where(drawn).dropDuplicates(["text", "grade"]), "severity-sample")


def fit(labelled: DataFrame, grade: Column, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from rows with an integer grade from 0; grade null or text null are left out.

    At most about 2 * ``sample_docs`` rows and MAX_FEATURES features reach the driver. Without rows of
    at least two grades the model gives everything the lowest grade.
    """
    rows = labelled.select(F.col(text).alias("text"), grade.cast("int").alias("grade")).where("text IS NOT NULL AND grade >= 0")
    sample = _sample(rows.withColumn("positive", F.col("grade") > 0), sample_docs)
    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    graded, others = sizes.get(True, 0), sizes.get(False, 0)
    if not graded or not others:
        return Model(np.zeros(0), np.array([40.0]), {})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for positive, own in batch.groupby("positive"):
                n = Counter(f for t in own["text"] for f in {f for w in words_in(t) for f in features_of(w)})
                yield pd.DataFrame({"feature": list(n), "positive": bool(positive), "n": list(n.values())})

    counted = small_batches(dealt(sample)).mapInPandas(count, "feature string, positive boolean, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("positive"), 0).otherwise(F.col("n"))).alias("b")
    )
    total = graded + others
    rate = (F.col("a") + F.col("b")) / total
    z = (F.col("a") / graded - F.col("b") / others) / F.sqrt(rate * (1 - rate) * (1 / graded + 1 / others) + 1e-12)
    common = (F.col("a") >= MIN_SHARE * graded) | (F.col("b") >= MIN_SHARE * others)
    chosen = counted.where(common & (F.col("a") + F.col("b") > 1)).withColumn("z", z).where(F.abs("z") >= MIN_Z)
    place = {r.feature: k for k, r in enumerate(chosen.orderBy(F.desc(F.abs("z")), "feature").limit(MAX_FEATURES).collect())}
    empty = Model(np.zeros(len(place)), np.zeros(0), place)

    @F.pandas_udf("map<int,double>")
    def sparse(texts: pd.Series) -> pd.Series:
        return pd.Series([empty.values(t) for t in texts])

    got = sample.select("grade", sparse("text").alias("x")).collect()
    grades = np.array([r.grade for r in got])
    weights, thresholds = fit_cumulative([r.x for r in got], grades, len(place), int(grades.max()) + 1)
    return Model(weights, thresholds, place)


def graded_from_flag(labelled: DataFrame, flag: str = "toxic", text: str = "text") -> DataFrame:
    """(text, flag, grade) for rows with a 0/1 flag: grade 0 unflagged; flagged rows 1, or 2 from the median evidence up.

    Evidence is the score of a model fitted on the flag alone. Rows with a null flag get a null grade.
    """
    first = labelled.sparkSession.sparkContext.broadcast(fit(labelled, F.col(flag), text))

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series([first.value.score(t) for t in texts], dtype=float)

    rows = small_batches(labelled).select(text, flag, F.when(F.col(flag) == 1, evidence(F.col(text))).alias("evidence"))
    rows = staged(rows, "severity-grades")
    middle = rows.agg(F.percentile_approx("evidence", 0.5)).collect()[0][0]
    high = F.col("evidence") >= F.lit(middle if middle is not None else 0.0)
    return rows.withColumn("grade", F.when(F.col(flag) == 1, F.when(high, 2).otherwise(1)).when(F.col(flag) == 0, 0))


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add expected_severity, severity (the most likely grade) and p_toxic = P(grade > 0).

    Null and empty texts, and others without any feature, get severity 0 with certainty. Columns with these
    names are replaced; rows are independent of each other.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES features

    @F.pandas_udf("expected_severity double, severity int, p_toxic double")
    def graded(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        p = own.probabilities(np.array([own.score(t) for t in texts], float))
        return pd.DataFrame({"expected_severity": p @ np.arange(p.shape[1]), "severity": p.argmax(axis=1).astype("int32"), "p_toxic": 1 - p[:, 0]})

    got = small_batches(df).withColumn("__graded", graded(F.col(text)))
    return got.withColumns({c: F.col(f"__graded.{c}") for c in ("expected_severity", "severity", "p_toxic")}).drop("__graded")


def model_for(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from about ``sample_docs`` documents of each class of the toxic label.

    The documents are drawn from the labels, by the id's hash, so no text is moved for the choice; the ids
    drawn are bounded by the sample and go to all tasks. Of several labels of one document the highest counts.
    """
    flags = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").alias("toxic"))
    share = F.lit(0.0)
    for r in flags.groupBy("toxic").count().collect():
        share = F.when(F.col("toxic") == r["toxic"], F.lit(sample_docs / r["count"])).otherwise(share)
    drawn = flags.where(F.pmod(F.xxhash64("of", F.lit("severity")), F.lit(1_000_000)) < share * 1_000_000)
    known = docs.select("doc_id", "text").join(F.broadcast(staged(drawn, "severity-drawn")), F.col("doc_id") == F.col("of"))
    graded = graded_from_flag(staged(known.select("text", "toxic"), "severity-labelled"))
    return fit(graded, F.col("grade"))


TOXIC = 0.5  # from this P(grade > 0) a document is rejected


def severities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: expected severity, most likely grade, P(grade > 0), and whether it counts as toxic."""
    got = predict(dealt(docs.select("doc_id", "text")), model_for(docs, labels))
    return got.select("doc_id", "expected_severity", "severity", "p_toxic", (F.col("p_toxic") >= TOXIC).alias("toxic"))
