"""Quality by kernel ridge regression on document statistics, with random Fourier features and calibrated scores.

A Gaussian kernel over standardised statistics of a whole text is approximated by cosines of random projections.
Ridge weights solve the normal equations, which every partition sums over its own rows; isotonic regression turns
ridge scores of rows that the weights have not seen into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dealt, small_batches, staged

SAMPLE_DOCS = 40_000  # labelled documents that the model is fitted on, about
COSINES = 384  # random features
WIDTH = 3.0  # the kernel's width, in standard deviations of a statistic
REACH = 3.0  # standard deviations: what is further from the sample than this counts as this far
PENALTY = 1.0  # added to the diagonal of the normal equations
FOLDS = 2  # each part's scores for the calibration come from weights fitted on the others
SEED = 12
GOOD = 0.7  # from this score a document counts as good

# classes of characters, as numbers in a table over code points
_OTHER, _SMALL, _LARGE, _DIGIT, _SPACE, _LINE, _STOP, _INNER, _SIGN = range(9)


def _table() -> np.ndarray:
    """The class of each code point; those above the basic plane are ``other``."""
    table = np.full(0x10000, _OTHER, np.uint8)
    for k in range(0x10000):
        c = chr(k)
        if c.isalpha():
            table[k] = _LARGE if c.isupper() else _SMALL
        elif c.isdigit():
            table[k] = _DIGIT
        elif c.isspace():
            table[k] = _SPACE
        elif k > 32 and (k < 127 or 0xA1 <= k <= 0xBF or 0x2000 <= k < 0x2C00):
            table[k] = _SIGN
    for c in ".!?":
        table[ord(c)] = _STOP
    for c in ",;:'\"-()":
        table[ord(c)] = _INNER
    table[10] = _LINE
    return table


_CLASSES = _table()
STATISTICS = (
    "log words", "letters", "capitals of letters", "digits", "marks a word", "sentence ends a word", "signs a word", "log line length",
    "repeated lines", "lines that end a sentence", "distinct words", "letters a word", "spread of word length", "words with a sign",
    "words in capitals", "words behind a sign", "longest word", "other characters",
)


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text; null as empty, for which all are 0."""
    text = text or ""
    own = text.split()
    if not own:
        return [0.0] * len(STATISTICS)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _CLASSES[np.minimum(points, 0xFFFF)]
    n = np.bincount(kind, minlength=9).astype(float)
    letters, size, count = n[_SMALL] + n[_LARGE], float(len(points)), float(len(own))
    lines = [line for line in text.split("\n") if line.strip()]
    lengths = np.array(list(map(len, own)), float)
    signs = np.flatnonzero(kind == _SIGN)
    gap = (kind == _SPACE) | (kind == _LINE)
    word_of = np.cumsum(gap)  # the same for all characters of a word
    capitals = np.count_nonzero((kind[1:] == _LARGE) & (kind[:-1] == _LARGE))
    return [
        float(np.log1p(count)), letters / size, n[_LARGE] / max(letters, 1.0), n[_DIGIT] / size, n[_INNER] / count, n[_STOP] / count,
        min(n[_SIGN] / count, 5.0), float(np.log1p(size / len(lines))), 1 - len(set(lines)) / len(lines),
        sum(line.rstrip()[-1:] in ".!?" for line in lines) / len(lines), len(set(own)) / count, min(float(lengths.mean()), 40.0),
        float(np.log1p(lengths.std())), len(np.unique(word_of[signs])) / count, capitals / max(letters, 1.0),
        np.count_nonzero(np.isin(word_of[signs[signs > 0]] - 1, word_of[signs])) / count, float(np.log1p(lengths.max())), n[_OTHER] / size,
    ]


@dataclass(frozen=True)
class Kernel:
    """Standardisation and random projections; the same for every fit with one seed."""

    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    @staticmethod
    def drawn(mean: np.ndarray, spread: np.ndarray, cosines: int = COSINES, width: float = WIDTH, seed: int = SEED) -> Kernel:
        rng = np.random.default_rng(seed)
        return Kernel(mean, np.where(spread > 1e-9, spread, 1.0), rng.normal(size=(len(mean), cosines)) / width, rng.uniform(0, 2 * np.pi, cosines))

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosines whose products approximate the kernel, and a constant. Statistics further off than REACH count as that far."""
        z = np.clip((stats - self.mean) / self.spread, -REACH, REACH)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(z), 1))])


@dataclass(frozen=True)
class Model:
    kernel: Kernel
    weights: np.ndarray
    raw: np.ndarray  # ridge scores at which the calibration is given, rising
    sure: np.ndarray  # and the probability there

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.kernel.features(stats) @ self.weights, self.raw, self.sure), 0.0, 1.0)


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``stats``, the STATISTICS of its whole texts as an array."""

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return small_batches(df).withColumn("stats", stats(F.col(text)))


def normal_equations(rows: DataFrame, kernel: Kernel) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each fold of (fold, stats, label) the sums of x x' and x y over its rows.

    Every task sums its own rows and gives COSINES + 1 rows a fold; the driver gets as many.
    """
    size = kernel.directions.shape[1] + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, own in batch.groupby("fold"):
                x = kernel.features(np.stack(own["stats"].to_list()))
                both = np.hstack([x, own["label"].to_numpy(float)[:, None]])
                held[fold] = held.get(fold, 0) + x.T @ both
        for fold, m in held.items():
            yield pd.DataFrame({"fold": int(fold), "line": np.arange(size), "sums": list(m)})

    def total(parts: pd.DataFrame) -> pd.DataFrame:
        values = sorted(parts["sums"].to_list(), key=lambda v: tuple(v[-3:]))  # one order, so one rounding
        return pd.DataFrame({"fold": [parts["fold"].iloc[0]], "line": [parts["line"].iloc[0]], "sums": [np.sum(values, axis=0)]})

    schema = "fold int, line int, sums array<double>"
    got = rows.select("fold", "stats", "label").mapInPandas(sums, schema).groupBy("fold", "line").applyInPandas(total, schema).collect()
    out = [np.zeros((size, size + 1)) for _ in range(FOLDS)]
    for r in got:
        out[r.fold][r.line] = r.sums
    return [(m[:, :size], m[:, size]) for m in out]


def solved(equations: list[tuple[np.ndarray, np.ndarray]], penalty: float = PENALTY) -> np.ndarray:
    left, right = (np.sum([e[k] for e in equations], axis=0) for k in (0, 1))
    ridge = np.full(len(left), penalty)
    ridge[-1] = 1e-9  # the constant is not shrunk
    return np.linalg.solve(left + np.diag(ridge), right)


def fit(labelled: DataFrame, label: Column, text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_key: Column | None = None) -> Model | None:
    """A model from rows with a 0/1 label; null labels are left out. None if there is no labelled row of each kind.

    About ``sample_docs`` rows are drawn, all classes at one rate, by the hash of ``sample_key`` (the text if not given).
    Copies of a text fall into one fold. Their ridge scores in the other fold's fit are calibrated.
    """
    rows = labelled.select(F.col(text).alias("text"), label.cast("int").alias("label"), F.xxhash64(F.col(text) if sample_key is None else sample_key).alias("key"))
    rows = rows.where("label IS NOT NULL")
    count = rows.count()
    drawn = rows.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.lit(1_000_000.0 * sample_docs / max(count, 1)))
    drawn = with_statistics(dealt(drawn)).select("label", "stats", F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"))
    drawn = staged(drawn, "quality-sample")
    if drawn.select("label").distinct().count() < 2:
        return None
    figures = drawn.agg(*[f(F.col("stats")[k]).alias(f"{n}{k}") for k in range(len(STATISTICS)) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).collect()[0]
    kernel = Kernel.drawn(*(np.array([figures[f"{n}{k}"] for k in range(len(STATISTICS))], float) for n in ("m", "s")))
    equations = normal_equations(drawn, kernel)
    apart = [solved([e for k, e in enumerate(equations) if k != fold]) for fold in range(FOLDS)]

    @F.pandas_udf("double")
    def unseen(stats: pd.Series, fold: pd.Series) -> pd.Series:
        x = kernel.features(np.stack(stats.to_list()))
        return pd.Series((x * np.stack([apart[k] for k in fold])).sum(axis=1))

    pairs = drawn.select(F.col("label").cast("double").alias("label"), F.round(unseen("stats", "fold"), 6).alias("raw"))
    steps = IsotonicRegression(featuresCol="raw", labelCol="label").fit(staged(pairs, "quality-unseen"))
    return Model(kernel, solved(equations), np.array(steps.boundaries), np.array(steps.predictions))


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add score (0 to 1, the calibrated probability of label 1) and predicted (1 from GOOD on).

    Null, empty and blank texts are scored like any other, from statistics of 0; very long texts are read whole.
    Without a model every score is 0.5. Columns with these names are replaced; rows are independent, so repeated rows
    score alike; an empty table gives none.
    """
    if model is None:
        return df.withColumns({"score": F.lit(0.5), "predicted": F.lit(0)})
    shared = df.sparkSession.sparkContext.broadcast(model)  # COSINES numbers for each statistic, at most SAMPLE_DOCS steps

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array([statistics(t) for t in texts], float).reshape(-1, len(STATISTICS))))

    return small_batches(df).withColumn("score", score(F.col(text))).withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


HELD_OUT = 2  # rows whose id's CRC-32 modulo 4 is this are never learned from


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == HELD_OUT


def qualities(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, learned from ``labels.quality`` of rows not held out.

    The labelled documents are drawn from the labels, by the id's hash, so no text is moved for the choice; the ids drawn
    are bounded by the sample and go to all tasks. Of several labels of one document the smallest counts. Rows of a
    null doc_id are scored, never learned from.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.min("quality").alias("quality"))
    known = known.where(~held_out("of"))
    count = known.count()
    drawn = known.where(F.pmod(F.xxhash64("of", F.lit("quality")), F.lit(1_000_000)) < F.lit(1_000_000.0 * sample_docs / max(count, 1)))
    texts = docs.select("doc_id", "text").join(F.broadcast(staged(drawn, "quality-drawn")), F.col("doc_id") == F.col("of")).select("text", "quality")
    model = fit(staged(texts, "quality-labelled"), F.col("quality"), sample_docs=sample_docs)
    got = predict(dealt(docs.select("doc_id", "text")), model)
    return got.select("doc_id", held_out().alias("held_out"), "score", "predicted")
