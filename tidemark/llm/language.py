"""Language identification by bit-sliced Bloom filters over character n-grams.

All languages share one table of slots; a slot holds a bit for each language. Looking an n-gram up
takes the AND of its slots and so returns every language whose filter holds it, at one go. A text's
n-grams are counted for each language, the share of false positives that the filter's fill predicts
is taken off, and the language with the most n-grams left wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import dealt, small_batches, staged

SIZES = (3, 4)  # characters in an n-gram
SAMPLE_DOCS = 2_000  # documents of each language that the filters are learned from, about
GRAMS = 20_000  # most frequent n-grams kept for each language
SHARED = 0.2  # an n-gram stays with a language where its rate is at least this share of its highest rate
MAX_LANGUAGES = 1_024
SLOTS = 1 << 18
PROBES = 3
CHUNK = 400_000  # characters looked up together
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point its lower-case letter, or a space where it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(text: str | None) -> np.ndarray:
    """Lower-case letters with single spaces between words and around; empty where there is no letter."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.concatenate([[32], _folded()[codes], [32]]).astype(np.uint64)
    space = codes == 32
    codes = codes[~(space & np.concatenate([[False], space[:-1]]))]
    return codes if len(codes) > 1 else codes[:0]


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-grams of this size."""
    count = len(codes) - n + 1
    h = np.full(count, n, np.uint64)
    for k in range(n):
        h = (h ^ codes[k : count + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def stretches(codes: np.ndarray, size: int = CHUNK) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of a text of any length, in pieces of bounded size; each n-gram comes once."""
    for at in range(0, len(codes), size):
        for n in SIZES:
            part = codes[at : at + size + n - 1]
            if len(part) >= n:
                yield _hashes(part, n)


def _slots(h: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(PROBES):
        yield ((h >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)).astype(np.int64)


@dataclass(frozen=True)
class Filters:
    """words[w] holds the bits of languages 64 w to 64 w + 63; languages stand in the order of ties."""

    languages: tuple[str, ...]
    words: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def build(cls, members: dict[str, np.ndarray]) -> Filters:
        languages = tuple(members)
        words = np.zeros((-(-max(1, len(languages)) // 64), SLOTS), np.uint64)
        rates = np.zeros(len(languages))
        for k, name in enumerate(languages):
            bit, row = np.uint64(1 << (k % 64)), words[k // 64]
            for slot in _slots(members[name]):
                row[slot] |= bit
            rates[k] = ((row & bit) != 0).mean() ** PROBES
        return cls(languages, words, rates)

    def counts(self, codes: np.ndarray) -> tuple[np.ndarray, int]:
        """For each language the n-grams its filter returns, and how many there are in all."""
        hits, n = np.zeros(len(self.languages), np.int64), 0
        for h in stretches(codes):
            n += len(h)
            for w, row in enumerate(self.words):
                found = None
                for slot in _slots(h):
                    found = row[slot] if found is None else found & row[slot]
                for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                    hits[k] += np.count_nonzero(found & np.uint64(1 << (k - 64 * w)))
        return hits, n

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and the corrected share of the text's n-grams that it holds, from 0 to 1."""
        codes = letters(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        hits, n = self.counts(codes)
        share = np.clip((hits / n - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0.0, 1.0)
        best = int(share.argmax())
        return self.languages[best], float(share[best])


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", by: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Filters:
    """Filters from rows with a text and a language, on about ``sample_docs`` rows of each language.

    Rows are drawn by the hash of ``by``. n-grams are counted over the partitions and added up in a
    shuffle; a language keeps its most frequent ones, except those at home elsewhere. Ties between
    languages go to the one with more rows, then by name. Null languages are left out.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = rows.groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is this the language column?")
    if not sizes:
        return Filters.build({})
    spark = labelled.sparkSession
    wanted = spark.createDataFrame([(r["lang"], sample_docs / r["count"]) for r in sizes], "of string, share double")
    drawn = F.pmod(F.xxhash64(F.col(by).cast("string"), F.lit("language")), F.lit(1_000_000)) < F.col("share") * 1_000_000
    sample = rows.select(F.col(by), F.col(text).alias("text"), F.col(lang).alias("lang")).join(F.broadcast(wanted), F.col("lang") == F.col("of")).where(drawn)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, own in batch.groupby("lang"):
                hashes = [h for t in own["text"] for h in stretches(letters(t))]
                if hashes:
                    gram, n = np.unique(np.concatenate(hashes), return_counts=True)
                    yield pd.DataFrame({"lang": name, "gram": gram.view(np.int64), "n": n})

    counted = small_batches(sample.select("lang", "text")).mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = Window.partitionBy("lang")
    top = counted.withColumn("rank", F.row_number().over(totals.orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= 3 * GRAMS)
    top = staged(top.where("n > 1"), "language-grams").toPandas()  # at most 3 GRAMS rows of each language
    total = top.groupby("lang")["n"].transform("sum")
    top["rate"] = top["n"] / total
    top = top[top["rate"] >= SHARED * top.groupby("gram")["rate"].transform("max")]
    members = {}
    for r in sizes:
        own = top[top["lang"] == r["lang"]].sort_values(["n", "gram"], ascending=[False, True])[:GRAMS]
        members[r["lang"]] = own["gram"].to_numpy(np.int64).view(np.uint64)
    return Filters.build(members)


def predict(df: DataFrame, filters: Filters, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add ``lang`` and ``score`` for the whole text; columns with these names are replaced.

    Null texts and texts without a letter give ``und`` and 0. A text none of whose n-grams is known
    gives the first language and 0. Rows are independent of each other.
    """
    shared = df.sparkSession.sparkContext.broadcast(filters)  # 2 MB for each 64 languages

    @F.pandas_udf("lang string, score double")
    def found(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        return pd.DataFrame([own.predict(t) for t in texts], columns=["lang", "score"])

    got = small_batches(df).withColumn("__found", found(F.col(text)))
    return got.withColumn(lang, F.col("__found.lang")).withColumn(score, F.col("__found.score")).drop("__found")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the checksum of the id as text leaves 1 when divided by 3; null ids are held out of learning too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def identified(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all."""
    filters = learn(docs.where(~held_out()))
    return predict(dealt(docs.select("doc_id", "text")), filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
