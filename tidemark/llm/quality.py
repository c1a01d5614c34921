"""Quality rules as a short-circuit cascade, ordered by rejection per cost as measured on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pinned, staged

BLANK = "\\x20\\x09-\\x0D"  # fixed: what separates words
SYMBOLS = "[#*$%&|<>]"  # fixed
WINDOW = 8  # words that make a repeated passage
SAMPLE_ROWS = 2_000  # rows on which costs and selectivities are estimated


@dataclass(frozen=True)
class Rule:
    """A row is rejected where ``fails`` is true; null counts as passing."""

    name: str
    fails: Callable[[], Column]


@dataclass(frozen=True)
class Estimate:
    name: str
    rejects: float
    seconds: float

    @property
    def worth(self) -> float:
        """Rejected share of rows per second."""
        return self.rejects / max(self.seconds, 1e-6)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+"), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more; ``words`` must be a pinned value.

    Hashes of the windows show whether any may repeat; only then are the windows themselves sorted
    and compared with their neighbours, so the count is exact.
    """
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)

    def counted(windows: Column) -> Column:
        same = F.filter(
            windows,
            lambda x, k: F.coalesce(x["w"] == F.get(windows, k - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(windows, k + 1)["w"], F.lit(False)),
        )
        return F.aggregate(
            F.sort_array(F.transform(same, lambda x: x["at"])),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, at: F.struct((acc["n"] + at + WINDOW - F.greatest(acc["end"], at)).alias("n"), (at + WINDOW).alias("end")),
            lambda acc: acc["n"],
        )

    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(WINDOW))))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i + 1, F.lit(WINDOW)), " ").alias("w"), i.alias("at"))))
    found = pinned(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), pinned(windows, counted)).otherwise(F.lit(0)))
    return F.when(F.size(words) > WINDOW, found).otherwise(F.lit(0))


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of the whole text.

    Null and empty texts count 0 throughout. Columns with these names are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    counts = pinned(
        F.struct(words_of(F.col(text)).alias("words"), lines.alias("lines")),
        lambda x: F.struct(
            F.size(x["words"]).cast("long").alias("n_words"),
            F.length(F.array_join(x["words"], "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(F.array_join(x["words"], ""), f"{SYMBOLS}+", "")).cast("long").alias("plain"),
            F.size(x["lines"]).cast("long").alias("n_lines"),
            (F.size(x["lines"]) - F.size(F.array_distinct(x["lines"]))).cast("long").alias("n_dup_lines"),
            repeated_words(x["words"]).cast("long").alias("n_repeat_words"),
        ),
    )
    names = ("n_words", "word_chars", "n_lines", "n_dup_lines", "n_repeat_words")
    got = df.withColumn("__counts", counts)
    return got.withColumns(
        {n: F.col(f"__counts.{n}") for n in names} | {"n_symbols": F.col("__counts.word_chars") - F.col("__counts.plain")}
    ).drop("__counts")


def share(part: Column, of: Column) -> Column:
    return part / F.nullif(of, F.lit(0))


def shouting(text: Column) -> Column:
    """Share of letters that are capitals."""
    capitals = F.length(F.regexp_replace(text, "[^\\p{Lu}]+", ""))
    return share(capitals, F.length(F.regexp_replace(text, "[^\\p{L}]+", "")))


def lettered(text: Column) -> Column:
    """Share of words that hold a letter."""
    return pinned(words_of(text), lambda w: share(F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))), F.size(w)))


def document_rules(text: str = "text") -> tuple[Rule, ...]:
    """Rules over a whole text and the columns of with_counts."""
    c = F.col
    return (
        Rule("few_words", lambda: c("n_words") < 20),
        Rule("repeated_passages", lambda: 100 * c("n_repeat_words") > 30 * c("n_words")),
        Rule("symbols", lambda: share(c("n_symbols"), c("n_words")) > 0.3),
        Rule("repeated_lines", lambda: (c("n_dup_lines") > 2) & (share(c("n_dup_lines"), c("n_lines")) > 0.3)),  # not a frame of one line
        Rule("word_length", lambda: ~share(c("word_chars"), c("n_words")).between(2.0, 15.0)),
        Rule("capitals", lambda: shouting(c(text)) > 0.5),
        Rule("no_letters", lambda: lettered(c(text)) < 0.6),
    )


def estimates(df: DataFrame, rules: tuple[Rule, ...], rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Estimate]:
    """Share of rows that each rule rejects and the seconds it takes, on a sample of about ``rows`` rows."""
    n = df.count()
    sample = staged(df.sample(min(1.0, rows / n), seed) if n else df, "quality-sample")
    sample.agg(F.count(F.lit(1))).collect()
    out = []
    for rule in rules:
        share_of = sample.agg(F.avg(F.coalesce(rule.fails(), F.lit(False)).cast("double")).alias("rejects"))
        best = None
        for _ in range(2):  # the first run also compiles
            began = time.perf_counter()
            rejects = share_of.collect()[0].rejects or 0.0
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        out.append(Estimate(rule.name, rejects, best))
    return out


def cascade(df: DataFrame, rules: tuple[Rule, ...], order: list[Estimate] | None = None) -> DataFrame:
    """Add kept and rejected_by, trying the rules in the order of rejected rows per second.

    A row is judged until the first rule that rejects it; the others are not evaluated for it. The order
    changes the time and which of several failing rules is named, never kept. ``order`` may hold earlier
    estimates; a rule without one comes last, ties keep the given order.
    """
    worth = {e.name: e.worth for e in (estimates(df, rules) if order is None else order)}
    ranked = sorted(rules, key=lambda r: -worth.get(r.name, -1.0))
    by = F.lit(None).cast("string")
    for rule in reversed(ranked):
        by = F.when(F.coalesce(rule.fails(), F.lit(False)), F.lit(rule.name)).otherwise(by)
    return df.withColumn("rejected_by", by).withColumn("kept", F.col("rejected_by").isNull())
