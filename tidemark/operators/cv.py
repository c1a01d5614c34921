"""Purged, combinatorial and walk-forward splits.

Fold edges are a handful of exact order statistics, found once. After that a
row's fold and its purge state are comparisons with literals, so assigning
folds to the big table needs no shuffle and no range join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import MAX_GROUP_ROWS, bucket_of, order_statistics, typed_lit


WORD = 62  # blocks in one word of a mask


@dataclass(frozen=True)
class Block:
    """One contiguous run of rows in time order; ``start`` and ``end`` are its outer instants."""

    number: int
    first_key: tuple
    start: datetime
    end: datetime


def _blocks(df: DataFrame, ts: str, tie: Sequence[str], k: int, max_rows: int) -> list[Block]:
    n = df.count()
    if n < k:
        raise ValueError(f"{n} rows cannot fill {k} folds")
    base, extra = divmod(n, k)  # the first n mod k blocks hold one row more
    sizes = [base + (i < extra) for i in range(k)]
    firsts, at = [], 1
    for size in sizes:
        firsts.append(at)
        at += size
    lasts = [f + s - 1 for f, s in zip(firsts, sizes)]
    found = order_statistics(df, [ts, *tie], firsts + lasts, max_rows, total=n)
    return [Block(i, found[f], found[f][0], found[l][0]) for i, (f, l) in enumerate(zip(firsts, lasts))]


def _block_number(df: DataFrame, ts: str, tie: Sequence[str], blocks: Sequence[Block]) -> Column:
    return bucket_of([ts, *tie], [b.first_key for b in blocks[1:]], df.schema)


def _shut_out(df: DataFrame, ts: str, block: Block, horizon: timedelta, embargo: timedelta) -> Column:
    """Label window [t, t+horizon] touches the block, or t lies in the embargo after it."""
    t, kind = F.col(ts), df.schema[ts].dataType
    start, end, cool = (typed_lit(v, kind) for v in (block.start - horizon, block.end, block.end + embargo))
    overlaps = (t <= end) & (t >= start)
    cooling = (t > end) & (t <= cool)
    return overlaps | cooling


def purged_kfold(
    df: DataFrame, ts: str, tie: Sequence[str], n_splits: int = 5,
    horizon: timedelta = timedelta(days=28), embargo: timedelta = timedelta(days=5),
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Every row of ``df`` once per fold with ``role`` train or test; purged rows are absent."""
    blocks = _blocks(df, ts, tie, n_splits, max_rows)
    tagged = df.withColumn("_b", _block_number(df, ts, tie, blocks))
    roles = [
        F.struct(
            F.lit(b.number).alias("fold"),
            F.when(F.col("_b") == b.number, "test")
            .when(~_shut_out(df, ts, b, horizon, embargo), "train")
            .alias("role"),
        )
        for b in blocks
    ]
    out = tagged.withColumn("_r", F.explode(F.array(*roles))).where(F.col("_r.role").isNotNull())
    return out.select(*df.columns, "_r.fold", "_r.role")


def combinatorial_purged(
    df: DataFrame, ts: str, tie: Sequence[str], n_groups: int = 10, n_test: int = 2,
    horizon: timedelta = timedelta(days=28), embargo: timedelta = timedelta(days=5),
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Every combination of ``n_test`` blocks as test set, purged around each block.

    A row carries two sets of blocks as bit masks: its own block and the blocks that shut it out. A
    combination is a third set, so each role is two bitwise tests. Masks have as many words of
    62 bits as the number of blocks asks for.
    """
    blocks = _blocks(df, ts, tie, n_groups, max_rows)
    words = range(-(-n_groups // WORD))

    def word(numbers: Sequence[int], w: int) -> int:
        return sum(1 << (g - w * WORD) for g in numbers if g // WORD == w)

    tagged = df.withColumn("_b", _block_number(df, ts, tie, blocks))
    for w in words:
        own, barred = F.lit(0).cast("long"), F.lit(0).cast("long")
        for b in blocks:
            if b.number // WORD == w:
                bit = F.lit(1 << (b.number - w * WORD)).cast("long")
                own = F.when(F.col("_b") == b.number, bit).otherwise(own)
                barred = barred.bitwiseOR(F.when(_shut_out(df, ts, b, horizon, embargo), bit).otherwise(F.lit(0).cast("long")))
        tagged = tagged.withColumn(f"_own{w}", own).withColumn(f"_bar{w}", barred)
    combos = [
        F.struct(F.lit(i).alias("combo"), *[F.lit(word(c, w)).cast("long").alias(f"m{w}") for w in words])
        for i, c in enumerate(combinations(range(n_groups), n_test))
    ]
    each = tagged.withColumn("_c", F.explode(F.array(*combos)))
    tested, shut = F.lit(False), F.lit(False)
    for w in words:
        tested = tested | (F.col(f"_own{w}").bitwiseAND(F.col(f"_c.m{w}")) != 0)
        shut = shut | (F.col(f"_bar{w}").bitwiseAND(F.col(f"_c.m{w}")) != 0)
    out = each.withColumn("role", F.when(tested, "test").when(~shut, "train")).where(F.col("role").isNotNull())
    return out.select(*df.columns, F.col("_c.combo").alias("combo"), "role")


def walk_forward(
    df: DataFrame, ts: str, train_window: timedelta, test_window: timedelta, step: timedelta,
    anchored: bool = True, embargo: timedelta = timedelta(days=5),
) -> DataFrame:
    """Half-open test windows moving by ``step``; the train tail within the embargo is dropped.

    Folds without train or without test rows are removed, as they cannot be scored.
    """
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    windows, at = [], None if lo is None else lo + train_window
    while at is not None and at + test_window <= hi:
        windows.append((len(windows), lo if anchored else at - train_window, at - embargo, at, at + test_window))
        at = at + step
    if not windows:
        raise ValueError("the time span is shorter than one train plus one test window")
    t = F.col(ts)

    def placed(rows: DataFrame, specs: list) -> DataFrame:
        fields = ("fold", "train_start", "train_end", "test_start", "test_end")
        spec = F.array(*[F.struct(*[typed_lit(v, df.schema[ts].dataType).alias(f) for f, v in zip(fields, w)]) for w in specs])
        hits = F.filter(
            spec,
            lambda w: ((t >= w["train_start"]) & (t < w["train_end"])) | ((t >= w["test_start"]) & (t < w["test_end"])),
        )
        out = rows.withColumn("_w", F.explode(hits))
        role = F.when(t >= F.col("_w.test_start"), "test").otherwise("train")
        return out.select(*rows.columns, "_w.fold", "_w.test_start", "_w.test_end", role.alias("role"))

    # one row per fold comes back to the driver, which then leaves unusable folds out of the spec
    sides = placed(df.select(ts), windows).groupBy("fold").agg(F.countDistinct("role").alias("k")).collect()
    usable = {r["fold"] for r in sides if r["k"] == 2}
    kept = [w for w in windows if w[0] in usable]
    if not kept:
        raise ValueError("no fold has both train and test rows")
    return placed(df, kept)


def fold_sizes(folds: DataFrame, key: str = "fold") -> DataFrame:
    return folds.groupBy(key).agg(
        F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test")
    )
