"""Block bootstrap of an information coefficient from per-block sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.evaluate import clean
from tidemark.operators.ordered import ordinal
from tidemark.session import durable


def block_sums(df: DataFrame, block: str, x: str, y: str) -> DataFrame:
    """Sufficient statistics of each block, staged once; ``slot`` numbers the blocks 0..K-1."""
    rows = df.select(F.col(block).alias("block"), clean(x).alias("_x"), clean(y).alias("_y")).dropna(
        subset=["_x", "_y"]
    )
    sums = rows.groupBy("block").agg(
        F.count("*").alias("n"),
        F.sum("_x").alias("sx"),
        F.sum("_y").alias("sy"),
        F.sum(F.col("_x") * F.col("_x")).alias("sxx"),
        F.sum(F.col("_y") * F.col("_y")).alias("syy"),
        F.sum(F.col("_x") * F.col("_y")).alias("sxy"),
    )
    return ordinal(durable(sums), ["block"], out="slot").withColumn("slot", F.col("slot") - 1)


def ic_from_sums() -> Column:
    """Pearson correlation out of aggregated sums named like ``block_sums``."""
    n, sx, sy = F.sum("n"), F.sum("sx"), F.sum("sy")
    cov = n * F.sum("sxy") - sx * sy
    vx, vy = n * F.sum("sxx") - sx * sx, n * F.sum("syy") - sy * sy
    return F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx) / F.sqrt(vy))


def bootstrap_draws(sums: DataFrame, n_boot: int = 10_000, seed: int = 20260731) -> DataFrame:
    """``n_boot`` resamples of K blocks out of K: one IC per resample.

    Draw j of resample b is the first 32 bits of the MD5 of "seed:b*K+j" modulo K, so the result does not
    depend on partitioning, on which executor runs it, or on the engine. The work is
    n_boot * K small rows, independent of the number of raw rows.
    """
    spark = sums.sparkSession
    k = sums.count()
    if k == 0:
        return spark.createDataFrame([], "b long, ic double")
    draws = spark.range(n_boot * k).select(
        F.floor(F.col("id") / k).alias("b"),
        F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(k).cast("long")).alias("slot"),
    )
    return draws.join(sums.drop("block"), "slot").groupBy("b").agg(ic_from_sums().alias("ic"))


def block_bootstrap_ic(
    df: DataFrame, block: str, x: str, y: str, n_boot: int = 10_000, seed: int = 20260731, ci: Sequence[float] = (0.025, 0.975)
) -> DataFrame:
    """Observed IC, confidence interval, SE, centred two-sided p and SE inflation, in one row."""
    sums = block_sums(df, block, x, y)
    observed = sums.agg(ic_from_sums().alias("ic"), F.sum("n").alias("n_obs"), F.count("*").alias("n_blocks"))
    drawn = bootstrap_draws(sums, n_boot, seed).where(F.col("ic").isNotNull())
    draws = durable(drawn.withColumnRenamed("ic", "draw"))
    centre = draws.agg(F.avg("draw").alias("_mean"))
    paired = draws.join(centre).join(observed.select(F.col("ic").alias("_obs")))  # two one-row tables
    spread = paired.agg(
        F.percentile("draw", F.array(*[F.lit(c) for c in ci])).alias("_ci"),
        F.stddev_pop("draw").alias("se"),
        F.avg((F.abs(F.col("draw") - F.col("_mean")) >= F.abs("_obs")).cast("double")).alias("p"),
    )
    out = observed.join(spread)  # one row each
    naive = F.sqrt(F.try_divide(1 - F.col("ic") * F.col("ic"), F.col("n_obs") - 2))
    return out.select(
        "ic", "n_obs", "n_blocks", F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"), "se", "p",
        naive.alias("naive_se"), F.try_divide(F.col("se"), naive).alias("se_inflation"),
    )
