"""Ordered computations that stay distributed when one key is huge.

A Spark window sends each partition key to one task. That is right for keys of
bounded size and wrong for a key that holds a third of the table, and for
windows with no key at all. Without keys the operators here always
range-partition on the order, freeze that layout on reliable storage, work
inside each range and carry one summary row per range to the next. With keys
they measure the largest group first: up to ``max_rows`` they emit the plain
one-shuffle window, beyond it the ranges. Both ways give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import durable

# Rows one task may hold in a single ordered group (window buffers spill beyond memory).
MAX_GROUP_ROWS = 4_000_000

# Distinct values the built-in exact percentile may hold in one aggregation buffer.
MAX_PERCENTILE_ROWS = 1_000_000

_LOCAL_BITS = 33  # monotonically_increasing_id = partition number << 33 | row position


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest key; partial aggregation keeps the shuffle small."""
    if keys:
        row = df.groupBy(*keys).count().agg(F.max("count")).first()
        return int(row[0] or 0)
    return df.count()


def ordered_ranges(df: DataFrame, order: Sequence[Column | str], parts: int) -> DataFrame:
    """Totally order ``df`` over ``parts`` ranges and freeze it.

    Adds ``_part`` (range number) and ``_pos`` (position inside the range).
    The freeze matters: range bounds come from a sample and would differ if
    the shuffle ran a second time.
    """
    laid_out = (
        df.repartitionByRange(max(parts, 1), *order)
        .sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
    )
    frozen = durable(laid_out)
    return (
        frozen.withColumn("_part", F.shiftright("_m", _LOCAL_BITS))
        .withColumn("_pos", F.col("_m").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("_m")
    )


def _parts_for(total: int, max_rows: int) -> int:
    # twice the minimum, so sampling error in the bounds keeps ranges under max_rows
    return max(2, 2 * math.ceil(total / max_rows))


def _as_columns(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def ordinal(
    df: DataFrame,
    order: Sequence[Column | str],
    keys: Sequence[str] = (),
    out: str = "idx",
    max_rows: int = MAX_GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """1-based row number per key (or over the whole table) in ``order``.

    ``largest`` passes on the size of the biggest group when it is known.
    """
    keys, order = list(keys), _as_columns(order)
    most = largest if largest is not None else largest_group(df, keys)
    if keys and most <= max_rows:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, F.row_number().over(w).cast("long"))
    frozen = ordered_ranges(df, [F.col(k) for k in keys] + order, _parts_for(df.count() if keys else most, max_rows))
    # one row per range: bounded by the number of ranges, not by the data
    sizes = frozen.groupBy("_part").count()
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_off"))
    placed = frozen.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_off") + F.col("_pos") + 1)
    placed = placed.drop("_part", "_pos", "_off")
    if not keys:
        return placed
    start = placed.groupBy(*keys).agg(F.min(out).alias("_start"))
    return placed.join(start, keys).withColumn(out, F.col(out) - F.col("_start") + 1).drop("_start")


def running_total(
    df: DataFrame,
    order: Sequence[Column | str],
    value: str,
    keys: Sequence[str] = (),
    out: str = "running",
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Inclusive running sum of ``value`` per key in ``order``."""
    keys, order = list(keys), _as_columns(order)
    upto = (Window.unboundedPreceding, Window.currentRow)
    most = largest_group(df, keys)
    if keys and most <= max_rows:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)
        return df.withColumn(out, F.sum(value).over(w))
    frozen = ordered_ranges(df, [F.col(k) for k in keys] + order, _parts_for(df.count() if keys else most, max_rows))
    local = F.sum(value).over(Window.partitionBy("_part", *keys).orderBy("_pos").rowsBetween(*upto))
    sums = frozen.groupBy("_part", *keys).agg(F.sum(value).alias("_s"))
    prior = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("_part", *keys, F.coalesce(F.sum("_s").over(prior), F.lit(0)).alias("_carry"))
    return (
        frozen.withColumn("_local", local)
        .join(carry, ["_part", *keys])
        .withColumn(out, F.col("_local") + F.col("_carry"))
        .drop("_part", "_pos", "_local", "_carry")
    )


# Rows whose order is found inside one aggregation buffer; larger bands are narrowed again.
BAND_ROWS = 20_000

SKETCH_ACCURACY = 10_000  # a quantile of the sketch is off by at most one row in this many

_SKETCHED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def order_statistics(
    df: DataFrame, order: Sequence[str], positions: Sequence[int], max_rows: int = MAX_GROUP_ROWS,
    total: int | None = None, band_rows: int = BAND_ROWS,
) -> dict[int, tuple]:
    """The exact rows at the given 1-based positions of the total order (NULL first, NaN last).

    A mergeable quantile sketch of the first column gives a value on either side of each position; one pass
    counts the rows below, at and between these values exactly. Bands of up to ``band_rows`` rows are ordered
    in one aggregate, larger ones between two values are narrowed again, and those of a single value go on
    with the next column. Only rows of small bands are shuffled and nothing is written. Columns without a
    sketch (text) are ordered in ranges, for the rows of their band only.

    Returns one small tuple per requested position, so the driver holds as many rows as were asked for
    and no more. Positions outside 1 to the row count are absent.
    """
    rows, order = df.select(*order), list(order)
    n = total if total is not None else rows.count()
    wanted = sorted({p for p in positions if 1 <= p <= n})
    return _select(rows, order, 0, wanted, n, max_rows, band_rows)


def _select(rows: DataFrame, order: list[str], depth: int, wanted: list[int], n: int, max_rows: int, band_rows: int) -> dict[int, tuple]:
    """``order_statistics`` for rows that are equal in the first ``depth`` columns."""
    if not wanted:
        return {}
    if n <= band_rows:
        return _pick(rows, order, F.lit(0), [(0, wanted, 0)])
    if depth == len(order):  # all rows are equal
        same = tuple(rows.first())
        return dict.fromkeys(wanted, same)
    name, kind = order[depth], rows.schema[order[depth]].dataType
    if not isinstance(kind, _SKETCHED):
        return _in_ranges(rows, order, wanted, n, max_rows)
    c = F.col(name)
    special = F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(False)
    slack, runs = 2.0 / SKETCH_ACCURACY, []
    for p in wanted:  # neighbouring positions share the values around them
        if runs and p - runs[-1][1] <= slack * n:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    shares = sorted({0.0, 1.0, *(max(p / n - slack, 0.0) for p, _ in runs), *(min(p / n + slack, 1.0) for _, p in runs)})
    marks = rows.agg(F.percentile_approx(F.when(~special, c), F.array(*map(F.lit, shares)), SKETCH_ACCURACY)).first()[0]
    points = sorted(set(marks or ()))
    # bands by number: -1 NULL; 2i below point i and above the one before; 2i + 1 at point i; the last but one above all; then NaN
    band = F.when(c.isNull(), -1).when(special, 2 * len(points) + 1).otherwise(_band_of(c, [typed_lit(x, kind) for x in points]))
    sizes = {r["_band"]: r["count"] for r in rows.groupBy(band.alias("_band")).count().collect()}
    found, small, before = {}, [], 0
    for number in sorted(sizes):
        size, single = sizes[number], number % 2 == 1
        here = [p for p in wanted if before < p <= before + size]
        if here and size <= band_rows:
            small.append((number, here, before))
        elif here and (single or size < n):
            part = _select(rows.where(band == number), order, depth + single, [p - before for p in here], size, max_rows, band_rows)
            found |= {p + before: row for p, row in part.items()}
        elif here:  # the sketch did not narrow the rows
            found |= _in_ranges(rows, order, here, n, max_rows)
        before += size
    return found | _pick(rows, order, band, small)


def _band_of(c: Column, points: list[Column]) -> Column:
    """2i + 1 at the i-th ascending point, 2i below it and above the one before, as a balanced CASE tree."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(2 * lo)
        mid = (lo + hi) // 2
        return F.when(c < points[mid], tree(lo, mid)).when(c == points[mid], 2 * mid + 1).otherwise(tree(mid + 1, hi))

    return tree(0, len(points))


def _in_ranges(rows: DataFrame, order: list[str], wanted: list[int], n: int, max_rows: int) -> dict[int, tuple]:
    if not wanted:
        return {}
    placed = ordinal(rows, order, out="_idx", max_rows=max_rows, largest=n)
    return {int(r["_idx"]): tuple(r[c] for c in order) for r in placed.where(F.col("_idx").isin(wanted)).collect()}


def _pick(rows: DataFrame, order: list[str], band: Column, bands: list[tuple[int, list[int], int]]) -> dict[int, tuple]:
    """Rows at positions inside small bands: (band number, positions, rows before it). One job for all bands."""
    if not bands:
        return {}
    places = F.lit(None).cast("array<int>")
    for number, wanted, before in bands:
        places = F.when(F.col("_band") == number, F.array(*[F.lit(p - before) for p in wanted])).otherwise(places)
    got = (
        rows.withColumn("_band", band).where(F.col("_band").isin([number for number, _, _ in bands])).groupBy("_band")
        .agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_rows"))
        .select("_band", F.transform(places, lambda p: F.element_at("_rows", p)).alias("_hits")).collect()
    )
    hits = {r["_band"]: r["_hits"] for r in got}
    return {p: tuple(hit) for number, wanted, _ in bands for p, hit in zip(wanted, hits[number])}


def typed_lit(value, like: T.DataType | None = None) -> Column:
    """A literal of the column type it is compared with.

    ``F.lit`` turns a naive datetime into an instant of the session zone;
    against a wall-clock column it has to stay a wall clock.
    """
    if isinstance(value, datetime) and isinstance(like, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def bucket_of(columns: Sequence[str], bounds: Sequence[tuple], schema: T.StructType | None = None) -> Column:
    """How many of the ascending ``bounds`` are <= the row, as a balanced CASE tree.

    Map-only and codegen friendly; meant for fold and query-time edges (tens of
    values), where it replaces a shuffle or a range join.
    """

    def at_least(bound: tuple) -> Column:
        test = F.lit(True)
        for name, v in reversed(list(zip(columns, bound))):
            c, edge = F.col(name), typed_lit(v, schema[name].dataType if schema else None)
            test = (c > edge) | ((c == edge) & test)
        return test

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(at_least(bounds[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def grouped_percentile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    out: str = "pct",
    max_rows: int = MAX_PERCENTILE_ROWS,
) -> DataFrame:
    """Exact linear-interpolated percentiles per key as an array column.

    The built-in exact aggregate keeps every distinct value of a group in one
    buffer. Groups above ``max_rows`` are ranked through ``ordinal`` instead,
    and only the rows next to each target rank are aggregated.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    direct = F.percentile("_v", F.array(*[F.lit(p) for p in probs])).alias(out)
    if not keys:
        rows = rows.withColumn("_all", F.lit(1))
        return grouped_percentile(rows, ["_all"], "_v", probs, out, max_rows).drop("_all")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > max_rows)
    found = sizes.collect()  # at most (rows / max_rows) groups are this large
    if not found:
        return rows.groupBy(*keys).agg(direct)
    hot = F.broadcast(rows.sparkSession.createDataFrame([tuple(r) for r in found], sizes.schema))
    cold = rows.join(hot, keys, "left_anti").groupBy(*keys).agg(direct)
    ranked = ordinal(rows.join(hot, keys, "left_semi"), ["_v"], keys, "_rn", max_rows)
    spots = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("_n") - 1)).alias("x"))
                      for i, p in enumerate(probs)])
    near = (
        ranked.join(hot, keys)
        .withColumn("_spot", F.explode(spots))
        .where(
            (F.col("_rn") - 1 == F.floor("_spot.x")) | (F.col("_rn") - 1 == F.ceil("_spot.x"))
        )
        .groupBy(*keys, "_spot")
        .agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_p", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_spot.x") - F.floor("_spot.x")))
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_spot.i", "_p"))), lambda s: s["_p"]).alias(out))
    )
    return cold.unionByName(near)


def average_rank(
    df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "rank_avg", max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Ranks with ties sharing their mean rank.

    Ties are counted before the shuffle, so a value repeated by a third of the
    rows costs one row per task, and the ranks are joined back on the value.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    upto = running_total(counts, [value], "_c", keys, "_upto", max_rows)
    ranks = upto.select(*keys, value, (F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2.0).alias(out))
    return df.join(ranks, [*keys, value])


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: Sequence[str]) -> DataFrame:
    """One row per key, the greatest by ``order``: partial aggregation, no window."""
    order = _as_columns(order)
    picked = F.max_by(F.struct(*keep), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("_r")).select(*keys, "_r.*")


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``order`` (keep-first dedup, W8, O3)."""
    order = _as_columns(order)
    picked = F.min_by(F.struct(*keep), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("_r")).select(*keys, "_r.*")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, out: str = "rn") -> DataFrame:
    """First ``n`` rows per key. Spark limits each task to n rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*_as_columns(order))
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)
