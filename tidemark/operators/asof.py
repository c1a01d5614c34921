"""As-of joins: the last (or next) right-hand row seen from each left-hand row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import MAX_GROUP_ROWS, _parts_for, ordered_ranges


@dataclass(frozen=True)
class HotKeys:
    """Keys too large for one task; at most (rows / max_rows) of them, so they are held locally."""

    frame: DataFrame | None
    rows: int


def find_hot_keys(frames: Sequence[DataFrame], by: Sequence[str], max_rows: int = MAX_GROUP_ROWS) -> HotKeys:
    """One counting pass over the key columns of ``frames`` together.

    Chained as-of joins on the same keys share the answer, since a left join
    neither adds nor removes left rows.
    """
    keys = None
    for frame in frames:
        part = frame.select(*by).dropna()
        keys = part if keys is None else keys.unionByName(part)
    counts = keys.groupBy(*by).count().where(F.col("count") > max_rows).collect()
    if not counts:
        return HotKeys(None, 0)
    local = keys.sparkSession.createDataFrame([tuple(r[:-1]) for r in counts], keys.schema)
    return HotKeys(F.broadcast(local), sum(r[-1] for r in counts))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    payload: Sequence[str],
    direction: str = "backward",
    strict: bool = False,
    tie_break: Sequence[str] = (),
    tolerance: Column | None = None,
    matched_ts: str | None = None,
    max_rows: int = MAX_GROUP_ROWS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Left join each left row to its nearest right row on the time axis.

    Both sides are tagged, unioned and walked once per key, so the cost is one
    shuffle and no pairs are built. ``strict`` excludes equal instants.
    ``tolerance`` (an interval column) drops matches farther away than that.
    ``matched_ts`` names an output column for the right-hand instant. A key
    above ``max_rows`` is cut into time ranges, and the last right row of each
    range is handed to the next; ``hot`` passes on keys found earlier.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction must be backward or forward, not {direction!r}")
    by = list(by)
    left_type = left.schema
    carried = right.select(
        *by,
        F.col(right_ts).alias("_ts"),
        F.struct(F.col(right_ts).alias("_rts"), *payload).alias("_r"),
        F.struct(*tie_break, F.lit(0).alias("_z")).alias("_tie"),
    ).where(F.col("_ts").isNotNull())
    right_type = carried.schema["_r"].dataType
    tie_type = carried.schema["_tie"].dataType
    for key in by:
        carried = carried.where(F.col(key).isNotNull())
    # at equal instants the right row comes first unless equality is excluded
    right_side, left_side = (1, 0) if strict else (0, 1)
    rights = carried.select(
        *by, F.lit(0).cast("long").alias("_spread"), "_ts", F.lit(right_side).alias("_side"), "_tie",
        F.lit(None).cast(left_type).alias("_l"), "_r",
    )
    # a missing key or instant matches nothing: such rows are dealt out instead of piling up in one group
    hopeless = F.col(left_ts).isNull()
    for key in by:
        hopeless = hopeless | F.col(key).isNull()
    lefts = left.select(
        *by,
        F.when(hopeless, 1 + F.pmod(F.monotonically_increasing_id(), F.lit(65_536))).otherwise(F.lit(0)).alias("_spread"),
        F.col(left_ts).cast(carried.schema["_ts"].dataType).alias("_ts"),
        F.lit(left_side).alias("_side"),
        F.lit(None).cast(tie_type).alias("_tie"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_l"),
        F.lit(None).cast(right_type).alias("_r"),
    )
    both = rights.unionByName(lefts)
    group = [*by, "_spread"]
    if direction == "backward":
        order = [F.col("_ts").asc(), F.col("_side").asc(), F.col("_tie").asc()]
    else:
        order = [F.col("_ts").desc(), F.col("_side").asc(), F.col("_tie").desc()]

    upto = (Window.unboundedPreceding, Window.currentRow)

    def plain(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(*upto)
        return rows.withColumn("_hit", F.last("_r", ignorenulls=True).over(w))

    if hot is None:
        hot = find_hot_keys([left, right], by, max_rows)
    if hot.frame is None:
        walked = plain(both)
    else:
        cold = plain(both.join(hot.frame, by, "left_anti"))
        ranged = ordered_ranges(
            both.join(hot.frame, by, "left_semi"), [F.col(k) for k in by] + order, _parts_for(hot.rows, max_rows)
        )
        inside = Window.partitionBy("_part", *by).orderBy("_pos").rowsBetween(*upto)
        tails = ranged.groupBy("_part", *by).agg(
            F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_pos"))).alias("_tail")
        )
        earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        carry = tails.select("_part", *by, F.last("_tail", ignorenulls=True).over(earlier).alias("_carry"))
        split = (
            ranged.withColumn("_hit", F.last("_r", ignorenulls=True).over(inside))
            .join(carry, ["_part", *by])
            .withColumn("_hit", F.coalesce("_hit", "_carry"))
            .select(*cold.columns)
        )
        walked = cold.unionByName(split)

    found = walked.where(F.col("_l").isNotNull())
    usable = F.col("_ts").isNotNull()
    for key in by:
        usable = usable & F.col(key).isNotNull()
    if tolerance is not None:
        if direction == "backward":
            usable = usable & (F.col("_hit._rts") >= F.col("_ts") - tolerance)
        else:
            usable = usable & (F.col("_hit._rts") <= F.col("_ts") + tolerance)
    found = found.withColumn("_hit", F.when(usable, F.col("_hit")))
    extra = [F.col(f"_hit.{c}").alias(c) for c in payload]
    if matched_ts:
        extra.append(F.col("_hit._rts").alias(matched_ts))
    return found.select("_l.*", *extra)
