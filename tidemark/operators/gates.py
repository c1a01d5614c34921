"""Checks, gates and stage records."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.session import durable


class GateFailure(RuntimeError):
    """A hard check failed; the pipeline stops here."""


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Schema check on the driver, no job."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


@dataclass
class Check:
    name: str
    passed: bool
    value: float | int | str | None = None
    message: str = ""
    hard: bool = True


def gate(name: str, passed: bool, value=None, message: str = "", hard: bool = True) -> Check:
    """G1: record a check and raise when a hard one fails."""
    check = Check(name, bool(passed), value, message, hard)
    if hard and not check.passed:
        raise GateFailure(f"{name}: value={value!r} {message}".strip())
    return check


def gate_rows(df: DataFrame, name: str, violation: Column, hard: bool = True) -> Check:
    """G1 over a table: no row may satisfy ``violation``."""
    bad = df.agg(F.count_if(violation)).first()[0]
    return gate(name, bad == 0, int(bad), f"{bad} rows violate the rule", hard)


@dataclass
class StageLog:
    """What one stage read, wrote and checked."""

    stage: str
    rows_in: int
    rows_out: int
    seconds: float
    finished_at: str
    checks: list[Check] = field(default_factory=list)

    @property
    def all_hard_checks_passed(self) -> bool:
        return all(c.passed for c in self.checks if c.hard)

    def to_row(self) -> dict:
        row = asdict(self)
        row["checks"] = [
            {**asdict(c), "value": None if c.value is None else str(c.value)} for c in self.checks
        ]
        row["all_hard_checks_passed"] = self.all_hard_checks_passed
        return row


STAGE_LOG_SCHEMA = (
    "stage string, rows_in long, rows_out long, seconds double, finished_at string, "
    "checks array<struct<name:string,passed:boolean,value:string,message:string,hard:boolean>>, "
    "all_hard_checks_passed boolean"
)


def stage_logs_frame(spark: SparkSession, logs: Sequence[StageLog]) -> DataFrame:
    """K5: stage records as a DataFrame, ready for ``write.json``."""
    return spark.createDataFrame([log.to_row() for log in logs], STAGE_LOG_SCHEMA)


def run_stage(
    name: str, source: DataFrame, build: Callable[[DataFrame], DataFrame],
    checks: Callable[[DataFrame], Sequence[Check]] = lambda out: (),
) -> tuple[DataFrame, StageLog]:
    """Run one stage, stage its output and record what went in and came out.

    Rows are counted while the stage's own job writes its output to reliable storage, so nothing is read again to be
    counted, and a later stage restarts from the output. Rows in are those that the stage took from ``source``. A failed
    hard check raises from here.
    """
    start = time.monotonic()
    rows_in, rows_out = Observation(), Observation()
    counted = F.count(F.lit(1)).alias("n")
    out = durable(build(source.observe(rows_in, counted)).observe(rows_out, counted))
    found = list(checks(out))
    finished = datetime.now(timezone.utc).isoformat()
    log = StageLog(name, rows_in.get.get("n", 0), rows_out.get.get("n", 0), time.monotonic() - start, finished, found)
    return out, log
