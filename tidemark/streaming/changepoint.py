"""M7 on a stream: run lengths per entity, state carried between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType

from tidemark.operators.models import ChangepointPrior, RunLengths


def stream_run_lengths(
    stream: DataFrame, entity: str, date: str, value: str, prior: ChangepointPrior = ChangepointPrior()
) -> DataFrame:
    """Append one row per new observation with its most likely run length.

    A key's values must arrive in date order across micro-batches; inside a
    batch they are sorted. State per key is three numbers for each run length,
    so it grows with the calendar, as the recursion keeps every run length.
    """
    rows = stream.select(entity, date, value).where(f"{value} IS NOT NULL AND NOT isnan({value})")
    output = rows.select(entity, date).schema.add("run_length", IntegerType())

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = RunLengths.unpack(state.get[0]) if state.exists else RunLengths.fresh()
        pdf = pd.concat(list(batches)).sort_values(date)
        lengths = [int(runs.observe(np.array([x]), prior)[0]) for x in pdf[value]]
        state.update((runs.pack(),))
        yield pd.DataFrame(
            {entity: pdf[entity].to_numpy(), date: pdf[date].to_numpy(), "run_length": pd.array(lengths, dtype="int32")}
        )

    return rows.groupBy(entity).applyInPandasWithState(
        update, output, "runs array<double>", "append", GroupStateTimeout.NoTimeout
    )
