"""Running progress and time left of many runs, as their samples arrive.

State is one small row a run, whatever the number of its samples. Samples of a run must arrive in order of time
from trigger to trigger; within a trigger they are sorted. (The batch forms read all of a run and sort it.)
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafgraph.operators.progress import projection


def _runs(samples: DataFrame, step, output: str, state: str) -> DataFrame:
    rows = samples.select(F.col("run").cast("long").alias("run"), F.col("t").cast("double").alias("t"), F.col("fraction").cast("double").alias("fraction"))
    return rows.groupBy("run").applyInPandasWithState(step, output, state, "update", GroupStateTimeout.NoTimeout)


def running_progress(samples: DataFrame) -> DataFrame:
    """(run, progress) for runs with new samples (run, t, fraction): the largest fraction so far, 1 at most."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        most = state.get[0] if state.exists else 0.0
        for frame in frames:
            most = max(most, min(float(frame["fraction"].max()), 1.0))
        state.update((most,))
        yield pd.DataFrame({"run": [key[0]], "progress": [most]})

    return _runs(samples, step, "run long, progress double", "most double")


def time_left(samples: DataFrame) -> DataFrame:
    """(run, left) for runs with new samples (run, t: seconds since the run's start, fraction); null while none is shown."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (None,) * 4
        for t, fraction in sorted((t, f) for frame in frames for t, f in zip(frame["t"], frame["fraction"])):
            now = projection(now, float(t), float(fraction))
        state.update(now)
        yield pd.DataFrame({"run": pd.Series([key[0]], dtype="int64"), "left": pd.Series([now[3]], dtype="float64")})

    return _runs(samples, step, "run long, left double", "end double, at double, since double, left double")
