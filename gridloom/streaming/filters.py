"""State that runs along each key's events: a Kalman filter of one hidden value, in a stream or over a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import scans

OUT = "at timestamp, id long, estimate double, variance double"


def kalman(events: DataFrame, drift: float = 0.01, noise: float = 1.0, key: str = "event_type", value: str = "value", at: str = "ts", id_: str = "event_id") -> DataFrame:
    """(key, at, id, estimate, variance) after each event, in order of time and id. The first known value starts the filter, later
    ones correct what was predicted, and unknown ones only let the variance grow.

    The state of a key is two numbers. In a stream it outlives the micro-batches; over a batch keys are cut into
    ranges of time, whose steps are put together, so a hot key is no hot task.
    """
    kind = dict(events.dtypes)[key]
    some = events.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(id_).cast("long").alias("id"), F.col(value).cast("double").alias("value"))
    if not events.isStreaming:
        made = scans.local_level(some.where(F.col("key").isNotNull()), "value", "estimate", ["key"], ["at", "id"], drift, noise)
        return made.select("key", "at", "id", "estimate", F.col("estimate_variance").alias("variance"))
    model = scans.LocalLevel(drift, noise)

    def grouped(k: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        made, state = model.run(rows["value"].to_numpy(dtype=float, na_value=np.nan), np.array(held.get) if held.exists else None)
        if state is not None:
            held.update(tuple(float(x) for x in state))
        unknown = lambda x: pd.Series(x, rows.index).astype(object).where(~np.isnan(x), None)
        out = rows[["at", "id"]].assign(estimate=unknown(made[:, 0]), variance=unknown(made[:, 1]))
        out.insert(0, "key", k[0])
        yield out

    return some.groupBy("key").applyInPandasWithState(grouped, f"key {kind}, {OUT}", "mean double, variance double", "append", "NoTimeout")
