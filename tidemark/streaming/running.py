"""The as-of statistics over a stream of events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

EPOCH = np.datetime64("1970-01-01")


def window_totals(events: DataFrame, time: str, keys: list[str], value: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by key and window; a window closes ``late`` after the newest event."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def career_stream(events: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each event with its key's count and sum of earlier days, as batches arrive.

    A key's state is its closed days' totals and the open day's.  Days are expected in order: an
    event of an earlier day counts from now on but changes nothing that was told.
    """
    kind = events.schema[key].dataType.simpleString()

    def step(keys, frames, state):
        n, total, day, day_n, day_total = state.get if state.exists else (0, 0.0, None, 0, 0.0)
        for frame in frames:
            frame = frame.sort_values(time, kind="stable")
            if not len(frame):
                continue
            days = (frame[time].to_numpy("datetime64[D]") - EPOCH).astype(np.int64)
            day = int(days[0]) if day is None else day
            days = np.maximum(days, day)  # what is late counts as of the open day
            value_ = frame[value].fillna(0.0).to_numpy(np.float64)
            sums, first = np.r_[0.0, np.cumsum(value_)], np.searchsorted(days, days)  # rows of the frame before each row's day
            closed = days > day
            yield pd.DataFrame({key: keys[0], time: frame[time], value: frame[value], "n_before": n + first + closed * day_n, "sum_before": total + sums[first] + closed * day_total})[[key, time, value, "n_before", "sum_before"]]
            last = int(np.searchsorted(days, days[-1]))
            if days[-1] > day:
                n, total, day, day_n, day_total = n + day_n + last, total + day_total + float(sums[last]), int(days[-1]), 0, 0.0
            day_n, day_total = day_n + len(days) - last, day_total + float(sums[-1] - sums[last])
        state.update((n, total, day, day_n, day_total))

    return events.select(key, time, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {time} timestamp, {value} double, n_before long, sum_before double", "n long, total double, day long, day_n long, day_total double", "append", GroupStateTimeout.NoTimeout)
