"""Series with state: smoothing and windows, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.operators.ordering import running
from marginalia.scratch import Scratch

ALPHA = 0.3


def ewma(values: Column, alpha: float = ALPHA) -> Column:
    """The last smoothed value of an ordered array; the first value primes it."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda s, x: F.coalesce(alpha * x + (1 - alpha) * s, x.cast("double")))


def smoothed(events: DataFrame, by: str, time: str, value: str, tie: str, alpha: float = ALPHA) -> DataFrame:
    """``(by, n, smoothed)``, a row for each series.

    The last smoothed value is a sum: ``alpha (1 - alpha)^j`` times the value j
    places from the end, and ``(1 - alpha)^(n - 1)`` times the first, which
    primes it. Places are counted range by range, so that a long series is many
    ranges, and sums are added up before they are shuffled.
    """
    rows = events.where(F.col(value).isNotNull()).select(by, time, tie, F.col(value).cast("double").alias("__v"))
    placed = running(Scratch(events.sparkSession, "smoothed"), rows, [F.col(by), F.col(time), F.col(tie)], {"__at": F.lit(1)})
    series = rows.groupBy(by).agg(F.count("*").cast("int").alias("n"))
    ends = running(Scratch(events.sparkSession, "smoothed"), series, [F.col(by)], {"__start": F.col("n")})
    there = placed.join(ends.withColumnRenamed(by, "__by").hint("merge"), F.col(by).eqNullSafe(F.col("__by")))
    after = F.col("__start") + F.col("n") - 1 - F.col("__at")
    weight = F.pow(F.lit(1 - alpha), after) * F.when(F.col("__at") == F.col("__start"), 1.0).otherwise(alpha)
    return there.groupBy(by).agg(F.first("n").alias("n"), F.sum(weight * F.col("__v")).alias("smoothed"))


def smoothed_stream(events: DataFrame, by: str, value: str) -> DataFrame:
    """The same over a stream, series by series; each batch gives the series' value so far."""
    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, s = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            for x in pdf.sort_values("ts")[value]:
                s = float(x) if n == 0 else ALPHA * float(x) + (1 - ALPHA) * s
                n += 1
        state.update((n, s))
        yield pd.DataFrame({by: [key[0]], "n": [n], "smoothed": [s]})

    return events.groupBy(by).applyInPandasWithState(update, f"{by} long, n long, smoothed double", "n long, s double", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in tumbling windows; our own extension, for batch and streams alike."""
    return (events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), "event_type", "n"))
