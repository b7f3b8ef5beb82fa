"""Running sums in one global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.scratch import Scratch

#: Rows of a range, and the most ranges, whose starts are broadcast.
ROWS, MOST_RANGES = 100_000, 10_000


def running(scratch: Scratch, rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str = "ordered") -> DataFrame:
    """rows with, for each name of sums, the sum of that column over all rows before.

    Rows are range-partitioned by order, which has to be total but for rows
    that are alike, and written with the number of their range; the sums of
    ranges give each its start. However many rows share the first columns of
    the order, they are spread over ranges by the next ones. Tables of no rows
    give none.
    """
    ranges = min(MOST_RANGES, 1 + rows.count() // ROWS)
    placed = scratch.put(
        rows.withColumns({f"__{k}": v for k, v in sums.items()}).repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()), name)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__range").agg(*(F.sum(f"__{k}").alias(f"__{k}") for k in sums)).select(
        "__range", *(F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__start_{k}") for k in sums))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(F.broadcast(starts), "__range")
        .withColumns({k: F.col(f"__start_{k}") + F.coalesce(F.sum(f"__{k}").over(inside), F.lit(0)) for k in sums})
        .drop("__range", *(f"__{k}" for k in sums), *(f"__start_{k}" for k in sums)))
