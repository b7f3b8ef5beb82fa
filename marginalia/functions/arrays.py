"""Running sums and ranks within arrays, for whole batches of rows at once; a row's array is never exploded, sorted or shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(rows: DataFrame, name: str, values: Column, *kept: str | Column) -> DataFrame:
    """``kept`` and, as ``name``, each value of an array, which holds no nulls.

    Spark asks an inner explode for arrays that aren't empty, and that condition
    moves down to the source with all that the array is made of, which is then made twice.
    """
    return rows.select(*kept, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def _edges(rows: pa.Array) -> np.ndarray:
    """Where each row's values begin in ``rows.flatten()``, and where the last ends; null arrays are empty."""
    sizes = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _lists(edges: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind))


def running(sizes: Column) -> Column:
    """Sums of the first 1, 2, ... values of an ``array<int>``."""
    def sums(rows: pa.Array) -> pa.Array:
        edges = _edges(rows)
        upto = np.concatenate([[0], np.cumsum(rows.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)])
        return _lists(edges, upto[1:] - np.repeat(upto[edges[:-1]], np.diff(edges)), pa.int32())

    return F.arrow_udf(sums, "array<int>")(sizes)


def ranks(values: Column, bounds: Column) -> Column:
    """For each value of an ``array<int>``, how many of its row's bounds, which ascend, aren't over it."""
    def count(values: pa.Array, bounds: pa.Array) -> pa.Array:
        of, to = _edges(values), _edges(bounds)
        # rows one after another: all numbers of a row are over those of the rows before it
        keys = [np.repeat(np.arange(len(e) - 1) << 33, np.diff(e)) + x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for e, x in ((of, values), (to, bounds))]
        return _lists(of, np.searchsorted(keys[1], keys[0], side="right") - np.repeat(to[:-1], np.diff(of)), pa.int32())

    return F.arrow_udf(count, "array<int>")(values, bounds)
