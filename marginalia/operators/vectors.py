"""Retrieval by vectors. Vectors are ``array<double>``.

Nearest items and pairs are found exactly: each scope is dealt into blocks, and
every two blocks that meet are a group of at most some 2 * 4096 vectors. There a
matrix product proposes what may be among the best, and those are scored term by
term, as Spark and SQL add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block, rows of it that are multiplied at once, and how far a matrix product may be from the sum term by term.
BLOCK, ROWS, NEAR = 4096, 256, 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of the same number, added in order."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _cells(left: DataFrame, right: DataFrame, scope: str, once: bool) -> tuple[DataFrame, str]:
    """Rows ``(scope, dim, lo, hi, side, id, v)`` of all blocks that meet, and what makes a cell. ``once``: the sides are the same, and two blocks meet once."""
    def usable(df: DataFrame) -> DataFrame:
        v = F.col("v")
        return df.where(F.col(scope).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).withColumn("dim", F.size("v"))

    left, right = usable(left), usable(right)
    size = lambda df, name: df.groupBy(scope, "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = size(left, "nl").join(size(right, "nr"), [scope, "dim"])
    own = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    l = left.join(sizes, [scope, "dim"]).withColumn("own", own("nl"))
    r = right.join(sizes, [scope, "dim"]).withColumn("own", own("nr"))
    if once:
        both = l.withColumn("other", F.explode(upto("nl")))
        return both.select(scope, "dim", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "v"), [scope, "dim", "lo", "hi"]
    l = l.withColumn("other", F.explode(upto("nr"))).select(scope, "dim", F.col("own").alias("lo"), F.col("other").alias("hi"), F.lit(0).alias("side"), "id", "v")
    r = r.withColumn("other", F.explode(upto("nl"))).select(scope, "dim", F.col("other").alias("lo"), F.col("own").alias("hi"), F.lit(1).alias("side"), "id", "v")
    return l.unionByName(r), [scope, "dim", "lo", "hi"]


def _matrix(pdf: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, dim))
    with np.errstate(over="ignore"):
        norm = np.sqrt(summed(v, v))
    fit = (norm > 0) & np.isfinite(norm)
    return pdf["id"].to_numpy()[fit], v[fit], norm[fit]


def _best(frame: pd.DataFrame, by: list[str], k: int, each: str | None) -> pd.DataFrame:
    """The k first rows by score, then ``by``; of each value of a column if that is named."""
    frame = frame.sort_values(["score", *by], ascending=[False] + [True] * len(by), kind="stable")
    return frame.groupby(each, sort=False).head(k) if each else frame.head(k)


def _in_cell(names: tuple[str, str], k: int, least: float | None, later: bool) -> Callable[[pd.DataFrame], Iterator[pd.DataFrame]]:
    """Best pairs of a cell: ``later`` takes the k best of all with first < second, else k of each of the first."""
    first, second = names

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, same = int(pdf["dim"].iloc[0]), later and pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
        a_id, a, a_norm = _matrix(pdf[pdf["side"] == 0], dim)
        b_id, b, b_norm = (a_id, a, a_norm) if same else _matrix(pdf[pdf["side"] == 1], dim)
        kept = pd.DataFrame({first: a_id[:0], second: b_id[:0], "score": np.zeros(0)})
        if not len(a) or not len(b):
            return kept
        unit = (b / b_norm[:, None]).T
        for i in range(0, len(a), ROWS):
            about = (a[i : i + ROWS] / a_norm[i : i + ROWS, None]) @ unit
            fit = np.ones(about.shape, bool) if least is None else about >= least - NEAR
            if later and len(kept) == k:
                fit &= about >= kept["score"].iloc[-1] - NEAR
            if same:
                fit &= a_id[i : i + ROWS, None] < b_id[None, :]
            most = about.size if later else about.shape[1]
            if k < most:  # only what is near the k-th of its row, or of all, can be among the best
                held = np.where(fit, about, -2.0)
                limit = np.partition(held.ravel(), most - k)[most - k] if later else np.partition(held, most - k, axis=1)[:, most - k, None]
                fit &= about >= limit - 2 * NEAR
            x, y = np.nonzero(fit)
            for at in range(0, len(x), 65536):  # of equal vectors many pairs may be as near
                p, q = x[at : at + 65536] + i, y[at : at + 65536]
                score = summed(a[p], b[q]) / (a_norm[p] * b_norm[q])
                one, two = a_id[p], b_id[q]
                if later:
                    one, two = np.minimum(one, two), np.maximum(one, two)
                new = pd.DataFrame({first: one, second: two, "score": score})
                if later:
                    new = new[new[first] < new[second]]
                if least is not None:
                    new = new[new["score"] >= least]
                kept = _best(pd.concat([kept, new]), [first, second] if later else [second], k, None if later else first)
        return kept

    return pairs


def scoped_nearest(queries: DataFrame, items: DataFrame, scope: str, k: int, cutoff: float | None = None) -> DataFrame:
    """``(query, item, score, rank)``: the k nearest items of each query's scope, and of these those within ``cutoff`` of the best.

    Vectors null, with components null or not finite, or whose length as a
    double is zero or infinite, take no part; those of different sizes don't
    meet. Each query and item has one row.
    """
    left, right = queries.select(scope, F.col("query").alias("id"), F.col("qv").alias("v")), items.select(scope, F.col("item").alias("id"), F.col("iv").alias("v"))
    cells, by = _cells(left, right, scope, False)
    found = cells.groupBy(*by).applyInPandas(_in_cell(("query", "item"), k, None, False), f"query {queries.schema['query'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if cutoff is not None:
        out = out.withColumn("best", F.max("score").over(Window.partitionBy("query"))).where(F.col("score") >= cutoff * F.col("best")).drop("best")
    return out


def forward_pairs(items: DataFrame, scope: str, least: float, most: int) -> DataFrame:
    """``(scope, first, second, score)``: similar items later in the same scope, the ``most`` best of each scope. What takes part is as in ``scoped_nearest``."""
    rows = items.select(scope, F.col("item").alias("id"), F.col("iv").alias("v"))
    cells, by = _cells(rows, rows, scope, True)
    kind, name = items.schema["item"].dataType.simpleString(), items.schema[scope].dataType.simpleString()
    pairs = _in_cell(("first", "second"), most, least, True)
    found = cells.groupBy(*by).applyInPandas(lambda key, pdf: pairs(pdf).assign(**{scope: key[0]})[[scope, "first", "second", "score"]], f"`{scope}` {name}, first {kind}, second {kind}, score double")
    w = Window.partitionBy(scope).orderBy(F.desc("score"), "first", "second")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")
