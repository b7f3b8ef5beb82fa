"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` hashes cuts ``projections`` Gaussian projections into cells
of ``width``. A query visits its own bucket and perturbed ones, least total
squared distance to the crossed cell walls first, which is the order of
estimated success. Candidates of all tables are reranked by exact inner
product. Vectors are first put on a sphere (one more coordinate evens out
their norms), where the largest inner product is the smallest distance.

How many buckets to visit is fitted on ``fit_queries`` queries, whose true
neighbours are found by brute force over all rows: the least number that
reaches ``fit_recall`` for them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.scratch import Scratch


class Hasher:
    """The projections; picklable and small."""

    def __init__(self, dim: int, norm: float, tables: int, projections: int, width: float, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.norm, self.tables, self.projections, self.width = norm, tables, projections, width
        self.a = rng.normal(size=(tables * projections, dim + 1))
        self.b = rng.random(tables * projections) * width
        self.mix = rng.integers(1, 2**62, size=(tables, projections), dtype=np.int64) | 1

    def cells(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Positions in units of cells, (rows, tables, projections)."""
        if query:
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            extra = np.zeros((len(x), 1))
        else:
            x = x / self.norm
            extra = np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))
        return ((np.hstack([x, extra]) @ self.a.T + self.b) / self.width).reshape(len(x), self.tables, self.projections)

    def bucket(self, cell: np.ndarray, table: int | None = None) -> np.ndarray:
        """One number for each bucket; ``cell`` ends in (tables, projections) or, for one table, (projections)."""
        mix = self.mix if table is None else self.mix[table]
        with np.errstate(over="ignore"):
            return (np.floor(cell).astype(np.int64) * mix).sum(-1)

    def probes(self, position: np.ndarray, table: int, most: int) -> list[int]:
        """Bucket numbers for one query in one table, the likeliest first."""
        cell = np.floor(position)
        part = position - cell
        score = np.concatenate([part**2, (1 - part) ** 2])
        order = np.argsort(score, kind="stable")
        score = score[order].tolist()
        k, mix = self.projections, self.mix[table]
        step = np.where(order < k, -1, 1) * mix[order % k]
        axis, step = (order % k).tolist(), [int(s) for s in step]
        base = int(self.bucket(position, table))
        out, heap = [base], [(score[0], (0,))]
        while heap and len(out) < most:
            cost, chosen = heapq.heappop(heap)
            last = chosen[-1]
            if len({axis[i] for i in chosen}) == len(chosen):
                out.append(base + sum(step[i] for i in chosen))
            if last + 1 < len(score):
                heapq.heappush(heap, (cost + score[last + 1], (*chosen, last + 1)))
                heapq.heappush(heap, (cost - score[last] + score[last + 1], (*chosen[:-1], last + 1)))
        return [(b + 2**63) % 2**64 - 2**63 for b in out]


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v array<double>)`` of vectors that take part: not null, not zero, all components finite, of the most common length."""
    v = F.col(vec_col).cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.when(good, v).alias("v")).where("v IS NOT NULL")
    dim = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (dim["n"] if dim else 0)).groupBy("id").agg(F.min("v").alias("v"))


def best(query_ids, q, ids, x, k: int, allowed: np.ndarray | None = None) -> pd.DataFrame:
    """The k best of ``ids`` for each query; scores are sums of products in a fixed order, so that equal vectors tie."""
    rough = q @ x.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    if allowed is not None:
        rough[~allowed] = -np.inf
    n = rough.shape[1]
    floor = np.full(len(q), -np.inf) if n <= k else -np.partition(-rough, k - 1, axis=1)[:, k - 1]
    near = (rough >= (floor - 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0))))[:, None]) & (rough > -np.inf)
    r, c = np.nonzero(near)
    score = (q[r] * x[c]).sum(1)
    order = np.lexsort((ids[c], -score, r))
    r, c, score = r[order], c[order], score[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    keep = place < k
    return pd.DataFrame({"query_id": query_ids[r[keep]], "vec_id": ids[c[keep]], "score": score[keep]})


def _found(rows: list, bundle: int) -> pd.DataFrame:
    return pd.DataFrame({"query_id": pd.Series([q for q, _ in rows], dtype="int64"), "best": pd.Series([b for _, b in rows], dtype=object), "bundle": pd.Series([bundle] * len(rows), dtype="int64")})


_BEST = "query_id long, vec_id long, score double"


def _top(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def brute_force(rows: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    """True neighbours of a small set of queries (``id, v``), over all rows."""
    ids, q = queries["id"].to_numpy(np.int64), np.array(queries["v"].tolist(), np.float64)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield best(ids, q, pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy()), k)

    return _top(rows.mapInPandas(scan, _BEST), k)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, tables: int = 6, projections: int = 8,
            width: float = 2.0, group_rows: int = 8192, block_queries: int = 4096, fit_queries: int = 64, fit_recall: float = 0.95) -> DataFrame:
    """``(query_id, rank, vec_id, score, probes)``: the k best found of every row but its own, for rows whose id is divisible by ``every``.

    Vectors that are null, zero, of another length than most, or that hold a
    null or non-finite component take no part. Ties go to the smaller id. Of
    equal vectors only the k + 1 smallest ids can be among the best, so only
    those are indexed; no answer is lost. A row that is repeated counts once;
    of an id's several vectors the least counts, compared by component.
    Buckets of more than ``group_rows`` vectors are split, and queries visit
    every split; queries meet a slot in blocks of about ``block_queries``, for
    each of which the slot's vectors are repeated, so no group grows with the
    input. Other columns are not carried. Fewer candidates than k give fewer rows, no vectors none.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.put(valid_vectors(vectors, id_col, vec_col).withColumn("vh", F.xxhash64("v")), "vectors")
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("norm")).first()
    if not shape["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, probes int")
    n_of_copy = F.row_number().over(Window.partitionBy("vh", "v").orderBy("id"))
    index = rows.withColumn("copy", n_of_copy).where(F.col("copy") <= k + 1).drop("copy")
    queries = rows.where(F.col("id") % every == 0)
    hasher = Hasher(shape["dim"], shape["norm"], tables, projections, width)
    probes = fitted_probes(rows, index, queries, hasher, k, fit_queries, fit_recall)
    groups = max(1, -(-shape["n"] * tables // group_rows))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy())
            bucket = hasher.bucket(hasher.cells(x))
            for t in range(tables):
                yield pd.DataFrame({"tab": np.full(len(x), t, np.int32), "bucket": bucket[:, t], "id": pdf["id"], "vh": pdf["vh"], "v": pdf["v"]})

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells = hasher.cells(np.stack(pdf["v"].to_numpy()), query=True)
            for t in range(tables):
                lists = [hasher.probes(c, t, probes) for c in cells[:, t]]
                yield pd.DataFrame({"tab": np.full(len(lists), t, np.int32), "id": pdf["id"], "buckets": lists})

    held = index.mapInPandas(hashed, "tab int, bucket long, id long, vh long, v array<double>")
    held = scratch.put(held, "index")
    full = held.groupBy("tab", "bucket").agg(F.count("*").alias("size")).where(F.col("size") > group_rows)
    full = scratch.put(full.select("tab", "bucket", F.ceil(F.col("size") / group_rows).cast("int").alias("splits")), "full")
    few = full.count() <= 1_000_000
    full = F.broadcast(full) if few else full
    slot = F.pmod(F.xxhash64("tab", "bucket", "split"), F.lit(groups))
    members = (held.join(full, ["tab", "bucket"], "left")
               .withColumn("split", F.pmod("vh", F.coalesce("splits", F.lit(1))).cast("int")).select(slot.alias("slot"), "tab", "bucket", "id", "v"))
    visits = (queries.select("id", "v").mapInPandas(probed, "tab int, id long, buckets array<long>")
              .select("tab", "id", F.explode("buckets").alias("bucket")).distinct()
              .join(full, ["tab", "bucket"], "left")
              .withColumn("split", F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1)))
              .select(slot.alias("slot"), "tab", "bucket", "id"))
    visits = visits.groupBy("slot", "id").agg(F.collect_set(F.struct("tab", "bucket")).alias("wanted")).join(queries.select("id", "v").hint("merge"), "id")
    blocks = max(1, -(-queries.count() // block_queries))
    members = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    visits = visits.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def rerank(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """left: members of one slot; right: queries with the buckets they visit there."""
        if not len(left) or not len(right):
            return _found([], 0)
        names = {b: i for i, b in enumerate(dict.fromkeys(zip(left["tab"], left["bucket"])))}
        own = np.array([names[b] for b in zip(left["tab"], left["bucket"])])
        ids, first = np.unique(left["id"].to_numpy(), return_index=True)
        x = np.stack(left["v"].to_numpy()[first])
        member = np.zeros((len(names), len(ids)), np.float32)
        member[own, np.searchsorted(ids, left["id"].to_numpy())] = 1
        out = []
        for at in range(0, len(right), 256):
            part = right.iloc[at : at + 256]
            want = np.zeros((len(part), len(names)), np.float32)
            for i, wanted in enumerate(part["wanted"]):
                want[i, [names[b] for b in ((w["tab"], w["bucket"]) for w in wanted) if b in names]] = 1
            got = best(part["id"].to_numpy(), np.stack(part["v"].to_numpy()), ids, x, k, (want @ member) > 0)
            for q, rows_of in got.groupby("query_id").indices.items():
                out.append((q, [{"far": -s, "vec_id": i} for s, i in zip(got["score"].to_numpy()[rows_of], got["vec_id"].to_numpy()[rows_of])]))
        return _found(out, int(key[0]) // 64)

    # a slot gives a query one row; those of 64 slots are merged before all
    found = members.groupBy("slot", "block").cogroup(visits.groupBy("slot", "block")).applyInPandas(rerank, "query_id long, best array<struct<far:double,vec_id:long>>, bundle long")
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k).alias("best")
    answer = found.groupBy("query_id", "bundle").agg(merged).groupBy("query_id").agg(merged)
    return answer.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.far")).alias("score"), F.lit(probes).alias("probes"))


def fitted_probes(rows, index, queries, hasher: Hasher, k: int, fit_queries: int, fit_recall: float) -> int:
    """The least number of buckets a table, of a doubling-by-halves series, that finds ``fit_recall`` of the fit queries' true neighbours."""
    fit = queries.orderBy(F.xxhash64("id")).limit(fit_queries).select("id", "v").toPandas()
    if not len(fit):
        return 1
    true = brute_force(index, fit, k)
    true = true.join(index.select(F.col("id").alias("vec_id"), "v"), "vec_id").toPandas()
    if not len(true):
        return 1
    most = 3**hasher.projections
    series = sorted({min(most, int(25 * 1.5**i)) for i in range(40)})
    cells = dict(zip(fit["id"], hasher.cells(np.array(fit["v"].tolist()), query=True)))
    bucket = hasher.bucket(hasher.cells(np.array(true["v"].tolist())))
    at = np.full(len(true), np.inf)
    for n in series:
        for q, rows_of in true.groupby("query_id").indices.items():
            for t in range(hasher.tables):
                rank = {b: i for i, b in enumerate(hasher.probes(cells[q][t], t, n))}
                for r in rows_of:
                    at[r] = min(at[r], rank.get(int(bucket[r, t]), np.inf))
        if (at < n).mean() >= fit_recall:
            return n
    return series[-1]


def op6_multiprobe_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")).select("query_id", "rank", "vec_id", "score")
