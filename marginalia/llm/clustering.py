"""Lloyd's algorithm on vectors that are sharded by dimension.

Vectors are written as chunks of rows, each cut into blocks of columns. A task
on column blocks holds the centroids' slices of its columns only, and gives
the exact partial squared distances of a chunk to all centroids. Partial
distances are added by chunk; the least sum names the cluster. Each block then
sums its own columns by cluster and floors the means, which are its slices of
the next centroids. Only centroids, clusters times dimensions numbers, pass
through the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.scratch import Scratch

#: Components reach from -LARGEST to LARGEST; beyond that a squared distance over 64 components may not fit in 64 bits.
LARGEST = 1 << 27
#: Below this, products and sums of 64 of them are exact in double precision.
EXACT = 1 << 22


def whole_vectors(vectors: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v array<double>)``: vectors of dim components, none null or non-finite, times scale; floors of them are the integers."""
    v = F.col(vector_col).cast("array<double>")
    fits = F.forall(v, lambda x: F.coalesce(F.abs(x * scale) < LARGEST, F.lit(False)))
    return vectors.where(F.size(v) == dim).where(fits).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x * scale).alias("v"))


def column_blocks(scratch: Scratch, vectors: DataFrame, dim: int, width: int, rows: int = 1024) -> DataFrame:
    """``(chunk, block, n, ids, data)`` of ``(vec_id, v)``; ids only in block 0, both as bytes of little-endian numbers."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            values = np.floor(batch["v"].flatten().to_numpy(zero_copy_only=False)).astype("<i4").reshape(-1, dim)
            ids = batch["vec_id"].fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            null = np.asarray(batch["vec_id"].is_null())
            for at in range(0, len(values), rows):
                part, firsts = values[at : at + rows], range(0, dim, width)
                yield pa.RecordBatch.from_pylist([
                    {"chunk": (task << 32) + k, "block": b, "n": len(part), "ids": ids[at : at + rows].tobytes() if not b else None,
                     "nulls": null[at : at + rows].tobytes() if not b else None, "data": np.ascontiguousarray(part[:, f : f + width]).tobytes()}
                    for b, f in enumerate(firsts)], BLOCKS)
                k += 1

    return scratch.put(vectors.mapInArrow(cut, "chunk long, block int, n int, ids binary, nulls binary, data binary"), "blocks", partition_by="block")


BLOCKS = pa.schema([("chunk", pa.int64()), ("block", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("nulls", pa.binary()), ("data", pa.binary())])


def partial_distances(slices: dict[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over column blocks to ``(chunk, part)``: rows by centroids squared distances in the block's columns, as 64-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, block, data in zip(batch["chunk"].to_pylist(), batch["block"].to_pylist(), batch["data"]):
                c = slices[block]
                x = np.frombuffer(data.as_buffer(), "<i4").reshape(-1, c.shape[1])
                if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
                    xf, cf = x.astype(np.float64), c.astype(np.float64)
                    part = (xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)[None]
                else:
                    part = np.zeros((len(x), len(c)), np.int64)
                    for j in range(c.shape[1]):
                        part += (x[:, j].astype(np.int64)[:, None] - c[:, j][None]) ** 2
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "part": [part.astype("<i8").tobytes()]}, pa.schema([("chunk", pa.int64()), ("part", pa.binary())]))

    return run


def nearest(k: int) -> Callable[[pa.Table], pa.Table]:
    """Adds a chunk's partial distances and takes the least; the smaller number wins a tie."""
    def run(table: pa.Table) -> pa.Table:
        total = None
        for part in table["part"]:
            d = np.frombuffer(part.as_buffer(), "<i8").reshape(-1, k)
            total = d.copy() if total is None else np.add(total, d, out=total)
        best = total.argmin(1)
        return pa.table({"chunk": [table["chunk"][0].as_py()], "cluster": [best.astype("<i4").tobytes()], "distance": [total[np.arange(len(best)), best].astype("<i8").tobytes()]},
                        pa.schema([("chunk", pa.int64()), ("cluster", pa.binary()), ("distance", pa.binary())]))

    return run


def block_sums(k: int, widths: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over column blocks with their rows' clusters to sums ``(block, cluster, n, sums)`` of a task."""
    out = pa.schema([("block", pa.int32()), ("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = {b: np.zeros((k, w), np.int64) for b, w in widths.items()}, {b: np.zeros(k, np.int64) for b in widths}
        for batch in batches:
            for block, data, cluster in zip(batch["block"].to_pylist(), batch["data"], batch["cluster"]):
                x, to = np.frombuffer(data.as_buffer(), "<i4").reshape(-1, widths[block]), np.frombuffer(cluster.as_buffer(), "<i4")
                order = np.argsort(to, kind="stable")
                kinds, firsts = np.unique(to[order], return_index=True)
                sums[block][kinds] += np.add.reduceat(x[order].astype(np.int64), firsts, axis=0)
                counts[block] += np.bincount(to, minlength=k)
        rows = [{"block": b, "cluster": c, "n": int(counts[b][c]), "sums": sums[b][c].tolist()} for b in widths for c in np.flatnonzero(counts[b]).tolist()]
        yield pa.RecordBatch.from_pylist(rows, out)

    return run


def first_centroids(vectors: DataFrame, k: int, scale: int, salt: str) -> list[list[int]]:
    """The integers of the k vectors with the smallest sha256 of salt and id, in ascending order; of rows with one id, by their components. Rows without an id are none."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [[math.floor(x) for x in r["v"]] for r in vectors.where("vec_id IS NOT NULL").select(key.alias("key"), "v").orderBy("key", F.transform("v", lambda x: F.floor(x))).limit(k).collect()]


def lloyd(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, width: int = 16, scale: int = 256, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` for each kept vector, and the last centroids.

    Kept are vectors of dim components, none null or non-finite; a component x
    counts as floor(scale * x). Components of ``LARGEST`` or more in size have
    no distance that is sure to fit in 64 bits, so their vectors aren't kept.
    Rows without an id are clustered but are never first centroids; rows that
    share an id are vectors of their own. Fewer kept vectors than k give as
    many centroids, none give no rows. A cluster that loses all vectors keeps
    its centroid. Arithmetic is of integers and exact.
    """
    scratch = Scratch(vectors.sparkSession, "lloyd")
    kept = whole_vectors(vectors, dim, scale, id_col, vector_col)
    centroids = np.array(first_centroids(kept, k, scale, salt), np.int64).reshape(-1, dim)
    k = len(centroids)
    if not k:
        return kept.where("vec_id IS NOT NULL").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    blocks = column_blocks(scratch, kept, dim, width)
    firsts = dict(enumerate(range(0, dim, width)))
    widths = {b: min(width, dim - f) for b, f in firsts.items()}
    assigned = None
    for turn in range(rounds + 1):
        slices = {b: centroids[:, f : f + width] for b, f in firsts.items()}
        parts = blocks.select("chunk", "block", "data").mapInArrow(partial_distances(slices), "chunk long, part binary")
        scratch.drop(assigned)
        assigned = scratch.put(parts.groupBy("chunk").applyInArrow(nearest(k), "chunk long, cluster binary, distance binary"), "assigned")
        if turn < rounds:
            sums = (
                blocks.select("chunk", "block", "data").join(assigned.select("chunk", "cluster").hint("merge"), "chunk").select("block", "data", "cluster")
                .mapInArrow(block_sums(k, widths), "block int, cluster int, n long, sums array<long>")
                .select("block", "cluster", "n", F.posexplode("sums").alias("column", "part"))
                .groupBy("block", "cluster", "column").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
                .select("block", "cluster", "column", F.expr("(total - pmod(total, n)) div n").alias("mean")))
            centroids = centroids.copy()
            for r in sums.collect():  # k * dim numbers at most
                centroids[r["cluster"], firsts[r["block"]] + r["column"]] = r["mean"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, nulls, cluster, distance in zip(batch["ids"], batch["nulls"], batch["cluster"], batch["distance"]):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(ids.as_buffer(), "<i8"), mask=np.frombuffer(nulls.as_buffer(), np.bool_)),
                    pa.array(np.frombuffer(cluster.as_buffer(), "<i4")), pa.array(np.frombuffer(distance.as_buffer(), "<i8"))], ["vec_id", "cluster", "distance"])

    out = blocks.where("block = 0").select("chunk", "ids", "nulls").join(assigned.hint("merge"), "chunk").select("ids", "nulls", "cluster", "distance")
    return out.mapInArrow(rows, "vec_id long, cluster int, distance long"), centroids


def clusters(vectors: DataFrame, **options) -> DataFrame:
    """``lloyd``'s rows with ``cluster_inertia``, ``inertia`` (sums of distances; null where they pass 64 bits) and ``centroid_sha256``."""
    rows, centroids = lloyd(vectors, **options)
    spark = vectors.sparkSession
    rows = Scratch(spark, "clusters").put(rows, "rows")
    digests = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    by = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("__sum"))
    whole = by.agg(F.sum("__sum").alias("__all"))
    sums = by.crossJoin(F.broadcast(whole)).select("cluster", F.expr("try_cast(__sum AS long)").alias("cluster_inertia"), F.expr("try_cast(__all AS long)").alias("inertia"))
    return rows.join(F.broadcast(sums), "cluster").join(F.broadcast(digests), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_sharded_lloyd(spark, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _sql(k: int = 40, rounds: int = 5) -> str:
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * e::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS cluster, x
  FROM (SELECT x, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT vec_id, x, best.cluster AS cluster, best.distance AS distance FROM (
    SELECT v.vec_id, any_value(v.x) AS x, min({{'distance': {far}, 'cluster': c.cluster}}) AS best
    FROM v CROSS JOIN c{i} c GROUP BY v.vec_id))""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT cluster, list(m ORDER BY d) AS x FROM (
    SELECT cluster, d, (s - ((s % n) + n) % n) // n AS m FROM (
      SELECT cluster, d, sum(e)::BIGINT AS s, count(*) AS n
      FROM (SELECT cluster, unnest(x) AS e, unnest(range(64)) AS d FROM a{i}) GROUP BY cluster, d))
  GROUP BY cluster
  UNION ALL SELECT cluster, x FROM c{i} WHERE cluster NOT IN (SELECT cluster FROM a{i}))""")
    return ",".join(steps) + f"""
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (cluster)
"""


OP12_SQL = _sql()
