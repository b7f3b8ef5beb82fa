"""SimHash near-duplicates, compared through pivot distance tables.

Every distinct fingerprint gets a row of Hamming distances to fixed reference
fingerprints. Two fingerprints at distance d differ by at most d in every
coordinate, so a pair is discarded by its largest coordinate difference and
only survivors are verified. Candidate pairs come from buckets: a fingerprint
is cut into ``max_bits + 1`` pieces, of which linked ones share at least one.
A bucket with more than ``bucket_limit`` fingerprints is split by the pivot
whose distances vary most in it: rows go by cells of that coordinate, and also
to the next cell if a linked one may lie there; so on with further pivots. What
no pivot tells apart is a cluster of copies. There each fingerprint names those
one flipped bit away (and itself), and those that share a name are linked,
which is exact for two bits; a name has at most 65 holders.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.components import connected_components
from marginalia.llm.text import attach, whole
from marginalia.scratch import Scratch

SHINGLE = 3
MAX_BITS = 2
N_PIVOTS = 16
LANES = np.uint64(0x0001000100010001)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64, seed 42, of each run of ``size`` words; of the whole sequence if shorter. A-Z are lower-cased; words end at ASCII blanks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: both concern ASCII only
    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [h(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [h(joined[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of ``counts`` hashes: a bit is 1 if set in over half of them. No hashes: 0."""
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if not full.any():
        return out
    n, first = counts[full], (np.cumsum(counts) - counts)[full]
    # four 16-bit lanes are summed at once, so that a lane holds at most 65,535 rows
    pieces = [np.arange(a, a + k, 65_535) for a, k in zip(first, n)] if n.max() > 65_535 else None
    at = first if pieces is None else np.concatenate(pieces)
    owner = None if pieces is None else np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]])
    made = np.zeros(len(n), np.uint64)
    for j in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(j)) & LANES, at)
        for lane in range(4):
            ones = ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64)
            ones = ones if owner is None else np.add.reduceat(ones, owner)
            made |= (2 * ones > n).astype(np.uint64) << np.uint64(j + 16 * lane)
    out[full] = made
    return out


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        lists = [shingle_hashes(t) for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((h for x in lists for h in x), np.uint64, int(counts.sum()))
        yield pd.Series(majority_bits(flat, counts).view(np.int64))


def fingerprint_column(text):
    return F.pandas_udf(_fingerprints, "long")(text)


_fingerprints.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}


def pivots(n: int = N_PIVOTS) -> list[int]:
    """Fixed reference fingerprints, signed: XXH64 of their numbers."""
    return [int(np.uint64(xxhash.xxh64_intdigest(str(i), 7)).view(np.int64)) for i in range(n)]


#: Values of a coordinate in one cell.
CELL = 6
#: A bucket in which no coordinate varies by so much (unlike fingerprints: 16) isn't split.
LEAST_VARIANCE = 4.0


def _split(crowd: DataFrame, n_pivots: int, max_bits: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows of crowded buckets by cells of their bucket's most telling pivot, and the buckets ``(key)`` that none splits."""
    spread = [F.when(F.max(f"d{i}") - F.min(f"d{i}") >= CELL, F.var_pop(f"d{i}")).otherwise(0.0) for i in range(n_pivots)]
    told = crowd.groupBy("key").agg(F.array(*spread).alias("spread")).withColumn("most", F.array_max("spread"))
    told = told.select("key", F.when((F.col("most") > 0) & (F.col("most") >= least), F.array_position("spread", F.col("most")).cast("int")).alias("pivot"))
    value = F.element_at(F.array(*[F.col(f"d{i}") for i in range(n_pivots)]), F.col("pivot")).cast("int")
    cell = F.floor(value / CELL)
    cells = F.when(value % CELL >= CELL - max_bits, F.array(cell, cell + 1)).otherwise(F.array(cell))
    dealt = crowd.join(told.where("pivot IS NOT NULL").hint("merge"), "key").withColumn("cell", F.explode(cells))
    return dealt.withColumn("key", F.xxhash64("key", "pivot", "cell")).drop("pivot", "cell"), told.where("pivot IS NULL").select("key")


def linked_pairs(prints: DataFrame, max_bits: int = MAX_BITS, n_pivots: int = N_PIVOTS, bucket_limit: int = 64,
                 scratch: Scratch | None = None, least_variance: float = LEAST_VARIANCE) -> DataFrame:
    """Edges ``(src, dst)`` whose components are those of all links between distinct fingerprints.

    prints: ``(fp long, node long)``, one row for each fingerprint. Keys of
    buckets are hashes, so buckets that clash are compared together, at no
    loss. Links of more than two bits aren't offered: clusters are exact for
    two bits or fewer.
    """
    if max_bits > 2:
        raise ValueError("clusters are handled for two bits")
    scratch = scratch or Scratch(prints.sparkSession, "simhash")
    table = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("tinyint").alias(f"d{i}") for i, p in enumerate(pivots(n_pivots))]
    cuts = [(0, 22), (22, 21), (43, 21)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.shiftright("fp", at).bitwiseAND(F.lit((1 << width) - 1))) for i, (at, width) in enumerate(cuts)])
    rows = prints.select("fp", "node", F.explode(keys).alias("key"))
    sizes = scratch.put(rows.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "buckets")
    rows = scratch.put(rows.join(sizes.hint("merge"), "key").select("*", *table), "pivots")
    small, crowd, clusters = [rows.where(F.col("held") <= bucket_limit)], rows.where(F.col("held") > bucket_limit).drop("held"), []
    for turn in range(n_pivots + 1):
        if crowd.isEmpty():
            break
        dealt, whole_ = _split(crowd, n_pivots, max_bits, least_variance) if turn < n_pivots else (None, crowd.select("key").distinct())
        clusters.append(scratch.put(crowd.join(whole_.hint("merge"), "key", "left_semi").select("fp", "node"), "cluster"))
        if dealt is None:
            break
        dealt = scratch.put(dealt, "cells")
        held = dealt.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
        dealt = scratch.put(dealt.join(held.hint("merge"), "key"), "cells")
        small.append(dealt.where(F.col("held") <= bucket_limit).select(rows.columns))
        crowd = dealt.where(F.col("held") > bucket_limit).drop("held")
    near = reduce(lambda x, y: x & y, [F.abs(F.col(f"a.d{i}") - F.col(f"b.d{i}")) <= max_bits for i in range(n_pivots)])

    def verified(rows: DataFrame) -> DataFrame:
        a, b = rows.alias("a"), rows.alias("b")
        return a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & near
                      & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits)).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"))

    edges = reduce(DataFrame.unionByName, map(verified, small))
    if clusters:
        flips = F.array(F.col("fp"), *([F.col("fp").bitwiseXOR(F.lit(int(np.uint64(1 << i).view(np.int64)))) for i in range(64)] if max_bits else []))
        pair = F.struct("fp", "node")
        shared = reduce(DataFrame.unionByName, clusters).distinct().select(F.explode(flips).alias("name"), pair.alias("one"))
        shared = shared.groupBy("name").agg(F.min("one").alias("low"), F.collect_list("one").alias("all")).where(F.size("all") > 1).select("low", F.explode("all").alias("one"))
        edges = edges.unionByName(shared.where("low <> one").select(F.col("low.node").alias("src"), F.col("one.node").alias("dst")))
    return edges


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, text_hash, fp long, component_id)``, one row for each row of docs.

    Component: the smallest id reachable over links of ``max_bits`` or fewer
    differing bits; rows that share an id are linked too. Texts without words,
    null ones too, have fingerprint 0 and are linked like any other. Rows
    without an id keep their fingerprint, link nothing by themselves and take
    the component of their fingerprint, if it has one. Repeated ids are rows
    of their own. Empty tables give none. Other columns are not carried.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.put(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole(F.col(text_col))).alias("text_hash"), fingerprint_column(F.col(text_col)).alias("fp")), "prints")
    named = prints.where("doc_id IS NOT NULL")
    # a fingerprint's smallest id stands for it
    nodes = scratch.put(named.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    edges = linked_pairs(nodes, max_bits, scratch=scratch)
    # an id with several texts joins their fingerprints
    several = named.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id")
    of_id = named.join(several.hint("merge"), "doc_id").select("doc_id", "fp").distinct().join(nodes.hint("merge"), "fp").select("doc_id", "node")
    edges = edges.unionByName(of_id.join(of_id.groupBy("doc_id").agg(F.min("node").alias("src")).hint("merge"), "doc_id").select("src", F.col("node").alias("dst")).where("src <> dst"))
    comp = connected_components(edges)
    of_print = nodes.join(comp.hint("merge"), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return attach(prints, of_print, "fp")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicate_components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
