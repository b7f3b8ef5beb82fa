"""Near copies by exact Jaccard similarity of word shingles.

Two texts are linked if their sets of five-word shingles have a Jaccard
similarity of 0.8 or more. Any one order of all shingles gives each set a
prefix of a little over a fifth, and linked sets share a shingle there, so
buckets by prefix shingle hold every linked pair. Shingles that a sample finds
in many texts come last in the order, which concerns speed alone.

A pair is looked at in full only if bitmaps of both sets allow a link: every
shingle flips one of ``BITS`` bits, so sets differ in at least as many shingles
as their bitmaps in bits. That leaves out no linked pair.

Buckets of up to ``SMALL`` texts are paired up. Members of larger ones meet
``CENTRES`` of them, turn by turn, and those that verify are components. Pairs
within a component need no look; those across that are left after the turns
are all verified, whatever the size of the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.text import attach, whole
from marginalia.operators.components import connected_components
from marginalia.scratch import Scratch

SHINGLE = 5
#: A similarity of 0.8, as a fraction.
PART, OF = 4, 5
#: So many shingles at most are put last.
COMMON = 400_000


#: Buckets up to this size are paired up.
SMALL = 16
CENTRES = 4
#: Bits of a set's bitmap.
BITS = 512
#: So many sets at most are named by broadcast (16 bytes each) to the texts they are read from.
BROADCAST_SETS = 500_000
_M, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """Hashes of words; forgotten when there are many, so that only work is repeated."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


_words = _Words()


def _set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``SHINGLE`` words; of the whole sequence if shorter. Words are those of ``shingle_hashes``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * _M + w[k : len(w) - size + 1 + k]
    h = (h ^ (h >> np.uint64(32))) * _C
    return np.unique(h ^ (h >> np.uint64(29)))


def _sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([_set(t).view(np.int64) for t in texts], dtype=object)


_sets.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}


def shingle_sets(text):
    return F.pandas_udf(_sets, "array<long>")(text)


def prefixes(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, held, size, prefix, bits)`` of ``(doc_id, text)``; held: a hash of the set, 0 if it is empty; prefix: ascending keys."""
    some = docs.where(F.xxhash64("text").bitwiseAND(F.lit(3)) == 0).select(F.explode(shingle_sets(F.col("text"))).alias("shingle"))
    often = some.groupBy("shingle").agg(F.count("*").alias("uses")).where("uses > 2").orderBy(F.desc("uses"), "shingle").limit(COMMON).toPandas()["shingle"]
    common = docs.sparkSession.sparkContext.broadcast(np.sort(often.to_numpy(np.int64).view(np.uint64)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held, size, prefix, bits = [], [], [], []
            for text in pdf["text"]:
                s = _set(text)
                n = len(s)
                held.append(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 42)).view(np.int64) if n else 0)
                size.append(n)
                bits.append(np.packbits(np.bincount((s >> np.uint64(7) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).view(np.int64))
                key = s >> np.uint64(1)  # 63 bits; the first is set for those that come last
                if len(common.value):
                    at = np.minimum(np.searchsorted(common.value, s), len(common.value) - 1)
                    last = common.value[at] == s
                    key = np.sort(key + (last.astype(np.uint64) << np.uint64(63)))
                prefix.append((key[: n - (PART * n + OF - 1) // OF + 1] ^ np.uint64(1 << 63)).view(np.int64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_hash": pdf["text_hash"], "held": held, "size": size, "prefix": prefix, "bits": bits})

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInPandas(cut, "doc_id long, text_hash long, held long, size int, prefix array<long>, bits array<long>")


def _able(a: str, b: str) -> Column:
    """Whether sets with columns ``size`` and ``bits``, named with these suffixes, may be linked by their sizes and bitmaps."""
    sizes = F.col(f"size{a}") + F.col(f"size{b}")
    shared = F.floor((sizes * PART + OF + PART - 1) / (OF + PART))  # as many shingles at least
    differ = sum((F.bit_count(F.get(f"bits{a}", F.lit(k)).bitwiseXOR(F.get(f"bits{b}", F.lit(k)))) for k in range(BITS // 64)), F.lit(0))
    return (OF * F.least(f"size{a}", f"size{b}") >= PART * F.greatest(f"size{a}", f"size{b}")) & (differ <= sizes - 2 * shared)


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of distinct pairs of sets ``(src, dst)`` that are linked."""
    a, b = (sets.select(F.col("held").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}")).hint("merge") for x in ("src", "dst"))
    pairs = scratch.put(pairs.join(a, "src").join(b, "dst").where(_able("_src", "_dst")).select("src", "dst"), "pairs")
    met = pairs.select(F.explode(F.array("src", "dst")).alias("held")).distinct()
    of_text = scratch.put(sets.select("held", "text_hash").join(met.hint("merge"), "held", "left_semi"), "met")
    of_text = F.broadcast(of_text) if of_text.count() <= BROADCAST_SETS else of_text.hint("merge")
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(of_text, "text_hash")
    # copies of a text give its set more than once
    whole_sets = scratch.put(texts.select("held", shingle_sets(F.col("text")).alias("shingles")).dropDuplicates(["held"]), "shingles")
    a, b = (whole_sets.select(F.col("held").alias(x), F.col("shingles").alias(f"{x}_set")).hint("merge") for x in ("src", "dst"))
    shared = F.size(F.array_intersect("src_set", "dst_set"))
    # PART / OF of the union, in whole numbers
    linked = shared * (OF + PART) >= PART * (F.size("src_set") + F.size("dst_set"))
    out = scratch.put(pairs.join(a, "src").join(b, "dst").where(linked).select("src", "dst"), "verified")
    scratch.drop(pairs, whole_sets)
    return out


def _pairs(both: DataFrame) -> DataFrame:
    """Distinct pairs of rows with ``held, size, held_, size_`` whose sizes allow a link."""
    able = (OF * F.least("size", "size_") >= PART * F.greatest("size", "size_")) & (F.col("held") != F.col("held_"))
    return both.where(able).select(F.least("held", "held_").alias("src"), F.greatest("held", "held_").alias("dst")).distinct()


def linked_sets(rows: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` of the sets in rows of ``prefixes``, a written table that is deleted, that are linked to another."""
    sets = scratch.put(rows.where("size > 0").groupBy("held").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"), F.min("text_hash").alias("text_hash")), "sets")
    scratch.drop(rows)
    keys = sets.select(F.explode("prefix").alias("shingle"), "held", "size")
    shared = scratch.put(keys.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    buckets = scratch.put(keys.join(shared.hint("merge"), "shingle"), "buckets")
    prefixed, sets = sets, scratch.put(sets.select("held", "size", "text_hash", "bits"), "narrow")
    scratch.drop(prefixed, shared)
    other = {"held": "held_", "size": "size_"}
    small, crowd = buckets.where(F.col("n") <= SMALL).drop("n"), buckets.where(F.col("n") > SMALL).drop("n")

    def centred(members: DataFrame, turn: int) -> DataFrame:
        """Each member beside each of its bucket's centres; all buckets prefer the same sets."""
        ones = [F.min_by(F.struct("held", "size"), F.xxhash64("held", F.lit(CENTRES * turn + k))) for k in range(CENTRES)]
        centres = members.groupBy("shingle").agg(F.array_distinct(F.array(*ones)).alias("c")).select("shingle", F.explode("c").alias("c")).select("shingle", F.col("c.held").alias("held_"), F.col("c.size").alias("size_"))
        return members.select("shingle", "held", "size").join(centres.hint("merge"), "shingle")

    first = small.join(small.withColumnsRenamed(other).hint("merge"), "shingle").where("held < held_")
    edges = _verified(_pairs(first.unionByName(centred(crowd, 0))), sets, docs, scratch)
    comp, turn, before = connected_components(edges), 1, None
    while True:
        label = scratch.put(crowd.join(comp.withColumnRenamed("node", "held").hint("merge"), "held", "left").select("shingle", "held", "size", F.coalesce("component", "held").alias("label")), "labels")
        spread = label.groupBy("shingle", "label").agg(F.count("*").alias("n")).groupBy("shingle").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares")).where("n * n > squares")
        left = spread.agg(F.sum("n").alias("n"), F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2).alias("pairs")).first()
        if not left["n"]:
            return comp
        mixed = label.join(spread.select("shingle").hint("merge"), "shingle", "left_semi")
        last = left["pairs"] <= 16 * left["n"] or (before is not None and left["pairs"] > 0.8 * before)
        if last:
            mixed = scratch.put(mixed.join(sets.select("held", "bits").hint("merge"), "held"), "mixed")
            across = mixed.join(mixed.withColumnsRenamed({c: f"{c}_" for c in ("held", "size", "label", "bits")}).hint("merge"), "shingle").where(F.expr("held < held_ AND label <> label_") & _able("", "_"))
        else:
            across = centred(mixed, turn)
        edges = scratch.put(edges.unionByName(_verified(_pairs(across), sets, docs, scratch)), "linked")
        comp = connected_components(edges)
        if last:
            return comp
        before, turn = left["pairs"], turn + 1


def near_copy_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, component_id)``, one row for each row of docs.

    Component: the smallest id reachable over links. A text of fewer
    words is one shingle. Texts without words,
    null ones too, are linked with each other. Rows without an id link nothing
    and take the component of their set, if it has one. Repeated ids are rows
    of their own. Empty tables give none.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    prefixed = scratch.put(prefixes(texts), "prefixes")
    rows = scratch.put(prefixed.select("doc_id", "text_hash", "held"), "rows")
    named = rows.where("doc_id IS NOT NULL")
    comp = linked_sets(prefixed, texts, scratch)
    of_set = scratch.put(named.groupBy("held").agg(F.min("doc_id").alias("first")).join(comp.withColumnRenamed("node", "held").hint("merge"), "held", "left")
                         .select("held", "first", F.coalesce("component", "held").alias("component")), "firsts")
    low = of_set.groupBy("component").agg(F.min("first").alias("component_id"))
    return attach(rows, of_set.join(low.hint("merge"), "component").select("held", "component_id"), "held").select("doc_id", "text_hash", "component_id")
