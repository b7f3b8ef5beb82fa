"""Fuzzy matching of titles, authors and candidates."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate, product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import scalars


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; 1 for two empty strings. Bit-parallel over the first string."""
    if a == b:
        return 1.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return 2 * (len(a) - s.bit_count()) / (len(a) + len(b))


@lru_cache(maxsize=50_000)
def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string to a window of the longer, windows at the ends being shorter; those that can't be better are passed over."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 1.0 if not long else 0.0
    if short in long:
        return 1.0
    n, best, known = len(short), 0.0, set(short)
    upto = [0, *accumulate(c in known for c in long)]
    for i in range(1 - n, len(long)):
        low, high = max(0, i), min(i + n, len(long))
        if 2 * (upto[high] - upto[low]) > best * (n + high - low):
            best = max(best, indel_ratio(short, long[low:high]))
    return best


def _pairwise(f):
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")

    return score


def fuzzy_ratio(a: Column, b: Column) -> Column:
    return F.pandas_udf(_pairwise(indel_ratio), "double")(a, b)


def fuzzy_partial(a: Column, b: Column) -> Column:
    return F.pandas_udf(_pairwise(partial_ratio), "double")(a, b)


#: Middle names that vary one by one; beyond them all are whole, initials or left out alike, as forms would double with each.
VARIED = 5


@lru_cache(maxsize=50_000)
def name_variants(name: str) -> frozenset[str]:
    """Ways to write a name, in lower-case ASCII and without punctuation.

    Given names are whole or initials, middle names may be left out, the family
    name comes last, first or alone. It is the last word, of three words and
    more also the first; a comma sets it apart. What has initials only is left
    out. A name without letters has no variants.
    """
    name = scalars.plain(name).lower().strip()
    family, comma, given = (x.strip() for x in name.partition(","))
    words = re.sub(r"[.,;:'\"]+", " ", f"{given} {family}" if comma and given else name).split()
    if len(words) < 2:
        return frozenset(words)
    made = set()
    for last, others in [(words[-1], words[:-1])] + ([(words[0], words[1:])] if len(words) > 2 else []):
        first, middle = others[0], others[1:]
        forms = [(m, m[0], "") for m in middle[:VARIED]]
        rest = [tuple(middle[VARIED:]), tuple(m[0] for m in middle[VARIED:]), ()] if len(middle) > VARIED else [()]
        for g, tail, *mid in product((first, first[0]), rest, *forms):
            written = " ".join(w for w in (g, *mid, *tail) if w)
            made |= {f"{written} {last}", f"{last} {written}", last}
    return frozenset(v for v in made if any(len(w) > 1 for w in v.split()))


@lru_cache(maxsize=50_000)
def best_ratio(ours: frozenset[str], theirs: frozenset[str]) -> float:
    """The best ratio of any two; pairs whose lengths allow no better one are passed over."""
    if ours & theirs:
        return 1.0
    best = 0.0
    for a in ours:
        for b in theirs:
            if 2 * min(len(a), len(b)) > best * (len(a) + len(b)):
                best = max(best, indel_ratio(a, b))
    return best


def author_overlap(query: list[str], candidate: list[str]) -> float:
    """The mean, over the query's authors, of the best ratio of any variants. Blank names don't count; 0 without authors. Not symmetric."""
    ours, theirs = ([v for v in map(name_variants, filter(None, names)) if v] for names in (query, candidate))
    if not ours or not theirs:
        return 0.0
    return sum(max(best_ratio(a, b) for b in theirs) for a in ours) / len(ours)


def author_similarity(a: Column, b: Column) -> Column:
    """``author_overlap`` of two arrays of names, once for each pair of arrays in a batch."""
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = [(tuple(p) if p is not None else (), tuple(q) if q is not None else ()) for p, q in zip(x, y)]
        known = {pair: author_overlap(*map(list, pair)) for pair in set(pairs)}
        return pd.Series([known[pair] for pair in pairs], dtype="float64")

    return F.pandas_udf(score, "double")(a, b)


def best_title_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    forms = lambda t: {t, t.partition(":")[0].strip(" ")}
    return max(indel_ratio(x, y) for x in forms(a) for y in forms(b))


def title_similarity(a: Column, b: Column) -> Column:
    """The best ratio of whole titles and what stands before a colon; 0 if either is empty."""
    return F.coalesce(F.pandas_udf(_pairwise(best_title_ratio), "double")(a, b), F.lit(0.0))


def year_factor(a: Column, b: Column) -> Column:
    return F.coalesce(1 / (1 + F.pow((a - b) / 3.0, F.lit(2))), F.lit(1.0))


def best_candidate(pairs: DataFrame, threshold: float = 0.70) -> DataFrame:
    """``(key, ord, score)`` of ``key, ord, title_sim, author_sim, year, cand_year, venue_sim``: the best candidate, the first on a tie. What is unknown doesn't count."""
    score = (F.col("title_sim") * F.coalesce(0.5 + 0.5 * F.col("author_sim"), F.lit(1.0)) * year_factor(F.col("year"), F.col("cand_year")) * F.coalesce(0.9 + 0.1 * F.col("venue_sim"), F.lit(1.0)))
    w = Window.partitionBy("key").orderBy(F.desc("score"), "ord")
    return pairs.withColumn("score", score).withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) & (F.col("score") >= threshold)).select("key", "ord", "score")


def best_later_titles(items: DataFrame, scope: list[str], least: float) -> DataFrame:
    """``(key, ord, score)`` of ``key, title`` and scope: the later key of the same scope whose title is most alike, ``least`` (over 0) or more, the first on a tie.

    Titles are compared, not rows: each two that share a scope are scored once.
    A scope's title can serve keys below its last one, so of a title's scores,
    from the highest down, each serves the keys between the last key of higher
    ones and its own, and a key has one of them at most. A hot title is sorted
    in one task; its rows are never paired.
    """
    items = items.where("title <> ''").select(*scope, "key", "title")
    groups = items.groupBy(*scope, "title").agg(F.max("key").alias("last"))
    pairs = groups.drop("last").join(groups.withColumnRenamed("title", "other"), scope)
    scored = pairs.select("title", "other").distinct().withColumn("score", title_similarity(F.col("title"), F.col("other"))).where(F.col("score") >= least)
    pairs = pairs.join(scored, ["title", "other"])
    levels = pairs.groupBy(*scope, "title", "score").agg(F.max("last").alias("last"))
    higher = Window.partitionBy(*scope, "title").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("begin", F.max("last").over(higher)).where("begin IS NULL OR begin < last")
    at = items.join(levels, [*scope, "title"]).where("key < last AND (begin IS NULL OR key >= begin)").select(*scope, "title", "key", "score")
    asked = at.join(pairs.drop("last"), [*scope, "title", "score"]).select(*scope, F.col("other").alias("title"), "key", F.lit(0).alias("kind"), "score")
    both = asked.unionByName(items.select(*scope, "title", "key", F.lit(1).alias("kind")), allowMissingColumns=True)
    after = Window.partitionBy(*scope, "title").orderBy(F.desc("key"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("ord", F.last(F.when(F.col("kind") == 1, F.col("key")), ignorenulls=True).over(after)).where("kind = 0 AND ord IS NOT NULL")
    return found.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("score"), "ord")).alias("best")).select("key", "best.ord", (-F.col("best.score")).alias("score"))
