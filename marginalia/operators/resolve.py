"""Joins that resolve references: registers, cascades, orphans, caches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dangling(cites: DataFrame, bib: DataFrame) -> DataFrame:
    """Cited keys that a paper's bibliography lacks, at their first line; papers without any bibliography are left alone."""
    has_bib = bib.select("paper").distinct()
    return (cites.join(has_bib, "paper", "left_semi").join(bib.select("paper", "key"), ["paper", "key"], "left_anti")
            .groupBy("paper", "key").agg(F.min("line").alias("line")))


def orphans(cites: DataFrame, bib: DataFrame) -> DataFrame:
    """Keys cited but not listed, and listed but not cited."""
    c = cites.select("paper", "key").distinct().withColumn("cited", F.lit(True))
    b = bib.select("paper", "key").distinct().withColumn("listed", F.lit(True))
    return (c.join(b, ["paper", "key"], "full").where("cited IS NULL OR listed IS NULL")
            .select("paper", "key", F.when(F.col("listed").isNull(), "not_listed").otherwise("not_cited").alias("problem")))


def latest_notice(register: DataFrame, key: str, date: str, row: str) -> DataFrame:
    """Each key's last notice; on one date, the later row."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(date), F.desc(row)))
    return register.withColumn("__n", n).where("__n = 1").drop("__n")


def cascade(keys: DataFrame, phases: list[tuple[str, DataFrame]], key: str = "key") -> DataFrame:
    """``(key, phase, value)``: each phase sees only what no earlier one resolved; the rest is ``not_found``."""
    left, found = keys.select(key).distinct(), []
    for name, table in phases:
        hit = left.join(table.groupBy(key).agg(F.min("value").alias("value")), key).select(key, F.lit(name).alias("phase"), "value")
        found.append(hit)
        left = left.join(table.select(key), key, "left_anti")
    found.append(left.select(key, F.lit("not_found").alias("phase"), F.lit(None).cast(found[0].schema["value"].dataType).alias("value")))
    return reduce(DataFrame.unionByName, found)


def registry_lookup(refs: DataFrame, registry: DataFrame, ids: list[str], agree: list[str]) -> DataFrame:
    """``(ref, entry, matched_by)``: ids are tried in order, one entry each (the least); an entry must agree on every field that both have."""
    said = []
    for rank, i in enumerate(ids):
        one = registry.where(F.coalesce(F.col(i), F.lit("")) != "").groupBy(i).agg(F.min_by(F.struct("entry", *agree), "entry").alias("e"))
        pair = refs.where(F.coalesce(F.col(i), F.lit("")) != "").join(one, i)
        ok = reduce(lambda a, b: a & b, [F.coalesce(F.nullif(F.col(f), F.lit("")) == F.nullif(F.col(f"e.{f}"), F.lit("")), F.lit(True)) for f in agree])
        said.append(pair.where(ok).select("ref", F.col("e.entry").alias("entry"), F.lit(i).alias("matched_by"), F.lit(rank).alias("rank")))
    best = F.min_by(F.struct("entry", "matched_by"), "rank").alias("m")
    return reduce(DataFrame.unionByName, said).groupBy("ref").agg(best).select("ref", "m.entry", "m.matched_by")


def inconsistent_citations(bib: DataFrame) -> DataFrame:
    """Keys that two papers or more list with different years (error) or titles (warning); blanks don't count."""
    agg = bib.groupBy("key").agg(F.count_distinct("paper").alias("papers"), F.count_distinct(F.nullif("year", F.lit(""))).alias("years"), F.count_distinct(F.nullif("title", F.lit(""))).alias("titles"))
    many = agg.where("papers >= 2")
    return many.where("years > 1").select("key", F.lit("year").alias("field"), F.lit("error").alias("level")).unionByName(
        many.where("titles > 1").select("key", F.lit("title").alias("field"), F.lit("warning").alias("level")))


def split_cache(queries: DataFrame, cache: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Hits with their result and misses; a null result is a miss."""
    good = cache.where("result IS NOT NULL")
    return queries.join(good, on), queries.join(good, on, "left_anti")


def reusable(new: DataFrame, old: DataFrame, on: list[str], hash_col: str) -> DataFrame:
    """Old verdicts that still hold: keys equal, and hashes equal or either unknown."""
    a, b = F.col(f"new.{hash_col}"), F.col(f"old.{hash_col}")
    blank = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    keys = reduce(lambda x, y: x & y, [F.col(f"new.{k}") == F.col(f"old.{k}") for k in on])
    return new.alias("new").join(old.alias("old"), keys & (blank | (a == b))).where(F.col("old.verdict").isin("SUPPORTS", "NOT_SUPPORTED", "PARTIALLY_SUPPORTS")).select("new.*", "old.verdict")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def protected(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """A verified match isn't downgraded to not found."""
    keep = (F.col("old.api_match") == "verified") & (F.col("new.api_match") == "not_found")
    return new.alias("new").join(old.alias("old"), key, "left").select(key, F.when(keep, "verified").otherwise(F.col("new.api_match")).alias("api_match"), F.coalesce(keep, F.lit(False)).alias("kept"))


def keep_last(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
