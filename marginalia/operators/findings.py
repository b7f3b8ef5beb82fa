"""Findings from what is stored about references. A finding has ``level, rule, key`` and its paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.scoring import PURPOSE_WEIGHTS, VERDICT_SCORES, lookup

# fixed values: below what weight a citation has no purpose, below what reliability it is reported, and what bibliographies cost
NO_PURPOSE, UNRELIABLE = 0.3, 0.4
PER_MISMATCH, PER_RETRACTION, MOST_TAKEN = 0.05, 0.15, 0.3


def retracted(refs: DataFrame) -> DataFrame:
    """``key, nature``: retractions are errors, concerns warnings, corrections for information."""
    level = F.when(F.col("nature") == "Retraction", "error").when(F.col("nature") == "Expression of Concern", "warning").when(F.col("nature") == "Correction", "info")
    return refs.select("key", level.alias("level"), F.lit("retracted-cite").alias("rule")).where("level IS NOT NULL")


def claim_support(claims: DataFrame) -> DataFrame:
    """Verdicts that don't hold, without dismissed claims and examples."""
    level = F.when(F.col("verdict") == "NOT_SUPPORTED", "error").when(F.col("verdict") == "PARTIALLY_SUPPORTS", "warning")
    kept = claims.where(~F.coalesce("dismissed", F.lit(False)) & (F.coalesce("purpose", F.lit("")) != "example"))
    return kept.select("paper", "key", "line", level.alias("level"), F.lit("claim-support").alias("rule")).where("level IS NOT NULL")


def cite_purpose(claims: DataFrame) -> DataFrame:
    """Citations that support nothing in particular; skipped claims were never classified."""
    weight = lookup(PURPOSE_WEIGHTS, F.coalesce("purpose", F.lit("context")), 0.2)
    kept = claims.where(~F.coalesce("dismissed", F.lit(False)) & (F.coalesce("verdict", F.lit("")) != "SKIPPED") & (weight <= NO_PURPOSE))
    return kept.select("paper", "key", "line", F.lit("warning").alias("level"), F.lit("cite-purpose").alias("rule"))


def tier_violations(cites: DataFrame, tiers: DataFrame) -> DataFrame:
    """``paper, key, unverified`` against ``key, tier``: T3 can't be cited, T2 only as unverified, T1 needn't be."""
    used = cites.groupBy("paper", "key").agg(F.bool_or("unverified").alias("unverified"))
    level = F.when(F.col("tier") == "T3", "error").when((F.col("tier") == "T2") & ~F.col("unverified"), "warning").when((F.col("tier") == "T1") & F.col("unverified"), "info")
    return used.join(tiers, "key").select("paper", "key", level.alias("level"), F.when(F.col("tier") == "T3", "ref-008").otherwise("ref-009").alias("rule")).where("level IS NOT NULL")


def bibliography_score(total: Column, found: Column, mismatches: Column, retractions: Column) -> Column:
    score = found / total - F.least(mismatches * PER_MISMATCH, F.lit(MOST_TAKEN)) - F.least(retractions * PER_RETRACTION, F.lit(MOST_TAKEN))
    return F.when(F.coalesce(total, F.lit(0)) > 0, F.greatest(score, F.lit(0.0))).otherwise(1.0)


def reliability(claims: DataFrame, meta: DataFrame, bib: DataFrame) -> DataFrame:
    """``(key, reliability, unreliable)``: metadata times verdicts times bibliography; what is unknown counts 1."""
    active = ~F.coalesce("dismissed", F.lit(False)) & (F.coalesce("verdict", F.lit("")) != "SKIPPED")
    said = claims.groupBy("key").agg(F.avg(F.when(active, lookup(VERDICT_SCORES, F.coalesce("verdict", F.lit("CANNOT_DETERMINE")), 0.25))).alias("claim"))
    one = F.lit(1.0)
    bibs = bib.select("key", bibliography_score(F.col("total"), F.col("found"), F.col("mismatches"), F.col("retractions")).alias("bib"))
    out = said.join(meta.select("key", "meta"), "key", "full").join(bibs, "key", "left")
    r = F.coalesce("meta", one) * F.coalesce("claim", one) * F.coalesce("bib", one)
    return out.select("key", r.alias("reliability"), (r < UNRELIABLE).alias("unreliable"))


def roll_up(entries: DataFrame) -> DataFrame:
    """``ref, status, retracted, mismatches`` to counts and rates for each reference."""
    agg = entries.groupBy("ref").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "found").alias("found"), F.count_if(F.col("status") == "not_found").alias("not_found"), F.count_if("retracted").alias("retractions"), F.sum("mismatches").alias("mismatches"))
    return agg.withColumns({"found_rate": F.try_divide("found", "total"), "retraction_rate": F.try_divide("retractions", "total")})


def oa_score(title_sim: Column, overlap: Column, year: Column, cand_year: Column) -> Column:
    """Rank of an open-access candidate: 0 for another title (under .4) or other authors; what is unknown is neutral."""
    title = F.when(title_sim.isNull(), 0.5).otherwise(0.2 + 0.8 * title_sim)
    return F.when((title_sim < 0.4) | (overlap == 0), 0.0).otherwise(title + F.when(overlap > 0, 0.2).otherwise(0.0) + F.when(year == cand_year, 0.05).otherwise(0.0))


def effective_severity(findings: DataFrame, rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """Every finding takes its rule's declared severity, or the override's."""
    known = rules.join(overrides, "rule", "left").select("rule", F.coalesce("override", "severity").alias("severity"))
    return findings.join(F.broadcast(known), "rule", "left").withColumn("level", F.coalesce("severity", "level")).drop("severity")


def citation_direction(cites: DataFrame, rules: DataFrame) -> DataFrame:
    """``paper, other, kind``: each forbidden key that a paper cites, and papers that cite none of the keys required of them (``other`` null)."""
    c = cites.select("paper", F.col("key").alias("other")).distinct().withColumn("cited", F.lit(True))
    checked = rules.join(c, ["paper", "other"], "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
    forbidden = checked.where((F.col("kind") == "forbidden") & F.col("cited")).select("paper", "other", "kind")
    required = checked.where("kind = 'required'").groupBy("paper").agg(F.bool_or("cited").alias("any")).where("NOT any")
    return forbidden.unionByName(required.select("paper", F.lit(None).cast(rules.schema["other"].dataType).alias("other"), F.lit("required").alias("kind")))


def with_neighbours(hits: DataFrame, sections: DataFrame, most: int) -> DataFrame:
    """``query, doc, section, rank``: each hit's section with the one before and after, once, in the order of hits, ``most`` of them."""
    near = hits.join(sections.select("doc", F.col("section").alias("s")), "doc").where(F.abs(F.col("s") - F.col("section")) <= 1)
    once = near.groupBy("query", "doc", "s").agg(F.min(F.struct("rank", F.abs(F.col("s") - F.col("section")).alias("away"))).alias("first"))
    n = F.row_number().over(Window.partitionBy("query").orderBy("first", "doc", "s"))
    return once.withColumn("n", n).where(F.col("n") <= most).select("query", "doc", F.col("s").alias("section"), "n")
