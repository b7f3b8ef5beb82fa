"""Verdicts, tiers and contributions folded into scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.ordering import running
from marginalia.scratch import Scratch

# fixed values: scores of verdicts, weights of citation purposes, scores of tiers and what is taken off
VERDICT_SCORES = {"SUPPORTS": 1.0, "PARTIALLY_SUPPORTS": 0.5, "CANNOT_DETERMINE": 0.25, "NOT_SUPPORTED": 0.0}
PURPOSE_WEIGHTS = {"evidence": 1.0, "contrast": 0.9, "method": 0.8, "definition": 0.7, "example": 0.6, "attribution": 0.5, "tool": 0.4, "context": 0.2}
TIER_SCORES = {"T1": 0.9, "T2": 0.7, "T3": 0.3}
MISMATCH, API_MISMATCH, NOT_FORMAL, CONCERN = 0.1, 0.1, 0.2, 0.3
WORST_FIRST = ["NOT_SUPPORTED", "CANNOT_DETERMINE", "PARTIALLY_SUPPORTS", "SUPPORTS"]


def lookup(values: dict, c: Column, default) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def reference_scores(claims: DataFrame) -> DataFrame:
    """One row for each ``(paper, key)`` of ``paper, key, verdict, purpose, dismissed``.

    Skipped claims don't count; the purpose is the most frequent, the weightier
    on a tie; verification is the mean verdict of claims not dismissed (none:
    .25); the verdict is their worst. A reference with skipped claims alone has
    weight 0. Blank keys are dropped.
    """
    c = claims.where("key IS NOT NULL AND key <> ''").withColumn("live", F.col("verdict").isNull() | (F.col("verdict") != "SKIPPED"))
    c = c.withColumn("active", F.col("live") & ~F.coalesce("dismissed", F.lit(False)))
    rank = lookup({v: i for i, v in enumerate(WORST_FIRST)}, F.coalesce("verdict", F.lit("CANNOT_DETERMINE")), 3)
    score = lookup(VERDICT_SCORES, F.coalesce("verdict", F.lit("CANNOT_DETERMINE")), 0.25)
    purpose = F.coalesce("purpose", F.lit("evidence"))
    by_purpose = (
        c.groupBy("paper", "key", purpose.alias("purpose")).agg(
            F.count_if("live").alias("n"), F.sum(F.when(F.col("active"), score)).alias("total"), F.count_if("active").alias("active"),
            F.min(F.when(F.col("active"), rank)).alias("worst"), F.count("*").alias("all"), *[F.count_if(F.col("live") & (F.col("verdict") == v)).alias(v) for v in WORST_FIRST]))
    weight = lookup(PURPOSE_WEIGHTS, F.col("purpose"), 0.2)
    agg = by_purpose.groupBy("paper", "key").agg(
        F.max_by(F.struct("purpose", weight.alias("weight")), F.when(F.col("n") > 0, F.struct("n", weight, "purpose"))).alias("p"), F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.sum("active").alias("active"), F.min("worst").alias("worst"), F.sum("all").alias("all"), *[F.sum(v).alias(v) for v in WORST_FIRST])
    some = F.col("n") > 0
    verification = F.when(~some, 0.0).when(F.col("active") > 0, F.col("total") / F.col("active")).otherwise(0.25)
    w = F.when(some, F.col("p.weight")).otherwise(0.0)
    worst = F.when(~some, "SKIPPED").otherwise(F.element_at(F.array(*map(F.lit, WORST_FIRST)), F.coalesce("worst", F.lit(3)) + 1))
    return agg.select("paper", "key", F.when(some, F.col("p.purpose")).otherwise("context").alias("purpose"), w.alias("weight"), worst.alias("verdict"), verification.alias("verification"),
                      F.when(some, F.col("n")).otherwise(F.col("all")).alias("claims"), F.col("SUPPORTS").alias("supports"), F.col("PARTIALLY_SUPPORTS").alias("partial"), F.col("NOT_SUPPORTED").alias("not_supported"))


def referencing_quality(scores: DataFrame, child: DataFrame | None = None, papers: DataFrame | None = None) -> DataFrame:
    """``(paper, quality)``: weighted mean of verification times the cited paper's own score (its verification, where unknown). Of ``papers``, those without references have 1."""
    s = scores.join(child, ["paper", "key"], "left") if child is not None else scores.withColumn("child", F.lit(None).cast("double"))
    s = s.withColumn("v", F.col("weight") * F.col("verification") * F.coalesce("child", "verification"))
    out = s.groupBy("paper").agg(F.when(F.sum("weight") > 0, F.sum("v") / F.sum("weight")).otherwise(0.0).alias("quality"))
    return out if papers is None else papers.select("paper").distinct().join(out, "paper", "left").select("paper", F.coalesce("quality", F.lit(1.0)).alias("quality"))


def metadata_score(tier: Column, api_match: Column, mismatches: Column, formal: Column, retracted: Column, nature: Column) -> Column:
    base = lookup(TIER_SCORES, tier, TIER_SCORES["T3"]) - F.when(api_match == "mismatch", API_MISMATCH).otherwise(0.0) - MISMATCH * mismatches - F.when(formal == F.lit(False), NOT_FORMAL).otherwise(0.0)
    return F.when(retracted & (nature == "Expression of Concern"), CONCERN).when(retracted, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)))


def blended(internal: DataFrame, metadata: DataFrame, key: list[str]) -> DataFrame:
    """Internal and metadata scores: .6 and .4 of both, or the one there is."""
    return internal.join(metadata, key, "full").select(*key, F.when(F.col("internal").isNotNull() & F.col("meta").isNotNull(), 0.6 * F.col("internal") + 0.4 * F.col("meta")).otherwise(F.coalesce("internal", "meta")).alias("child"))


def internal_consistency(papers: DataFrame, findings: DataFrame) -> DataFrame:
    """``(paper, consistency)``: the share of findings that aren't errors; 1 without findings."""
    f = findings.groupBy("paper").agg((1 - F.count_if(F.col("level") == "error") / F.count("*")).alias("c"))
    return papers.select("paper").distinct().join(f, "paper", "left").select("paper", F.coalesce("c", F.lit(1.0)).alias("consistency"))


def contribution(axes: dict[str, Column], weight: float = 0.2) -> Column:
    """Mean of clamped axes, damped where progress is bold but no problem is solved."""
    s = {k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0)))) for k, c in axes.items()}
    mean = sum(s.values(), F.lit(0.0)) * weight / (weight * len(s))
    bold = (s["problem_solving"] < 0.1) & (s["progressiveness"] > 0.5)
    return F.when(bold, mean * (0.5 + 0.5 * (1 - s["progressiveness"]))).otherwise(mean)


def votes(samples: DataFrame, n_samples: int) -> DataFrame:
    """``(item, span, votes, level, text)``: one vote a sample for each normalised span; all agree: warning, over half: info, else dropped."""
    s = samples.withColumn("span", F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))).where("span <> ''")
    agg = s.groupBy("item", "span").agg(F.count_distinct("sample").alias("votes"), F.min_by("text", F.struct("sample", "ord")).alias("text"))
    return agg.where(F.col("votes") * 2 > n_samples).withColumn("level", F.when(F.col("votes") == n_samples, "warning").otherwise("info"))


def best_unit(units: DataFrame) -> DataFrame:
    """Each claim's best verdict, then the highest confidence, then the first unit; nothing but unsupported at confidence 0 names no unit."""
    rank = lookup({v: i for i, v in enumerate(["NOT_SUPPORTED", "CANNOT_DETERMINE", "PARTIALLY_SUPPORTS", "SUPPORTS"])}, F.col("verdict"), 0)
    b = units.groupBy("claim").agg(F.max_by(F.struct("verdict", "confidence", "unit"), F.struct(rank, "confidence", -F.col("ord"))).alias("b"))
    none = (F.col("b.verdict") == "NOT_SUPPORTED") & (F.col("b.confidence") <= 0)
    return b.select("claim", "b.verdict", "b.confidence", F.when(none, "").otherwise(F.col("b.unit")).alias("unit"))


def detection_metrics(counts: DataFrame, empty_is_null: bool) -> DataFrame:
    """Precision, recall and F1 of ``tp, fp, fn``; what is undefined is null or 0."""
    def part(a, b):
        r = F.try_divide(F.col(a), F.col(a) + F.col(b))
        return r if empty_is_null else F.coalesce(r, F.lit(0.0))

    p, r = part("tp", "fp"), part("tp", "fn")
    f = F.try_divide(2 * p * r, p + r)
    return counts.withColumns({"precision": p, "recall": r, "f1": f if empty_is_null else F.coalesce(f, F.lit(0.0))})


def quartiles(scores: DataFrame, by: Column, *ties: Column) -> DataFrame:
    """scores with ``quartile``, ``i * 4 // n + 1`` by descending score, which isn't ``ntile(4)``. Places are counted range by range, so no task holds all rows."""
    placed = running(Scratch(scores.sparkSession, "quartiles"), scores, [by.desc(), *ties], {"__i": F.lit(1)})
    total = scores.agg(F.count("*").alias("__n"))
    return placed.crossJoin(F.broadcast(total)).withColumn("quartile", F.floor(F.col("__i") * 4 / F.col("__n")).cast("int") + 1).drop("__i", "__n")
