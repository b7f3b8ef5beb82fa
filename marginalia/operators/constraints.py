"""Ordinal constraints: parsed from a manifest, held against scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators import scoring
from marginalia.operators.structure import stripped

# fixed values: names of axes, and the papers that "any experimental paper" stands for
AXES = {
    "test-severity": "test_severity",
    "test_severity": "test_severity",
    "progressiveness": "progressiveness",
    "unification": "unification",
    "empirical": "empirical_content",
    "empirical_content": "empirical_content",
    "problem-solving": "problem_solving",
    "problem_solving": "problem_solving",
    "contribution": "overall",
    "integrity": "integrity",
}
EXPERIMENTAL = ["Graphene", "Transformer", "LIGO", "ResNet", "CRISPR", "AlphaFold", "RECOVERY", "Camerer", "Ritchie", "Ceballos"]
CONSTRAINT = r"(?U)^([\w-]+)(?:\s+([\w-]+))?\s*([><\u2248])\s*([\w-]+)(?:\s+([\w-]+))?$"


def _axis(c: Column) -> Column:
    named = F.create_map(*[F.lit(x) for kv in AXES.items() for x in kv])
    return F.when(c != "", F.coalesce(named[c], c))


def constraints(manifests: DataFrame) -> DataFrame:
    """``(manifest, ord, n, left, left_axis, op, right, right_axis, raw)`` of ``(manifest, text)``.

    Constraints are the lines of the first fenced block, comments from ``#`` and
    what stands in parentheses left out. ``a axis < any experimental paper``
    gives one for each such paper, numbered by n. A name without an axis has
    null for it; lines that aren't constraints give none.
    """
    lines = F.transform(F.split("text", r"\r\n|\n|\r", -1), stripped)
    fences = F.filter(F.transform("lines", lambda s, i: F.when(s == "```", i + 1)), lambda i: i.isNotNull())
    first, last = F.get("fences", F.lit(0)), F.coalesce(F.get("fences", F.lit(1)), F.size("lines") + 1)
    rows = manifests.select("manifest", lines.alias("lines")).withColumn("fences", fences).where(F.size("fences") > 0)
    rows = rows.select("manifest", F.posexplode(F.slice("lines", first + 1, last - first - 1)).alias("ord", "raw"))
    plain = lambda c: stripped(F.regexp_replace(c, r"\(.*?\)", ""))
    rows = rows.withColumn("said", plain(F.substring_index("raw", "#", 1))).where("said <> ''")
    rows = rows.withColumns({"every": F.contains(F.lower("raw"), F.lit("any experimental paper")), "words": F.split(plain(F.substring_index("raw", "<", 1)), r"\s+")})
    part = lambda n: F.regexp_extract("said", CONSTRAINT, n)
    one = F.struct(part(1).alias("left"), _axis(part(2)).alias("left_axis"), part(3).alias("op"), part(4).alias("right"), _axis(part(5)).alias("right_axis"))
    axis = _axis(F.get("words", F.lit(1)))
    many = F.transform(F.array(*map(F.lit, EXPERIMENTAL)), lambda p: F.struct(F.col("words")[0].alias("left"), axis.alias("left_axis"), F.lit("<").alias("op"), p.alias("right"), axis.alias("right_axis")))
    none = F.array().cast(many_type := "array<struct<left:string,left_axis:string,op:string,right:string,right_axis:string>>")
    made = F.when(F.col("every"), F.when(F.size("words") > 1, many.cast(many_type)).otherwise(none)).when(part(1) != "", F.array(one).cast(many_type)).otherwise(none)
    return rows.select("manifest", "ord", "raw", F.posexplode(made).alias("n", "c")).select("manifest", "ord", "n", "c.*", "raw")


def held_constraints(asked: DataFrame, scores: DataFrame) -> DataFrame:
    """asked with ``left_value``, ``right_value`` and ``passed``; constraints on papers without scores are left out.

    scores is ``(name, ord, score, internal_consistency, referencing_quality,
    contribution map)``. Without an axis the value is the score, ``integrity`` is
    consistency times quality, others are axes of the contribution, 0 where
    unknown. ``≈`` holds for papers of one quartile by score, ties by ord.
    """
    ranked = scoring.quartiles(scores, F.col("score"), F.col("ord"))
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))

    def side(name: str) -> DataFrame:
        return ranked.select(F.col("name").alias(name), F.struct("score", "internal_consistency", "referencing_quality", "contribution", "quartile").alias(f"__{name}"))

    def value(name: str) -> Column:
        s, axis = F.col(f"__{name}"), F.col(f"{name}_axis")
        return F.when(axis.isNull(), zero(s["score"])).when(axis == "integrity", zero(s["internal_consistency"]) * zero(s["referencing_quality"])).otherwise(zero(s["contribution"][axis]))

    rows = asked.join(side("left"), "left").join(side("right"), "right").withColumns({"left_value": value("left"), "right_value": value("right")})
    a, b = F.col("left_value"), F.col("right_value")
    passed = F.when(F.col("op") == ">", a > b).when(F.col("op") == "<", a < b).otherwise(F.col("__left.quartile") == F.col("__right.quartile"))
    return rows.select(*asked.columns, "left_value", "right_value", passed.alias("passed"))


def calibration(results: DataFrame) -> DataFrame:
    """``(manifest, total, passed, pass_rate, failures)`` of held constraints; the rate has four decimals, failures are the raw lines in order."""
    failed = F.transform(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("ord", "n", "raw")))), lambda x: x["raw"])
    return results.groupBy("manifest").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), failed.alias("failures")).select("manifest", "total", "passed", F.round(F.col("passed") / F.col("total"), 4).alias("pass_rate"), "failures")
