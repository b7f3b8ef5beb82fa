"""A catalogue of checks as a table: which run on which paper, and what their answers are worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.structure import stripped

# fixed values: headings of reference lists, characters a token counts for, and how much of an answer counts
REFERENCE_HEADINGS = ["references", "bibliography", "works cited", "literature cited", "reference", "bibliographie"]
CHARS_PER_TOKEN = 3.5
ISSUES, DESCRIPTION, EVIDENCE, LOCATION = 5, 300, 300, 100
# fixed values: what an issue says that is none, and what marks an opinion on style
NO_FINDING = ["grammatically correct", "no change needed", "no changes needed", "no change required", "the sentence is fine", "the sentence is correct", "no error", "no issues"]
STYLE = ["awkward", "unclear", "ambiguous", "imprecise", "could be", "more precise", "more concise", "clarity", "misleading", "flow ", "concise", "room for improvement", "could be improved", "stylistic"]
ANSWER = "struct<issues:array<struct<description:string,evidence:string,location:string,is_genuine:boolean>>>"


def tokens(text: Column) -> Column:
    """How many tokens a text may have, from its length."""
    return F.floor(F.char_length(text) / F.lit(CHARS_PER_TOKEN))


def paper_bodies(sections: DataFrame, abstracts: DataFrame) -> DataFrame:
    """``(paper, body, body_tokens)`` of sections ``(paper, ord, depth, title, text)`` and abstracts ``(paper, text)``.

    The abstract comes first, then sections in their order under headings of
    their depth; reference lists and blank sections are left out.
    """
    head = abstracts.where("text <> ''").select("paper", F.lit(-1).alias("ord"), F.concat(F.lit("## Abstract\n\n"), "text").alias("part"))
    kept = sections.where(~F.lower(stripped(F.col("title"))).isin(REFERENCE_HEADINGS) & (stripped(F.col("text")) != ""))
    parts = kept.select("paper", "ord", F.concat(F.repeat(F.lit("#"), F.col("depth") + 2), F.lit(" "), "title", F.lit("\n\n"), "text").alias("part"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part"))), lambda x: x["part"]), "\n\n")
    return head.unionByName(parts).groupBy("paper").agg(body.alias("body")).withColumn("body_tokens", tokens(F.col("body")))


def selected_checks(catalogue: DataFrame, disabled: DataFrame | None = None, category: str | None = None) -> DataFrame:
    """Rows of the catalogue ``(check_id, category, requires_figures, ...)`` that are of a category, if one is given, and not in ``(check_id)``."""
    rows = catalogue if category is None else catalogue.where(F.col("category") == category)
    return rows if disabled is None else rows.join(disabled.select("check_id").distinct(), "check_id", "left_anti").select(*catalogue.columns)


def uses_reference_db(catalogue: DataFrame, disabled: DataFrame | None = None) -> DataFrame:
    """One row ``(uses)``: whether a check of the category reference-db is left."""
    return selected_checks(catalogue, disabled, "reference-db").agg((F.count("*") > 0).alias("uses"))


def check_queries(bodies: DataFrame, figures: DataFrame, catalogue: DataFrame, most_tokens: int) -> DataFrame:
    """``(paper, check_id, question, body, figures)`` of every selected check on every paper it can be asked of.

    Papers whose body and figure descriptions ``(paper, text)`` together have
    more than ``most_tokens`` are left out, checks of figures where a paper has
    none. The catalogue has a row a check and is broadcast; it doesn't grow with
    the papers.
    """
    described = figures.where("text <> ''").groupBy("paper").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("figures"))
    rows = bodies.join(described, "paper", "left").withColumn("all", F.col("body_tokens") + tokens(F.coalesce("figures", F.lit("Not available."))))
    asked = rows.where(F.col("all") <= most_tokens).crossJoin(F.broadcast(catalogue.select("check_id", "question", "requires_figures")))
    return asked.where(~F.col("requires_figures") | F.col("figures").isNotNull()).select("paper", "check_id", "question", "body", F.coalesce("figures", F.lit("Not available.")).alias("figures"))


def json_in(text: Column) -> Column:
    """The JSON of a model's answer as VARIANT: all of it, what a fence holds, or from the first brace to the last; null if none of these is an object."""
    c = stripped(F.regexp_replace(text, r"(?s)<think(?:ing)?>.*?</think(?:ing)?>", ""))
    tried = [c, F.regexp_extract(c, r"(?s)```(?:json)?\s*\n?(.*?)```", 1), F.regexp_extract(c, r"(?s)(\{.*\})", 1)]
    objects = [F.when(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), F.try_parse_json(t)) for t in tried]
    return F.coalesce(*objects)


def answered_findings(answers: DataFrame) -> DataFrame:
    """``(paper, level, rule_id, message, context)`` of answers ``(paper, check_id, answer)``.

    Of an answer its first five issues count, cut to their lengths, and of these
    the genuine ones. A null answer is a model that gave up, which is a finding
    of its own; an answer without JSON has no issues.
    """
    said = F.from_json(F.to_json(json_in(F.col("answer"))), ANSWER)
    issues = F.filter(F.slice(F.coalesce(said["issues"], F.array().cast("array<struct<description:string,evidence:string,location:string,is_genuine:boolean>>")), 1, ISSUES), lambda i: F.coalesce(i["is_genuine"], F.lit(False)))
    text = lambda c, n: F.left(F.coalesce(c, F.lit("")), F.lit(n))
    found = answers.where(F.col("answer").isNotNull()).select("paper", F.col("check_id").alias("rule_id"), F.explode(issues).alias("i"))
    found = found.select("paper", F.lit("warning").alias("level"), "rule_id", text(F.col("i.description"), DESCRIPTION).alias("message"), text(F.col("i.evidence"), EVIDENCE).alias("context"))
    gone = answers.where(F.col("answer").isNull()).select(
        "paper", F.lit("warning").alias("level"), F.lit("llm-unavailable").alias("rule_id"), F.concat("check_id", F.lit(": LLM call exhausted retries; check did not run")).alias("message"), F.lit("").alias("context"))
    return found.unionByName(gone)


def cited_paper_findings(findings: DataFrame) -> DataFrame:
    """Findings of checks on cited papers ``(key, ...)``, with the paper's key before the message."""
    return findings.withColumn("message", F.concat(F.lit("["), "key", F.lit("] "), "message"))


def emittable(issues: DataFrame) -> DataFrame:
    """Prose issues ``(span, suggestion, issue)`` with a fix that changes something, and that are neither no finding nor an opinion on style."""
    span, fix, said = stripped(F.coalesce("span", F.lit(""))), stripped(F.coalesce("suggestion", F.lit(""))), F.lower(F.coalesce("issue", F.lit("")))
    banned = F.greatest(*[F.contains(said, F.lit(w)) for w in (*NO_FINDING, *STYLE)])
    return issues.where((span != "") & (fix != "") & (F.lower(span) != F.lower(fix)) & ~banned)
