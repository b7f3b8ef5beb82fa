"""Checks, folds and filters over stored records of references, claims and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import scalars as S
from marginalia.operators import matching

# fixed values: below what similarity fields differ, and by how many years
TITLE, AUTHORS, VENUE, YEARS = 0.80, 0.60, 0.65, 1
# fixed values: weights of how specific a claim is, what it adds, and how it was tested
SPECIFICITY = {"quantified": 1.0, "directional": 0.7, "vague": 0.3}
SUPPORT = {"severe_test": 1.0, "weak_test": 0.5, "no_test": 0.0, "post_hoc": 0.0}
# fixed values: rules that report on the run, not on a manuscript
SYSTEM_RULES = ["llm-unavailable", "vision-incomplete", "internal-error", "parse-failed", "source-unsupported", "no-references"]


def _weight(values: dict, c: Column, default: float) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


# ---- references --------------------------------------------------------------------------------------------------


def reference_exists(refs: DataFrame) -> DataFrame:
    """``(key, level, rule, issue)`` of ``key, api_match, issues, skip``: references nobody knows, dead and unreachable addresses."""
    known = refs.where(~F.coalesce("skip", F.lit(False)))
    rule = F.lit("reference-exists").alias("rule")
    missing = known.where("api_match = 'not_found'").select("key", F.lit("error").alias("level"), rule, F.lit("Not found").alias("issue"))
    rest = known.where("api_match IS NULL OR api_match <> 'not_found'").select("key", F.explode("issues").alias("issue"))
    low = F.lower("issue")
    level = F.when(low.contains("dead url"), "error").when(low.contains("blocked by ") | low.contains("content extraction failed"), "warning")
    return missing.unionByName(rest.select("key", level.alias("level"), rule, "issue").where("level IS NOT NULL"))


def venue_similarity(a: Column, b: Column) -> Column:
    """1 if either is missing or both are equal once normalised, else their best partial ratio."""
    x, y = S.normalize_venue(F.coalesce(a, F.lit(""))), S.normalize_venue(F.coalesce(b, F.lit("")))
    return F.when((x == "") | (y == "") | (x == y), 1.0).otherwise(matching.fuzzy_partial(x, y))


def reference_accuracy(refs: DataFrame) -> DataFrame:
    """``(key, field, level)``: fields in which an entry differs from the record found for it.

    refs: ``key, api_match, skip`` and ``title, authors, year, venue`` of both
    (the record's begin with ``api_``). What either lacks isn't compared; one
    joined string of authors is split at commas.
    """
    r = refs.where(F.col("api_match").isin("verified", "mismatch") & ~F.coalesce("skip", F.lit(False)))
    joined = (F.size("authors") == 1) & F.contains(F.get("authors", F.lit(0)), F.lit(","))
    names = F.when(joined, F.filter(F.transform(F.split(F.get("authors", F.lit(0)), ","), F.trim), lambda x: x != "")).otherwise(F.col("authors"))
    title = matching.title_similarity(S.normalize_title(F.col("title")), S.normalize_title(F.col("api_title")))
    r = r.select(
        "key", F.when(~S.missing(F.col("title")) & ~S.missing(F.col("api_title")), title).alias("t"),
        F.when((F.size("authors") > 0) & (F.size("api_authors") > 0), matching.author_similarity(names, F.col("api_authors"))).alias("a"),
        F.when(~S.missing(F.col("venue")) & ~S.missing(F.col("api_venue")), venue_similarity(F.col("venue"), F.col("api_venue"))).alias("v"),
        F.abs(F.expr("try_cast(year AS INT) - try_cast(api_year AS INT)")).alias("y"))
    issue = lambda bad, field, level: F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(level).alias("level")))
    found = F.array_compact(F.array(issue(F.col("t") < TITLE, "title", "error"), issue(F.col("a") < AUTHORS, "authors", "warning"), issue(F.col("y") > YEARS, "year", "warning"), issue(F.col("v") < VENUE, "venue", "warning")))
    return r.select("key", F.explode(found).alias("f")).select("key", "f.field", "f.level")


def needs_fetch(refs: DataFrame, now: Column, ttl_days: int = 30) -> DataFrame:
    """Rows whose full text is worth looking for: not at hand, verified, and not tried in vain within the last days."""
    fresh = (F.coalesce("status", F.lit("")) == "exhausted") & F.coalesce(F.col("attempted") > now - F.make_dt_interval(F.lit(ttl_days)), F.lit(False))
    at_hand = (F.col("tier") == "T1") & ~S.missing(F.col("local_file"))
    out = (F.col("tier") == "T3") | F.coalesce(F.col("api_match").isin("not_found", "web_verified", "web_dead", "web_blocked"), F.lit(False))
    return refs.where(~F.coalesce(at_hand, F.lit(False)) & ~F.coalesce(out, F.lit(False)) & ~fresh)


def is_web_resource(entry_type: Column, url: Column, doi: Column) -> Column:
    return F.coalesce(entry_type == "misc", F.lit(False)) & ~S.missing(url) & S.missing(doi)


def is_formal_document(title: Column, authors: Column, references: Column, least: int = 10) -> Column:
    """A parsed document with a title, an author and ten references or more."""
    return ~S.missing(title) & (authors >= 1) & (references >= least)


def access_split(refs: DataFrame) -> DataFrame:
    """``(key, kind, detail)`` of T2 references: open ones with their address, others with the reason why there is no text."""
    open_ = F.col("is_oa") & ~S.missing(F.col("oa_url"))
    return refs.where("tier = 'T2'").select("key", F.when(open_, "open").otherwise("other").alias("kind"), F.when(open_, F.col("oa_url")).otherwise(F.col("reason")).alias("detail")).where("detail <> ''")


def merged_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(key, papers)``: the papers that cite a reference, each new one appended once."""
    both = old.select("key", F.col("papers").alias("p")).join(new.select("key", F.col("papers").alias("q")), "key", "full")
    none = F.array().cast("array<string>")
    return both.select("key", F.array_union(F.coalesce("p", none), F.coalesce("q", none)).alias("papers"))


def ref_penalty(findings: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """``(key, score)`` of a cited paper: .1 off for each error, .05 for each warning; those of papers without findings have 1."""
    off = F.count_if(F.col("level") == "error") * 0.10 + F.count_if(F.col("level") == "warning") * 0.05
    rows = findings.select("key", "level") if papers is None else papers.select("key").distinct().join(findings.select("key", "level"), "key", "left")
    return rows.groupBy("key").agg(F.greatest(F.lit(0.0), 1.0 - off).alias("score"))


def with_contribution(scores: DataFrame) -> DataFrame:
    """``(key, score)``: internal score times contribution, which counts 1 where it is unknown."""
    return scores.select("key", (F.col("internal") * F.coalesce("contribution", F.lit(1.0))).alias("score"))


# ---- claims ------------------------------------------------------------------------------------------------------


def taxonomy_axes(classified: DataFrame) -> DataFrame:
    """``(paper, empirical_content, progressiveness, test_severity)`` of classified claims.

    Falsifiable claims by how specific they are; novel ones over novel and
    accommodating ones (.5 without either); the mean weight of tests.
    """
    new = F.when(F.col("type") == "prediction", 1.0).when(F.col("type") == "synthesis", 0.7).when((F.col("type") == "explanation") & (F.col("scope") == "cross_domain"), 0.5).otherwise(0.0)
    old = F.when((F.col("type") == "explanation") & (F.coalesce("scope", F.lit("")) != "cross_domain"), 1.0).otherwise(0.0)
    agg = classified.groupBy("paper").agg(
        F.avg(F.when(F.col("testability") == "falsifiable", _weight(SPECIFICITY, F.col("specificity"), 0.3)).otherwise(0.0)).alias("empirical_content"),
        F.sum(new).alias("new"), F.sum(old).alias("old"), F.avg(_weight(SUPPORT, F.col("support"), 0.0)).alias("test_severity"))
    return agg.select("paper", "empirical_content", F.coalesce(F.try_divide("new", F.col("new") + F.col("old")), F.lit(0.5)).alias("progressiveness"), "test_severity")


def contribution_axes(papers: DataFrame, taxonomy: DataFrame, unification: DataFrame, problems: DataFrame) -> DataFrame:
    """All five axes of each paper; what is unknown is neutral (.5) for progress and problem solving and 0 for the rest."""
    out = papers.select("paper").distinct().join(taxonomy, "paper", "left").join(unification.select("paper", F.col("score").alias("unification")), "paper", "left").join(problems.select("paper", F.col("score").alias("problem_solving")), "paper", "left")
    neutral = {"empirical_content": 0.0, "progressiveness": 0.5, "unification": 0.0, "problem_solving": 0.5, "test_severity": 0.0}
    return out.select("paper", *[F.coalesce(k, F.lit(v)).alias(k) for k, v in neutral.items()])


def overall_score(consistency: DataFrame, quality: DataFrame, contribution: DataFrame) -> DataFrame:
    """``(paper, score)``: internal consistency times referencing quality times contribution, which counts 1 where it is unknown."""
    return consistency.join(quality, "paper").join(contribution, "paper", "left").select("paper", (F.col("consistency") * F.col("quality") * F.coalesce("overall", F.lit(1.0))).alias("score"))


def limited_claims(claims: DataFrame, limit: int | None = None, only: str | None = None) -> DataFrame:
    """``(paper, ord, reason)`` of ``paper, ord, key, line, local``: null for claims to verify, else why one is skipped.

    Claims with a local source, of the key named by only if any, are verified
    in their order up to limit; 0 and null are no limit. What shares its key and
    line with one of them isn't skipped.
    """
    wanted = F.col("local") & (F.lit(True) if only is None else F.col("key") == only)
    n = F.row_number().over(Window.partitionBy("paper").orderBy(F.col("wanted").desc(), "ord"))
    rows = claims.withColumn("wanted", F.coalesce(wanted, F.lit(False))).withColumn("n", n)
    chosen = F.col("wanted") & (F.col("n") <= limit if limit else F.lit(True))
    shared = F.max(chosen).over(Window.partitionBy("paper", "key", "line"))
    excluded = F.lit(False) if only is None else F.coalesce(F.col("key") != only, F.lit(True))
    reason = F.when(~F.coalesce("local", F.lit(False)), "no_local_source").when(excluded, "key_filter_excluded").otherwise("limit_truncated")
    return rows.select("paper", "ord", F.when(~shared, reason).alias("reason"))


def ladder_verdicts(levels: DataFrame) -> DataFrame:
    """``(claim, verdict, level)`` of ``claim, step, level, verdict``: the first level that supports, else the last."""
    first = F.min(F.when(F.col("verdict") == "SUPPORTS", F.struct("step", "verdict", "level")))
    got = levels.groupBy("claim").agg(F.coalesce(first, F.max(F.struct("step", "verdict", "level"))).alias("x"))
    return got.select("claim", "x.verdict", "x.level")


def upgraded(verdicts: DataFrame) -> DataFrame:
    """``(claim, verdict)`` of ``claim, verdict, level, purpose, retry``.

    A retry counts if it is better, and only after the section level, where the
    verdict was NOT_SUPPORTED or PARTIALLY_SUPPORTS and the purpose no example.
    """
    def rank(c):
        return _weight({"SUPPORTS": 3.0, "PARTIALLY_SUPPORTS": 2.0, "CANNOT_DETERMINE": 1.0}, c, 0.0)

    tried = (F.col("level") == "section") & F.col("verdict").isin("NOT_SUPPORTED", "PARTIALLY_SUPPORTS") & (F.coalesce("purpose", F.lit("")) != "example")
    better = F.coalesce(tried & (rank(F.col("retry")) > rank(F.col("verdict"))), F.lit(False))
    return verdicts.select("claim", F.when(better, F.col("retry")).otherwise(F.col("verdict")).alias("verdict"))


def web_page_verdict(kind: Column, verdict: Column) -> Column:
    """A page about a paper can't refute a claim on it."""
    return F.when((kind == "web_page") & (verdict == "NOT_SUPPORTED"), "CANNOT_DETERMINE").otherwise(verdict)


def with_dismissals(claims: DataFrame, dismissals: DataFrame) -> DataFrame:
    """claims with ``dismissed`` carried over by key and line."""
    d = dismissals.select("key", "line").distinct().withColumn("dismissed", F.lit(True))
    return claims.join(d, ["key", "line"], "left").withColumn("dismissed", F.coalesce("dismissed", F.lit(False)))


def without_vector(contexts: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """``(hash, context)``: distinct contexts for which the model has no vector yet."""
    rows = contexts.where("context <> ''").select(F.sha2("context", 256).alias("hash"), "context").distinct()
    return rows.join(vectors.where(F.col("model") == model).select("hash"), "hash", "left_anti")


# ---- findings, caches and runs -----------------------------------------------------------------------------------


def split_findings(findings: DataFrame) -> DataFrame:
    """findings with ``system``: whether they report on the run."""
    return findings.withColumn("system", F.col("rule").isin(SYSTEM_RULES))


def still_valid(cached: DataFrame) -> DataFrame:
    """Rows of a cache, but for those whose hash and current hash are both known and differ."""
    return cached.where(S.missing(F.col("hash")) | S.missing(F.col("current")) | (F.col("hash") == F.col("current")))


def saved(cache: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """The cache with results that aren't null put in their keys' place."""
    new = results.where("result IS NOT NULL")
    return cache.join(new.select(*key), key, "left_anti").unionByName(new.select(cache.columns))


def replaced(stored: DataFrame, run: DataFrame, by: str) -> DataFrame:
    """Everything stored, with a run's own rows in place of those of what it ran on."""
    return stored.join(run.select(by).distinct(), by, "left_anti").unionByName(run)


def stage_states(events: DataFrame) -> DataFrame:
    """``(paper, stage, state)``: the latest state of each stage."""
    return events.groupBy("paper", "stage").agg(F.max_by("state", F.struct("ts", "ord")).alias("state"))


def service_totals(calls: DataFrame) -> DataFrame:
    """``(service, calls, errors, elapsed)``."""
    return calls.groupBy("service").agg(F.count("*").alias("calls"), F.count_if("failed").alias("errors"), F.sum("elapsed").alias("elapsed"))


def level_accuracy(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``(field, n, accuracy)``: how often ``field`` equals ``want_field``, for each field that a row wants something of."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("got"), F.col(f"want_{f}").alias("want")) for f in fields])).alias("x")
    return rows.select(pairs).select("x.*").where("want IS NOT NULL").groupBy("field").agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("got") == F.col("want"), F.lit(False)).cast("double")).alias("accuracy"))


def coverage(sets: DataFrame) -> DataFrame:
    """``(case, missed, unexpected, regressions)`` of arrays ``expected, found, known_gaps``."""
    missed = F.array_except("expected", "found")
    return sets.select("case", F.sort_array(missed).alias("missed"), F.sort_array(F.array_except("found", "expected")).alias("unexpected"), F.sort_array(F.array_except(missed, F.col("known_gaps"))).alias("regressions"))
