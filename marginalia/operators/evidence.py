"""What speaks for and against a reference: issues of entries, open-access choices, reliability with its signals, sections that bear on a claim, kept metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import scalars
from marginalia.operators import findings, matching
from marginalia.operators.acceptance import surname
from marginalia.operators.structure import stripped

# fixed values: identifiers of an entry, the least score of an open-access candidate, the share of sections from which all count, texts that tell of a failed tool
IDENTIFIERS = ["doi", "isbn", "pmid", "arxiv_id", "pmc_id", "lccn"]
LEAST_OA, ALL_FROM = 0.5, 0.7
INFRASTRUCTURE = ["error code:", "does not exist", "connection", "timeout", "parse error", "cli error", "not found", "could not read", "refused", "unreachable", "500", "502", "503"]
# fixed values: a rendered reference that found no target
BROKEN = r"(?i)(?:(?:Figure|Fig\.|Table|Tab\.|Section|Sec\.|Equation|Eq\.|Theorem|Lemma|Proposition|Corollary|Definition|Algorithm|Alg\.|Appendix|App\.|Chapter|Ch\.)\s*\?\?|\(\s*\?\?\s*\)|(?<!\?)\?\?(?!\?))"
BRACKETS = r"\[(\d+(?:[,;\s]+\d+)*)\]"


def entry_issues(refs: DataFrame) -> DataFrame:
    """``(key, issue)``: wrong and missing identifiers, open access, retraction.

    refs has the entry's identifiers and ``local_status``, and of the record
    found ``api_doi, pdf_url, retracted, wrong_id, wrong_title``; wrong_id is an
    identifier of the entry that leads to another paper.
    """
    none = ~F.greatest(*[~scalars.missing(F.col(c)) for c in IDENTIFIERS])
    issues = [
        F.when(~scalars.missing(F.col("wrong_id")), F.concat(F.lit("Wrong identifier in bib entry: '"), "wrong_id", F.lit("' resolves to '"), F.left(F.coalesce("wrong_title", F.lit("")), F.lit(60)), F.lit("', not the paper found by title search"))),
        F.when(none, F.when(scalars.missing(F.col("api_doi")), "No identifier in bib entry (no DOI, ISBN, PMID, or arXiv ID)").otherwise(F.concat(F.lit("No identifier in bib entry; DOI available: "), "api_doi"))),
        F.when(~scalars.missing(F.col("pdf_url")) & (F.col("local_status") == "none"), F.concat(F.lit("Open access PDF available: "), "pdf_url")),
        F.when(F.col("retracted"), "RETRACTED: This paper has been retracted"),
    ]
    return refs.select("key", F.explode(F.array_compact(F.array(*issues))).alias("issue"))


def surname_overlap(a: Column, b: Column) -> Column:
    """How many surnames two lists of names share, marks and case aside; null if either has no names."""
    names = lambda c: F.array_except(F.array_distinct(F.split(scalars.fold(F.array_join(F.transform(c, surname), "\u0001")), "\u0001")), F.array(F.lit("")))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(names(a), names(b))))


def best_open_access(candidates: DataFrame) -> DataFrame:
    """``(key, ord, score)`` of ``key, title, authors, year`` and ``ord, cand_title, cand_authors, cand_year``: the best candidate, of 0.5 and more, the first on a tie."""
    known = ~scalars.missing(F.col("title")) & ~scalars.missing(F.col("cand_title"))
    sim = F.when(known, matching.title_similarity(scalars.normalize_title(F.col("title")), scalars.normalize_title(F.col("cand_title"))))
    score = findings.oa_score(F.col("sim"), F.col("overlap"), F.col("year"), F.col("cand_year"))
    rows = candidates.withColumns({"sim": sim, "overlap": surname_overlap(F.col("authors"), F.col("cand_authors"))}).withColumn("score", score)
    best = rows.groupBy("key").agg(F.min_by(F.struct("ord", "score"), F.struct((-F.col("score")).alias("s"), "ord")).alias("b"))
    return best.select("key", "b.ord", "b.score").where(F.col("score") >= LEAST_OA)


def reliability_signals(claims: DataFrame, meta: DataFrame, bib: DataFrame) -> DataFrame:
    """``(key, reliability, signals)`` of references under 0.4, with what lowered them.

    claims ``(key, verdict, dismissed)``, meta ``(key, meta, retracted, tier,
    api_match, mismatches)``, bib ``(key, total, found, not_found, mismatches,
    retractions)``.
    """
    low = findings.reliability(claims, meta.select("key", "meta"), bib).where("unreliable").select("key", "reliability")
    active = ~F.coalesce("dismissed", F.lit(False))
    said = claims.groupBy("key").agg(F.count_if(active & (F.col("verdict") == "NOT_SUPPORTED")).alias("not_sup"), F.count_if(active & (F.col("verdict") == "PARTIALLY_SUPPORTS")).alias("partial"))
    m = meta.select("key", "retracted", "tier", "api_match", F.col("mismatches").alias("fields"))
    b = bib.where("total > 0").select("key", "total", "found", "not_found", F.col("mismatches").alias("differ"), "retractions")
    rows = low.join(said, "key", "left").join(m, "key", "left").join(b, "key", "left")
    share = lambda c, of: F.concat(F.format_string("%.0f", F.bround(100 * F.try_divide(c, of), 0)), F.lit("%"))
    kept = ~F.coalesce("retracted", F.lit(False))
    count = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    signals = F.array_compact(F.array(
        F.when(F.col("retracted"), "retracted"), F.when(kept & (F.col("tier") == "T3"), "not found in APIs"), F.when(kept & (F.col("api_match") == "mismatch"), "API metadata mismatch"), F.when(kept, count("fields", " field mismatch(es)")),
        count("not_sup", " claim(s) not supported"), count("partial", " claim(s) partially supported"),
        F.when(F.col("not_found") > 0, F.concat(F.col("not_found"), F.lit("/"), F.col("total"), F.lit(" bibliography entries not found in APIs ("), share(F.col("not_found"), F.col("total")), F.lit(")"))),
        count("retractions", " retracted entries in bibliography"), F.when(F.col("differ") > 0, F.concat(F.col("differ"), F.lit(" bibliography metadata mismatches ("), F.coalesce(share(F.col("differ"), F.col("found")), F.lit("0%")), F.lit(" of found)")))))
    return rows.select("key", "reliability", signals.alias("signals"))


def sections_of_hits(hits: DataFrame, sections: DataFrame, top_k: int) -> DataFrame:
    """``(query, doc, ord, title)``: the sections that hits ``(query, doc, rank, title)`` point at, of ``(doc, ord, title)``.

    Hits are gone through in their order. One whose title wasn't met yet brings
    its section, the first of that title, with the one before and the one after
    it that weren't met; once there are top_k, no more hits count. Are they 70 %
    of the document's sections or more, all are returned.
    """
    outline = sections.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"]).alias("titles"))
    ordered = hits.groupBy("query", "doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("hits"))
    none, at = F.array().cast("array<string>"), lambda i: F.get("titles", i)
    start = F.struct(none.alias("met"), F.array().cast("array<int>").alias("chosen"))

    def step(s: Column, title: Column) -> Column:
        i = F.array_position(F.col("titles"), title).cast("int") - 1
        met = F.array_append(s["met"], title)
        prior = (i > 0) & ~F.array_contains(met, at(i - 1))
        met_ = F.when(prior, F.array_append(met, at(i - 1))).otherwise(met)
        after = (i + 1 < F.size("titles")) & ~F.array_contains(met_, F.coalesce(at(i + 1), F.lit("")))
        new = F.filter(F.array(F.when(prior, i - 1), i, F.when(after, i + 1)), lambda x: x.isNotNull())
        added = F.struct(F.when(after, F.array_append(met_, at(i + 1))).otherwise(met_).alias("met"), F.concat(s["chosen"], new).alias("chosen"))
        skipped = F.struct(F.when(F.array_contains(s["met"], title), s["met"]).otherwise(met).alias("met"), s["chosen"].alias("chosen"))
        return F.when((F.size(s["chosen"]) >= top_k) | F.array_contains(s["met"], title) | (i < 0), skipped).otherwise(added)

    rows = ordered.join(outline, "doc").withColumn("chosen", F.aggregate("hits", start, step)["chosen"]).where(F.size("chosen") > 0)
    every = F.size("chosen") >= F.size("titles") * F.lit(ALL_FROM)
    picked = F.when(every, F.sequence(F.lit(0), F.size("titles") - 1)).otherwise(F.array_sort("chosen"))
    return rows.select("query", "doc", F.explode(picked).alias("ord"), "titles").select("query", "doc", "ord", F.get("titles", F.col("ord")).alias("title"))


def kept_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(key, api_match, manual_override, source_papers)`` after a new verification of ``(key, api_match, manual_override, source_papers)``.

    A verified match stays if the new one is not found; a manual override
    stays; papers that cite a reference are joined, old ones of a match that
    stays first. Keys of either side alone stay as they are.
    """
    o = old.select("key", *(F.col(c).alias(f"__{c}") for c in ("api_match", "manual_override", "source_papers")), F.lit(True).alias("__old"))
    rows = new.join(o, "key", "full")
    stays = F.coalesce((F.col("__api_match") == "verified") & (F.col("api_match") == "not_found"), F.lit(False)) | F.col("api_match").isNull()
    papers = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    before, now = papers(F.col("__source_papers")), papers(F.col("source_papers"))
    return rows.select("key", F.when(stays, F.col("__api_match")).otherwise(F.col("api_match")).alias("api_match"),
                       F.coalesce(F.nullif("__manual_override", F.lit("")), F.when(~stays, F.col("manual_override"))).alias("manual_override"),
                       F.when(stays, F.array_union(before, now)).otherwise(F.array_union(now, before)).alias("source_papers"))


def embedding_states(expected: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """``(key, state)`` of expected keys: missing, incomplete, other_model or ready, of stored ``(key, complete, model)``."""
    rows = expected.select("key").distinct().join(stored.select("key", "complete", "model"), "key", "left")
    state = F.when(F.col("complete").isNull(), "missing").when(F.col("complete") != 1, "incomplete").when(~F.col("model").eqNullSafe(F.lit(model)), "other_model").otherwise("ready")
    return rows.select("key", state.alias("state"))


def infrastructure_error(explanation: Column) -> Column:
    """The text tells of a tool that failed, not of the claim."""
    low = F.lower(F.coalesce(explanation, F.lit("")))
    return F.greatest(*[F.contains(low, F.lit(p)) for p in INFRASTRUCTURE])


def broken_references(sections: DataFrame) -> DataFrame:
    """``(paper, section, match)``: rendered references without a target in ``(paper, title, text)``, each once a section."""
    found = F.transform(F.regexp_extract_all("text", F.lit(BROKEN), 0), stripped)
    return sections.select("paper", F.col("title").alias("section"), F.explode(found).alias("match")).distinct()


def bracket_contexts(docs: DataFrame) -> DataFrame:
    """``(paper, number, context)`` of bracketed numbers in ``(paper, text)``, with their paragraph; the same number with the same first 100 characters counts once."""
    paragraph = docs.select("paper", F.posexplode(F.split("text", "\n\n", -1)).alias("p", "raw")).withColumn("context", stripped(F.col("raw")))
    found = paragraph.select("paper", "p", "context", F.posexplode(F.regexp_extract_all("raw", F.lit(BRACKETS), 1)).alias("b", "numbers"))
    each = found.select("paper", "p", "b", "context", F.posexplode(F.split("numbers", r"[,;]\s*")).alias("i", "number")).withColumn("number", stripped(F.col("number"))).where(F.col("number").rlike(r"^\d+$"))
    first = F.min_by("context", F.struct("p", "b", "i")).alias("context")
    return each.groupBy("paper", F.col("number").cast("int").alias("number"), F.left("context", F.lit(100)).alias("head")).agg(first).select("paper", "number", "context")


def line_at(text: Column, at: Column) -> Column:
    """The line, from 1, of the character at, from 0."""
    return F.regexp_count(F.substring(text, F.lit(1), at), F.lit("\n")) + 1


def in_environment(text: Column, at: Column, name: str) -> Column:
    """Whether the character at, from 0, lies in an environment: more begin than end before it."""
    before = F.substring(text, F.lit(1), at)
    return F.regexp_count(before, F.lit(rf"\\begin\{{\Q{name}\E\}}")) > F.regexp_count(before, F.lit(rf"\\end\{{\Q{name}\E\}}"))


def recent(rows: DataFrame, time: str, n: int, *ties: Column, by: str | None = None) -> DataFrame:
    """The last n rows, newest first; with by, the last n of each of its values."""
    if by is None:
        return rows.orderBy(F.desc(time), *ties).limit(n)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(time), *ties))).where(F.col("__n") <= n).drop("__n")
