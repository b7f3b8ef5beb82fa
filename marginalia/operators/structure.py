"""Sections of manuscripts, passages to compare, and identifiers of bibliography entries.

A document is one row: its lines and sections are arrays inside that row, so
that sections need no shuffle. Null texts give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import latex
from marginalia.operators import matching
from marginalia.operators.extract import CITE

DEPTHS = {"section": 0, "subsection": 1, "subsubsection": 2}
HEADING = r"\\(section|subsection|subsubsection)\*?\{(.+?)\}"

# fixed values: words in titles that give a section its role, and the roles that are compared
ROLES = {
    "introduction": ["introduction", "intro"],
    "methods": ["method", "methodology", "approach"],
    "results": ["result", "finding", "experiment", "evaluation"],
    "conclusion": ["conclusion", "discussion"],
}
PAIRS = [
    ("abstract", "results", "Abstract vs Results"),
    ("abstract", "conclusion", "Abstract vs Conclusion"),
    ("introduction", "conclusion", "Introduction vs Conclusion"),
    ("methods", "results", "Methods vs Results"),
]
PASSAGE = 3000

# fixed values: identifiers in free text, and the fields that have been read before
IDENTIFIERS = {
    "doi": r"(10\.\d{4,9}/[^\s,}]+)",
    "arxiv_id": r"(?i)arXiv[:\s]+(\d{4}\.\d{4,5})",
    "pmid": r"PMID[:\s]+(\d{6,9})",
    "pmc_id": r"(PMC\d{6,8})\b",
    "isbn": r"(?i)(?:ISBN[:\s-]*)?(97[89]\d{10}|\d{9}[\dXx])",
    "lccn": r"(?i)LCCN[:\s]+(\d{8,12})",
}
STANDARD_FIELDS = ["doi", "eprint", "url", "eprinttype", "archiveprefix", "isbn", "lccn"]
PLAUSIBLE = 0.40


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def without_bibliography(text: Column) -> Column:
    """The document's body without its list of references."""
    return F.regexp_replace(latex.body(text), r"(?s)\\begin\{thebibliography\}.*?\\end\{thebibliography\}", "")


def abstract(text: Column) -> Column:
    """The abstract, comments cut; empty if there is none."""
    return stripped(F.regexp_extract(latex.strip_comments(text), r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}", 1))


def section_table(docs: DataFrame) -> DataFrame:
    """``(paper, ord, depth, title, label, start_line, end_line, words, cites, text)`` of each heading, lines of the body from 1.

    A line counts by its first heading. The label is the first on the heading's
    line or the two after it, the body's last line left out. Text runs to the
    line before the next heading, whatever its depth.
    """
    body = docs.select("paper", F.split(without_bibliography(latex.strip_comments(F.col("text"))), "\n").alias("ls"))
    heads = F.filter(F.transform("ls", lambda s, i: F.struct((i + 1).alias("line"), F.regexp_extract(s, HEADING, 1).alias("kind"), F.regexp_extract(s, HEADING, 2).alias("title"))), lambda h: h["kind"] != "")
    n = F.size("ls")

    def section(h: Column, k: Column) -> Column:
        end = F.coalesce(F.get("heads", k + 1)["line"] - 1, n)
        near = F.array_join(F.slice("ls", h["line"], F.greatest(F.least(h["line"] + 3, n) - h["line"], F.lit(0))), "\n")
        return F.struct(k.alias("ord"), h["kind"].alias("kind"), h["title"].alias("title"), F.regexp_extract(near, r"\\label\{([^}]+)\}", 1).alias("label"),
                        h["line"].alias("start_line"), end.alias("end_line"), F.array_join(F.slice("ls", h["line"] + 1, end - h["line"]), "\n").alias("text"))

    rows = body.withColumn("heads", heads).select("paper", F.explode(F.transform("heads", section)).alias("s")).select("paper", "s.*")
    keys = F.flatten(F.transform(F.regexp_extract_all(latex.strip_verbatim(F.col("text")), F.lit(CITE), 1), lambda a: F.filter(F.split(a, ","), lambda key: F.trim(key) != "")))
    depth = F.create_map(*[F.lit(x) for kv in DEPTHS.items() for x in kv])[F.col("kind")]
    return rows.select("paper", "ord", depth.alias("depth"), "title", "label", "start_line", "end_line", latex.word_count(F.col("text")).alias("words"), F.size(keys).alias("cites"), "text")


def section_pairs(sections: DataFrame, abstracts: DataFrame, most_chars: int | None = None) -> DataFrame:
    """``(paper, pair, a_label, a_text, b_label, b_text)``: passages to compare, of ``paper, ord, title, text`` and ``paper, text``.

    A section has every role whose words its title holds; those of a role are
    joined in order and cut at 3,000 characters. Pairs with a side missing or
    empty abstracts give no row, nor do papers of over ``most_chars`` in all.
    """
    title = F.lower("title")
    held = F.filter(F.array(*[F.when(F.greatest(*[F.contains(title, F.lit(w)) for w in words]), role) for role, words in ROLES.items()]), lambda r: r.isNotNull())
    rows = sections.select("paper", "ord", "title", F.left("text", F.lit(PASSAGE)).alias("text"), F.length("text").alias("chars"), held.alias("roles"))
    rows = rows.unionByName(abstracts.where("text <> ''").select("paper", F.lit(-1).alias("ord"), F.lit("Abstract").alias("title"), F.left("text", F.lit(PASSAGE)).alias("text"), F.length("text").alias("chars"), F.array(F.lit("abstract")).alias("roles")))
    # a section without a role counts in the paper's size
    rows = rows.select("paper", "ord", "title", "text", F.explode_outer("roles").alias("role"), (F.col("chars") / F.greatest(F.size("roles"), F.lit(1))).alias("chars"))
    joined = F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n"), F.lit(PASSAGE))
    sides = rows.groupBy("paper", "role").agg(F.sum("chars").alias("chars"), F.when(F.col("role").isNotNull(), joined).alias("text"), F.min_by("title", "ord").alias("label"))
    entry = F.when(F.col("role").isNotNull(), F.struct("role", F.struct("label", "text").alias("side")))
    papers = sides.groupBy("paper").agg(F.map_from_entries(F.collect_list(entry)).alias("m"), F.sum("chars").alias("chars"))
    if most_chars is not None:
        papers = papers.where(F.round("chars") <= most_chars)
    pair = F.explode(F.array(*[F.struct(F.lit(name).alias("pair"), F.col("m")[a].alias("a"), F.col("m")[b].alias("b")) for a, b, name in PAIRS]))
    out = papers.select("paper", pair.alias("p")).where("p.a IS NOT NULL AND p.b IS NOT NULL")
    return out.select("paper", "p.pair", F.col("p.a.label").alias("a_label"), F.col("p.a.text").alias("a_text"), F.col("p.b.label").alias("b_label"), F.col("p.b.text").alias("b_text"))


def swept_identifiers(entries: DataFrame) -> DataFrame:
    """Entries with missing identifiers filled from ``fields`` (name, value), in the entry's order, standard fields left out.

    Identifiers there stay; what no field holds is null.
    """
    swept = F.filter("fields", lambda f: ~F.lower(f["name"]).isin(*STANDARD_FIELDS) & ~f["name"].isin("ID", "ENTRYTYPE"))
    entries = entries.withColumn("__values", F.transform(swept, lambda f: F.coalesce(f["value"], F.lit(""))))

    def filled(name: str, pattern: str) -> Column:
        found = F.get(F.filter(F.transform("__values", lambda v: F.regexp_extract(v, pattern, 1)), lambda x: x != ""), F.lit(0))
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.regexp_replace(found, r"\.+\z", "") if name == "doi" else found)

    return entries.withColumns({name: filled(name, p) for name, p in IDENTIFIERS.items()}).drop("__values")


def bib_text(c: Column) -> Column:
    """Plain text of a bibliography entry: markup unwrapped, addresses and block marks dropped, blanks collapsed."""
    for command in ("emph", "textbf", "texttt"):
        c = F.regexp_replace(c, r"\\" + command + r"\{([^}]+)\}", "$1")
    c = F.regexp_replace(c, r"\\url\{[^}]*\}", "")
    c = F.regexp_replace(c, r"\{([^}]*)\}", "$1")
    c = F.regexp_replace(F.replace(c, F.lit("~"), F.lit(" ")), r"\\newblock\s*", "")
    return stripped(F.regexp_replace(c, r"\s+", " "))


def bib_authors(c: Column) -> Column:
    """Names parted by ``and`` or ``&``; single characters go."""
    parts = F.split(F.regexp_replace(bib_text(c), r"\.+\z", ""), r"\s+and\s+|\s*&\s*|\s*,\s+and\s+")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(stripped(p), r",+\z", "")), lambda p: F.length(p) > 1)


def bib_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\b(19\d{2}|20\d{2})\b", 1), F.lit(""))


def bib_doi(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(c, IDENTIFIERS["doi"], 1), r"\.+\z", ""), F.lit(""))


def plausible() -> Column:
    """Whether a record that an identifier led to can be the cited work, of ``title, authors, year, api_title, api_authors, api_year``.

    Titles count whole or up to a colon, times half of the authors' overlap and
    half without, times nearness of years, at least a half. Where a title is
    missing the identifier is trusted; missing authors and years don't count.
    """
    title, other = F.lower("title"), F.lower(F.trim("api_title"))
    named = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    authors = F.when(named("authors") & named("api_authors"), matching.author_similarity(F.col("authors"), F.col("api_authors"))).otherwise(1.0)
    year = F.when(F.col("year").rlike(r"\A\d+\z"), F.try_to_number("year", F.lit("9999999999")))
    near = F.coalesce(F.greatest(F.lit(0.5), matching.year_factor(year.cast("double"), F.col("api_year").cast("double"))), F.lit(1.0))
    missing = (F.coalesce(title, F.lit("")) == "") | (F.coalesce(other, F.lit("")) == "")
    return missing | (matching.title_similarity(title, other) * (0.5 + 0.5 * authors) * near >= PLAUSIBLE)


def conflicting_ids(refs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``(key, kind, id, api_title)``: identifiers of an entry that lead to another work than its canonical record.

    Refs hold the canonical record's ``title, authors, year``, the identifier
    it was found by as ``found_by`` (kind, id), and ``ids``, an array of the same; catalogue has ``kind,
    id, api_title, api_authors, api_year``. Identifiers compare without case;
    those that the catalogue lacks, and the one found by, are no conflict.
    """
    each = refs.select("key", "title", "authors", F.col("year").cast("string").alias("year"), "found_by", F.explode("ids").alias("i"))
    same = (F.col("i.kind") == F.col("found_by.kind")) & (F.lower("i.id") == F.lower("found_by.id"))
    each = each.where(~F.coalesce(same, F.lit(False))).select("key", "title", "authors", "year", F.col("i.kind").alias("kind"), F.col("i.id").alias("id"), F.lower("i.id").alias("__id"))
    met = each.join(catalogue.withColumnRenamed("id", "__id").withColumn("__id", F.lower("__id")), ["kind", "__id"])
    return met.where(~plausible()).select("key", "kind", "id", F.left("api_title", F.lit(60)).alias("api_title"))


def matched_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """``(response, key)``: the request that a response answers, by DOI, else by arXiv identifier, without case.

    Of several requests with one identifier the largest key is taken; a
    response that answers none has no row.
    """
    melt = lambda df, col: df.select(col, F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.lower("doi").alias("id")), F.struct(F.lit(1).alias("rank"), F.lower("arxiv_id").alias("id")))).alias("x")).select(col, "x.*").where("id <> ''")
    asked = melt(requests, "key").groupBy("rank", "id").agg(F.max("key").alias("key"))
    return melt(responses, "response").join(asked, ["rank", "id"]).groupBy("response").agg(F.min_by("key", "rank").alias("key"))


def www_variant(url: Column) -> Column:
    """The address with ``www.`` put before its host, or taken away; user names go, ports stay."""
    part = lambda k: F.regexp_extract(url, r"\A([^:/?#]+://)(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?((?s).*)\z", k)
    host = F.lower(part(2))
    return F.when(part(1) != "", F.concat(part(1), F.when(host.startswith("www."), F.substr(host, F.lit(5))).otherwise(F.concat(F.lit("www."), host)), part(3), part(4)))
