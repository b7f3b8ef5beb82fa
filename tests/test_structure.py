"""Sections, passages and identifiers on small fixtures with their edge cases."""

from pyspark.sql import functions as F

from marginalia.operators import structure


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_sections(spark):
    text = "\\begin{document}a\n\\section*{One} \\label{s:one}\nx y \\cite{a, b}\n\\subsection{Two}\n\nz % \\section{No}\n\\label{s:two}\n\\begin{thebibliography}\\section{Bib}\\end{thebibliography}\\end{document}\\section{After}"
    d = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "\\section{Last}\\label{l}")], "paper long, text string")
    out = structure.section_table(d)
    # the label of Two stands three lines below; a heading in the last line has none
    assert rows(out, "paper", "ord", "depth", "title", "label", "start_line", "end_line", "words", "cites") == [
        (1, 0, 0, "One", "s:one", 2, 3, 4, 2), (1, 1, 1, "Two", "", 4, 8, 2, 0), (4, 0, 0, "Last", "", 1, 1, 0, 0)]
    assert rows(d.select(structure.abstract(F.lit("% \\begin{abstract}\n\\begin{abstract}\n A b.\n\\end{abstract}")))) == [("A b.",)] * 4


def test_section_pairs(spark):
    s = spark.createDataFrame([(1, 0, "INTRO and method", "i"), (1, 1, "Results", "r" * 4000), (1, 2, "Discussion of findings", "d"), (2, 0, "Results", "x"), (3, 0, None, None)], "paper long, ord int, title string, text string")
    a = spark.createDataFrame([(1, ""), (2, "abs"), (4, None)], "paper long, text string")
    assert rows(structure.section_pairs(s, a).selectExpr("paper", "pair", "a_label", "b_label", "length(b_text)")) == [
        (1, "Introduction vs Conclusion", "INTRO and method", "Discussion of findings", 1), (1, "Methods vs Results", "INTRO and method", "Results", 3000), (2, "Abstract vs Results", "Abstract", "Results", 1)]
    assert rows(structure.section_pairs(s, a, most_chars=10), "paper") == [(2,)]
    assert structure.section_pairs(s.limit(0), a.limit(0)).count() == 0


def test_swept_identifiers(spark):
    kinds = "doi string, arxiv_id string, pmid string, pmc_id string, isbn string, lccn string"
    d = spark.createDataFrame([
        (1, [("doi", "10.1111/no"), ("note", "arXiv:2101.00001 10.1111/a."), ("more", "10.2222/b PMID 1234567")], None, "", None, None, None, None),
        (2, [("note", "isbn-9781234567897 lccn: 12345678"), ("x", None)], "10.3/own", None, None, None, None, None),
        (3, None, None, None, None, None, None, None)], "key long, fields array<struct<name:string,value:string>>, " + kinds)
    assert [tuple(r)[2:] for r in structure.swept_identifiers(d).orderBy("key").collect()] == [
        ("10.1111/a", "2101.00001", "1234567", None, None, None), ("10.3/own", None, None, None, "9781234567897", "12345678"), (None,) * 6]


def test_plausible(spark):
    d = spark.createDataFrame([
        (1, "Deep Nets: a tour", ["Ann Lee"], "2010", "deep nets", ["Lee, Ann"], 2025),
        (2, "Deep nets", ["Ann Lee"], "2010", "0123456789", ["Ann Lee"], 2010),
        (3, "Deep nets", ["Ann Lee"], "2010", "deep nets", ["Xu Zzyzx"], 2025),
        (4, "Deep nets", [], "n.d.", "Deep nets", None, None),
        (5, "", ["Ann Lee"], "2010", "0123456789", ["Xu Zzyzx"], 1900),
        (6, "Deep nets", None, None, None, None, None)], "key long, title string, authors array<string>, year string, api_title string, api_authors array<string>, api_year int")
    assert rows(d.select("key", structure.plausible())) == [(1, True), (2, False), (3, False), (4, True), (5, True), (6, True)]


def test_responses_and_addresses(spark):
    asked = spark.createDataFrame([(1, "10.1/A", "x1"), (2, None, "X2"), (3, "10.1/a", "")], "key long, doi string, arxiv_id string")
    got = spark.createDataFrame([(1, "10.1/a", "x2"), (2, "10.9/z", "x2"), (3, None, None)], "response long, doi string, arxiv_id string")
    assert rows(structure.matched_responses(asked, got), "response", "key") == [(1, 3), (2, 2)]
    d = spark.createDataFrame([("https://A.org:8/x?q",), ("http://www.a.org",), ("no address",), (None,)], "url string")
    assert [r[0] for r in d.select(structure.www_variant(F.col("url"))).collect()] == ["https://www.a.org:8/x?q", "http://a.org", None, None]


def test_markdown_blocks_take_no_shuffle(spark):
    """Blocks are grouped where their text is."""
    from marginalia.sources import markdown

    text = "---\na: b\n---\nlead\n```x\n# no heading\n\n~~~\nafter\nmore\n\n## *One* ##\ntext\n# Two\n```\nopen\n"
    blocks = markdown.blocks(spark.createDataFrame([(1, text), (2, None), (3, "")], "paper int, text string"))
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in blocks.orderBy("n").collect()] == [
        (1, 1, "text", "lead", ""), (1, 2, "code", "```x\n# no heading\n\n~~~", ""), (1, 3, "text", "after\nmore", ""), (1, 5, "heading", "## *One* ##", "One"),
        (1, 6, "text", "text", "One"), (1, 7, "heading", "# Two", "Two"), (1, 8, "code", "```\nopen\n", "Two")]


def test_markdown_references_are_found_in_one_reading(spark):
    from marginalia.plans import catalogue, reviews  # noqa: F401
    from marginalia.sources import markdown

    d = spark.createDataFrame([(1, "![a](b){#fig:a}\n\n![c](d){#fig:c}\n\nsee @fig:c and @fig:x, @sec:y\n\n```{#lst:z}\n@fig:a\n```\n\n# Head {#sec:y}\n"), (2, None)], "paper int, text string")
    assert sorted(tuple(r) for r in markdown.reference_problems(d).collect()) == [(1, "fig:a", "unreferenced"), (1, "fig:x", "dangling")]
    assert [r["label"] for r in markdown.dangling_crossrefs(d).collect()] == ["fig:x"] and [r["label"] for r in markdown.unreferenced_figures(d).collect()] == ["fig:a"]
    plan = catalogue.QUERIES["markdown_references"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
