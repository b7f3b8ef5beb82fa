"""Markdown papers and the catalogue of checks on cases with edges."""

from marginalia.operators import checks
from marginalia.sources import markdown


def papers(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "paper int, text string")


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_markdown_blocks_and_keys(spark):
    d = papers(spark, "Text @a:b.c. and @{odd key}, @{x/y} -@neg [-@sup] mail me@x.org \\@no `@code`\n~~~\n@no\n\n# no\n~~~\nafter @z\n# Head @in-head {.c #own}\n\n> quoted @q\n\n- item @i^[note @n]", "@only\r\n\r\n\r\n## ", None, "")
    assert got(markdown.citations(d), "paper", "key") == [(0, "a:b.c"), (0, "i"), (0, "in-head"), (0, "n"), (0, "neg"), (0, "q"), (0, "sup"), (0, "x/y"), (0, "z"), (1, "only")]
    rows = {r["key"]: (r["context"], r["section"]) for r in markdown.citations(d).collect()}
    assert rows["z"] == ("after @z", "") and rows["in-head"] == ("Head @in-head", "Head @in-head") and rows["i"] == ("- item @i", "Head @in-head")
    assert got(markdown.labels(d), "paper", "label") == [(0, "own"), (1, "section")]


def test_markdown_crossrefs_and_figures(spark):
    d = papers(spark, "See @fig:a, @sec:s and @eq:none.\n\n![c](x){#fig:a}\n\n![c](y){#fig:b}\n\nInline ![c](z){#fig:c} text\n\n# S {#sec:s}\n\n# 3 Plain Words, here!\n")
    assert got(markdown.crossrefs(d), "target", "kind") == [("eq:none", "eq"), ("fig:a", "fig"), ("sec:s", "sec")]
    assert got(markdown.dangling_crossrefs(d), "label") == [("eq:none",)]
    assert got(markdown.unreferenced_figures(d), "label") == [("fig:b",)]
    assert ("plain-words-here", False) in got(markdown.labels(d), "label", "figure")


def test_front_matter_and_styles(spark):
    d = papers(spark, "---\nbibliography: one.bib\n---\nx [@k]", "---\nbibliography:\n  - a.bib\n  - 'b.bib'\nother: y\n...\n[1, 2]", "---\nbibliography: [ ]\n---\n", "bibliography: no.bib", None)
    assert got(markdown.bibliographies(d), "paper", "path") == [(0, "one.bib"), (1, "a.bib"), (1, "b.bib")]
    assert got(markdown.citation_styles(d), "paper", "style") == [(0, "pandoc"), (1, "numeric"), (2, "none"), (3, "none"), (4, "none")]


def test_answers_and_queries(spark):
    answers = spark.createDataFrame([(1, "c", '{"issues": [{"description": "d", "is_genuine": true}, {"is_genuine": null}, {"description": 5, "is_genuine": true}]}'), (2, "c", "[1]"), (3, "c", None), (4, "c", ""), (5, "c", '{"issues": "none"}'), (6, "c", '{"other": 1}')], "paper int, check_id string, answer string")
    assert got(checks.answered_findings(answers), "paper", "rule_id", "message", "context") == [(1, "c", "5", ""), (1, "c", "d", ""), (3, "llm-unavailable", "c: LLM call exhausted retries; check did not run", "")]
    sections = spark.createDataFrame([(1, 2, 1, "B", "two"), (1, 1, 0, "A", "one"), (1, 3, 0, "Works Cited", "x"), (2, 1, 0, "A", "word " * 100)], "paper int, ord int, depth int, title string, text string")
    bodies = checks.paper_bodies(sections, spark.createDataFrame([(1, "abs"), (3, "")], "paper int, text string"))
    assert got(bodies, "paper", "body")[0] == (1, "## Abstract\n\nabs\n\n## A\n\none\n\n### B\n\ntwo")
    catalogue = spark.createDataFrame([("a", "full", "q", False), ("f", "full", "q", True), ("off", "full", "q", False), ("r", "reference-db", "q", False)], "check_id string, category string, question string, requires_figures boolean")
    off = spark.createDataFrame([("off",), ("r",)], "check_id string")
    asked = checks.check_queries(bodies, spark.createDataFrame([(1, "fig")], "paper int, text string"), checks.selected_checks(catalogue, off, "full"), 40)
    assert got(asked, "paper", "check_id", "figures") == [(1, "a", "fig"), (1, "f", "fig")]  # the other paper is too long
    assert checks.uses_reference_db(catalogue).first()["uses"] and not checks.uses_reference_db(catalogue, off).first()["uses"]
