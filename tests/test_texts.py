"""Text operators on small manuscripts with edges."""

import random

from pyspark.sql import functions as F

from marginalia.operators import arguments, extract, sections

DOC = r"\begin{document}" + "\n"


def papers(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "paper int, text string")


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_arguments_are_balanced_over_lines(spark):
    d = papers(spark, "a \\label{x{y}\nz}\n\\label{open \\ref{in}", "} \\label{after}", None, "no commands", "\\xlabel{no}\\label{}")
    assert got(arguments.command_arguments(d, ["label", "ref"]), "paper", "command", "line", "argument") == [
        (0, "label", 1, "x{y}\nz"), (0, "ref", 3, "in"), (1, "label", 1, "after"), (4, "label", 1, "")]
    assert arguments.command_arguments(d.limit(0), ["label"]).count() == 0


def test_flat_texts_are_read_without_python(spark, monkeypatch):
    """Texts go to Python only if their braces nest or don't match; what is found is the same."""
    rng = random.Random(5)
    parts = ["\\ref{", "\\label{", "\\eqref{a}", "\\label{b}", "{", "}", "a", "\n", "\\xref{q}"]
    texts = ["\\ref{a}" * 20_000, "\\ref{}", "", "} \\ref{a}", "{\\ref{a}}"] + ["".join(rng.choices(parts, k=rng.randint(1, 8))) for _ in range(300)]
    d, names = papers(spark, *texts, None), ["ref", "eqref", "label"]
    want = {r["paper"]: r["a"] and [(x["command"], x["argument"]) for x in r["a"]] for r in d.select("paper", arguments.arguments_of(F.col("text"), names).alias("a")).collect()}
    assert {r["paper"]: r["a"] and [tuple(x) for x in r["a"]] for r in d.select("paper", arguments.named_arguments(F.col("text"), names).alias("a")).collect()} == want
    sent, read = [], arguments.arguments_of
    monkeypatch.setattr(arguments, "arguments_of", lambda text, commands: sent.append(text) or read(text, commands))
    extract.dangling_refs(papers(spark, "\\ref{a}")).collect()
    flat = papers(spark, "\\ref{a} \\label{b}", "\\ref{a{b}}", "\\ref{open")
    assert [r[0] is None for r in flat.select(sent[0]).collect()] == [True, False, False]


def test_references_of_the_body(spark):
    d = papers(spark, "\\ref{before}\n" + DOC + "\\ref{a} \\ref{b} % \\label{b}\n\\eqref{a\nb}\n\\label{a}\n\\begin{verbatim}\\ref{v}\\end{verbatim}\n\\end{document}\\ref{later}", "\\pageref{all of it}")
    assert got(extract.dangling_refs(d), "paper", "label") == [(0, "a\nb"), (0, "b"), (0, "v"), (1, "all of it")]
    f = papers(spark, "\\begin{figure}\\label{fig:a}\\label{fig:{b}\\end{figure}\\ref{fig:a} \\begin{figure}\\label{fig:c}\\end{figure}")
    assert got(extract.unreferenced_figures(f), "label") == [("fig:c",), ("fig:{b",)]


def test_sections_merge_and_split(spark):
    small, mid, large = "s" * 199, "m" * 200, "\n\n".join("p" * 1500 for _ in range(6))
    d = papers(spark, f"{small}\n# A\n{mid}\n## B\n{small}\n### C\n\n#### D\n{mid}", f"# L\n{large}", "   \n", None, f"{mid}", f"# T\n{small}", "# Only\n", f"intro\n# A \nx\n# B\n{mid}")
    rows = {(p, o): (t, x) for p, o, t, x in got(sections.markdown_sections(d), "paper", "ord", "title", "text")}
    assert rows[0, 0] == ("A", f"{small}\n\n{mid}\n\n{small}") and rows[0, 1] == ("C", f"#### D\n{mid}") and (0, 2) not in rows
    assert [rows[1, i][0] for i in range(5)] == [f"L (part {i + 1})" for i in range(5)] and (1, 5) not in rows
    assert [rows[1, i][1].count("p" * 1500) for i in range(5)] == [2, 2, 2, 2, 2]  # 1500 of 3000 characters are shared
    assert rows[2, 0] == ("Full text", "   \n") and rows[4, 0] == ("Chunk 1", mid) and rows[5, 0] == ("T", small)
    assert (6, 0) not in rows or rows[6, 0][1].strip() == ""
    assert rows[7, 0] == ("B", f"intro\n\nx\n\n{mid}") and not [k for k in rows if k[0] == 3]


def test_one_long_paragraph_is_one_chunk(spark):
    d = papers(spark, "x" * 9000, "\n\n".join(["y" * 5000] * 2))
    assert got(sections.markdown_sections(d), "paper", "ord", "title") == [(0, 0, "Chunk 1 (part 1)"), (1, 0, "Chunk 1"), (1, 1, "Chunk 2")]


def test_paragraph_offsets_point_into_the_text(spark):
    text = "one\ntwo\n \nthree \\subsection*{S} four\n\n\n  five  "
    found = got(sections.paragraphs(papers(spark, text)), "ord", "start", "text")
    assert [t for _, _, t in found] == ["one\ntwo", "three", "\\subsection*{S} four", "five"]
    assert all(text[s:].lstrip().startswith(t) for _, s, t in found)


def test_context_windows(spark):
    late = "x" * 90 + "\\cite{b, c}"
    d = papers(spark, "% one\n" + DOC + f"\\textbf{{First}}  \\cite{{a}}\n\n{late}\n\nnext\n\\bibliography{{r}} \\cite{{no}}", "\\cite{without a begin}", None)
    rows = {r["key"]: r for r in sections.citation_contexts(d).collect()}
    assert set(rows) == {"a", "b", "c"} and rows["a"]["line"] == 3 and rows["b"]["line"] == 5
    assert rows["a"]["context"] == f"document First [TARGET_CITE] {'x' * 90}[CITE]"  # in the last fifth, so the next paragraph comes too
    assert rows["c"]["context"] == f"document First [CITE] {'x' * 90}[TARGET_CITE] next"
    start = len(DOC) + len("\\textbf{First}  ")
    assert rows["a"]["at"] == start


def test_footnotes_and_captures(spark):
    d = papers(spark, DOC + "A claim\\footnote{See \\url{https://A.org/x/} {and} \\url{ https://b.org }} holds.\n\n\\footnote{\\url{https://c.org}}")
    claims = sections.footnote_claims(d)
    assert got(claims, "url") == [("https://A.org/x/",), ("https://b.org",), ("https://c.org",)]
    files = spark.createDataFrame([("https://a.org/x#y", "b.md"), ("https://a.org/x", "a.md")], "url string, file string")
    assert [r["file"] for r in sections.captured_footnotes(claims, files).orderBy("url").collect()] == ["a.md", None, None]


def test_texts_are_read_once(spark):
    """A text that is another each time it is made, as one collected from a shuffle can be, still gives its own arguments."""
    mixed = F.udf(lambda lines: "\n".join(sorted(lines, key=lambda _: random.SystemRandom().random())), "string").asNondeterministic()
    lines = F.array(*[F.lit("\\begin{figure}\\label{fig:" + "x" * n + "}\\end{figure} \\ref{fig:" + "x" * n + "}") for n in range(1, 9)])
    made = spark.range(200).select(F.col("id").alias("paper"), mixed(lines).alias("text"))
    assert got(arguments.command_arguments(made, ["ref"]).groupBy("argument").count(), "argument", "count") == [("fig:" + "x" * n, 200) for n in range(1, 9)]
    assert extract.unreferenced_figures(made).count() == 0 and extract.dangling_refs(made).count() == 0


def test_braces_without_partners(spark):
    d = papers(spark, "} \\label{a} }} { \\label{b{c} \\ref{d}", "\\label{\\label{in} out}\n\n{}\\ref{é}")
    assert got(arguments.command_arguments(d, ["label", "ref"]), "paper", "command", "line", "argument") == [
        (0, "label", 1, "a"), (0, "ref", 1, "d"), (1, "label", 1, "\\label{in} out"), (1, "label", 1, "in"), (1, "ref", 3, "é")]


def test_pages_that_share_a_key_keep_their_captures(spark):
    """Two addresses whose synthetic keys are the same, as happens among a million."""
    one, two = "https://a.org/537029", "https://a.org/2084523"
    claims = sections.footnote_claims(papers(spark, DOC + f"A claim\\footnote{{\\url{{{one}}}}} holds.\n\nAnother\\footnote{{\\url{{{two}}}}} too."))
    files = spark.createDataFrame([(two, "two.md"), (one + "/#x", "zero.md")], "url string, file string")
    rows = sections.captured_footnotes(claims, files).collect()
    assert len({r["key"] for r in rows}) == 1 and {r["url"]: r["file"] for r in rows} == {one: "zero.md", two: "two.md"}
