"""Operators on small fixtures with their edge cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import latex
from marginalia.functions import scalars as S
from marginalia.operators import components, extract, graph, matching, resolve, scoring
from marginalia.sources import readers
from marginalia.streaming import timestate


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "paper long, text string")


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_cites(spark):
    d = docs(spark, "\\cite{a, b} 5\\% \\citep{c} % \\cite{no}\n\\citep[p. 1]{d} \\citeunverified{e}")
    assert rows(extract.cite_keys(d)) == [(0, 1, "a"), (0, 1, "b"), (0, 1, "c"), (0, 2, "e")]
    assert rows(extract.bare_keys(d), "key") == [("a",), ("b",), ("c",)]


def test_brackets_and_figures(spark):
    assert rows(extract.bracket_citations(docs(spark, "as in [1,2; 3] and [3], not [x]")), "number") == [(1,), (2,), (3,)]
    assert rows(extract.figure_numbers(docs(spark, "Figures 1-3, 5 and 7; Fig. 9.")), "number") == [(1,), (2,), (3,), (5,), (7,), (9,)]


def test_sentences_and_paragraphs(spark):
    got = docs(spark, "See Smith et al. Then stop. Next one! no split").select(extract.sentences(F.col("text"))).first()[0]
    assert got == ["See Smith et al. Then stop.", "Next one! no split"]
    assert rows(extract.paragraphs(docs(spark, "a\nb\n\n \nc"))) == [(0, 1, "a\nb"), (0, 5, "c")]


def test_chunks(spark):
    long = "X" * 10_001
    got = extract.chunks(docs(spark, "one.\n\ntwo.\n\nthree.", f"p\n\n{long}"))
    assert rows(got.where("granularity = 'paragraph'"), "paper", "text") == [(0, "one.\n\ntwo."), (0, "one.\n\ntwo.\n\nthree."), (0, "two.\n\nthree.")]


def test_numbered_entries(spark):
    text = "1. A. doi: 10.1234/ab, x\n2. B. arXiv:2101.00001v2\n3. C\n4. Smith, J. (2020). A long enough title\nhere. doi:10.5555/xyz.\n"
    assert rows(extract.numbered_entries(docs(spark, text))) == [
        (0, 1, "10.1234/ab", None, None, None), (0, 2, None, "2101.00001v2", None, None), (0, 4, "10.5555/xyz", None, None, None)]
    assert rows(extract.numbered_entries(docs(spark, "7. Smith, J. (2020). A long enough title here. More")), "number", "title") == [(7, "A long enough title here")]


def test_verbatim_text_cites_nothing(spark):
    d = docs(spark, "\\cite{a}\n\\begin{Verbatim}\n\\cite{b}\n\\end{Verbatim}\n\\verb|\\cite{c}| \\cite{d}\n\\autoref{x} \\ref{y}")
    assert rows(extract.cite_keys(d), "line", "key") == [(1, "a"), (5, "d")]
    assert rows(extract.dangling_refs(d), "label") == [("y",)]


def test_figures_and_cited_entries(spark):
    d = docs(spark, "\\begin{document}\n\\begin{figure*}\\label{fig:a}\n\\label{tab:x}\\end{figure*}\\begin{figure}\\label{fig:b}\\end{figure} \\ref{fig:b} \\label{fig:c} \\nocite{k1, *} \\cite{k2}\\end{document}")
    assert rows(extract.unreferenced_figures(d), "label") == [("fig:a",)]
    aux = docs(spark, "\\citation{k3,k4}\n\\bibcite{k9}{1}")
    assert rows(extract.cited(d, aux), "key") == [("*",), ("k1",), ("k2",), ("k3",), ("k4",)]


def test_dangling_needs_a_bibliography(spark):
    cites = spark.createDataFrame([(1, 3, "a"), (1, 2, "a"), (1, 1, "b"), (2, 1, "z")], "paper long, line long, key string")
    bib = spark.createDataFrame([(1, "b")], "paper long, key string")
    assert rows(resolve.dangling(cites, bib)) == [(1, "a", 2)]


def test_url_and_ids(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    assert one(S.normalize_url(F.lit("HTTPS://Ex.org:443/a/?utm_source=x&id=2&b=#top"))) == "https://ex.org/a?id=2&b="
    assert one(S.normalize_url(F.lit("http://ex.org/"))) == "http://ex.org/"
    assert one(S.valid_id("isbn", F.lit("0-123-45678-X"))) is False
    assert one(S.valid_id("doi", F.lit("https://doi.org/10.1234/x"))) is True
    assert one(S.acquisition_exhausted(F.array(F.lit("http 404"), F.lit("paywalled")), ["404", "paywall"])) is True
    assert one(S.acquisition_exhausted(F.array().cast("array<string>"), ["404"])) is False
    assert one(S.normalize_venue(F.lit("Proceedings of the {ACL}, 2020"))) == "acl"
    assert one(S.normalize_title(F.lit("A~{B} \\emph{Über} l’été – Straße"))) == "a b uber lete - strasse"
    assert one(S.particle_surname(F.lit("Bas van Fraassen"))) == "van Fraassen" and one(S.last_token_surname(F.lit("Smith, J"))) == "Smith"
    assert one(S.coerce_year(F.lit("2020-01"))) == 2020 and one(S.coerce_year(F.lit("20a0"))) is None
    assert one(S.issue_rule(F.lit("Title MISMATCH: not found"))) == ("error", "reference-exists")
    assert one(S.year_in_text(F.lit("in 12020 and 2020."), F.lit(2020))) and not one(S.year_in_text(F.lit("12020"), F.lit(2020)))


def test_ratios():
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd", k=rng.randrange(9))) for _ in range(2))
        want = 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert matching.indel_ratio(a, b) == pytest.approx(want)
    assert matching.partial_ratio("nips", "xx nips yy") == 1.0


def test_best_candidate(spark):
    c = spark.createDataFrame([("k", 0, 0.9, None, 2000, 2000, None), ("k", 1, 0.9, None, 2000, 2000, None), ("k", 2, 1.0, None, 2000, 2013, None), ("z", 0, 0.5, None, None, None, None)],
                              "key string, ord int, title_sim double, author_sim double, year int, cand_year int, venue_sim double")
    assert rows(matching.best_candidate(c), "key", "ord") == [("k", 0)]


def test_reference_scores(spark):
    c = spark.createDataFrame([
        (1, "a", "SKIPPED", "tool", False), (1, "b", "SUPPORTS", "tool", True), (1, "c", "SUPPORTS", "tool", False), (1, "c", "NOT_SUPPORTED", "method", False), (1, "c", "odd", "method", False), (1, "c", "SUPPORTS", "tool", False), (1, "", "SUPPORTS", "tool", False)],
        "paper long, key string, verdict string, purpose string, dismissed boolean")
    got = {r["key"]: r for r in scoring.reference_scores(c).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"]["verdict"], got["a"]["weight"]) == ("SKIPPED", 0.0)
    assert (got["b"]["verdict"], got["b"]["verification"]) == ("SUPPORTS", 0.25)
    assert (got["c"]["purpose"], got["c"]["verdict"], got["c"]["verification"]) == ("method", "NOT_SUPPORTED", pytest.approx(2.25 / 4))


def test_votes_and_best_unit(spark):
    s = spark.createDataFrame([(1, 0, 0, "A  b"), (1, 0, 1, "a b"), (1, 1, 0, "a b"), (1, 2, 0, "a B"), (1, 0, 2, "c"), (1, 1, 1, "c"), (1, 2, 1, "d")], "item long, sample int, ord int, text string")
    assert rows(scoring.votes(s, 3), "span", "votes", "level", "text") == [("a b", 3, "warning", "A  b"), ("c", 2, "info", "c")]
    u = spark.createDataFrame([(1, 0, "x", "NOT_SUPPORTED", 0.0), (2, 0, "x", "NOT_SUPPORTED", 0.0), (2, 1, "y", "SUPPORTS", 0.1)], "claim long, ord int, unit string, verdict string, confidence double")
    assert rows(scoring.best_unit(u), "claim", "verdict", "unit") == [(1, "NOT_SUPPORTED", ""), (2, "SUPPORTS", "y")]


def test_components_of_a_path_and_none(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40, 70)] + [(3, 3), (None, 1)], "src long, dst long")
    assert rows(components.connected_components(path)) == [(3, 3)] + [(i, 40) for i in range(40, 71)]
    assert components.connected_components(path.limit(0)).count() == 0


def test_unification(spark):
    c = spark.createDataFrame([(1, "a", "s1", 1), (1, "b", "s1", 1), (1, "b", "s2", 1), (1, "c", "s2", 1), (1, "d", "", None), (2, "x", "", 1)], "paper long, key string, section string, line long")
    got = {r["paper"]: r for r in graph.unification(c).collect()}
    assert (got[1]["clusters"], got[1]["bridges"], got[1]["score"]) == (2, 1, pytest.approx(0.55))
    assert got[2]["score"] == 0.0


def test_readers(spark, tmp_path):
    (tmp_path / "rw.csv").write_text('OriginalPaperDOI,RetractionNature,Reason,RetractionDate,Title\n10.1/A,Retraction,x,2020-01-01,T\nunavailable,Retraction,x,2020-01-01,T\n10.1/B,,x,2020-01-01,T\n')
    assert rows(readers.retraction_register(spark, str(tmp_path / "rw.csv")), "doi", "nature") == [("10.1/a", "Retraction")]
    assert rows(readers.bibitems(docs(spark, "\\bibitem{a} One.\n\\bibitem[X]{b} Two.\\end{thebibliography}"))) == [(0, "a", "One."), (0, "b", "Two.")]
    bib = "@article{k1,\n  title = {A {B}},\n  year = {2020},\n  journal = {J}\n}\n@misc{k2,\n  title = {C},\n  howpublished = {Web}\n}\n"
    assert rows(readers.bibtex(docs(spark, bib)), "key", "entry_type", "year", "venue") == [("k1", "article", "2020", "J"), ("k2", "misc", None, "Web")]
    r = spark.createDataFrame([('{"title":"T","doi":"https://doi.org/10.1/x","publication_year":2020,"authorships":[{"author":{"display_name":"A"}},{"author":{"display_name":""}}]}',), ("broken",)], "body string")
    assert [tuple(x) for x in readers.openalex_records(r).collect()] == [("T", "10.1/x", 2020, ["A"], False), (None, None, None, None, False)]


def test_stream_smoothing(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, t, 1.0), (1, t + dt.timedelta(1), 2.0), (2, t, 5.0)], "user_id long, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = timestate.smoothed_stream(stream, "user_id", "value").writeStream.outputMode("update").format("memory").queryName("smooth").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("smooth"), "user_id", "n", F.round("smoothed", 6)) == [(1, 2, 1.3), (2, 1, 5.0)]


def test_latex(spark):
    def one(text, f):
        return docs(spark, text).select(f(F.col("text"))).first()[0]

    assert one("a 5\\% % gone\nb", latex.strip_comments) == "a 5\\% \nb"
    assert one("a\n\\begin{verbatim}\n\\cite{x}\n\\end{verbatim}\nb", latex.strip_verbatim) == "a\n\n\n\nb"
    assert one("x \\begin{table}..\n\\end{table} y", latex.prose) == "x  y"
    assert one("\\emph{One}~\\cite{a, b} two\\footnote{no} \\section{Three}\\\\ four", lambda c: latex.clean_latex(c, "b")) == "One [TARGET_CITE] two Three four"
    assert one("See https://x.org \\textbf{two words}", latex.word_count) == 3


def test_authors(spark):
    assert matching.author_overlap(["J. R. Smith"], ["Smith, John"]) == 1.0
    assert matching.author_overlap([], ["A B"]) == 0.0
    assert matching.author_overlap(["Ann Lee"], ["Ann Lee", "Bo Chan"]) > matching.author_overlap(["Ann Lee", "Bo Chan"], ["Ann Lee"])
    d = spark.createDataFrame([(["Ann Lee"], ["Lee Ann"]), (None, ["x"])], "a array<string>, b array<string>")
    assert [r[0] for r in d.select(matching.author_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]
