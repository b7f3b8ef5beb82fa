"""Bibliography files, catalogue responses and parsed papers with edges."""

from pyspark.sql import functions as F

from marginalia.sources import bibtex, captures, catalogues, tei

BIB = r'''junk } before @comment{ @article{no, title={x}} }
@STRING{ acm = "ACM " # press }   @string{press = {Press}}
@string{both = acm # { and more}}
@book{ key1 ,
  Title = {A {B{C}} "d", e # f},
  title2 = "quoted {with, "inner"} comma, here",
  publisher = both # 12 # unknown # "x",
  month = jan, year = 1999,
  title = "last one {W}ins"
}
@misc{key2}
@misc{, title = {no key}}
@preamble{"\newcommand{x}"}
@online{key3, howpublished = "See \url{http://dx.doi.org/10.5555/abc.}", author = {A. One and B. Two & {C Three}}, annote = {arXiv:2101.00002}, isbn = {}, note = {open'''


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_bibtex_fields(spark):
    rows = {r["key"]: r for r in bibtex.bib_fields(spark.createDataFrame([("f", BIB), ("g", "@misc{k, a = acm}"), ("h", None), ("i", "")], "paper string, text string")).collect()}
    assert set(rows) == {"key1", "key2", "key3", "k"}
    f = rows["key1"]["fields"]
    assert rows["key1"]["entry_type"] == "book" and f["title2"] == 'quoted {with, "inner"} comma, here'
    assert f["title"] == "last one {W}ins" and f["publisher"] == "ACM press and more12unknownx" and f["month"] == "January" and f["year"] == "1999"
    assert rows["key2"]["fields"] in ({}, None) and rows["k"]["fields"] == {"a": "acm"}  # another file's names aren't known


def test_bibtex_records_and_reader(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.bib").write_text(BIB + "}}")
    (tmp_path / "deep" / "b.bib").write_text("@article{x, title = {T}, journal = {}, booktitle = {B}}")
    (tmp_path / "c.txt").write_text("@article{no, title = {T}}")
    rows = {r["key"]: r for r in bibtex.bib_records(bibtex.bib_files(spark, str(tmp_path))).collect()}
    assert set(rows) == {"key1", "key2", "key3", "x"}
    three = rows["key3"]
    assert three["doi"] == "10.5555/abc" and three["url"] == "http://dx.doi.org/10.5555/abc." and three["authors"] == ["A. One", "B. Two", "C Three"] and three["arxiv_id"] == "2101.00002" and three["isbn"] is None
    assert rows["x"]["venue"] == "B" and rows["x"]["raw_text"] == "T. B" and rows["key2"]["title"] is None and rows["key1"]["title"] == "last one Wins"
    assert bibtex.bib_records(spark.createDataFrame([], "paper string, text string")).count() == 0


def test_oddly_shaped_bodies(spark):
    bodies = ['{"title": ["T"], "author": "x", "issued": {"date-parts": [[null]]}, "update-to": [{"label": "RETRACTION"}]}', '{"title": "plain"}', "{}", "null", "3", "", None, '{"author": [{"family": "F", "given": null}, 5, null]}']
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    rows = {r["id"]: r for r in catalogues.catalogue_records(df, "crossref").collect()}
    assert rows[0]["title"] == "T" and rows[0]["authors"] == [] and rows[0]["year"] is None and rows[0]["retracted"] is True
    assert rows[1]["title"] == "" and rows[2]["citations"] == 0 and rows[7]["authors"] == ["F"]
    assert all(rows[i]["title"] is None and rows[i]["authors"] is None for i in (3, 4, 5, 6))
    for source in catalogues.SHAPES:
        out = catalogues.catalogue_records(df, source)
        assert out.count() == len(bodies) and out.columns == ["id", "source", *catalogues.RECORD]
    assert got(catalogues.book_year(spark.createDataFrame([(1, '{"publish_date": "c1999, 2001"}'), (2, "x")], "id int, body string")), "id", "year") == [(1, 2001), (2, None)]


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>
<div><head>One</head><p>P <ref type="bibr" target="#b0">(1)</ref><ref type="bibr" target="#bx">?</ref></p>
 <div><p>deep <ref type="bibr" target="#b0">x</ref></p><div><head>Low</head><p/></div></div><p>after</p></div>
<div><p> </p></div></body><back><listBibl><biblStruct/><biblStruct><monogr><title level="m">Only a series</title></monogr></biblStruct></listBibl></back></text></TEI>"""


def test_tei_nesting(spark):
    d = spark.createDataFrame([(1, TEI), (2, "<broken"), (3, None), (4, "")], "paper int, tei string")
    assert got(tei.body_sections(d), "paper", "ord", "level", "title", "text") == [
        (1, 0, 0, "One", "P (1)?\n\nafter"), (1, 1, 1, "Section 1", "deep x"), (1, 2, 2, "Low", ""), (1, 3, 0, "Section 4", "")]
    keys = spark.createDataFrame([(1, 0, "k")], "paper int, ord int, key string")
    assert got(tei.inline_citations(d, keys), "key", "section", "context") == [("k", "", "deep  x"), ("k", "One", "P  (1) ?"), ("k", "One", "deep  x")]
    refs = got(tei.references(d), "paper", "ord", "title", "venue")
    assert refs == [(1, 0, None, None), (1, 1, None, "Only a series")]
    assert [r["title"] for r in tei.paper_headers(d).orderBy("paper").collect()][:2] == ["", ""]
    assert tei.body_sections(d.limit(0)).count() == 0 and tei.figure_labels(d).count() == 0


def test_captured_pages(spark):
    qp = "MIME-Version: 1.0\nSnapshot-Content-Location: http://a.org/\nContent-Type: multipart/related; boundary=B\n\n--B\nContent-Type: text/html\nContent-Transfer-Encoding: quoted-printable\n\n<p>50%+ caf=C3=A9 =3D=\n ok</p>\n--B--\n"
    single = "Content-Type: text/html\n\n<b>x</b>"
    d = spark.createDataFrame([("q", qp), ("s", single), ("n", "Content-Type: text/plain\n\nx"), ("e", ""), ("z", None)], "path string, text string")
    assert got(captures.mhtml_pages(d), "path", "url", "html") == [("q", "http://a.org/", "<p>50%+ café = ok</p>"), ("s", None, "<b>x</b>")]
    pages = spark.createDataFrame([(1, "<body><nav>no</nav><article><h1>T</h1><p>One  two<br>three</p><script>x<y</script></article><p>out</p></body>"), (2, "plain &amp;lt; <b>bold</b>"), (3, None), (4, "<MAIN class=x>a\n b</MAIN>")], "id int, html string")
    assert {r["id"]: r["t"] for r in pages.select("id", captures.article_text(F.col("html")).alias("t")).collect()} == {1: "T\nOne two\nthree", 2: "plain &lt; bold", 3: None, 4: "a b"}


def test_divisions_are_found_where_the_text_is(spark):
    d = spark.range(2).select(F.col("id").alias("paper"), F.lit(TEI).alias("tei"))
    assert "Exchange" not in tei.body_sections(d)._jdf.queryExecution().executedPlan().toString()


def test_unmatched_ends_of_divisions(spark):
    """An end without a begin shifts the depth of what follows; a division that is never closed holds the rest."""
    body = "</div><div><p>lost</p><div><p>a</p><div><head>In</head><p>b</p></div></div></div><div><p>c</p>"
    d = spark.createDataFrame([(1, f"<body>{body}</body>")], "paper int, tei string")
    assert got(tei.body_sections(d), "ord", "level", "title", "text") == [(0, 0, "Section 1", "a"), (1, 1, "In", "b")]
