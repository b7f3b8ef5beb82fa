"""Queries on bibliography files, catalogue responses and parsed papers: rendered from the tables, read back, compared with the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.plans.catalogue import query, table
from marginalia.plans.texts import text_of
from marginalia.scratch import Scratch
from marginalia.sources import bibtex, catalogues, tei


@query(r"""SELECT p_partkey // 50 AS paper, 'k' || p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN 'article' ELSE 'inproceedings' END AS entry_type, 'On DNA and ' || p_name || ', a "study"' AS title, 'Lee, Ann|Bo Chan' AS authors,
    '2001' AS year, CASE WHEN p_size % 2 = 0 THEN 'Journal of Things, vol. ' || p_size ELSE 'Proc. May ' || p_brand END AS venue,
    CASE p_partkey % 4 WHEN 0 THEN '10.1000/a' || p_partkey WHEN 1 THEN '10.1000/b' || p_partkey WHEN 2 THEN '10.1000/c' || p_partkey END AS doi,
    CASE WHEN p_partkey % 4 = 1 THEN 'https://doi.org/10.1000/b' || p_partkey END AS url, CASE WHEN p_partkey % 4 = 3 THEN '2101.0' || (1000 + p_partkey % 9000) END AS arxiv_id, CASE WHEN p_partkey % 4 = 3 THEN '12345678' END AS pmid,
    'Lee, Ann and {Bo} Chan. On DNA and ' || p_name || ', a "study". ' || CASE WHEN p_size % 2 = 0 THEN 'Journal of Things, vol. ' || p_size ELSE 'Proc. May ' || p_brand END AS raw_text FROM part""")
def bibtex_records(spark, d):
    """Nested braces, quotes in braces, joined values, names, comments, addresses in ``howpublished`` and identifiers in notes."""
    n, k = F.col("p_size"), F.col("p_partkey")
    venue = F.when(n % 2 == 0, text_of("journal = PUB # {, vol. } # ", n)).otherwise(text_of('booktitle = "Proc. " # may # { ', F.col("p_brand"), "}"))
    extra = (F.when(k % 4 == 0, text_of(",\n doi = {10.1000/a", k, "}")).when(k % 4 == 1, text_of(",\n howpublished = {\\url{https://doi.org/10.1000/b", k, "}}"))
             .when(k % 4 == 2, text_of(",\n Note = \"see doi:10.1000/c", k, ".\"")).otherwise(text_of(",\n eprint = {2101.0", 1000 + k % 9000, "v2}, note = {PMID: 12345678}")))
    entry = text_of(F.when(n % 2 == 0, "@Article").otherwise("@INPROCEEDINGS"), "{k", k, ",\n  title = {On {DNA} and {", F.col("p_name"), "}, a \"study\"},\n  author = \"Lee, Ann and {Bo} Chan\",\n ", venue, ",\n  year = 2001", extra, ",\n}\n text between, and = signs\n")
    head = '@comment{ignored, @article{x, title = {no}}}\n@string{thing = {Things}}\n@String{pub = "Journal of " # thing}\n'
    files = table(spark, d, "part").groupBy(F.expr("p_partkey div 50").alias("paper")).agg(text_of(head, F.array_join(F.array_sort(F.collect_list(entry)), "")).alias("text"))
    return bibtex.bib_records(files).select("paper", "key", "entry_type", "title", F.array_join("authors", "|").alias("authors"), "year", "venue", "doi", "url", "arxiv_id", "pmid", "raw_text")


# ---- catalogue responses -----------------------------------------------------------------------------------------


def _bodies(spark, d, body):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), body.alias("body"))


def _some_bad(body):
    """Every eleventh body isn't JSON, another is no object, a third is missing."""
    k = F.col("p_partkey")
    return F.when(k % 11 == 0, "oops {").when(k % 11 == 1, "[1, 2]").when(k % 11 == 2, F.lit(None)).otherwise(F.to_json(body, {"ignoreNullFields": "false"}))


def _shape(source):
    def run(spark, d, body):
        rows = catalogues.catalogue_records(_bodies(spark, d, _some_bad(body)), source)
        return rows.withColumns({"authors": F.array_join("authors", "|"), "retracted": F.col("retracted").cast("int")}).na.fill(-1, ["year", "citations", "retracted"])

    return run


_GOOD = "p_partkey % 11 > 2"


def _sql(source: str, **parts: str) -> str:
    """A record of each part, null but for the source where the body is bad; numbers are -1 then."""
    known = {"title": "''", "authors": "''", "year": "NULL", "doi": "''", "venue": "''", "citations": "0", "arxiv_id": "NULL", "pmcid": "NULL", "isbn": "NULL", "url": "NULL", "pdf_url": "NULL", "abstract": "NULL", "retracted": "false"} | parts
    known["retracted"] = f"({known['retracted']})::INT"
    return f"SELECT p_partkey AS id, '{source}' AS source, " + ", ".join(f"coalesce(CASE WHEN {_GOOD} THEN {v} END, -1)::{'BIGINT' if k == 'citations' else 'INT'} AS {k}" if k in ("year", "citations", "retracted") else f"CASE WHEN {_GOOD} THEN {v} END AS {k}" for k, v in known.items()) + " FROM part"


@query(_sql("openalex", title="CASE WHEN p_size % 5 > 0 THEN p_name ELSE '' END", authors="'Ann ' || p_brand", year="CASE WHEN p_size % 7 > 0 THEN 1990 + p_size END", doi="'10.1/' || p_partkey", venue="CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END", citations="p_size",
            arxiv_id="CASE WHEN p_size % 2 = 0 THEN '2101.' || (10000 + p_partkey) END", pmcid="CASE WHEN p_size % 4 = 0 THEN 'PMC' || p_partkey END", pdf_url="'http://x/' || p_partkey", abstract="CASE WHEN p_size % 3 > 0 THEN 'to be or not to be' END", retracted="p_size % 9 = 0"))
def openalex_works(spark, d):
    n, k = F.col("p_size"), F.col("p_partkey")
    name = lambda c: F.struct(F.struct(c.alias("display_name")).alias("author"))
    body = F.struct(
        F.when(n % 5 > 0, F.col("p_name")).alias("title"), F.array(name(F.concat(F.lit("Ann "), "p_brand")), name(F.lit(None).cast("string")), name(F.lit(""))).alias("authorships"), F.when(n % 7 > 0, (1990 + n).cast("string")).otherwise("n.d.").alias("publication_year"),
        text_of("https://doi.org/10.1/", k).alias("doi"), F.when(n % 3 == 0, F.struct(F.struct(F.col("p_type").alias("display_name")).alias("source"))).alias("primary_location"), n.alias("cited_by_count"),
        F.array(F.struct(F.lit(None).cast("string").alias("landing_page_url")), F.struct(F.when(n % 2 == 0, text_of("https://arxiv.org/abs/2101.", 10000 + k)).otherwise("https://else").alias("landing_page_url"))).alias("locations"),
        F.struct(F.when(n % 4 == 0, text_of("https://www.ncbi.nlm.nih.gov/pmc/articles/PMC", k)).alias("pmcid")).alias("ids"), F.struct(text_of("http://x/", k).alias("oa_url")).alias("open_access"),
        F.when(n % 3 > 0, F.from_json(F.lit('{"to": [0, 4], "be": [1, 5], "or": [2], "not": [3]}'), "map<string,array<int>>")).alias("abstract_inverted_index"), (n % 9 == 0).alias("is_retracted"))
    return _shape("openalex")(spark, d, body)


@query(_sql("semantic_scholar", title="p_name", authors="CASE WHEN p_size % 3 > 0 THEN 'Ann Lee|' ELSE '' END", year="1990 + p_size", doi="CASE WHEN p_size % 2 = 0 THEN '10.1/' || p_partkey ELSE '' END", venue="p_type", citations="p_size", arxiv_id="CASE WHEN p_size % 2 = 0 THEN 'a' || p_partkey END", pmcid="CASE WHEN p_size % 2 = 0 THEN '77' END",
            url="'u' || p_partkey", pdf_url="CASE WHEN p_size % 5 = 0 THEN 'p' || p_partkey END", abstract="'About ' || p_name"))
def semantic_scholar_papers(spark, d):
    n, k = F.col("p_size"), F.col("p_partkey")
    ids = F.struct(text_of("10.1/", k).alias("DOI"), text_of("a", k).alias("ArXiv"), F.lit(77).alias("PubMedCentral"))
    body = F.struct(F.col("p_name").alias("title"), F.when(n % 3 > 0, F.array(F.struct(F.lit("Ann Lee").alias("name")), F.struct(F.lit(None).cast("string").alias("name")))).alias("authors"), (1990 + n).alias("year"), F.when(n % 2 == 0, ids).alias("externalIds"), F.col("p_type").alias("venue"), n.alias("citationCount"),
                    text_of("u", k).alias("url"), F.when(n % 5 == 0, F.struct(text_of("p", k).alias("url"))).alias("openAccessPdf"), text_of("About ", F.col("p_name")).alias("abstract"))
    return _shape("semantic_scholar")(spark, d, body)


@query(_sql("crossref", title="CASE WHEN p_size % 4 > 0 THEN p_name ELSE '' END", authors="'Ann Lee|Chan'", year="CASE WHEN p_size % 3 = 0 THEN 1990 + p_size WHEN p_size % 3 = 1 THEN 1991 + p_size END", doi="'10.1/' || p_partkey", venue="p_type", citations="p_size", abstract="CASE WHEN p_size % 2 = 0 THEN 'Some text.' END", retracted="p_size % 5 = 0"))
def crossref_works(spark, d):
    n, k = F.col("p_size"), F.col("p_partkey")
    person = lambda given, family: F.struct(F.lit(given).alias("given"), F.lit(family).alias("family"))
    date = lambda c: F.struct(F.array(F.array(c, F.lit(2))).alias("date-parts"))
    body = F.struct(
        F.when(n % 4 > 0, F.array("p_name", F.lit("second"))).otherwise(F.array().cast("array<string>")).alias("title"), F.array(person("Ann", "Lee"), person("No family", ""), person("", "Chan")).alias("author"),
        F.when(n % 3 == 0, date(1990 + n)).alias("published-print"), F.when(n % 3 < 2, date(1991 + n)).alias("published-online"), F.struct(F.array(F.array().cast("array<int>")).alias("date-parts")).alias("issued"),
        text_of("10.1/", k).alias("DOI"), F.array("p_type").alias("container-title"), n.alias("is-referenced-by-count"), F.when(n % 2 == 0, "<jats:p>Some <b>text</b>.</jats:p> ").otherwise("<p></p>").alias("abstract"),
        F.array(F.struct(F.lit("erratum").alias("type"), F.when(n % 5 == 0, "Retraction of").otherwise("Note").alias("label"))).alias("update-to"))
    return _shape("crossref")(spark, d, body)


@query(_sql("openlibrary", title="p_name || CASE WHEN p_size % 2 = 0 THEN ': a story' ELSE '' END", authors="'Ann|Bo'", year="1990 + p_size", venue="CASE WHEN p_size % 3 > 0 THEN p_brand ELSE '' END", isbn="CASE WHEN p_size % 5 > 0 THEN '978' || p_partkey END"))
def openlibrary_books(spark, d):
    n = F.col("p_size")
    body = F.struct(F.col("p_name").alias("title"), F.when(n % 2 == 0, "a story").otherwise("").alias("subtitle"), F.array(F.lit("Ann"), F.lit("Bo")).alias("author_name"), (1990 + n).alias("first_publish_year"),
                    F.when(n % 3 > 0, F.array("p_brand", F.lit("x"))).alias("publisher"), F.when(n % 5 > 0, F.array(text_of("978", F.col("p_partkey")))).otherwise(F.array().cast("array<string>")).alias("isbn"))
    return _shape("openlibrary")(spark, d, body)


@query(_sql("loc", title="p_name", authors="CASE WHEN p_size % 2 = 0 THEN 'lee, ann' ELSE '' END", year="CASE WHEN p_size % 3 > 0 THEN 1900 + p_size END"))
def library_of_congress_items(spark, d):
    n = F.col("p_size")
    date = F.when(n % 3 == 0, "undated").when(n % 3 == 1, (1900 + n).cast("string")).otherwise(F.concat(1900 + n, F.lit("-01-02")))
    body = F.struct(F.col("p_name").alias("title"), F.when(n % 2 == 0, F.array(F.lit("lee, ann"))).alias("contributor"), date.alias("date"))
    return _shape("loc")(spark, d, body)


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 1900 + p_size ELSE -1 END AS year FROM part")
def book_years(spark, d):
    n = F.col("p_size")
    return catalogues.book_year(_bodies(spark, d, F.to_json(F.struct(F.when(n % 2 == 0, F.concat(F.lit("May "), 1900 + n, F.lit(", 2d ed."))).otherwise("about 12345").alias("publish_date"))))).select("id", "year").na.fill(-1)


# ---- parsed papers -----------------------------------------------------------------------------------------------

_ITEMS = "l AS (SELECT l_orderkey AS paper, l_partkey AS p, l_suppkey AS s, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)"


def parsed_papers(spark, d):
    """TEI of an order's line items: every second has a division inside it, whose second sentence is in no paragraph; every fifth has no heading. Each cites a reference of the list, and one that isn't listed."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("int").alias("q"), n.alias("n"))
    ref = lambda at: text_of('<ref type="bibr" target="#b', at, '">[', at, "]</ref>")
    inner = text_of("<div><head>Inner ", F.col("n"), "</head><p>", F.repeat(F.lit("w "), F.col("q")), "</p>", ref(F.col("n") - 1), " tail ", F.col("n"), "<p></p></div>")
    div = text_of('<div xmlns="x">', F.when(F.col("q") % 5 > 0, text_of('<head n="1">A &amp; ', F.col("n"), "</head>")).otherwise(""), "\n<p>One ", ref(F.col("n") - 1), " and <hi>two</hi> ", ref(F.lit(999)), ' <ref type="figure" target="#b0">1</ref></p>', F.when(F.col("n") % 2 == 0, inner).otherwise(""), "<p>Last &lt;", F.col("n"), "&gt;.</p></div>\n")
    idno = F.when(F.col("q") % 3 == 0, text_of('<idno type="DOI">10.1/', F.col("p"), "</idno>")).otherwise('<idno type="arXiv">2101.00001</idno>')
    book = F.when(F.col("q") % 2 == 0, text_of("<analytic><title level=\"a\" type=\"main\"> Part ", F.col("p"), " </title><author><persName><forename type=\"first\">Ann</forename><forename type=\"middle\">B</forename><surname>Lee</surname></persName></author>", idno, "</analytic><monogr><title level=\"j\">Journal &amp; Co</title><imprint><date type=\"published\" when=\"2001-05\" /></imprint></monogr>"))
    book = book.otherwise(text_of("<monogr><title level=\"m\">Series</title><title>Book ", F.col("p"), "</title><author><persName><surname>Chan</surname></persName></author><imprint><date when=\"1999\" /></imprint></monogr><ptr type=\"url\" target=\"http://x/", F.col("p"), "\" />"))
    bibl = text_of('<biblStruct xml:id="b', F.col("n") - 1, '">', book, '<note type="raw_reference">raw ', F.col("p"), "</note></biblStruct>")
    joined = lambda c: F.array_join(F.sort_array(F.collect_list(F.struct("n", c.alias("t"))))["t"], "")
    figures = F.array_join(F.collect_list(text_of(F.when(F.col("q") % 4 == 0, '<figure type="table">').otherwise("<figure>"), F.when(F.col("q") % 3 > 0, text_of("<label> ", F.col("n"), " </label>")).otherwise(""), "<figDesc>x</figDesc></figure>")), "")
    return li.groupBy("paper").agg(text_of('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title level="a" type="main">Paper ', F.col("paper"), ' &amp; more</title></titleStmt><sourceDesc><author><persName><forename>Ann</forename><surname>Lee</surname></persName></author><author><email>x</email></author></sourceDesc></fileDesc>'
                                           "<profileDesc><abstract><div><p>In short, ", F.count("*"), " items.</p></div></abstract></profileDesc></teiHeader><text><body>", joined(div), figures, "</body><back><div><listBibl>", joined(bibl), "</listBibl></div></back></text></TEI>").alias("tei"))


@query("SELECT l_orderkey AS paper, 'Paper ' || l_orderkey || ' & more' AS title, 'In short, ' || count(*) || ' items.' AS abstract, 'Ann Lee' AS authors FROM lineitem GROUP BY 1")
def tei_headers(spark, d):
    return tei.paper_headers(parsed_papers(spark, d)).withColumn("authors", F.array_join("authors", "|"))


@query(f"""WITH {_ITEMS},
  r AS (SELECT *, n + coalesce(sum(CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY paper ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM l)
  SELECT paper, (o - 1)::INT AS ord, 0 AS level, CASE WHEN q % 5 > 0 THEN 'A & ' || n ELSE 'Section ' || o END AS title, 'One [' || (n - 1) || '] and two [999] 1' || chr(10) || chr(10) || 'Last <' || n || '>.' AS text FROM r
  UNION ALL SELECT paper, o::INT, 1, 'Inner ' || n, trim(repeat('w ', q)) FROM r WHERE n % 2 = 0""")
def tei_sections(spark, d):
    return tei.body_sections(parsed_papers(spark, d))


@query(f"""WITH {_ITEMS}
  SELECT paper, (n - 1)::INT AS ord, CASE WHEN q % 2 = 0 THEN 'Part ' ELSE 'Book ' END || p AS title, CASE WHEN q % 2 = 0 THEN 'Journal & Co' ELSE 'Series' END AS venue, CASE WHEN q % 2 = 0 THEN 'Ann B Lee' ELSE 'Chan' END AS authors, CASE WHEN q % 2 = 0 THEN '2001' ELSE '1999' END AS year,
    CASE WHEN q % 6 = 0 THEN '10.1/' || p END AS doi, CASE WHEN q % 2 = 0 AND q % 3 > 0 THEN '2101.00001' END AS arxiv_id, CASE WHEN q % 2 = 1 THEN 'http://x/' || p END AS url, 'raw ' || p AS raw FROM l""")
def tei_references(spark, d):
    return tei.references(parsed_papers(spark, d)).withColumn("authors", F.array_join("authors", "|")).drop("pmid", "isbn", "lccn")


@query(f"""WITH {_ITEMS}
  SELECT paper, 'ref' || (n - 1) AS key, CASE WHEN q % 5 > 0 THEN 'A & ' || n ELSE '' END AS section, 'One  [' || (n - 1) || ']  and  two   [999]   1' AS context FROM l
  UNION ALL SELECT paper, 'ref' || (n - 1), unnest(['Inner ' || n, CASE WHEN q % 5 > 0 THEN 'A & ' || n ELSE '' END]), 'tail ' || n FROM l WHERE n % 2 = 0""")
def tei_citations(spark, d):
    papers = Scratch(spark, "tei_citations").put(parsed_papers(spark, d), "papers")  # read twice
    return tei.inline_citations(papers, tei.references(papers).select("paper", "ord", text_of("ref", F.col("ord")).alias("key")))


@query(f"""WITH {_ITEMS} SELECT paper, n::VARCHAR AS label FROM l WHERE q % 4 > 0 AND q % 3 > 0""")
def tei_figures(spark, d):
    return tei.figure_labels(parsed_papers(spark, d))
