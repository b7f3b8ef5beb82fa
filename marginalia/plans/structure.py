"""Registered queries of sections, passages and identifiers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import structure
from marginalia.plans.catalogue import query, table
from marginalia.plans.records import pick

ORDERED = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem"


def sectioned(spark, d):
    """A paper for each order, three lines for each item: heading, label, words."""
    li = table(spark, d, "lineitem")
    item = F.concat(
        F.lit("\\"), pick(["section", "subsection", "subsubsection"], F.col("l_linenumber") % 3), F.lit("{T"), "l_partkey", F.lit("}\n"),
        F.when(F.col("l_quantity") > 25, F.concat(F.lit("\\label{sec:"), "l_suppkey", F.lit("}"))).otherwise("plain"),
        F.when(F.col("l_tax") > 0.04, F.concat(F.lit("\nalpha beta \\cite{p"), "l_partkey", F.lit(", s"), "l_suppkey", F.lit("}"))).otherwise("\nalpha beta gamma % delta"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", item.alias("t")))), lambda x: x["t"]), "\n")
    return li.groupBy(F.col("l_orderkey").alias("paper")).agg(F.concat(F.lit("\\begin{document}"), body, F.lit("\nend\\end{document}")).alias("text"))


@query(f"""SELECT l_orderkey AS paper, (rn - 1)::INT AS ord, (l_linenumber % 3)::INT AS depth, 'T' || l_partkey AS title, CASE WHEN l_quantity > 25 THEN 'sec:' || l_suppkey ELSE '' END AS label,
  (3 * rn - 2)::INT AS start_line, (3 * rn + (rn = n)::INT)::INT AS end_line, (CASE WHEN l_tax > 0.04 THEN 5 ELSE 4 END + (rn = n)::INT)::INT AS words, (CASE WHEN l_tax > 0.04 THEN 2 ELSE 0 END)::INT AS cites FROM ({ORDERED})""")
def section_table(spark, d):
    return structure.section_table(sectioned(spark, d)).drop("text")


@query(f"""WITH s AS (SELECT *, unnest([r, CASE WHEN l_partkey % 6 = 5 THEN 'results' END]) AS role FROM (SELECT *, ['introduction', 'methods', 'results', 'conclusion', NULL, 'methods'][(l_partkey % 6 + 1)::INT] AS r, ['1 Introduction', 'Our Methods', 'Results', 'Discussion', 'Other', 'Approach and Findings'][(l_partkey % 6 + 1)::INT] AS title FROM ({ORDERED}))),
  big AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(length('x' || l_partkey)) + max(CASE WHEN l_orderkey % 3 = 0 THEN 3 ELSE 0 END) > 24),
  side AS (SELECT l_orderkey AS paper, role, string_agg('x' || l_partkey, chr(10) || chr(10) ORDER BY rn) AS t, arg_min(title, rn) AS label FROM s WHERE role IS NOT NULL AND l_orderkey NOT IN (FROM big) GROUP BY 1, 2
    UNION ALL SELECT o_orderkey, 'abstract', 'abs', 'Abstract' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey NOT IN (FROM big)),
  p(a, b, pair) AS (VALUES ('abstract', 'results', 'Abstract vs Results'), ('abstract', 'conclusion', 'Abstract vs Conclusion'), ('introduction', 'conclusion', 'Introduction vs Conclusion'), ('methods', 'results', 'Methods vs Results'))
  SELECT x.paper, p.pair, x.label AS a_label, x.t AS a_text, y.label AS b_label, y.t AS b_text FROM p JOIN side x ON x.role = p.a JOIN side y ON y.role = p.b AND y.paper = x.paper""")
def section_pairs(spark, d):
    li = table(spark, d, "lineitem").selectExpr("*", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord")
    sections = li.select(F.col("l_orderkey").alias("paper"), "ord", pick(["1 Introduction", "Our Methods", "Results", "Discussion", "Other", "Approach and Findings"], F.col("l_partkey") % 6).alias("title"), F.concat(F.lit("x"), "l_partkey").alias("text"))
    abstracts = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper"), F.when(F.col("o_orderkey") % 3 == 0, "abs").otherwise("").alias("text"))
    return structure.section_pairs(sections, abstracts, most_chars=24)


@query("""SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN '10.1000/own' WHEN p_size % 3 = 0 THEN '10.1234/n' || p_partkey WHEN p_size % 5 = 0 THEN '10.1234/t' || p_partkey END AS doi,
  CASE WHEN p_size % 3 = 0 THEN '2001.' || lpad((p_partkey % 10000)::VARCHAR, 5, '0') END AS arxiv_id, CASE WHEN p_size % 7 = 0 THEN (1000000 + p_partkey)::VARCHAR END AS pmid,
  CASE WHEN p_size % 7 = 1 THEN 'PMC' || (1000000 + p_partkey) END AS pmc_id FROM part""")
def swept_identifiers(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    note = F.when(n % 3 == 0, F.concat(F.lit("see 10.1234/n"), k, F.lit("., ARXIV: 2001."), F.lpad((k % 10000).cast("string"), 5, "0"))).otherwise("none")
    extra = F.when(n % 7 == 0, F.concat(F.lit("PMID: "), k + 1000000)).when(n % 7 == 1, F.concat(F.lit("PMC"), k + 1000000, F.lit(".")))
    fields = F.array(field("ID", F.lit("10.9999/id")), field("URL", F.lit("https://doi.org/10.9999/u")), field("note", note), field("title", F.when(n % 5 == 0, F.concat(F.lit("10.1234/t"), k, F.lit("."))).otherwise("a")), field("extra", extra))
    none = {c: F.lit(None).cast("string") for c in ("arxiv_id", "pmid", "pmc_id", "isbn", "lccn")}
    entries = table(spark, d, "part").select(k.alias("key"), fields.alias("fields"), F.when(k % 2 == 0, "10.1000/own").otherwise("").alias("doi")).withColumns(none)
    return structure.swept_identifiers(entries).select("key", "doi", "arxiv_id", "pmid", "pmc_id")


@query("""SELECT p_partkey AS key, 'Bo ' || p_size || ', C|Di E' AS authors, CASE WHEN p_size % 4 > 0 THEN (1960 + p_size)::VARCHAR END AS year, CASE WHEN p_partkey % 3 = 0 THEN '10.5555/a' || p_partkey END AS doi, 'On ' || p_name || ' , see' AS body FROM part""")
def bibliography_fields(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    authors = F.concat(F.lit("{Bo}~"), n, F.lit(", \\emph{C}  and Di E & X."))
    body = F.concat(F.lit("On \\emph{"), "p_name", F.lit("}\n~\\newblock "), F.when(k % 3 == 0, F.concat(F.lit("\\url{https://doi.org/10.5555/a"), k, F.lit(".}"))).otherwise(""), F.lit(", see"))
    year = F.when(n % 4 > 0, F.concat(F.lit("(17"), n + 1960, F.lit(", "), n + 1960, F.lit(")"))).otherwise("in 1860")
    return table(spark, d, "part").select(k.alias("key"), F.array_join(structure.bib_authors(authors), "|").alias("authors"), structure.bib_year(year).alias("year"), structure.bib_doi(body).alias("doi"), structure.bib_text(body).alias("body"))


@query("""SELECT p_partkey AS key, k AS kind, k || p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '0123456789' ELSE p_name END AS api_title FROM part, (VALUES ('pmid', 0), ('doi', 1)) v(k, own)
  WHERE NOT (own = 1 AND p_partkey % 2 = 0) AND p_partkey % 11 <> 0 AND p_size % 7 <> 0 AND (p_size % 3 = 0 OR (p_size % 5 = 0 AND p_partkey % 5 > 1))""")
def conflicting_identifiers(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    part = table(spark, d, "part")
    name = lambda kind: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(kind), k).alias("id"))
    refs = part.select(k.alias("key"), F.when(n % 7 == 0, "").otherwise(F.col("p_name")).alias("title"), F.array(F.lit("Ann Lee")).alias("authors"), F.lit("2010").alias("year"), F.when(k % 2 == 0, name("doi")).alias("found_by"), F.array(name("doi"), name("pmid")).alias("ids"))
    catalogue = part.where("p_partkey % 11 <> 0").select(
        F.explode(F.array(name("doi"), name("pmid"))).alias("i"), F.when(n % 3 == 0, "0123456789").otherwise(F.col("p_name")).alias("api_title"),
        F.when(n % 5 == 0, F.array(F.lit("Xu Zzyzx"))).otherwise(F.array(F.lit("Ann Lee"))).alias("api_authors"), F.when(k % 5 > 1, 2019).otherwise(2010).alias("api_year")).select("i.kind", F.upper("i.id").alias("id"), "api_title", "api_authors", "api_year")
    return structure.conflicting_ids(refs, catalogue)


@query("""SELECT DISTINCT concat_ws('-', l_orderkey, l_partkey, l_suppkey) AS response, CASE WHEN l_partkey % 3 = 0 THEN l_partkey ELSE l_suppkey END AS key FROM lineitem WHERE l_partkey % 3 = 0 OR l_suppkey % 2 = 0""")
def answered_requests(spark, d):
    requests = table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("key"), F.concat(F.lit("10.1/P"), "p_partkey").alias("doi"), F.lit(None).cast("string").alias("arxiv_id")).unionByName(
        table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("key"), F.lit("").alias("doi"), F.concat(F.lit("s"), "s_suppkey").alias("arxiv_id")))
    responses = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("response"), F.concat(F.lit("10.1/p"), "l_partkey").alias("doi"), F.concat(F.lit("S"), "l_suppkey").alias("arxiv_id"))
    return structure.matched_responses(requests, responses)


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^[a-z]+://www\.') THEN regexp_replace(url, '^([a-z]+://)www\.', '\1') ELSE regexp_replace(url, '^([a-z]+://)', '\1www.') END AS url FROM pages""")
def www_variants(spark, d):
    return table(spark, d, "pages").select("page_id", structure.www_variant(F.col("url")).alias("url"))
