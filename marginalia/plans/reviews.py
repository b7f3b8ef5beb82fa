"""Queries on Markdown manuscripts and on the catalogue of checks, against SQL over the tables they are rendered from."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import checks
from marginalia.plans.catalogue import query, table
from marginalia.plans.texts import joined, text_of
from marginalia.sources import markdown

# ---- Markdown ----------------------------------------------------------------------------------------------------


def markdown_papers(spark, d):
    """A paper for each order: a paragraph for each item, figures, code, and what looks like citations and is none."""
    li, n = table(spark, d, "lineitem"), F.col("l_linenumber")
    line = text_of("As [@p", F.col("l_partkey"), "; see @s", F.col("l_suppkey"), ", p. 4] show in @fig:", n + 1, "\n*well* (a@b.c, `@code`).\n",
                   F.when(F.col("l_quantity") > 25, text_of("\n![Cap\n@x", n, "](a.png){#fig:", n, " width=50%}\n")).otherwise(""), F.when(F.col("l_tax") > 0.05, text_of("\n```{#lst:", n, "}\n# no heading @no\n\n@no\n```\n")).otherwise("\n"))
    head = text_of("---\ntitle: x @no\nbibliography: [a", F.first("l_orderkey"), ".bib, \"b.bib\"]\n---\n\nIntro @intro\n## Start **now** {#sec:start}\n")
    return li.groupBy(F.col("l_orderkey").alias("paper")).agg(text_of(head, joined(li, line, "\n"), "\n# Two parts\n").alias("text"))


@query("""SELECT l_orderkey AS paper, unnest(['p' || l_partkey, 's' || l_suppkey]) AS key, 'As [@p' || l_partkey || '; see @s' || l_suppkey || ', p. 4] show in @fig:' || (l_linenumber + 1) || ' well (a@b.c, @code).' AS context, 'Start now' AS section FROM lineitem
  UNION ALL SELECT l_orderkey, 'x' || l_linenumber, 'Start now', 'Start now' FROM lineitem WHERE l_quantity > 25
  UNION ALL SELECT DISTINCT l_orderkey, 'intro', 'Intro @intro', '' FROM lineitem""")
def markdown_citations(spark, d):
    return markdown.citations(markdown_papers(spark, d)).select("paper", "key", "context", "section")


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS paper, 'fig:' || l_linenumber AS label, true AS figure FROM lineitem WHERE l_quantity > 25)
  SELECT * FROM l UNION ALL SELECT DISTINCT l_orderkey, 'lst:' || l_linenumber, false FROM lineitem WHERE l_tax > 0.05 UNION ALL SELECT DISTINCT l_orderkey, unnest(['sec:start', 'two-parts']), false FROM lineitem""")
def markdown_labels(spark, d):
    return markdown.labels(markdown_papers(spark, d))


@query("""SELECT l_orderkey AS paper, 'fig:' || (l_linenumber + 1) AS label, 'dangling' AS problem FROM lineitem EXCEPT SELECT l_orderkey, 'fig:' || l_linenumber, 'dangling' FROM lineitem WHERE l_quantity > 25
  UNION ALL (SELECT l_orderkey, 'fig:' || l_linenumber, 'unreferenced' FROM lineitem WHERE l_quantity > 25 EXCEPT SELECT l_orderkey, 'fig:' || (l_linenumber + 1), 'unreferenced' FROM lineitem)""")
def markdown_references(spark, d):
    return markdown.reference_problems(markdown_papers(spark, d))


@query("SELECT DISTINCT l_orderkey AS paper, 'pandoc' AS style, 'a' || l_orderkey || '.bib|b.bib' AS paths FROM lineitem UNION ALL SELECT -1 - doc_id, CASE WHEN regexp_matches(text, '\\[\\d+(?:[,;\\s]+\\d+)*\\]') THEN 'numeric' ELSE 'none' END, '' FROM documents WHERE text NOT LIKE '%@%'")
def markdown_styles(spark, d):
    """Of rendered papers, and of documents without an at sign."""
    texts = table(spark, d, "documents").where("text NOT LIKE '%@%'").select((-1 - F.col("doc_id")).alias("paper"), "text")
    papers = markdown_papers(spark, d).unionByName(texts)
    paths = markdown.bibliographies(papers).groupBy("paper").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]), "|").alias("paths"))
    return markdown.citation_styles(papers).join(paths, "paper", "left").na.fill("", ["paths"])


# ---- checks ------------------------------------------------------------------------------------------------------


def _sections(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), n.alias("ord"), (n % 2).alias("depth"), F.when(n % 4 == 0, " References ").otherwise(F.concat(F.lit("Part "), n)).alias("title"), F.when(n % 5 == 0, "\n ").otherwise(F.concat(F.lit("t"), F.col("l_partkey"))).alias("text"))


_BODIES = """b AS (SELECT paper, string_agg(part, chr(10) || chr(10) ORDER BY ord, part) AS body FROM (
    SELECT l_orderkey AS paper, l_linenumber AS ord, CASE WHEN l_linenumber % 2 = 1 THEN '### ' ELSE '## ' END || 'Part ' || l_linenumber || chr(10) || chr(10) || 't' || l_partkey AS part FROM lineitem WHERE l_linenumber % 4 > 0 AND l_linenumber % 5 > 0
    UNION ALL SELECT o_orderkey, -1, '## Abstract' || chr(10) || chr(10) || 'about ' || o_custkey FROM orders WHERE o_custkey % 2 = 0) GROUP BY paper)"""


def _bodies(spark, d):
    abstracts = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("about "), "o_custkey")).otherwise("").alias("text"))
    return checks.paper_bodies(_sections(spark, d), abstracts)


@query(f"WITH {_BODIES} SELECT paper, body, floor(length(body) / 3.5)::BIGINT AS body_tokens FROM b")
def paper_bodies(spark, d):
    return _bodies(spark, d)


@query(f"""WITH {_BODIES}, f AS (SELECT o_orderkey AS paper, 'figure of ' || o_custkey AS figures FROM orders WHERE o_orderkey % 3 = 0),
  c AS (SELECT r_name AS check_id, 'ask ' || r_regionkey AS question, r_regionkey % 2 = 0 AS requires_figures FROM region WHERE r_regionkey <> 3)
  SELECT b.paper, check_id, question, body, coalesce(figures, 'Not available.') AS figures FROM b LEFT JOIN f ON f.paper = b.paper CROSS JOIN c
  WHERE floor(length(body) / 3.5) + floor(length(coalesce(figures, 'Not available.')) / 3.5) <= 30 AND (NOT requires_figures OR figures IS NOT NULL)""")
def check_queries(spark, d):
    """A catalogue of one check a region, one of them switched off; every second is of figures, which a third of the papers have."""
    region = table(spark, d, "region")
    catalogue = region.select(F.col("r_name").alias("check_id"), F.lit("full-paper").alias("category"), F.concat(F.lit("ask "), "r_regionkey").alias("question"), (F.col("r_regionkey") % 2 == 0).alias("requires_figures"))
    off = region.where("r_regionkey = 3").select(F.col("r_name").alias("check_id"))
    figures = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("paper"), F.concat(F.lit("figure of "), "o_custkey").alias("text"))
    return checks.check_queries(_bodies(spark, d), figures, checks.selected_checks(catalogue, off, "full-paper"), 30)


@query("""WITH o AS (SELECT o_orderkey AS paper, o_custkey AS c, o_orderkey % 7 AS k FROM orders),
  i AS (SELECT paper, c, k, unnest(range(0, c % 8)) AS i FROM o WHERE k NOT IN (5, 6))
  SELECT 'key' || paper AS key, 'warning' AS level, 'numbers' AS rule_id, '[key' || paper || '] ' || left(repeat('issue ' || i || ' ', 40), 300) AS message, 'seen ' || i AS context FROM i WHERE i < 5 AND i % 3 > 0
  UNION ALL SELECT 'key' || paper, 'warning', 'llm-unavailable', '[key' || paper || '] numbers: LLM call exhausted retries; check did not run', '' FROM o WHERE k = 6""")
def answered_findings(spark, d):
    """Answers as they come: bare, fenced, after thinking, among words, not JSON, none; issues beyond five and what isn't genuine don't count."""
    k, c = F.col("o_orderkey") % 7, F.col("o_custkey")
    issues = F.transform(F.sequence(F.lit(0), (c % 8).cast("int")), lambda i: F.struct(F.repeat(F.concat(F.lit("issue "), i, F.lit(" ")), F.lit(40)).alias("description"), F.concat(F.lit("seen "), i).alias("evidence"), (i % 3 > 0).alias("is_genuine")))
    body = F.to_json(F.struct(F.slice(issues, 1, (c % 8).cast("int")).alias("issues")))
    answer = (F.when(k == 0, body).when(k == 1, text_of("```json\n", body, "\n```")).when(k == 2, text_of("<think>{no}</think>\n", body)).when(k == 3, text_of("Here it is: ", body, " as asked")).when(k == 4, text_of("<thinking>a\nb</thinking>```\n", body, "```\n"))
              .when(k == 5, "I found {nothing}"))
    answers = table(spark, d, "orders").select(F.concat(F.lit("key"), "o_orderkey").alias("paper"), F.lit("numbers").alias("check_id"), answer.alias("answer"))
    return checks.cited_paper_findings(checks.answered_findings(answers).withColumnRenamed("paper", "key"))


@query("""SELECT p_partkey AS id FROM part WHERE p_partkey % 7 > 1 AND p_size % 6 > 1 AND p_size % 5 > 1""")
def emittable_issues(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    said = F.when(n % 6 == 0, "This is Grammatically Correct as it is").when(n % 6 == 1, "Somewhat AWKWARD here").otherwise("Verb and subject disagree")
    fix = F.when(n % 5 == 0, " THE SPAN ").when(n % 5 == 1, F.lit(None)).otherwise("a fix")
    return checks.emittable(table(spark, d, "part").select(k.alias("id"), F.when(k % 7 == 0, " ").when(k % 7 == 1, F.lit(None)).otherwise("the span").alias("span"), fix.alias("suggestion"), said.alias("issue"))).select("id")
