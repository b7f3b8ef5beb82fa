"""Queries on manuscripts' text: balanced arguments, Markdown sections, citation and footnote contexts.

Manuscripts are rendered from line items, Markdown from documents, whose short
lines become headings. The SQL works from the tables, or folds recursively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators import arguments, sections
from marginalia.plans.catalogue import query, table

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def joined(rows: DataFrame, line: Column, between: str) -> Column:
    """A group's lines in the order of line number and text."""
    return F.array_join(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("t"))))["t"], between)


def text_of(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


# ---- arguments ---------------------------------------------------------------------------------------------------


@query(r"""WITH l AS (SELECT l_orderkey AS paper, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_quantity > 25 AS nested,
    '\section{Part ' || l_linenumber || ' of {{' || l_partkey || '}}}' || chr(10) || '\caption{' || CASE WHEN l_quantity > 25 THEN '\emph{a' || chr(10) || '\label{x' || l_suppkey || '} {b}}' ELSE 'flat' END || ' \}}' || ' \label{open' AS t FROM lineitem),
  m AS (SELECT *, 3 + coalesce(sum(CASE WHEN nested THEN 3 ELSE 2 END) OVER (PARTITION BY paper ORDER BY n, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT - 2 AS line,
    lead(t) OVER (PARTITION BY paper ORDER BY n, t) AS next FROM l)
  SELECT paper, 'section' AS command, line, 'Part ' || n || ' of {{' || p || '}}' AS argument FROM m
  UNION ALL SELECT paper, 'label', line + 2, 'x' || s FROM m WHERE nested
  UNION ALL SELECT paper, 'label', line + CASE WHEN nested THEN 2 ELSE 1 END, 'open' || chr(10) || left(next, len(next) - 13) FROM m WHERE next IS NOT NULL""")
def command_arguments(spark, d):
    """``\\caption`` is closed by an escaped brace, which counts, so the brace after it ends the ``\\label{open`` of the line before; the last one never ends."""
    li = table(spark, d, "lineitem")
    inner = F.when(F.col("l_quantity") > 25, text_of("\\emph{a\n\\label{x", F.col("l_suppkey"), "} {b}}")).otherwise("flat")
    line = text_of("\\section{Part ", F.col("l_linenumber"), " of {{", F.col("l_partkey"), "}}}\n\\caption{", inner, " \\}}", " \\label{open")
    docs = li.groupBy(F.col("l_orderkey").alias("paper")).agg(joined(li, line, "\n").alias("text"))
    return arguments.command_arguments(docs, ["section", "label"])


# ---- sections ----------------------------------------------------------------------------------------------------


def _chunks(name: str, source: str) -> str:
    """Recursion over the paragraphs of ``source (id, paras)`` to ``{name} (id, no, text)``."""
    return f"""
{name}_fold AS (
  SELECT id, paras, 1 AS i, [paras[1]] AS held, len(paras[1]) AS size, NULL::VARCHAR AS chunk FROM {source}
  UNION ALL
  SELECT id, paras, i + 1, list_append(CASE WHEN over THEN kept ELSE held END, p), CASE WHEN over THEN coalesce(list_sum(list_transform(kept, lambda x: len(x))), 0) ELSE size END + len(p),
         CASE WHEN over THEN array_to_string(held, chr(10) || chr(10)) END
  FROM (SELECT *, paras[i + 1] AS p, size + len(paras[i + 1]) > 4000 AS over,
          held[len(held) + 1 - len(list_filter(range(1, len(held) + 1), lambda n: list_sum(list_transform(held[len(held) - n + 1 :], lambda x: len(x))) <= 2000)) :] AS kept
        FROM {name}_fold WHERE i < len(paras))),
{name} AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, last) AS no, trim(chunk, {BLANKS}) AS text
  FROM (SELECT id, i, 0 AS last, chunk FROM {name}_fold WHERE chunk IS NOT NULL
        UNION ALL SELECT id, i, 1, array_to_string(held, chr(10) || chr(10)) FROM {name}_fold WHERE i = len(paras) AND trim(array_to_string(held, ''), {BLANKS}) <> '')),"""


@query(rf"""WITH RECURSIVE d AS (
  SELECT doc_id AS paper, replace(regexp_replace(coalesce(text, ''), '(?m)^(.{{1,40}})$', '## \1', 'g'), chr(10), chr(10) || chr(10)) AS text FROM documents),
plain AS (SELECT paper AS id, string_split(text, chr(10) || chr(10)) AS paras FROM d WHERE NOT regexp_matches(text, '(?m)^#{{1,3}}\s+')),
{_chunks('whole', 'plain')}
heads AS (SELECT paper, unnest(list_concat(['## Preamble'], regexp_extract_all(text, '(?m)^(#{{1,3}}\s+.+)$', 1))) AS title, unnest(regexp_split_to_array(text, '(?m)^(#{{1,3}}\s+.+)$')) AS text,
    unnest(range(0, 1 + len(regexp_extract_all(text, '(?m)^(#{{1,3}}\s+.+)$', 1)))) AS n FROM d WHERE regexp_matches(text, '(?m)^#{{1,3}}\s+')),
secs AS (
  SELECT paper, n, trim(ltrim(trim(title, {BLANKS}), '#'), {BLANKS}) AS title, trim(text, {BLANKS}) AS text FROM heads WHERE trim(text, {BLANKS}) <> ''
  UNION ALL SELECT id, no, 'Chunk ' || no, text FROM whole),
isl AS (SELECT *, sum(CASE WHEN len(text) >= 200 OR first THEN 1 ELSE 0 END) OVER (PARTITION BY paper ORDER BY n) AS k
        FROM (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY n) = 1 AS first FROM secs)),
merged AS (SELECT paper, k, min_by(title, n) AS title, string_agg(text, chr(10) || chr(10) ORDER BY n) AS text FROM isl GROUP BY paper, k),
mended AS (
  SELECT paper, k, title, CASE WHEN k = 2 AND len(prior) < 200 THEN prior || chr(10) || chr(10) || text ELSE text END AS text
  FROM (SELECT *, lag(text) OVER (PARTITION BY paper ORDER BY k) AS prior, lead(k) OVER (PARTITION BY paper ORDER BY k) AS next FROM merged)
  WHERE NOT (k = 1 AND len(text) < 200 AND next IS NOT NULL)),
long AS (SELECT paper || '/' || k AS id, string_split(text, chr(10) || chr(10)) AS paras FROM mended WHERE len(text) > 8000),
{_chunks('pieces', 'long')}
final AS (
  SELECT paper, k, 0 AS no, title, text FROM mended WHERE len(text) <= 8000
  UNION ALL SELECT m.paper, m.k, p.no, m.title || ' (part ' || p.no || ')', p.text FROM mended m JOIN pieces p ON p.id = m.paper || '/' || m.k)
SELECT paper, (row_number() OVER (PARTITION BY paper ORDER BY k, no) - 1)::INT AS ord, title, text FROM final
UNION ALL SELECT paper, 0, 'Full text', text FROM d WHERE trim(text, {BLANKS}) = ''""")
def markdown_sections(spark, d):
    """Lines of at most 40 characters are headings; line feeds part paragraphs."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?md)^(.{1,40})$", "## $1")
    return sections.markdown_sections(table(spark, d, "documents").select(F.col("doc_id").alias("paper"), F.replace(text, F.lit("\n"), F.lit("\n\n")).alias("text")))


# ---- contexts ----------------------------------------------------------------------------------------------------

#: A paragraph for each line item, its offset, and which paragraph has a position, as SQL over ``p (paper, n, t, head)``: paragraphs as rendered and the characters before the marked position.
_PLACED = """
o AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY n, t) AS i FROM p),
s AS (SELECT paper, i, t, CASE WHEN i = 1 AND left(t, 1) <> '\\' THEN '\\begin{document}' || chr(10) ELSE '' END || rtrim(t) AS own,
        CASE WHEN i = 1 AND left(t, 1) <> '\\' THEN 0 WHEN i = 1 THEN 17 ELSE 17 + sum(len(t) + 2) OVER (PARTITION BY paper ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS start,
        17 + coalesce(sum(len(t) + 2) OVER (PARTITION BY paper ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + head AS pos FROM o
      UNION ALL SELECT paper, 0, NULL, '\\begin{document}', 0, NULL FROM o WHERE i = 1 AND left(t, 1) = '\\'),
w AS (SELECT *, lag(own) OVER (PARTITION BY paper ORDER BY i) AS before, lead(own) OVER (PARTITION BY paper ORDER BY i) AS after FROM s),
c AS (SELECT a.paper, a.i, a.t, a.pos, min_by({'start': b.start, 'own': b.own, 'before': b.before, 'after': b.after}, b.i) AS b
      FROM s a JOIN w b ON a.paper = b.paper AND b.start <= a.pos AND a.pos < b.start + len(b.own) + 50 GROUP BY a.paper, a.i, a.t, a.pos),
x AS (SELECT paper, i, t, pos, concat_ws(chr(10), b.before, b.own, CASE WHEN pos - b.start > 0.8 * len(b.own) THEN b.after END) AS context, (1 + 2 * i)::INT AS line FROM c)"""


def _manuscript(spark, d, line: Column) -> DataFrame:
    # items are dealt to their paper's task as they are, and written out there
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition("l_orderkey")
    body = joined(li, line, "\n\n")
    return li.groupBy(F.col("l_orderkey").alias("paper")).agg(text_of("\\documentclass{a}\n\\begin{document}\n", body, "\n\\bibliography{refs}\n").alias("text"))


@query(rf"""WITH p AS (SELECT l_orderkey AS paper, l_linenumber AS n, CASE WHEN l_linenumber % 3 = 0 THEN '\subsection{{Part ' || l_linenumber || '}} ' ELSE 'Item ' END || repeat('w ', l_quantity::INT) || '\cite{{p' || l_partkey || ', s' || l_suppkey || '}} ' || repeat('z ', (l_partkey % 20)::INT) AS t,
    len(CASE WHEN l_linenumber % 3 = 0 THEN '\subsection{{Part ' || l_linenumber || '}} ' ELSE 'Item ' END) + 2 * l_quantity::INT AS head FROM lineitem), {_PLACED},
  k AS (SELECT paper, line, pos, context, trim(unnest(string_split(regexp_extract(t, '\\cite\{{([^}}]+)\}}', 1), ','))) AS key FROM x)
  SELECT paper, key, line, pos::INT AS "at", trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(context, '\\cite\{{(?:[^}}]*,)?\s*' || key || '\s*(?:,[^}}]*)?\}}', '[TARGET_CITE]', 'g'), '\\cite\{{[^}}]+\}}', '[CITE]', 'g'), '\\[a-z]+\{{([^}}]*)\}}', '\1', 'g'), '\s+', ' ', 'g')) AS context FROM k""")
def citation_contexts(spark, d):
    """Paragraphs of many lengths, every third under a section command, a citation early or late in each."""
    lead = F.when(F.col("l_linenumber") % 3 == 0, text_of("\\subsection{Part ", F.col("l_linenumber"), "} ")).otherwise("Item ")
    line = text_of(lead, F.repeat(F.lit("w "), F.col("l_quantity").cast("int")), "\\cite{p", F.col("l_partkey"), ", s", F.col("l_suppkey"), "} ", F.repeat(F.lit("z "), (F.col("l_partkey") % 20).cast("int")))
    return sections.citation_contexts(_manuscript(spark, d, line))


@query(rf"""WITH p AS (SELECT l_orderkey AS paper, l_linenumber AS n, 'Item ' || repeat('w ', l_quantity::INT) || '\footnote{{See \url{{HTTP://Example.org/p' || l_partkey || '/#x}}}} ' || repeat('z ', (l_partkey % 20)::INT) AS t, 5 + 2 * l_quantity::INT AS head FROM lineitem), {_PLACED},
  k AS (SELECT paper, line, context, regexp_extract(t, '\\url\{{([^}}]+)\}}', 1) AS url FROM x)
  SELECT paper, 'fn_' || left(sha256('http://example.org/' || regexp_extract(url, 'p\d+')), 10) AS key, url, line, trim(regexp_replace(regexp_replace(replace(regexp_replace(context, '\\footnote\{{[^}}]*\}}', '', 'g'), '}}', ' '), '\\begin.document', 'document', 'g'), '\s+', ' ', 'g')) AS context,
    CASE WHEN regexp_extract(url, 'p(\d+)', 1)::BIGINT % 3 = 0 THEN 'capture' || regexp_extract(url, 'p(\d+)', 1) || '.md' END AS file FROM k""")
def footnote_claims(spark, d):
    """Footnotes with addresses, a third of whose pages have a capture."""
    line = text_of("Item ", F.repeat(F.lit("w "), F.col("l_quantity").cast("int")), "\\footnote{See \\url{HTTP://Example.org/p", F.col("l_partkey"), "/#x}} ", F.repeat(F.lit("z "), (F.col("l_partkey") % 20).cast("int")))
    captures = table(spark, d, "lineitem").where("l_partkey % 3 = 0").select(text_of("http://example.org/p", F.col("l_partkey")).alias("url"), text_of("capture", F.col("l_partkey"), ".md").alias("file"))
    return sections.captured_footnotes(sections.footnote_claims(_manuscript(spark, d, line)), captures)
