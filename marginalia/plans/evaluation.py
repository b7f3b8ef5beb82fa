"""Queries on assignments: findings to expectations, files to references. The SQL goes through the choosers one after another."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.functions import arrays
from marginalia.operators import assignment, constraints, extract, injection
from marginalia.plans.catalogue import query, table
from marginalia.scratch import Scratch
from marginalia.sources import readers

_NUMBERED = """l AS (SELECT l_orderkey // 3 AS grp, l_partkey AS p, l_suppkey AS s, (row_number() OVER (PARTITION BY l_orderkey // 3 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey))::INT AS n FROM lineitem)"""


def _numbered(spark, d):
    li = table(spark, d, "lineitem").withColumn("grp", F.expr("l_orderkey div 3"))
    n = F.row_number().over(Window.partitionBy("grp").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    rows = li.select("grp", F.lit("dangling-cite").alias("check"), n.alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    wanted = F.when(F.col("n") % 5 == 0, "").when(F.col("n") % 5 != 4, F.concat(F.lit("k"), F.col("p") % 4))
    expected = rows.select("grp", "check", F.col("n").alias("exp"), wanted.alias("context"))
    found = rows.where("p % 6 > 0").select("grp", F.when(F.col("s") % 5 == 0, "dangling-ref").otherwise(F.col("check")).alias("check"), F.col("n").alias("finding"), F.concat(F.lit("k"), F.col("s") % 4).alias("context"), F.concat(F.lit("about k"), F.col("p") % 3).alias("message"))
    return expected, found


_TURNS = f"""{_NUMBERED},
  f AS (SELECT grp, list({{'n': n, 'a': 'k' || s % 4, 'b': 'about k' || p % 3}} ORDER BY n) AS fs FROM l WHERE p % 6 > 0 AND s % 5 <> 0 GROUP BY grp),
  t AS (SELECT l.grp, n, CASE WHEN n % 5 = 0 THEN '' WHEN n % 5 <> 4 THEN 'k' || p % 4 END AS w, coalesce(fs, []) AS fs FROM l LEFT JOIN f ON f.grp = l.grp),
  r AS (SELECT grp, 0 AS n, []::INT[] AS used, NULL::INT AS got FROM (SELECT DISTINCT grp FROM t)
    UNION ALL SELECT grp, n, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END, got FROM (
      SELECT r.grp, t.n, r.used, list_min(list_transform(list_filter(t.fs, lambda x: NOT list_contains(r.used, x.n) AND coalesce(t.w = '' OR contains(x.a, t.w) OR contains(x.b, t.w), false)), lambda x: x.n)) AS got
      FROM r JOIN t ON t.grp = r.grp AND t.n = r.n + 1))"""


@query(f"""WITH RECURSIVE {_TURNS}
  SELECT grp, 'dangling-cite' AS "check", n AS exp, coalesce(got, -1) AS finding FROM r WHERE n > 0""")
def matched_findings(spark, d):
    return assignment.matched_findings(*_numbered(spark, d)).na.fill({"finding": -1})


@query(f"""WITH RECURSIVE {_TURNS},
  m AS (SELECT grp, count(*) FILTER (WHERE p % 6 > 0 AND s % 5 <> 0) AS made, count(*) FILTER (WHERE p % 6 > 0 AND s % 5 = 0) AS other FROM l GROUP BY grp)
  SELECT m.grp, 'dangling-cite' AS "check", count(got) AS tp, any_value(made) - count(got) AS fp, count(*) - count(got) AS fn FROM r JOIN m ON m.grp = r.grp WHERE n > 0 GROUP BY m.grp
  UNION ALL SELECT grp, 'dangling-ref', 0, other, 0 FROM m WHERE other > 0""")
def detection_counts(spark, d):
    return assignment.detection_counts(*_numbered(spark, d))


@query("""WITH t AS (SELECT p_partkey AS k, p_partkey // 20 AS paper, md5((p_partkey // 2)::VARCHAR) || md5('x' || p_partkey // 2) AS title FROM part),
  named AS (SELECT paper, 'Key' || k AS key, 'key' || k || '_' || 'my copy.PDF' AS name FROM t WHERE k % 5 = 0),
  f AS (SELECT paper, title, name, row_number() OVER (PARTITION BY paper, title ORDER BY name) AS i FROM (
    SELECT paper, title, left(title, 30) || '_' || substr(title, 31) || '.pdf' AS name FROM t WHERE k % 4 = 0 UNION SELECT paper, title, left(title, 10) || '-' || substr(title, 11) || '.md' FROM t WHERE k % 6 = 0)),
  r AS (SELECT paper, title, 'Key' || k AS key, row_number() OVER (PARTITION BY paper, title ORDER BY k) AS i FROM t WHERE k % 5 <> 0)
  SELECT paper, key, name, 'key' AS pass FROM named UNION ALL SELECT paper, key, name, 'title' FROM f JOIN r USING (paper, title, i)""")
def assigned_files(spark, d):
    """Files named by keys, by titles with a separator in them, and of kinds that don't count; titles come in pairs that are alike, others are far apart."""
    half, key = F.expr("p_partkey div 2").cast("string"), F.col("p_partkey")
    t = table(spark, d, "part").select(key.alias("k"), F.expr("p_partkey div 20").alias("paper"), F.concat(F.md5(half.cast("binary")), F.md5(F.concat(F.lit("x"), half).cast("binary"))).alias("title"))
    def split(at, sep, suffix):
        return F.concat(F.left("title", F.lit(at)), F.lit(sep), F.substring("title", at + 1, 100), F.lit(suffix))

    files = t.where("k % 5 = 0").select("paper", F.concat(F.lit("key"), "k", F.lit("_my copy.PDF")).alias("name")).unionByName(t.where("k % 4 = 0").select("paper", split(30, "_", ".pdf").alias("name")))
    files = files.unionByName(t.where("k % 6 = 0").select("paper", split(10, "-", ".md").alias("name"))).unionByName(t.select("paper", F.concat("title", F.lit(".txt")).alias("name")))
    return assignment.assigned_files(files, t.select("paper", F.concat(F.lit("Key"), "k").alias("key"), F.col("k").alias("ord"), "title"))


# ---- injected errors ---------------------------------------------------------------------------------------------


def _drawn(*parts: str) -> str:
    return "('0x' || substr(md5('7:' || " + " || ':' || ".join(parts) + "), 1, 15))::BIGINT"


_INJECTED = rf"""
  l AS (SELECT l_orderkey AS paper, l_linenumber AS n, l_quantity > 10 AS cites, 'We follow the line of work number ' || l_partkey || ' on parts.' AS s,
      ' See Figure' || CASE WHEN l_suppkey % 2 = 0 THEN ' ' ELSE '~' END AS r, l_suppkey % 2 = 0 AS named, '\ref{{fig:' || l_linenumber || '}} now.' AS t FROM lineitem),
  m AS (SELECT *, CASE WHEN cites THEN s || r || t ELSE s END AS line, 43 + length((paper % 90 + 10)::VARCHAR) + coalesce(sum(length(CASE WHEN cites THEN s || r || t ELSE s END) + 1) OVER (PARTITION BY paper ORDER BY n, CASE WHEN cites THEN s || r || t ELSE s END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off,
      row_number() OVER (PARTITION BY paper ORDER BY n, CASE WHEN cites THEN s || r || t ELSE s END) AS i FROM l),
  c AS (SELECT paper, i, off + length(s) AS at_, 'fakename' || (2020 + {_drawn("paper", "'year'")} % 7) || ['survey', 'analysis', 'framework'][row_number() OVER (PARTITION BY paper ORDER BY i)] AS key
        FROM (SELECT * FROM m WHERE paper % 2 = 0 QUALIFY row_number() OVER (PARTITION BY paper ORDER BY {_drawn("paper", "'cite'", "(off + length(s))")}) <= 3)),
  f AS (SELECT paper, i, 'fig:phantom' || (10 + {_drawn("paper", "'label'")} % 90) AS label, off + length(s || r) + 5 AS at_, kind, CASE kind WHEN 0 THEN off + length(s) + 5 WHEN 1 THEN off + length(s || r) ELSE off + length(s) - 1 END AS place, length(n::VARCHAR) + 4 AS cut, line, off, s
        FROM (SELECT *, 1 AS kind FROM m WHERE cites UNION ALL SELECT *, 0 FROM m WHERE cites AND named)
        QUALIFY row_number() OVER (PARTITION BY paper ORDER BY kind, {_drawn("paper", "'ref'", "place")}) = 1),
  x AS (SELECT m.paper, m.i, CASE WHEN c.key IS NULL THEN s ELSE s || ' \cite{{' || c.key || '}}' END || CASE WHEN NOT cites THEN '' WHEN f.label IS NULL THEN r || t ELSE r || '\ref{{' || f.label || '}} now.' END AS line
        FROM m LEFT JOIN c ON c.paper = m.paper AND c.i = m.i LEFT JOIN (SELECT paper, i, label FROM f) f ON f.paper = m.paper AND f.i = m.i),
  j AS (SELECT paper, 'dangling-cite' AS rule_id, key AS context, at_ AS pos FROM c UNION ALL SELECT paper, 'dangling-ref', label, at_ FROM f)"""


def _injected(spark, d):
    s = F.col("l_suppkey")
    line = F.concat(F.lit("We follow the line of work number "), "l_partkey", F.lit(" on parts."), F.when(F.col("l_quantity") > 10, F.concat(F.lit(" See Figure"), F.when(s % 2 == 0, " ").otherwise("~"), F.lit("\\ref{fig:"), "l_linenumber", F.lit("} now."))).otherwise(""))
    # items are dealt to their paper's task as they are, and written out there
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition("l_orderkey")
    lines = F.array_join(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("t"))))["t"], "\n")
    paper = F.col("l_orderkey")
    head = F.concat(F.lit("\\begin{abstract}We gain "), paper % 90 + 10, F.lit(" pp.\\end{abstract}\n"))
    docs = li.groupBy(paper.alias("paper")).agg(F.concat(F.first(head), lines, F.when(F.first(paper) % 2 == 0, "\n\\bibitem{a} x").otherwise("")).alias("text"))
    # papers without a reference would get one before a sentence
    return injection.inject_errors(docs.where(F.contains("text", F.lit("\\ref{"))), seed=7)


@query(f"""WITH {_INJECTED} SELECT j.paper, rule_id, context, pos::INT AS "at" FROM j JOIN (SELECT DISTINCT paper FROM f) USING (paper)""")
def injected_errors(spark, d):
    return arrays.exploded(_injected(spark, d), "i", F.col("injections"), "paper").select("paper", "i.*")


@query(rf"""WITH {_INJECTED} SELECT x.paper, md5('\begin{{abstract}}We gain ' || (x.paper % 90 + 10) || ' pp.\end{{abstract}}' || chr(10) || string_agg(line, chr(10) ORDER BY i) || CASE WHEN x.paper % 2 = 0 THEN chr(10) || '\bibitem{{a}} x' ELSE '' END) AS text
  FROM x WHERE paper IN (SELECT paper FROM f) GROUP BY x.paper""")
def injected_texts(spark, d):
    return _injected(spark, d).select("paper", F.md5(F.col("text").cast("binary")).alias("text"))


@query(f"""WITH {_INJECTED} SELECT rule_id, count(*) AS injected, count(*) AS found, 1.0::DOUBLE AS recall FROM j JOIN (SELECT DISTINCT paper FROM f) USING (paper) GROUP BY rule_id""")
def injection_recall(spark, d):
    """The checks of dangling citations and references find every injected error."""
    made = Scratch(spark, "injection_recall").put(_injected(spark, d), "made")  # read by each check
    texts = made.select("paper", "text")
    cites = extract.cite_keys(texts).join(readers.bibitems(texts), ["paper", "key"], "left_anti").select("paper", F.lit("dangling-cite").alias("rule_id"), F.col("key").alias("context"))
    refs = extract.dangling_refs(texts).select("paper", F.lit("dangling-ref").alias("rule_id"), F.col("label").alias("context"))
    return injection.injection_report(made, cites.unionByName(refs))


# ---- constraints -------------------------------------------------------------------------------------------------

_SCORES = """sc AS (SELECT CASE s_suppkey WHEN 1 THEN 'Graphene' WHEN 2 THEN 'LIGO' WHEN 3 THEN 'Ceballos' ELSE 'S' || s_suppkey END AS name, s_suppkey AS k, s_nationkey AS nation, floor(s_acctbal / 1000)::INT / 10.0::DOUBLE AS score, (s_suppkey % 7) / 7.0::DOUBLE AS consistency, (s_suppkey % 3) / 3.0::DOUBLE AS quality, (s_suppkey % 5) / 5.0::DOUBLE AS severity FROM supplier)"""
_ASKED = """q AS (SELECT nation, k, score, unnest([
    {'n': 0, 'l': 'S' || k, 'la': NULL, 'op': '>', 'r': 'S' || (k + 1), 'ra': NULL, 'raw': 'S' || k || '>S' || (k + 1)},
    {'n': 1, 'l': 'S' || k, 'la': 'test_severity', 'op': '<', 'r': 'S' || (k + 2), 'ra': 'integrity', 'raw': 'S' || k || ' test-severity < S' || (k + 2) || ' integrity # why (not)'},
    {'n': 2, 'l': 'S' || k, 'la': NULL, 'op': '≈', 'r': 'LIGO', 'ra': 'odd-axis', 'raw': 'S' || k || ' (a survey) ≈ LIGO odd-axis'},
    {'n': 3, 'l': 'S' || k, 'la': 'overall', 'op': '<', 'r': 'Graphene', 'ra': 'overall', 'raw': 'S' || k || ' contribution < any experimental paper'},
    {'n': 4, 'l': 'S' || k, 'la': 'overall', 'op': '<', 'r': 'LIGO', 'ra': 'overall', 'raw': 'S' || k || ' contribution < any experimental paper'},
    {'n': 5, 'l': 'S' || k, 'la': 'overall', 'op': '<', 'r': 'Ceballos', 'ra': 'overall', 'raw': 'S' || k || ' contribution < any experimental paper'}]) AS c FROM sc),
  qq AS (SELECT name, floor((row_number() OVER (ORDER BY score DESC, k) - 1) * 4 / (SELECT count(*) FROM sc))::INT AS quart FROM sc),
  vals AS (SELECT name, unnest([{'axis': '', 'v': score}, {'axis': 'integrity', 'v': consistency * quality}, {'axis': 'test_severity', 'v': severity}, {'axis': 'overall', 'v': score / 2}, {'axis': 'odd-axis', 'v': 0.0}]) AS a FROM sc),
  held AS (SELECT nation, k, c.n AS n, c.l AS "left", c.op AS op, c.r AS "right", c.raw AS raw, a.a.v AS left_value, b.a.v AS right_value, CASE c.op WHEN '>' THEN a.a.v > b.a.v WHEN '<' THEN a.a.v < b.a.v ELSE qa.quart = qb.quart END AS passed
    FROM q JOIN vals a ON a.name = c.l AND a.a.axis = coalesce(c.la, '') JOIN vals b ON b.name = c.r AND b.a.axis = coalesce(c.ra, '') JOIN qq qa ON qa.name = c.l JOIN qq qb ON qb.name = c.r)"""


def _held(spark, d):
    """A manifest for each nation, with a paper of the lines' own for each supplier; some names have no scores."""
    k = F.col("s_suppkey")
    name = F.when(k == 1, "Graphene").when(k == 2, "LIGO").when(k == 3, "Ceballos").otherwise(F.concat(F.lit("S"), k))
    own = F.concat(F.lit("S"), k)
    lines = F.concat(own, F.lit(">"), F.lit("S"), k + 1, F.lit("\n# only a comment\n  "), own, F.lit(" test-severity < S"), k + 2, F.lit(" integrity # why (not)\nno constraint here\n"), own, F.lit(" (a survey) ≈ LIGO odd-axis\n\n"), own, F.lit(" contribution < any experimental paper"))
    text = F.concat(F.lit("Intro\nA > B\n```\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, lines.alias("t")))), lambda x: x["t"]), "\n"), F.lit("\n```\nC > D\n```\nE > F\n```"))
    suppliers = table(spark, d, "supplier")
    manifests = suppliers.groupBy(F.col("s_nationkey").alias("manifest")).agg(text.alias("text"))
    score = F.floor(F.col("s_acctbal") / 1000).cast("int") / F.lit(10.0)
    scores = suppliers.select(name.alias("name"), k.alias("ord"), score.alias("score"), ((k % 7) / F.lit(7.0)).alias("internal_consistency"), ((k % 3) / F.lit(3.0)).alias("referencing_quality"), F.create_map(F.lit("test_severity"), (k % 5) / F.lit(5.0), F.lit("overall"), score / 2).alias("contribution"))
    return constraints.held_constraints(constraints.constraints(manifests), scores)


@query(f"""WITH {_SCORES}, {_ASKED} SELECT nation AS manifest, "left", op, "right", raw, left_value, right_value, passed FROM held""")
def held_constraints(spark, d):
    return _held(spark, d).select("manifest", "left", "op", "right", "raw", "left_value", "right_value", "passed")


@query(f"""WITH {_SCORES}, {_ASKED} SELECT nation AS manifest, count(*) AS total, count(*) FILTER (WHERE passed) AS passed, round(count(*) FILTER (WHERE passed) / count(*), 4) AS pass_rate, coalesce(string_agg(raw, '|' ORDER BY k, n) FILTER (WHERE NOT passed), '') AS failures FROM held GROUP BY nation""")
def calibration(spark, d):
    return constraints.calibration(_held(spark, d)).withColumn("failures", F.array_join("failures", "|"))
