"""Further registered queries: findings, coverage and state over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.functions import latex
from marginalia.operators import extract, findings
from marginalia.plans.catalogue import CLAIMS, LINE, claims, manuscripts, query, table


@query("""SELECT event_id AS key, CASE event_type WHEN 'purchase' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END AS level, 'retracted-cite' AS rule FROM events WHERE event_type IN ('purchase', 'click', 'view')""")
def retraction_findings(spark, d):
    nature = F.when(F.col("event_type") == "purchase", "Retraction").when(F.col("event_type") == "click", "Expression of Concern").when(F.col("event_type") == "view", "Correction").otherwise("Reinstatement")
    return findings.retracted(table(spark, d, "events").select(F.col("event_id").alias("key"), nature.alias("nature")))


@query("WITH " + CLAIMS + " SELECT paper, key, line, CASE verdict WHEN 'NOT_SUPPORTED' THEN 'error' ELSE 'warning' END AS level, 'claim-support' AS rule FROM claims WHERE NOT dismissed AND purpose <> 'example' AND verdict IN ('NOT_SUPPORTED', 'PARTIALLY_SUPPORTS')")
def claim_support_findings(spark, d):
    return findings.claim_support(claims(spark, d))


@query("WITH " + CLAIMS + " SELECT paper, key, line, 'warning' AS level, 'cite-purpose' AS rule FROM claims WHERE NOT dismissed AND verdict <> 'SKIPPED' AND purpose IN ('context', 'unknown')")
def cite_purpose_findings(spark, d):
    return findings.cite_purpose(claims(spark, d))


@query("""WITH u AS (SELECT l_orderkey AS paper, l_suppkey AS key, bool_or(l_tax > 0.05) AS unverified FROM lineitem GROUP BY 1, 2), t AS (SELECT s_suppkey AS key, 'T' || (1 + s_nationkey % 3) AS tier FROM supplier)
  SELECT paper, key, CASE WHEN tier = 'T3' THEN 'error' WHEN tier = 'T2' THEN 'warning' ELSE 'info' END AS level, CASE WHEN tier = 'T3' THEN 'ref-008' ELSE 'ref-009' END AS rule FROM u JOIN t USING (key) WHERE tier = 'T3' OR (tier = 'T2' AND NOT unverified) OR (tier = 'T1' AND unverified)""")
def tier_violations(spark, d):
    cites = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("key"), (F.col("l_tax") > 0.05).alias("unverified"))
    return findings.tier_violations(cites, table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.concat(F.lit("T"), 1 + F.col("s_nationkey") % 3).alias("tier")))


ROLL = """SELECT l_suppkey AS ref, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'N') AS found, count(*) FILTER (WHERE l_returnflag = 'A') AS not_found, count(*) FILTER (WHERE l_discount > 0.09) AS retractions, CAST(sum(CAST(l_quantity AS INT) % 3) AS BIGINT) AS mismatches FROM lineitem GROUP BY 1"""


def _entries(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("ref"), F.when(F.col("l_returnflag") == "N", "found").when(F.col("l_returnflag") == "A", "not_found").otherwise("error").alias("status"), (F.col("l_discount") > 0.09).alias("retracted"), (F.col("l_quantity").cast("int") % 3).alias("mismatches"))


@query(f"WITH r AS ({ROLL}) SELECT *, found / total AS found_rate, retractions / total AS retraction_rate FROM r")
def bibliography_roll_up(spark, d):
    return findings.roll_up(_entries(spark, d))


@query("WITH r AS (" + ROLL.replace("l_suppkey AS ref", "l_partkey AS ref") + """), b AS (SELECT ref AS key, greatest(found / total - least(mismatches * 0.05, 0.3) - least(retractions * 0.15, 0.3), 0.0) AS bib FROM r),
  c AS (SELECT l_partkey AS key, avg(CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0.0 END) FILTER (WHERE CAST(l_quantity AS INT) % 5 <> 4 AND l_tax <= 0.07) AS claim FROM lineitem GROUP BY 1),
  m AS (SELECT p_partkey AS key, (p_size % 10) / 10.0 AS meta FROM part WHERE p_size > 5),
  f AS (SELECT coalesce(c.key, m.key) AS key, CAST(coalesce(meta, 1.0) AS DOUBLE) * CAST(coalesce(claim, 1.0) AS DOUBLE) * CAST(coalesce(bib, 1.0) AS DOUBLE) AS r FROM c FULL JOIN m ON c.key = m.key LEFT JOIN b ON b.key = coalesce(c.key, m.key))
  SELECT key, round(r + 1e-9, 6) AS reliability FROM f""")
def reference_reliability(spark, d):
    li = table(spark, d, "lineitem")
    entries = li.select(F.col("l_partkey").alias("ref"), F.when(F.col("l_returnflag") == "N", "found").otherwise("other").alias("status"), (F.col("l_discount") > 0.09).alias("retracted"), (F.col("l_quantity").cast("int") % 3).alias("mismatches"))
    bib = findings.roll_up(entries).withColumnRenamed("ref", "key")
    verdict = F.element_at(F.array(*map(F.lit, ["SUPPORTS", "PARTIALLY_SUPPORTS", "CANNOT_DETERMINE", "NOT_SUPPORTED", "SKIPPED"])), (F.col("l_quantity").cast("int") % 5) + 1)
    said = li.select(F.col("l_partkey").alias("key"), verdict.alias("verdict"), (F.col("l_tax") > 0.07).alias("dismissed"))
    meta = table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("key"), ((F.col("p_size") % 10) / 10.0).alias("meta"))
    return findings.reliability(said, meta, bib).select("key", F.round(F.col("reliability") + 1e-9, 6).alias("reliability"))


@query("""SELECT p_partkey AS key, CAST(CASE WHEN s < 0.4 OR o = 0 THEN 0.0 ELSE CASE WHEN s IS NULL THEN 0.5 ELSE 0.2 + 0.8 * s END + CASE WHEN o > 0 THEN 0.2 ELSE 0.0 END + CASE WHEN p_size = p_partkey % 50 THEN 0.05 ELSE 0.0 END END AS DOUBLE) AS score
  FROM (SELECT p_partkey, p_size, CASE WHEN p_size % 7 = 0 THEN NULL ELSE (p_size % 11) / 10.0 END AS s, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_partkey % 3 END AS o FROM part)""")
def open_access_ranks(spark, d):
    n, k = F.col("p_size"), F.col("p_partkey")
    score = findings.oa_score(F.when(n % 7 != 0, (n % 11) / 10.0), F.when(n % 5 != 0, k % 3), n, k % 50)
    return table(spark, d, "part").select(k.alias("key"), score.alias("score"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'error' WHEN 'view' THEN 'warning' ELSE 'info' END AS level FROM events""")
def overridden_severity(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("rule"), F.lit("info").alias("level"))
    rules = spark.createDataFrame([("click", "warning"), ("view", "warning"), ("purchase", "info")], "rule string, severity string")
    return findings.effective_severity(e, rules, spark.createDataFrame([("click", "error")], "rule string, override string")).select("event_id", "level")


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS paper, l_suppkey AS other FROM lineitem), r AS (SELECT DISTINCT o_orderkey AS paper, unnest([o_custkey % 50, o_custkey % 7]) AS other, CASE WHEN o_orderkey % 2 = 0 THEN 'forbidden' ELSE 'required' END AS kind FROM orders),
  j AS (SELECT r.*, c.paper IS NOT NULL AS cited FROM r LEFT JOIN c ON c.paper = r.paper AND c.other = r.other)
  SELECT paper, other, kind FROM j WHERE kind = 'forbidden' AND cited UNION ALL SELECT paper, -1, 'required' FROM j WHERE kind = 'required' GROUP BY paper HAVING NOT bool_or(cited)""")
def citation_direction(spark, d):
    cites = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("key"))
    rules = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("paper"), F.explode(F.array(F.col("o_custkey") % 50, F.col("o_custkey") % 7)).alias("other"), F.when(F.col("o_orderkey") % 2 == 0, "forbidden").otherwise("required").alias("kind"))
    return findings.citation_direction(cites, rules.distinct()).withColumn("other", F.coalesce("other", F.lit(-1)))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS section FROM lineitem), h AS (SELECT l_suppkey AS query, l_orderkey AS doc, l_linenumber AS section, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS INT) AS rank FROM lineitem QUALIFY rank <= 10),
  nn AS (SELECT query, h.doc, s.section AS s, min((rank, abs(s.section - h.section))) AS first FROM h JOIN s ON s.doc = h.doc AND abs(s.section - h.section) <= 1 GROUP BY query, h.doc, s.section)
  SELECT query, doc, s AS section, CAST(row_number() OVER (PARTITION BY query ORDER BY first, doc, s) AS INT) AS n FROM nn QUALIFY n <= 15""")
def neighbouring_sections(spark, d):
    li = table(spark, d, "lineitem")
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    hits = li.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select(F.col("l_suppkey").alias("query"), F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("section"), "rank")
    sections = li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("section")).distinct()
    return findings.with_neighbours(hits, sections, 15)


@query("""SELECT name, count(*) FILTER (WHERE v) AS present, count(*) AS total FROM (SELECT unnest(['doi', 'arxiv', 'pmid']) AS name, unnest([p_size % 2 = 0, p_size % 3 = 0, p_size > 30]) AS v FROM part) GROUP BY name""")
def identifier_coverage(spark, d):
    p = table(spark, d, "part").selectExpr("stack(3, 'doi', p_size % 2 = 0, 'arxiv', p_size % 3 = 0, 'pmid', p_size > 30) AS (name, v)")
    return p.groupBy("name").agg(F.count_if("v").alias("present"), F.count("*").alias("total"))


@query("""SELECT c.c_custkey AS child, coalesce(p.c_custkey, -1) AS parent FROM customer c LEFT JOIN customer p ON p.c_custkey = c.c_custkey // 10 AND p.c_custkey % 10 = 0""")
def reference_parents(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    kids = c.select(F.col("c_custkey").alias("child"), F.floor(F.col("c_custkey") / 10).alias("up"))
    return kids.join(c.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("parent")), F.col("up") == F.col("parent"), "left").select("child", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY AS fresh FROM events GROUP BY user_id""")
def fresh_states(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("last")).crossJoin(F.broadcast(now)).select("user_id", "state", (F.col("last") >= F.col("now") - F.expr("INTERVAL 30 DAY")).alias("fresh"))


@query(f"""SELECT l_orderkey AS paper, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {LINE}) AS INT) AS line,
  'We follow [CITE] and Figure fig:' || l_linenumber || '.' || CASE WHEN l_quantity > 25 THEN ' fig:' || l_linenumber ELSE '' END || CASE WHEN l_tax > 0.05 THEN ' [CITE]' ELSE '' END AS text FROM lineitem""")
def cleaned_manuscripts(spark, d):
    return extract.lines(manuscripts(spark, d)).select("paper", "line", latex.clean_latex(F.col("content")).alias("text"))


@query("""SELECT doc_id, md5(string_agg('## Section ' || i || chr(10) || chr(10) || line, chr(10) || chr(10) ORDER BY i)) AS markdown FROM (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def markdown_documents(spark, d):
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    section = F.concat(F.lit("## Section "), F.col("i") + 1, F.lit("\n\n"), F.col("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", section.alias("s")))), lambda x: x["s"])
    return parts.groupBy("doc_id").agg(F.md5(F.array_join(ordered, "\n\n")).alias("markdown"))
