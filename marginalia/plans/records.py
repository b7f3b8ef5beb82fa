"""Registered queries of checks, folds and filters over stored records, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.functions import scalars as S
from marginalia.operators import extract, records, scoring
from marginalia.plans.catalogue import REF_SCORES, claims, query, spread, table

pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


@query("""SELECT p_partkey AS key, 'error' AS level, 'reference-exists' AS rule, 'Not found' AS issue FROM part WHERE p_partkey % 7 <> 0 AND p_size % 5 = 0
  UNION ALL SELECT p_partkey, 'error', 'reference-exists', 'Dead URL: x' FROM part WHERE p_partkey % 7 <> 0 AND p_size % 5 = 1
  UNION ALL SELECT p_partkey, 'warning', 'reference-exists', unnest(['Blocked by site (HTTP 403)', 'Content extraction failed']) FROM part WHERE p_partkey % 7 <> 0 AND p_size % 5 = 2""")
def reference_exists(spark, d):
    n = F.col("p_size") % 5
    issues = F.when(n == 1, F.array(F.lit("Dead URL: x"))).when(n == 2, F.array(F.lit("Blocked by site (HTTP 403)"), F.lit("Content extraction failed"))).otherwise(F.array(F.lit("all is well")))
    return records.reference_exists(table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.when(n == 0, "not_found").otherwise("verified").alias("api_match"), issues.alias("issues"), (F.col("p_partkey") % 7 == 0).alias("skip")))


@query("""WITH r AS (SELECT p_partkey AS key, p_size AS n FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 4 <> 3)
  SELECT key, 'title' AS field, 'error' AS level FROM r WHERE n % 3 = 0 UNION ALL SELECT key, 'authors', 'warning' FROM r WHERE n % 5 = 0 UNION ALL SELECT key, 'year', 'warning' FROM r WHERE key % 5 > 1 UNION ALL SELECT key, 'venue', 'warning' FROM r WHERE n % 7 = 0""")
def reference_accuracy(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    refs = spread(table(spark, d, "part").select("p_partkey", "p_size", "p_name", "p_type"), parts=3).select(
        k.alias("key"), pick(["verified", "mismatch", "verified", "not_found"], k % 4).alias("api_match"), (k % 9 == 0).alias("skip"),
        F.concat(F.lit("{On} "), "p_name").alias("title"), F.when(n % 3 == 0, F.lit("0123456789")).otherwise(F.concat(F.lit("on "), "p_name")).alias("api_title"),
        F.array(F.lit("Ann B. Lee, Bo Chan")).alias("authors"), F.when(n % 5 == 0, F.array(F.lit("Xu Zzyzx"))).otherwise(F.array(F.lit("Lee, Ann"), F.lit("Chan, Bo"))).alias("api_authors"),
        F.lit("2010").alias("year"), (2010 + k % 5).alias("api_year"), F.concat(F.lit("Proceedings of the "), "p_type").alias("venue"), F.when(n % 7 == 0, F.lit("0123456789")).otherwise(F.col("p_type")).alias("api_venue"))
    return records.reference_accuracy(refs)


@query(r"""SELECT DISTINCT l_orderkey AS paper, 'fig:' || l_linenumber AS label FROM lineitem WHERE l_quantity > 25 EXCEPT SELECT l_orderkey, 'fig:' || l_linenumber FROM lineitem WHERE l_tax > 0.04""")
def unreferenced_figures(spark, d):
    li = table(spark, d, "lineitem")
    part = F.concat(F.when(F.col("l_quantity") > 25, F.concat(F.lit("\\begin{figure}\\label{fig:"), "l_linenumber", F.lit("}\\end{figure}"))).otherwise(F.concat(F.lit("\\label{fig:x"), "l_linenumber", F.lit("}"))),
                    F.when(F.col("l_tax") > 0.04, F.concat(F.lit(" see \\ref{fig:"), "l_linenumber", F.lit("}"))).otherwise(""))
    return extract.unreferenced_figures(li.groupBy(F.col("l_orderkey").alias("paper")).agg(F.array_join(F.collect_list(part), "\n").alias("text")))


@query("""SELECT DISTINCT l_orderkey AS paper, 'p' || l_partkey AS key FROM lineitem WHERE l_tax > 0.06 OR l_quantity > 30 OR l_discount > 0.08""")
def cited_entries(spark, d):
    li = table(spark, d, "lineitem").withColumn("key", F.concat(F.lit("p"), "l_partkey"))
    line = F.concat_ws(" ", F.when(F.col("l_tax") > 0.06, F.concat(F.lit("\\nocite{"), "key", F.lit("}"))), F.when(F.col("l_quantity") > 30, F.concat(F.lit("\\citep{"), "key", F.lit("}"))))
    docs = li.groupBy(F.col("l_orderkey").alias("paper")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    aux = li.where("l_discount > 0.08").groupBy(F.col("l_orderkey").alias("paper")).agg(F.concat(F.lit("\\citation{"), F.array_join(F.collect_list("key"), ","), F.lit("}")).alias("text"))
    return extract.keep_cited(li.select(F.col("l_orderkey").alias("paper"), "key").distinct(), docs, aux)


@query("""SELECT p_partkey AS key, 'open' AS kind, 'u' || p_size AS detail FROM part WHERE p_size % 3 = 1 AND p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'other', 'paywall' FROM part WHERE p_size % 3 = 1 AND p_partkey % 2 = 1 AND p_partkey % 5 <> 0""")
def access_split(spark, d):
    k = F.col("p_partkey")
    return records.access_split(table(spark, d, "part").select(k.alias("key"), pick(["T1", "T2", "T3"], F.col("p_size") % 3).alias("tier"), (k % 2 == 0).alias("is_oa"), F.concat(F.lit("u"), "p_size").alias("oa_url"), F.when(k % 5 == 0, "").otherwise("paywall").alias("reason")))


@query("""SELECT event_id AS key FROM events WHERE event_id % 4 <> 3 AND NOT (event_id % 4 = 0 AND user_id % 2 = 0) AND event_type <> 'view' AND NOT (event_type = 'click' AND ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAY)""")
def fetch_candidates(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    refs = e.select(F.col("event_id").alias("key"), pick(["T1", "T2", "T2", "T3"], F.col("event_id") % 4).alias("tier"), F.when(F.col("user_id") % 2 == 0, "a.pdf").otherwise("").alias("local_file"),
                    F.when(F.col("event_type") == "view", "not_found").otherwise("verified").alias("api_match"), F.when(F.col("event_type") == "click", "exhausted").alias("status"), F.col("ts").alias("attempted"))
    return records.needs_fetch(refs, F.lit(now).cast(e.schema["ts"].dataType)).select("key")


@query("""SELECT s_suppkey AS key, greatest(0.0, 1.0 - 0.10 * count(l_orderkey) FILTER (WHERE l_returnflag = 'R') - 0.05 * count(l_orderkey) FILTER (WHERE l_returnflag = 'A')) AS score FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 49 AND s_suppkey % 3 > 0 GROUP BY 1""")
def reference_penalties(spark, d):
    level = F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "warning")
    findings = table(spark, d, "lineitem").where("l_quantity > 49 AND l_suppkey % 3 > 0").select(F.col("l_suppkey").alias("key"), level.alias("level"))
    return records.ref_penalty(findings, table(spark, d, "supplier").select(F.col("s_suppkey").alias("key")))


@query("""SELECT c_custkey AS key, abs(c_acctbal) / 10000 * CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE (c_custkey % 10) / 10.0 END AS score FROM customer""")
def contributed_scores(spark, d):
    k = F.col("c_custkey")
    return records.with_contribution(table(spark, d, "customer").select(k.alias("key"), (F.abs("c_acctbal") / 10000).alias("internal"), F.when(k % 3 != 0, (k % 10) / 10.0).alias("contribution")))


TAXONOMY = """taxonomy AS (SELECT l_orderkey AS paper, avg(CASE WHEN l_linenumber % 3 <> 0 THEN CASE l_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.3 END ELSE 0.0 END) AS empirical_content,
  sum(CASE l_suppkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN CASE WHEN l_tax > 0.04 THEN 0.5 ELSE 0.0 END ELSE 0.0 END) AS new, sum(CASE WHEN l_suppkey % 4 = 2 AND l_tax <= 0.04 THEN 1.0 ELSE 0.0 END) AS old,
  avg(CASE CAST(l_quantity AS INT) % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END) AS test_severity FROM lineitem WHERE l_quantity > 20 GROUP BY 1)"""
PROGRESS = "CASE WHEN new + old = 0 THEN 0.5 ELSE new / (new + old) END"


def _classified(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 20").select(
        F.col("l_orderkey").alias("paper"), F.when(F.col("l_linenumber") % 3 == 0, "tautological").otherwise("falsifiable").alias("testability"), pick(["quantified", "directional", "vague"], F.col("l_partkey") % 3).alias("specificity"),
        pick(["prediction", "synthesis", "explanation", "reproduction"], F.col("l_suppkey") % 4).alias("type"), F.when(F.col("l_tax") > 0.04, "cross_domain").otherwise("within_paper").alias("scope"),
        pick(["severe_test", "weak_test", "no_test", "post_hoc"], F.col("l_quantity").cast("int") % 4).alias("support"))


@query(f"WITH {TAXONOMY} SELECT paper, round(empirical_content + 1e-9, 6) AS empirical_content, round({PROGRESS} + 1e-9, 6) AS progressiveness, round(test_severity + 1e-9, 6) AS test_severity FROM taxonomy")
def taxonomy_axes(spark, d):
    out = records.taxonomy_axes(_classified(spark, d))
    return out.select("paper", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in out.columns[1:]])


@query(f"""WITH {TAXONOMY}, a AS (SELECT o_orderkey AS paper, coalesce(empirical_content, 0.0) AS e, coalesce({PROGRESS}, 0.5) AS p, CASE WHEN o_custkey % 3 = 0 THEN 0.0 ELSE (o_custkey % 10) / 10.0 END AS u, CASE WHEN o_custkey % 4 = 0 THEN 0.5 ELSE (o_custkey % 6) / 6.0 END AS s, coalesce(test_severity, 0.0) AS t
    FROM orders LEFT JOIN (SELECT *, {PROGRESS} AS p0 FROM taxonomy) x ON x.paper = o_orderkey),
  c AS (SELECT paper, (e + p + u + s + t) / 5 * CASE WHEN s < 0.1 AND p > 0.5 THEN 0.5 + 0.5 * (1 - p) ELSE 1 END AS overall FROM a),
  i AS (SELECT o_orderkey AS paper, coalesce(1 - count(*) FILTER (WHERE l_returnflag = 'R') * 1.0 / nullif(count(l_orderkey), 0), 1.0) AS consistency FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 20 GROUP BY 1),
  """ + REF_SCORES + """, q AS (SELECT paper, CASE WHEN sum(weight) > 0 THEN sum(weight * verification * verification) / sum(weight) ELSE 0.0 END AS quality FROM ref_scores GROUP BY paper)
  SELECT paper, round(consistency * coalesce(quality, 1.0) * overall + 1e-9, 6) AS score FROM i LEFT JOIN q USING (paper) JOIN c USING (paper)""")
def overall_scores(spark, d):
    o = table(spark, d, "orders")
    papers, k = o.select(F.col("o_orderkey").alias("paper")), F.col("o_custkey")
    unified = o.where(k % 3 != 0).select(F.col("o_orderkey").alias("paper"), ((k % 10) / 10.0).alias("score"))
    solved = o.where(k % 4 != 0).select(F.col("o_orderkey").alias("paper"), ((k % 6) / 6.0).alias("score"))
    axes = records.contribution_axes(papers, records.taxonomy_axes(_classified(spark, d)), unified, solved)
    contribution = axes.select("paper", scoring.contribution({c: F.col(c) for c in axes.columns[1:]}).alias("overall"))
    found = table(spark, d, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("paper"), F.when(F.col("l_returnflag") == "R", "error").otherwise("warning").alias("level"))
    quality = scoring.referencing_quality(scoring.reference_scores(claims(spark, d)), papers=papers)
    return records.overall_score(scoring.internal_consistency(papers, found), quality, contribution).withColumn("score", F.round(F.col("score") + 1e-9, 6))


_CLAIMS = """c AS (SELECT l_orderkey AS paper, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))::INT AS ord, 'k' || l_partkey % 3 AS key, l_linenumber % 2 AS line, l_tax > 0.02 AS local FROM lineitem)"""


def _claims(spark, d):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    li = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax"), "l_orderkey")
    return li.select(F.col("l_orderkey").alias("paper"), n.alias("ord"), F.concat(F.lit("k"), F.col("l_partkey") % 3).alias("key"), (F.col("l_linenumber") % 2).alias("line"), (F.col("l_tax") > 0.02).alias("local"))


@query(f"""WITH {_CLAIMS}, v AS (SELECT paper, key, line FROM c WHERE local QUALIFY row_number() OVER (PARTITION BY paper ORDER BY ord) <= 2)
  SELECT paper, ord, CASE WHEN (paper, key, line) IN (SELECT (paper, key, line) FROM v) THEN NULL WHEN NOT local THEN 'no_local_source' ELSE 'limit_truncated' END AS reason FROM c""")
def limited_claims(spark, d):
    return records.limited_claims(_claims(spark, d), 2)


@query(f"""WITH {_CLAIMS}, v AS (SELECT DISTINCT paper, key, line FROM c WHERE local AND key = 'k1')
  SELECT paper, ord, CASE WHEN (paper, key, line) IN (SELECT (paper, key, line) FROM v) THEN NULL WHEN NOT local THEN 'no_local_source' ELSE 'key_filter_excluded' END AS reason FROM c""")
def filtered_claims(spark, d):
    return records.limited_claims(_claims(spark, d), 0, "k1")


@query("""WITH u AS (SELECT o_orderkey AS claim, unnest([0, 1, 2]) AS step, unnest(['sentence', 'paragraph', 'section']) AS level, unnest([o_custkey % 5, o_custkey % 3, o_custkey % 4]) AS r FROM orders)
  SELECT claim, CASE r WHEN 0 THEN 'SUPPORTS' ELSE 'NOT_SUPPORTED' END AS verdict, level FROM u QUALIFY row_number() OVER (PARTITION BY claim ORDER BY (r = 0) DESC, CASE WHEN r = 0 THEN step ELSE -step END) = 1""")
def ladder_verdicts(spark, d):
    k = F.col("o_custkey")
    x = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(level).alias("level"), F.when(k % m == 0, "SUPPORTS").otherwise("NOT_SUPPORTED").alias("verdict")) for i, (level, m) in enumerate([("sentence", 5), ("paragraph", 3), ("section", 4)])])).alias("x")
    return records.ladder_verdicts(table(spark, d, "orders").select(F.col("o_orderkey").alias("claim"), x).select("claim", "x.*"))


@query("""WITH v AS (SELECT o_orderkey AS claim, o_custkey % 4 AS v, o_custkey % 3 + 1 AS r, o_custkey % 5 > 0 AS section, o_orderkey % 7 = 0 AS example FROM orders),
  w AS (SELECT claim, CASE WHEN section AND v IN (0, 2) AND NOT example AND r > v THEN r ELSE v END AS v FROM v)
  SELECT claim, CASE WHEN v = 0 AND claim % 2 = 0 THEN 'CANNOT_DETERMINE' ELSE ['NOT_SUPPORTED', 'CANNOT_DETERMINE', 'PARTIALLY_SUPPORTS', 'SUPPORTS'][v + 1] END AS verdict FROM w""")
def retried_verdicts(spark, d):
    names, k = ["NOT_SUPPORTED", "CANNOT_DETERMINE", "PARTIALLY_SUPPORTS", "SUPPORTS"], F.col("o_custkey")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim"), pick(names, k % 4).alias("verdict"), pick(names, k % 3 + 1).alias("retry"), F.when(k % 5 > 0, "section").otherwise("sentence").alias("level"), F.when(F.col("o_orderkey") % 7 == 0, "example").alias("purpose"))
    return records.upgraded(rows).select("claim", records.web_page_verdict(F.when(F.col("claim") % 2 == 0, "web_page").otherwise("pdf"), F.col("verdict")).alias("verdict"))


@query("""SELECT l_partkey AS key, l_linenumber AS line, EXISTS (SELECT 1 FROM lineitem x WHERE x.l_tax > 0.07 AND x.l_partkey = l.l_partkey AND x.l_linenumber = l.l_linenumber) AS dismissed FROM lineitem l""")
def carried_dismissals(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_linenumber").alias("line"), "l_tax")
    return records.with_dismissals(li.drop("l_tax"), li.where("l_tax > 0.07"))


@query("""SELECT DISTINCT sha256(text) AS hash, text AS context FROM conversations WHERE text <> '' AND text NOT IN (SELECT text FROM conversations WHERE conv_id % 3 = 0)""")
def contexts_without_vector(spark, d):
    c = table(spark, d, "conversations")
    vectors = c.where("conv_id % 3 = 0").select(F.sha2("text", 256).alias("hash"), F.lit("m1").alias("model")).unionByName(c.select(F.sha2("text", 256).alias("hash"), F.lit("m2").alias("model")))
    return records.without_vector(c.select(F.col("text").alias("context")), vectors, "m1")


@query("""SELECT event_id, event_type = 'click' AS system FROM events""")
def system_findings(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", "parse-failed").otherwise(F.col("event_type")).alias("rule"))
    return records.split_findings(e).select("event_id", "system")


@query("""SELECT p_partkey AS key FROM part WHERE p_size % 4 = 0 OR p_size % 5 = 0 OR p_size % 3 = p_partkey % 3""")
def valid_cache(spark, d):
    n = F.col("p_size")
    return records.still_valid(table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.when(n % 4 == 0, "").otherwise((n % 3).cast("string")).alias("hash"), F.when(n % 5 != 0, (F.col("p_partkey") % 3).cast("string")).alias("current"))).select("key")


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 AND c_acctbal > 0 THEN 'new' ELSE 'old' END AS result FROM customer WHERE c_custkey % 2 = 0 OR (c_custkey % 3 = 0 AND c_acctbal > 0)""")
def saved_results(spark, d):
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.lit("old").alias("result"))
    return records.saved(old, c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.when(F.col("c_acctbal") > 0, "new").alias("result")), ["key"])


@query("""SELECT l_orderkey AS paper, l_linenumber AS line, 'old' AS run FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_tax > 0.06) UNION ALL SELECT l_orderkey, l_linenumber, 'new' FROM lineitem WHERE l_tax > 0.06""")
def replaced_results(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("line"), "l_tax")
    return records.replaced(li.select("paper", "line", F.lit("old").alias("run")), li.where("l_tax > 0.06").select("paper", "line", F.lit("new").alias("run")), "paper")


@query("""SELECT user_id AS paper, event_id % 3 AS stage, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY ALL""")
def stage_states(spark, d):
    return records.stage_states(table(spark, d, "events").select(F.col("user_id").alias("paper"), (F.col("event_id") % 3).alias("stage"), F.col("event_type").alias("state"), "ts", F.col("event_id").alias("ord")))


@query("""SELECT event_type AS service, count(*) AS calls, count(*) FILTER (WHERE event_id % 9 = 0) AS errors, round(sum(value), 3) AS elapsed FROM events GROUP BY 1""")
def service_totals(spark, d):
    out = records.service_totals(table(spark, d, "events").select(F.col("event_type").alias("service"), (F.col("event_id") % 9 == 0).alias("failed"), F.col("value").alias("elapsed")))
    return out.withColumn("elapsed", F.round("elapsed", 3))


@query("""SELECT field, count(*) AS n, avg(CASE WHEN got = want THEN 1.0 ELSE 0.0 END) AS accuracy FROM (
  SELECT 'kind' AS field, p_size % 3 AS got, p_partkey % 3 AS want FROM part UNION ALL SELECT 'scope', p_size % 4, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 4 END FROM part) WHERE want IS NOT NULL GROUP BY field""")
def field_accuracy(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, d, "part").select((n % 3).cast("long").alias("kind"), (k % 3).cast("long").alias("want_kind"), (n % 4).cast("long").alias("scope"), F.when(k % 5 > 0, k % 4).cast("long").alias("want_scope"))
    return records.level_accuracy(rows, ["kind", "scope"])


@query("""WITH e AS (SELECT l_orderkey AS k, array_agg(DISTINCT l_suppkey) FILTER (WHERE l_quantity > 15) AS e, array_agg(DISTINCT l_suppkey) FILTER (WHERE l_tax > 0.02) AS f FROM lineitem GROUP BY 1),
  m AS (SELECT k, list_sort(list_filter(coalesce(e, []), lambda x: NOT list_contains(coalesce(f, []), x))) AS missed, list_sort(list_filter(coalesce(f, []), lambda x: NOT list_contains(coalesce(e, []), x))) AS unexpected FROM e)
  SELECT k AS "case", array_to_string(missed, ',') AS missed, array_to_string(unexpected, ',') AS unexpected, array_to_string(list_filter(missed, lambda x: x % 2 <> 0), ',') AS regressions FROM m""")
def coverage_sets(spark, d):
    s = F.col("l_suppkey")
    sets = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case")).agg(
        F.collect_set(F.when(F.col("l_quantity") > 15, s)).alias("expected"), F.collect_set(F.when(F.col("l_tax") > 0.02, s)).alias("found"), F.collect_set(F.when(s % 2 == 0, s)).alias("known_gaps"))
    out = records.coverage(sets)
    return out.select("case", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in out.columns[1:]])


@query(r"""SELECT doc_id, md5(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g')) AS folded FROM documents""")
def folded_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.fold(F.col("text"))).alias("folded"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'van ' || c_name ELSE c_mktsegment END AS surname,
  CASE WHEN c_custkey % 3 = 1 THEN 'van ' || c_name WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END || ' Of ' || c_mktsegment AS query FROM customer""")
def surnames_and_queries(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat("c_name", F.lit(", A."))).when(k % 3 == 1, F.concat(F.lit("Bo van "), "c_name")).otherwise(F.concat(F.lit("J. "), "c_mktsegment"))
    surname = S.particle_surname(name)
    return table(spark, d, "customer").select("c_custkey", surname.alias("surname"), S.search_query(F.concat(F.lit("Of: "), "c_mktsegment", F.lit("!")), surname).alias("query"))


@query("""SELECT p_partkey AS key, p_size % 2 = 0 AND p_size % 3 <> 0 AND p_size % 5 = 0 AS web, p_size >= 10 AND p_partkey % 4 > 0 AS formal, CASE WHEN 1480 + p_size * 20 BETWEEN 1500 AND 2100 THEN 1480 + p_size * 20 ELSE -1 END AS year,
  CASE p_partkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'web_page' WHEN 2 THEN 'summary' ELSE 'none' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'site (HTTP 403)' WHEN p_size % 3 = 1 THEN 'server error (HTTP 502)' ELSE 'HTTP 418' END AS reason,
  CASE WHEN p_size % 3 = 0 THEN 'warning' WHEN p_size % 3 = 1 THEN 'error' ELSE 'info' END AS level FROM part""")
def record_predicates(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    url = F.when(n % 3 != 0, "u")
    return table(spark, d, "part").select(
        k.alias("key"), records.is_web_resource(F.when(n % 2 == 0, "misc").otherwise("article"), url, F.when(n % 5 != 0, "10.1/x")).alias("web"), records.is_formal_document(F.lit("T"), k % 4, n).alias("formal"),
        F.coalesce(S.coerce_year((1480 + n * 20).cast("string")), F.lit(-1)).alias("year"), S.local_kind(pick(["a.pdf", "a_web.md", "a.md", "a.txt"], k % 4)).alias("kind"), S.status_reason(pick([403, 502, 418], n % 3)).alias("reason"),
        S.issue_rule(pick(["Year mismatch", "Dead URL: mismatch", "Web content saved"], n % 3))["level"].alias("level"))
