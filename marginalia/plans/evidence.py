"""Queries on what speaks for and against references, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import evidence
from marginalia.plans.catalogue import query, table
from marginalia.plans.texts import joined, text_of

_NO_ID = "No identifier in bib entry"


@query(f"""SELECT p_partkey AS key, unnest(list_filter([
    CASE WHEN p_partkey % 6 = 0 THEN 'Wrong identifier in bib entry: ''10.9/' || p_partkey || ''' resolves to ''' || p_name || ''', not the paper found by title search' END,
    CASE WHEN p_partkey % 5 = 0 AND p_partkey % 2 = 0 THEN '{_NO_ID}; DOI available: 10.2/' || p_partkey WHEN p_partkey % 5 = 0 THEN '{_NO_ID} (no DOI, ISBN, PMID, or arXiv ID)' END,
    CASE WHEN p_partkey % 3 = 0 AND p_partkey % 4 > 0 THEN 'Open access PDF available: http://x/' || p_partkey END,
    CASE WHEN p_partkey % 7 = 0 THEN 'RETRACTED: This paper has been retracted' END], lambda x: x IS NOT NULL)) AS issue FROM part""")
def entry_issues(spark, d):
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    refs = table(spark, d, "part").select(
        k.alias("key"), F.when(k % 5 == 0, "").when(k % 5 < 3, text_of("10.1/", k)).alias("doi"), F.when(k % 5 == 3, "978").alias("isbn"), F.when(k % 5 == 4, "2101.00001").alias("arxiv_id"), *(none.alias(c) for c in ("pmid", "pmc_id", "lccn")),
        F.when(k % 4 == 0, "pdf").otherwise("none").alias("local_status"), F.when(k % 2 == 0, text_of("10.2/", k)).alias("api_doi"), F.when(k % 3 == 0, text_of("http://x/", k)).alias("pdf_url"), F.when(k % 7 == 0, True).alias("retracted"),
        F.when(k % 6 == 0, text_of("10.9/", k)).alias("wrong_id"), F.col("p_name").alias("wrong_title"))
    return evidence.entry_issues(refs)


@query("""WITH c AS (SELECT p_partkey AS key, 1 AS ord, CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE 1.0 + CASE WHEN p_partkey % 2 = 0 THEN 0.2 ELSE 0.0 END + CASE WHEN p_partkey % 3 = 0 THEN 0.05 ELSE 0.0 END END AS score FROM part
    UNION ALL SELECT p_partkey, 2, CASE WHEN p_partkey % 7 = 0 THEN 0.0 ELSE 0.7 END FROM part UNION ALL SELECT p_partkey, 3, CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE 1.0 + CASE WHEN p_partkey % 2 = 0 THEN 0.2 ELSE 0.0 END + CASE WHEN p_partkey % 3 = 0 THEN 0.05 ELSE 0.0 END END FROM part)
  SELECT key, ord, score::DOUBLE AS score FROM c WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, ord) = 1""")
def best_open_access(spark, d):
    """Of each part another title, the same one twice (by other authors for a fifth), and a candidate without a title."""
    k = F.col("p_partkey")
    authors = F.when(k % 5 == 0, F.array(F.lit("Xu Yi"))).when(k % 2 == 0, F.array(F.lit("Müller, A."), F.lit("Bo van Dyk"))).otherwise(F.array().cast("array<string>"))
    one = lambda ord_, title, names, year: F.struct(F.lit(ord_).alias("ord"), title.alias("cand_title"), names.alias("cand_authors"), year.alias("cand_year"))
    year = F.when(k % 3 == 0, 2001)
    untitled = F.when(k % 7 == 0, F.array(F.lit("Nobody"))).otherwise(F.array(F.lit("muller")))
    made = F.explode(F.array(one(0, F.lit("0123456789"), authors, year), one(1, F.col("p_name"), authors, year), one(2, F.lit(None).cast("string"), untitled, F.lit(1999)), one(3, F.col("p_name"), authors, year))).alias("c")
    rows = table(spark, d, "part").select(k.alias("key"), F.col("p_name").alias("title"), F.array(F.lit("Ann Muller"), F.lit("Bo Van Dyk")).alias("authors"), F.lit(2001).alias("year"), made)
    return evidence.best_open_access(rows.select("key", "title", "authors", "year", "c.*")).withColumn("score", F.round("score", 6))


@query("""WITH c AS (SELECT l_suppkey AS key, avg(CASE l_linenumber % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END) FILTER (WHERE l_tax <= 0.06) AS claim, count(*) FILTER (WHERE l_linenumber % 3 = 0 AND l_tax <= 0.06) AS bad, count(*) FILTER (WHERE l_linenumber % 3 = 1 AND l_tax <= 0.06) AS part FROM lineitem GROUP BY 1),
  r AS (SELECT s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN 0.3 ELSE 0.9 END * coalesce(claim, 1.0) * greatest((12 - s_suppkey % 4) / 12 - least(0.05 * (s_suppkey % 3), 0.3) - least(0.15 * (s_suppkey % 2), 0.3), 0.0) AS score, coalesce(bad, 0) AS bad, coalesce(part, 0) AS part, s_suppkey AS s FROM supplier LEFT JOIN c ON c.key = s_suppkey)
  SELECT key, round(score, 6)::DOUBLE AS reliability, array_to_string(list_filter([CASE WHEN s % 4 = 0 THEN 'retracted' END, CASE WHEN s % 4 > 0 AND s % 3 = 0 THEN 'not found in APIs' END, CASE WHEN s % 4 > 0 AND s % 5 = 0 THEN 'API metadata mismatch' END, CASE WHEN s % 4 > 0 AND s % 3 > 0 THEN (s % 3) || ' field mismatch(es)' END,
    CASE WHEN bad > 0 THEN bad || ' claim(s) not supported' END, CASE WHEN part > 0 THEN part || ' claim(s) partially supported' END, CASE WHEN s % 4 > 0 THEN (s % 4) || '/12 bibliography entries not found in APIs (' || round(100 * (s % 4) / 12)::INT || '%)' END,
    CASE WHEN s % 2 > 0 THEN '1 retracted entries in bibliography' END, CASE WHEN s % 3 > 0 THEN (s % 3) || ' bibliography metadata mismatches (' || round(100 * (s % 3) / (12 - s % 4))::INT || '% of found)' END], lambda x: x IS NOT NULL), '; ') AS signals FROM r WHERE score < 0.4""")
def reliability_signals(spark, d):
    s = F.col("s_suppkey")
    supplier, n = table(spark, d, "supplier"), F.col("l_linenumber")
    claims = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.when(n % 3 == 0, "NOT_SUPPORTED").when(n % 3 == 1, "PARTIALLY_SUPPORTS").otherwise("SUPPORTS").alias("verdict"), (F.col("l_tax") > 0.06).alias("dismissed"))
    meta = supplier.select(s.alias("key"), F.when(s % 2 == 0, 0.3).otherwise(0.9).alias("meta"), (s % 4 == 0).alias("retracted"), F.when(s % 3 == 0, "T3").otherwise("T1").alias("tier"), F.when(s % 5 == 0, "mismatch").otherwise("verified").alias("api_match"), (s % 3).alias("mismatches"))
    bib = supplier.select(s.alias("key"), F.lit(12).alias("total"), (12 - s % 4).alias("found"), (s % 4).alias("not_found"), (s % 3).alias("mismatches"), (s % 2).alias("retractions"))
    out = evidence.reliability_signals(claims, meta, bib)
    return out.select("key", F.round("reliability", 6).alias("reliability"), F.array_join("signals", "; ").alias("signals"))


@query("""WITH RECURSIVE h AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, (l_partkey % (4 + l_orderkey % 9))::INT AS i, (4 + l_orderkey % 9)::INT AS size FROM lineitem),
  w AS (SELECT q, 0 AS n, []::INT[] AS met, size FROM (SELECT DISTINCT q, size FROM h)
    UNION ALL SELECT w.q, h.n, CASE WHEN len(w.met) >= 4 OR list_contains(w.met, h.i) THEN w.met
      ELSE list_concat(list_append(list_concat(w.met, CASE WHEN h.i > 0 AND NOT list_contains(w.met, h.i - 1) THEN [h.i - 1] ELSE [] END), h.i), CASE WHEN h.i + 1 < h.size AND NOT list_contains(w.met, h.i + 1) THEN [h.i + 1] ELSE [] END) END, w.size
    FROM w JOIN h ON h.q = w.q AND h.n = w.n + 1),
  f AS (SELECT q, met, size FROM w QUALIFY row_number() OVER (PARTITION BY q ORDER BY n DESC) = 1)
  SELECT q AS query, ord, 'T' || ord AS title FROM (SELECT q, unnest(CASE WHEN len(met) >= size * 0.7 THEN range(0, size)::INT[] ELSE met END)::INT AS ord FROM f)""")
def sections_of_hits(spark, d):
    """Each order's items are hits on the sections of a document of 4 to 12; from 70 % on all sections come."""
    size = 4 + F.col("l_orderkey") % 9
    li = table(spark, d, "lineitem")
    hits = li.select(F.col("l_orderkey").alias("query"), F.col("l_orderkey").alias("doc"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("rank"), text_of("T", F.col("l_partkey") % size).alias("title"))
    sections = li.select(F.col("l_orderkey").alias("doc"), F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("ord")).distinct().withColumn("title", text_of("T", F.col("ord")))
    return evidence.sections_of_hits(hits, sections, 4).select("query", F.col("ord").cast("int").alias("ord"), "title")


@query("""WITH o AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'verified' ELSE 'mismatch' END AS m, CASE WHEN o_orderkey % 3 = 0 THEN 'T1' ELSE '' END AS ov, ['p' || o_custkey % 3, 'shared'] AS ps FROM orders WHERE o_orderkey % 5 > 0),
  n AS (SELECT o_orderkey AS key, CASE WHEN o_custkey % 2 = 0 THEN 'not_found' ELSE 'verified' END AS m, ['p' || o_custkey % 4] AS ps FROM orders WHERE o_orderkey % 7 > 0),
  j AS (SELECT coalesce(o.key, n.key) AS key, o.m AS om, n.m AS nm, o.ov, o.ps AS a, n.ps AS b, n.m IS NULL OR coalesce(o.m = 'verified' AND n.m = 'not_found', false) AS stays FROM o FULL JOIN n ON n.key = o.key)
  SELECT key, CASE WHEN stays THEN om ELSE nm END AS api_match, coalesce(nullif(ov, ''), CASE WHEN NOT stays THEN 'new' END, '') AS manual_override,
    array_to_string(CASE WHEN stays THEN list_concat(coalesce(a, []), list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) ELSE list_concat(coalesce(b, []), list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) END, '|') AS source_papers FROM j""")
def kept_metadata(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, d, "orders")
    old = orders.where(k % 5 > 0).select(k.alias("key"), F.when(k % 2 == 0, "verified").otherwise("mismatch").alias("api_match"), F.when(k % 3 == 0, "T1").otherwise("").alias("manual_override"), F.array(text_of("p", c % 3), F.lit("shared")).alias("source_papers"))
    new = orders.where(k % 7 > 0).select(k.alias("key"), F.when(c % 2 == 0, "not_found").otherwise("verified").alias("api_match"), F.lit("new").alias("manual_override"), F.array(text_of("p", c % 4)).alias("source_papers"))
    return evidence.kept_metadata(old, new).withColumns({"source_papers": F.array_join("source_papers", "|"), "manual_override": F.coalesce("manual_override", F.lit(""))})


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN 'missing' WHEN c_custkey % 4 = 1 THEN 'incomplete' WHEN c_nationkey % 2 = 0 THEN 'other_model' ELSE 'ready' END AS state, c_custkey % 3 = 0 AS failed FROM customer""")
def embedding_states(spark, d):
    k = F.col("c_custkey")
    customer = table(spark, d, "customer")
    stored = customer.where(k % 4 > 0).select(k.alias("key"), F.when(k % 4 == 1, 0).otherwise(1).alias("complete"), F.when(F.col("c_nationkey") % 2 == 0, F.lit(None)).otherwise("m").alias("model"))
    said = F.when(F.col("key") % 3 == 0, "Connection REFUSED by host").otherwise("The claim holds")
    return evidence.embedding_states(customer.select(k.alias("key")), stored, "m").withColumn("failed", evidence.infrastructure_error(said))


@query("""SELECT DISTINCT l_orderkey AS paper, 'S' || l_linenumber % 2 AS section, unnest(CASE l_partkey % 3 WHEN 0 THEN ['Figure ??'] WHEN 1 THEN ['( ?? )', '??'] ELSE []::VARCHAR[] END) AS match FROM lineitem""")
def broken_references(spark, d):
    text = F.when(F.col("l_partkey") % 3 == 0, "see Figure ?? here ???").when(F.col("l_partkey") % 3 == 1, "by ( ?? ), ?? and what???").otherwise("fine?")
    return evidence.broken_references(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), text_of("S", F.col("l_linenumber") % 2).alias("title"), text.alias("text")))


@query("""SELECT l_orderkey AS paper, number::INT AS number, 'As [' || l_partkey % 9 || ', ' || l_suppkey % 9 || '; x] and [' || l_linenumber || '] say.' AS context FROM (SELECT DISTINCT l_orderkey, l_partkey % 9 AS l_partkey, l_suppkey % 9 AS l_suppkey, l_linenumber FROM lineitem), LATERAL (SELECT l_linenumber AS number)""")
def bracket_contexts(spark, d):
    """A list with a letter in it is none."""
    line = text_of("As [", F.col("l_partkey") % 9, ", ", F.col("l_suppkey") % 9, "; x] and [", F.col("l_linenumber"), "] say.")
    li = table(spark, d, "lineitem")
    return evidence.bracket_contexts(li.groupBy(F.col("l_orderkey").alias("paper")).agg(joined(li, line, "\n\n").alias("text")))


@query("""WITH e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) SELECT user_id, event_id FROM e WHERE n <= 3""")
def recent_events(spark, d):
    return evidence.recent(table(spark, d, "events").select("user_id", "event_id", "ts"), "ts", 3, F.col("event_id"), by="user_id").select("user_id", "event_id")
