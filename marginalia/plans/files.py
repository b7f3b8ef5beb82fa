"""Queries on files: whether one is the paper it should be, what is new in a drop folder, what changed since the last run."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import acceptance
from marginalia.plans.catalogue import query, spread, table
from marginalia.plans.texts import text_of
from marginalia.sources import captures
from marginalia.streaming import ingest


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS n, CASE WHEN p_partkey % 7 = 0 THEN 16 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 250 ELSE 2000 END + CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 0 END + CASE WHEN p_partkey % 4 = 0 THEN 7 + length(p_partkey::VARCHAR) ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 5 ELSE 0 END AS chars,
    p_size % 11 > 0 AS titled, p_size % 4 > 0 AS authors, CASE WHEN p_size % 11 > 0 AND p_size % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS sim, p_partkey % 3 = 0 AND p_size % 4 > 0 AS named, p_partkey % 4 = 0 AND p_size % 5 < 3 AS doi, p_size % 2 = 0 AND p_size % 7 > 0 AS dated FROM part),
  d AS (SELECT *, CASE WHEN k % 7 = 0 THEN ['0', 'template page', '0'] WHEN NOT titled AND NOT authors AND n % 5 >= 3 AND n % 7 = 0 THEN ['1', 'no evidence supplied', '0'] WHEN n % 6 > 0 AND chars < 1500 THEN ['0', 'body too short', '0']
      WHEN doi AND NOT (authors OR titled OR n % 7 > 0) THEN ['1', 'doi match', '1'] WHEN doi AND (sim = 1 OR named OR (dated AND NOT authors)) THEN ['1', 'doi and more', '1'] WHEN doi THEN ['0', 'doi only', '0.5']
      WHEN sim = 1 AND NOT authors THEN ['1', 'strong title', '0.85'] WHEN sim = 1 AND named THEN ['1', 'strong title and surname', '0.9'] WHEN n % 6 = 0 AND NOT authors THEN ['0', 'corporate title too weak', sim::VARCHAR]
      WHEN n % 3 = 2 AND named AND dated THEN ['1', 'surname and year, no title', '0.55'] ELSE ['0', 'no positive signal', sim::VARCHAR] END AS x FROM p)
  SELECT k AS key, x[1] = '1' AS accepted, x[2] AS reason, x[3]::DOUBLE AS confidence, chars::INT AS body_chars, CASE WHEN named THEN 1 ELSE 0 END AS surnames FROM d""")
def accepted_files(spark, d):
    n, k = F.col("p_size"), F.col("p_partkey")
    text = text_of(F.when(k % 7 == 0, "Document Resume\n").otherwise(""), F.repeat(F.lit("word "), F.when(k % 5 == 0, 50).otherwise(400)), F.when(k % 3 == 0, "Lée, ").otherwise(""), F.when(k % 4 == 0, text_of(" 10.1/", k, " ")).otherwise(""), F.when(n % 2 == 0, " 2001").otherwise(""))
    files = spread(table(spark, d, "part").select("p_partkey", "p_size", "p_name"), parts=3).select(
        k.alias("key"), text.alias("text"), F.when(n % 3 == 0, F.col("p_name")).when(n % 3 == 1, "0123456789").otherwise("").alias("found_title"), F.when(n % 11 > 0, F.col("p_name")).alias("title"), F.when(n % 4 > 0, F.array(F.lit("Lee, Ann"))).otherwise(F.array().cast("array<string>")).alias("authors"),
        F.when(n % 5 < 3, text_of("https://doi.org/10.1/", k)).alias("doi"), F.when(n % 7 > 0, 2001).alias("year"), F.when(n % 6 == 0, "techreport").otherwise("article").alias("entry_type"))
    return acceptance.acceptance(files).select("key", "accepted", "reason", "confidence", "body_chars", "surnames")


@query("""SELECT (p_partkey // 20)::VARCHAR AS paper, 'K' || p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN 'k' || p_partkey || '_x.pdf' ELSE 'K' || p_partkey || '.md' END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'academic' ELSE 'web' END AS kind,
    sha256(CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE 'w' END || p_size) AS hash FROM part WHERE (p_partkey % 3 = 0 OR p_partkey % 2 = 0) AND p_partkey % 4 > 0""")
def read_again(spark, d):
    """Files in both folders; of a fourth of the references the content read before is the same, of another fourth it is other."""
    k = F.col("p_partkey")
    part = table(spark, d, "part").withColumn("paper", F.expr("p_partkey div 20").cast("string"))
    academic = part.where(k % 3 == 0).select(text_of("file:/drops/", F.col("paper"), "/academic/k", k, "_x.pdf").alias("path"), text_of("a", F.col("p_size")).alias("content"))
    web = part.where(k % 2 == 0).select(text_of("file:/drops/", F.col("paper"), "/web/K", k, ".md").alias("path"), text_of("w", F.col("p_size")).alias("content"))
    files = academic.unionByName(web).select("path", F.col("content").cast("binary").alias("content"), F.lit(0).cast("timestamp").alias("modificationTime"))
    refs = part.select("paper", text_of("K", k).alias("key"), k.alias("ord"), F.lit(None).cast("string").alias("title"))
    before = part.where(k % 4 < 2).select("paper", text_of("K", k).alias("key"), F.when(k % 4 == 0, F.sha2(text_of(F.when(k % 3 == 0, "a").otherwise("w"), F.col("p_size")).cast("binary"), 256)).otherwise("other").alias("hash"))
    return ingest.outcomes(ingest.dropped(files), refs, before)


@query("""SELECT o_orderkey AS paper, NOT (o_orderkey % 3 > 0 AND o_custkey % 4 > 0 AND o_custkey % 3 <> o_orderkey % 3 - 1) AS compatible, CASE WHEN o_orderkey % 3 = 0 THEN 'first_run' WHEN o_custkey % 4 > 0 AND o_custkey % 3 <> o_orderkey % 3 - 1 THEN 'source_type_changed:' || ['tex', 'pdf'][o_orderkey % 3] || '→' || ['tex', 'pdf', 'markdown'][o_custkey % 3 + 1] ELSE 'ok' END AS reason,
    o_orderkey % 3 = 0 OR o_custkey % 5 > 0 AS changed FROM orders""")
def source_states(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kinds = F.array(*map(F.lit, ["tex", "pdf", "markdown"]))
    orders = table(spark, d, "orders")
    suffix = F.element_at(F.array(*map(F.lit, ["tex", "PDF", "md"])), (c % 3 + 1).cast("int"))
    now = orders.select(k.alias("paper"), F.concat(F.lit("a."), suffix).alias("source_file"), F.lit("h").alias("source_hash"), F.when(c % 5 > 0, "b").alias("bib_hash"))
    before = orders.where(k % 3 > 0).select(k.alias("paper"), F.when(c % 4 > 0, F.element_at(kinds, (k % 3).cast("int"))).alias("source_type"), F.lit("h").alias("source_hash"), F.lit("").alias("bib_hash"))
    return ingest.source_states(now, before)


@query("""WITH c AS (SELECT sha256('s' || p_size) AS hash FROM part WHERE NOT (p_brand IS NOT DISTINCT FROM 'Brand#12' OR p_size % 3 = 0))
  SELECT p_partkey AS key, sha256('s' || (p_partkey % 60)) IN (SELECT hash FROM c) AS cached FROM part""")
def cached_images(spark, d):
    """A cache without one model and one version, and what of new images it still knows."""
    part = table(spark, d, "part")
    of = lambda c: F.sha2(F.concat(F.lit("s"), c).cast("binary"), 256)
    cache = part.select(of(F.col("p_size")).alias("hash"), F.col("p_brand").alias("model"), (F.col("p_size") % 3).cast("string").alias("version"))
    cache = ingest.purged(ingest.purged(cache, model="Brand#12"), version="0")
    return ingest.split_by_hash(part.select(F.col("p_partkey").alias("key"), of(F.col("p_partkey") % 60).alias("hash")), cache).select("key", "cached")


# ---- captured pages ----------------------------------------------------------------------------------------------


@query("SELECT CASE page_id % 3 WHEN 0 THEN 'qp' WHEN 1 THEN 'b64' ELSE 'plain' END || page_id AS path, url, html FROM pages WHERE page_id % 7 > 0")
def mhtml_pages(spark, d):
    """Pages put into MHTML, quoted-printable, base64 or plain, after a part of another kind; a seventh has no HTML part."""
    k, html = F.col("page_id"), F.col("html")
    quoted = F.regexp_replace(F.replace(F.replace(html, F.lit("="), F.lit("=3D")), F.lit("é"), F.lit("=C3=A9")), r"(.{60}) ", "$1 =\r\n")
    body = F.when(k % 3 == 0, quoted).when(k % 3 == 1, F.regexp_replace(F.base64(html.cast("binary")), r"(.{76})", "$1\r\n")).otherwise(html)
    coding = F.when(k % 3 == 0, "quoted-printable").when(k % 3 == 1, "BASE64").otherwise("8bit")
    text = text_of("From: <x>\r\nSnapshot-Content-Location: ", F.when(k % 2 == 0, F.col("url")).otherwise("http://other"), "\r\nContent-Type: multipart/related;\r\n\ttype=\"text/html\";\r\n\tboundary=\"--Mark.+(1)\"\r\n\r\n----Mark.+(1)\r\nContent-Type: text/css\r\n\r\np {}\r\n----Mark.+(1)\r\n",
                   F.when(k % 7 > 0, text_of("Content-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: ", coding, "\r\n", F.when(k % 2 > 0, text_of("Content-Location: ", F.col("url"), "\r\n")).otherwise(""), "\r\n", body)).otherwise("Content-Type: image/png\r\n\r\nx"), "\r\n----Mark.+(1)--\r\n")
    path = F.concat(F.when(k % 3 == 0, "qp").when(k % 3 == 1, "b64").otherwise("plain"), k)
    return captures.mhtml_pages(table(spark, d, "pages").select(path.alias("path"), text.alias("text")))


_BARE = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _tag in captures.NO_TEXT:
    _BARE = f"regexp_replace({_BARE}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'g')"


@query(rf"""WITH p AS (SELECT page_id, {_BARE} AS c FROM pages),
  q AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(c, '(?is)<article\b[^>]*>(.*?)</article>', 1), ''), nullif(regexp_extract(c, '(?is)<main\b[^>]*>(.*?)</main>', 1), ''), nullif(regexp_extract(c, '(?is)<body\b[^>]*>(.*?)</body>', 1), ''), c), '\s+', ' ', 'g'), '{captures.BLOCK_END}', chr(10), 'g') AS c FROM p),
  r AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(c, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS c FROM q)
  SELECT page_id, trim(regexp_replace(regexp_replace(c, '[ \t]*\n\s*', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ' || chr(10)) AS text FROM r""")
def article_texts(spark, d):
    return table(spark, d, "pages").select("page_id", captures.article_text(F.col("html")).alias("text"))
