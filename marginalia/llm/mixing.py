"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, gone through up to
``most`` times. A document's virtual finish time is the number of words that its
source has served with it, over the source's target. Documents of all sources
are range-sorted by finish time and served until the budget is used up, which
is at time 1: the sum of targets is the budget. A document in service then
is cut, so that no source misses its target by a long document.

Targets share the budget by weight and stop at ``most`` times what a source
holds; the excess is shared again among the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.text import attach, whole
from marginalia.operators.ordering import running
from marginalia.scratch import Scratch

#: Alike rows of one group that are laid out by one task.
RUN = 1000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(scratch: Scratch, sources: DataFrame, budget: int | None = None, most: int = 3) -> DataFrame:
    """sources ``(source, source_size, weight, ...)`` with ``target``.

    A source's target is its weight's share of the budget (all sizes, if not
    given) or ``most`` times its size, whichever is less, where what such
    sources leave over is shared among the others by weight. Each round is one
    sum over the sources; a source that has met its bound keeps it, so rounds
    end. Without words, or with all at their bounds, targets are these bounds.
    """
    size, weight = F.col("source_size"), F.col("weight").cast("double")
    total = int(sources.agg(F.sum(size)).first()[0] or 0) if budget is None else budget
    level, held = 0.0, -1
    while True:
        met = (size * most <= weight * level) if held >= 0 else F.lit(False)
        full, n, rest = sources.agg(F.sum(F.when(met, size * most)), F.count(F.when(met, 1)), F.sum(F.when(~met, weight))).first()
        if n == held:
            break
        held = n
        if not rest:
            level = float("inf")
            break
        level = (total - int(full or 0)) / float(rest)
    bound = (size * most).cast("double")
    return sources.withColumn("target", F.least(bound, weight * level) if level < float("inf") else bound)


def schedule(docs: DataFrame, weights: DataFrame | None = None, budget: int | None = None, most: int = 3, seed: int = 11,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix: one row for each document and each time that it is served.

    ``doc_id, text_hash, source, repeat, size, source_size, target, pass, words,
    finish, place``: words of this serving that the mix takes, its virtual finish
    time, and the number of words before it in the mix. A document that isn't
    served has one row of 0 words without a place.

    weights is ``(source, weight)``; without it sources in the order of their
    code points, null last, weigh 1, 2, 3, 1, 2, 3 and so on. Null is a source
    like any other; one without a weight has none of the mix. Null texts and
    texts of blanks have size 0. Ids may be null or repeated: rows alike in id,
    text and source are told apart by ``repeat`` (from 0) and are queued one
    after another, others of an id by their text. The order depends on ids and
    texts alone, so reruns agree. Other columns of docs aren't read; an empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    text = whole(F.col(text_col))
    runs = scratch.put(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text).alias("size"), F.xxhash64(text).alias("text_hash"))
        .groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("n"))
        .withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
        .withColumn("shuffled", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")), "runs")
    sources = scratch.put(runs.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "sources")
    sources = running(scratch, sources, [F.col("source").asc_nulls_last()], {"source_no": F.lit(1), "source_start": F.col("source_size")}, "sources")
    if weights is None:
        sources = sources.withColumn("weight", 1 + F.col("source_no") % 3)
    else:
        given = weights.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("key"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(given.groupBy("key").agg(F.max("weight").alias("weight")), "key", "left").na.fill({"weight": 0.0})
    sources = scratch.put(sources, "weighed")
    sources = scratch.put(source_targets(scratch, sources, budget, most), "targets")

    queued = attach(runs, sources.select("key", "source_no", "source_start", "source_size", "target"), "key")
    order = [F.col(c) for c in ("source_no", "shuffled", "doc_id", "text_hash", "size")]
    queued = scratch.put(running(scratch, queued, order, {"before": F.col("size") * F.col("n")}, "queues"), "queued")
    last = F.col("n") - 1
    few = queued.where(f"n <= {RUN}").withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    many = (
        queued.where(f"n > {RUN}").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / RUN))))
        .repartition("doc_id", "text_hash", "__part")
        .withColumn("repeat", F.explode(F.sequence(F.col("__part") * RUN, F.least(last, F.col("__part") * RUN + RUN - 1)))).drop("__part"))
    quota = F.floor("target")
    own = F.col("before") - F.col("source_start") + F.col("repeat") * F.col("size")
    passes = F.sequence(F.lit(0), F.lit(most - 1))
    served = scratch.put(
        few.unionByName(many).withColumn("__own", own)
        .withColumn("pass", F.explode(F.filter(passes, lambda p: (p == 0) | (F.col("__own") + p * F.col("source_size") < quota))))
        .withColumn("start", F.col("__own") + F.col("pass") * F.col("source_size"))
        .withColumn("words", F.greatest(F.lit(0), F.least("size", quota - F.col("start"))))
        .select("doc_id", "text_hash", "source", "source_no", "repeat", "size", "source_size", "target", "pass", "start", "words",
                F.when(F.col("words") > 0, (F.col("start") + F.col("size")) / F.col("target")).alias("finish")), "served")
    out = running(scratch, served.where("words > 0"), [F.col(c) for c in ("finish", "source_no", "start")], {"place": F.col("words")}, "mix")
    if budget is not None:  # the words that fit; without a budget, targets add up to all sizes
        out = out.withColumn("words", F.greatest(F.lit(0), F.least("words", F.lit(budget) - F.col("place"))))
    none = served.where("words = 0").withColumn("place", F.lit(None).cast("long"))
    return out.unionByName(none).drop("start", "source_no")


def mixed_documents(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(place, doc_id, source, pass, words, text)`` in the order of the mix; texts cut by the mix end after their last word taken."""
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), whole(F.col(text_col)).alias("text")).withColumn("__hash", F.xxhash64("text")).dropDuplicates(["__id", "__hash"])
    taken = mix.where("words > 0").join(texts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), "")
    return taken.select("place", "doc_id", "source", "pass", "words", F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("text")).alias("text")).orderBy("place")


def op11_weighted_fair_queueing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return schedule(docs).groupBy("doc_id", "text_hash", "source", "repeat").agg(
        F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum("words").alias("taken"), F.coalesce(F.min("place"), F.lit(-1)).alias("place")).select("doc_id", "size", "source_size", "target", "taken", "place")


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('11:' || doc_id), 1, 15) AS BIGINT) AS shuffled
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source),
fill(round, level) AS (
  SELECT 0, sum(source_size)::DOUBLE / sum(weight)::DOUBLE FROM s
  UNION ALL
  SELECT round + 1,
         (SELECT sum(source_size) - coalesce(sum(3 * source_size) FILTER (WHERE 3 * source_size <= weight::DOUBLE * level), 0) FROM s)::DOUBLE
         / (SELECT sum(weight) FILTER (WHERE NOT 3 * source_size <= weight::DOUBLE * level) FROM s)::DOUBLE
  FROM fill WHERE round < (SELECT count(*) FROM s)),
t AS (
  SELECT s.*, least((3 * source_size)::DOUBLE, weight::DOUBLE * (SELECT max(level) FROM fill)) AS target FROM s),
q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.no, p.pass,
         p.pass * t.source_size + coalesce(sum(d.size) OVER (PARTITION BY t.no, p.pass ORDER BY d.shuffled, d.doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN (SELECT unnest([0, 1, 2]) AS pass) p),
w AS (
  SELECT *, greatest(0, least(size, floor(target)::BIGINT - start))::BIGINT AS words, (start + size)::DOUBLE / target AS finish FROM q),
m AS (
  SELECT *, CASE WHEN words > 0 THEN coalesce(sum(words) OVER (ORDER BY words = 0, finish, no, start
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT END AS place
  FROM w)
SELECT doc_id, any_value(size)::BIGINT AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       sum(words)::BIGINT AS taken, coalesce(min(place), -1) AS place
FROM m GROUP BY doc_id
"""
