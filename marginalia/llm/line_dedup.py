"""Line dedup over levelled sorted runs of line hashes.

Documents are split into batches by descending id. A batch's line keys are
merge-anti-joined with the runs so far: keys that no run holds are new, and
the batch's largest document holding one becomes its keeper. The batch then
adds its own run, ``(h1, h2, n_docs, n_rows, keeper)``, sorted by hash; once a level
has ``fanout`` runs they are compacted into one run of the next level, adding
counts. The last compaction says which keys are in enough documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.text import BLANKS, ascii_lower, whole
from marginalia.scratch import Scratch

#: A key with over 1/HOT of all line rows is joined by broadcast; there are fewer than HOT such keys, however large the input.
HOT = 2000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """Levels of runs ``(h1, h2, n_docs, n_rows, keeper)``. Keeper is null in runs whose batch met a key that an earlier run holds."""

    def __init__(self, scratch: Scratch, fanout: int = 2):
        self.scratch, self.fanout, self.levels = scratch, fanout, [[]]

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        return self.scratch.put(df.sortWithinPartitions("h1", "h2"), name)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_rows").alias("n_rows"), F.max("keeper").alias("keeper"))

    def add(self, batch: DataFrame) -> None:
        """batch: one row ``(h1, h2, n_docs, n_rows, keeper)`` per key."""
        runs = self.runs()
        if runs:
            held = runs[0].select("h1", "h2")
            for r in runs[1:]:
                held = held.unionByName(r.select("h1", "h2"))
            fresh = batch.join(held.hint("merge"), ["h1", "h2"], "left_anti")
            seen = batch.join(held.hint("merge"), ["h1", "h2"], "left_semi").withColumn("keeper", F.lit(None).cast("long"))
            batch = fresh.unionByName(seen)
        self.levels[0].append(self._write(batch, "run"))
        k = 0
        while len(self.levels[k]) >= self.fanout:
            full, self.levels[k] = self.levels[k], []
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._write(self._merged(full), f"level{k + 1}"))
            self.scratch.drop(*full)
            k += 1

    def compacted(self) -> DataFrame:
        return self._merged(self.runs())


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                  min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``(doc_id, text_hash, drop array<int>)``: the lines, from 0, that each document loses."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    key = line_key(F.col("line"))
    keys = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .withColumn("key", key).where(F.char_length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    keys = scratch.put(keys, "keys")
    n_rows, cuts = keys.agg(F.count("*"), F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()
    cuts = [None, *sorted(set(cuts or [])), None]
    runs = LineRuns(scratch, fanout)
    for low, high in reversed(list(zip(cuts, cuts[1:]))):
        part = keys
        part = part if low is None else part.where(F.col("doc_id") > low)
        part = part if high is None else part.where(F.col("doc_id") <= high)
        runs.add(
            part.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"))
            .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_rows"), F.max("doc_id").alias("keeper")))
    repeated = scratch.put(runs.compacted().where(F.col("n_docs") >= min_docs), "repeated")
    hot = F.col("n_rows") * HOT > n_rows
    lose = keys.join(F.broadcast(repeated.where(hot)), ["h1", "h2"]).unionByName(
        keys.join(F.broadcast(repeated.where(hot).select("h1", "h2")), ["h1", "h2"], "left_anti")
        .join(repeated.where(~hot).hint("merge"), ["h1", "h2"]), allowMissingColumns=True)
    return (
        lose.where(F.col("doc_id") < F.col("keeper"))
        .groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drop")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Documents with ``n_lines`` (before), ``n_dropped`` and ``kept_text`` beside their own columns.

    A line's key is the line stripped of blanks with A-Z lower-cased. Keys of
    ``min_chars`` code points and more in ``min_docs`` documents and more stay
    only in the largest id holding them, there as often as they occur. Null
    and empty texts are one empty line. Rows without an id count for nothing
    and lose nothing. Rows that share an id are one document: each keeps or
    loses its own lines. Columns named like the new ones are replaced. Empty
    tables give none. Decisions carry line numbers, so texts of any length
    are rebuilt in time linear in their lines.
    """
    drop = dropped_lines(docs, id_col, text_col, min_chars, min_docs, batches, fanout).select(
        F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("drop").alias("__drop"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    lines = F.split(F.col("__text"), "\n")
    none = F.array().cast("array<int>")
    out = (
        docs.select(*own, whole(F.col(text_col)).alias("__text"), F.col(id_col).cast("long").alias("__id"))
        .withColumn("__th", F.xxhash64("__text"))
        .join(drop, (F.col("__id") == F.col("__doc")) & (F.col("__th") == F.col("__hash")), "left")
        .withColumn("__drop", F.coalesce("__drop", none)).withColumn("__lines", lines)
    )
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop")),
        lambda i: F.element_at("__lines", i + 1))
    return out.select(
        *own, F.size("__lines").cast("long").alias("n_lines"), F.size("__drop").cast("long").alias("n_dropped"),
        F.when(F.size("__drop") == 0, F.col("__text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id < r.keeper AS lost
  FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
