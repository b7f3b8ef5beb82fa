"""Language ID by fusing evidence.

Text: a multinomial over hashed byte trigrams for each language, counted by
grouped aggregation over all documents with the languages they declare. Its
likelihood is discounted, as trigrams overlap and long texts add little. Then
the declared language, the address suffix and the host are weighed by how they
go with what texts say: ``P(declared | language)`` and ``P(suffix | language)``
are smoothed counts, and the prior of a host backs off to its parent domain
and on to all documents. Posteriors are their product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.text import attach, whole
from marginalia.scratch import Scratch

SLOTS = 1 << 14
#: Text evidence counts as that of at most so many trigrams, each as a third of one.
MOST_GRAMS = 300
#: Documents that a level's own counts must outweigh in the hierarchy of priors.
STRENGTH = 20.0


def primary(tag: Column) -> Column:
    """The primary subtag of a language tag, lower-case; null if it isn't one."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(tag), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1)), F.lit(""))


def trigram_slots(raw: bytes) -> np.ndarray:
    """Slots of all byte trigrams of a text with ASCII lower-cased; runs of other than letters become one blank."""
    b = _FOLD[np.frombuffer(raw, np.uint8)]
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])] if len(b) else b
    b = b.astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    return (((b[:-2] * 0x9E3779B1 ^ b[1:-1] * 0x85EBCA77 ^ b[2:] * 0xC2B2AE3D) * np.uint32(0x27D4EB2F)) >> np.uint32(18)).astype(np.int64)


_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _bytes(texts) -> Iterator[bytes]:
    """One after another: a batch's texts aren't held twice."""
    return (t.encode("utf-8", "replace") for t in texts)


def text_counts(rows: DataFrame) -> DataFrame:
    """``(declared, slot, n)`` from rows with ``declared`` and ``text``."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, part in pdf.groupby("declared")["text"]:
                own = total.setdefault(lang, np.zeros(SLOTS, np.int64))
                for raw in _bytes(part):
                    own += np.bincount(trigram_slots(raw), minlength=SLOTS)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            if len(at):
                yield pd.DataFrame({"declared": [lang] * len(at), "slot": at, "n": own[at]})

    return (rows.where("declared IS NOT NULL").select("declared", "text").mapInPandas(count, "declared string, slot long, n long")
            .groupBy("declared", "slot").agg(F.sum("n").alias("n")))


def text_model(counts: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log-likelihoods (slots, languages)."""
    langs = sorted(counts["declared"].unique())
    table = np.full((SLOTS, len(langs)), 0.5)
    for i, lang in enumerate(langs):
        own = counts[counts["declared"] == lang]
        table[own["slot"], i] += own["n"]
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def with_text_evidence(rows: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """Rows without ``text`` but with ``evidence array<double>`` (log-likelihoods, the best at 0) and ``grams``."""
    names = [c for c in rows.columns if c != "text"]
    portion = max(20_000, 3_000_000 // max(1, len(langs)))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums, grams, held, n = [], [], [], 0

            def add(held):
                sizes = np.array([len(h) for h in held])
                out = np.zeros((len(held), len(langs)))
                some = sizes > 0
                if some.any():
                    at = (np.cumsum(sizes) - sizes)[some]
                    out[some] = np.add.reduceat(table[np.concatenate(held)], at, axis=0)
                return out, sizes

            for raw in _bytes(pdf["text"]):
                slots = trigram_slots(raw)
                held.append(slots)
                n += len(slots)
                if n > portion:
                    s, g = add(held)
                    sums.append(s), grams.append(g)
                    held, n = [], 0
            if held:
                s, g = add(held)
                sums.append(s), grams.append(g)
            total, size = np.concatenate(sums), np.concatenate(grams)
            total *= (np.minimum(1.0, MOST_GRAMS / np.maximum(size, 1)) / 3)[:, None]
            total -= total.max(1, keepdims=True)
            lettered = [any(map(str.isalpha, t)) for t in pdf["text"]]
            yield pdf[names].assign(evidence=list(total), grams=size, lettered=lettered)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInPandas(weigh, f"{schema}, evidence array<double>, grams long, lettered boolean")


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    up = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(up, lambda x: x / F.aggregate(up, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``(key, counts array<double>)``: soft counts of languages under each value."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*[F.sum(F.col("said")[i]) for i in range(n)]).alias("counts"))


def _smoothed(own: Column, back: Column) -> Column:
    total = F.aggregate(own, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(own, back, lambda x, p: (x + STRENGTH * p) / (total + STRENGTH))


def identify(rows: DataFrame, threshold: float = 0.6, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang",
             host_col: str | None = "source", suffix_col: str | None = None, markup: DataFrame | None = None) -> DataFrame:
    """``(doc_id, text_hash, language, posterior, declared, grams, accepted)``, one row for each row.

    markup: ``(doc_id, page_lang, page_host, page_suffix)``, at most one row
    for each id, which stands before the row's own columns. It meets the rows
    only after their texts are read.

    Languages are those that rows declare. A row is accepted if its best
    language has a posterior of ``threshold`` and more and its text has any
    letter. Texts under three letters leave it to the other evidence; rows without declared language, suffix or host go
    without that evidence. If no row declares a language, none is named. Ties
    go to the first language by name. Other columns are not carried.
    """
    scratch = Scratch(rows.sparkSession, "langid")
    missing = F.lit(None).cast("string")
    rows = rows.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole(F.col(text_col))).alias("text_hash"), whole(F.col(text_col)).alias("text"),
        (primary(F.col(declared_col)) if declared_col else missing).alias("declared"),
        (F.lower(F.col(host_col)) if host_col else missing).alias("host"), (F.lower(F.col(suffix_col)) if suffix_col else missing).alias("suffix"))
    # languages by SLOTS rows at most, whatever the number of documents
    langs, table = text_model(text_counts(rows).toPandas())
    if not langs:
        return rows.select("doc_id", "text_hash", missing.alias("language"), F.lit(0.0).alias("posterior"), "declared", F.lit(0).cast("long").alias("grams"), F.lit(False).alias("accepted"))
    n = len(langs)
    said = with_text_evidence(rows, langs, table)
    if markup is not None:
        said = scratch.put(said, "texts").join(markup.hint("merge"), "doc_id", "left").withColumns({
            "declared": F.coalesce("page_lang", "declared"), "host": F.coalesce("page_host", "host"), "suffix": F.coalesce("page_suffix", "suffix")})
        said = said.drop("page_lang", "page_host", "page_suffix")
    said = scratch.put(said.withColumn("said", F.when(F.col("grams") > 0, _softmax(F.col("evidence"))))
                       .withColumn("parent", F.nullif(F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1), F.lit(""))), "evidence")
    all_ = said.agg(*[F.sum(F.col("said")[i]) for i in range(n)]).first()
    world = (np.array([x or 0.0 for x in all_]) + 1) / (sum(x or 0.0 for x in all_) + n)
    world_col = F.array(*[F.lit(float(p)) for p in world])
    zero = F.array(*[F.lit(0.0)] * n)

    def likelihood(key: str, most: int = 2000) -> DataFrame:
        """``P(value | language)``: values' soft counts over languages' totals."""
        sums = _sums(said, key, n)
        share = [F.lit(float(p)) for p in world]
        return sums.select(key, F.array(*[(F.col("counts")[i] + STRENGTH * share[i] * 0.01) / F.lit(float(world[i])) for i in range(n)]).alias(f"p_{key}"))

    parents = _sums(said, "parent", n).select("parent", _smoothed(F.col("counts"), world_col).alias("p_parent"))
    hosts = said.where("host IS NOT NULL").groupBy("host", "parent").agg(F.array(*[F.sum(F.col("said")[i]) for i in range(n)]).alias("counts"))
    hosts = hosts.join(parents, "parent", "left").select("host", _smoothed(F.transform("counts", lambda x: F.coalesce(x, F.lit(0.0))), F.coalesce("p_parent", world_col)).alias("p_host"))
    out = attach(said, scratch.put(hosts, "hosts"), "host")
    for key in ("declared", "suffix"):
        out = attach(scratch.put(out, f"with-{key}"), scratch.put(likelihood(key), key), key)
    logs = [F.col("evidence")[i] + F.log(F.coalesce(F.col("p_host"), world_col)[i])
            + F.coalesce(F.log(F.col("p_declared")[i]), F.lit(0.0)) + F.coalesce(F.log(F.col("p_suffix")[i]), F.lit(0.0)) for i in range(n)]
    post = _softmax(F.array(*logs))
    best = F.array_max("post")
    name = F.array(*[F.lit(x) for x in langs])
    return (out.select("doc_id", "text_hash", "declared", "grams", "lettered", post.alias("post"))
            .select("doc_id", "text_hash", F.element_at(name, F.array_position("post", best).cast("int")).alias("language"), best.alias("posterior"), "declared", "grams",
                    ((best >= threshold) & F.col("lettered")).alias("accepted")))


def page_evidence(pages: DataFrame) -> DataFrame:
    """``(doc_id, page_lang, page_host, page_suffix)``: what the first page of a document declares; the document's id ends the path."""
    host = F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))
    found = pages.select(
        F.expr("try_cast(nullif(regexp_extract(url, '/([0-9]+)(?:[.]html)?/?(?:[?#].*)?$', 1), '') AS BIGINT)").alias("doc_id"), "page_id",
        primary(F.regexp_extract("html", r"(?i)<html[^>]*\slang=[\"']?([A-Za-z-]+)", 1)).alias("page_lang"), host.alias("page_host"),
        F.nullif(F.regexp_extract(host, r"\.([A-Za-z]{2,})$", 1), F.lit("")).alias("page_suffix"))
    first = F.min_by(F.struct("page_lang", "page_host", "page_suffix"), "page_id").alias("p")
    return found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(first).select("doc_id", "p.*")


def op1_language_evidence(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    pages = page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return identify(docs, markup=Scratch(spark, "langid").put(pages, "pages")).drop("text_hash")
