"""The corpus pipeline: documents to packed training sequences.

Every stage works on all that its predecessor kept. Stages but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, langid, line_dedup, near_copies, packing, simhash
from marginalia.llm.text import without
from marginalia.scratch import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the evidence names; those without letters or a clear language go."""
    said = langid.identify(docs)
    return without(docs, said.where(~F.col("accepted")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that later ones repeat; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are no near copy of one of a lesser id.

    Operator 7 links texts whose fingerprints differ in two bits or fewer. Most
    near copies are further apart, so a text also goes where five-word shingles
    link it: a Jaccard similarity of 0.8 or more.
    """
    prints, sets = simhash.near_duplicate_components(docs), near_copies.near_copy_components(docs)
    told = [c.where(F.col("doc_id") != F.col("component_id")).select("doc_id", "text_hash") for c in (prints, sets)]
    return without(docs, told[0].unionByName(told[1]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontaminate.contaminated_documents(docs, bench))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences.

    Executors still hold the heap of the stages before, so encoders remember fewer pieces than operator 8's.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=250_000)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_lines),
    ("near_dedup", near_dedup),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]
#: Neither fused evidence nor fingerprints nor local search are SQL; tests/llm compares stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
