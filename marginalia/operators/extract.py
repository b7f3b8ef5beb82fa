"""Text to rows: citations, labels, sentences, chunks. Inputs carry ``paper`` and ``text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import latex
from marginalia.operators.arguments import named_arguments

# fixed values: what counts as a citation command, and abbreviations that end no sentence
CITE = r"\\cite(?:unverified|[tp]|yearpar)?\{([^}]+)\}"
ABBREVIATIONS = ["et al.", "e.g.", "i.e.", "cf.", "vs.", "Dr.", "Mr.", "Mrs.", "Prof.", "Fig.", "Eq.", "Ref.", "Sec.", "Vol.", "No.", "U.S.", "U.K.", "N.J."]
MAX_PARAGRAPH, MAX_CHUNK, MIN_SENTENCE = 10_000, 30_000, 30


def lines(docs: DataFrame) -> DataFrame:
    """``(paper, line, content)``, lines from 1, comments cut at an unescaped ``%``, then verbatim text blanked."""
    text = latex.strip_verbatim(latex.strip_comments(F.col("text")))
    return docs.select("paper", F.posexplode(F.split(text, "\n")).alias("line", "content")).select("paper", (F.col("line") + 1).alias("line"), "content")


def _arguments(docs: DataFrame, pattern: str, name: str) -> DataFrame:
    found = lines(docs).select("paper", "line", F.explode(F.regexp_extract_all("content", F.lit(pattern), 1)).alias("arg"))
    return found.select("paper", "line", F.explode(F.split("arg", ",")).alias(name)).select("paper", "line", F.trim(name).alias(name)).where(F.col(name) != "")


def cite_keys(docs: DataFrame) -> DataFrame:
    """``(paper, line, key)`` of every citation."""
    return _arguments(docs, CITE, "key")


def unverified_keys(docs: DataFrame) -> DataFrame:
    return _arguments(docs, r"\\citeunverified\{([^}]+)\}", "key")


def bare_keys(docs: DataFrame) -> DataFrame:
    """Cited, but never as unverified; in one pass."""
    found = lambda group: F.regexp_extract_all("content", F.lit(r"\\cite(unverified|[tp]|yearpar)?\{([^}]+)\}"), group)
    rows = lines(docs).select("paper", F.explode(F.arrays_zip(found(1).alias("kind"), found(2).alias("keys"))).alias("c"))
    rows = rows.select("paper", (F.col("c.kind") == "unverified").alias("unverified"), F.explode(F.split("c.keys", ",")).alias("key")).withColumn("key", F.trim("key")).where("key <> ''")
    return rows.groupBy("paper", "key").agg(F.bool_or("unverified").alias("u")).where("NOT u").drop("u")


def labels(docs: DataFrame) -> DataFrame:
    return _arguments(docs, r"\\label\{([^}]+)\}", "label")


def refs(docs: DataFrame) -> DataFrame:
    return _arguments(docs, r"\\(?:ref|eqref|pageref)\{([^}]+)\}", "label")


# fixed values: commands that refer to labels
REFERENCES = ["ref", "eqref", "pageref"]


def _body(docs: DataFrame) -> DataFrame:
    # in a lambda, so that comments are cut once and not for each use of the text
    return docs.select("paper", F.get(F.transform(F.array(latex.strip_comments(F.col("text"))), latex.document_body), F.lit(0)).alias("text"))


def _names(found: Column, keep) -> Column:
    return F.transform(F.filter(found, keep), lambda a: a["argument"])


def dangling_refs(docs: DataFrame) -> DataFrame:
    """``(paper, label)`` that the body refers to and doesn't define. Arguments are taken whole, as balanced braces hold them. Papers have one row each."""
    found = _body(docs).select("paper", named_arguments(F.col("text"), [*REFERENCES, "label"]).alias("found"))
    return found.select("paper", F.explode(F.array_except(_names(F.col("found"), lambda a: a["command"] != "label"), _names(F.col("found"), lambda a: a["command"] == "label"))).alias("label"))


def unreferenced_figures(docs: DataFrame) -> DataFrame:
    """``(paper, label)``: labels ``fig:...`` inside figures that nothing refers to. Papers have one row each."""
    figures = F.regexp_extract_all("text", F.lit(r"(?s)\\begin\{(?:figure|figure\*|subfigure)\}(.*?)\\end\{(?:figure|figure\*|subfigure)\}"), 1)
    labels_ = F.flatten(F.transform(figures, lambda f: F.regexp_extract_all(f, F.lit(r"\\label\{(fig:[^}]+)\}"), 1)))
    # one row of both: a text may have its lines in another order when it is made again
    found = _body(docs).select("paper", labels_.alias("labels"), named_arguments(F.col("text"), REFERENCES).alias("found"))
    return found.select("paper", F.explode(F.array_except("labels", _names(F.col("found"), lambda a: F.lit(True)))).alias("label"))


def aux_citations(aux: DataFrame) -> DataFrame:
    """``(paper, key)`` of the ``\\citation`` records of compiled manuscripts."""
    found = aux.select("paper", F.explode(F.regexp_extract_all("text", F.lit(r"\\citation\{([^}]+)\}"), 1)).alias("arg"))
    return found.select("paper", F.explode(F.split("arg", ",")).alias("key")).select("paper", F.trim("key").alias("key")).distinct()


def cited(docs: DataFrame, aux: DataFrame | None = None) -> DataFrame:
    """``(paper, key)``, each once: cited, named by ``\\nocite`` (``*`` too), or in the compiled records."""
    text = docs.select("paper", latex.strip_comments(F.col("text")).alias("text"))
    none = text.select("paper", F.explode(F.regexp_extract_all("text", F.lit(r"\\nocite\{([^}]+)\}"), 1)).alias("arg"))
    none = none.select("paper", F.explode(F.split("arg", ",")).alias("key")).select("paper", F.trim("key").alias("key")).where("key <> ''")
    out = cite_keys(docs).select("paper", "key").unionByName(none)
    return (out.unionByName(aux_citations(aux)) if aux is not None else out).distinct()


def keep_cited(entries: DataFrame, docs: DataFrame, aux: DataFrame | None = None) -> DataFrame:
    """Bibliography entries that their manuscript cites."""
    return entries.join(cited(docs, aux), ["paper", "key"], "left_semi")


def bracket_citations(docs: DataFrame) -> DataFrame:
    """``(paper, number)`` of ``[1, 2; 3]``, each once."""
    found = docs.select("paper", F.explode(F.regexp_extract_all("text", F.lit(r"\[(\d+(?:[,;\s]+\d+)*)\]"), 1)).alias("list"))
    return found.select("paper", F.explode(F.split("list", r"[,;\s]+")).alias("number")).select("paper", F.col("number").cast("int").alias("number")).distinct()


def figure_numbers(docs: DataFrame) -> DataFrame:
    """Figure numbers that a text mentions, ranges spelt out."""
    run = docs.select("paper", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)\bfig(?:ure|s|ures)?\.?\s+(\d+(?:(?:\s*[-–,]\s*|\s+and\s+)\d+)*)"), 1)).alias("run"))
    part = run.select("paper", F.explode(F.split("run", r"\s*,\s*|\s+and\s+")).alias("part"))
    ends = part.select("paper", F.transform(F.split("part", r"\s*[-–]\s*"), lambda x: x.cast("int")).alias("e"))
    return ends.select("paper", F.explode(F.sequence(F.element_at("e", 1), F.greatest(F.element_at("e", -1), F.element_at("e", 1)))).alias("number")).distinct()


def sentences(text: Column) -> Column:
    """Sentences end at ``.!?`` before a blank and a capital or command, but not after an abbreviation."""
    for a in ABBREVIATIONS:
        text = F.replace(text, F.lit(a), F.lit(a.replace(".", "·")))
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-Z\\])")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("·"), F.lit(".")))), lambda s: s != "")


def chunks(docs: DataFrame, paragraph: str = "\n\n") -> DataFrame:
    """``(paper, granularity, ord, text)``: each paragraph, and each sentence of over 30 characters, with its neighbours.

    A document with any paragraph of over 10,000 characters has no paragraph
    chunks. Windows of sentences stay within their paragraph.
    """
    paras = docs.select("paper", F.posexplode(F.filter(F.transform(F.split("text", paragraph), lambda p: F.trim(p)), lambda p: p != "")).alias("p", "para"))
    w = Window.partitionBy("paper").orderBy("p").rowsBetween(-1, 1)
    by_para = (
        paras.withColumn("longest", F.max(F.length("para")).over(Window.partitionBy("paper"))).where(F.col("longest") <= MAX_PARAGRAPH)
        .select("paper", F.lit("paragraph").alias("granularity"), F.col("p").alias("ord"), F.left(F.array_join(F.collect_list("para").over(w), paragraph), F.lit(MAX_CHUNK)).alias("text")))
    sents = paras.select("paper", "p", F.posexplode(F.filter(F.split("para", r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.length(F.trim(s)) > MIN_SENTENCE)).alias("s", "sent"))
    w = Window.partitionBy("paper", "p").orderBy("s").rowsBetween(-1, 1)
    by_sent = sents.select("paper", F.lit("sentence").alias("granularity"), (F.col("p") * 100_000 + F.col("s")).alias("ord"),
                           F.left(F.array_join(F.collect_list(F.trim("sent")).over(w), " "), F.lit(MAX_CHUNK)).alias("text"))
    return by_para.unionByName(by_sent)


def paragraphs(docs: DataFrame) -> DataFrame:
    """``(paper, start_line, text)``: runs of lines that aren't blank."""
    rows = docs.select("paper", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    w = Window.partitionBy("paper").orderBy("line")
    rows = rows.withColumn("island", F.sum(F.when(F.trim("content") == "", 1).otherwise(0)).over(w)).where(F.trim("content") != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n")
    return rows.groupBy("paper", "island").agg((F.min("line") + 1).alias("start_line"), joined.alias("text")).drop("island")


def numbered_entries(docs: DataFrame) -> DataFrame:
    """``(paper, number, doi, arxiv_id, pmid, title)`` of numbered bibliography entries, each up to the next; those with neither identifier nor title go."""
    rows = docs.select("paper", F.explode(F.regexp_extract_all("text", F.lit(r"(?ms)^\d+\.\s+.*?(?=^\d+\.\s|\z)"), 0)).alias("entry"))
    rows = rows.withColumn("entry", F.regexp_replace("entry", r"\s+\z", ""))
    first = lambda p: F.nullif(F.regexp_extract("entry", p, 1), F.lit(""))
    title = F.trim(F.regexp_extract("entry", r"^\d+\.\s+(?:[A-Z][^.]*?\.\s+)*(?:\(\d{4}\)\.\s*)?(.+?)(?:\.|$)", 1))
    return rows.select("paper", F.regexp_extract("entry", r"^(\d+)", 1).cast("int").alias("number"), F.regexp_replace(first(r"(?i)(?:doi:\s*|doi\.org/)(10\.\d{4,}/[^\s,;]+)"), r"\.+$", "").alias("doi"),
                       first(r"(?i)(?:arXiv:\s*|arxiv\.org/abs/)(\d{4}\.\d{4,5}(?:v\d+)?)").alias("arxiv_id"), first(r"(?i)(?:PMID:\s*|pubmed/)(\d{6,9})").alias("pmid"),
                       F.when((F.length(title) > 10) & (F.length(title) < 300), title).alias("title")).where("coalesce(doi, arxiv_id, pmid, title) IS NOT NULL")


def cite_key_names(rows: DataFrame, base: str = "base", order: str = "ord", by: str = "paper") -> DataFrame:
    """Keys made unique: the second of a name gets ``b``, the third ``c``; from the 27th on, its number."""
    n = F.row_number().over(Window.partitionBy(by, base).orderBy(order))
    return rows.withColumn("key", F.concat(base, F.when(n == 1, "").when(n <= 26, F.char(96 + n)).otherwise(n.cast("string"))))
