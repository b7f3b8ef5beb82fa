"""Markdown manuscripts: citations, cross-references, labels and bibliographies.

A stated subset of Pandoc's Markdown: blocks between blank lines, ``#`` headings,
fenced code, lists and quotes as blocks of text, ``[@key]`` and ``@key``
citations, ``{#id}`` of headings, figures, tables and code, and front matter.
Setext headings, HTML and nested blocks are text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.structure import stripped

# fixed values: what a key begins with that is a cross-reference
PREFIXES = ["fig:", "sec:", "tbl:", "eq:", "lst:"]
FRONT = r"(?s)\A---[ \t]*\n(.*?)\n(?:---|\.\.\.)[ \t]*(?:\n|\z)"
FIGURE = r"(?s)\A\s*!\[.*\]\([^)]*\)\{[^}]*\}\s*\z"
FENCE, HEADING = r"^\s{0,3}(?:```|~~~)", r"^(#{1,6})\s+(.*?)\s*#*\s*$"
KEY = r"(?:\{[^}\s]+\}|[\p{L}\p{N}_](?:[\p{L}\p{N}_]|[:.#$%&+?<>~/-](?=[\p{L}\p{N}_]))*)"
CITE = rf"(?<![\p{{L}}\p{{N}}_.@\\])@({KEY})"
NUMERIC = r"\[\d+(?:[,;\s]+\d+)*\]"


def plain(text: Column) -> Column:
    """Inline markup as its text: no footnotes, attributes and marks of emphasis, links as what they show, code as it stands."""
    c = F.regexp_replace(text, r"\^\[[^\]]*\]|\[\^[^\]]+\]", "")
    c = F.regexp_replace(c, r"!?\[([^\]]*)\]\([^)]*\)(?:\{[^}]*\})?", "$1")
    c = F.regexp_replace(F.regexp_replace(c, r"\s*(?<!@)\{(?:[#.]|\w+=)[^}]*\}", ""), r"`([^`]*)`", "$1")
    c = F.regexp_replace(c, r"(?<![\p{L}\p{N}])(?:\*{1,3}|_{1,3})([^\s*_](?:[^*_]*[^\s*_])?)(?:\*{1,3}|_{1,3})(?![\p{L}\p{N}])", "$1")
    return stripped(F.regexp_replace(c, r"\s+", " "))


def grouped(lines: list[str], marks: str) -> list[dict]:
    """Runs of lines by their marks (fence, heading, blank, text) as ``(n, kind, text, head)``; head is the last heading's line."""
    out, n, opened, was, head = [], 0, False, None, None
    for line, mark in zip(lines, marks):
        kind = "code" if opened or mark == "f" else {"h": "heading", "b": "blank", "t": "text"}[mark]
        begins = not opened if kind == "code" else kind != "text" or was != "text"
        n, opened, was = n + begins, opened != (mark == "f"), kind
        if kind == "heading":
            head = line
        if kind != "blank" and begins:
            out.append({"n": n, "kind": kind, "text": [line], "head": head})
        elif kind != "blank":
            out[-1]["text"].append(line)
    return [b | {"text": "\n".join(b["text"])} for b in out]


def blocks(docs: DataFrame) -> DataFrame:
    """``(paper, n, kind, text, section)`` of ``(paper, text)``: headings, paragraphs and fenced code in their order, under the last heading before them.

    Lines are marked as columns, and grouped where their text is: no shuffle.
    """
    def group(lines: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([None if m is None else grouped(l, m) for l, m in zip(lines, marks)], dtype=object)

    body = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), FRONT, "")
    rows = docs.select("paper", F.split(body, "\n", -1).alias("lines"))
    mark = lambda x: F.when(x.rlike(FENCE), "f").when(x.rlike(HEADING), "h").when(stripped(x) == "", "b").otherwise("t")
    made = F.pandas_udf(group, "array<struct<n:long,kind:string,text:string,head:string>>")("lines", F.array_join(F.transform("lines", mark), ""))
    found = rows.select("paper", F.explode(made).alias("b")).select("paper", "b.*")
    return found.select("paper", "n", "kind", "text", F.coalesce(plain(F.regexp_extract("head", HEADING, 2)), F.lit("")).alias("section"))


def _found_keys() -> Column:
    """A block's keys, in their order."""
    prose = F.regexp_replace(F.regexp_replace("text", r"`[^`]*`", ""), HEADING, "$2")
    return F.transform(F.regexp_extract_all(prose, F.lit(CITE), 1), lambda k: F.regexp_replace(k, r"\A\{|\}\z", ""))


def _refers(key: Column) -> Column:
    return F.greatest(*[key.startswith(p) for p in PREFIXES])


def _keys(docs: DataFrame) -> DataFrame:
    rows = blocks(docs).where("kind <> 'code'").withColumn("context", F.when((F.col("kind") == "heading") | F.col("text").rlike(FIGURE), F.col("section")).otherwise(plain(F.col("text"))))
    return rows.select("paper", "n", F.posexplode(_found_keys()).alias("i", "key"), "context", "section")


def citations(docs: DataFrame) -> DataFrame:
    """``(paper, n, i, key, context, section)`` of each citation: its block's text and the heading above; the heading's text for one in a heading or a figure."""
    return _keys(docs).where(~_refers(F.col("key")))


def crossrefs(docs: DataFrame) -> DataFrame:
    """``(paper, n, i, target, kind, context, section)`` of references to figures, sections, tables, equations and listings."""
    rows = _keys(docs).where(_refers(F.col("key")))
    return rows.select("paper", "n", "i", F.col("key").alias("target"), F.substring_index("key", ":", 1).alias("kind"), "context", "section")


def _found_labels() -> Column:
    """A block's labels."""
    first = F.when(F.col("kind") == "code", F.substring_index("text", "\n", 1)).otherwise(F.regexp_replace("text", r"`[^`]*`", ""))
    ids = F.regexp_extract_all(first, F.lit(r"\{[^}]*?#([\p{L}\p{N}_][\p{L}\p{N}_:.-]*)[^}]*\}"), 1)
    words = F.regexp_replace(F.regexp_replace(F.lower(plain(F.regexp_extract("text", HEADING, 2))), r"[^\p{L}\p{N}_ .-]", ""), r"\s+", "-")
    own = F.regexp_replace(words, r"\A[^\p{L}]+", "")
    return F.when((F.col("kind") == "heading") & (F.size(ids) == 0), F.array(F.when(own == "", "section").otherwise(own))).otherwise(ids)


def labels(docs: DataFrame) -> DataFrame:
    """``(paper, label, figure)``: ids in braces of any block, and of headings without one their own words; figures are paragraphs of one image."""
    made = blocks(docs).select("paper", F.col("text").rlike(FIGURE).alias("figure"), F.explode(_found_labels()).alias("label"))
    return made.groupBy("paper", "label").agg(F.bool_or("figure").alias("figure"))


def reference_problems(docs: DataFrame) -> DataFrame:
    """``(paper, label, problem)``, each once: ``dangling`` that a cross-reference names and no block has, ``unreferenced`` figures ``fig:...`` that none names. Texts are read once for both."""
    named = F.when(F.col("kind") != "code", F.filter(_found_keys(), _refers)).otherwise(F.array().cast("array<string>"))
    uses = F.concat(F.transform(named, lambda x: F.struct(x.alias("label"), F.lit(True).alias("named"), F.lit(False).alias("figure"))),
                    F.transform(_found_labels(), lambda x: F.struct(x.alias("label"), F.lit(False).alias("named"), (F.col("text").rlike(FIGURE) & x.startswith("fig:")).alias("figure"))))
    rows = blocks(docs).select("paper", F.explode(uses).alias("u")).select("paper", "u.*")
    every = rows.groupBy("paper", "label").agg(F.bool_or("named").alias("named"), F.bool_and("named").alias("only"), F.bool_or("figure").alias("figure"))
    return every.select("paper", "label", F.when(F.col("only"), "dangling").when(F.col("figure") & ~F.col("named"), "unreferenced").alias("problem")).where("problem IS NOT NULL")


def dangling_crossrefs(docs: DataFrame) -> DataFrame:
    """``(paper, label)`` that a cross-reference names and no block has."""
    return reference_problems(docs).where("problem = 'dangling'").select("paper", "label")


def unreferenced_figures(docs: DataFrame) -> DataFrame:
    """``(paper, label)`` of figures ``fig:...`` that no cross-reference names."""
    return reference_problems(docs).where("problem = 'unreferenced'").select("paper", "label")


def bibliographies(docs: DataFrame) -> DataFrame:
    """``(paper, ord, path)`` named by ``bibliography`` in a paper's front matter: one value, a list in brackets, or a list of lines."""
    front = F.regexp_extract(F.regexp_replace("text", r"\r\n?", "\n"), FRONT, 1)
    said = F.regexp_extract(front, r"(?m)^bibliography:[ \t]*(.*(?:\n[ \t]*- .*)*)", 1)
    items = F.split(F.regexp_replace(said, r"\A\[|\]\s*\z", ""), r",|\n[ \t]*- ")
    clean = F.filter(F.transform(items, lambda x: F.regexp_replace(stripped(x), r"\A[\"'-]\s*|[\"']\z", "")), lambda x: x != "")
    return docs.select("paper", F.posexplode(clean).alias("ord", "path"))


def citation_styles(docs: DataFrame) -> DataFrame:
    """``(paper, style)``: pandoc if a paper has such citations, else numeric if it has bracketed numbers, else none."""
    cited = citations(docs).select("paper").distinct().withColumn("cited", F.lit(True))
    return docs.join(cited, "paper", "left").select("paper", F.when(F.col("cited"), "pandoc").when(F.coalesce(F.col("text").rlike(NUMERIC), F.lit(False)), "numeric").otherwise("none").alias("style"))
