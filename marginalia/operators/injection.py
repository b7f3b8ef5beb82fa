"""Errors put into manuscripts on purpose, with what a check has to find.

Places are chosen by the least hash of seed, paper and place, so they don't
depend on how the table is partitioned. All edits of a paper are made on its
original text, from the first to the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import places

# fixed values: where errors go, what they look like, and how many citations a paper gets
SENTENCE = r"[A-Z][^.!?]{30,120}\."
NAMED_REF, ANY_REF, NEXT_SENTENCE = r"(?:Figure|Table|Section)\s*\\ref\{", r"\\ref\{", r"\.\s+[A-Z]"
ABSTRACT = r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}"
MEASURE = r"\d+(?:\.\d+)?(?=\s*(?:\\?%|points?|pp))"
SUFFIXES = ["survey", "analysis", "framework", "novel", "deep"]
CITATIONS, FACTORS = 3, [0.6, 0.7, 1.3, 1.4]


def drawn(seed: int, *parts: Column | str) -> Column:
    """60 bits that depend on seed and parts alone."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _chosen(at: Column, seed: int, kind: str, most: int) -> Column:
    """The places with the least hashes, of an array, in their order."""
    drawn_ = F.transform(at, lambda a: F.struct(drawn(seed, F.col("paper"), kind, a).alias("hash"), a.alias("at")))
    return F.sort_array(F.transform(F.slice(F.sort_array(drawn_), 1, most), lambda x: x["at"]))


def _edit(at: Column, rule_id: str, cut: Column, put: Column, context: Column) -> Column:
    return F.struct(at.cast("int").alias("at"), F.lit(rule_id).alias("rule_id"), cut.cast("int").alias("cut"), put.alias("put"), context.alias("context"))


def _fake_citations(sentences: Column, seed: int) -> Column:
    """Edits that cite keys no bibliography has, after up to three sentences."""
    year = 2020 + drawn(seed, F.col("paper"), "year") % 7
    ends = _chosen(F.transform(sentences, lambda m: m["at"] + F.char_length(m["match"])), seed, "cite", CITATIONS)

    def cited(at: Column, i: Column) -> Column:
        key = F.concat(F.lit("fakename"), year, F.element_at(F.array(*map(F.lit, SUFFIXES)), i + 1))
        return _edit(at, "dangling-cite", F.lit(0), F.concat(F.lit(r" \cite{"), key, F.lit("}")), key)

    return F.transform(ends, cited)


def _broken_references(marks: Column, seed: int) -> Column:
    """One edit, or none: a label that a named reference, else any, refers to is replaced; without references one is put before a sentence."""
    hashed = lambda m: F.struct(m["kind"].alias("kind"), drawn(seed, F.col("paper"), "ref", m["at"]).alias("hash"), m["at"].alias("at"), m["match"].alias("match"))
    label = F.concat(F.lit("fig:phantom"), 10 + drawn(seed, F.col("paper"), "label") % 90)

    def broken(p: Column) -> Column:
        fresh = p["kind"] == 2
        start = F.when(fresh, p["at"] + 2).otherwise(p["at"] + F.char_length(p["match"]))
        close = F.call_function("locate", F.lit("}"), F.col("text"), start + 1)
        edit = _edit(start, "dangling-ref", F.when(fresh, 0).otherwise(close - 1 - start), F.when(fresh, F.concat(F.lit(r"As shown in Figure~\ref{"), label, F.lit("}, "))).otherwise(label), label)
        return F.when(fresh | (close > 0), edit)

    return F.array_compact(F.transform(F.array_compact(F.array(F.array_min(F.transform(marks, hashed)))), broken))


def _drifted_numbers(measures: Column, begin: Column, seed: int) -> Column:
    """One edit, or none: a measured number of the abstract times 0.6, 0.7, 1.3 or 1.4, with one decimal."""
    factor = F.element_at(F.array(*map(F.lit, FACTORS)), (drawn(seed, F.col("paper"), "factor") % len(FACTORS) + 1).cast("int"))
    chosen = _chosen(F.transform(measures, lambda m: m["at"]), seed, "number", 1)

    def drifted(m: Column) -> Column:
        put = F.format_string("%.1f", F.round(m["match"].cast("double") * factor, 1))
        return _edit(m["at"] + begin, "cross-section-consistency", F.char_length(m["match"]), put, F.concat(m["match"], F.lit(" -> "), put))

    return F.transform(F.filter(measures, lambda m: F.array_contains(chosen, m["at"])), drifted)


def inject_errors(docs: DataFrame, seed: int = 0, numbers: bool = False) -> DataFrame:
    """``(paper, text, injections)`` of ``(paper, text)``: edited texts and ``(rule_id, context, at)`` of each error, at its place in the original.

    Citations go only where entries are listed in the manuscript. Papers without
    a place for an error stay as they are, with no injections. Edits don't
    overlap: one inside what another cuts is left out. Papers have one row each;
    null texts stay null. All is found and made in the row that has the text,
    without a shuffle or a join; a paper has five edits at most.
    """
    text, abstract = F.col("text"), F.nullif(F.regexp_extract("text", ABSTRACT, 1), F.lit(""))
    # places of a kind are looked for only where there is none of a better kind
    wanted = {"__said": places.matches(F.when(F.contains(text, F.lit(r"\bibitem")), text), SENTENCE), "__refs": places.matches(text, NAMED_REF, ANY_REF, NEXT_SENTENCE)}
    if numbers:
        wanted["__measured"] = places.matches(abstract, MEASURE)
    rows = docs.withColumns(wanted)
    rows = rows.withColumns({name: F.coalesce(name, F.array().cast("array<struct<kind:int,at:int,match:string>>")) for name in wanted})
    edits = [_fake_citations(F.col("__said"), seed), _broken_references(F.col("__refs"), seed)]
    if numbers:
        edits.append(_drifted_numbers(F.col("__measured"), F.instr("text", r"\begin{abstract}") - 1 + len(r"\begin{abstract}"), seed))
    rows = rows.withColumn("__all", F.sort_array(F.concat(*edits))).drop(*wanted)
    rows = rows.withColumn("edits", F.filter("__all", lambda e, i: ~F.exists(F.slice("__all", F.lit(1), i), lambda p: p["at"] + p["cut"] > e["at"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, e: F.struct((e["at"] + e["cut"]).cast("int").alias("at"), F.concat(s["out"], F.substring("text", s["at"] + 1, e["at"] - s["at"]), e["put"]).alias("out"))
    spliced = F.aggregate("edits", start, step, lambda s: F.concat(s["out"], F.substring("text", s["at"] + 1, F.char_length("text"))))
    said = F.transform("edits", lambda e: F.struct(e["rule_id"].alias("rule_id"), e["context"].alias("context"), e["at"].alias("at")))
    return rows.select(*(c for c in docs.columns if c != "text"), F.coalesce(spliced, "text").alias("text"), said.cast("array<struct<rule_id:string,context:string,at:int>>").alias("injections"))


def injection_report(injected: DataFrame, findings: DataFrame) -> DataFrame:
    """``(rule_id, injected, found, recall)``: errors whose context a finding ``(paper, rule_id, context)`` of their paper and rule has."""
    rows = injected.select("paper", F.explode("injections").alias("i")).select("paper", "i.rule_id", "i.context")
    hits = findings.select("paper", "rule_id", "context").distinct().withColumn("hit", F.lit(1))
    both = rows.join(hits, ["paper", "rule_id", "context"], "left")
    return both.groupBy("rule_id").agg(F.count("*").alias("injected"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("injected"))
