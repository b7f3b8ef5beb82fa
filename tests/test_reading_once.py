"""Texts are made and read once in a job, and places in them equal those of Spark's own patterns."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import places
from marginalia.operators import sections, structure
from marginalia.plans import catalogue, catalogues, evaluation, texts  # noqa: F401  they add to the catalogue


def readings(spark, name):
    """How many steps of a query's plan run Python."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("ArrowEvalPython"), plan


@pytest.mark.parametrize("name", ["injected_errors", "citation_contexts", "footnote_claims"])
def test_a_text_is_read_once(spark, name):
    """An explode's own condition moved below, with all that its array is made of."""
    times, plan = readings(spark, name)
    assert times == 1 and "Filter (size(" not in plan


@pytest.mark.parametrize("name", ["tei_references", "tei_citations", "tei_sections", "tei_figures"])
def test_papers_are_read_once(spark, name):
    """Neither a list of references nor divisions are asked for being empty before they are made."""
    times, plan = readings(spark, name)
    assert "size(" not in "".join(x for x in plan.splitlines() if "Filter" in x and "sections" not in x) and times == {"tei_citations": 1, "tei_sections": 1}.get(name, 0)


def test_matches_are_those_of_spark(spark):
    texts = ["x. A . B.\u0085C.\x1cD.\tE", "\U0001d54f\U0001d54f. Z 12 ٣", "", None, "none"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for first, second in [(r"\.\s+[A-Z]", r"\d+"), (r"never", r"\d+"), (r"never", r"nor")]:
        rows = d.select("id", "text", places.matches(F.col("text"), first, second).alias("m"), *(F.regexp_extract_all("text", F.lit(p), 0).alias(k) for p, k in ((first, "a"), (second, "b")))).collect()
        for r in rows:
            want = [(0, x) for x in r["a"] or []] or [(1, x) for x in r["b"] or []]
            assert (r["m"] is None) == (r["text"] is None) and [(m["kind"], m["match"]) for m in r["m"] or []] == want
            assert all(r["text"].startswith(m["match"], m["at"]) for m in r["m"] or [])


def test_bytes_that_are_no_text(spark):
    d = spark.sql("SELECT cast(x'61ff2e2042' AS string) AS text UNION ALL SELECT 'c. D'")
    assert sorted(m["at"] for r in d.select(places.matches(F.col("text"), r"\.\s+[A-Z]").alias("m")).collect() for m in r["m"]) == [1, 2]


@pytest.mark.parametrize("around, keys, want", [
    (["a \\cite{x, y} b", "\\emph{c}  \\cite{y}~d"], ["x", "y"], ["a [TARGET_CITE] b c [CITE] d", "a [TARGET_CITE] b c [TARGET_CITE] d"]),
    (["a \\emph{b", "c} \\cite{x}"], ["x"], ["a b c [TARGET_CITE]"]),  # a command over two paragraphs
    (["\\cite{a \\cite{b}"], ["a \\cite{b", "b"], ["[TARGET_CITE]", "\\cite a [TARGET_CITE]"]),  # a citation in another
    (["p\\footnote{\\cite{x}} q", "{", "r \\\\ s"], ["x"], ["p q r s"]),
    (["a \\cite{x} {\\cite{y}"], None, ["a [CITE] [CITE]"]),
])
def test_claims_of_paragraphs_and_of_all_together(around, keys, want):
    assert sections.clean_claims(around, keys) == want


def test_blanks_at_ends_need_no_pattern(spark):
    """A pattern was tried at every character of each part of a reference."""
    texts = [" a b ", "\t\n\x0b\f\r", "", None, " a ", "\x1ca ", "a", "\n\U0001d54f \n", "\u0085 a"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", structure.stripped(F.col("t")).alias("s"), F.regexp_replace("t", r"\A\s+|\s+\z", "").alias("want"))
    assert all(r["s"] == r["want"] for r in d.collect())
    assert r"\s+\z" not in readings(spark, "tei_references")[1]
