"""Streams of dropped files, injected errors, constraints and acceptance on small cases."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import acceptance, constraints, injection
from marginalia.streaming import ingest


def test_stream_reads_changes_once(spark, tmp_path):
    refs = spark.createDataFrame([("p1", "a", 1, "one title here"), ("p1", "b", 2, "another name"), ("p2", "a", 1, "x")], "paper string, key string, ord int, title string")
    manifest, checkpoint = ingest.Manifest(spark, str(tmp_path / "manifest")), str(tmp_path / "checkpoint")

    def drop(day, paper, kind, name, content):
        (d := tmp_path / "drops" / day / paper / kind).mkdir(parents=True, exist_ok=True)
        (d / name).write_text(content)

    def run():
        query = ingest.ingest_stream(spark, str(tmp_path / "drops"), refs, manifest, checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r["paper"], r["key"], r["name"], r["kind"], r["batch"]) for r in manifest.rows().collect())

    drop("1", "p1", "academic", "a_file.pdf", "v1")
    drop("1", "p1", "web", "another_name.md", "w1")
    drop("1", "p1", "web", "a.md", "loses against the academic file")
    drop("1", "p1", "other", "a.pdf", "not looked at")
    first = [("p1", "a", "a_file.pdf", "academic", 0), ("p1", "b", "another_name.md", "web", 0)]
    assert run() == first and run() == first  # nothing new, nothing read
    drop("2", "p1", "academic", "a_file.pdf", "v1")  # the same content again
    drop("2", "p2", "academic", "A.pdf", "x")
    second = [*first, ("p2", "a", "A.pdf", "academic", 1)]
    assert run() == second
    drop("3", "p1", "academic", "a_file.pdf", "v2")
    assert run() == sorted([*second, ("p1", "a", "a_file.pdf", "academic", 2)])
    latest = {(r["paper"], r["key"]): r["hash"] for r in manifest.latest().collect()}
    batch = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "drops"))
    whole = ingest.outcomes(ingest.dropped(batch), refs, spark.createDataFrame([], ingest.MANIFEST))
    assert {(r["paper"], r["key"]): r["hash"] for r in whole.collect()} == latest


def test_source_states_and_caches(spark):
    now = spark.createDataFrame([(1, "a.tex", "h", ""), (2, "a.PDF", "h", None), (3, "a.md", "x", "b"), (4, "a.tex", "h", None)], "paper int, source_file string, source_hash string, bib_hash string")
    before = spark.createDataFrame([(2, "tex", "h", ""), (3, "markdown", "h", "b"), (4, "tex", "h", "")], "paper int, source_type string, source_hash string, bib_hash string")
    got = {r["paper"]: (r["compatible"], r["reason"], r["changed"]) for r in ingest.source_states(now, before).collect()}
    assert got == {1: (True, "first_run", True), 2: (False, "source_type_changed:tex→pdf", False), 3: (True, "ok", True), 4: (True, "ok", False)}
    rows, cache = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "")], "id int, hash string"), spark.createDataFrame([("a",), ("a",), ("",)], "hash string")
    assert {r["id"]: r["cached"] for r in ingest.split_by_hash(rows, cache).collect()} == {1: True, 2: False, 3: False, 4: False}
    kept = spark.createDataFrame([("m", "1"), ("n", "2"), (None, "1")], "model string, version string")
    assert ingest.purged(kept, model="m").count() == 2 and ingest.purged(kept, version="1").count() == 1 and ingest.purged(kept).count() == 3


def test_injection_is_stable_and_splices_right(spark):
    sentence = "This sentence goes on for more than thirty characters {}. "
    text = "\\begin{abstract}We gain 40\\% and 3 points, 7 runs.\\end{abstract}" + "".join(sentence.format(i) for i in range(6)) + "See Figure \\ref{fig:a} and \\ref{tab:b}. \\bibitem{k} x"
    rows = [(i, text) for i in range(30)] + [(100, sentence.format("x") + "And so on."), (101, None), (102, "nothing"), (103, "\\ref{open")]
    d = spark.createDataFrame(rows, "paper int, text string")
    got = {r["paper"]: (r["text"], r["injections"]) for r in injection.inject_errors(d, 3, numbers=True).collect()}
    again = {r["paper"]: (r["text"], r["injections"]) for r in injection.inject_errors(d.repartition(5), 3, numbers=True).collect()}
    assert got == again and len(got) == len(rows)
    for p in range(30):
        new, made = got[p]
        assert sorted(i["rule_id"] for i in made) == ["cross-section-consistency"] + ["dangling-cite"] * 3 + ["dangling-ref"]
        undone = new
        for i in made:
            if i["rule_id"] == "dangling-cite":
                assert f". \\cite{{{i['context']}}}" in new
                undone = undone.replace(f" \\cite{{{i['context']}}}", "")
            elif i["rule_id"] == "dangling-ref":
                undone = undone.replace(i["context"], "fig:a")
            else:
                old, drifted = i["context"].split(" -> ")
                assert old in ("40", "3") and f"{float(drifted):.1f}" == drifted
                undone = undone.replace(drifted, old, 1)
        assert undone == text
    assert len({got[p][0] for p in range(30)}) > 5
    assert got[100][0].startswith(sentence.format("x") + "As shown in Figure~\\ref{fig:phantom") and [i["rule_id"] for i in got[100][1]] == ["dangling-ref"]
    assert got[101] == (None, []) and got[102] == ("nothing", []) and got[103] == ("\\ref{open", [])


def test_constraints_of_all_forms(spark):
    text = "x\n```\nA > B\nA-1 empirical≈B_2\n# c\nA odd < B integrity (why (not\nWu test-severity < any experimental paper (of ours)\nany experimental paper\nA >\nA >> B\n```\n```\nno > no\n```"
    rows = constraints.constraints(spark.createDataFrame([(1, text), (2, "A > B"), (3, "```\nA < B"), (4, None)], "manifest int, text string")).collect()
    one = [(r["left"], r["left_axis"], r["op"], r["right"], r["right_axis"]) for r in sorted(rows, key=lambda r: (r["manifest"], r["ord"], r["n"])) if r["manifest"] == 1]
    assert one[:2] == [("A", None, ">", "B", None), ("A-1", "empirical_content", "≈", "B_2", None)]
    assert one[2:] == [(left, axis, "<", p, axis) for left, axis in (("Wu", "test_severity"), ("any", "experimental")) for p in constraints.EXPERIMENTAL]
    assert [(r["left"], r["op"], r["right"]) for r in rows if r["manifest"] == 3] == [("A", "<", "B")] and {r["manifest"] for r in rows} == {1, 3}


LONG = "word " * 400


@pytest.mark.parametrize("text,found,title,authors,doi,year,kind,want", [
    ("Document  Resume " + LONG, "T", "T", ["A B"], None, None, "article", (False, "template page", 0.0)),
    ("", None, None, [" "], "", None, "article", (True, "no evidence supplied", 0.0)),
    ("short", "A title", "A title", None, None, None, "article", (False, "body too short", 0.0)),
    (LONG + "10.1/ABC", None, None, None, "10.1/abc", None, "article", (True, "doi match", 1.0)),
    (LONG + "10.1/ abc 2001", "unlike", "A title", None, "10.1/abc", 2001, "article", (True, "doi and more", 1.0)),
    (LONG + "10.1/abc 2001", "unlike", "Quite a name", ["Bo Chan"], "10.1/abc", 2001, "article", (False, "doi only", 0.5)),
    ("short", "A title", "A Title", None, None, None, "book", (True, "strong title", 0.85)),
    (LONG + " de la Crúz, x", "A title", "A Title", ["Juan de la Cruz"], None, None, "article", (True, "strong title and surname", 0.9)),
    (LONG + "Chandler", "A title", "A Title", ["Bo Chan"], None, None, "article", (False, "no positive signal", 1.0)),
    ("x", "abcd", "abcdefgh", [], None, None, "manual", (False, "corporate title too weak", pytest.approx(2 / 3))),
    (LONG + " CHAN", "abcd", "abcdefgh", ["Chan, Bo"], None, None, "article", (True, "title and surname", 0.8)),
    (LONG + " Chan 1999", "abcd", "abcdefghijklm", ["Chan, Bo"], None, 1999, "article", (True, "title, surname and year", 0.65)),
    (LONG + " Chan 19990", "", "abc", ["Chan, Bo"], None, 1999, "article", (False, "no positive signal", 0.0)),
    (LONG + " Chan 1999", "", "abc", ["Chan, Bo"], None, 1999, "article", (True, "surname and year, no title", 0.55)),
])
def test_acceptance_rules(spark, text, found, title, authors, doi, year, kind, want):
    df = spark.createDataFrame([(text, found, title, authors, doi, year, kind)], "text string, found_title string, title string, authors array<string>, doi string, year int, entry_type string")
    r = acceptance.acceptance(df.withColumn("extra", F.lit(1))).first()
    assert (r["accepted"], r["reason"], r["confidence"]) == want and r["extra"] == 1
