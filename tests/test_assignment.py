"""Assignments equal the sequential rule; names by the full set of variants."""

import random
from itertools import product

import pytest

from marginalia.operators import assignment, matching, records


def in_turn_plain(wishes):
    out, by = set(), {}
    for g, c, i, w in wishes:
        by.setdefault((g, c), []).append((w, i))
    taken = set()
    for g, c in sorted(by):
        left = [(w, i) for w, i in by[g, c] if (g, i) not in taken]
        if left:
            i = min(left)[1]
            taken.add((g, i))
            out.add((g, c, i))
    return out


def test_rounds_equal_turns(spark):
    rng = random.Random(3)
    wishes = [(g, c, i, rng.randrange(6)) for g in range(40) for c in range(8) for i in range(8) if rng.random() < 0.1 + g / 50]
    df = spark.createDataFrame(wishes + [(None, 1, 1, 0), (1, None, 1, 0)], "grp int, chooser int, item int, wish int")
    assert {tuple(r) for r in assignment.in_turn(df).collect()} == in_turn_plain(wishes)
    assert assignment.in_turn(df.limit(0)).count() == 0


def test_rounds_and_folds_are_one_rule(spark, monkeypatch):
    """Small groups are folded in a pass, large ones go in rounds, whose tables are merged; a group of many turns no longer takes a table a turn."""
    rng = random.Random(8)
    wishes = [(g, c, i, rng.randrange(4)) for g in range(9) for c in range(6) for i in range(6) if rng.random() < 0.2 + g / 12]
    df = spark.createDataFrame(wishes + wishes[:5], "grp int, chooser int, item int, wish int")
    monkeypatch.setattr(assignment, "MERGED", 2)
    for small in (0, 12, 10_000):
        assert {tuple(r) for r in assignment.in_turn(df, small).collect()} == in_turn_plain(wishes)
    made = []
    put = assignment.Scratch.put
    monkeypatch.setattr(assignment.Scratch, "put", lambda self, *a, **b: made.append(1) or put(self, *a, **b))
    same = spark.range(40).selectExpr("1 AS grp", "id AS chooser").crossJoin(spark.range(40).selectExpr("id AS item", "id AS wish"))
    assert {(r["chooser"], r["item"]) for r in assignment.in_turn(same).collect()} == {(i, i) for i in range(40)} and len(made) < 5


def test_findings_meet_expectations_in_order(spark):
    e = spark.createDataFrame([(1, "a", 1, "x"), (1, "a", 2, ""), (1, "a", 3, "x"), (1, "a", 4, None), (2, "a", 1, "%_"), (3, "b", 1, "")], "grp int, check string, exp int, context string")
    f = spark.createDataFrame([(1, "a", 1, "xy", None), (1, "a", 2, None, "axb"), (1, "a", 3, "z", "z"), (1, "b", 4, "x", "x"), (2, "a", 1, "q", "100%_"), (4, "a", 9, "", "")], "grp int, check string, finding int, context string, message string")
    got = {(r["grp"], r["exp"]): r["finding"] for r in assignment.matched_findings(e, f).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (1, 3): None, (1, 4): None, (2, 1): 1, (3, 1): None}
    counts = {(r["grp"], r["check"]): (r["tp"], r["fp"], r["fn"]) for r in assignment.detection_counts(e, f).collect()}
    assert counts == {(1, "a"): (2, 1, 2), (1, "b"): (0, 1, 0), (2, "a"): (1, 0, 0), (3, "b"): (0, 0, 1), (4, "a"): (0, 1, 0)}


def test_files_and_references_equal_turns(spark):
    rng = random.Random(5)
    words = ["deep", "networks", "graph", "learning", "models", "of", "theory"]
    refs = [(p, f"key{p}{i}", i, " ".join(rng.choice(words) for _ in range(4)) + rng.choice(["", ": a study of many things"])) for p in range(6) for i in range(8)]
    refs += [(0, "Smith2020", 8, "deep graph"), (0, "SMITH2020", 9, ""), (1, "lone", 3, None)]
    files = []
    for p, _, _, t in refs:
        if t and rng.random() < 0.8:
            name = t.split(":")[0].replace(" ", rng.choice("_-."))
            files.append((p, (name if rng.random() < 0.5 else name.replace("e", "", 1)) + rng.choice([".pdf", ".md", ".txt", ".PDF"])))
    files += [(0, "smith2020_b.pdf"), (0, "smith2020_a.pdf"), (0, "_.pdf"), (0, ".pdf"), (5, "key50.md")]
    got = {(r["paper"], r["key"], r["name"], r["pass"]) for r in assignment.assigned_files(spark.createDataFrame(files, "paper int, name string"), spark.createDataFrame(refs, "paper int, key string, ord int, title string")).collect()}

    def ratio(a, b):
        return max(matching.indel_ratio(x, y) for x, y in product((a, a.split(":")[0].strip()), (b, b.split(":")[0].strip())))

    want = set()
    for p in range(6):
        names = sorted({n for q, n in files if q == p and n.lower().endswith((".pdf", ".md"))})
        keys, titles, used = {}, [(k, t) for q, k, _, t in refs if q == p], set()
        for n in names:
            token = n.split("_")[0].split(".")[0].lower()
            key = {k.lower(): k for k, _ in titles}.get(token)
            if key and key not in keys:
                keys[key] = (n, "key")
                used.add(n)
        for n in names:
            stem = n.rsplit(".", 1)[0] if n.rsplit(".", 1)[0] else n
            read = " ".join("".join(c if c.isalnum() else " " if c in "_-. " else "" for c in stem.lower()).split())
            left = [(ratio(read, t), -i, k) for i, (k, t) in enumerate(titles) if t and k not in keys]
            if n not in used and read and left and max(left)[0] >= 0.8:
                keys[max(left)[2]] = (n, "title")
                used.add(n)
        want |= {(p, k, n, how) for k, (n, how) in keys.items()}
    assert got == want and {how for *_, how in want} == {"key", "title"}


def test_academic_files_come_first(spark):
    refs = spark.createDataFrame([(1, "a", 1, "one title"), (1, "b", 2, "another name")], "paper int, key string, ord int, title string")
    academic, web = (spark.createDataFrame([(1, n) for n in names], "paper int, name string") for names in (["a_x.pdf"], ["a.mhtml", "another_name.mht"]))
    assert sorted((r["key"], r["name"], r["kind"]) for r in assignment.preferred_files(academic, web, refs).collect()) == [("a", "a_x.pdf", "academic"), ("b", "another_name.mht", "web")]


@pytest.mark.parametrize("a,b", [("José García", "Jose Garcia"), ("García, José", "J. Garcia"), ("Garcia", "José García"), ("Lee Ann Marie", "Ann Marie Lee"), ("Smith, John A. B. C. D.", "J D Smith"), ("O'Brien, Pat", "Pat O Brien"), ("Łukasz Straße", "Lukasz Strasse")])
def test_names_that_are_the_same(a, b):
    assert matching.author_overlap([a], [b]) == 1.0


def test_blank_names_and_many_middle_names():
    assert matching.author_overlap(["Ann Lee", "", " ,. "], ["Ann Lee"]) == 1.0 and matching.author_overlap([""], ["Ann Lee"]) == 0.0
    assert matching.name_variants("") == frozenset() and matching.name_variants("A B") == frozenset() and matching.name_variants("Plato") == {"plato"}
    assert matching.author_overlap(["A B"], ["A B"]) == 0.0
    long = "Ana Bel Cid Dor Eva Fay Gus Hal Ivo"
    assert matching.author_overlap([long], ["A. B. C. D. E. F. G. H. Ivo"]) == 1.0 == matching.author_overlap([long], ["Ana Ivo"])
    assert len(matching.name_variants("x " * 40 + "Yy")) < 10_000


def test_retries_limits_and_penalties(spark):
    v = spark.createDataFrame([(1, "NOT_SUPPORTED", "section", None, "SUPPORTS"), (2, "NOT_SUPPORTED", "sentence", None, "SUPPORTS"), (3, "CANNOT_DETERMINE", "section", None, "SUPPORTS"), (4, "PARTIALLY_SUPPORTS", "section", "example", "SUPPORTS"), (5, "PARTIALLY_SUPPORTS", "section", "evidence", "CANNOT_DETERMINE"), (6, "NOT_SUPPORTED", "section", "x", None)], "claim int, verdict string, level string, purpose string, retry string")
    assert {r["claim"]: r["verdict"] for r in records.upgraded(v).collect()} == {1: "SUPPORTS", 2: "NOT_SUPPORTED", 3: "CANNOT_DETERMINE", 4: "PARTIALLY_SUPPORTS", 5: "PARTIALLY_SUPPORTS", 6: "NOT_SUPPORTED"}
    c = spark.createDataFrame([(1, 1, "a", 5, True), (1, 2, "a", 5, True), (1, 3, "b", 6, True), (1, 4, "c", 7, False)], "paper int, ord int, key string, line int, local boolean")
    reasons = lambda *args: [r["reason"] for r in records.limited_claims(c, *args).orderBy("ord").collect()]
    assert reasons(1) == [None, None, "limit_truncated", "no_local_source"] and reasons(0) == reasons(None) == [None, None, None, "no_local_source"]
    assert reasons(None, "b") == ["key_filter_excluded", "key_filter_excluded", None, "no_local_source"]
    found, papers = spark.createDataFrame([("a", "error"), ("a", "warning"), ("z", "error")], "key string, level string"), spark.createDataFrame([("a",), ("b",)], "key string")
    assert {r["key"]: r["score"] for r in records.ref_penalty(found, papers).collect()} == {"a": pytest.approx(0.85), "b": 1.0}
