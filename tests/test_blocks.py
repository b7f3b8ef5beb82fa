"""Best titles and nearest vectors equal brute force, whatever is repeated."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import arrays, scalars
from marginalia.operators import injection, matching, sections, vectors
from marginalia.plans import catalogue


def test_titles_are_compared_once_for_all_their_rows(spark):
    rng = random.Random(4)
    titles = ["red bolt", "red bolts", "blue bolt", "a: red bolt", "a: pin", "zz", "", None]
    rows = [(rng.choice("xy"), k, rng.choice(titles)) for k in range(150)] + [("z", 200 + k, "same") for k in range(300)] + [(None, 900, "same")]
    ratio = lambda a, b: max(matching.indel_ratio(x, y) for x in (a, a.split(":")[0].strip()) for y in (b, b.split(":")[0].strip()))
    want = {}
    for s, k, t in rows:
        near = [(-ratio(t, u), o) for r, o, u in rows if t and u and s == r and s and o > k and ratio(t, u) >= 0.4]
        if near:
            want[k] = min(near)
    df = spark.createDataFrame(rows, "s string, key int, title string")
    got = {r["key"]: (-r["score"], r["ord"]) for r in matching.best_later_titles(df, ["s"], 0.4).collect()}
    assert {k: (round(a, 9), o) for k, (a, o) in got.items()} == {k: (round(a, 9), o) for k, (a, o) in want.items()} and len(got) == 299 + len([k for k in want if k < 200])


def plain(a, b):
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    return dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5)


@pytest.mark.parametrize("block", [7, 4096])
def test_nearest_vectors_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "ROWS", 5)
    rng = random.Random(6)
    rows = [("s" if i % 3 else "t", i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [("s", 100 + i, rows[1][2]) for i in range(30)]  # copies: ties go to smaller ids
    bad = [("s", 200, [0.0] * 4), ("s", 201, None), ("s", 202, [1.0, None, 0.0, 0.0]), ("s", 203, [1.0]), ("s", 204, [float("nan")] * 4), (None, 205, [1.0] * 4)]
    df = spark.createDataFrame(rows + bad, "label string, item int, iv array<double>")
    want = []
    for s in "st":
        some = [(-plain(a, b), i, j) for l, i, a in rows for m, j, b in rows if l == m == s and i < j and plain(a, b) >= 0.3]
        want += [(s, i, j) for _, i, j in sorted(some)[:12]]
    assert sorted((r["label"], r["first"], r["second"]) for r in vectors.forward_pairs(df, "label", 0.3, 12).collect()) == sorted(want)
    asked = df.where("item % 5 = 0").select("label", F.col("item").alias("query"), F.col("iv").alias("qv"))
    want = [(i, j, n) for l, i, a in rows if i % 5 == 0 for n, (_, j) in enumerate(sorted((-plain(a, b), j) for m, j, b in rows if m == l)[:4], 1)]
    found = vectors.scoped_nearest(asked, df, "label", 4)
    assert sorted((r["query"], r["item"], r["rank"]) for r in found.where("query <> 203").collect()) == sorted(want)


def test_registered_queries_pair_no_rows(spark):
    """Neither scores nor joins all pairs of rows."""
    plan = lambda name: catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan("near_paraphrases") and "zip_with" not in plan("scoped_neighbours")
    assert "p_partkey" not in "".join(x for x in plan("fuzzy_part_matches").splitlines() if "Join" in x and "score" not in x)


def test_inverted_abstracts_stay_with_their_document(spark):
    df = catalogue.QUERIES["inverted_abstracts"](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    made = spark.createDataFrame([(1, ["b", "a", "b", ""]), (2, []), (3, None)], "id int, w array<string>").select("id", scalars.inverted(F.col("w")).alias("index"))
    assert {r["id"]: r["index"] for r in made.collect()} == {1: {"b": [0, 2], "a": [1], "": [3]}, 2: {}, 3: None}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sums_and_ranks_within_arrays(spark):
    d = spark.createDataFrame([(0, [3, 1, 2], [1, 4]), (1, [], [5]), (2, None, None), (3, [7, 7], []), (4, [2], [1, 2, 3])], "id int, a array<int>, b array<int>")
    rows = d.select("id", arrays.running(F.col("a")).alias("s"), arrays.ranks(F.col("a"), F.col("b")).alias("r")).collect()
    assert {r["id"]: (r["s"] or [], r["r"] or []) for r in rows} == {0: ([3, 4, 6], [1, 1, 1]), 1: ([], []), 2: ([], []), 3: ([7, 14], [0, 0]), 4: ([2], [2])}
    again = d.repartition(1).where("id > 2").select("id", arrays.ranks(F.col("a"), F.col("b")).alias("r")).collect()
    assert {r["id"]: r["r"] for r in again} == {3: [0, 0], 4: [2]}


def test_errors_and_contexts_are_made_where_the_text_is(spark):
    d = spark.range(3).select(F.col("id").alias("paper"), F.lit("\\begin{document} \\cite{a}\n\nsee \\ref{b}").alias("text"))
    assert "Exchange" not in _plan(injection.inject_errors(d, 1, numbers=True)) and "Exchange" not in _plan(sections.citation_contexts(d))


def test_matches_beyond_the_first_plane_keep_their_places(spark):
    text = "\U0001d54f\n\U0001d54f \\cite{a}\nb \\cite{c} é\\cite{d}"
    got = [tuple(r) for r in sections.occurrences(spark.createDataFrame([(1, text), (2, None), (3, "none")], "paper int, text string"), sections.CITE).collect()]
    assert got == [(1, text.index(m), m, text[: text.index(m)].count("\n") + 1) for m in ("\\cite{a}", "\\cite{c}", "\\cite{d}")]
