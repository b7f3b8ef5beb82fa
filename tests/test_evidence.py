"""Evidence on references, and walks and sums that replaced others, on cases with edges."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import evidence, graph, scoring
from marginalia.streaming import timestate


def test_issues_of_an_entry(spark):
    cols = "key string, doi string, isbn string, pmid string, arxiv_id string, pmc_id string, lccn string, local_status string, api_doi string, pdf_url string, retracted boolean, wrong_id string, wrong_title string"
    rows = [("a", None, "", None, None, None, None, "none", "10.1/x", "u", None, None, None), ("b", None, "978", None, None, None, None, None, "10.1/x", "u", True, "10.9/y", None), ("c", "d", None, None, None, None, None, "pdf", None, "u", False, "", "t")]
    got = sorted((r["key"], r["issue"].split(":")[0].split(";")[0]) for r in evidence.entry_issues(spark.createDataFrame(rows, cols)).collect())
    assert got == [("a", "No identifier in bib entry"), ("a", "Open access PDF available"), ("b", "RETRACTED"), ("b", "Wrong identifier in bib entry")]


def test_open_access_choice(spark):
    cols = "key int, title string, authors array<string>, year int, ord int, cand_title string, cand_authors array<string>, cand_year int"
    rows = [(1, "A title", ["Ann Lee"], 2000, 0, "A title", ["Bo Chan"], 2000), (1, "A title", ["Ann Lee"], 2000, 1, None, None, None), (1, "A title", ["Ann Lee"], 2000, 2, "A title", ["LEE, A."], 1999), (1, "A title", ["Ann Lee"], 2000, 3, "A title", ["lee"], None),
            (2, "A title", None, None, 0, "Zzzzzzz", None, None), (3, None, None, None, 5, None, [], None)]
    assert [(r["key"], r["ord"], round(r["score"], 6)) for r in evidence.best_open_access(spark.createDataFrame(rows, cols)).orderBy("key").collect()] == [(1, 2, 1.2), (3, 5, 0.5)]


def plain_sections(hits, titles, top_k):
    met, chosen = set(), []
    for title in hits:
        if title in met:
            continue
        met.add(title)
        if title in titles:
            i = titles.index(title)
            for j in (i - 1, i, i + 1):
                if j == i or 0 <= j < len(titles) and titles[j] not in met:
                    chosen.append(j)
                    met.add(titles[j])
        if len(chosen) >= top_k:
            break
    return sorted(range(len(titles)) if chosen and len(chosen) >= 0.7 * len(titles) else chosen)


def test_sections_of_hits_equal_the_walk(spark):
    rng = random.Random(2)
    docs = {d: [f"t{rng.randrange(12)}" for _ in range(rng.randrange(1, 14))] for d in range(60)}
    hits = {d: [f"t{rng.randrange(14)}" for _ in range(rng.randrange(1, 8))] for d in docs}
    s = spark.createDataFrame([(d, i, t) for d, ts in docs.items() for i, t in enumerate(ts)], "doc int, ord int, title string")
    h = spark.createDataFrame([(d, d, i, t) for d, ts in hits.items() for i, t in enumerate(ts)], "query int, doc int, rank int, title string")
    got = {}
    for r in evidence.sections_of_hits(h, s, 4).collect():
        got.setdefault(r["doc"], []).append(r["ord"])
    assert {d: sorted(o) for d, o in got.items()} == {d: o for d in docs if (o := plain_sections(hits[d], docs[d], 4))}


def test_kept_metadata_and_states(spark):
    cols = "key string, api_match string, manual_override string, source_papers array<string>"
    old = spark.createDataFrame([("a", "verified", "", ["p"]), ("b", "verified", "T1", None), ("c", "mismatch", None, ["q"]), ("d", "x", None, ["r"])], cols)
    new = spark.createDataFrame([("a", "not_found", "n", ["s", "p"]), ("b", "verified", None, ["t"]), ("c", "not_found", None, ["q", "u"]), ("e", "new", None, None)], cols)
    got = {r["key"]: (r["api_match"], r["manual_override"], r["source_papers"]) for r in evidence.kept_metadata(old, new).collect()}
    assert got == {"a": ("verified", None, ["p", "s"]), "b": ("verified", "T1", ["t"]), "c": ("not_found", None, ["q", "u"]), "d": ("x", None, ["r"]), "e": ("new", None, [])}
    text = spark.createDataFrame([("a\n\\begin{figure*}b\\end{figure*}c", 22), ("a\nb", 0)], "t string, at int")
    assert [tuple(r) for r in text.select(evidence.line_at(F.col("t"), F.col("at")), evidence.in_environment(F.col("t"), F.col("at"), "figure*")).collect()] == [(2, True), (1, False)]
    assert [r[0] for r in spark.createDataFrame([("Error CODE: 5",), (None,), ("fine",)], "e string").select(evidence.infrastructure_error(F.col("e"))).collect()] == [True, False, False]


def test_broken_and_bracketed(spark):
    d = spark.createDataFrame([(1, "S", "Fig. ?? and (??) or ?? not ??? Figure ??"), (1, "S", "fig. ??"), (1, "T", None)], "paper int, title string, text string")
    assert sorted(r["match"] for r in evidence.broken_references(d).collect()) == ["(??)", "??", "Fig. ??", "Figure ??", "fig. ??"]
    b = spark.createDataFrame([(1, "A [1, 2; 2] b\n\nA [1] [x, 3]\n\nA [1]"), (2, None)], "paper int, text string")
    assert sorted((r["number"], r["context"]) for r in evidence.bracket_contexts(b).collect()) == [(1, "A [1, 2; 2] b"), (1, "A [1]"), (1, "A [1] [x, 3]"), (2, "A [1, 2; 2] b")]


def test_cut_nodes_equal_removal():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 12)
        links = {k: set() for k in range(n)}
        for _ in range(rng.randrange(0, 2 * n)):
            a, b = rng.randrange(n), rng.randrange(n)
            if a != b:
                links[a].add(b), links[b].add(a)
        clusters = graph._components(set(links), links)
        assert graph._cut_nodes(links) == sum(graph._components(set(links) - {k}, links) > clusters for k in links if links[k])


def test_smoothing_is_a_sum(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), i // 3, i, rng.choice([None, float(rng.randrange(100))])) for i in range(400)] + [("one", 1, 1, 5.0)]
    want = {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        if v is not None:
            n, s = want.get(k, (0, None))
            want[k] = (n + 1, v if s is None else 0.3 * v + 0.7 * s)
    got = timestate.smoothed(spark.createDataFrame(rows, "k string, ts int, id int, v double").repartition(5), "k", "ts", "v", "id").collect()
    assert {r["k"]: r["n"] for r in got} == {k: n for k, (n, _) in want.items()} and all(r["smoothed"] == pytest.approx(want[r["k"]][1]) for r in got)


def test_quartiles_by_place(spark):
    df = spark.createDataFrame([(f"p{i}", float(i % 4), i) for i in range(10)], "name string, score double, ord int").repartition(3)
    got = {r["name"]: r["quartile"] for r in scoring.quartiles(df, F.col("score"), F.col("ord")).collect()}
    order = sorted(range(10), key=lambda i: (-(i % 4), i))
    assert got == {f"p{p}": i * 4 // 10 + 1 for i, p in enumerate(order)}
    assert scoring.quartiles(df.limit(0), F.col("score"), F.col("ord")).count() == 0
