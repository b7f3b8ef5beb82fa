"""Mixing, clustering and collocations against plain versions and their SQL."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from marginalia.llm import clustering, collocations, mixing, queries
from marginalia.operators.ordering import running
from marginalia.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 0) for i, t, lang, source in rows], SCHEMA)


@pytest.mark.parametrize("name", ["op11_weighted_fair_queueing", "op12_sharded_lloyd", "op13_collocations"])
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_queries_match_sql(spark, name, sf):
    d, con = f"/root/testdata/sf{sf}", duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, d).collect()]
    assert sorted(got) == sorted(want.fetchall())


# ---- 11: mixing


def test_running_sums(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(500)], "k int, v long")
    from pyspark.sql import functions as F

    got = {(r["k"], r["v"]): r["before"] for r in running(Scratch(spark, "t"), rows, [F.col("k"), F.col("v").desc()], {"before": F.col("v")}).collect()}
    total = 0
    for k, v in sorted(got, key=lambda x: (x[0], -x[1])):
        assert got[k, v] == total
        total += v
    assert running(Scratch(spark, "t"), rows.limit(0), [F.col("k")], {"before": F.col("v")}).count() == 0


def plain_targets(sizes, most=3):
    """Shares by weight 1, 2, 3, ...; what is above a bound is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, target = sum(sizes.values()), dict.fromkeys(names, 0.0)
    left, still = float(total), set(names)
    while still and left > 1e-9:
        share = left / sum(weight[s] for s in still)
        for s in still:
            target[s] += share * weight[s]
        left = sum(max(0, target[s] - most * sizes[s]) for s in names)
        for s in names:
            target[s] = min(target[s], most * sizes[s])
        still = {s for s in names if target[s] < most * sizes[s] - 1e-9}
    return target


def test_mix_of_edges(spark):
    rows = [(i, "w " * (i % 7), "en", "big") for i in range(300)] + [(1000 + i, "x y z", "en", None) for i in range(4)]
    rows += [(7, "same row", "en", "copies")] * 40 + [(None, "no id here", "en", "copies"), (7, "same id", "en", "copies"), (2000, None, "en", "empty"), (2001, " \t\n", "en", "empty"), (3000, "long " * 5000, "en", "long")]
    docs = make(spark, rows)
    mix = mixing.schedule(docs)
    got = [r.asDict() for r in mix.collect()]
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want, taken, rowed = plain_targets(sizes), Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["words"]
        rowed[r["doc_id"], r["text_hash"], r["source"], r["repeat"]] += r["words"]
        assert r["words"] <= r["size"]
    assert len(rowed) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    size = {(r["doc_id"], r["text_hash"], r["source"], r["repeat"]): r["size"] for r in got}
    assert all(n <= 3 * size[k] for k, n in rowed.items())
    served = sorted((r for r in got if r["words"]), key=lambda r: r["place"])
    at = 0
    for r, nxt in zip(served, served[1:] + [None]):
        assert r["place"] == at and (nxt is None or r["finish"] <= nxt["finish"])
        at += r["words"]
    again = {(r["doc_id"], r["text_hash"], r["repeat"], r["pass"]): r["place"] for r in mixing.schedule(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["text_hash"], r["repeat"], r["pass"]): r["place"] for r in got}
    texts = mixing.mixed_documents(docs, mix).collect()
    assert [r["place"] for r in texts] == sorted(r["place"] for r in texts) and all(len(r["text"].split()) == r["words"] for r in texts)
    assert mixing.schedule(docs.limit(0)).count() == 0
    assert {r["words"] for r in mixing.schedule(make(spark, [(1, None, "en", "a"), (2, "", "en", None)])).collect()} == {0}


def test_mix_by_given_weights_and_budget(spark):
    docs = make(spark, [(i, "a b c d e", "en", "ab"[i % 2]) for i in range(100)])
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    got = Counter()
    for r in mixing.schedule(docs.withColumnsRenamed({"n_chars": "size"}), weights, budget=200).collect():
        got[r["source"]] += r["words"]
    assert got == {"a": 150, "b": 50}


def test_long_runs_of_alike_rows(spark):
    n = 2 * mixing.RUN + 5
    docs = spark.range(n).selectExpr("1L AS doc_id", "'one two' AS text", "'s' AS source")
    got = mixing.schedule(docs).collect()
    assert len({r["repeat"] for r in got}) == n and sum(r["words"] for r in got) == 2 * n


# ---- 12: clustering


def plain_lloyd(rows, k=40, rounds=5):
    xs = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in xs if i is not None)[:k]
    cs = [v for _, v in first]

    def assign():
        out = []
        for _, v in xs:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cs]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        to = assign()
        for c in range(len(cs)):
            own = [v for (_, v), (a, _) in zip(xs, to) if a == c]
            if own:
                cs[c] = [sum(col) // len(own) for col in zip(*own)]
    return sorted(((i if i is not None else -1), a, d) for (i, _), (a, d) in zip(xs, assign()))


@pytest.mark.parametrize("scale", [1.0, 3e4])
def test_lloyd_equals_plain(spark, scale):
    rng = np.random.default_rng(1)
    good = [(i, (rng.normal(size=64) * scale).tolist()) for i in range(150)]
    good += [(3, good[5][1]), (None, good[9][1]), (500, [0.0] * 64), (501, [0.0] * 64)]
    bad = [(600, None), (601, [1.0] * 63), (602, [1.0] * 65), (603, [None] + [1.0] * 63), (604, [float("nan")] + [1.0] * 63), (605, [float("inf")] * 64), (606, [])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").repartition(3)
    got, _ = clustering.lloyd(df)
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["cluster"], r["distance"]) for r in got.collect()) == plain_lloyd(good)
    rows = clustering.clusters(df).collect()
    by = defaultdict(int)
    for r in rows:
        by[r["cluster"]] += r["distance"]
    assert all(r["cluster_inertia"] == by[r["cluster"]] and r["inertia"] == sum(by.values()) for r in rows)


def test_lloyd_of_few_or_none(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [2.0] * 64)], "vec_id long, embedding array<float>")
    assert sorted((r["vec_id"], r["distance"]) for r in clustering.clusters(df.selectExpr("*", "7 AS cluster")).collect()) == [(1, 0), (2, 0)]
    assert clustering.clusters(df.limit(0)).count() == 0
    small = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(30)], "vec_id long, embedding array<float>")
    assert clustering.lloyd(small, k=4, dim=3, width=2)[0].count() == 30  # a last block of other width


# ---- 13: collocations


def plain_collocations(rows, top, least):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        cand, rows_ = {p: a for p, a in f.items() if len(p) > 1 and a >= least}, []
        for p, a in cand.items():
            cuts = [(2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min(cuts)
            rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("top,ahead", [(2000, 2), (5, 1), (1, 1), (3, 2)])
def test_collocations_equal_plain(spark, top, ahead):
    rng = np.random.default_rng(7)
    words = ["the", "of", "New", "york", "city", "é", "x\x1c", "\x00", "a"] + [f"w{i}" for i in range(6)]
    p = np.array([0.2] * 2 + [0.6 / 13] * 13)
    rows = []
    for i in range(150):
        t = " ".join(rng.choice(words, size=25, p=p))
        t = t.replace("New", "New York City Hall").replace("w1", "w1 w2 w3 w4.").replace("w5", "of the  w5\t")
        rows.append((t, ["en", None, "und", "fr"][i % 4]))
    rows += [(None, "en"), ("", "xx"), (" ,.", "zz")] + [("many alike rows here", "fr")] * 40
    docs = spark.createDataFrame([(i, t, lang, 1, 2) for i, (t, lang) in enumerate(rows)], "doc_id int, text string, lang string, n int, score int").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(docs, top=top, least=8, ahead=ahead, log_bits=8 if top == 3 else 16).collect())
    assert got == plain_collocations(rows, top, 8)


def test_collocations_of_none(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "a b"), (None, None)], "lang string, text string")).count() == 0


def test_texts_in_parts_and_whole(spark, monkeypatch):
    """A long text, and texts counted a few at a time, give the counts of all together."""
    rows = [("en", "ab cd ef. " * 3000), *[("en", "ab cd gh"), ("de", "ab cd")] * 40]
    run = lambda: sorted(map(tuple, collocations.collocations(spark.createDataFrame(rows, "lang string, text string").coalesce(1)).collect()))
    whole = run()
    batch = collocations.pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1].encode() for r in rows]})

    def summed():
        out = Counter()
        for b in collocations.counter(1, {})(iter([batch])):
            for x in b.to_pylist():
                out[x["lang"], x["phrase"]] += x["f"]
        return out

    once = summed()
    monkeypatch.setattr(collocations, "AT_ONCE", 20)
    assert summed() == once and ("en", 2, "ab cd ef", 3000, 3040, 3000, 9120, 993377) not in whole and whole[0][0] == "de"
