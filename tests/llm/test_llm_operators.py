"""The training-text operators against plain versions, on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm import ann, decontaminate, encoding, langid, line_dedup, lm, near_copies, packing, quality, secrets, simhash, simple8b

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in texts], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ---- 1: language ID


def test_language_evidence(spark):
    said = by_id(langid.identify(documents(spark)))
    lang = {r["doc_id"]: r["lang"] for r in documents(spark).collect()}
    assert sum(said[k]["language"] == v for k, v in lang.items()) >= 0.97 * len(lang)
    assert all(0 <= r["posterior"] <= 1 + 1e-9 for r in said.values())


def test_language_edges(spark):
    rows = make(spark, [(1, "the cat and the dog " * 20), (2, None), (3, ""), (4, "123 !!"), (1, "the cat and the dog " * 20), (None, "the end of the day")])
    out = langid.identify(rows.withColumn("evidence", F.lit(1)))
    assert out.count() == 6
    accepted = {r["doc_id"]: r["accepted"] for r in out.collect()}
    assert accepted == {1: True, 2: False, 3: False, 4: False, None: True}
    assert langid.identify(rows.limit(0)).count() == 0
    assert {r["language"] for r in langid.identify(make(spark, [(1, "x y")], lang=None)).collect()} == {None}


def test_priors_decide_where_text_cannot(spark):
    rows = [(i, "the cat and the dog sat there " * 10, "en", "a.example.com", 1) for i in range(30)] + [(100 + i, "le chat et le chien dans la rue " * 10, "fr", "b.example.fr", 1) for i in range(30)]
    rows += [(999, "ok", None, "b.example.fr", 1)]
    assert by_id(langid.identify(spark.createDataFrame(rows, SCHEMA)))[999]["language"] == "fr"


# ---- 2: token ids


def test_simple8b_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        for high in (1, 2, 300, 60_000, 2**40, 2**63):
            ids = rng.integers(0, high, n, dtype=np.uint64)
            words, offsets = simple8b.encode(ids)
            assert (simple8b.decode(words, offsets, n) == ids).all()
    wide = np.array([2**64 - 1, 0, 2**60, 2**60 - 1] * 700, np.uint64)
    words, offsets = simple8b.encode(wide)
    assert (simple8b.decode(words, offsets, len(wide)) == wide).all()


@pytest.mark.parametrize("specials", [True, False])
@pytest.mark.parametrize("name,style", [("byte_bpe_50k.json", "space"), ("word_bpe_49k.json", "split")])
def test_encoder_equals_tokenizer(spark, name, style, specials):
    """By default ids are those of the tokenizer as loaded, its special strings within texts included."""
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    if not specials:
        plain.encode_special_tokens = True
    texts = [r[0] for r in documents(spark).select("text").collect()]
    texts += ["", " ", "a  b", "\n\nx ", "don't've it's", "naïve é, Zürich. Œuvre", "à́ b", "tab\there", "日本 語", "<|endoftext|>", "hello <|endoftext|> world", "a<|startoftext|>b <|EndOfText|>c", "<|endoftext|><|endoftext|>", "İx ŉ ~ ~~", "a\x00b", "x" * 5000]
    for keep in (1_500_000, 50):  # the second forgets all the time
        e = encoding.Encoder(path, style, keep, specials=specials)
        for at in range(0, len(texts), 40):
            ids, counts = e(texts[at : at + 40])
            want = [x.ids for x in plain.encode_batch(texts[at : at + 40], add_special_tokens=False)]
            assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_token_shards(spark, tmp_path):
    docs = make(spark, [(5, "b c"), (1, None), (9, "word " * 3000), (3, ""), (5, "a"), (4, "x <|endoftext|> y")])
    simple8b.write_token_shards(docs, str(tmp_path / "s"), public_tokenizers.path("byte_bpe_50k.json"), shard_ids=100)
    got = sorted(tuple(r) for r in simple8b.read_token_shards(spark, str(tmp_path / "s")).collect())
    plain, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, t in [(1, ""), (3, ""), (4, "x <|endoftext|> y"), (5, "a"), (5, "b c"), (9, "word " * 3000)]:
        ids = np.array(plain.encode(t, add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)
    simple8b.write_token_shards(docs.limit(0), str(tmp_path / "e"), public_tokenizers.path("byte_bpe_50k.json"))
    assert simple8b.read_token_shards(spark, str(tmp_path / "e")).count() == 0


# ---- 3: secrets

KINDS = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]


def plain_spans(t):
    found = [(k, *m.span()) for k, p, g, n in KINDS for m in re.finditer(p, t, re.A) if len(m[g]) >= n]
    return sorted(found, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def test_base_spans(spark):
    texts = [r[0] for r in documents(spark).select("text").collect()]
    texts += ["", "Password='abcdefgh' TOKEN : short secret=" + "ab" * 20, "AKIA" + "A" * 12 + " xAKIA123", "é" * 40 + "0" * 32, "api_key=api-key: apikey=ABCDEFGH1", "a" * 31, "secret=token=abcdefgh", "toKen=abcdefghij"]
    for t in texts:
        assert [x[:3] for x in secrets.base_spans(t)] == plain_spans(t)


def test_formats_find_unlabelled_keys(spark):
    rng = np.random.default_rng(1)
    key = lambda: "".join(rng.choice(list("0123456789abcdef"), 20)) + "-" + "".join(rng.choice(list("GHJKLM"), 6))
    rows = [(i, f"some words password={key()} and more") for i in range(60)] + [(100, f"left it here: {key()} ok"), (101, "mail7.example.com/a1-and.some.path"), (102, None), (103, "")]
    out = by_id(secrets.find_secrets(make(spark, rows)))
    assert len(out[100]["added"]) == 1 and out[101]["added"] == [] and out[102]["base"] == [] and all(len(out[i]["base"]) == 1 for i in range(60))
    assert secrets.find_secrets(make(spark, rows[-2:])).count() == 2


def test_short_formats_and_edges(spark):
    rng = np.random.default_rng(2)
    key = lambda: "".join(rng.choice(list("0123456789"), 3)) + "_" + "".join(rng.choice(list("XYZ"), 6))
    rows = [(i, f"words token={key()} and other simple sentences here, usually 12345678 long") for i in range(300)]
    rows += [(500, f"see {key()} and id={key()} but international 20240101"), (500, "z" * 200_000), (None, f"at {key()}"), (501, ""), (502, None)]
    docs = make(spark, rows).withColumn("base", F.lit("clash"))
    out = [(r["doc_id"], [x["value"] for x in r["added"]], [x["first"] for x in r["added"]]) for r in secrets.find_secrets(docs).where("size(added) > 0").collect()]
    assert sorted((str(i), len(v)) for i, v, _ in out) == [("500", 2), ("None", 1)]
    assert all("_" in x and "=" not in x for _, v, _ in out for x in v)
    assert secrets.find_secrets(docs).count() == len(rows) and secrets.find_secrets(docs.limit(0)).count() == 0


def test_automaton_merges_a_loop():
    rng = np.random.default_rng(4)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 24)) for _ in range(300)]
    a = secrets.Automaton(hexes)
    assert len(a.states) < 25 and a.score("0a1b2c3d4e5f0a1b2c3d4e5f") > a.score("zzzzzzzzzzzzzzzzzzzzzzzz")


# ---- 4: quality


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got["predicted"] == got["quality"]).mean()) > 0.95
    assert got["score"].between(0, 1).all()


def test_quality_edges(spark):
    docs = make(spark, [(1, "a b"), (2, None), (3, ""), (None, "x" * 200_000), (1, "a b")])
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.score(docs, quality.fit(docs, no_labels)).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert {r["doc_id"]: r["held_out"] for r in out} == {i: (zlib.crc32(str(i).encode()) % 5 == 0 if i else False) for i in (1, 2, 3, None)}


# ---- 5: decontamination


def plain_hits(text, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, which = split(text), set(), set()
    for item, t in items:
        b = split(t)
        size = min(n, len(b))
        grams = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if b else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                which.add(str(item))
    return len(w), len(hit), sorted(which)


def test_decontamination(spark):
    words = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(words[:40])), (2, "Just four words here"), (3, ""), (4, None), (5, "solo"), (6, "two words"), (7, " ".join(words[:40])), (10, "x " * 25)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(1, " ".join(words[3:13])), (2, " ".join(words[3:12])), (3, "JUST, four -words; here!"), (4, None), (5, ""), (6, "a solo b"), (7, "two words two words"), (8, "x " * 30), (9, " ".join(words[20:40] + ["q"] + words[:11]))]
    texts += [(None, " ".join(words[5:30])), (10, "É" + " ".join(words)), (1, "other text"), (11, "x " * 9), (12, "two; WORDS ~ solo")]
    docs = make(spark, texts).withColumn("items", F.lit("clash")).withColumn("pos", F.lit(1))
    got = decontaminate.decontamination_report(docs, bench).collect()
    assert len(got) == len(texts)
    want = Counter((i, t, *plain_hits(t, items)[:2], ",".join(plain_hits(t, items)[2])) for i, t in texts)
    assert Counter((r["doc_id"], r["text"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in got) == want
    assert decontaminate.decontamination_report(docs.limit(0), bench).count() == 0
    assert decontaminate.decontamination_report(docs, bench.limit(0)).where("contaminated").count() == 0
    spans = by_id(decontaminate.decontaminate(docs.where("doc_id = 9"), bench, mode="span"))
    assert spans[9]["text"] == "q" and decontaminate.decontaminate(docs, bench).where("doc_id = 8").count() == 0


def test_decontamination_of_long_and_repetitive_texts(spark):
    long, rows = " ".join(f"v{i}" for i in range(100_000)), [(1, "x " * 3000), (3, "x " * 9), (4, None)]
    bench = spark.createDataFrame([(1, long), (2, "x " * 300), (3, "x " * 40)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.decontamination_report(make(spark, [*rows, (2, long)]), bench).collect()}
    assert got == {1: (3000, 3000, ["2", "3"]), 2: (100_000, 100_000, ["1"]), 3: (9, 0, []), 4: (0, 0, [])}


def test_decontamination_in_several_passes(spark, monkeypatch):
    docs, bench = documents(spark), spark.read.parquet(f"{DIR}/benchmark.parquet")
    one = sorted(tuple(r) for r in decontaminate.contamination_hits(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "PASS_ANCHORS", 30)
    assert one == sorted(tuple(r) for r in decontaminate.contamination_hits(docs, bench).collect())


# ---- 6: nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16)).astype(np.float32) * rng.uniform(0.5, 2, (600, 1)).astype(np.float32)
    x[300:330] = x[299]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [None] + [1.0] * 15), (780, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    exact, found = 0, 0
    y = x.astype(np.float64)
    for q in range(0, 600, 20):
        s = (y * y[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        exact += 20
        found += len(set(want) & {v for v, _ in got[q]})
        assert len(got[q]) == 20 and q not in {v for v, _ in got[q]}
        assert all(abs(s[v] - sc) < 1e-12 for v, sc in got[q]) and [-sc for _, sc in got[q]] == sorted(-sc for _, sc in got[q])
    assert set(got) == set(range(0, 600, 20)) and found / exact >= 0.9
    repeated = df.unionByName(df.where("vec_id < 50")).unionByName(spark.createDataFrame([(0, [1e6] * 16)], "vec_id long, embedding array<float>").withColumn("score", F.lit(1)))
    assert sorted(map(tuple, ann.nearest(repeated, block_queries=7).collect())) == sorted(map(tuple, ann.nearest(df).collect()))
    assert ann.nearest(df.limit(0)).count() == 0
    assert sorted((r["query_id"], r["vec_id"]) for r in ann.nearest(df.where("vec_id IN (1, 2, 20)")).collect()) == [(20, 1), (20, 2)]
    assert ann.nearest(df.where("vec_id IN (1, 2)")).count() == 0


def test_recall_on_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), np.float64)
    got = ann.op6_multiprobe_ann(spark, "/root/testdata/sf0.01").toPandas().groupby("query_id")["vec_id"].agg(set)
    recall = [len(got[q] & set(ids[[i for i in np.lexsort((ids, -(x @ v))) if ids[i] != q][:20]])) / 20 for q, v in zip(ids, x) if q % 20 == 0]
    assert np.mean(recall) >= 0.9


# ---- 7: SimHash


def plain_print(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    texts = [(i, t) for i, t in enumerate(["a", "A  b", "a b c", "a b c d\te", "", None, " \n", "ÉA b ñ c", "long words here " * 30_000])]
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.near_duplicate_components(make(spark, texts)).collect()}
    assert got == {i: plain_print(t) for i, t in texts}


def linked(nodes, bits=2):
    """Position of the least linked fingerprint, over links of all pairs."""
    root, changed = list(range(len(nodes))), True
    links = [(i, j) for i, a in enumerate(nodes) for j, b in enumerate(nodes) if i != j and (a ^ b).bit_count() <= bits]
    while changed:
        changed = False
        for i, j in links:
            if root[j] < root[i]:
                root[i], changed = root[j], True
    return root


@pytest.mark.parametrize("limit,least", [(64, simhash.LEAST_VARIANCE), (2, simhash.LEAST_VARIANCE), (2, 0.0), (3, 99.0)])
def test_links_equal_all_pairs(spark, limit, least):
    rng = np.random.default_rng(2)
    base = [int(v) for v in rng.integers(0, 2**63, 30)]
    prints = set(base)
    for b in base[:10]:
        for _ in range(12):
            b ^= int(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 4), replace=False)))
            prints.add(b)
    crowded = [int(v) << 22 for v in rng.integers(0, 2**41, 150)]  # one bucket of unlike fingerprints
    prints |= {c ^ x for c in crowded for x in (0, *([1 << 40, 3 << 30] if c % 3 == 0 else []))}
    nodes = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)), i) for i, p in enumerate(nodes)], "fp long, node long")
    from marginalia.operators.components import connected_components

    got = {r["node"]: r["component"] for r in connected_components(simhash.linked_pairs(df, bucket_limit=limit, least_variance=least)).collect()}
    root = linked(nodes)
    assert all(got.get(i, i) == r for i, r in enumerate(root)) and len(set(root)) < len(root)


def test_repeated_ids_are_one_component(spark):
    docs = make(spark, [(3, "alpha beta gamma"), (5, "alpha beta gamma"), (5, "quite another text"), (9, "quite another text"), (11, "neither of both")])
    assert sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicate_components(docs).collect()) == [(3, 3), (5, 3), (5, 3), (9, 3), (11, 11)]


def test_components_edges(spark):
    docs = make(spark, [(4, "same text"), (2, "same text"), (9, None), (7, ""), (None, "same text"), (2, "same text"), (11, "quite another text of words")]).withColumn("fp", F.lit("x"))
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicate_components(docs).collect())
    assert got == Counter([(4, 2), (2, 2), (2, 2), (None, 2), (9, 7), (7, 7), (11, 11)])
    assert simhash.near_duplicate_components(docs.limit(0)).count() == 0


# ---- near copies of the pipeline


def plain_near_copies(rows):
    """id -> least id of its group, by brute force."""
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := split(t)) else set() for i, t in rows}
    comp, changed = {i: i for i in sets}, True
    links = [(i, j) for i in sets for j in sets if i < j and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            if comp[i] != comp[j]:
                comp[i] = comp[j] = min(comp[i], comp[j])
                changed = True
    return comp


def test_near_copies_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 3000, n)]
    rows, shared = [(0, None), (1, ""), (2, "a b c"), (3, "A b  c"), (4, "a b d"), (5, "one two three four five six")], word(40)
    for base in range(12):  # near copies of every distance, a crowded group of them, and a passage that many share
        text = word(60 + 30 * base)
        for _ in range(90 if base == 5 else 8):
            copy = list(text)
            for at in rng.choice(len(copy), rng.integers(0, 1 + len(copy) // 40), replace=False):
                copy[at] = "x" + copy[at]
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, " ".join(word(8) + shared + word(int(rng.integers(1, 8))))) for k in range(40)]
    order = rng.permutation(len(rows))
    rows = [(int(order[i]), t) for i, t in rows]
    docs = make(spark, rows)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copy_components(docs).collect()}
    want = plain_near_copies(rows)
    assert got == want and 20 < len(set(want.values())) < len(rows) - 60
    import corpus_pipeline

    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, DIR).collect()} == set(want.values())


def test_near_copies_edges(spark):
    docs = make(spark, [(4, "same text"), (2, "same text"), (9, None), (7, ""), (None, "same text"), (2, "same text"), (11, "quite another text of words")]).withColumn("held", F.lit("x"))
    got = Counter((r["doc_id"], r["component_id"]) for r in near_copies.near_copy_components(docs).collect())
    assert got == Counter([(4, 2), (2, 2), (2, 2), (None, 2), (9, 7), (7, 7), (11, 11)])
    assert near_copies.near_copy_components(docs.limit(0)).count() == 0


# ---- 8: packing


def test_packing(spark):
    docs = make(spark, [(i, "word " * (37 * i % 900)) for i in range(60)] + [(100, None), (101, "word " * 9000), (5, "x"), (5, "x"), (None, "y")])
    got = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).toPandas()
    assert (got["doc_id"] == 101).sum() == 3 and (got["doc_id"] == 5).sum() == 3
    for _, part in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert part["length"].sum() <= 4096 and (part["offset"].to_numpy() == np.cumsum(part["length"]) - part["length"]).all()
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 4096) + 1
    assert packing.pack_documents(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_packing_with_a_small_table(spark):
    """The pipeline's encoders remember few pieces; what they pack is the same, and the table stays small."""
    path, docs = public_tokenizers.path("word_bpe_49k.json"), documents(spark)
    small, usual = (packing.pieces(docs, path, keep=keep).toPandas().sort_values(["doc_id", "piece"]).reset_index(drop=True) for keep in (200, 900_000))
    assert small.equals(usual)
    e = encoding.encoder(path, "split", 200)
    assert e is not encoding.encoder(path, "split") and e is encoding.encoder(path, "split", 200)
    for i in range(40):
        e([f"w{i}x{j}" for j in range(50)])
        assert len(e.pieces) <= 200 + 50


def test_local_search_helps_and_keeps_items():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1300, 2000, 4000)
    first = packing.best_fit(lengths, 4096)
    more = packing.local_search(lengths, first, 4096)
    assert sorted(i for b in more for i in b) == list(range(4000)) and max(lengths[b].sum() for b in more) <= 4096 and len(more) < len(first)


def test_packing_in_groups(spark):
    rows = packing.pieces(documents(spark), public_tokenizers.path("word_bpe_49k.json"))
    one, many = packing.pack(rows).toPandas(), packing.pack(rows, group_bins=5).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, one[key].to_numpy())) == sorted(map(tuple, many[key].to_numpy()))
    assert many["sequence_id"].nunique() <= one["sequence_id"].nunique() * 1.05 + 1


def test_equal_rows_are_spread(spark):
    rows = spark.range(200_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("length"), F.lit(7).cast("long").alias("ids_crc32"))
    got = packing.pack(rows, group_bins=5).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("offset").alias("most")).toPandas()
    assert got["n"].sum() == 200_000 and got["n"].max() <= 4096 and len(got) <= 55 and (got["most"] == got["n"] - 1).all()


def test_packing_ends_where_nothing_fits(spark, monkeypatch):
    rounds, put = [], packing.Scratch.put

    def counted(self, df, name, *a):
        rounds.append(name)
        assert rounds.count("packed") <= 5
        return put(self, df, name, *a)

    monkeypatch.setattr(packing.Scratch, "put", counted)
    rows = spark.range(2100).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(3000).cast("long").alias("length"), F.col("id").alias("ids_crc32"))
    got = packing.pack(rows, group_bins=50).toPandas()
    assert sorted(got["doc_id"]) == list(range(2100)) and got["sequence_id"].nunique() == 2100 and (got["offset"] == 0).all()


# ---- 9: line dedup


def plain_lines(docs):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\f\r"))
    seen = defaultdict(set)
    for i, t in docs:
        if i is not None:
            for s in (t or "").split("\n"):
                if len(key(s)) >= 20:
                    seen[key(s)].add(i)
    return [(i, t, "\n".join(s for s in (t or "").split("\n") if i is None or len(seen[key(s)]) < 3 or max(seen[key(s)]) == i)) for i, t in docs]


def test_line_dedup(spark):
    x, y = "Exactly the same long line", "another line that is shared É"
    rows = [(1, f"{x}\nshort\n{y}"), (2, f" {x.upper()}\t\n{x}"), (3, f"{x}\nshort"), (4, f"short\n{y}\n{y}"), (5, y), (6, None), (7, ""), (8, "\n\n"), (5, y), (None, x), (3, "a second text of an id\n" + x), (9, "a" * 19)]
    docs = make(spark, rows).withColumn("key", F.lit(1)).withColumn("n_lines", F.lit("x"))
    got = line_dedup.dedup_lines(docs).collect()
    assert Counter((r["doc_id"], r["text"], r["kept_text"]) for r in got) == Counter(plain_lines(rows))
    assert all(r["n_lines"] == len((r["text"] or "").split("\n")) and r["n_dropped"] == r["n_lines"] - len(r["kept_text"].split("\n")) for r in got if r["kept_text"])
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("batches,fanout", [(1, 2), (7, 3)])
def test_line_runs_compact(spark, batches, fanout):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    got = line_dedup.dedup_lines(documents(spark), batches=batches, fanout=fanout).collect()
    assert Counter((r["doc_id"], r["text"], r["kept_text"]) for r in got) == Counter(plain_lines(rows))


# ---- 10: LM scoring


def test_lm(spark):
    docs = documents(spark).unionByName(make(spark, [(None, "a b"), (9001, None), (9002, "z" * 500), (9002, "z" * 500)]))
    got = lm.score_documents(docs, frequent=300).toPandas()
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    count = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(lm.words_of(t) + [lm.END])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in rows:
        w = lm.words_of(t) + [lm.END]
        want[(str(i), len(w), sum(count[x] > 0 for x in w), round(sum(np.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 5))] += 1
    made = Counter(("None" if r.doc_id != r.doc_id else str(int(r.doc_id)), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got.itertuples())
    assert made == want and (got["score"] < 0).all() and set(got["train_tokens"]) == {n}
    assert got[got["n_tokens"] > 50]["bits_per_byte"].mean() < 4.5
    clash = docs.withColumn("portion", F.lit(1)).withColumn("score", F.lit("x"))
    small = lm.score_documents(clash, frequent=300, shard=2_000).toPandas()  # many shards, hot words
    assert small["base_score"].sum() == pytest.approx(got["base_score"].sum()) and small["score"].sum() == pytest.approx(got["score"].sum(), rel=0.03)
    assert lm.score_documents(docs.limit(0)).count() == 0


def test_lm_beats_its_base_and_tells_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    one = docs.where("doc_id % 97 = 0 AND length(text) > 400")
    docs = docs.unionByName(one.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))
    got = lm.score_documents(docs).toPandas()
    out = got[got["held_out"] & (got["n_known"] == got["n_tokens"])]  # the base doesn't spell new words
    assert len(out) > 20 and out["score"].sum() > out["base_score"].sum()
    got["each"] = got["score"] / got["n_tokens"]
    twice = got["doc_id"] >= 1_000_000
    assert got[twice]["each"].median() > got[~twice]["each"].quantile(0.8)


def plain_mixed(train, before, before2, symbol, code, batch):
    """The mixer by dictionaries, bit by bit and batch by batch."""
    turn = np.random.default_rng(11).permutation(len(symbol))
    steps = [(i, int(code.node[k]), bool(code.bit[k])) for i in turn for k in range(code.start[symbol[i]], code.start[symbol[i]] + code.length[symbol[i]])]
    seen, pairs = defaultdict(lambda: [0, 0]), Counter(zip(before, before2))
    for i, node, bit in steps:
        if train[i]:
            for context in ((before[i],), (before[i], before2[i])):
                seen[(*context, node)][bit] += 1
    stretch = lambda p: np.log(min(max(p, 1e-5), 1 - 1e-5) / (1 - min(max(p, 1e-5), 1 - 1e-5)))
    rows = []
    for i, node, bit in steps:
        p, x, gate = float(code.p[node]), [stretch(float(code.p[node]))], 0
        for k, context in enumerate(((before[i],), (before[i], before2[i]))):
            zero, one = seen[(*context, node)] if k == 0 or pairs[before[i], before2[i]] > 1 else (0, 0)
            if train[i] and (k == 0 or pairs[before[i], before2[i]] > 1):
                zero, one = zero - (not bit), one - bit
            p = (one + lm.BACK * p) / (zero + one + lm.BACK)
            x.append(stretch(p))
            gate += sum(zero + one >= v for v in (1, 2, 4, 16, 256)) * 6**k
        rows.append((i, bit, x, gate + 36 * (one == 0 or zero == 0)))
    w, squares = defaultdict(lambda: np.array([0.0, 0.0, 1.0])), defaultdict(lambda: np.full(3, 1e-4))
    cells = defaultdict(lambda: 1 / (1 + np.exp(-np.linspace(-8, 8, 33))))
    mix = lambda x, g: float(np.clip(w[g] @ np.array(x), -7.999, 7.999))
    for at in range(0, len(rows), batch):
        grads, met = defaultdict(lambda: np.zeros(3)), defaultdict(list)
        for i, bit, x, g in rows[at : at + batch]:
            if train[i]:
                z = mix(x, g)
                grads[g] += (bit - 1 / (1 + np.exp(-z))) * np.array(x)
                met[g, int(round((z + 8) * 2))].append(bit)
        for g, d in grads.items():
            squares[g] += d * d
            w[g] = w[g] + 0.05 * d / np.sqrt(squares[g])
        for (g, c), bits in met.items():
            cells[g] = cells[g].copy()
            cells[g][c] += (sum(bits) - len(bits) * cells[g][c]) / (len(bits) + 200)
    out = np.zeros(len(symbol))
    for i, bit, x, g in rows:
        z = mix(x, g)
        low = min(int((z + 8) * 2), 31)
        part = (z + 8) * 2 - low
        q = (1 / (1 + np.exp(-z)) + cells[g][low] * (1 - part) + cells[g][low + 1] * part) / 2
        out[i] += np.log10(q if bit else 1 - q)
    return out


def test_mixer_equals_plain_version_and_is_a_distribution():
    rng = np.random.default_rng(8)
    code = lm.Code([50, 30, 12, 5, 2, 1, 9])
    n = 1500
    before, before2, symbol = rng.integers(0, 12, n).astype(np.uint32), rng.integers(0, 5, n).astype(np.uint32), rng.choice(7, n, p=np.array([50, 30, 12, 5, 2, 1, 9]) / 109)
    symbol[before == 3] = 2
    train = rng.random(n) < 0.8
    before[-7:], before2[-7:], symbol[-7:], train[-7:] = 4, 2, np.arange(7), False
    got = lm.mixed_scores(train, before, before2, symbol, code, batch=512, room=8)
    assert np.allclose(got, plain_mixed(train, before.tolist(), before2.tolist(), symbol, code, 512), atol=2e-3)
    assert (10 ** got[-7:]).sum() == pytest.approx(1, abs=1e-4)
    assert lm.mixed_scores(train[:3], before[:3], before2[:3], np.zeros(3, int), lm.Code([5])).tolist() == [0, 0, 0]


def test_hot_contexts_know_the_whole_corpus(spark):
    """A word before and a pair that fill many shards have in each of them the counts of all."""
    rng = np.random.default_rng(4)
    code = lm.Code([9, 7, 5, 3, 1])
    n = 4000
    before, before2, symbol, train = rng.integers(0, 3, n).astype(np.uint32), rng.integers(0, 3, n).astype(np.uint32), rng.integers(0, 5, n), rng.random(n) < 0.8
    pairs = lm.pair_of(before, before2)
    met = {int(c): np.bincount(symbol[train & (x == c)], minlength=5) for x in (before.astype(np.int64), pairs) for c in np.unique(x)}
    counts = {c: (np.arange(5), k) for c, k in met.items()}

    def seen(part, names):
        token = np.repeat(np.arange(len(part)), code.length[symbol[part]])
        at = lm._spread(code.start[symbol[part]], code.length[symbol[part]])
        got = np.zeros((2, len(token)), np.float32)
        lm.whole_counts(counts, names[part], token, code.node[at], code.bit[at], train[part][token], code, *got)
        plain = lm.context_counts(np.unique(names[part], return_inverse=True)[1], None, token, code.node[at], code.bit[at], train[part][token], 8)
        return got, np.array(plain)

    for names in (before.astype(np.int64), pairs):
        got, plain = seen(np.arange(n), names)
        assert (got == plain).all()
        half, torn = seen(np.arange(0, n, 2), names)
        assert (half[0] > 1.5 * torn[0]).mean() > 0.9  # a shard's own counts are those of a sample
    docs = make(spark, [(i, "a b a b c a b d" if i % 3 else "a b e") for i in range(400)])
    one, many = ({r["doc_id"]: r["score"] for r in lm.score_documents(docs, shard=s).collect()} for s in (250_000, 100))
    assert max(abs(one[i] - many[i]) for i in one) < 0.25  # weights are learnt by shard, counts are not


def test_hot_contexts_are_not_counted_again(monkeypatch):
    """What comes with the corpus's counts is left out of a shard's own, whose table is then the others' alone."""
    rng, n = np.random.default_rng(3), 3000
    code = lm.Code([50, 30, 10, 5, 5])
    symbol, before, before2 = (rng.integers(0, 5, n) for _ in range(3))
    counts = {c: (np.arange(5), np.bincount(symbol[before == c], minlength=5)) for c in (0, 1)}
    met, count = [], lm.context_counts

    def watched(context, some, token, *rest):
        seen, ones = count(context, some, token, *rest)
        met.append(np.unique(token[seen > 0]))
        return seen, ones

    monkeypatch.setattr(lm, "context_counts", watched)
    train = np.ones(n, bool)
    got = lm.mixed_scores(train, before, before2, symbol, code, room=6, counts=counts)
    assert len(met[0]) == (before > 1).sum()
    assert np.allclose(got, lm.mixed_scores(train, before, before2, symbol, code, room=6), atol=1e-6)


def test_spelling_is_a_distribution():
    n, ones = lm.empty_tables()
    words = [b"the", b"then", b"cat", lm.END]
    lm.count_spellings(words, n, ones)
    s = lm.Speller(n, ones)
    total = lambda: sum(10.0 ** s.score([bytes([b])], np.array([False]))[0] for b in range(256) if b not in (10, 32))  # noqa: E731  one-letter words are followed by a blank
    assert total() < 1 and 10 ** s.score([b"the"], np.array([False]))[0] > 10 ** s.score([b"qzx"], np.array([False]))[0]
    assert lm.segments([b"x" * 200])[1].tolist() == [0, 0, 0, 0] and lm.segments([b"abcdefghij" * 8])[2].tolist() == [0, int.from_bytes(b"ghijabcd", "big")]
    assert s.score([b"x" * 5000], np.array([False]))[0] < 0
    s.learn(words * 30)  # each is left out of its own counts, so what is learnt is that none of them is known
    assert total() < 1


def test_packed_tokens_round_trip():
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 60_000, 500).astype(np.uint16), np.sort(rng.integers(0, 2**32, 500).astype(np.uint32)), rng.integers(0, 2**24, 500).astype(np.uint32), rng.integers(0, 2**16, 500).astype(np.uint16)]
    assert all((a == b).all() for a, b in zip(arrays, lm._unpack(lm._pack(*arrays))))


# ---- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs, kept = documents(spark), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = stage(spark, docs, DIR).cache()
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == documents(spark).columns
        if name == "language_id":
            assert set(after) == {i for i, t in before if any(map(str.isalpha, t))}
        if name == "line_dedup":
            assert after == {i: t for i, _, t in plain_lines(before)}
        if name == "near_dedup":
            comp = plain_near_copies(before)
            assert set(after) == {i for i in comp if comp[i] == i} and len(after) < len(before)
        if name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
            assert set(after) == {i for i, t in before if not plain_hits(t, items)[1]}
        kept[name] = len(after)
    packed = corpus_pipeline.run(spark, DIR).toPandas()
    assert packed["doc_id"].nunique() == kept["decontaminate"]


def test_report_hash(spark):
    from marginalia.llm.queries import QUERIES

    got = by_id(QUERIES["op3_secret_formats"](spark, DIR))
    for r in documents(spark).collect():
        s = plain_spans(r["text"])
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()
        assert (got[r["doc_id"]]["n_assign"], got[r["doc_id"]]["n_hex"]) == (sum(k == "assign" for k, *_ in s), sum(k == "hex" for k, *_ in s))


def test_near_dedup_goes_by_fingerprints_too(spark):
    """Repeats outweigh what differs in a fingerprint, but not in a set of shingles."""
    import corpus_pipeline

    tail = lambda c: " ".join(f"{c}{i}" for i in range(40))
    docs = make(spark, [(1, "one two three four five " * 200 + tail("x")), (2, "one two three four five " * 200 + tail("y")), (3, tail("z"))])
    prints = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_components(docs).collect()}
    sets = {r["doc_id"]: r["component_id"] for r in near_copies.near_copy_components(docs).collect()}
    assert prints == {1: 1, 2: 1, 3: 3} and sets == {1: 1, 2: 2, 3: 3}
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, DIR).collect()) == [1, 3]
