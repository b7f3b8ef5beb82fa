"""Phrase collocations by best-first branch and bound over prefixes.

A phrase of a prefix q is at most as frequent as q, so none scores above
``bound(q) = 2000000 f(q) / (f(first word) + f(q))``, and bounds only fall as a
prefix grows. Pairs of frequent words are counted first. Then, language by
language, prefixes are expanded in the order of their bounds down to a
threshold T. A phrase with a score of T or more has prefixes with bounds of T
or more, and so is found; the phrases that may displace it are counted with
it. Once as many phrases as asked for survive at T or above, the last one's
score, ties included, is settled. Where fewer do, T falls and the frontier is
expanded further, down to 0 in the end.

Counting is a pass over the texts: tasks number the words of some texts, count
in arrays, and give sums that are added by Spark. What may be skipped is told
by bit sets of a fixed size over hashes of words and prefixes. A hash that
collides only makes a task count more, all of it exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.text import whole
from marginalia.operators.ordering import running
from marginalia.scratch import Scratch

#: Ends of pieces become line feeds, tabs blanks; ``END`` stands for an end of a piece and is in no UTF-8 text.
_TABLE = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
END = b"\xff"
#: Bytes of texts of one language that a task counts at once; a longer text is counted by itself.
AT_ONCE = 5 << 20
SCALE = 2_000_000
COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("f", pa.int64())])


def numbered(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the words of texts, -1 at each end of a piece, and the words by number."""
    data = b"\n".join([*texts, b""]).lower().translate(_TABLE).replace(b"\n", b" \xff ")
    blob = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int64)), pa.py_buffer(data)])
    words = pc.ascii_split_whitespace(blob).values.view(pa.large_binary())
    words = words.filter(pc.not_equal(pc.binary_length(words), 0)).dictionary_encode()
    ids, end = words.indices.to_numpy(), pc.index(words.dictionary, pa.scalar(END, pa.large_binary())).as_py()
    return np.where(ids == end, np.int32(-1), ids.astype(np.int32, copy=False)), words.dictionary


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word)


def longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of prefixes with one more word."""
    h = (h * np.uint64(0x9E3779B97F4A7C15) + word) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(31))


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bits) * 64 - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bit_set(phrases: DataFrame, log_bits: int = 26) -> Broadcast:
    """A broadcast set of 2**log_bits bits with the hashes of phrases ``(lang, phrase)``; its size doesn't depend on theirs."""
    spark = phrases.sparkSession

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, known = [], {}
            for lang, phrase in zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist()):
                h = None
                for word in phrase.split(b" "):
                    w = known.get((lang, word))
                    if w is None:
                        w = known[lang, word] = word_hash(lang, word)
                    h = w if h is None else longer(np.array([h], np.uint64), np.array([w], np.uint64))[0]
                hashes.append(int(h))
            at = np.unique(np.array(hashes, np.uint64) & np.uint64(2**log_bits - 1))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(bits.view(np.int64))], ["at", "bits"])

    got = phrases.select("lang", F.col("phrase").cast("binary").alias("phrase")).mapInArrow(places, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(2**log_bits // 64, np.uint64)
    out[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(out)


def counter(length: int, sets: dict[str, Broadcast]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over ``(lang, text)`` to counts of phrases of some words, those that sets ask for; of one word, all, and with a null phrase their number.

    ``words`` and ``pairs``: what a phrase's words and pairs have to be in;
    ``prefix``, ``suffix``: what all but its last or first word has to be in,
    either of the two; ``itself``: what it has to be in.
    """
    def counts(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, words = numbered(texts)
        if length == 1:
            n = np.bincount(ids[ids >= 0], minlength=len(words))
            phrases, n = pa.concat_arrays([words, pa.array([None], pa.large_binary())]), np.append(n, n.sum())
        else:
            if len(ids) < length:
                return
            bits = {k: b.value for k, b in sets.items()}
            h = np.fromiter((word_hash(lang, w) for w in words.to_pylist()), np.uint64, len(words))
            fits = ids >= 0
            if "words" in bits:
                fits = fits & marked(bits["words"], h)[ids]
            chain, good = [h[ids]], fits
            for k in range(1, length):
                m = len(ids) - k
                good = good[:m] & fits[k:]
                chain.append(longer(chain[-1][:m], chain[0][k:]))
            if "pairs" in bits:
                pair = marked(bits["pairs"], chain[1])
                for k in range(length - 1):
                    good = good & pair[k : k + len(good)]
            if "prefix" in bits:
                prefix = chain[length - 2]
                good = good & (marked(bits["prefix"], prefix[: len(good)]) | marked(bits["suffix"], prefix[1 : len(good) + 1]))
            if "itself" in bits:
                good = good & marked(bits["itself"], chain[length - 1])
            at = np.flatnonzero(good)
            if not len(at):
                return
            key, parts = ids[at].astype(np.int64), []
            for k in range(1, length):  # prefixes are numbered anew, so keys fit in 64 bits
                if k > 1:
                    kinds, key = np.unique(key, return_inverse=True)
                    parts.append(kinds)
                key = key * len(words) + ids[at + k]
            key.sort()
            first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            n, key, split = np.diff(first, append=len(key)), key[first], []
            for kinds in (*reversed(parts), None):  # the last word of each prefix, from the longest prefix down
                split.append(key % len(words))
                key = key // len(words) if kinds is None else kinds[key // len(words)]
            phrases = pc.binary_join_element_wise(*(words.take(pa.array(i)) for i in (key, *reversed(split))), pa.scalar(b" ", pa.large_binary()))
        phrases, n = phrases.cast(pa.binary()), pa.array(n.astype(np.int64))
        for i in range(0, len(phrases), 50_000):
            part = phrases.slice(i, 50_000)
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part)), part, n.slice(i, 50_000)], schema=COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        total = 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                held.setdefault(lang, []).append(text.as_py())
                sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1])
                total += len(held[lang][-1])
                if sizes[lang] >= AT_ONCE or total >= 3 * AT_ONCE:
                    full = max(sizes, key=sizes.get)
                    total -= sizes.pop(full)
                    yield from counts(full, held.pop(full))
        for lang, texts in held.items():
            yield from counts(lang, texts)

    return run


def ratio(a: Column, l: Column, r: Column) -> Column:
    """floor(2000000 a / (l + r)), exactly."""
    wide = [c.cast("decimal(19,0)") for c in (a, l, r)]
    return F.call_function("div", wide[0] * SCALE, wide[1] + wide[2])


def lowest(a: Column, *cuts: tuple[Column, Column]) -> Column:
    """The cut ``(score, k, l, r)`` with the lowest score, the earliest of them."""
    scored = [F.struct(ratio(a, l, r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")) for k, (l, r) in enumerate(cuts, 1)]
    return F.array_min(F.array(*scored))


def first_words(c: Column, n: int) -> Column:
    return F.substring_index(c, " ", n)


class Search:
    """Counts so far, and passes over the texts."""

    def __init__(self, docs: DataFrame, least: int, log_bits: int, lang_col: str, text_col: str):
        self.scratch, self.least, self.log_bits = Scratch(docs.sparkSession, "collocations"), least, log_bits
        self.texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole(F.col(text_col)).cast("binary").alias("text"))

    def bits(self, phrases: DataFrame) -> Broadcast:
        return bit_set(phrases, self.log_bits)

    def count(self, length: int, **sets: Broadcast) -> DataFrame:
        got = self.texts.mapInArrow(counter(length, sets), "lang string, phrase binary, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("a"))
        got = got.where((F.col("a") >= self.least) | F.col("phrase").isNull()).withColumn("phrase", F.col("phrase").cast("string"))
        return self.scratch.put(got, f"counts{length}")

    def pairs(self, words: DataFrame) -> DataFrame:
        """``(lang, phrase, a, l1, r1)`` of all frequent pairs."""
        counted = self.count(2, words=self.bits(words)).withColumns({"first": first_words(F.col("phrase"), 1), "last": first_words(F.col("phrase"), -1)})
        left = words.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l1")).hint("merge")
        right = words.select("lang", F.col("phrase").alias("last"), F.col("a").alias("r1")).hint("merge")
        return self.scratch.put(counted.join(left, ["lang", "first"]).join(right, ["lang", "last"]).drop("first", "last"), "pairs")

    def triples(self, counted: DataFrame, pairs: DataFrame) -> DataFrame:
        """``(lang, phrase, a, l1, r1, l2, r2)``."""
        counted = counted.withColumns({"first": first_words(F.col("phrase"), 2), "last": first_words(F.col("phrase"), -2)})
        left = pairs.select("lang", F.col("phrase").alias("first"), F.col("l1"), F.col("a").alias("l2")).hint("merge")
        right = pairs.select("lang", F.col("phrase").alias("last"), F.col("a").alias("r1"), F.col("r1").alias("r2")).hint("merge")
        return self.scratch.put(counted.join(left, ["lang", "first"]).join(right, ["lang", "last"]).drop("first", "last"), "triples")

    def fours(self, counted: DataFrame, triples: DataFrame) -> DataFrame:
        counted = counted.withColumns({"first": first_words(F.col("phrase"), 3), "last": first_words(F.col("phrase"), -3)})
        left = triples.select("lang", F.col("phrase").alias("first"), "l1", "l2", F.col("a").alias("l3")).hint("merge")
        right = triples.select("lang", F.col("phrase").alias("last"), F.col("a").alias("r1"), F.col("r1").alias("r2"), F.col("r2").alias("r3")).hint("merge")
        return counted.join(left, ["lang", "first"]).join(right, ["lang", "last"]).drop("first", "last")


def scored(rows: DataFrame, cuts: int) -> DataFrame:
    best = lowest(F.col("a"), *((F.col(f"l{k}"), F.col(f"r{k}")) for k in range(1, cuts + 1)))
    return rows.withColumn("__best", best).select("*", F.col("__best.score").alias("score"), F.col("__best.l").alias("l"), F.col("__best.r").alias("r"), ratio(F.col("a"), F.col("l1"), F.col("a")).alias("bound")).drop("__best")


def score_at(rows: DataFrame, most: int) -> DataFrame:
    """``(lang, t, n)``: the score of each language's most-th best row, 0 where it has fewer, and its number of rows. A language has at most 1000001 scores."""
    down = Window.partitionBy("lang").orderBy(F.col("score").desc())
    return (
        rows.groupBy("lang", "score").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(down))
        .groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upto") >= most, F.col("score"))), F.lit(0).cast("long")).alias("t"), F.sum("n").alias("n")))


def undisplaced(rows: DataFrame, longer_rows: DataFrame | None, words: int) -> DataFrame:
    """rows of some words that no phrase of one more word holds with 80 % of their count or more. Phrases of two more words hold one of one more, at least as frequent."""
    if longer_rows is None:
        return rows
    inside = longer_rows.select("lang", F.explode(F.array(first_words(F.col("phrase"), words), first_words(F.col("phrase"), -words))).alias("phrase"), F.col("a").alias("__longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("__longer").alias("__longer"))
    held = F.col("__longer").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * 80
    return rows.join(inside.hint("merge"), ["lang", "phrase"], "left").where(~F.coalesce(held, F.lit(False))).drop("__longer")


def collocations(docs: DataFrame, top: int = 2000, least: int = 30, ahead: int = 2, log_bits: int = 26, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's best phrases of 2 to 4 words.

    Words are `[^\\x20\\x09]+` of pieces between `[.,;:!?\\x0A-\\x0D]`, A-Z
    lower-cased; n counts a language's words, a, l and r a phrase and the parts
    of its lowest-scoring cut. Ties in score go to the larger a, then to the
    smaller phrase in byte order. Null texts are empty, a null language counts
    with ``und``. Repeated rows count as often as they occur, whatever their
    ids; other columns aren't read. Languages without candidates, and empty
    tables, give no rows. A text of any length is counted whole.

    The first threshold is the score of a language's ``ahead * top``-th pair;
    where too few survive it, the next is that of four times as many.
    """
    search = Search(docs, least, log_bits, lang_col, text_col)
    keep = search.scratch.put
    counted = search.count(1)
    totals = keep(counted.where("phrase IS NULL").select("lang", F.col("a").alias("n")), "totals")
    words = counted.where("phrase IS NOT NULL")
    pairs = keep(scored(search.pairs(words), 1), "pairs")
    known = search.bits(pairs)
    settled, open_langs, most = [], totals.select("lang"), ahead * top
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    while True:
        level = keep(score_at(pairs.join(open_langs, "lang", "left_semi"), most).select("lang", "t"), "thresholds")

        def above(rows: DataFrame, what: str) -> DataFrame:
            return rows.join(level, "lang").where(F.col(what) >= F.col("t")).drop("t")

        counted3 = search.count(3, pairs=known, prefix=search.bits(above(pairs, "bound")), suffix=search.bits(above(pairs, "score")))
        triples = keep(scored(search.triples(counted3, pairs), 2), "triples")
        counted4 = search.count(4, pairs=known, prefix=search.bits(above(triples, "bound")), suffix=search.bits(above(triples, "score")))
        lacking = counted4.select("lang", first_words(F.col("phrase"), -3).alias("phrase")).join(triples.hint("merge"), ["lang", "phrase"], "left_anti").distinct()
        lacking = keep(lacking, "lacking")
        every = triples
        if not lacking.isEmpty():
            more = search.count(3, itself=search.bits(lacking)).join(triples.hint("merge"), ["lang", "phrase"], "left_anti")
            every = triples.unionByName(scored(search.triples(more, pairs), 2))
        fours = keep(scored(search.fours(counted4, every), 3), "fours")
        found = [undisplaced(above(rows, "score"), held, k).select(*columns) for rows, held, k in ((pairs, triples, 2), (triples, counted4, 3), (fours, None, 4))]
        found = keep(found[0].unionByName(found[1]).unionByName(found[2]), "found")
        enough = keep(level.join(found.groupBy("lang").agg(F.count("*").alias("n")), "lang", "left").select("lang", ((F.coalesce("n", F.lit(0)) >= top) | (F.col("t") == 0)).alias("done")), "enough")
        settled.append(keep(found.join(enough.where("done"), "lang", "left_semi"), "settled"))
        open_langs = enough.where("NOT done").select("lang")
        if open_langs.isEmpty():
            break
        most *= 4
    out = settled[0]
    for rows in settled[1:]:
        out = out.unionByName(rows)
    last = keep(score_at(out, top).select("lang", "t"), "last")
    out = keep(out.join(last, "lang").where(F.col("score") >= F.col("t")).drop("t"), "best")
    ordered = keep(running(search.scratch, out, [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")], {"place": F.lit(1)}), "ranked")
    starts = ordered.groupBy("lang").agg(F.min("place").alias("start")).join(totals, "lang")
    return (
        ordered.join(starts, "lang").withColumn("rank", (F.col("place") - F.col("start") + 1).cast("long")).where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS MATERIALIZED (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k)
  WHERE i + k - 1 <= len(ws) GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND a >= 30),
parts AS MATERIALIZED (
  SELECT lang, phrase, k, a, cut, array_to_string(ws[1 : cut], ' ') AS first, array_to_string(ws[cut + 1 :], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
cuts AS (
  SELECT p.lang, p.k, p.phrase, p.a, cut, l.a AS l, r.a AS r, (2000000 * p.a::HUGEINT // (l.a + r.a))::BIGINT AS score
  FROM parts p JOIN g l ON l.lang = p.lang AND l.phrase = p.first JOIN g r ON r.lang = p.lang AND r.phrase = p.rest),
best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, cut) = 1),
held AS MATERIALIZED (
  SELECT lang, a, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM held h JOIN c s ON s.lang = h.lang AND s.phrase = h.phrase
  WHERE 100 * h.a::HUGEINT >= 80 * s.a::HUGEINT)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN n USING (lang) ANTI JOIN inside USING (lang, phrase)
QUALIFY rank <= 2000
"""
