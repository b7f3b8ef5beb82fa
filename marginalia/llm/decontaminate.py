"""Benchmark decontamination with broadcast sets of n-grams, JVM-side throughout.

Every window of ``n`` item words covers one item position that is a multiple
of ``n - 2``, with the three words from there on. So only those trigrams of an
item are anchors. A document is read once, in a row of its own: its trigrams
are looked up in the set of anchors, and only the windows that lie around a
hit, at most ``n - 2`` of them each, leave the row, as text. There they meet
the distinct windows of all items word for word. Items are attached to windows
last, so a passage that many items hold costs one row where it is found.
Items shorter than ``n`` are one window anchored at its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.text import NOT_WORD, ascii_lower, whole
from marginalia.scratch import Scratch

N = 10
#: Anchors in a set and windows that are broadcast; more of them take more passes over the documents.
PASS_ANCHORS, PASS_WINDOWS = 20_000, 200_000
#: Windows with their items are broadcast up to this number.
BROADCAST_ITEMS = 200_000


def raw_words(text: Column) -> Column:
    """Words with their own case: splitting doesn't depend on it."""
    return F.filter(F.split(whole(text), NOT_WORD), lambda w: w != "")


def words(text: Column) -> Column:
    return F.transform(raw_words(text), ascii_lower)


def _gram(w: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(w, at + k) for k in range(size)])


def _window(w: Column, at: Column, length: Column | int) -> Column:
    return F.array_join(F.slice(w, at + 1, length), " ")


def item_windows(bench: DataFrame, n: int = N) -> DataFrame:
    """``(item_id, length, text, gram)``, distinct, from ``(item_id, words)``: every window of an item and the hash of its anchor."""
    w, m = F.col("words"), F.size("words")
    rows = bench.where(m > 0).select("item_id", "words", F.least(m, F.lit(n)).alias("length"), F.explode(F.sequence(F.lit(0), F.greatest(m - n, F.lit(0)))).alias("at"))
    # the least multiple of n - 2 from the window's start on; a short item's own start
    anchor = F.when(F.col("length") < n, F.lit(0)).otherwise(F.ceil(F.col("at") / (n - 2)).cast("int") * (n - 2))
    size = F.least(F.col("length"), F.lit(3))
    gram = F.when(size == 1, _gram(w, anchor, 1)).when(size == 2, _gram(w, anchor, 2)).otherwise(_gram(w, anchor, 3))
    return rows.select("item_id", "length", _window(w, F.col("at"), F.col("length")).alias("text"), gram.alias("gram")).distinct()


def _near(length: int, anchors: list[int], n: int) -> Column:
    """``array<struct<first, length, window>>``: the windows of so many words of ``w`` that lie around an anchor, first from 0."""
    size = min(length, 3)
    gram = ", ".join(f"get(w, i + {k})" for k in range(size))
    hit = f"filter(sequence(0, size(w) - {size}), i -> xxhash64({gram}) IN ({', '.join(f'{a}L' for a in anchors)}))"
    if length == n:  # the anchor may be any of the window's first n - 2 words
        around = f"sequence(greatest(p - {n - 3}, 0), least(p, size(w) - {n}))"
        hit = f"array_distinct(flatten(transform(filter({hit}, p -> p - {n - 3} <= size(w) - {n}), p -> {around})))"
    made = f"transform({hit}, p -> struct(p AS first, {length} AS length, array_join(slice(w, p + 1, {length}), ' ') AS window))"
    return F.expr(f"CASE WHEN size(w) >= {length} THEN {made} ELSE CAST(array() AS array<struct<first:int,length:int,window:string>>) END")


def window_hits(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """``(doc_id, text_hash, first, length, window)``: where windows of ``item_windows`` lie in documents, word for word. Rows may repeat."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(whole(F.col(text_col))).alias("text_hash"), words(F.col(text_col)).alias("w"))
    parts = -(-windows.select("length", "gram").distinct().count() // PASS_ANCHORS)
    part = F.pmod("gram", F.lit(parts))
    # many windows behind a few anchors are split by their own hash
    sizes = windows.select("gram", "text").distinct().groupBy(part.alias("part")).count().collect() if parts else []
    found = None
    for k, split, splits in [(r["part"], i, -(-r["count"] // PASS_WINDOWS)) for r in sorted(sizes) for i in range(-(-r["count"] // PASS_WINDOWS))]:
        mine = windows.where((part == k) & (F.pmod(F.xxhash64("text"), F.lit(splits)) == split))
        sets: dict[int, list[int]] = {}
        for r in mine.select("length", "gram").distinct().collect():
            sets.setdefault(r["length"], []).append(r["gram"])
        if not sets:
            continue
        near = F.explode(F.concat(*[_near(length, grams, n) for length, grams in sorted(sets.items())])).alias("x")
        of_pass = mine.select(F.col("text").alias("window")).distinct()
        hit = texts.select("doc_id", "text_hash", near).select("doc_id", "text_hash", "x.first", "x.length", "x.window").join(F.broadcast(of_pass), "window", "left_semi")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = spark.createDataFrame([], "doc_id long, text_hash long, first int, length int, window string")
    return found.select("doc_id", "text_hash", "first", "length", "window")


def _with_items(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """hits with ``item_id``, a row for each item that holds the window."""
    items = windows.select(F.col("text").alias("window"), "item_id").distinct()
    return hits.join(F.broadcast(items) if items.count() <= BROADCAST_ITEMS else items, "window")


def _windows(docs: DataFrame, bench: DataFrame, item_col: str, item_text_col: str, n: int) -> DataFrame:
    items = bench.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("words"))
    return Scratch(docs.sparkSession, "decontaminate").put(item_windows(items, n), "windows")


def contamination_hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", n: int = N) -> DataFrame:
    """``(doc_id, text_hash, item_id, first, length)``: where a window of an item lies in a document, first from 0, verified word by word."""
    windows = _windows(docs, bench, item_col, item_text_col, n)
    return _with_items(window_hits(docs, windows, id_col, text_col, n), windows).select("doc_id", "text_hash", "item_id", "first", "length").distinct()


def contaminated_documents(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           item_col: str = "item_id", item_text_col: str = "text", n: int = N) -> DataFrame:
    """``(doc_id, text_hash)`` of the documents with any hit."""
    return window_hits(docs, _windows(docs, bench, item_col, item_text_col, n), id_col, text_col, n).select("doc_id", "text_hash").distinct()


def decontamination_report(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           item_col: str = "item_id", item_text_col: str = "text", n: int = N) -> DataFrame:
    """Docs' own columns plus ``n_words, n_hit, n_items, items, contaminated``.

    Null and empty texts have no words. Rows that share id and text have the
    same result; rows without an id are judged like any other. Items without
    words match nothing; repeated items count by id. Hit positions are
    counted once however many windows cover them. No documents give none, no
    items leave all clean. Columns named like the new ones are replaced. A
    row holds its own text's hits alone, so texts of any length, and of one
    word all through, take memory in proportion to their words.
    """
    windows = _windows(docs, bench, item_col, item_text_col, n)
    hits = Scratch(docs.sparkSession, "decontaminate").put(window_hits(docs, windows, id_col, text_col, n), "hits")
    items = _with_items(hits, windows).select("doc_id", "text_hash", F.lit(None).cast("struct<first:int,length:int>").alias("at"), F.col("item_id").cast("string").alias("item")).distinct()
    places = hits.select("doc_id", "text_hash", F.struct("first", "length").alias("at"), F.lit(None).cast("string").alias("item"))
    found = places.unionByName(items).groupBy(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).agg(
        F.sort_array(F.collect_set("at")).alias("at"), F.sort_array(F.collect_set("item")).alias("items"))
    # by ascending first word: what a window adds beyond the end of those before it
    covered = F.aggregate(
        "at", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["first"] + x["length"]).alias("end"),
                              (s["n"] + F.greatest(x["first"] + x["length"] - F.greatest(s["end"], x["first"]), F.lit(0))).alias("n")), lambda s: s["n"])
    found = found.select("__doc", "__hash", covered.cast("long").alias("n_hit"), "items")
    own = [c for c in docs.columns if c not in ("n_words", "n_hit", "n_items", "items", "contaminated")]
    base = docs.select(*own, F.col(id_col).alias("__id"), F.xxhash64(whole(F.col(text_col))).alias("__th"),
                       F.size(raw_words(F.col(text_col))).cast("long").alias("n_words"))
    return base.join(found, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__th") == F.col("__hash")), "left").select(
        *own, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, bench: DataFrame, mode: str = "document", **names) -> DataFrame:
    """Docs without contaminated documents, or (``mode="span"``) with hit words removed, each with what parts it from the next; the rest stays as it was, without blanks at its end if words went there."""
    id_col, text_col = names.get("id_col", "doc_id"), names.get("text_col", "text")
    if mode == "document":
        return decontamination_report(docs, bench, **names).where(~F.col("contaminated")).select(*docs.columns)
    hits = contamination_hits(docs, bench, **names)
    spans = hits.select("doc_id", "text_hash", F.explode(F.sequence("first", F.col("first") + F.col("length") - 1)).alias("p"))
    spans = spans.groupBy(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).agg(F.collect_set("p").alias("__hit"))
    part = NOT_WORD.removesuffix("+")
    w = F.regexp_extract_all(F.col(text_col), F.lit(f"[^{part[1:]}+{NOT_WORD.removesuffix('+')}*"), 0)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(w) - 1), F.col("__hit")), lambda i: F.element_at(w, i + 1))
    left = F.concat(F.regexp_extract(F.col(text_col), f"\\A{part}*", 0), F.array_join(kept, ""))
    left = F.when(F.array_contains("__hit", F.size(w) - 1), F.regexp_replace(left, r"\s+\z", "")).otherwise(left)
    out = docs.withColumns({"__id": F.col(id_col), "__th": F.xxhash64(whole(F.col(text_col)))})
    out = out.join(spans, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__th") == F.col("__hash")), "left")
    return out.select(*[F.when(F.col("__hit").isNull(), F.col(c)).otherwise(left).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontamination_report(docs, bench).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.doc_id, bw.item_id, dw.i, dw.n FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
