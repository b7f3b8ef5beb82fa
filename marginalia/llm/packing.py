"""Best-fit packing refined by swap-based local search.

Pieces are dealt at random into groups of about ``group_bins`` sequences'
worth of tokens. A group is packed best fit, longest first; then documents of
its emptiest bins are moved to fuller ones, or exchanged one for one or two
for one, wherever that makes the fuller bin fuller. Each such step
increases the sum of squared fills, and the emptiest bins run empty. What
groups leave in underfull bins is packed again in fewer groups, until one
group has had all that is left or a round closes little of what it was given:
then the rest doesn't fill bins in any groups, and that round's bins stay.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import encoding
from marginalia.llm.text import whole
from marginalia.scratch import Scratch

MAX_TOKENS = 4096


def pieces(docs: DataFrame, tokenizer: str, style: str = "split", end_id: int = 1, max_tokens: int = MAX_TOKENS,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: int = 900_000) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document, longer ones cut every ``max_tokens``; ``ids`` on request.

    ``keep``: pieces of text whose ids a task remembers: fewer take less memory and more time, ids are the same.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_texts = encoding.encoder(tokenizer, style, keep)
        for pdf in batches:
            texts, doc_ids = pdf["text"].tolist(), pdf["doc_id"]
            for p in encoding.portions(texts):
                ids, counts = encode_texts(texts[p])
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                n = -(-counts // max_tokens)
                owner = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * max_tokens
                length = np.minimum(counts[owner] - start, max_tokens)
                at = (np.cumsum(counts) - counts)[owner] + start
                raw = memoryview(ids.tobytes())
                spans = list(zip((4 * at).tolist(), (4 * (at + length)).tolist()))
                out = pd.DataFrame({"doc_id": doc_ids.iloc[p].to_numpy()[owner], "piece": piece.astype(np.int32), "start": start, "length": length,
                                    "ids_crc32": np.array([zlib.crc32(raw[a:b]) for a, b in spans], np.int64)})
                if with_ids:
                    out["ids"] = [ids[a // 4 : b // 4].astype(np.int64) for a, b in spans]
                yield out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text")).mapInPandas(cut, schema)


def best_fit(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the bin with the least room that takes it."""
    bins, by_room, open_ = [], [[] for _ in range(room + 1)], 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_ >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_ ^= 1 << r
        else:
            r, b = room, len(bins)
            bins.append([])
        bins[b].append(i)
        r -= n
        if r:
            if not by_room[r]:
                open_ |= 1 << r
            by_room[r].append(b)
    return bins


def local_search(lengths: np.ndarray, bins: list[list[int]], room: int) -> list[list[int]]:
    """Empty the emptiest bins into fuller ones; returns bins without empty ones."""
    bin_of = np.zeros(len(lengths), np.int64)
    for b, items in enumerate(bins):
        bin_of[items] = b
    fill = np.bincount(bin_of, lengths, minlength=len(bins)).astype(np.int64)
    # only bins with room change; a source gives to fuller bins alone, so that each step increases the sum of squares
    for s in np.lexsort((np.arange(len(bins)), fill)):
        while 0 < fill[s] < room:
            into = (fill < room) & ((fill > fill[s]) | ((fill == fill[s]) & (np.arange(len(bins)) > s)))
            step = _best_step(lengths, bin_of, room - fill, np.flatnonzero(bin_of == s), np.flatnonzero(into[bin_of]), into)
            if step is None:
                break
            t, out, back = step
            bin_of[out], bin_of[back] = t, s
            gain = int(lengths[out].sum() - lengths[back].sum())
            fill[s] -= gain
            fill[t] += gain
    order = np.lexsort((np.arange(len(lengths)), bin_of))
    edges = np.flatnonzero(np.diff(bin_of[order])) + 1
    return [x.tolist() for x in np.split(order, edges) if len(x)]


def _best_step(lengths, bin_of, gaps, own, items, into):
    """``(bin, items to it, items back)``: a move, else the exchange that fills a fuller bin most; None if there is none."""
    if not into.any():
        return None
    own = own[np.argsort(-lengths[own], kind="stable")]
    size = lengths[own]
    targets = np.flatnonzero(into)
    if (fits := np.flatnonzero(size <= gaps[targets].max())).size:  # the longest that fits, into the least room for it
        i = fits[0]
        able = targets[gaps[targets] >= size[i]]
        return int(able[np.argmin(gaps[able])]), [int(own[i])], []
    other, gap = lengths[items], gaps[bin_of[items]]
    best, found = 0, None
    for i in range(len(own)):  # one for one
        gain = size[i] - other
        gain[(gain > gap) | (gain <= best)] = 0
        if len(gain) and gain.max() > 0:
            k = int(np.argmax(gain))
            best, found = int(gain[k]), (int(bin_of[items[k]]), [int(own[i])], [int(items[k])])
    if found:
        return found
    for i in range(len(own) - 1):  # two for one
        for j in range(i + 1, len(own)):
            gain = size[i] + size[j] - other
            gain[(gain > gap) | (gain <= 0)] = 0
            if len(gain) and gain.max() > 0:
                k = int(np.argmax(gain))
                return int(bin_of[items[k]]), [int(own[i]), int(own[j])], [int(items[k])]
    return None


def _pack_group(room: int, number: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32", "salt"]).reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins = local_search(lengths, best_fit(lengths, room), room)
        seq, offset, fill = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        group = int(pdf["grp"].iloc[0])
        for b, items in enumerate(bins):
            n = lengths[items]
            seq[items] = (number << 56) + (group << 24) + b
            offset[items] = np.cumsum(n) - n
            fill[items] = n.sum()
        return pdf.assign(sequence_id=seq, offset=offset, fill=fill)

    return pack


def pack(rows: DataFrame, max_tokens: int = MAX_TOKENS, group_bins: int = 1000, closed: float = 0.995, again: bool = True, least: float = 1 / 16) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, start, length, ids_crc32``.

    ``closed``: bins filled to this share are left as they are in later rounds.
    ``least``: a round that closes bins of less than this share of its tokens is the last.
    Rows longer than ``max_tokens`` are an error; equal rows stay rows of their
    own; no rows give none.
    """
    scratch = Scratch(rows.sparkSession, "packing")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    # the salt, written once, spreads rows that are equal
    left, done, number = scratch.put(rows.withColumn("salt", F.rand(7)), "pieces"), [], 0
    while True:
        tokens = left.agg(F.sum("length")).first()[0] or 0
        groups = max(1, -(-tokens // (max_tokens * group_bins)))
        dealt = left.withColumn("grp", F.pmod(F.xxhash64(F.lit(number), "salt"), F.lit(groups)))
        packed = scratch.put(dealt.groupBy("grp").applyInPandas(
            _pack_group(max_tokens, number), f"{schema}, salt double, grp long, sequence_id long, offset long, fill long"), "packed")
        full = F.col("fill") >= closed * max_tokens
        # a sequence id has 7 bits for the round
        if groups == 1 or not again or number == 127 or (packed.where(full).agg(F.sum("length")).first()[0] or 0) < least * tokens:
            done.append(packed)
            break
        done.append(packed.where(full))
        left, number = packed.where(~full).select(*rows.columns, "salt"), number + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("salt", "grp", "fill")


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text", keep: int = 900_000) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece of every document.

    Null texts are empty: their end id is packed all the same. Rows that share
    an id are packed each for itself; rows without one keep null. Empty tables
    give none. Further columns are not carried. ``keep``: see ``pieces``.
    """
    return pack(pieces(docs, tokenizer, max_tokens=max_tokens, id_col=id_col, text_col=text_col, keep=keep), max_tokens)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
