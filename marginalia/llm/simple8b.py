"""Simple-8b coding of token ids, and shards of documents in it.

A 64-bit word has a 4-bit selector on top and 60 bits of ids, as many as fit
at one width. Selector 0 is the escape: the next word is one id as it is, for
ids of over 60 bits. Blocks of ``BLOCK`` ids start at recorded words, so that
a block is decoded alone and all words of one selector at once.

A shard, all little-endian: ``S8B1``, uint32 block size, uint64 documents,
uint64 ids, uint64 blocks; then int64 doc_id and uint64 number of ids for each
document, uint64 first word for each block and one past the last, and the
words. A doc_id of -2**63 stands for a document without one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm import encoding
from marginalia.llm.text import whole
from marginalia.scratch import Scratch

BLOCK = 1024
#: Ids in a word and bits of each, by selector; 0 is the escape.
SELECTORS = [(1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_WIDTH = np.frexp(np.arange(1 << 17, dtype=np.float64))[1].astype(np.uint8)
NO_ID = -(1 << 63)
_MAGIC, _HEAD = b"S8B1", struct.Struct("<4sIQQQ")


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, as uint8."""
    if ids.dtype.itemsize <= 4 or int(ids.max()) < 1 << 32:
        small = ids.astype(np.uint32)
        if int(small.max()) < len(_WIDTH):
            return _WIDTH[small]
        return np.frexp(small.astype(np.float64))[1].astype(np.uint8)
    high = ids >> np.uint64(32)
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, low).astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """uint64 words, and each block's first word with one past the last."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    most, row = 120, BLOCK + 120  # zeros follow each block, so that its last word may run over its end
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = ids
    padded = np.zeros((blocks, row), np.uint64)
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    flat_width = np.zeros(blocks * BLOCK, np.uint8)
    flat_width[:n] = _widths(ids)
    width = np.zeros((blocks, row + most), np.uint8)
    width[:, :BLOCK] = flat_width.reshape(blocks, BLOCK)

    def widest(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        """The largest of a's window and b's window ``shift`` later."""
        size = min(a.shape[1], b.shape[1] - shift)
        return np.maximum(a[:, :size], b[:, shift : shift + size])

    over = {1: width}  # the largest width among so many ids from here on
    for k, (i, j) in {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (3, 2), 6: (3, 3), 7: (4, 3), 8: (4, 4), 10: (5, 5), 12: (6, 6), 15: (8, 7), 20: (10, 10), 30: (15, 15), 60: (30, 30), 120: (60, 60)}.items():
        over[k] = widest(over[i], over[j], i)
    chosen = np.where(width[:, :BLOCK] <= 60, np.uint8(15), np.uint8(0))
    for s in range(14, 0, -1):
        count, bits = SELECTORS[s]
        np.putmask(chosen, over[count][:, :BLOCK] <= bits, np.uint8(s))
    take = np.array([c for c, _ in SELECTORS], np.int64)
    length = np.full(blocks, BLOCK, np.int64)
    length[-1] = n - (blocks - 1) * BLOCK
    rows, at = np.arange(blocks), np.zeros(blocks, np.int64)
    starts, picks, owners = [], [], []
    while len(rows):
        s = chosen[rows, at]
        starts.append(rows * row + at)
        picks.append(s)
        owners.append(rows)
        at = at + take[s]
        on = at < length[rows]
        if not on.all():
            rows, at = rows[on], at[on]
    start, pick, owner = np.concatenate(starts), np.concatenate(picks), np.concatenate(owners)
    order = np.argsort(start, kind="stable")
    start, pick, owner = start[order], pick[order], owner[order]
    size = np.where(pick == 0, 2, 1)
    place = np.cumsum(size) - size
    words, padded = np.zeros(int(size.sum()), np.uint64), padded.reshape(-1)
    for s, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(pick == s)
        if not len(mine):
            continue
        if s == 0:
            words[place[mine] + 1] = padded[start[mine]]
            continue
        word, first = np.full(len(mine), s << 60, np.uint64), start[mine]
        for k in range(count if bits else 0):
            word |= padded[first + k] << np.uint64(bits * k)
        words[place[mine]] = word
    offsets = np.zeros(blocks + 1, np.uint64)
    offsets[1:] = np.cumsum(np.bincount(owner, weights=size, minlength=blocks)).astype(np.uint64)
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ids of whole blocks, the last of which may be short of ``BLOCK``."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    pick = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for at in np.flatnonzero(pick == 0):  # escapes are rare; a raw word's own top bits say nothing
        if not raw[at]:
            raw[at + 1] = True
    head = np.flatnonzero(~raw)
    pick = pick[head]
    block = np.searchsorted(offsets, head.astype(np.uint64), side="right") - 1
    count = np.array([c for c, _ in SELECTORS])[pick]
    before = np.cumsum(count) - count
    first = np.searchsorted(block, np.arange(len(offsets) - 1))  # each block's first word among heads
    start = block * BLOCK + before - before[first][block]
    end = np.minimum((block + 1) * BLOCK, n)
    for s, (c, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(pick == s)
        if s == 0:
            out[start[mine]] = words[head[mine] + 1]
            continue
        for k in range(c if bits and len(mine) else 0):
            at = start[mine] + k
            inside = at < end[mine]
            out[at[inside]] = (words[head[mine]][inside] >> np.uint64(bits * k)) & np.uint64((1 << bits) - 1)
    return out


def pack_shard(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = encode(ids)
    head = _HEAD.pack(_MAGIC, BLOCK, len(doc_ids), len(ids), len(offsets) - 1)
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def unpack_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc_ids, counts, ids`` of one shard."""
    magic, block, docs, n, blocks = _HEAD.unpack_from(data)
    if magic != _MAGIC or block != BLOCK:
        raise ValueError("not a shard of this format")
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    counts = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
    offsets = np.frombuffer(data, "<u8", blocks + 1, at + 16 * docs)
    words = np.frombuffer(data, "<u8", offset=at + 16 * docs + 8 * (blocks + 1))
    return doc_ids, counts, decode(words, offsets, n)


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, style: str = "space", end_id: int | None = 2,
                       id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 1 << 19) -> None:
    """Encode whole texts in ascending id order into a table of shards ``(part, seq, part_start, n_docs, n_ids, shard)``.

    Documents are dealt by ranges of their id and the beginning of their text,
    so that one id with many rows is split, and sorted; a shard takes whole
    documents until it has ``shard_ids`` ids. The table is Parquet, so only
    whole parts are ever committed. Null texts are empty; ``end_id`` follows
    each document. Rows that share an id are ordered by their text and stay
    rows of their own; rows without an id come first and keep a null id. Other
    columns are not carried; an empty table gives a table without shards.
    """
    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_texts, part = encoding.encoder(tokenizer, style), TaskContext.get().partitionId()
        held, n, seq, done = [], 0, 0, 0

        def close():
            doc_ids, counts, ids = (np.concatenate(x) for x in zip(*held))
            return pd.DataFrame({"part": [part], "seq": [seq], "part_start": [done], "n_docs": [len(doc_ids)], "n_ids": [len(ids)], "shard": [pack_shard(doc_ids, counts, ids)]})

        for pdf in batches:
            texts, doc_ids = pdf["text"].tolist(), pdf["doc_id"].to_numpy(np.int64)
            for p in encoding.portions(texts, 1_000_000):
                ids, counts = encode_texts(texts[p])
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                held.append((doc_ids[p], counts, ids))
                n += len(ids)
                if n >= shard_ids:
                    yield close()
                    seq, done, held, n = seq + 1, done + n, [], 0
        if held:
            yield close()

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), whole(F.col(text_col)).alias("text"))
    (rows.withColumn("begin", F.substring("text", 1, 32)).repartitionByRange("doc_id", "begin").sortWithinPartitions("doc_id", "text").drop("begin")
     .mapInPandas(shards, "part int, seq int, part_start long, n_docs long, n_ids long, shard binary")
     .write.option("compression", "zstd").parquet(path))


def read_token_shards(spark, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, decoded from the shards. start counts all ids before it. No shards give no rows."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, part_start, data in zip(pdf["part"], pdf["part_start"], pdf["shard"]):
                doc_ids, counts, ids = unpack_shard(data)
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                yield pd.DataFrame({"part": np.full(len(doc_ids), part, np.int32), "doc_id": doc_ids, "at": part_start + ends - counts, "n_tokens": counts, "ids_crc32": np.array(crc, np.int64)})

    shards = spark.read.schema("part int, seq int, part_start long, n_docs long, n_ids long, shard binary").parquet(path)
    # one row for each part, of which there are no more than shuffle partitions
    base = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return (
        shards.select("part", "part_start", "shard").mapInPandas(rows, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
        .join(F.broadcast(base), "part")
        .select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def op2_simple8b(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = Scratch(spark, "tokens").path("shards")
    write_token_shards(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_shards(spark, path)
