"""Quality scores by Bradley-Terry ranking.

A better document is preferred to a worse one with the probability
``sigmoid(w . (x_better - x_worse))``; w is fitted on pairs of labelled
documents by logistic loss on feature differences. The cut lies at the score
quantile that the labels' share of worse documents names, and scores are put
on a scale from 0 to 1 on which the cut is ``CUT``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.text import whole

CUT = 0.3
#: Classes of bytes whose bigrams are counted: blank, line feed, digit, lower, upper, then marks by kind, and bytes beyond ASCII.
_CLASS = np.full(256, 12, np.uint8)
for _i, _chars in enumerate([" \t\r", "\n", "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".", ",;:", "!?", "'\"()[]{}", "|", "*#$%&^~@", "<>/\\=+-_"]):
    for _c in _chars.encode():
        _CLASS[_c] = _i
_CLASS[128:] = 13
N_CLASSES = 14
NAMES = ["log_bytes", "log_words", "word_length", "distinct", "distinct_root", "repeated_next", "distinct_lines", "line_words", "capital_first", "longest_word"]


def features(texts: list[str]) -> np.ndarray:
    """A row for each text: shape of words and lines, then shares of byte-class bigrams. Empty texts have zeros."""
    out = np.zeros((len(texts), len(NAMES) + N_CLASSES * N_CLASSES), np.float64)
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "replace")
        words = raw.split()
        if not words:
            continue
        n, lines = len(words), raw.split(b"\n")
        distinct = len(set(words))
        size = len(raw)
        letters = sum(map(len, words))
        out[i, : len(NAMES)] = (
            np.log1p(size), np.log1p(n), letters / n, distinct / n, distinct / np.sqrt(n), sum(map(bytes.__eq__, words, words[1:])) / n,
            len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(map(bytes.istitle, words)) / n, np.log1p(max(map(len, words))))
        k = _CLASS[np.frombuffer(raw, np.uint8)]
        if size > 1:
            out[i, len(NAMES) :] = np.sqrt(np.bincount(k[:-1] * np.uint8(N_CLASSES) + k[1:], minlength=N_CLASSES * N_CLASSES) / (size - 1))
    return out


class Ranker:
    """Weights, and the scale on which the cut is ``CUT``."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = 40_000, penalty: float = 1e-3, rounds: int = 12, seed: int = 5):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.w, self.cut, self.slope = np.zeros(x.shape[1]), 0.0, 1.0
        if not len(better) or not len(worse):
            return
        z, rng = self._scaled(x), np.random.default_rng(seed)
        a, b = rng.permutation(np.resize(better, max(pairs, len(better))))[:pairs], rng.permutation(np.resize(worse, max(pairs, len(worse))))[:pairs]
        d = (z[a] - z[b]).astype(np.float32)
        for _ in range(rounds):  # Newton's steps on the logistic loss
            p = 1 / (1 + np.exp(-np.clip(d @ self.w.astype(np.float32), -30, 30)))
            grad = d.T @ (1 - p) / len(d) - penalty * self.w
            curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(self.w))
            step = np.linalg.solve(curve.astype(np.float64), grad.astype(np.float64))
            self.w = self.w + step
            if np.abs(step).max() < 1e-4:
                break
        s = z @ self.w
        self.cut = float(np.quantile(s, (y == 0).mean()))
        spread = float(np.median(s[better]) - np.median(s[worse]))
        self.slope = 8 / spread if spread > 0 else 1.0

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = self.slope * (self._scaled(x) @ self.w - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string")) % 5


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_labels: int = 20_000) -> Ranker:
    """A ranker from at most ``most_labels`` labelled documents outside fold 0, those whose ids have the least hashes; of rows that share an id one teaches, however many there are."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(F.col(id_col)) != 0))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(most_labels)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["__id"], "label": pdf["__label"], "x": [r.tobytes() for r in features(pdf["text"].tolist()).astype(np.float32)]})

    got = (
        docs.select(F.col(id_col).alias("__id"), whole(F.col(text_col)).alias("text")).join(F.broadcast(known), "__id")
        .select(F.col("__id").cast("long"), F.col("__label").cast("int"), "text").mapInPandas(rows, "id long, label int, x binary")
        .groupBy("id", "label").agg(F.min("x").alias("x")).toPandas())
    got = got.sort_values(["id", "x"])
    x = np.stack([np.frombuffer(b, np.float32) for b in got["x"]]).astype(np.float64) if len(got) else np.zeros((1, len(NAMES) + N_CLASSES**2))
    return Ranker(x, got["label"].to_numpy() if len(got) else np.array([1]))


def score(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; null texts are empty, a null id is never held out."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": ranker.score(features(texts))})

    return (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), whole(F.col(text_col)).alias("text"))
        .mapInPandas(rows, "doc_id long, held_out boolean, score double")
        .withColumn("predicted", (F.col("score") >= CUT).cast("int")))


def op4_bradley_terry(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score(docs, fit(docs, labels))
