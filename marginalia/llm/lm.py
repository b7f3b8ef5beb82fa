"""LM scoring by online logistic context mixing.

A text is coded word by word, an end last. Frequent words (the head) are
leaves of a binary tree, others take the tree's escape; each bit on the way is
predicted under hashed contexts: the node alone, with the word before, and
with the two words before. A gate, how much is known of both contexts, chooses
the weights that combine them, and a second table, which adapts to how mixed
predictions turn out, refines the result. Weights and table are learnt online,
over all training tokens. A known rare word then costs its share of rare uses;
a new word is spelled, bit by bit, by a mix of the bytes before.

Tokens are dealt into shards by the word before, so all that a context has
seen lies in one shard: counts grow with the corpus and are never collected.
A word before that fills more than a shard is dealt by both words before, and
a pair that would still fill one by the portion of the input as well. What
such contexts have seen is counted over the whole corpus first and sent to
each of their shards, so no context knows only a part of its uses. A
training token is predicted from all training tokens but itself, so a passage
scores high only if it occurs elsewhere.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.encoding import _spread
from marginalia.llm.text import whole
from marginalia.scratch import Scratch

END = b"\n"  # no word holds a line feed
#: Words in the tree at most, and the uses that each of them has at least. Others are rare.
HEAD, HEAD_USES = 6_000, 5
#: Tokens in a shard, and in a portion of the input.
SHARD, PORTION = 250_000, 600_000
#: Weight of the shorter context's prediction in a context's own.
BACK = 2.0
#: How well a count is known, up to 256 and beyond.
_LEVEL = np.digitize(np.arange(257), [1, 2, 4, 16, 256]).astype(np.uint8)
GATES = 2 * 6 * 6
CELLS = 33
#: Bits of tokens that are worked on at once, so that arrays of a step stay in a core's cache.
STRETCH = 1 << 14
_START, _RARE = 0x7FFFFF, 0x800000
#: Bytes of context and bits of the table's size of the spelling's predictors. 0 bytes: the word so far.
PREDICTORS = [(1, 16), (2, 18), (3, 19), (5, 19), (0, 20)]
#: Longer words are spelled in pieces, side by side; a piece knows the bytes before it.
SEGMENT = 64
SPELL_GATES = 16 * 4
_PRIOR = [0.02] * 4 + [0.4]
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


# ---- mixing over tokens ------------------------------------------------------------------------------------------


class Code:
    """The way to each symbol in a binary tree, short for frequent ones: ``length[s]`` pairs ``node, bit`` from ``start[s]`` on.

    ``p``: each node's share of training uses under bit 1.
    """

    def __init__(self, uses: list[int]):
        uses = [max(1, int(u)) for u in uses]
        heap = [(u, i) for i, u in enumerate(uses)]
        heapq.heapify(heap)
        up, p, n = {}, [], len(uses)
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            node = len(p)
            up[x], up[y] = (node, 0), (node, 1)
            p.append(b / (a + b))
            heapq.heappush(heap, (a + b, n + node))
        ways = []
        for s in range(n):
            way, at = [], s
            while at in up:
                node, bit = up[at]
                way.append((node, bit))
                at = n + node
            ways.append(way[::-1])
        self.length = np.array([len(w) for w in ways], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.node = np.array([k for w in ways for k, _ in w], np.uint16)
        self.bit = np.array([b for w in ways for _, b in w], bool)
        self.p = np.array(p or [0.5], np.float32)


def context_counts(context: np.ndarray, some: np.ndarray | None, token: np.ndarray, node: np.ndarray, bit: np.ndarray, train: np.ndarray, room: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """How often, under the hash of its token's context and its node, each bit was coded in training and how often as 1, but for its own token. ``some``: tokens whose context is looked at."""
    bits = max(8, int(np.log2(len(token) + 1)) + room)
    hashed = context.astype(np.uint64) * _A
    slot, add, n = np.empty(len(token), np.int64), np.empty(len(token)), 0
    seen, ones = np.zeros(len(token), np.float32), np.zeros(len(token), np.float32)
    for s in _stretches(len(token)):
        k = slice(None) if some is None else some[token[s]]
        h = hashed[token[s][k]]
        h += node[s][k]
        h *= _B
        h ^= h >> np.uint64(29)
        h *= _C
        h >>= np.uint64(64 - bits)
        to = slice(n, n + len(h))
        slot[to] = h
        # a use adds 1, a one 2**26 more, so that both are counted at once
        add[to] = train[s][k] * (1 + bit[s][k] * float(1 << 26))
        n += len(h)
    table, n = np.bincount(slot[:n], add[:n], 1 << bits).astype(np.float64, copy=False), 0  # of nothing it has integers
    for s in _stretches(len(token)):
        k = slice(None) if some is None else some[token[s]]
        to = slice(n, n + (len(token[s]) if some is None else np.count_nonzero(k)))
        held = table[slot[to]]
        held -= add[to]
        one = np.floor(held * 2.0**-26)
        held -= one * 2.0**26
        seen[s][k], ones[s][k] = held, one
        n = to.stop
    return seen, ones


def _stretches(n: int) -> Iterator[slice]:
    for at in range(0, n, STRETCH):
        yield slice(at, at + STRETCH)


def whole_counts(counts: dict[int, tuple[np.ndarray, np.ndarray]], context: np.ndarray, token: np.ndarray, node: np.ndarray, bit: np.ndarray, train: np.ndarray, code: Code, seen: np.ndarray, ones: np.ndarray) -> None:
    """Replace what a shard has counted, under contexts that lie in several, by what the corpus has: ``counts[context]`` pairs symbols with their uses in training."""
    known = np.array(sorted(counts), np.int64)
    at = np.minimum(np.searchsorted(known, context), len(known) - 1)
    met = known[at] == context
    if not met.any():
        return
    total = np.zeros((2, len(known), len(code.p)), np.float32)
    for row in np.unique(at[met]):
        symbol, uses = counts[int(known[row])]
        steps, weight = _spread(code.start[symbol], code.length[symbol]), np.repeat(uses, code.length[symbol])
        total[0, row] = np.bincount(code.node[steps], weight, len(code.p))
        total[1, row] = np.bincount(code.node[steps], weight * code.bit[steps], len(code.p))
    first, flat = at * len(code.p), total.reshape(2, -1)
    for s in _stretches(len(token)):
        k = met[token[s]]
        cell, own = first[token[s][k]] + node[s][k], train[s][k]
        seen[s][k] = flat[0][cell] - own
        ones[s][k] = flat[1][cell] - (own & bit[s][k])


def _stretch(p: np.ndarray) -> np.ndarray:
    p = np.minimum(np.maximum(p, np.float32(1e-5)), np.float32(1 - 1e-5))
    return np.log(p / (1 - p))


class Gated:
    """Weights by gate, and the refining table by gate and cell of the mixed prediction."""

    def __init__(self, inputs: int):
        self.w = np.zeros((GATES, inputs), np.float32)
        self.w[:, -1] = 1.0  # the longest context, which backs off to shorter ones by itself
        self.squares = np.full(self.w.shape, 1e-4, np.float32)
        self.refine = np.tile((1 / (1 + np.exp(-np.linspace(-8, 8, CELLS)))).astype(np.float32), (GATES, 1))

    def mix(self, x: list[np.ndarray], gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z, g, columns = np.zeros(len(gate), np.float32), gate.astype(np.intp), np.ascontiguousarray(self.w.T)
        for w, xk in zip(columns, x):
            z += w[g] * xk
        z = np.minimum(np.maximum(z, np.float32(-7.999)), np.float32(7.999))
        return z, 1 / (1 + np.exp(-z))

    def learn(self, x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, rate: float = 0.05) -> None:
        """One step with a batch of bits: weights by their gradient over the root of its squares so far, cells towards what came."""
        z, p = self.mix(x, gate)
        error, at = bit - p, gate.astype(np.intp)
        for k, xk in enumerate(x):
            g = np.bincount(at, error * xk, GATES).astype(np.float32)
            self.squares[:, k] += g * g
            self.w[:, k] += rate * g / np.sqrt(self.squares[:, k])
        at = at * CELLS + np.round((z + 8) * 2).astype(np.intp)
        n, ones = np.bincount(at, minlength=GATES * CELLS), np.bincount(at[bit], minlength=GATES * CELLS)
        flat = self.refine.reshape(-1)
        flat += ((ones - n * flat) / (n + 200)).astype(np.float32)

    def predict(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z, p = self.mix(x, gate)
        at = (z + 8) * 2
        low = np.minimum(at.astype(np.int32), CELLS - 2)
        part = at - low
        cell, flat = gate.astype(np.intp) * CELLS + low, self.refine.reshape(-1)
        refined = flat[cell] * (1 - part) + flat[cell + 1] * part
        return np.clip((p + refined) / 2, 1e-6, 1 - 1e-6)


def pair_of(before: np.ndarray, before2: np.ndarray) -> np.ndarray:
    """A number for both words before, which is none of a word."""
    return (before.astype(np.int64) + 1 << 32) + before2


def mixed_scores(train: np.ndarray, before: np.ndarray, before2: np.ndarray, symbol: np.ndarray, code: Code, batch: int = 1 << 14, room: int = 0, counts: dict | None = None) -> np.ndarray:
    """log10 of each token's probability on the tree. train: whether tokens are learnt from; before, before2: numbers of the words before; counts: see ``whole_counts``."""
    n = len(symbol)
    if not n:
        return np.zeros(0)
    turn = np.random.default_rng(11).permutation(n)
    train, symbol = train[turn], symbol[turn]
    names = (before[turn].astype(np.int64), pair_of(before[turn], before2[turn]))
    one = np.unique(before[turn], return_inverse=True)[1]
    _, two, uses = np.unique(one.astype(np.uint64) << np.uint64(32) | before2[turn].astype(np.uint64), return_inverse=True, return_counts=True)
    length = code.length[symbol]
    token = np.repeat(np.arange(n, dtype=np.int32), length)
    at = _spread(code.start[symbol], length)
    node, bit = code.node[at], code.bit[at]
    del at
    x, p, own = [np.empty(len(token), np.float32)], code.p, train[token]
    by_node = _stretch(p)
    for s in _stretches(len(token)):
        x[0][s] = by_node[node[s]]
    gate, alike = np.zeros(len(token), np.uint8), None
    for step, (context, some) in enumerate(((one, None), (two, uses[two] > 1))):
        shared = {c: n for c, n in (counts or {}).items() if (c >> 32 > 0) == step}
        if shared:  # what the corpus has counted isn't counted here
            alone = ~np.isin(names[step], list(shared))
            some = alone if some is None else some & alone
        seen, ones = context_counts(context, some, token, node, bit, own, room)
        if shared:
            whole_counts(shared, names[step], token, node, bit, own, code, seen, ones)
        x.append(np.empty(len(token), np.float32))
        for s in _stretches(len(token)):
            # the shorter context's prediction: of the node alone first, then what the step before has left here
            back = p[node[s]] if alike is None else alike[s]
            own_p = (ones[s] + np.float32(BACK) * back) / (seen[s] + np.float32(BACK))
            x[-1][s] = _stretch(own_p)
            gate[s] += _LEVEL[np.minimum(seen[s], 256).astype(np.intp)] * np.uint8(6**step)
            ones[s], seen[s] = own_p, (ones[s] == 0) | (ones[s] == seen[s])
        alike, sure = ones, seen
    gate += sure.astype(np.uint8) * np.uint8(36)
    gated = Gated(len(x))
    for a in range(0, len(token), batch):
        k = np.flatnonzero(own[a : a + batch]) + a
        if len(k):
            gated.learn([xk[k] for xk in x], gate[k], bit[k])
    out = np.zeros(n)
    for s in _stretches(len(token)):
        q = gated.predict([xk[s] for xk in x], gate[s])
        low, high = token[s][0], token[s][-1] + 1
        out[low:high] += np.bincount(token[s] - low, np.log10(np.where(bit[s], q, 1 - q)), high - low)
    back = np.zeros(n)
    back[turn] = out
    return back


# ---- spelling of new words ---------------------------------------------------------------------------------------


def segments(tokens: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """What is spelled for each token, whose each piece is, and the eight bytes before it as a number."""
    if max(map(len, tokens), default=0) < SEGMENT:
        return [t if t == END else t + b" " for t in tokens], np.arange(len(tokens)), np.zeros(len(tokens), np.uint64)
    out, owner, past = [], [], []
    for i, t in enumerate(tokens):
        t = t if t == END else t + b" "
        for at in range(0, len(t), SEGMENT):
            out.append(t[at : at + SEGMENT])
            owner.append(i)
            past.append(int.from_bytes(t[max(0, at - 8) : at], "big"))
    return out, np.array(owner, np.int64), np.array(past, np.uint64)


def walk(pieces: list[bytes], past: np.ndarray):
    """``(rows, bit, previous byte, position, slots)`` for every bit of every piece: slots has an array for each predictor."""
    size = np.array([len(p) for p in pieces])
    order = np.argsort(-size, kind="stable")
    width = int(size.max())
    grid = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(pieces), width)
    sizes, past, so_far = size[order], past[order], past[order] + np.uint64(7)
    for p in range(width):
        m = int(np.searchsorted(-sizes, -p, side="left"))  # pieces longer than p
        rows, now = order[:m], grid[:m, p].astype(np.uint64)
        past, so_far = past[:m], so_far[:m]
        base = [(so_far if not k else (past & np.uint64((1 << 8 * k) - 1)) + np.uint64(k)) * _A for k, _ in PREDICTORS]
        before = (past & np.uint64(255)).astype(np.int64)
        node = np.ones(m, np.uint64)
        for shift in range(7, -1, -1):
            step = node * _B
            slots = []
            for b, (_, bits) in zip(base, PREDICTORS):
                h = b + step
                h ^= h >> np.uint64(29)
                h *= _C
                h >>= np.uint64(64 - bits)
                slots.append(h.view(np.int64))
            bit = (now >> np.uint64(shift)) & np.uint64(1)
            yield rows, bit.astype(np.float32), before, p, slots
            node = node * np.uint64(2) + bit
        past = (past << np.uint64(8)) | now
        so_far = (so_far ^ now) * _C + np.uint64(1)


def portions(tokens: list[bytes], most: int = 20_000) -> Iterator[slice]:
    for at in range(0, len(tokens), most):
        yield slice(at, at + most)


def empty_tables() -> list[list[np.ndarray]]:
    return [[np.zeros(1 << bits, np.float32) for _, bits in PREDICTORS] for _ in range(2)]


def count_spellings(tokens: list[bytes], n: list[np.ndarray], ones: list[np.ndarray]) -> None:
    """Add each token's bits, once, to the tables of all predictors."""
    pieces, _, past = segments(tokens)
    met = [([], []) for _ in PREDICTORS]
    for _, bit, _, _, slots in walk(pieces, past):
        for k, s in enumerate(slots):
            met[k][0].append(s), met[k][1].append(bit)
    for k, (s, b) in enumerate(met):
        s = np.concatenate(s)
        n[k] += np.bincount(s, minlength=len(n[k])).astype(np.float32)
        ones[k] += np.bincount(s, np.concatenate(b), len(n[k])).astype(np.float32)


class Speller:
    """Predictions of all predictors under the bytes before, the gated weights and the refining table.

    ``stretched[k][v]``: predictor k's prediction by slot, from all counts (v = 0) or without one use of bit 0 (1) or 1 (2).
    """

    def __init__(self, n: list[np.ndarray], ones: list[np.ndarray]):
        less = [(0, 0), (1, 0), (1, 1)]
        self.stretched = [np.stack([np.log((np.clip(o - b, 0, np.maximum(t - a, 0)) + prior) / (np.maximum(np.maximum(t - a, 0) - np.maximum(o - b, 0), 0) + prior)) for a, b in less]).astype(np.float32)
                          for t, o, prior in zip(n, ones, _PRIOR)]
        self.sure = np.stack([np.minimum(np.log2(np.maximum(n[-1] - a, 0) + 1), 15) for a, _ in less]).astype(np.int8)
        self.start()

    def start(self) -> Speller:
        """Weights as they are until they are learnt: long contexts before short ones, and the word so far once it is known."""
        self.w = np.array([[0.0, 0.1, 0.2, 0.2, 1 - 0.5 / (g // 4 + 1)] if g >= 4 else [0.1, 0.2, 0.3, 0.4, 0.0] for g in range(SPELL_GATES)], np.float32)
        grid = 1 / (1 + np.exp(-np.linspace(-8, 8, CELLS)))
        self.refine, self.steps = np.tile(grid, (256, 1)), 0
        return self

    def _inputs(self, slots, bit, own):
        """Stretched predictions, and how much the word so far is known. own: 1 for what was counted once itself."""
        v = (own * (1 + bit)).astype(np.int64)
        x = [t.reshape(-1)[v * t.shape[1] + s] for t, s in zip(self.stretched, slots)]
        return x, self.sure.reshape(-1)[v * self.sure.shape[1] + slots[-1]].astype(np.int64)

    def _mix(self, x, gate):
        z = np.zeros(len(gate), np.float32)
        for w, xk in zip(np.ascontiguousarray(self.w.T), x):
            z += w[gate] * xk
        p = 1 / (1 + np.exp(-np.minimum(np.maximum(z, np.float32(-14)), np.float32(14)).astype(np.float64)))
        return np.minimum(np.maximum(p, 1e-6), 1 - 1e-6)

    def _refined(self, p, before):
        at = np.minimum(np.maximum((np.log(p / (1 - p)) + 8) * 2, 0), 31.999)
        low = at.astype(np.int64)
        part, cell, flat = at - low, before * CELLS + low, self.refine.reshape(-1)
        r = flat[cell] * (1 - part) + flat[cell + 1] * part
        return np.minimum(np.maximum(0.75 * p + 0.25 * r, 1e-6), 1 - 1e-6), low + (part > 0.5)

    def learn(self, tokens: list[bytes], batch: int = 4096, rate: float = 0.02) -> np.ndarray:
        """Online, batch by batch, from tokens that were each counted once: log10 of each token's probability before it was learnt from."""
        out = np.zeros(len(tokens))
        for at in range(0, len(tokens), batch):
            pieces, owner, past = segments(tokens[at : at + batch])
            speed, self.steps = rate / (1 + self.steps / 40), self.steps + 1
            total, own = np.zeros(len(pieces)), np.float32(1)
            for rows, bit, before, p, slots in walk(pieces, past):
                x, sure = self._inputs(slots, bit, own)
                gate = sure * 4 + min(p, 3)
                mixed = self._mix(x, gate)
                q, cell = self._refined(mixed, before)
                total[rows] += np.log10(np.where(bit > 0, q, 1 - q))
                pull = speed * (bit - mixed) / np.sqrt(np.bincount(gate, minlength=SPELL_GATES)[gate])
                for k, xk in enumerate(x):
                    self.w[:, k] += np.bincount(gate, pull * xk, SPELL_GATES)
                at_cell, n_before = before * CELLS + cell, np.bincount(before, minlength=256)
                flat = self.refine.reshape(-1)
                flat += np.bincount(at_cell, 0.02 * (bit - flat[at_cell]) / np.sqrt(n_before[before]), len(flat))
            np.clip(self.refine, 1e-5, 1 - 1e-5, out=self.refine)
            out[at : at + batch] = np.bincount(owner, total, minlength=len(tokens[at : at + batch]))
        return out

    def score(self, tokens: list[bytes], counted: np.ndarray) -> np.ndarray:
        """log10 of each token's probability; counted: whether the tables hold the token itself, which is then left out."""
        out = np.zeros(len(tokens))
        for part in portions(tokens):
            pieces, owner, past = segments(tokens[part])
            own, total = counted[part][owner].astype(np.float32), np.zeros(len(pieces))
            for rows, bit, before, p, slots in walk(pieces, past):
                x, sure = self._inputs(slots, bit, own[rows])
                q, _ = self._refined(self._mix(x, sure * 4 + min(p, 3)), before)
                total[rows] += np.log10(np.where(bit > 0, q, 1 - q))
            out[part] += np.bincount(owner, total, minlength=len(tokens[part]))
        return out


# ---- Spark -------------------------------------------------------------------------------------------------------


def vocabulary(docs: DataFrame) -> DataFrame:
    """``(word, n, c)`` of all tokens of ``(learns boolean, text)``: uses, and uses in texts that are learnt from."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {True: Counter(), False: Counter()}

        def out():
            for learns, counter in held.items():
                if counter:
                    n = np.fromiter(counter.values(), np.int64, len(counter))
                    yield pd.DataFrame({"word": list(counter), "n": n, "c": n * learns})
                    counter.clear()

        for pdf in batches:
            for learns, text in zip(pdf["learns"], pdf["text"]):
                own = held[bool(learns)]
                own.update(words_of(text))
                own[END] += 1
                if len(own) > 300_000:
                    yield from out()
        yield from out()

    return docs.mapInPandas(count, "word binary, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def cut(words: DataFrame, column: str, most: int) -> int:
    """The least value such that no more than ``most`` rows have it or more, to within a 64th of an octave; from a histogram of logarithms."""
    bins = words.groupBy(F.floor(F.log2(column) * 64).alias("bin")).agg(F.count("*").alias("rows")).collect()
    held = 0
    for b, rows in sorted(map(tuple, bins), reverse=True):
        held += rows
        if held > most:
            return int(np.ceil(2 ** ((b + 1) / 64) - 1e-9))
    return 1


def spelling_tables(words: DataFrame, task_words: int = 1_000_000) -> Speller:
    """A speller that has counted every ``word`` once. Tables are hashed, of a fixed size, so each task sums its share first; some 24 MB reach the driver."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, ones = empty_tables()
        for pdf in batches:
            tokens = list(map(bytes, pdf["word"]))
            for part in portions(tokens):
                count_spellings(tokens[part], n, ones)
        for k in range(len(PREDICTORS)):
            at = np.flatnonzero(n[k])
            for i in range(0, len(at), 200_000):
                a = at[i : i + 200_000]
                yield pd.DataFrame({"k": np.full(len(a), k, np.int32), "slot": a.astype(np.int32), "n": n[k][a].astype(np.float64), "ones": ones[k][a].astype(np.float64)})

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        n, ones = np.zeros(1 << 16, np.float32), np.zeros(1 << 16, np.float32)
        at = pdf["slot"] & 0xFFFF
        n[at], ones[at] = pdf["n"], pdf["ones"]
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "block": [int(pdf["slot"].iloc[0]) >> 16], "n": [n.tobytes()], "ones": [ones.tobytes()]})

    dealt = words.select("word").repartition(max(1, -(-words.count() // task_words)))
    sums = dealt.mapInPandas(count, "k int, slot int, n double, ones double").groupBy("k", "slot").agg(F.sum("n").cast("float").alias("n"), F.sum("ones").cast("float").alias("ones"))
    n, ones = empty_tables()
    for r in sums.groupBy("k", F.shiftright("slot", 16).alias("block")).applyInPandas(block, "k int, block int, n binary, ones binary").toLocalIterator():
        at = slice(r["block"] << 16, (r["block"] + 1) << 16)
        n[r["k"]][at], ones[r["k"]][at] = np.frombuffer(r["n"], np.float32), np.frombuffer(r["ones"], np.float32)
    return Speller(n, ones)


def spelled(words: DataFrame, speller, chunk: int = 200_000) -> DataFrame:
    """``(word, n, c, spell)`` of ``(word, n, c)``. Each task goes on learning the weights online: a training word is scored, then learnt from; the others of a ``chunk`` follow."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, held = speller.value.start(), []

        def scored() -> pd.DataFrame:
            part = pd.concat(held)
            held.clear()
            tokens, counted = list(map(bytes, part["word"])), part["c"].to_numpy() > 0
            spell = np.zeros(len(tokens))
            spell[counted] = own.learn([t for t, c in zip(tokens, counted) if c])
            spell[~counted] = own.score([t for t, c in zip(tokens, counted) if not c], np.zeros((~counted).sum()))
            return part.assign(spell=spell)

        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= chunk:
                yield scored()
        if held:
            yield scored()

    return words.mapInPandas(score, "word binary, n long, c long, spell double")


class Near:
    """Frequent words by number, those of the tree first, and what is known of each."""

    def __init__(self, top: pd.DataFrame, least: int, shard: int, shards: int):
        top = top.sort_values(["c", "word"], ascending=[False, True])
        self.place = {bytes(w): i for i, w in enumerate(top["word"])}
        self.heads = int((top["c"] >= least).sum())
        self.known, self.base = top["c"].to_numpy() > 0, top["base"].to_numpy()
        self.rare = top[["rare_held", "rare_train"]].to_numpy()
        # words before that fill more than a shard, the beginning of a text last, and how many shards each fills
        hot = [(i, int(n)) for i, n in enumerate(top["n"]) if n > shard]
        starts = int(top.loc[top["word"].map(bytes) == END, "n"].sum())
        hot += [(_START, starts)] * (starts > shard)
        self.contexts = np.array([i for i, _ in hot], np.int64)
        self.hot_at = np.full(len(top) + 1, -1, np.int32)  # the last for rare words
        self.hot_at[self.contexts[self.contexts != _START]] = np.arange(len(hot) - (starts > shard))
        self.hot_start = len(hot) - 1 if starts > shard else -1
        self.ways = np.array([min(shards, -(-n // shard)) for _, n in hot], np.int64)
        self.shards = shards

    def hot(self, before: np.ndarray) -> np.ndarray:
        """Which of the hot contexts each word before is; -1: none."""
        out = self.hot_at[np.minimum(before, len(self.hot_at) - 1)]
        out[before == _START] = self.hot_start
        return out

    def symbols(self, word: np.ndarray) -> np.ndarray:
        return np.where(word >= self.heads, self.heads, word)


class Pairs:
    """Pairs of words before that may fill more than a shard, by number, and how many shards each fills."""

    def __init__(self, rows: list[tuple[int, int]], near: Near, shard: int):
        rows = sorted(rows)
        self.contexts = np.array([c for c, _ in rows], np.int64)
        self.ways = np.array([min(near.shards, -(-4 * n // (3 * shard))) for _, n in rows], np.int64)

    def find(self, pair: np.ndarray) -> np.ndarray:
        if not len(self.contexts):
            return np.full(len(pair), -1)
        at = np.minimum(np.searchsorted(self.contexts, pair), len(self.contexts) - 1)
        return np.where(self.contexts[at] == pair, at, -1)

    def targets(self, near: Near) -> dict[int, list[int]]:
        """The shards in which each hot word and pair is met."""
        n = near.shards
        out = {int(c): {(h + k) % n for k in range(w)} for c, w, h in zip(near.contexts, near.ways, _mixing(near.contexts.astype(np.uint64)).astype(np.int64).tolist())}
        for c, w, h in zip(self.contexts, self.ways, _mixing(self.contexts.astype(np.uint64)).astype(np.int64).tolist()):
            out[int(c)] = {(h + k) % n for k in range(w)}
            out[(int(c) >> 32) - 1] |= out[int(c)]
        return {c: sorted(map(int, found)) for c, found in out.items()}


_DOC = "idx int, doc_id long, no_id boolean, held_out boolean, n_tokens long, n_bytes long, n_known long, base_score double, score double, rare binary"
_DOC_COLUMNS = [c.split()[0] for c in _DOC.split(", ")]


def _mixing(number: np.ndarray) -> np.ndarray:
    h = number * _A
    return (h ^ (h >> np.uint64(29))) * _C >> np.uint64(33)


def _befores(word: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both words before each word of texts of the given sizes."""
    first = np.cumsum(size) - size
    before, before2 = np.empty_like(word), np.empty_like(word)
    before[1:], before2[2:] = word[:-1], word[:-2]
    before[first], before2[first] = _START, _START
    before2[(first + 1)[size > 1]] = _START
    return before, before2


class Uses:
    """Uses of each symbol in training under each of some contexts."""

    def __init__(self, contexts: np.ndarray, symbols: int):
        self.contexts, self.held = contexts, np.zeros((len(contexts), symbols), np.int64)

    def add(self, at: np.ndarray, symbol: np.ndarray) -> None:
        k, n = np.unique(at.astype(np.int64) * self.held.shape[1] + symbol, return_counts=True)
        self.held.reshape(-1)[k] += n

    def rows(self) -> Iterator[dict]:
        for context, row in zip(self.contexts, self.held):
            used = np.flatnonzero(row)
            if len(used):
                yield {"context": int(context), "words": used.astype("<u2").tobytes() + row[used].astype("<i8").tobytes()}


def _uses(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 10
    return np.frombuffer(data, "<u2", n).astype(np.int64), np.frombuffer(data, "<i8", n, 2 * n)


_ENCODED = "doc_id long, no_id boolean, held_out boolean, n_bytes long, rare binary, words binary, context long, uses long"
_NO_DOC = {"doc_id": 0, "no_id": False, "held_out": False, "n_bytes": 0, "rare": None}


def encoded_tokens(near, all_tokens: int, shard: int):
    """For ``mapInPandas``: texts as numbers of words, uses under hot contexts, and uses of pairs that may be hot.

    A pair of over ``shard`` uses has over three quarters of them in portions that tell them: others hold less than a quarter of their share.
    """
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = near.value
        uses, docs, numbers, n = Uses(v.contexts, v.heads + 1), [], [], 0

        def flush():
            nonlocal docs, numbers, n
            word, size = np.concatenate(numbers), np.array([len(x) for x in numbers])
            yield pd.DataFrame(docs, columns=["doc_id", "no_id", "held_out", "n_bytes", "rare"]).assign(words=[x.tobytes() for x in numbers], context=-1, uses=0)
            if len(v.contexts):
                before, before2 = _befores(word, size)
                at = v.hot(before)
                learns = np.repeat(~np.array([d[2] for d in docs], bool), size) & (at >= 0)
                uses.add(at[learns], v.symbols(word[learns]))
                both = np.flatnonzero((at >= 0) & ((v.hot(before2) >= 0) | (before2 == _START)))
                pair, met = np.unique(pair_of(before[both], before2[both]), return_counts=True)
                often = met >= shard * n / all_tokens / 4
                if often.any():
                    yield pd.DataFrame({"context": pair[often], "uses": met[often]}).assign(words=None, **_NO_DOC)
            docs, numbers, n = [], [], 0

        for pdf in batches:
            for doc_id, no_id, held_out, text in zip(pdf["doc_id"], pdf["no_id"], pdf["held_out"], pdf["text"]):
                tokens = words_of(text)
                tokens.append(END)
                at = np.fromiter(map(v.place.get, tokens, repeat(-1)), np.int64, len(tokens))
                rare = np.flatnonzero(at < 0)
                others = [tokens[i] for i in rare]
                word = at.astype(np.uint32)
                word[rare] = np.fromiter(map(zlib.crc32, others), np.uint32, len(others)) & 0x7FFFFFFF | 0x80000000
                docs.append((doc_id, no_id, held_out, len(text.encode("utf-8", "replace")), b"\n".join(others) if others else None))
                numbers.append(word)
                n += len(at)
                if n >= PORTION or len(docs) >= 60_000:
                    yield from flush()
        if docs:
            yield from flush()
        for row in uses.rows():
            yield pd.DataFrame([row]).assign(uses=0, **_NO_DOC)

    return encode


def _sizes(pdf: pd.DataFrame) -> np.ndarray:
    return np.fromiter(map(len, pdf["words"]), np.int64, len(pdf)) // 4


def _portions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Encoded texts, some 600,000 words and 60,000 texts at most at once."""
    held, n, rows = [], 0, 0
    for pdf in batches:
        size = _sizes(pdf)
        cuts = np.flatnonzero(np.diff((n + np.cumsum(size)) // PORTION, prepend=0) > 0).tolist()
        for a, b in zip([0, *[c + 1 for c in cuts]], [*[c + 1 for c in cuts], len(pdf)]):
            held.append(pdf.iloc[a:b])
            n, rows = n + int(size[a:b].sum()), rows + b - a
            if n >= PORTION or rows >= 40_000:
                yield pd.concat(held, ignore_index=True)
                held, n, rows = [], 0, 0
    if rows:
        yield pd.concat(held, ignore_index=True)


def pair_uses(near, pairs):
    """For ``mapInPandas``: uses in training under hot pairs."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, hot = near.value, pairs.value
        uses = Uses(hot.contexts, v.heads + 1)
        for pdf in _portions(batches):
            size = _sizes(pdf)
            word = np.frombuffer(b"".join(pdf["words"]), np.uint32)
            at = hot.find(pair_of(*_befores(word, size)))
            learns = np.repeat(~pdf["held_out"].to_numpy(bool), size) & (at >= 0)
            uses.add(at[learns], v.symbols(word[learns]))
        for row in uses.rows():
            yield pd.DataFrame([row])

    return count


def sent_counts(targets):
    """For ``applyInPandas``: a hot context's uses over the corpus, once for each shard that meets it."""
    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        symbol, n = (np.concatenate(x) for x in zip(*map(_uses, pdf["words"])))
        total = np.bincount(symbol, n).astype(np.int64)
        used, context = np.flatnonzero(total), int(pdf["context"].iloc[0])
        shards = targets.value[context]
        return pd.DataFrame({"shard": np.array(shards, np.int32), "context": context, "tokens": [used.astype("<u2").tobytes() + total[used].astype("<i8").tobytes()] * len(shards)})

    return send


def dealt_tokens(near, pairs):
    """For ``mapInPandas``: rows of documents, and packed tokens of a portion of them for each shard, from encoded texts."""
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, hot_pairs, part = near.value, pairs.value, TaskContext.get().partitionId()
        shards, escape = v.shards, v.heads
        for turn, docs in enumerate(_portions(batches)):
            portion = (part << 24) + turn
            size = _sizes(docs)
            word, held = np.frombuffer(b"".join(docs["words"]), np.uint32), docs["held_out"].to_numpy(bool)
            doc = np.repeat(np.arange(len(size)), size)
            rare = word >= 0x80000000
            own = np.where(rare, 0, word)
            known = np.bincount(doc, v.known[own] & ~rare, len(size)).astype(np.int64)
            base = np.bincount(doc, np.where(rare, 0, v.base[own]), len(size))
            cost = np.bincount(doc, np.where(rare | (own < v.heads), 0, v.rare[own, (~held[doc]).astype(np.int64)]), len(size))
            mixed = _mixing(np.array([portion], np.uint64))[0]
            yield docs[["doc_id", "no_id", "held_out", "n_bytes", "rare"]].assign(
                idx=np.arange(len(size), dtype=np.int32), shard=np.int32(mixed % np.uint64(shards)), portion=portion, n_tokens=size, n_known=known, base_score=base, score=cost, tokens=None, context=-1)
            before, before2 = _befores(word, size)
            to = _mixing(before.astype(np.uint64)) % np.uint64(shards)
            at = v.hot(before)
            hot = np.flatnonzero(at >= 0)
            if len(hot):
                pair = pair_of(before[hot], before2[hot])
                key = _mixing(pair.astype(np.uint64))
                to[hot] = (to[hot] + key % v.ways[at[hot]].astype(np.uint64)) % np.uint64(shards)
                which = hot_pairs.find(pair)
                k = np.flatnonzero(which >= 0)
                to[hot[k]] = (key[k] + mixed % hot_pairs.ways[which[k]].astype(np.uint64)) % np.uint64(shards)
            order = np.argsort((to << np.uint64(32)) + before, kind="stable")
            to = to[order]
            edges = np.flatnonzero(np.diff(to.astype(np.int64), prepend=-1))
            before2 = np.where(before2 >= 0x80000000, before2 & 0x7FFFFF | _RARE, before2)
            symbol = np.where(word >= v.heads, escape, own).astype(np.uint16) | ((~held[doc]).astype(np.uint16) << 15)
            doc, before, before2, symbol = doc[order].astype(np.uint16), before[order], before2[order], symbol[order]
            blobs = [_pack(doc[a:b], before[a:b], before2[a:b], symbol[a:b]) for a, b in zip(edges, [*edges[1:], len(to)])]
            blank = {"idx": 0, **_NO_DOC, "n_tokens": 0, "n_known": 0, "base_score": 0.0, "score": 0.0, "context": -1}
            for a in range(0, len(blobs), 1000):
                yield pd.DataFrame({"shard": to[edges[a : a + 1000]].astype(np.int32), "portion": portion, "tokens": blobs[a : a + 1000]}).assign(**blank)

    return deal


def _pack(doc, before, before2, symbol) -> bytes:
    """Arrays of one shard and portion, sorted by ``before``, byte by byte."""
    step = np.diff(before, prepend=np.uint32(0))
    planes = [x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in (doc, step, np.ascontiguousarray(before2.astype(np.uint32)), symbol)]
    data = b"".join(planes)
    return len(doc).to_bytes(4, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    n, at, out, kinds = int.from_bytes(data[:4], "little"), 0, [], (np.uint16, np.uint32, np.uint32, np.uint16)
    raw = pa.decompress(memoryview(data)[4:], n * sum(np.dtype(k).itemsize for k in kinds), "zstd", asbytes=True)
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    out[1] = np.cumsum(out[1], dtype=np.uint32)
    return out


def mixed_shard(code):
    """For ``applyInPandas``: a shard's tokens to sums for each portion's documents; rows of documents go through."""
    def mix(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = {int(r.context): _uses(r.tokens) for r in pdf[pdf["context"] >= 0].itertuples()}
        pdf = pdf[pdf["context"] < 0].drop(columns="context")
        tokens = pdf[pdf["tokens"].notna()].sort_values("portion")
        out = [pdf[pdf["tokens"].isna()].assign(sums=None).drop(columns=["shard", "tokens"])]
        if len(tokens):
            parts = list(map(_unpack, tokens["tokens"]))
            doc, before, before2, symbol = (np.concatenate(x) for x in zip(*parts))
            score = mixed_scores((symbol >> 15) > 0, before, before2, (symbol & 0x7FFF).astype(np.int64), code.value, counts=counts)
            sums, at = [], 0
            for d, *_ in parts:
                dense, used = np.bincount(d, score[at : at + len(d)]), np.flatnonzero(np.bincount(d))
                sums.append(used.astype("<u2").tobytes() + dense[used].astype("<f4").tobytes())
                at += len(d)
            out.append(tokens.assign(sums=sums).drop(columns=["shard", "tokens"]))
        return pd.concat(out)[["portion", *_DOC_COLUMNS, "sums"]]

    return mix


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    """A portion's documents with the sums of all shards."""
    docs, total = pdf[pdf["sums"].isna()].sort_values("idx"), np.zeros(int(pdf["idx"].max()) + 1)
    for data in pdf["sums"].dropna():
        n = len(data) // 6
        total[np.frombuffer(data, "<u2", n)] += np.frombuffer(data, "<f4", n, 2 * n)
    return docs.assign(score=docs["score"] + total[docs["idx"]]).drop(columns="sums")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = 150_000, shard: int = SHARD) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)`` for each row.

    Rows with crc32(id as text) mod 5 = 1 are held out of learning. Null texts
    are empty: an end alone. Rows without an id are learnt from and keep null;
    rows that share an id are rows of their own. base_score is an add-half
    unigram model of the same tokens. Empty tables give none. Other columns
    are not carried.

    ``frequent``: words that are broadcast, beside those of the tree; all others meet their scores by a
    join, in which no word has many rows. ``shard``: tokens in a shard.
    """
    spark = docs.sparkSession
    sc, scratch = spark.sparkContext, Scratch(spark, "lm")
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))
    number = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(number, F.lit(0)).alias("doc_id"), number.isNull().alias("no_id"), held.alias("held_out"), whole(F.col(text_col)).alias("text"))
    words = scratch.put(vocabulary(rows.select((~F.col("held_out")).alias("learns"), "text")), "words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    least = max(HEAD_USES, cut(words.where("c > 0"), "c", HEAD))
    tail = words.where(F.col("c") < least)
    of_tail = tail.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") == 1).alias("once")).first()
    speller = sc.broadcast(spelling_tables(tail.where("c > 0")))
    new = (of_tail["once"] + 0.5) / (of_tail["n"] + 1)
    base = F.log10((F.col("c") + 0.5) / F.lit(total["n"] + 0.5 * (total["v"] + 1)))

    def rare(uses, others: int):
        """What follows the escape: a known word by its share of rare uses, or a new one, spelled."""
        return F.when(uses > 0, F.log10(uses / F.lit(float(max(1, others)))) + float(np.log10(max(1e-9, 1 - new)))).otherwise(F.col("spell") + float(np.log10(new)))

    counted = words
    all_words = spelled(words.where("c <= 1"), speller).unionByName(words.where("c > 1").withColumn("spell", F.lit(0.0)))
    words = scratch.put(all_words.select("word", "n", "c", base.alias("base"), rare(F.col("c"), of_tail["n"]).alias("rare_held"), rare(F.col("c") - 1, of_tail["n"] - 1).alias("rare_train")), "scored")
    scratch.drop(counted)
    top = words.where((F.col("n") >= cut(words, "n", frequent)) | (F.col("c") >= least) | (F.col("word") == F.lit(END))).toPandas()
    shards = max(1, -(-total["all"] // shard))
    known = Near(top, least, shard, shards)
    uses = top.loc[top["c"] >= least, "c"].sort_values(ascending=False).tolist()
    code = sc.broadcast(Code([*uses, total["n"] - sum(uses)]))
    near = sc.broadcast(known)
    encoded = scratch.put(rows.mapInPandas(encoded_tokens(near, total["all"], shard), _ENCODED), "encoded")
    often = encoded.where("uses > 0").groupBy("context").agg(F.sum("uses").alias("uses")).where(F.col("uses") * 2 > shard)
    hot_pairs = Pairs([tuple(r) for r in often.collect()] if len(known.contexts) else [], known, shard)
    pairs, texts = sc.broadcast(hot_pairs), encoded.where("context < 0")
    counts = encoded.where("context >= 0 AND uses = 0").select("context", "words")
    if len(hot_pairs.contexts):
        counts = counts.unionByName(texts.mapInPandas(pair_uses(near, pairs), "context long, words binary"))
    sent = counts.groupBy("context").applyInPandas(sent_counts(sc.broadcast(hot_pairs.targets(known))), "shard int, context long, tokens binary")
    dealt = texts.mapInPandas(dealt_tokens(near, pairs), f"shard int, portion long, {_DOC}, tokens binary, context long")
    if len(known.contexts):
        blank = {c: F.lit(None).cast(k) for c, k in (x.split() for x in f"portion long, {_DOC}".split(", "))}
        dealt = dealt.unionByName(sent.withColumns(blank))
    mixed = dealt.groupBy("shard").applyInPandas(mixed_shard(code), f"portion long, {_DOC}, sums binary")
    parts = scratch.put(mixed.groupBy("portion").applyInPandas(_summed, f"portion long, {_DOC}"), "sums")
    found = (
        parts.where("rare IS NOT NULL").select("portion", "idx", "held_out", F.explode(F.split(F.col("rare").cast("string"), "\n")).alias("word"))
        .withColumn("word", F.col("word").cast("binary"))
        .join(words.hint("merge"), "word")
        .groupBy("portion", "idx").agg(F.count_if(F.col("c") > 0).alias("known_"), F.sum("base").alias("base_"), F.sum(F.when(F.col("held_out"), F.col("rare_held")).otherwise(F.col("rare_train"))).alias("rare_")))
    score = F.col("score") + F.coalesce("rare_", F.lit(0.0))
    return parts.join(found.hint("merge"), ["portion", "idx"], "left").select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known_", F.lit(0))).alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base_", F.lit(0.0))).alias("base_score"), score.alias("score"),
        F.when(F.col("n_bytes") > 0, -score * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))


def op10_context_mixing(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
