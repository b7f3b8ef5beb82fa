"""Secret scan: fixed patterns, and formats inferred from what they find.

Credentials that the patterns catch are labelled examples. For each kind their
prefix tree, over classes of characters, is reduced to a probabilistic
automaton: states are merged whose outgoing frequencies, and those of all
states reached by the same suffixes, are compatible by Hoeffding's bound.
Every other candidate of a text, a run of 8 and more token characters or what
follows an equals sign in it, is scored by its log-likelihood under each
automaton and its length's, against that of common candidates, and added as
``format`` where it scores like the examples do.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.text import whole
from marginalia.scratch import Scratch

KINDS = ("assign", "access", "hex")


# fixed values: the base patterns
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_TAIL = re.compile(r"[^=]{8,}=*$")
_KEYWORDS = ("passw", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, value)`` in code points, by start and then kind; the value of an assignment is what is assigned."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    for run in _RUN.finditer(text):  # both other kinds lie within runs of 16 token characters
        at, s = run.start(), run.group()
        if "AKIA" in s:
            found += [("access", at + m.start(), at + m.end(), m[0]) for m in _ACCESS.finditer(s) if m.end() - m.start() >= 16]
        if len(s) >= 32:
            found += [("hex", at + m.start(), at + m.end(), m[0]) for m in _HEX.finditer(s) if m.end() - m.start() >= 32]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def candidates(text: str, taken: list[tuple]) -> Iterator[tuple[int, int, str]]:
    """Runs of 8 token characters and more that touch no base span, and of each what follows an equals sign inside it. taken is in order of starts, and both lists are walked once."""
    ends = list(itertools.accumulate((x[2] for x in taken), max))  # the furthest end so far: spans of several kinds may lie in each other
    at = 0
    for run in _CANDIDATE.finditer(text):
        a, b = run.span()
        while at < len(taken) and ends[at] <= a:
            at += 1
        if at < len(taken) and taken[at][1] < b:
            continue
        yield a, b, run[0]
        if "=" in run[0] and (tail := _TAIL.search(run[0])) and tail.start():
            yield a + tail.start(), b, tail[0]


def char_class(c: str) -> str:
    return "d" if "0" <= c <= "9" else "a" if "a" <= c <= "f" else "z" if "g" <= c <= "z" else "A" if "A" <= c <= "F" else "Z" if "G" <= c <= "Z" else c


#: Candidates of this length and more are counted as one length.
LONGEST = 4096
#: All classes of token characters.
CLASSES = [*"dazAZ+/_.=-"]


class Automaton:
    """A deterministic probabilistic automaton, from a prefix tree by merging compatible states."""

    def __init__(self, examples: list[str], alpha: float = 0.05):
        self.out: list[dict[str, int]] = [{}]  # transitions
        self.n: list[Counter] = [Counter()]  # uses of each; "" is the end
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for e in examples:
            s = 0
            for c in e:
                k = char_class(c)
                self.n[s][k] += 1
                if k not in self.out[s]:
                    self.out[s][k] = len(self.out)
                    self.out.append({})
                    self.n.append(Counter())
                s = self.out[s][k]
            self.n[s][""] += 1
        self._merge_all()
        self.total = [sum(n.values()) for n in self.n]

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = sum(self.n[a].values()), sum(self.n[b].values())
            if not na or not nb:
                continue
            most = self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if most < 1 and any(abs(self.n[a][k] / na - self.n[b][k] / nb) > most for k in self.n[a].keys() | self.n[b].keys()):
                return False
            todo += [(self.out[a][k], self.out[b][k]) for k in self.out[a].keys() & self.out[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the subtree at b to the automaton at a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.n[a].update(self.n[b])
            for k, t in self.out[b].items():
                if k in self.out[a]:
                    todo.append((self.out[a][k], t))
                else:
                    self.out[a][k] = t

    def _merge_all(self) -> None:
        red = [0]
        blue = [(0, k) for k in sorted(self.out[0])]
        while blue:
            s, k = blue.pop(0)
            t = self.out[s][k]
            if t in red:
                continue
            for r in red:
                if self._compatible(r, t):
                    self.out[s][k] = r
                    self._fold(r, t)
                    break
            else:
                red.append(t)
            blue = [(r, k) for r in red for k in sorted(self.out[r]) if self.out[r][k] not in red]
        self.states = red

    def score(self, token: str) -> float:
        """Natural log-likelihood of the characters; steps never seen count as half a use among all."""
        s, total = 0, 0.0
        for c in token:
            k = char_class(c)
            if k not in self.out[s] or not self.n[s][k]:
                total += math.log(0.5 / (self.total[s] + 1))
                s = 0
                continue
            total += math.log(self.n[s][k] / (self.total[s] + 1))
            s = self.out[s][k]
        return total


class Formats:
    """For each kind an automaton, its examples' lengths and the least score of most of them; and how usual classes and lengths are.

    A score is a log-likelihood ratio: characters by the automaton and length
    by the examples, against usual candidates. ``usual`` counts characters by
    class, ``lengths`` candidates by length.
    """

    def __init__(self, examples: dict[str, list[str]], usual: dict[str, int], lengths: dict[int, int], share: float = 0.02):
        total, n = sum(usual.values()) + 80, sum(lengths.values()) + 80
        self.usual = {c: math.log((usual.get(c, 0) + 1) / total) for c in CLASSES}
        self.lengths = {k: math.log((v + 1) / n) for k, v in lengths.items()}
        self.unseen = math.log(1 / n)
        self.automata, self.own, self.floor = {}, {}, {}
        for k, v in sorted(examples.items()):
            if v:
                self.automata[k], seen = Automaton(v), Counter(map(len, v))
                self.own[k] = ({i: math.log((c + 0.5) / (len(v) + 1)) for i, c in seen.items()}, math.log(0.5 / (len(v) + 1)))
                scores = sorted(self.score(k, e) for e in v)
                self.floor[k] = max(0.0, scores[int(share * (len(scores) - 1))])
        self.known: dict[str, float | None] = {}

    def score(self, kind: str, token: str) -> float:
        own, unseen = self.own[kind]
        usual = sum(self.usual[char_class(c)] for c in token) + self.lengths.get(min(len(token), LONGEST), self.unseen)
        return self.automata[kind].score(token) + own.get(len(token), unseen) - usual

    def accepted(self, token: str) -> float | None:
        """The best score, if it is one that its kind's examples have."""
        if token not in self.known:
            if len(self.known) > 200_000:  # only so that work isn't repeated
                self.known.clear()
            fit = [s for k in self.automata if (s := self.score(k, token)) >= self.floor[k]]
            self.known[token] = max(fit, default=None)
        return self.known[token]


_BASE = "array<struct<kind:string,first:int,past:int,value:string>>"
_ADDED = "array<struct<kind:string,first:int,past:int,value:string,score:double>>"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))


def labelled(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(kind, value, uses)``: distinct credentials of base spans; and under the kinds ``class`` and ``length`` the counts of candidates."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes, lengths = Counter(), Counter()
        for pdf in batches:
            found = Counter()
            for t in pdf["text"]:
                spans = base_spans(t)
                found.update((k, v) for k, _, _, v in spans)
                own = [v for _, _, v in candidates(t, spans)]
                lengths.update(map(len, own))
                classes.update("".join(own))
            yield pd.DataFrame([(k, v, n) for (k, v), n in found.items()], columns=["kind", "value", "uses"])
        by_class = Counter()
        for c, n in classes.items():
            by_class[char_class(c)] += n
        yield pd.DataFrame([("class", k, n) for k, n in by_class.items()] + [("length", str(k), n) for k, n in lengths.items()], columns=["kind", "value", "uses"])

    return docs.select(whole(F.col(text_col)).alias("text")).mapInPandas(rows, "kind string, value string, uses long").groupBy("kind", "value").agg(F.sum("uses").alias("uses"))


def learn_formats(docs: DataFrame, text_col: str = "text", examples: int = 1000) -> Formats:
    """Automata from at most ``examples`` distinct labelled credentials a kind, those of least hash; classes and lengths are counted over all candidates.

    The hash up to which examples are fetched follows from each kind's number
    of values, so that little more than ``examples`` rows come.
    """
    found = Scratch(docs.sparkSession, "secrets").put(labelled(docs, text_col), "labelled")
    order = F.xxhash64("value").bitwiseAND(F.lit(2**62 - 1))
    usual = {r["value"]: r["uses"] for r in found.where("kind = 'class'").collect()}  # 12 classes at most
    lengths = {r["length"]: r["n"] for r in found.where("kind = 'length'").groupBy(F.least(F.col("value").cast("long"), F.lit(LONGEST)).alias("length")).agg(F.sum("uses").alias("n")).collect()}
    chosen: dict[str, list[str]] = {}
    for kind, n in found.where(F.col("kind").isin(*KINDS)).groupBy("kind").count().collect():
        most = min(1.0, (examples + 8 * math.sqrt(examples)) / n)
        some = found.where((F.col("kind") == kind) & (order < F.lit(int(2**62 * most)))).select("value", order.alias("h")).collect()
        chosen[kind] = sorted(r["value"] for r in sorted(some, key=lambda r: (r["h"], r["value"]))[:examples])
    return Formats(chosen, usual, lengths)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = 1000) -> DataFrame:
    """``(doc_id, base array, added array)``; elements are ``kind, first, past`` (code points, past exclusive) and ``value``, of added ones ``score`` too.

    Null and empty texts have no spans, empty tables no rows. Each row is a
    text of its own, so repeated ids give repeated rows and a null id stays
    null. Of a run and what follows an equals sign in it, the run is added if
    both fit. Without any labelled credential nothing is added. Other columns
    are not carried.
    """
    formats = learn_formats(docs, text_col, examples)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            base, added = [], []
            for t in pdf["text"]:
                spans = base_spans(t)
                base.append([{"kind": k, "first": a, "past": b, "value": v} for k, a, b, v in spans])
                own, end = [], 0
                for a, b, v in candidates(t, spans) if formats.automata else ():
                    if a >= end and (s := formats.accepted(v)) is not None:
                        own.append({"kind": "format", "first": a, "past": b, "value": v, "score": s})
                        end = b
                added.append(own)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "base": base, "added": added})

    return _texts(docs, id_col, text_col).mapInPandas(found, f"doc_id long, base {_BASE}, added {_ADDED}")


def _joined(spans):
    """``kind:first:past`` by first and then kind as listed, joined by commas."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate((*KINDS, "format")) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(s["first"].alias("f"), rank[s["kind"]].alias("r"), s["past"].alias("p"), s["kind"].alias("k")))
    return F.transform(F.sort_array(keyed), lambda s: F.concat_ws(":", s["k"], s["f"], s["p"]))


def op3_secret_formats(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs)

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    plain = F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["first"].alias("first"), s["past"].alias("past"), s["value"].alias("value")))
    return found.select("doc_id", *map(count, KINDS), F.sha2(F.array_join(_joined(F.col("base")), ","), 256).alias("base_sha256"),
                        F.array_join(_joined(F.concat("base", plain)), ",").alias("spans"), F.size("added").cast("long").alias("n_added"),
                        F.array_max(F.transform("added", lambda s: s["score"])).alias("best_score"))
