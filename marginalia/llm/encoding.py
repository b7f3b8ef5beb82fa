"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once.

Encoding is the costly part and most words come again, so a text is cut where
the tokenizer is bound to cut it and ids are kept by piece, in a bounded
table that keeps the most frequent when it is full. Texts with characters for which such cuts aren't proven are one piece.
"""

from __future__ import annotations

import itertools
import os
import re
from array import array
from collections import defaultdict

import numpy as np

#: Line feed, printable ASCII, and Latin letters and signs that normal forms leave alone: no other blanks, no combining marks.
_OTHER = re.compile("[^\n\x20-\x7e¡-įı-ɏ]")
#: Those of them that are letters.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and not _OTHER.search(c))
_BEFORE_WORD = re.compile(r"(?<=\S) (?=\S)")
_BLANK_RUN = re.compile(r"[ \n][ \n]")
#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest in order from U+0100. NUL, in no word, comes first.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SELF)}
_DELIMITER = _BYTE_CHARS[0]


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1 and so on, n[0] of them, then those from begin[1]."""
    upto = np.cumsum(n)
    return np.repeat(begin - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)


class _Growing:
    """An array that is added to at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1 << 16, dtype), 0

    def add(self, more) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(self.n, len(more)) + len(more), self.data.dtype)])
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


class Encoder:
    """style "space": a single blank begins the next piece; "split": blanks separate pieces and give no ids.

    Special strings of the tokenizer that stand in a text are one id each, as
    its file says; with ``specials=False`` they are text like any other.
    """

    def __init__(self, path: str, style: str, keep: int = 900_000, keep_chars: int = 12_000_000, specials: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        # a text that holds one of the tokenizer's own strings isn't cut
        own = self.tokenizer.get_added_tokens_decoder().values()
        self._own = [t.content for t in own if not t.normalized]
        loose = [re.escape(t.content) for t in own if t.normalized]
        self._loose = re.compile("|".join(loose), re.IGNORECASE).search if loose else None
        self.style, self.keep, self.keep_chars = style, keep, keep_chars
        # a word of letters, with a blank before it for style "space", and maybe a mark after it
        self._plain = re.compile(f"{' ?' if style == 'space' else ''}[{_LETTERS}]+[.,]?").fullmatch
        # words of letters are cut no further: they go to the tokenizer's model many at a time, without its normaliser and splitter
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = Split(_DELIMITER, "isolated")
        self.delimiter = self.bare.encode(_DELIMITER, add_special_tokens=False).ids
        self._start([])
        trial = [p + q for p in ("Añb", "the", "Zürich", "ŉa", "oł", "K") for q in ("", ".", ",")]
        trial = [" " + p for p in trial] + trial if style == "space" else trial
        if len(self.delimiter) != 1 or any(not np.array_equal(a, b) for a, b in zip(self._together(trial), self._one_by_one(trial))):
            self._together = self._one_by_one

    def _start(self, pieces: list[str]) -> None:
        self.pieces = defaultdict(itertools.count().__next__)
        self.ids, self.ends, self.uses = _Growing(np.uint32), _Growing(np.int64), np.zeros(0, np.int64)
        self.met, self.n_met, self.chars = [], 0, 0
        self.ends.add([0])
        for p in pieces:
            self.pieces[p]
        self._add()

    def _count(self) -> None:
        """Add what was met since the last count to ``uses``."""
        uses = np.bincount(np.concatenate(self.met), minlength=len(self.pieces)) if self.met else np.zeros(len(self.pieces), np.int64)
        uses[: len(self.uses)] += self.uses
        self.uses, self.met, self.n_met = uses, [], 0

    def _renew(self) -> None:
        """Keep the pieces that were met most, a quarter at most."""
        self._count()
        names = list(self.pieces)
        often = np.argsort(-self.uses[: len(names)], kind="stable")[: self.keep // 4]
        self._start([names[i] for i in np.sort(often) if self.uses[i] > 2 and len(names[i]) < 64])

    def _one_by_one(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each piece has."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))

    def _together(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that ``_plain`` accepts; a mark at the end is a cut of its own."""
        joined = "\0".join(some).replace(".", "\0.").replace(",", "\0,")
        if self.style == "split":
            joined = joined.lower()
        if joined.isascii():
            joined = joined.replace(" ", _BYTE_CHARS[32]).replace("\0", _DELIMITER)
        else:
            joined = joined.encode().decode("latin-1").translate(_BYTE_CHARS)
        (e,) = self.bare.encode_batch_fast([joined], add_special_tokens=False)
        ids = np.array(e.ids, np.uint32)
        cuts = np.flatnonzero(ids == self.delimiter[0])
        n = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
        parts = np.fromiter((2 if p[-1] in ".," else 1 for p in some), np.int64, len(some))
        return np.delete(ids, cuts), np.add.reduceat(n, np.cumsum(parts) - parts)

    def _add(self) -> None:
        """Encode the pieces that were named since the last time."""
        n_new = len(self.pieces) - (self.ends.n - 1)
        new = list(itertools.islice(reversed(self.pieces), n_new))[::-1]
        self.chars += sum(map(len, new))
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            plain = np.fromiter((self._plain(p) is not None for p in some), bool, len(some))
            ascii_ = np.fromiter(map(str.isascii, some), bool, len(some))
            kinds = [(f, np.flatnonzero(k)) for f, k in ((self._together, plain & ascii_), (self._together, plain & ~ascii_), (self._one_by_one, ~plain)) if k.any()]
            ids, n = (np.concatenate(x) for x in zip(*(f([some[i] for i in k]) for f, k in kinds)))
            order = np.argsort(np.concatenate([k for _, k in kinds]))
            self.ids.add(ids[_spread((np.cumsum(n) - n)[order], n[order])])
            self.ends.add(self.ends.data[self.ends.n - 1] + np.cumsum(n[order]))

    def _cut(self, text: str) -> list[str]:
        if _OTHER.search(text) or any(s in text for s in self._own) or self._loose and self._loose(text):
            return [text]
        if self.style == "split":
            return text.split()
        if _BLANK_RUN.search(text):
            return _BEFORE_WORD.sub("\x01 ", text).split("\x01")
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one uint32 array, and the number of each text's ids."""
        if len(self.pieces) > self.keep or self.chars > self.keep_chars:
            self._renew()
        pieces, seen, sizes = self.pieces, array("q"), []
        for text in texts:
            own = self._cut(text)
            seen.extend(map(pieces.__getitem__, own))
            sizes.append(len(own))
        self._add()
        seen = np.frombuffer(seen, np.int64) if len(seen) else np.zeros(0, np.int64)
        self.met.append(seen)
        self.n_met += len(seen)
        if self.n_met > 1_000_000:
            self._count()
        ids, ends = self.ids.data, self.ends.data
        begin = ends[seen]
        n = ends[seen + 1] - begin
        flat = ids[_spread(begin, n)]
        edges = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        return flat, np.diff(edges)


_made: dict = {}


def encoder(path: str, style: str, keep: int = 900_000) -> Encoder:
    """One for each worker process, kept between tasks. keep: pieces in its table, some 200 bytes each."""
    if (path, style, keep) not in _made:
        _made[path, style, keep] = Encoder(path, style, keep, keep * 40 // 3)
    return _made[path, style, keep]


def portions(texts, most_chars: int = 1_000_000):
    """Slices of a batch, so that what is held at once doesn't follow the batch's size."""
    at, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= most_chars:
            yield slice(at, i + 1)
            at, chars = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))
