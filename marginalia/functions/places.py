"""Places of matches in texts, found in one reading of each, for whole Arrow batches of rows; built-ins tell the place of a first match alone.

Places are in code points, from 0. Blanks and digits in patterns are those of ASCII, as in Spark's own.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\v"


def texts(rows: pa.Array) -> list[str | None]:
    """A batch's texts; bytes that are no UTF-8 are U+FFFD, as Java reads them."""
    try:
        return rows.to_numpy(zero_copy_only=False).tolist()
    except pa.ArrowException:
        return [None if b is None else b.decode("utf-8", "replace") for b in rows.cast(pa.binary()).to_pylist()]


def table(sizes: list[int | None], **columns: pa.Array) -> pa.Array:
    """An array of structs for each row, of its size; null for None."""
    edges = np.concatenate([[0], np.cumsum([n or 0 for n in sizes])]).astype(np.int32)
    of = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.ListArray.from_arrays(pa.array(edges), of, mask=pa.array([n is None for n in sizes], pa.bool_()))


def matches(text: Column, *patterns: str) -> Column:
    """``array<struct<kind, at, match>>``: every match of the first of the patterns, which have no empty ones, that has any; kind is that pattern's place in the list. Null for a null text."""
    def find(rows: pa.Array) -> pa.Array:
        tried = [re.compile(p, re.ASCII) for p in patterns]
        sizes, kinds, ats, found = [], [], [], []
        for t in texts(rows):
            before = len(ats)
            for kind, p in enumerate(tried if t else []):
                for m in p.finditer(t):
                    ats.append(m.start())
                    found.append(m.group())
                if len(ats) > before:
                    kinds.extend([kind] * (len(ats) - before))
                    break
            sizes.append(None if t is None else len(ats) - before)
        return table(sizes, kind=pa.array(kinds, pa.int32()), at=pa.array(ats, pa.int32()), match=pa.array(found, pa.string()))

    return F.arrow_udf(find, "array<struct<kind:int,at:int,match:string>>")(text)


def blocks(text: str, part: re.Pattern) -> tuple[list[int], list[str]]:
    """Where the parts of a text between separators begin, and the parts without blanks at their ends; a separator that begins with a backslash belongs to the part after it. Blank parts are left out."""
    starts, parts, begin = [], [], 0
    cuts = [(m.start(), m.end()) for m in part.finditer(text)]
    for start, end in [*cuts, (len(text), len(text))]:
        piece = text[begin:start].strip(BLANKS)
        if piece:
            starts.append(begin)
            parts.append(piece)
        begin = start if text.startswith("\\", start) else end
    return starts, parts


def contexts(text: Column, pattern: str, part: str, slack: int, late: float, tell: Callable[[str, list[str]], list[tuple[str, str | None]]]) -> Column:
    """``array<struct<at, line, told, context>>``: what ``tell`` makes of every match of pattern and the paragraphs around it, see ``sections.windows``, with the match's place and line. Null for a null text."""
    def find(rows: pa.Array) -> pa.Array:
        wanted, parts = re.compile(pattern, re.ASCII), re.compile(part, re.ASCII)
        sizes, ats, lines, names, said = [], [], [], [], []
        for t in texts(rows):
            before = len(ats)
            marks = list(wanted.finditer(t)) if t else []
            starts, pieces = blocks(t, parts) if marks else ([], [])
            claimed = [s + len(p) + slack for s, p in zip(starts, pieces)]
            line, seen = 1, 0
            for m in marks:
                at = m.start()
                line, seen = line + t.count("\n", seen, at), at
                i, around = bisect_right(claimed, at), []
                if i < len(starts) and starts[i] <= at:
                    around = pieces[max(i - 1, 0) : i + 1 + (at - starts[i] > len(pieces[i]) * late)]
                for name, context in tell(m.group(), around):
                    ats.append(at)
                    lines.append(line)
                    names.append(name)
                    said.append(context)
            sizes.append(None if t is None else len(ats) - before)
        return table(sizes, at=pa.array(ats, pa.int32()), line=pa.array(lines, pa.int32()), told=pa.array(names, pa.string()), context=pa.array(said, pa.string()))

    return F.arrow_udf(find, "array<struct<at:int,line:int,told:string,context:string>>")(text)
