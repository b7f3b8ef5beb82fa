"""Arguments of commands with balanced braces, over as many lines as they take."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def balanced(text: str, pattern: re.Pattern) -> list[tuple[str, int, str]]:
    """``(command, line, argument)`` of every command that pattern finds; it finds all braces as well."""
    out, opened, line, seen = [], [], 1, 0
    for m in pattern.finditer(text):
        at = m.end()
        if text[at - 1] == "{":
            line, seen = line + text.count("\n", seen, at), at
            opened.append((m[1], line, at))
        elif opened:
            command, begun, start = opened.pop()
            if command:
                out.append((command, begun, text[start : at - 1]))
    return out


def arguments_of(text: Column, commands: list[str]) -> Column:
    """``array<struct<command, line, argument>>`` of a text, see ``command_arguments``; null for a null text."""
    known = "|".join(commands)

    def read(texts: pd.Series) -> pd.Series:
        pattern = re.compile(rf"\\({known})\{{|[{{}}]")
        return pd.Series([None if t is None else [{"command": c, "line": n, "argument": a} for c, n, a in balanced(t, pattern)] for t in texts], dtype=object)

    return F.pandas_udf(read, "array<struct<command:string,line:int,argument:string>>")(text)


#: Texts in which every opening brace is closed before the next one opens. Possessive, so that long texts need no stack.
FLAT = r"(?s)\A(?:[^{}]*+\{[^{}]*+\})*+[^{}]*+\z"


def named_arguments(text: Column, commands: list[str]) -> Column:
    """``array<struct<command, argument>>`` of a text, see ``command_arguments``; only texts with nested or unmatched braces leave the JVM."""
    pattern = F.lit(rf"\\({'|'.join(commands)})\{{([^{{}}]*)\}}")
    flat = text.rlike(FLAT)
    nested = F.transform(arguments_of(F.when(~flat, text), commands), lambda a: F.struct(a["command"].alias("command"), a["argument"].alias("argument")))
    plain = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("command"), F.regexp_extract_all(text, pattern, 2).alias("argument"))
    return F.when(flat, plain).otherwise(nested)


def command_arguments(docs: DataFrame, commands: list[str]) -> DataFrame:
    """``(paper, command, line, argument)`` of every ``\\command{argument}`` in ``(paper, text)``.

    An opening brace ends at the closing one that balances it; closing braces
    that balance none are passed over. Every brace counts, escaped or not. Lines
    count from 1 and are those of the command. An argument that is never closed
    gives no row; arguments inside arguments give rows of their own. Null texts
    give none. Each text is read once, where it is, so one whose lines come in
    another order when it is made again can't be mixed up with itself.
    """
    known = "|".join(commands)
    texts = docs.where(F.col("text").rlike(rf"\\(?:{known})\{{"))
    return texts.select("paper", F.explode(arguments_of(F.col("text"), commands)).alias("a")).select("paper", "a.*")
