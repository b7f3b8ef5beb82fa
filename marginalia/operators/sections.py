"""Markdown sections in pieces of bounded size, paragraphs with their offsets, and the context of citations.

Lengths and offsets are in code points. Papers have one row each.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import arrays, places, scalars
from marginalia.operators.extract import CITE

# fixed values: sections under so many characters join their neighbour, those over twice so many are split, how far beyond its end a paragraph still claims a position, and what share of it is before its last part
TINY, LARGE, SLACK, LATE = 200, 4000, 50, 0.8
HEADING = r"(?md)^(#{1,3}\s+.+)$"
BREAK = r"\n\s*\n|\\(?:sub)*section\*?\{"
FOOTNOTE = r"\\footnote\{(?:[^{}]|\{[^{}]*\})*\\url\{[^}]+\}(?:[^{}]|\{[^{}]*\})*\}"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def by_size(text: Column, most: int = LARGE) -> Column:
    """Chunks of whole paragraphs, begun anew before one would pass ``most`` characters; a chunk begins with the last paragraphs of the one before that have ``most // 2`` characters together.

    A fold over the paragraphs: the chunks so far, the paragraphs of the open
    one and their length. A paragraph over ``most`` is a chunk of its own with
    what it took over.
    """
    size = lambda ps: F.aggregate(ps, F.lit(0), lambda n, p: n + F.char_length(p))
    none = F.array().cast("array<string>")

    def step(s: Column, p: Column) -> Column:
        full = (s["size"] + F.char_length(p) > most) & (F.size(s["open"]) > 0)
        held = F.filter(F.sequence(F.lit(1), F.greatest(F.size(s["open"]), F.lit(1))), lambda n: (n <= F.size(s["open"])) & (size(F.slice(s["open"], -F.least(n, F.greatest(F.size(s["open"]), F.lit(1))), n)) <= most // 2))
        last = F.when(F.size(held) == 0, none).otherwise(F.slice(s["open"], -F.size(held), F.size(held)))
        carried = F.when(full, last).otherwise(s["open"])
        return F.struct(
            F.when(full, F.array_append(s["done"], F.array_join(s["open"], "\n\n"))).otherwise(s["done"]).alias("done"),
            F.array_append(carried, p).alias("open"),
            (F.when(full, size(last)).otherwise(s["size"]) + F.char_length(p)).alias("size"))

    start = F.struct(none.alias("done"), none.alias("open"), F.lit(0).alias("size"))
    chunks = F.aggregate(F.split(text, "\n\n", -1), start, step, lambda s: F.array_append(s["done"], F.array_join(s["open"], "\n\n")))
    chunks = F.transform(chunks, stripped)
    # only the last may be left out for being blank
    return F.when(F.element_at(chunks, -1) == "", F.slice(chunks, 1, F.size(chunks) - 1)).otherwise(chunks)


def markdown_sections(docs: DataFrame) -> DataFrame:
    """``(paper, ord, title, text)``: sections of ``(paper, text)`` by headings of one to three ``#``.

    What stands before the first heading is the Preamble; headings over blank
    text are left out. Text without headings is split by size into chunks.
    Sections under 200 characters are added to the one before, and a first
    section that still is so small to the next. Sections over 8000 characters
    are split by size, their pieces sharing about half, with the number of the
    part in the title. A blank text is one section, as it is; null gives none.
    """
    text = F.col("text")
    heads = F.transform(F.regexp_extract_all(text, F.lit(HEADING), 1), lambda h: stripped(F.regexp_replace(stripped(h), r"\A#+", "")))
    parts = F.transform(F.split(text, HEADING, -1), stripped)
    named = F.zip_with(F.concat(F.array(F.lit("Preamble")), heads), parts, lambda h, t: F.struct(h.alias("title"), t.alias("text")))
    chunks = F.transform(by_size(text), lambda t, i: F.struct(F.concat(F.lit("Chunk "), (i + 1).cast("string")).alias("title"), t.alias("text")))
    headed = text.rlike(r"(?md)^#{1,3}\s+")
    first = F.when(headed, F.filter(named, lambda s: s["text"] != "")).otherwise(chunks)
    rows = docs.where(text.isNotNull()).select("paper", F.posexplode(first).alias("n", "s")).select("paper", "n", "s.title", "s.text")
    # islands: a section that isn't tiny begins one, as does the first
    upto = Window.partitionBy("paper").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    island = F.sum(((F.col("n") == 0) | (F.char_length("text") >= TINY)).cast("int")).over(upto)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n\n")
    merged = rows.withColumn("island", island).groupBy("paper", "island").agg(F.min_by("title", "n").alias("title"), joined.alias("text"))
    w = Window.partitionBy("paper").orderBy("island")
    before, tiny = F.lag("text").over(w), F.char_length("text") < TINY
    merged = merged.withColumns({"before": before, "after": F.lead("island").over(w)})
    merged = merged.where(~((F.col("island") == 1) & tiny & F.col("after").isNotNull())).withColumn(
        "text", F.when((F.col("island") == 2) & (F.char_length("before") < TINY), F.concat_ws("\n\n", "before", "text")).otherwise(F.col("text")))
    pieces = F.when(F.char_length("text") > 2 * LARGE, by_size(F.col("text"))).otherwise(F.array("text"))
    split = merged.select("paper", "island", "title", (F.char_length("text") > 2 * LARGE).alias("large"), F.posexplode(pieces).alias("part", "text"))
    title = F.when(F.col("large"), F.concat("title", F.lit(" (part "), (F.col("part") + 1).cast("string"), F.lit(")"))).otherwise(F.col("title"))
    out = split.select("paper", (F.row_number().over(Window.partitionBy("paper").orderBy("island", "part")) - 1).alias("ord"), title.alias("title"), "text")
    blank = docs.where(stripped(text) == "").select("paper", F.lit(0).alias("ord"), F.lit("Full text").alias("title"), "text")
    return out.unionByName(blank)


def claim_slice(docs: DataFrame) -> DataFrame:
    """``(paper, text, line)``: from the document's begin to its bibliography, and the lines before it. Texts without a begin give no row."""
    begin = F.instr("text", r"\begin{document}")
    listed, included = F.instr("text", r"\begin{thebibliography}"), F.instr("text", r"\bibliography{")
    end = F.when(listed > 0, listed).when(included > 0, included).otherwise(F.char_length("text") + 1)
    return docs.where(begin > 0).select("paper", F.substring("text", begin, F.greatest(end - begin, F.lit(0))).alias("text"), F.regexp_count(F.substring("text", F.lit(1), begin), F.lit("\n")).alias("line"))


def _paragraphs(docs: DataFrame) -> DataFrame:
    """docs with ``paragraphs``, an array of ``(start, text)``; see ``paragraphs``."""
    rows = docs.withColumns({"__seps": F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(BREAK), 0)), "__pieces": F.split("text", BREAK, -1)})
    rows = rows.withColumn("__ends", arrays.running(F.zip_with("__seps", "__pieces", lambda s, p: F.char_length(s) + F.char_length(p))))
    placed = F.transform(F.arrays_zip(F.col("__seps").alias("sep"), F.col("__pieces").alias("piece"), F.col("__ends").alias("end")), lambda x: F.struct(
        (x["end"] - F.char_length(x["piece"]) - F.when(x["sep"].startswith("\\"), F.char_length(x["sep"])).otherwise(0)).alias("start"),
        stripped(F.when(x["sep"].startswith("\\"), F.concat(x["sep"], x["piece"])).otherwise(x["piece"])).alias("text")))
    return rows.withColumn("paragraphs", F.filter(placed, lambda p: p["text"] != "")).drop("__seps", "__pieces", "__ends")


def paragraphs(docs: DataFrame) -> DataFrame:
    """``(paper, ord, start, text)``: paragraphs between blank lines and section commands, which begin their paragraph.

    start, from 0, is where the paragraph begins in the text, blanks at its
    ends included; text is without them.
    """
    return _paragraphs(docs).select("paper", F.posexplode("paragraphs").alias("ord", "p")).select("paper", "ord", "p.start", "p.text")


def _as_found(match: str, around: list[str]) -> list[tuple[str, str | None]]:
    return [(match, "\n\n".join(around) or None)]


def _told(docs: DataFrame, pattern: str, tell, *kept: str) -> DataFrame:
    return arrays.exploded(docs, "m", places.contexts(F.col("text"), pattern, BREAK, SLACK, LATE, tell), *kept).select(*kept, "m.*")


def occurrences(docs: DataFrame, pattern: str) -> DataFrame:
    """``(paper, at, match, line)`` of every match of pattern, from character 0 and line 1 of ``(paper, text)``; found where the text is, without a shuffle."""
    return _told(docs, pattern, _as_found, "paper").select("paper", "at", F.col("told").alias("match"), "line")


def windows(docs: DataFrame, pattern: str) -> DataFrame:
    """``docs`` but their text, and ``occurrences`` with ``context``: its paragraph after the one before, and before the next if it stands in the paragraph's last fifth.

    A paragraph claims positions up to 50 characters beyond its end, and the
    first that claims a position has it. A match that none claims gives no row.
    Nothing is shuffled: both are found in one reading of the text, in its row.
    """
    kept = [c for c in docs.columns if c != "text"]
    return _told(docs, pattern, _as_found, *kept).where("context IS NOT NULL").select(*kept, "at", F.col("told").alias("match"), "line", "context")


_UNWRAPPED = [(f"\\{c}{{", re.compile(rf"\\{c}\{{([^}}]+)\}}")) for c in ("textbf", "emph", "texttt")]
_CITE, _NOTE, _COMMAND = re.compile(CITE), re.compile(r"\\footnote\{[^}]*\}"), re.compile(r"\\[a-zA-Z]+\{([^}]*)\}")
_BLANK = ["{", "}", "~", "\\\\", *places.BLANKS.replace(" ", "")]


def _plain(text: str) -> str:
    """Without footnotes, commands, braces, line ends and runs of blanks, in this order."""
    if "\\" in text:
        text = _COMMAND.sub(r"\1", _NOTE.sub("", text))
    for gone in _BLANK:
        if gone in text:
            text = text.replace(gone, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text.strip(" ")


def _unwrapped(text: str) -> str:
    for begin, pattern in _UNWRAPPED:
        if begin in text:
            text = pattern.sub(r"\1", text)
    return text


def _open(text: str) -> bool:
    """Whether what begins with a brace may end in a paragraph after this one."""
    return text.rfind("{") > text.rfind("}")


@lru_cache(256)  # a paragraph is before, in and after its matches
def _paragraph(text: str) -> tuple[str, set[str], list[str], list[list[str]]] | None:
    """A paragraph cleaned by itself: the text, the keys it cites, what stands between its citations, and the keys of each. None where it can't be told from its neighbours, a citation stands inside another or a footnote may hold one."""
    if "\0" in text or _open(text):
        return None
    for begin, pattern in _UNWRAPPED:
        if begin in text:
            text = pattern.sub(r"\1", text)
            if _open(text):
                return None
    parts = _CITE.split(text)
    cited, noted = parts[1::2], r"\footnote{" in text
    text = "\0".join(parts[::2])
    if cited and (noted or _open(text) or any(r"\cite" in c for c in cited)) or noted and _open(_NOTE.sub("", text)):
        return None
    text = _plain(text)
    if not cited:
        return text, set(), [text], []
    names = [[k.strip(places.BLANKS) for k in c.split(",")] for c in cited]
    return text.replace("\0", "[CITE]"), {k for n in names for k in n}, text.split("\0"), names


def clean_claims(around: list[str], keys: list[str] | None = None) -> list[str]:
    """The text of paragraphs for each key: markup unwrapped; citations are ``[CITE]``, those that name the key ``[TARGET_CITE]``; footnotes go, blanks collapse. Without keys, one text."""
    each = [_paragraph(p) for p in around]
    if None in each:  # all together, and the key's own citations before the others
        text = _unwrapped("\n\n".join(around))
        named = [re.sub(rf"\\cite(?:unverified|[tp]|yearpar)?\{{(?:[^}}]*,)?\s*{re.escape(k)}\s*(?:,[^}}]*)?\}}", "[TARGET_CITE]", text, flags=re.ASCII) for k in keys] if keys else [text]
        return [_plain(_CITE.sub("[CITE]", t)) for t in named]
    out = []
    for key in keys or [None]:
        said = []
        for plain, cited, pieces, names in each:
            if key in cited:
                plain = "".join(x for n, piece in zip(names, pieces) for x in (piece, "[TARGET_CITE]" if key in n else "[CITE]")) + pieces[-1]
            if plain:
                said.append(plain)
        out.append(" ".join(said))
    return out


def _cited(match: str, around: list[str]) -> list[tuple[str, str]]:
    keys = [k for x in match[match.index("{") + 1 : -1].split(",") if (k := x.strip(places.BLANKS))]
    return list(zip(keys, clean_claims(around, keys))) if around and keys else []


_URL = re.compile(r"\\url\{([^}]+)\}")


def _footnoted(match: str, around: list[str]) -> list[tuple[str, str]]:
    urls = [u for x in _URL.findall(match) if (u := x.strip(places.BLANKS))]
    return [(u, c) for c in clean_claims(around) if c for u in urls]


def citation_contexts(docs: DataFrame) -> DataFrame:
    """``(paper, key, line, at, context)`` of each citation key in ``(paper, text)``.

    line is that of the whole text, at the offset in what stands between the
    document's begin and its bibliography.
    """
    found = _told(claim_slice(docs).withColumnRenamed("line", "before"), CITE, _cited, "paper", "before")
    return found.select("paper", F.col("told").alias("key"), (F.col("line") + F.col("before")).alias("line"), "at", "context")


def footnote_claims(docs: DataFrame) -> DataFrame:
    """``(paper, key, url, line, context)``: each address in a footnote, under the key that stands for it, with the text around the footnote."""
    found = _told(claim_slice(docs).withColumnRenamed("line", "before"), FOOTNOTE, _footnoted, "paper", "before")
    return found.select("paper", scalars.synthetic_key(scalars.normalize_url(F.col("told"))).alias("key"), F.col("told").alias("url"), (F.col("line") + F.col("before")).alias("line"), "context")


def captured_footnotes(claims: DataFrame, captures: DataFrame) -> DataFrame:
    """Footnote claims with ``file`` of the capture ``(url, file)`` of the same page, the first by name; null where there is none. Pages are the same by address: of a million, two share a key."""
    once = captures.groupBy("url").agg(F.min("file").alias("file"))  # most addresses are written the same way
    pages = once.groupBy(scalars.normalize_url(F.col("url")).alias("page")).agg(F.min("file").alias("file"))
    return claims.withColumn("page", scalars.normalize_url(F.col("url"))).join(pages, "page", "left").select(*claims.columns, "file")
