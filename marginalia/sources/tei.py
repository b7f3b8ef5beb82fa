"""Papers parsed to TEI: titles, sections, references, inline citations and figures.

Headers and references are read from TEI by ``from_xml``. A body's divisions
nest to any depth, which a schema can't say, so they are found like braces: the
text is cut at tags of divisions, and one reading of the pieces gives each
division its own text and those around it.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import arrays
from marginalia.functions.places import BLANKS, table, texts
from marginalia.operators.structure import stripped

_NAME = "struct<forename:array<string>,surname:array<string>,roleName:array<string>,genName:array<string>>"
_AUTHOR = f"struct<persName:array<{_NAME}>>"
_TITLE = "struct<_VALUE:string,_level:string,_type:string>"
_DATE = "struct<_type:string,_when:string,_VALUE:string>"
_IDNO = "struct<_type:string,_VALUE:string>"
_PTR = "struct<_type:string,_target:string>"
_IMPRINT = f"struct<date:array<{_DATE}>>"
REFERENCE = f"analytic struct<title:array<{_TITLE}>,author:array<{_AUTHOR}>,idno:array<{_IDNO}>,ptr:array<{_PTR}>>,monogr struct<title:array<{_TITLE}>,author:array<{_AUTHOR}>,idno:array<{_IDNO}>,ptr:array<{_PTR}>,imprint:{_IMPRINT}>,idno array<{_IDNO}>,ptr array<{_PTR}>,note array<struct<_type:string,_VALUE:string>>"
# fixed values: identifiers by their type in TEI
IDNOS = {"doi": "DOI", "arxiv_id": "arXiv", "pmid": "PMID", "isbn": "ISBN", "lccn": "LCCN"}
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def content(xml: Column) -> Column:
    """Text of a piece of XML without its tags."""
    c = F.regexp_replace(xml, r"(?s)<!--.*?-->|<[^>]*>", "")
    for entity, char in _ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def _flat(*lists: Column) -> Column:
    return F.flatten(F.transform(F.array(*lists), lambda x: F.coalesce(x, F.array())))


def _some(c: Column) -> Column:
    return F.nullif(stripped(c), F.lit(""))


def paper_headers(parsed: DataFrame) -> DataFrame:
    """``(paper, title, abstract, authors)`` of ``(paper, tei)``."""
    head = F.regexp_extract("tei", r"(?s)<teiHeader\b.*?</teiHeader>", 0)
    title = F.regexp_extract(head, r"(?s)<titleStmt\b[^>]*>.*?<title\b[^>]*>([^<]*)", 1)
    names = F.regexp_extract_all(head, F.lit(r"(?s)<author\b[^>]*>(?:(?!</author>).)*?<persName\b[^>]*>(.*?)</persName>"), 1)
    parts = lambda n: F.array_join(F.transform(F.regexp_extract_all(n, F.lit(r"<[a-zA-Z][^>/]*>([^<]+)</"), 1), lambda x: stripped(content(x))), " ")
    return parsed.select("paper", F.coalesce(_some(content(title)), F.lit("")).alias("title"), stripped(content(F.regexp_extract(head, r"(?s)<abstract\b[^>]*>(.*?)</abstract>", 1))).alias("abstract"),
                         F.filter(F.transform(names, parts), lambda n: n != "").alias("authors"))


def references(parsed: DataFrame) -> DataFrame:
    """``(paper, ord, title, venue, authors, year, doi, arxiv_id, pmid, isbn, lccn, url, raw)`` of each listed reference.

    Names are written with given names before family names. The title is the article's, else the first of the publication's that names
    neither a journal nor a book; the first that does is the venue. Unknown
    parts are null.
    """
    listed = F.regexp_extract_all("tei", F.lit(r"(?s)<biblStruct\b(?:[^>]*/>|.*?</biblStruct>)"), 0)
    rows = parsed.select("paper", F.posexplode_outer(listed).alias("ord", "xml")).where("xml IS NOT NULL").withColumn("r", F.from_xml("xml", REFERENCE, {"rowTag": "biblStruct", "attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE"}))
    r = F.col("r")
    own = lambda t: F.coalesce(t["_level"], F.lit("")).isin("j", "m")
    text = lambda rows, keep: F.get(F.filter(F.transform(F.filter(F.coalesce(rows, F.array()), keep), lambda t: _some(t["_VALUE"])), lambda t: t.isNotNull()), F.lit(0))
    article = _some(F.get(r["analytic"]["title"], F.lit(0))["_VALUE"])
    names = F.flatten(F.transform(_flat(r["analytic"]["author"], r["monogr"]["author"]), lambda a: F.coalesce(a["persName"], F.array())))
    written = F.transform(names, lambda n: F.array_join(F.filter(_flat(n["roleName"], n["forename"], n["surname"], n["genName"]), lambda x: F.coalesce(x, F.lit("")) != ""), " "))
    ids, ptrs = (_flat(r["analytic"][k], r["monogr"][k], r[k]) for k in ("idno", "ptr"))
    dates = F.coalesce(r["monogr"]["imprint"]["date"], F.array())
    when = lambda keep: F.nullif(F.left(F.get(F.filter(dates, keep), F.lit(0))["_when"], F.lit(4)), F.lit(""))
    year = F.coalesce(when(lambda d: d["_type"] == "published"), when(lambda d: F.lit(True)))
    idno = lambda kind: _some(F.get(F.filter(ids, lambda i: i["_type"] == kind), F.lit(0))["_VALUE"])
    return rows.select(
        "paper", "ord", F.coalesce(article, text(r["monogr"]["title"], lambda t: ~own(t))).alias("title"), text(r["monogr"]["title"], own).alias("venue"), F.filter(written, lambda w: w != "").alias("authors"), year.alias("year"),
        *(idno(kind).alias(name) for name, kind in IDNOS.items()), F.get(F.filter(ptrs, lambda p: p["_type"] == "url"), F.lit(0))["_target"].alias("url"), _some(F.get(F.filter(r["note"], lambda n: n["_type"] == "raw_reference"), F.lit(0))["_VALUE"]).alias("raw"))


def nested(pieces: list[str], marks: str) -> list[dict]:
    """Divisions by the marks of pieces (opens, closes, text) as ``(around, xml)`` in their order: places of those around and its own, and what stands directly in it."""
    out, within, below = [], [], 0
    for piece, mark in zip(pieces, marks):
        # an end of what wasn't begun takes a later begin to make up for it
        if mark == "o" and below:
            below -= 1
        elif mark == "o":
            within = [*within, len(out)]
            out.append({"around": within, "xml": []})
        elif mark == "c" and within:
            within = within[:-1]
        elif mark == "c":
            below += 1
        if within:
            out[within[-1]]["xml"].append(piece)
    return [d | {"xml": "".join(d["xml"])} for d in out]


def _divisions(parsed: DataFrame) -> DataFrame:
    """``(paper, divs)``: divisions of the body in their order, see ``nested``; found where the text is, without a shuffle."""
    def read(pieces: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([None if m is None else nested(p, m) for p, m in zip(pieces, marks)], dtype=object)

    body = F.regexp_extract("tei", r"(?s)<body\b[^>]*>(.*)</body>", 1)
    rows = parsed.select("paper", F.split(body, r"(?=<div\b[^>/]*>)|(?<=</div>)|(?=</div>)", -1).alias("pieces"))
    mark = lambda x: F.when(x.rlike(r"\A<div\b[^>/]*>"), "o").when(x.startswith("</div>"), "c").otherwise("t")
    return rows.select("paper", F.pandas_udf(read, "array<struct<around:array<int>,xml:string>>")("pieces", F.array_join(F.transform("pieces", mark), "")).alias("divs"))


def _head(xml: Column) -> Column:
    return _some(content(F.regexp_extract(xml, r"(?s)<head\b[^>]*>([^<]*)", 1)))


def body_sections(parsed: DataFrame) -> DataFrame:
    """``(paper, ord, level, title, text)``: a section for each division of the body, those inside it after it.

    Text is that of the paragraphs directly in the division, blank lines between
    them. A division without a heading is ``Section n``, n being one more than
    the number of sections before it in the division around it.
    """
    rows = _divisions(parsed).select("paper", F.posexplode_outer("divs").alias("ord", "d")).where("d IS NOT NULL").select("paper", "ord", "d.around", "d.xml")
    paragraphs = F.filter(F.transform(F.regexp_extract_all("xml", F.lit(r"(?s)<p\b[^>/]*>(.*?)</p>"), 1), lambda p: stripped(content(p))), lambda p: p != "")
    depth = F.size("around")
    up = F.when(depth > 1, F.get("around", depth - 2)).otherwise(-1)
    return rows.select("paper", "ord", (depth - 1).alias("level"), F.coalesce(_head(F.col("xml")), F.concat(F.lit("Section "), (F.col("ord") - up).cast("string"))).alias("title"), F.array_join(paragraphs, "\n\n").alias("text"))


_BODY, _TAG = re.compile(r"<body\b[^>]*>"), re.compile(r"(<(?:div\b[^<>/]*(?:<(?!div\b)[^<>/]*)*|/div)>)")
_HEAD, _BLOCK = re.compile(r"<head\b[^>]*>([^<]*)"), re.compile(r"(?s)<(?:p\b[^>/]*>.*?</p>|ref\b[^>]*>.*?</ref>[^<]*)")
_TAGS, _AFTER, _REF = re.compile(r"(?:<[^>]*>)+"), re.compile(r"</ref>([^<]*)\Z"), re.compile(r"<ref\b[^>]*>")
_BIBR, _TARGET = re.compile(r'\btype="bibr"'), re.compile(r'\btarget="#b([0-9]+)"')


def _entities(text: str) -> str:
    if "&" in text:
        for entity, char in _ENTITIES.items():
            text = text.replace(entity, char)
    return text


def _around(block: str) -> str:
    """A paragraph's first 200 characters, or what follows a reference in none."""
    if block.startswith("<p"):
        # it begins and ends with tags
        return _entities(_TAGS.sub("\1", block)[1:-1]).replace("\1", " ")[:200].strip(BLANKS)
    found = _AFTER.search(block)
    return _entities(found[1]).strip(BLANKS) if found else ""


def _told(tei: str) -> list[tuple[list[str], str, str]]:
    """Headings around, context and entry of each inline reference of a paper, in the order of the divisions."""
    begin, out = _BODY.search(tei), []
    body = tei[begin.end() : max(tei.rfind("</body>"), begin.end())] if begin else ""
    if 'type="bibr"' not in body:
        return out
    pieces = _TAG.split(body)
    divs = nested(pieces, ["t" if i % 2 == 0 else "c" if x == "</div>" else "o" for i, x in enumerate(pieces)])
    heads = [_entities(found[1]).strip(BLANKS) if (found := _HEAD.search(d["xml"])) else "" for d in divs]
    for d in divs:
        for block in _BLOCK.findall(d["xml"]):
            if 'type="bibr"' in block:
                context, sections = _around(block), [heads[i] for i in d["around"]]
                for ref in _REF.findall(block):
                    if 'type="bibr"' in ref and _BIBR.search(ref) and (entry := _TARGET.search(ref)):
                        out.append((sections, context, entry[1]))
    return out


def _bibliographic(tei: Column) -> Column:
    """``array<struct<sections, context, ord>>``, see ``_told``, read where the text is, without a shuffle; null for a null text."""
    def find(rows: pa.Array) -> pa.Array:
        told = [None if t is None else _told(t) for t in texts(rows)]
        sections, context, ord = zip(*(m for ms in told for m in ms or [])) if any(told) else ((), (), ())
        edges = np.cumsum([0, *map(len, sections)], dtype=np.int32)
        named = pa.ListArray.from_arrays(pa.array(edges), pa.array([x for s in sections for x in s], pa.string()))
        return table([m if m is None else len(m) for m in told], sections=named, context=pa.array(context, pa.string()), ord=pa.array(ord, pa.string()))

    return F.arrow_udf(find, "array<struct<sections:array<string>,context:string,ord:string>>")(tei)


def inline_citations(parsed: DataFrame, keys: DataFrame) -> DataFrame:
    """``(paper, key, section, context)`` of each inline reference to an entry ``(paper, ord, key)`` of the list.

    A reference counts once in its division and once in every division around
    that, under each one's heading; the context is the first 200 characters of
    its paragraph, or what follows it directly where it stands in none.
    References to what isn't listed give no row.
    """
    marks = arrays.exploded(parsed, "m", _bibliographic(F.col("tei")), "paper").select("paper", "m.sections", "m.context", F.col("m.ord").cast("int").alias("ord"))
    return marks.join(keys.select("paper", "ord", "key"), ["paper", "ord"]).select("paper", "key", F.explode("sections").alias("section"), "context")


def figure_labels(parsed: DataFrame) -> DataFrame:
    """``(paper, label)`` of figures with a label; tables aren't figures."""
    figures = F.filter(F.regexp_extract_all("tei", F.lit(r"(?s)<figure\b.*?</figure>"), 0), lambda f: ~F.contains(f, F.lit('type="table"')))
    labels = F.transform(figures, lambda f: F.regexp_extract(f, r"(?s)<label>\s*([^<]+?)\s*</label>", 1))
    return arrays.exploded(parsed, "label", labels, "paper").where("label <> ''")
