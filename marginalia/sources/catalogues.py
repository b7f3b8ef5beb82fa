"""Responses of five catalogues as one kind of record.

Bodies are parsed once into VARIANT and read by path, so that a missing or
oddly typed part is null, whatever shape the rest has. Bodies that aren't JSON
objects give rows of nulls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import scalars

RECORD = ["title", "authors", "year", "doi", "venue", "citations", "arxiv_id", "pmcid", "isbn", "url", "pdf_url", "abstract", "retracted"]


def _at(path: str, kind: str = "string", of: str = "v") -> Column:
    return F.try_variant_get(F.col(of), path, kind)


def _list(path: str, of: Column | None = None) -> Column:
    return F.coalesce(F.try_variant_get(F.col("v") if of is None else of, path, "array<variant>"), F.array().cast("array<variant>"))


def _in(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _first(rows: Column, value: Callable[[Column], Column]) -> Column:
    """The first value that isn't null."""
    return F.get(F.filter(F.transform(rows, value), lambda x: x.isNotNull()), F.lit(0))


def some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _names(rows: Column, value: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform(rows, value), lambda n: F.coalesce(n, F.lit("")) != "")


def _crossref_year() -> Column:
    """Printed, else online, else issued."""
    return F.coalesce(*(F.nullif(_at(f"$['{d}']['date-parts'][0][0]", "int"), F.lit(0)) for d in ("published-print", "published-online", "issued")))


def _person(a: Column) -> Column:
    family = some(_in(a, "$.family"))
    return F.when(family.isNotNull(), F.concat_ws(" ", some(F.trim(_in(a, "$.given"))), family))


def _openalex() -> dict[str, Column]:
    landing = lambda loc: F.when(F.contains(_in(loc, "$.landing_page_url"), F.lit("arxiv.org/abs/")), F.substring_index(_in(loc, "$.landing_page_url"), "arxiv.org/abs/", -1))
    pmcid = _at("$.ids.pmcid")
    return {
        "title": _at("$.title"), "authors": _names(_list("$.authorships"), lambda a: _in(a, "$.author.display_name")), "year": _at("$.publication_year", "int"),
        "doi": F.regexp_replace(F.coalesce(_at("$.doi"), F.lit("")), r"\Ahttps://doi\.org/", ""), "venue": _at("$.primary_location.source.display_name"), "citations": _at("$.cited_by_count", "long"),
        "arxiv_id": _first(_list("$.locations"), landing), "pmcid": F.when(F.contains(pmcid, F.lit("PMC")), F.substring_index(pmcid, "/", -1)), "pdf_url": _at("$.open_access.oa_url"),
        "abstract": F.when(F.size(F.coalesce(_at("$.abstract_inverted_index", "map<string,array<int>>"), F.create_map().cast("map<string,array<int>>"))) > 0, scalars.decode_inverted(_at("$.abstract_inverted_index", "map<string,array<int>>"))),
        "retracted": _at("$.is_retracted", "boolean")}


def _semantic_scholar() -> dict[str, Column]:
    return {
        "title": _at("$.title"), "authors": F.transform(_list("$.authors"), lambda a: F.coalesce(_in(a, "$.name"), F.lit(""))), "year": _at("$.year", "int"), "doi": _at("$.externalIds.DOI"), "venue": _at("$.venue"),
        "citations": _at("$.citationCount", "long"), "arxiv_id": _at("$.externalIds.ArXiv"), "pmcid": _at("$.externalIds.PubMedCentral"), "url": _at("$.url"), "pdf_url": _at("$.openAccessPdf.url"), "abstract": _at("$.abstract")}


def _crossref() -> dict[str, Column]:
    noted = lambda u: F.contains(F.lower(F.concat(F.coalesce(_in(u, "$.type"), F.lit("")), F.coalesce(_in(u, "$.label"), F.lit("")))), F.lit("retract"))
    return {
        "title": _at("$.title[0]"), "authors": _names(_list("$.author"), _person), "year": _crossref_year(), "doi": _at("$.DOI"), "venue": _at("$['container-title'][0]"), "citations": _at("$['is-referenced-by-count']", "long"),
        "abstract": some(F.trim(F.regexp_replace(_at("$.abstract"), r"<[^>]+>", ""))), "retracted": F.exists(_list("$['update-to']"), noted)}


def _open_library() -> dict[str, Column]:
    subtitle = some(_at("$.subtitle"))
    return {
        "title": F.concat(F.coalesce(_at("$.title"), F.lit("")), F.coalesce(F.concat(F.lit(": "), subtitle), F.lit(""))), "authors": F.transform(_list("$.author_name"), lambda a: _in(a, "$")),
        "year": _at("$.first_publish_year", "int"), "venue": _at("$.publisher[0]"), "isbn": _at("$.isbn[0]")}


def _library_of_congress() -> dict[str, Column]:
    year = F.regexp_extract(_at("$.date"), r"\A(\d{4})", 1)
    return {"title": _at("$.title"), "authors": F.transform(_list("$.contributor"), lambda a: _in(a, "$")), "year": some(year).cast("int")}


SHAPES: dict[str, Callable[[], dict[str, Column]]] = {
    "openalex": _openalex, "semantic_scholar": _semantic_scholar, "crossref": _crossref, "openlibrary": _open_library, "loc": _library_of_congress}
#: What a catalogue doesn't say: no citations, no retraction; empty where a string belongs to every record.
_KINDS = {"authors": "array<string>", "year": "int", "citations": "long", "retracted": "boolean"}
_KNOWN = {"title": "", "doi": "", "venue": "", "citations": 0, "retracted": False}


def catalogue_records(responses: DataFrame, source: str, column: str = "body") -> DataFrame:
    """responses without their body, with ``source`` and the columns of ``RECORD``.

    source is one of ``SHAPES``. Titles, DOIs and venues that a body doesn't
    have are empty, counts 0; other parts are null, as is everything of a body
    that isn't a JSON object.
    """
    rows = responses.withColumn("v", F.try_parse_json(column))
    said = SHAPES[source]()
    good = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))

    def one(name: str) -> Column:
        c = said.get(name, F.lit(None)).cast(_KINDS.get(name, "string"))
        return F.when(good, F.coalesce(c, F.lit(_KNOWN[name])) if name in _KNOWN else c).alias(name)

    return rows.select(*(c for c in responses.columns if c != column), F.lit(source).alias("source"), *map(one, RECORD))


def book_year(responses: DataFrame, column: str = "body") -> DataFrame:
    """responses with ``year``, the first word of four digits in a book's ``publish_date``."""
    date = F.try_variant_get(F.try_parse_json(column), "$.publish_date", "string")
    return responses.withColumn("year", some(F.regexp_extract(date, r"\b(\d{4})\b", 1)).cast("int"))
