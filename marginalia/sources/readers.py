"""Sources: registers, bibliographies, catalogue responses and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def retraction_register(spark: SparkSession, path: str) -> DataFrame:
    """``(doi, nature, reason, date, title, row)`` from a CSV export; rows without a usable DOI or nature are left out."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    doi = F.lower(F.regexp_replace(F.trim("OriginalPaperDOI"), r"^https?://doi\.org/", ""))
    return (raw.select(doi.alias("doi"), F.trim("RetractionNature").alias("nature"), F.col("Reason").alias("reason"), F.col("RetractionDate").alias("date"), F.col("Title").alias("title"), F.monotonically_increasing_id().alias("row"))
            .where("doi IS NOT NULL AND doi NOT IN ('', 'unavailable', 'n/a') AND nature IS NOT NULL AND nature <> ''"))


def bibitems(docs: DataFrame) -> DataFrame:
    """``(paper, key, entry)`` of every ``\\bibitem``."""
    found = F.regexp_extract_all("text", F.lit(r"(?s)\\bibitem(?:\[[^\]]*\])?\{([^}]+)\}(.*?)(?=\\bibitem|\\end\{thebibliography\}|\z)"), 0)
    return docs.select("paper", F.explode(found).alias("b")).select("paper", F.trim(F.regexp_extract("b", r"\{([^}]+)\}", 1)).alias("key"), F.regexp_replace(F.regexp_replace("b", r"(?s)^\\bibitem(?:\[[^\]]*\])?\{[^}]+\}", ""), r"^\s+|\s+$", "").alias("entry"))


def bibtex(docs: DataFrame) -> DataFrame:
    """``(paper, key, entry_type, title, year, doi, venue)`` of flat BibTeX entries; the venue is the journal, else the book, else how it was published."""
    entry = F.explode(F.regexp_extract_all("text", F.lit(r"(?ms)^\s*@\w+\s*\{.*?^\s*\}"), 0)).alias("e")

    def value(name: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract("e", rf"(?i)(?:^|[\s,]){name}\s*=\s*[{{\"]([^\n]*?)[}}\"]\s*,?\s*(?:\n|$)", 1)), F.lit(""))

    return docs.select("paper", entry).select(
        "paper", F.regexp_extract("e", r"@\w+\s*\{\s*([^,\s]+)", 1).alias("key"), F.lower(F.regexp_extract("e", r"@(\w+)", 1)).alias("entry_type"), value("title").alias("title"),
        value("year").alias("year"), value("doi").alias("doi"), F.coalesce(value("journal"), value("booktitle"), value("howpublished")).alias("venue"))


OPENALEX = "struct<title:string,doi:string,publication_year:int,is_retracted:boolean,authorships:array<struct<author:struct<display_name:string>>>>"


def openalex_records(responses: DataFrame, column: str = "body") -> DataFrame:
    """``(title, doi, year, authors, retracted)`` from response bodies; bodies that aren't JSON give nulls."""
    w = F.from_json(column, OPENALEX)
    names = F.filter(F.transform(w["authorships"], lambda a: a["author"]["display_name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return responses.select(w["title"].alias("title"), F.regexp_replace(w["doi"], r"^https://doi\.org/", "").alias("doi"), w["publication_year"].alias("year"), names.alias("authors"), F.coalesce(w["is_retracted"], F.lit(False)).alias("retracted"))


def page_facts(pages: DataFrame) -> DataFrame:
    """``(page_id, title, redirect, links)`` of web pages."""
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    redirect = F.nullif(F.regexp_extract("html", r"(?i)<meta[^>]*http-equiv=[\"']?refresh[\"']?[^>]*url=([^\"'>\s]+)", 1), F.lit(""))
    return pages.select("page_id", F.nullif(title, F.lit("")).alias("title"), redirect.alias("redirect"), F.size(F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*href=\"([^\"]*)\""), 1)).cast("long").alias("links"))


def source_url(text: Column, most_lines: int = 20) -> Column:
    """The address in a ``Source:`` header among the first lines."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, most_lines), "\n")
    return F.nullif(F.regexp_extract(head, r"(?im)^\s*(?:<!--\s*)?Source(?:\s*URL)?\s*:\s*(https?://\S+)", 1), F.lit(""))
