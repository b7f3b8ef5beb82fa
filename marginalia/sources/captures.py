"""Captured web pages: MHTML files to HTML, and HTML to the text of its article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.structure import stripped

# fixed values: parts of a page that hold no article, and what ends a line of text
NO_TEXT = ["script", "style", "nav", "aside", "header", "footer", "noscript", "template", "svg", "form"]
BLOCK_END = r"(?i)<br\s*/?>|</(?:p|h[1-6]|li|div|tr|blockquote|pre|section|article|ul|ol|table)>"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def quoted_printable(c: Column) -> Column:
    """Quoted-printable text in UTF-8 decoded: soft line ends go, ``=XX`` are bytes."""
    c = F.regexp_replace(c, r"=[ \t]*\r?\n", "")
    c = F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(F.regexp_replace(c, r"=([0-9A-Fa-f]{2})", "%$1"))


def mhtml_pages(files: DataFrame) -> DataFrame:
    """``(path, url, html)`` of MHTML files ``(path, text)``: the first part that is HTML, decoded, and the address it was taken from.

    A part's own ``Content-Location`` comes before the file's
    ``Snapshot-Content-Location``. Parts are quoted-printable, base64 or plain,
    in UTF-8. Files without an HTML part give no row.
    """
    head = F.regexp_replace(F.regexp_extract("text", r"(?s)\A(.*?)\r?\n\r?\n", 1), r"\r?\n[ \t]+", " ")
    boundary = F.coalesce(F.nullif(F.regexp_extract(head, r"(?i)\bboundary=\"([^\"]+)\"", 1), F.lit("")), F.nullif(F.regexp_extract(head, r"(?i)\bboundary=([^\s;\"]+)", 1), F.lit("")))
    parts = F.when(boundary.isNull(), F.array("text")).otherwise(F.split("text", F.concat(F.lit(r"(?m)^--\Q"), boundary, F.lit(r"\E(?:--)?[ \t]*\r?$\n?")), -1))
    page = F.get(F.filter(parts, lambda p: F.regexp_extract(p, r"(?s)\A(.*?)\r?\n\r?\n", 1).rlike(r"(?im)^content-type:\s*(?:text/html|application/xhtml)")), F.lit(0))
    rows = files.select("path", head.alias("head"), page.alias("page")).where(F.col("page").isNotNull())
    own = F.regexp_replace(F.regexp_extract("page", r"(?s)\A(.*?)\r?\n\r?\n", 1), r"\r?\n[ \t]+", " ")
    body = F.regexp_replace(F.regexp_extract("page", r"(?s)\A.*?\r?\n\r?\n(.*)\z", 1), r"\r?\n\z", "")
    field = lambda c, name: F.nullif(stripped(F.regexp_extract(c, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)), F.lit(""))
    coding = F.lower(F.coalesce(field(own, "content-transfer-encoding"), F.lit("")))
    html = F.when(coding == "quoted-printable", quoted_printable(body)).when(coding == "base64", F.try_to_binary(F.regexp_replace(body, r"\s+", ""), F.lit("base64")).cast("string")).otherwise(body)
    return rows.select("path", F.coalesce(field(own, "content-location"), field(F.col("head"), "snapshot-content-location")).alias("url"), html.alias("html"))


def article_text(html: Column) -> Column:
    """The text of a page's first ``article``, else of its ``main``, else of its body: a line a block, blanks collapsed, empty lines left out."""
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in NO_TEXT:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    held = [F.nullif(F.regexp_extract(c, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), F.lit("")) for tag in ("article", "main", "body")]
    c = F.regexp_replace(F.regexp_replace(F.coalesce(*held, c), r"\s+", " "), BLOCK_END, "\n")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return stripped(F.regexp_replace(F.regexp_replace(c, r"[ \t]*\n\s*", "\n"), r"[ \t]+", " "))
