"""Whether a file is the paper that a reference names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import scalars
from marginalia.operators import matching
from marginalia.operators.structure import stripped

# fixed values: cover pages with a word that each has in small letters, kinds of entries that may be short, particles that begin a surname, and how much of a file is looked at
TEMPLATES = {"eric_document_resume": ("resume", r"(?i)\bDOCUMENT\s+RESUME\b"), "core_ac_uk_landing": ("core.ac.uk", r"(?i)View\s+metadata,\s+citation\s+and\s+similar\s+papers\s+at\s+core\.ac\.uk")}
CORPORATE = ["book", "techreport", "manual", "inbook", "inproceedings", "incollection"]
PARTICLES = ["van", "de", "von", "der", "den", "du", "da", "la", "le"]
SHORTEST, TOP, WINDOW = 1500, 3000, 8000


def surname(name: Column) -> Column:
    """What stands before a comma, else from the first particle on, else the last word; empty for a blank name."""
    c = stripped(name)
    words = F.split(c, r"\s+")
    at = F.array_position(F.transform(words, lambda w: F.lower(w).isin(*PARTICLES)), True)
    return F.when(F.contains(c, F.lit(",")), stripped(F.substring_index(c, ",", 1))).when(at > 0, F.array_join(F.slice(words, at.cast("int"), F.size(words)), " ")).otherwise(F.element_at(words, -1))


def acceptance(files: DataFrame) -> DataFrame:
    """files ``(text, found_title, title, authors, doi, year, entry_type)`` with their evidence and ``accepted``, ``reason``, ``confidence``.

    text is that of a file's first pages, of which 8,000 characters count;
    found_title the title read from it; the others are the reference's. Rows
    are decided by the first rule that applies:

    - cover pages are rejected, references without any evidence accepted;
    - articles under 1,500 characters are rejected;
    - the DOI in the text decides with a title (0.5), a surname, or, without
      authors, the year; alone it does only where nothing else is known;
    - titles of 0.85 decide with a surname or without authors;
    - books and reports without authors need 0.75;
    - 0.65 decides with a surname, 0.4 with a surname and the year, no title at
      all with a surname and the year; else the file is rejected.
    """
    blank = lambda c: F.coalesce(stripped(c), F.lit("")) == ""
    some = F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda a: ~blank(a))
    text = F.left(F.coalesce("text", F.lit("")), F.lit(WINDOW))
    rows = files.withColumns({"__text": text, "__known": F.size(some) > 0, "__names": F.array_distinct(F.transform(some, surname))})
    rows = rows.withColumns({"__folded": scalars.fold(F.col("__text")), "__surnames": F.split(scalars.fold(F.array_join("__names", "\u0001")), "\u0001")})
    sim = F.when(blank(F.col("title")) | blank(F.col("found_title")), 0.0).otherwise(matching.title_similarity(scalars.normalize_title(F.col("title")), scalars.normalize_title(F.col("found_title"))))
    rows = rows.withColumns({
        "template": F.coalesce(*[F.when(F.contains(F.lower(F.left("__text", F.lit(TOP))), F.lit(word)) & F.left("__text", F.lit(TOP)).rlike(p), name) for name, (word, p) in TEMPLATES.items()]), "body_chars": F.char_length("__text"), "title_sim": F.coalesce(sim, F.lit(0.0)),
        "surnames": F.size(F.filter(F.array_distinct("__surnames"), lambda n: (n != "") & F.contains("__folded", n) & F.regexp_like(F.col("__folded"), F.concat(F.lit(r"(?<![a-z0-9])\Q"), n, F.lit(r"\E(?![a-z0-9])"))))),
        "doi_found": ~blank(F.col("doi")) & F.contains(F.lower(F.regexp_replace("__text", r"\s+", "")), F.lower(F.regexp_replace(F.coalesce("doi", F.lit("")), r"\s+|^https?://(?:dx\.)?doi\.org/", ""))),
        "year_found": F.coalesce(F.contains("__text", F.col("year").cast("string")) & F.regexp_like("__text", F.concat(F.lit(r"(?<!\d)"), F.col("year").cast("string"), F.lit(r"(?!\d)"))), F.lit(False))})
    s, n, year, authors = F.col("title_sim"), F.col("surnames"), F.col("year_found"), F.col("__known")
    titled, dated = ~blank(F.col("title")), F.col("year").isNotNull()
    corporate = F.coalesce(F.col("entry_type").isin(CORPORATE), F.lit(False))
    said = lambda accepted, reason, confidence: F.struct(F.lit(accepted).alias("accepted"), F.lit(reason).alias("reason"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"))
    rules = [
        (F.col("template").isNotNull(), said(False, "template page", 0.0)),
        (~titled & ~authors & blank(F.col("doi")) & ~dated, said(True, "no evidence supplied", 0.0)),
        (~corporate & (F.col("body_chars") < SHORTEST), said(False, "body too short", 0.0)),
        (F.col("doi_found") & ~(authors | titled | dated), said(True, "doi match", 1.0)),
        (F.col("doi_found") & ((s >= 0.5) | (n >= 1) | (year & ~authors)), said(True, "doi and more", 1.0)),
        (F.col("doi_found"), said(False, "doi only", 0.5)),
        ((s >= 0.85) & ~authors, said(True, "strong title", 0.85)),
        ((s >= 0.85) & (n >= 1), said(True, "strong title and surname", 0.9)),
        (corporate & ~authors & (s >= 0.75), said(True, "corporate title", 0.75)),
        (corporate & ~authors, said(False, "corporate title too weak", s)),
        ((s >= 0.65) & (n >= 1), said(True, "title and surname", 0.8)),
        ((s >= 0.40) & (n >= 1) & year, said(True, "title, surname and year", 0.65)),
        (blank(F.col("found_title")) & (n >= 1) & year, said(True, "surname and year, no title", 0.55)),
    ]
    decided = said(False, "no positive signal", s)
    for applies, what in reversed(rules):
        decided = F.when(applies, what).otherwise(decided)
    evidence = ["template", "body_chars", "title_sim", "surnames", "doi_found", "year_found"]
    return rows.withColumn("__d", decided).select(*files.columns, *evidence, "__d.accepted", "__d.reason", "__d.confidence")
