"""BibTeX files to entries, fields and records.

A file is cut after each brace, quote, comma and number sign. Running sums over
the pieces give the depth of braces, the entry, whether a quote is open, the
field and the part of a value, so that nested braces, ``@string`` names and
values joined by ``#`` come out whole, however many lines they take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.operators import structure
from marginalia.operators.structure import stripped

# fixed values: names that every file knows, fields that name a venue, in this order, and entries that are none
MONTHS = dict(zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), "January February March April May June July August September October November December".split()))
VENUE_FIELDS = ["journal", "booktitle", "howpublished"]
NOT_ENTRIES = ["string", "comment", "preamble"]
OPENING = r"@\s*(\w+)\s*\{\z"


def bib_files(spark: SparkSession, path: str) -> DataFrame:
    """``(paper, text)`` of ``.bib`` files below path, through Spark's own reader; paper is the file's path."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.bib", recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("paper"), F.col("value").alias("text"))


def _parts(files: DataFrame) -> DataFrame:
    """``(paper, entry, kind, field, part, raw)``: what stands between separators; field 0 is the key, or the whole of an ``@string``."""
    pieces = files.select("paper", F.posexplode(F.split("text", r'(?<=[{}",#])', -1)).alias("n", "piece"))
    order = Window.partitionBy("paper").orderBy("n")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("paper", "entry").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.right("piece", F.lit(1))
    step = F.when(mark == "{", 1).when(mark == "}", -1).otherwise(0)
    # a brace that closes nothing would shift all depths after it, so depth counts from the lowest point so far
    rows = pieces.withColumns({"mark": mark, "step": step}).withColumn("sum", F.sum("step").over(upto))
    rows = rows.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(upto)))
    opens = (F.col("depth") == 1) & (F.col("step") == 1) & F.col("piece").rlike(OPENING)
    rows = rows.withColumns({"opens": opens, "within": F.coalesce(F.lag("depth").over(order), F.lit(0)) > 0})
    rows = rows.withColumns({"entry": F.sum(F.col("opens").cast("int")).over(upto), "kind": F.lower(F.last(F.when(F.col("opens"), F.regexp_extract("piece", OPENING, 1)), ignorenulls=True).over(upto))})
    rows = rows.where("within AND entry > 0")
    total = lambda c: F.coalesce(F.sum(c.cast("int")).over(before), F.lit(0))
    top = (F.col("depth") == 1) & (F.col("step") == 0)
    rows = rows.withColumn("quoted", total(top & (F.col("mark") == '"')) % 2 == 1)
    parting = top & ~F.col("quoted") & F.col("mark").isin(",", "#")
    rows = rows.withColumns({"field": total(parting & (F.col("mark") == ",")), "part": total(parting & (F.col("mark") == "#"))})
    ends = parting | ((F.col("mark") == "}") & (F.col("depth") == 0))
    text = F.when(ends, F.substring("piece", F.lit(1), F.char_length("piece") - 1)).otherwise(F.col("piece"))
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))), lambda x: x["t"]), "")
    return rows.groupBy("paper", "entry", "field", "part").agg(F.first("kind").alias("kind"), raw.alias("raw"))


def _value(c: Column, names: Column) -> Column:
    """A part of a value: what its braces or quotes hold, a number, or what a name stands for; an unknown name stands for itself."""
    c = stripped(c)
    held = c.rlike(r"(?s)\A(?:\{.*\}|\".*\")\z")
    return F.when(held, F.substring(c, F.lit(2), F.char_length(c) - 2)).otherwise(F.coalesce(names[F.lower(c)], c))


def bib_fields(files: DataFrame) -> DataFrame:
    """``(paper, entry, entry_type, key, fields)`` of every entry in ``(paper, text)``; fields maps lower-case names to values, the last of a name.

    Comments, preambles, text between entries and entries without a key give
    none. ``@string`` names hold for their file, in any case of letters, and
    may be built from earlier ones.
    """
    parts = _parts(files).withColumn("first", F.row_number().over(Window.partitionBy("paper", "entry", "field").orderBy("part")) == 1)
    name = F.when(F.col("first"), F.lower(F.regexp_extract("raw", r"(?s)\A\s*([^\s=]+)\s*=", 1)))
    parts = parts.withColumns({"name": name, "raw": F.when(F.col("first") & name.isNotNull() & (name != ""), F.regexp_replace("raw", r"(?s)\A\s*[^\s=]+\s*=", "")).otherwise(F.col("raw"))})
    values = parts.groupBy("paper", "entry", "kind", "field").agg(F.max("name").alias("name"), F.transform(F.array_sort(F.collect_list(F.struct("part", "raw"))), lambda x: x["raw"]).alias("parts"))
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    joined = lambda v, names: F.array_join(F.transform(v["parts"], lambda p: _value(p, names)), "")
    strings = values.where("kind = 'string' AND field = 0 AND name <> ''").groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("entry", "name", "parts"))).alias("strings"))
    learnt = F.aggregate("strings", months, lambda m, s: F.map_concat(F.map_filter(m, lambda k, _: k != s["name"]), F.create_map(s["name"], joined(s, m))))
    names = strings.select("paper", learnt.alias("names"))
    fields = values.where(~F.col("kind").isin(NOT_ENTRIES)).join(names, "paper", "left").withColumn("names", F.coalesce("names", months))
    one = F.struct("name", "parts")
    fields = fields.select("paper", "entry", F.col("kind").alias("entry_type"), "field", F.when(F.col("field") == 0, F.lit(None)).otherwise(F.col("name")).alias("name"),
                           F.when(F.col("field") == 0, stripped(F.col("parts")[0])).otherwise(joined(one, F.col("names"))).alias("value"))
    last = fields.where("field = 0 OR name <> ''").groupBy("paper", "entry", "entry_type", "name").agg(F.max_by("value", "field").alias("value"))
    entries = last.groupBy("paper", "entry", "entry_type").agg(
        F.max(F.when(F.col("name").isNull(), F.col("value"))).alias("key"), F.map_from_entries(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value")))).alias("fields"))
    return entries.where("key <> ''").select("paper", "entry", "entry_type", "key", "fields")


def bib_records(files: DataFrame) -> DataFrame:
    """Entries as ``paper, entry, key, entry_type, title, authors, year, venue, doi, url, arxiv_id, pmid, pmc_id, isbn, lccn, raw_text``.

    A missing address is that in ``howpublished``, a missing DOI that in the
    address or there, and identifiers that still lack are looked for in fields
    that have no meaning of their own. What isn't known is null.
    """
    f = lambda name: F.nullif(F.col("fields")[name], F.lit(""))
    doi = lambda c: F.nullif(F.regexp_replace(F.regexp_extract(c, structure.IDENTIFIERS["doi"], 1), r"\.+\z", ""), F.lit(""))
    url = F.coalesce(f("url"), F.nullif(F.regexp_extract(f("howpublished"), r"\\url\{([^}]+)\}", 1), F.lit("")))
    title = F.nullif(stripped(F.regexp_replace(f("title"), r"[{}]", "")), F.lit(""))
    none = F.lit(None).cast("string")
    rows = bib_fields(files).select(
        "paper", "entry", "key", "entry_type", title.alias("title"), structure.bib_authors(F.coalesce(f("author"), F.lit(""))).alias("authors"), f("year").alias("year"),
        F.coalesce(*map(f, VENUE_FIELDS)).alias("venue"), F.coalesce(f("doi"), doi(url), doi(f("howpublished"))).alias("doi"), url.alias("url"),
        F.nullif(F.regexp_extract(f("eprint"), r"\A(\d{4}\.\d{4,5})", 1), F.lit("")).alias("arxiv_id"), none.alias("pmid"), none.alias("pmc_id"), f("isbn").alias("isbn"), f("lccn").alias("lccn"),
        F.concat_ws(". ", f("author"), title, F.coalesce(*map(f, VENUE_FIELDS))).alias("raw_text"), F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))).alias("fields"))
    return structure.swept_identifiers(rows).drop("fields")
