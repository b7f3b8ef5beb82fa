"""Column functions: normalisers, validators, classifiers."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: query parameters that only track visitors
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid"]
# fixed values: prefixes that say nothing about a venue, taken off in this order
VENUE_PREFIXES = ["proceedings of the ", "proceedings of ", "proc. ", "in "]
# fixed values: identifier formats
ID_FORMATS = {
    "doi": r"^10\.\d{4,}/\S+$", "arxiv": r"^(\d{4}\.\d{4,})(v\d+)?$", "pmid": r"^\d{1,9}$", "pmcid": r"^PMC\d+$",
    "isbn": r"^[\d\-]{10,17}$", "lccn": r"(?i)^[\da-z\-]{1,12}$",
}


def missing(c: Column) -> Column:
    """True for null and the empty string, which mean the same."""
    return F.coalesce(c, F.lit("")) == ""


# fixed values: letters that decompose into nothing, and marks, with what they are read as
_READ_AS = dict(zip("øØłŁđĐħĦıŧŦ‘’“”–—‐‑−", "oOlLdDhHitT''\"\"-----"))
_SPELT = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}


def _plain_letters() -> dict[str, str]:
    """Latin letters with marks and the letter below them."""
    parts = {c: unicodedata.normalize("NFKD", c) for c in map(chr, range(0xC0, 0x250))}
    return {c: p[0] for c, p in parts.items() if len(p) > 1 and p[0].isascii() and all(map(unicodedata.combining, p[1:]))}


def transliterate(c: Column) -> Column:
    """Latin letters without their marks, quotes and dashes in ASCII. Other scripts stay."""
    for a, b in _SPELT.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    table = _plain_letters() | _READ_AS
    return F.translate(c, "".join(table), "".join(table.values()))


def plain(s: str) -> str:
    """``transliterate`` of a string; marks of other scripts go as well."""
    for a, b in _SPELT.items():
        s = s.replace(a, b)
    s = unicodedata.normalize("NFKD", s.translate(str.maketrans(_READ_AS)))
    return "".join(c for c in s if not unicodedata.combining(c))


def normalize_title(c: Column) -> Column:
    """Transliterated, lower case, commands unwrapped, braces, ties and backslashes blanked, quotes dropped, blanks collapsed."""
    c = F.lower(transliterate(c))
    c = F.regexp_replace(c, r"\\[a-z]+\{([^}]*)\}", "$1")
    c = F.regexp_replace(c, r"[{}~\\]", " ")
    c = F.regexp_replace(c, "[\"'`]", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_venue(c: Column) -> Column:
    """Normalised title without boilerplate prefixes (each taken off once, in order) and a trailing year."""
    v = normalize_title(c)
    v = F.regexp_replace(v, "^" + "".join(f"(?:{re.escape(p)})?" for p in VENUE_PREFIXES), "")
    return F.regexp_replace(v, r"[,\s]+\d{4}$", "")


def strip_doi(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"^https?://doi\.org/", "")


def valid_id(kind: str, c: Column) -> Column:
    """True if the identifier has its kind's format; null counts as not."""
    return F.coalesce((strip_doi(c) if kind == "doi" else c).rlike(ID_FORMATS[kind]), F.lit(False))


def normalize_url(c: Column) -> Column:
    """Scheme and host lower-case, default port, fragment, trailing slash and tracking parameters dropped; other parameters keep their order."""
    u = F.trim(c)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING)), "&")
    full = F.concat(scheme, F.lit("://"), host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(scheme == "", u).otherwise(full)


def synthetic_key(url: Column) -> Column:
    """A key for a source that has only an address."""
    return F.concat(F.lit("fn_"), F.left(F.sha2(url, 256), F.lit(10)))


def year_matches(a: Column, b: Column) -> Column:
    """Years agree within one; what isn't a year agrees with all."""
    ya = F.when(a.cast("string").rlike(r"^\d+$"), a.cast("int"))
    yb = F.when(b.cast("string").rlike(r"^\d+$"), b.cast("int"))
    return F.coalesce(F.abs(ya - yb) <= 1, F.lit(True))


def prompt_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *parts), 256)


def access_tier(api_match: Column, local_file: Column, override: Column) -> Column:
    """T1: verified and at hand; T2: verified; T3: neither. A manual override comes first."""
    local = ~missing(local_file)
    return (F.when(~missing(override), override).when(api_match == "web_dead", "T3")
            .when(api_match == "web_verified", F.when(local, "T1").otherwise("T2")).when(api_match == "web_blocked", "T2")
            .when(~api_match.isin("verified", "mismatch") | api_match.isNull(), "T3").when(local, "T1").otherwise("T2"))


def is_dead_status(c: Column) -> Column:
    return c.isin(404, 410)


def inverted(words: Column) -> Column:
    """``map<word, array<position>>`` of an array of words, where the array is."""
    def index(arrays: pd.Series) -> pd.Series:
        out = []
        for row in arrays:
            at: dict[str, list[int]] = {}
            for i, w in enumerate(row if row is not None else ()):
                at.setdefault(w, []).append(i)
            out.append(None if row is None else at)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(index, "map<string, array<int>>")(words)


def decode_inverted(index: Column) -> Column:
    """``map<word, array<position>>`` to text."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def acquisition_exhausted(reasons: Column, definitive: list[str]) -> Column:
    """There are reasons, and every one of them is definitive."""
    return (F.size(reasons) > 0) & F.forall(reasons, lambda r: F.exists(F.array(*map(F.lit, definitive)), lambda d: F.contains(r, d)))


def fold(c: Column) -> Column:
    """Compatibility forms, no combining marks, lower case, blanks collapsed: for matching in any script."""
    blanks, others = re.compile(r"\s+"), re.compile(r"[^\x00-\x7f]")

    def bare(t: str) -> str:  # ASCII has no other forms and no marks
        return t if t.isascii() else others.sub(lambda m: "" if unicodedata.combining(m[0]) else m[0], unicodedata.normalize("NFKD", t))

    def folded(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else blanks.sub(" ", bare(t).lower()))

    folded.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(folded, "string")(c)


# fixed values: words that begin a family name
PARTICLES = ["van", "de", "von", "der", "den", "du", "da", "la", "le"]


def last_token_surname(name: Column) -> Column:
    """What stands before a comma, else the last word."""
    n = F.trim(name)
    return F.when(F.contains(n, F.lit(",")), F.trim(F.substring_index(n, ",", 1))).otherwise(F.coalesce(F.get(F.split(n, r"\s+"), F.size(F.split(n, r"\s+")) - 1), F.lit("")))


def particle_surname(name: Column) -> Column:
    """What stands before a comma, else the words from the first particle on, else the last word."""
    words = F.split(F.trim(name), r"\s+")
    at = F.array_position(F.transform(words, lambda w: F.lower(w).isin(PARTICLES)), True)
    return F.when(F.contains(F.trim(name), F.lit(",")) | (at == 0), last_token_surname(name)).otherwise(F.array_join(F.slice(words, at.cast("int"), F.size(words)), " "))


def search_query(title: Column, surname: Column) -> Column:
    """A title without marks but hyphens, after the first author's name, if there is one."""
    plain = F.trim(F.regexp_replace(title, r"(?U)[^\w\s-]", ""))
    return F.when(missing(surname), plain).otherwise(F.concat(surname, F.lit(" "), plain))


def status_reason(code: Column) -> Column:
    return F.when(code.isin(401, 403, 405, 429, 451), F.concat(F.lit("site (HTTP "), code, F.lit(")"))).when((code >= 500) & (code < 600), F.concat(F.lit("server error (HTTP "), code, F.lit(")"))).otherwise(F.concat(F.lit("HTTP "), code))


def coerce_year(value: Column) -> Column:
    """The year that the first four characters give, from 1500 to 2100; else null."""
    y = F.when(F.left(F.trim(value), F.lit(4)).rlike(r"^\d{1,4}$"), F.left(F.trim(value), F.lit(4)).cast("int"))
    return F.when(y.between(1500, 2100), y)


def year_in_text(text: Column, year: Column) -> Column:
    """True where the year stands as a number of its own."""
    return F.coalesce(F.regexp_like(text, F.concat(F.lit(r"(?<!\d)"), year.cast("string"), F.lit(r"(?!\d)"))), F.lit(False))


def local_kind(path: Column) -> Column:
    """pdf, web_page, summary or none, by the file's name."""
    return F.when(path.endswith(".pdf"), "pdf").when(path.endswith(".md"), F.when(F.contains(path, F.lit("_web")), "web_page").otherwise("summary")).otherwise("none")


# fixed values: what an issue says, in this order, with level and rule
ISSUE_RULES = [
    ("dead url", "error", "reference-exists"), ("blocked by ", "warning", "reference-exists"), ("web content saved", "info", "reference-exists"),
    ("content extraction failed", "warning", "reference-exists"), ("not found", "error", "reference-exists"), ("retracted", "error", "retracted-cite"),
    ("mismatch", "warning", "reference-accuracy"), ("unverified url identifier", "info", "reference-accuracy"),
    ("open access pdf available", "info", "reference-exists"), ("doi available but missing", "info", "reference-exists"),
]


def issue_rule(issue: Column) -> Column:
    """``struct<level, rule>`` of an issue's text."""
    low, out = F.lower(issue), F.struct(F.lit("warning").alias("level"), F.lit("reference-exists").alias("rule"))
    for text, level, rule in reversed(ISSUE_RULES):
        out = F.when(F.contains(low, F.lit(text)), F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))).otherwise(out)
    return out
