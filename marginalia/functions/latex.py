"""LaTeX to plain text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: environments that hold no prose
NOT_PROSE = ["tikzpicture", "tabular", "figure", "table", "equation", "align"]


def strip_comments(text: Column) -> Column:
    """Comments to the end of their line; an escaped ``%`` stays."""
    return F.regexp_replace(text, r"(?m)(?<!\\)%.*$", "")


# fixed values: environments and the command whose content is printed as it stands
VERBATIM = r"(?s)\\begin\{(lstlisting|verbatim|minted|Verbatim|alltt)\}.*?\\end\{\1\}"
VERB = r"\\verb(.)(.*?)\1"


def strip_verbatim(text: Column) -> Column:
    """Verbatim blocks become as many line feeds as they had, so that line numbers hold; what is printed inline goes."""
    blocks = F.regexp_extract_all(text, F.lit(VERBATIM), 0)
    feeds = lambda b: F.repeat(F.lit("\n"), F.coalesce(F.length(b) - F.length(F.replace(b, F.lit("\n"), F.lit(""))), F.lit(0)))
    kept = F.array_join(F.zip_with(F.split(text, VERBATIM, -1), blocks, lambda part, b: F.concat(part, feeds(b))), "")
    return F.regexp_replace(F.when(F.size(blocks) == 0, text).otherwise(kept), VERB, "")


def body(text: Column) -> Column:
    """What stands between the document's begin and end; all of it, if it has neither."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)\A.*?\\begin\{document\}", ""), r"(?s)\\end\{document\}.*\z", "")


def document_body(text: Column) -> Column:
    """From the line after the document's begin to its end; all of it, if either is missing."""
    begin, end = F.instr(text, r"\begin{document}"), F.instr(text, r"\end{document}")
    feed = F.call_function("locate", F.lit("\n"), text, begin)
    start = F.when(feed > 0, feed + 1).otherwise(begin)
    return F.when((begin > 0) & (end > 0), F.substring(text, start, F.greatest(end - start, F.lit(0)))).otherwise(text)


def prose(text: Column) -> Column:
    """Without environments that hold no prose."""
    return F.regexp_replace(text, r"(?s)\\begin\{(" + "|".join(NOT_PROSE) + r")\*?\}.*?\\end\{\1\*?\}", "")


def clean_latex(text: Column, target: str | None = None) -> Column:
    """Markup unwrapped: emphasis, then citations to ``[CITE]`` (``[TARGET_CITE]`` if they name the target), flat footnotes dropped, other commands unwrapped, blanks collapsed."""
    c = F.regexp_replace(text, r"\\(?:textbf|textit|emph|texttt)\{([^{}]*)\}", "$1")
    if target:
        c = F.regexp_replace(c, r"\\cite(?:unverified|[tp]|yearpar)?\{(?:[^}]*,)?\s*\Q" + target + r"\E\s*(?:,[^}]*)?\}", "[TARGET_CITE]")
    c = F.regexp_replace(c, r"\\cite(?:unverified|[tp]|yearpar)?\{[^}]*\}", "[CITE]")
    c = F.regexp_replace(c, r"\\footnote\{[^{}]*\}", "")
    c = F.regexp_replace(c, r"\\[a-zA-Z]+\*?\{([^{}]*)\}", "$1")
    c = F.regexp_replace(c, r"[{}~]", " ")
    c = F.regexp_replace(c, r"\\\\", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def word_count(text: Column) -> Column:
    """Words without commands and addresses."""
    c = F.regexp_replace(F.regexp_replace(text, r"https?://\S+", " "), r"\\[a-zA-Z]+\*?", " ")
    return F.size(F.filter(F.split(c, r"[\s{}]+"), lambda w: w.rlike(r"\w")))
