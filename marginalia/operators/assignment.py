"""One-to-one assignments: findings to what was expected, files to references.

Choosers of a group take their turns in ascending order, and each takes what it
wants most of what is left. Groups of up to 2000 wishes are a row each, whose
turns are a fold, in one pass over all of them. Larger groups go in rounds: a
chooser whose first wish no earlier chooser has on its list at all gets it, for
all groups at once. Each round settles at least the first chooser of every
group, and what it settles is merged with earlier rounds' as it piles up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import scalars
from marginalia.operators import matching
from marginalia.scratch import Scratch

# fixed values: kinds of files by folder, and how alike a file's name and a title have to be
SUFFIXES = {"academic": [".pdf", ".md"], "web": [".md", ".mhtml", ".mht"]}
ALIKE = 0.80
#: Wishes of a group that takes its turns as one row, and rounds after which what is settled becomes one table.
SMALL, MERGED = 2000, 16


def _by_fold(wishes: DataFrame) -> DataFrame:
    """Turns of small groups: choosers in their order, each with its items in the order it wants them."""
    lists = wishes.groupBy("grp", "chooser").agg(F.transform(F.array_sort(F.collect_list(F.struct("wish", "item"))), lambda w: w["item"]).alias("items"))
    turns = lists.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("chooser", "items"))).alias("turns"))
    none = F.array().cast(f"array<{wishes.schema['item'].dataType.simpleString()}>")
    # what is taken so far, a null for a turn without: the k-th is the k-th chooser's
    got = F.aggregate("turns", none, lambda taken, t: F.array_append(taken, F.get(F.array_except(t["items"], taken), F.lit(0))))
    rows = turns.select("grp", F.explode(F.zip_with("turns", got, lambda t, i: F.struct(t["chooser"].alias("chooser"), i.alias("item")))).alias("t"))
    return rows.select("grp", "t.chooser", "t.item").where("item IS NOT NULL")


def _in_rounds(scratch: Scratch, left: DataFrame) -> DataFrame:
    """Turns of groups of any size; drops ``left``."""
    settled = []
    while not left.isEmpty():
        first = left.groupBy("grp", "chooser").agg(F.min(F.struct("wish", "item")).alias("best")).select("grp", "chooser", F.col("best.item").alias("item"))
        ahead = left.groupBy("grp", "item").agg(F.min("chooser").alias("chooser"))
        taken = scratch.put(first.join(ahead, ["grp", "chooser", "item"]), "taken")
        settled.append(taken)
        rest = scratch.put(left.join(taken.select("grp", "chooser"), ["grp", "chooser"], "left_anti").join(taken.select("grp", "item"), ["grp", "item"], "left_anti").select(*left.columns), "wishes")
        scratch.drop(left)
        left = rest
        if len(settled) == MERGED:
            merged = scratch.put(reduce(DataFrame.unionByName, settled), "settled")
            scratch.drop(*settled)
            settled = [merged]
    return reduce(DataFrame.unionByName, settled, left.select("grp", "chooser", "item"))


def in_turn(wishes: DataFrame, small: int = SMALL) -> DataFrame:
    """``(grp, chooser, item)`` of ``(grp, chooser, item, wish)``: the smallest wish is wanted most, then the smallest item."""
    scratch = Scratch(wishes.sparkSession, "assignment")
    every = scratch.put(wishes.select("grp", "chooser", "item", "wish").where("grp IS NOT NULL AND chooser IS NOT NULL AND item IS NOT NULL"), "wishes")
    large = scratch.put(every.groupBy("grp").count().where(F.col("count") > small).select("grp"), "large")
    if large.isEmpty():
        return _by_fold(every)
    rounds = _in_rounds(scratch, scratch.put(every.join(large, "grp", "left_semi"), "wishes"))
    return _by_fold(every.join(large, "grp", "left_anti")).unionByName(rounds)


# ---- findings and expectations -----------------------------------------------------------------------------------


def matched_findings(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """``(grp, exp, finding)``: each expectation with the number of the finding that meets it, or null.

    expected is ``(grp, check, exp, context)``, findings ``(grp, check, finding,
    context, message)``. In their order, expectations take the first finding of
    their check that is left and whose context or message holds theirs; an
    empty context takes any, null none.
    """
    e = expected.select("grp", "check", "exp", F.col("context").alias("wanted"))
    f = findings.select("grp", "check", "finding", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("message", F.lit("")).alias("message"))
    meets = (F.col("wanted") == "") | F.contains("context", F.col("wanted")) | F.contains("message", F.col("wanted"))
    pairs = e.join(f, ["grp", "check"]).where(meets)
    grp = F.struct("grp", "check")
    got = in_turn(pairs.select(grp.alias("grp"), F.col("exp").alias("chooser"), F.col("finding").alias("item"), F.col("finding").alias("wish")))
    got = got.select("grp.grp", "grp.check", F.col("chooser").alias("exp"), F.col("item").alias("finding"))
    return expected.select("grp", "check", "exp").join(got, ["grp", "check", "exp"], "left")


def detection_counts(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """``(grp, check, tp, fp, fn)`` for every group and check of either side."""
    met = matched_findings(expected, findings).groupBy("grp", "check").agg(F.count("finding").alias("tp"), F.count_if(F.col("finding").isNull()).alias("fn"))
    made = findings.groupBy("grp", "check").agg(F.count("*").alias("made"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return met.join(made, ["grp", "check"], "full").select("grp", "check", zero("tp").alias("tp"), (zero("made") - zero("tp")).alias("fp"), zero("fn").alias("fn"))


# ---- files and references ----------------------------------------------------------------------------------------


def file_stem(name: Column) -> Column:
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def file_title(name: Column) -> Column:
    """A file's name as a title: no suffix, separators as blanks, letters, digits and blanks only."""
    c = F.lower(F.regexp_replace(file_stem(name), r"[_\-.]+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9 ]", ""), r"\s+", " "))


def assigned_files(files: DataFrame, references: DataFrame, folder: str = "academic") -> DataFrame:
    """``(paper, key, name, pass)`` of files ``(paper, name)`` and references ``(paper, key, ord, title)``.

    First the files whose leading letters and digits are a key, in any case:
    each key has the first such file. Then the others, in the order of their
    names, take the reference left whose title is most like theirs, at 0.8 or
    more, the first on a tie. Files of other kinds are left out. A key that
    differs from a later one in case alone is hidden by it in the first pass.
    Pairs of a paper are scored only if their lengths allow a ratio of 0.8, each
    pair of strings once.
    """
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    files = files.where(suffix.isin(SUFFIXES[folder])).select("paper", "name").distinct()
    token = F.lower(F.regexp_extract(file_stem(F.col("name")), r"^[A-Za-z0-9]+", 0))
    named = references.groupBy("paper", F.lower("key").alias("token")).agg(F.max_by("key", "ord").alias("key"))
    exact = files.withColumn("token", token).where("token <> ''").join(named, ["paper", "token"]).groupBy("paper", "key").agg(F.min("name").alias("name"))
    titles = references.join(exact.select("paper", "key"), ["paper", "key"], "left_anti").where("title <> ''").select("paper", "key", "ord", scalars.normalize_title(F.col("title")).alias("title"))
    left = files.join(exact.select("paper", "name"), ["paper", "name"], "left_anti").select("paper", "name", scalars.normalize_title(file_title(F.col("name"))).alias("read")).where("read <> ''")
    head = lambda c: F.char_length(F.trim(F.substring_index(c, ":", 1)))
    near = lambda a, b: 2 * F.least(a, b) >= ALIKE * (a + b) - 1e-9
    long = F.char_length("read")
    pairs = left.join(titles, "paper").where(near(long, F.char_length("title")) | near(long, head(F.col("title"))))
    texts = pairs.select("read", "title").distinct().withColumn("score", matching.title_similarity(F.col("read"), F.col("title"))).where(F.col("score") >= ALIKE)
    wishes = pairs.join(texts, ["read", "title"]).select(F.col("paper").alias("grp"), F.col("name").alias("chooser"), F.col("key").alias("item"), F.struct((-F.col("score")).alias("score"), "ord").alias("wish"))
    got = in_turn(wishes)
    return exact.select("paper", "key", "name", F.lit("key").alias("pass")).unionByName(got.select(F.col("grp").alias("paper"), F.col("item").alias("key"), F.col("chooser").alias("name"), F.lit("title").alias("pass")))


def preferred_files(academic: DataFrame, web: DataFrame, references: DataFrame) -> DataFrame:
    """Assigned files of both folders: a reference with an academic file takes no part in the web folder."""
    first = assigned_files(academic, references, "academic").withColumn("kind", F.lit("academic"))
    rest = references.join(first.select("paper", "key"), ["paper", "key"], "left_anti")
    return first.unionByName(assigned_files(web, rest, "web").withColumn("kind", F.lit("web")))
