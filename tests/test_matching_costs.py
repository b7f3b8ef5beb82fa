"""Matching costs what its distinct work costs, and is spread over tasks."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from marginalia.functions import scalars
from marginalia.operators import matching
from marginalia.plans import catalogue, files, records  # noqa: F401  the others add to it

DIR = "/root/testdata/sf0.001"


def tasks(df):
    return df.rdd.getNumPartitions()


def test_accepted_files_and_references_take_many_tasks(spark):
    assert tasks(catalogue.QUERIES["accepted_files"](spark, DIR)) > 4 and tasks(catalogue.QUERIES["reference_accuracy"](spark, DIR)) > 4


def test_a_venue_is_normalised_once(spark):
    venues = ["Proceedings of the Proceedings of X 2001", "In Proc. Y, 1999", "Proc. In Z", "proceedings of", "A.proc. B", "Proceedings of the In Proceedings of Q"]
    rows = spark.createDataFrame([(v,) for v in venues], "v string").select("v", scalars.normalize_venue(F.col("v")).alias("n"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    for r in rows.collect():
        want = re.sub(r"\s+", " ", r["v"].lower()).strip(" ")
        for p in scalars.VENUE_PREFIXES:
            want = want.removeprefix(p)
        assert r["n"] == re.sub(r"[,\s]+\d{4}$", "", want)


def test_ratios_equal_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcde ") for _ in range(rng.randrange(12))) for _ in range(2))
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        windows = [long[max(0, i) : i + len(short)] for i in range(1 - len(short), len(long))]
        want = max(matching.indel_ratio(short, w) for w in windows) if short else float(not long)
        assert matching.partial_ratio(a, b) == want
    assert matching.best_title_ratio("a: b", "a") == 1.0 and matching.best_title_ratio(": x", ": y") == 1.0 and matching.best_title_ratio("", "a") == 0.0


def test_fold_equals_plain_version(spark):
    texts = ["Lée   A\tB", "plain\x1c ascii", "ＦＵＬＬ ﬁ", "İstanbul Straße", "नमस्ते é", "", None]
    plain = lambda t: None if t is None else re.sub(r"\s+", " ", "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)).lower())
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.fold(F.col("t")).alias("f")).collect()
    assert all(r["f"] == plain(r["t"]) for r in rows)


def test_tasks_of_claims_grow_with_the_input(spark):
    """Windows hold a task's rows, so its share may not grow with the table."""
    plan = catalogue.QUERIES["limited_claims"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 1
