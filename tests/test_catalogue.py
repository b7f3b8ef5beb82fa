"""Every registered query with SQL gives the rows of its SQL, on the smallest tables."""

import duckdb
import pytest

from marginalia.plans import catalogues, evaluation, evidence, files, findings, records, reviews, structure, texts  # noqa: F401  all add to the catalogue
from marginalia.plans.catalogue import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def normal(pdf):
    cols = sorted(pdf.columns)

    def cell(v):
        if v is None or v != v:
            return "-"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return cols, sorted(tuple(cell(v) for v in row) for row in pdf[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    assert normal(QUERIES[name](spark, DIR).toPandas()) == normal(duck.execute(SQL[name]).fetchdf())


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_fuzzy_part_matches_equal_brute_force(spark, sf):
    """The one query without SQL; the smallest tables hold no pair that is near enough."""
    d = f"/root/testdata/sf{sf}"
    pairs = duckdb.sql(f"""SELECT a.p_partkey, b.p_partkey, a.p_name, b.p_name FROM '{d}/part.parquet' a
        JOIN '{d}/part.parquet' b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""").fetchall()
    best = {}
    for key, other, x, y in pairs:
        best[key] = max(best.get(key, (0, 0)), (2 * common(x, y) / (len(x) + len(y)), -other))
    want = {key: (-other, score) for key, (score, other) in best.items() if score >= 0.4}
    got = QUERIES["fuzzy_part_matches"](spark, d).collect()
    assert len(got) == len(want) and {r["key"]: r["ord"] for r in got} == {k: o for k, (o, _) in want.items()}
    assert all(r["score"] == pytest.approx(want[r["key"]][1]) for r in got)


def test_only_fuzzy_part_matches_lacks_sql():
    assert set(QUERIES) - set(SQL) == {"fuzzy_part_matches"}
