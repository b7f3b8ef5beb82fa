"""Column helpers shared by the operators on text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Splits before lower-casing: A-Z are word characters there, as a-z are after it.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLANKS = " \t\n\x0b\f\r"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else. ``lower`` is quick on ASCII; only strings that it changes are translated."""
    return F.when(F.lower(c) == c, c).otherwise(F.translate(c, UPPER, LOWER))


def whole(c: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(c, F.lit(""))


def attach(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Left join on a key that a third of the rows may share.

    The key's most frequent values (each in over 1/2000 of all rows, so fewer
    than 2000 of them) go by broadcast, the others by shuffle. Rows without a
    key, however many, stay where they are.
    """
    n, without_key = rows.count(), rows.where(F.col(key).isNull())
    rows = rows.where(F.col(key).isNotNull())
    hot = F.broadcast(rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") * 2000 > n).select(key))
    by_value = small.join(hot, key, "left_semi")
    frequent = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(by_value), key, "left")
    rest = rows.join(hot, key, "left_anti").join(small.hint("merge"), key, "left")
    return frequent.unionByName(rest).unionByName(without_key, allowMissingColumns=True)


def without(docs: DataFrame, drop: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs that aren't in drop ``(doc_id, text_hash)``; a null id is a value like any other.

    Both sides are dealt by key whatever their size: drop grows with the input.
    """
    drop = drop.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"))
    kept = docs.withColumn("__th", F.xxhash64(whole(F.col(text_col))))
    return kept.join(drop.hint("merge"), F.col(id_col).eqNullSafe(F.col("__doc")) & (F.col("__th") == F.col("__hash")), "left_anti").select(*docs.columns)
