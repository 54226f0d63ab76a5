"""Duplicates hidden by formatting differences (problem 2).

Values are stripped to ASCII letters and digits in lower case; the fields of a record may hold them in any order. Classes of equal
records are refined in steps: first by a cheap invariant (stripped length and a histogram of letter classes, one long a record),
whose counts are combined before the shuffle; only records of classes with several members get the costly exact key. Groups are
aggregates, never collected; a group that holds a large share of the records is dealt over several tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millweir.session import materialize
from millweir.skew import hot_of, salted_join

#: The letter classes of the histogram.
LETTER_CLASSES = ["aeiou", "lnrst", "bcdfg", "hjkmp", "01", "23", "45", "67", "8"]


def stripped(col: Column) -> Column:
    return F.lower(F.regexp_replace(col.cast("string"), "[^A-Za-z0-9]", ""))


def _invariant(values: Column) -> Column:
    """Of the fields' stripped values in any order: total length and how many characters fall in each class."""
    text = F.array_join(values, "")
    counts = [F.length(text) - F.length(F.translate(text, letters, "")) for letters in LETTER_CLASSES]
    return F.xxhash64(F.length(text), *counts)


def find_copies(df: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """(row_id, kept_id, n_copies) of each record that has copies; the record kept has row_id = kept_id, the smallest of its group.

    A record with a null field, or one that is empty after stripping, has no copies. Records repeated under one id count as copies
    of each other but come out once. Other columns are not read. An empty table gives no rows.
    """
    values = [stripped(F.col(f"`{f}`")) for f in fields]
    full = reduce(lambda a, b: a & b, [F.coalesce(F.length(v) > 0, F.lit(False)) for v in values])
    rows = df.select(F.col(f"`{row_id}`").alias("row_id"), F.array_sort(F.array(*values)).alias("key"), full.alias("full")).where("full").drop("full")
    rows = rows.withColumn("cheap", _invariant(F.col("key")))
    several = materialize(rows.groupBy("cheap").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    left = materialize(salted_join(rows, several.select("cheap"), "cheap", F.col("row_id"), hot=hot_of(several, "cheap")).select("row_id", F.array_join("key", "|").alias("key")).withColumn("hash", F.xxhash64("key")), "copies")
    groups = left.groupBy("hash", "key").agg(F.min("row_id").alias("kept_id"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    # two keys may share a hash: salts repeat a group once a salt, and the full key decides
    joined = salted_join(left, groups.withColumnRenamed("key", "group_key"), "hash", F.col("row_id"))
    return joined.where(F.col("key") == F.col("group_key")).select("row_id", "kept_id", "n_copies").distinct()


def collapse(df: DataFrame, row_id: str, found: DataFrame) -> DataFrame:
    """df without the copies that aren't kept, with n_copies (1 for a record without copies)."""
    drop = found.where("row_id <> kept_id").select(F.col("row_id").alias("_id"))
    kept = found.where("row_id = kept_id").select(F.col("row_id").alias("_id"), F.col("n_copies").alias("_n"))
    rest = df.join(drop, df[row_id] == drop["_id"], "left_anti")
    counts = rest.join(kept, rest[row_id] == kept["_id"], "left")
    return counts.select(*[rest[c] for c in df.columns], F.coalesce("_n", F.lit(1)).cast("long").alias("n_copies"))
