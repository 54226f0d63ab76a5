"""References to records that do not exist (problem 5).

References and parent keys are hashed to the same partitions, sorted and merged once (a sort-merge join). Each parent key carries
its validity: the load from which it exists, and whether a log says it was removed. From that the merge tells three kinds apart:
missing (never seen), deleted (only in the log) and late (it exists, but from a later load than the referring row).
A key with a large share of the references is dealt over several tasks (skew.py); parents have one row a key there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millweir.skew import salted_join


def parent_validity(parents: DataFrame, deletions: DataFrame, key: str, load: str) -> DataFrame:
    """(ref, valid_from, gone): valid_from is null for a key that is only in the log of deletions."""
    there = parents.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("ref"), F.col(load).cast("int").alias("valid_from"), F.lit(True).alias("there"))
    gone = deletions.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("ref"), F.lit(None).cast("int").alias("valid_from"), F.lit(False).alias("there"))
    return there.unionByName(gone).groupBy("ref").agg(F.min("valid_from").alias("valid_from"), F.max("there").alias("there"))


def find_orphans(refs: DataFrame, validity: DataFrame, row_id: str, key: str, load: str) -> DataFrame:
    """Distinct (row_id, load_id, kind) of the rows of refs whose key has no parent at their load.

    A null key is no reference. A parent or a referring row without a load counts as there from the start, so it's never late.
    Rows delivered twice in one load come out once. Other columns of refs are not read; empty tables give an empty result.
    """
    rows = refs.where(F.col(key).isNotNull()).select(F.col(row_id).cast("long").alias("row_id"), F.col(key).cast("long").alias("ref"), F.col(load).cast("int").alias("load_id"))
    merged = salted_join(rows, validity, "ref", F.struct("row_id", "load_id"), "left", "merge")
    kind = (
        F.when(F.col("there").isNull(), "missing")
        .when(~F.col("there"), "deleted")
        .when(F.col("valid_from") > F.col("load_id"), "late")
    )
    return merged.select("row_id", "load_id", kind.alias("kind")).where(F.col("kind").isNotNull()).distinct()


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, load and kind."""
    return found.groupBy("tbl_name", "load_id", "kind").agg(F.count(F.lit(1)).alias("n_rows"))
