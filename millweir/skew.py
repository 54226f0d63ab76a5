"""Joins on keys of which one may hold a third of all rows.

A key is hot when it holds more than 1/SLICES of the rows, so there are fewer than SLICES hot keys whatever the input: their list
is bounded and may go to the driver. Rows of a hot key are dealt over as many salts as it has such slices; the other side,
which has one row a key, is repeated once for each salt of its key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICES = 64
#: Tables that the planner takes for smaller are joined as they are: their hot keys fit a task.
LEAST_BYTES = 256 << 20
#: A key with fewer rows is left alone whatever its share: any task can hold that many.
LEAST_ROWS = 10_000


def hot_keys(df: DataFrame, key: str, slices: int = SLICES) -> list[tuple[object, int]]:
    """(key, number of salts) of each hot key, at most slices of them. Counts are combined map-side; nulls are no keys."""
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc("k")).limit(slices).collect()
    if not top:
        return []
    if top[0].n < LEAST_ROWS:
        return []
    total = df.count()
    return [(r.k, min(slices, -(-r.n * slices // total))) for r in top if r.n >= LEAST_ROWS and r.n * slices > total]


def hot_of(counts: DataFrame, key: str, n: str = "n", slices: int = SLICES) -> list[tuple[object, int]]:
    """hot_keys from counts that are known already, one row a key; keys left out of them can't be hot."""
    top = counts.where(F.col(key).isNotNull()).orderBy(F.desc(n), F.asc(key)).limit(slices).select(F.col(key).alias("k"), F.col(n).alias("n")).collect()
    if not top or top[0].n < LEAST_ROWS:
        return []
    total = counts.agg(F.sum(n)).first()[0]
    return [(r.k, min(slices, -(-r.n * slices // total))) for r in top if r.n >= LEAST_ROWS and r.n * slices > total]


def salts_of(key: Column, hot: list[tuple[object, int]]) -> Column:
    """How many salts a key has: 1 unless it is hot."""
    salts = F.create_map(*[F.lit(x) for pair in hot for x in pair])
    return F.coalesce(F.element_at(salts, key), F.lit(1))


def salted_join(rows: DataFrame, keyed: DataFrame, key: str, spread: Column, how: str = "inner", hint: str | None = None, hot: list[tuple[object, int]] | None = None) -> DataFrame:
    """rows join keyed on key, where keyed has one row a key. spread: what deals the rows of a hot key, such as their id."""
    hot = hot_keys(rows, key) if hot is None else hot
    if not hot:
        return rows.join(keyed.hint(hint) if hint else keyed, key, how)
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), salts_of(F.col(key), hot).cast("long")).cast("int"))
    right = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts_of(F.col(key), hot) - 1)))
    return left.join(right.hint(hint) if hint else right, [key, "_salt"], how).drop("_salt")


def _estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread_join(rows: DataFrame, other: DataFrame, on: list[tuple[Column, Column]], how: str = "left", nulls_match: bool = True) -> DataFrame:
    """rows join other on pairs of columns, where one key of rows, null as well, may hold a third of them.

    how: inner, left, left_semi or left_anti. The sides have no column names in common. Hot keys are found by a count of the keys'
    hashes; their rows are dealt over salts by what they hold, so that a task run again deals them alike; other's rows are repeated for
    each salt. Beyond hot keys the planner decides.
    """
    same = reduce(lambda a, b: a & b, [a.eqNullSafe(b) if nulls_match else a == b for a, b in on])
    if _estimated_bytes(rows) < LEAST_BYTES:
        return rows.join(other, same, how)
    left = rows.withColumn("_hash", F.xxhash64(*[a for a, _ in on]))
    hot = hot_keys(left, "_hash")
    if not hot:
        return rows.join(other, same, how)
    content = [F.col("`" + f.name.replace("`", "``") + "`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    left = left.withColumn("_salt", F.pmod(F.xxhash64(F.lit(5), *content), salts_of(F.col("_hash"), hot).cast("long")).cast("int"))
    right = other.withColumn("_hash2", F.xxhash64(*[b for _, b in on]))
    right = right.withColumn("_salt2", F.explode(F.sequence(F.lit(0), salts_of(F.col("_hash2"), hot) - 1)))
    return left.join(right, (F.col("_hash") == F.col("_hash2")) & (F.col("_salt") == F.col("_salt2")) & same, how).drop("_hash", "_salt", "_hash2", "_salt2")
