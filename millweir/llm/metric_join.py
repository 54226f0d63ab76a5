"""Exact radius joins of strings under the Damerau-Levenshtein metric, by metric-space partitioning.

Every distinct string of a cell is a pivot of its own, at distance 0. By the triangle inequality all strings within the radius r of it
lie within 0 + r of its pivot, so repeating each string in the cells of the pivots within r, and joining inside cells, loses nothing.
Pivots drawn as a sample don't part typed names, which all lie at much the same distance from each other: with 512 pivots for 5 362
names, radius 2, a name is repeated in 75 cells, and the cells hold eleven times as many pairs as the whole table.

The pivots within r of a string are found by signatures that two strings within r always share: what is left of a short one after
deleting up to r letters, the pieces of a long one. A cell of up to CELL strings is joined as it is: letters that two strings don't
share rule out nearly all pairs at a few nanoseconds each, while signatures write some 230 rows for each string of eleven letters.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millweir.llm.editing import distance
from millweir.session import materialize, release
from millweir.skew import hot_of, salted_join

#: Strings that a cell may hold before signatures part it, and deletion signatures that a string may have before pieces take their place.
CELL, MOST_SIGNATURES = 10_000, 1000


@functools.cache
def longest_deleted(radius: int) -> int:
    """The greatest length at which a string has at most MOST_SIGNATURES deletion signatures."""
    n = radius
    while sum(comb(n + 1, k) for k in range(radius + 1)) <= MOST_SIGNATURES and n < 200:
        n += 1
    return n


def signatures(key: str, radius: int) -> set[str]:
    """Strings of which two keys within the radius share at least one.

    Each edit, swaps as well, costs each side one letter at most, so both leave the same rest after up to radius deletions. As plain
    edits they are 2 radius at most: of 2 radius + 1 pieces one is untouched, and it moves by radius places at most.
    """
    n, out = len(key), set()
    if n <= longest_deleted(radius):
        out = {"".join(kept) for k in range(min(radius, n) + 1) for kept in combinations(key, n - k)}
    if n > longest_deleted(radius) - radius:  # lengths that meet keys on both sides of the limit have signatures of both kinds
        count = 2 * radius + 1
        for size in range(max(count, n - radius), n + radius + 1):
            for i in range(count):
                start, end = size * i // count, size * (i + 1) // count
                out.update(f"{size}|{i}|{key[at : at + end - start]}" for at in range(max(0, start - radius), min(n - end + start, start + radius) + 1))
    return out


class Near:
    """A bounded vocabulary, looked up by spelling."""

    def __init__(self, words: list[str] | set[str], radius: int = 2) -> None:
        self.radius, self.at = radius, defaultdict(list)
        for word in sorted(words):
            for sign in signatures(word, radius):
                self.at[sign].append(word)

    def of(self, word: str) -> list[tuple[int, str]]:
        """(distance, word of the vocabulary) within the radius, nearest first."""
        met = {w for sign in signatures(word, self.radius) for w in self.at.get(sign, ())}
        return sorted((d, w) for w in met if (d := distance(word, w, self.radius)) <= self.radius)


def _parted(items: DataFrame, radius: int, cell: int) -> DataFrame:
    """items with cell replaced by a hash, and those of large cells repeated once for each signature of their key."""
    large = materialize(items.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cell), "large")
    if not large.limit(1).count():
        release(large)
        return items.withColumn("cell", F.xxhash64("cell"))
    names, schema = items.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                signs = [sorted(signatures(k, radius)) for k in part.column(names.index("key")).to_pylist()]
                rows = part.take(pa.array([i for i, s in enumerate(signs) for _ in s], pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([x for s in signs for x in s], pa.string())], [*names, "_sign"])

    marked = salted_join(items, large, "cell", F.col("node"), "left", hot=hot_of(large, "cell", "_n"))
    small = marked.where("_n is null").select(*names).withColumn("cell", F.xxhash64("cell"))
    repeated = marked.where("_n is not null").select(*names).mapInArrow(run, schema + ", _sign string")
    return small.unionByName(repeated.withColumn("cell", F.xxhash64("cell", "_sign")).drop("_sign"))


def _letters(key: Column) -> Column:
    """Two bits a letter, set where the key has it once, twice or more: an edit changes two bits at most, a swap none."""
    times = [F.length(key) - F.length(F.replace(key, F.lit(c), F.lit(""))) for c in "abcdefghijklmnopqrstuvwxyz"]
    return reduce(lambda x, y: x + y, [F.when(n > 1, F.lit(3 << 2 * i)).when(n > 0, F.lit(1 << 2 * i)).otherwise(F.lit(0)).cast("long") for i, n in enumerate(times)])


def near_pairs(items: DataFrame, radius: int, fits: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None, cell: int = CELL) -> DataFrame:
    """(a, b, d, a_*, b_*): all pairs of nodes a < b of one cell whose keys are within the radius, d being their distance.

    items: (cell, node, key, ...), one row a cell and node; a column turns (array) holds other orders of a key's words, of which the nearest
    counts. fits: a further condition on the two sides' columns. Other columns come out as a_name and b_name. Nulls are left out.
    """
    items = items.where("cell is not null and key is not null and node is not null")
    others = [c for c in items.columns if c not in ("cell", "node")]
    turned = "turns" in others
    # both sides of the join read the same exchange
    split = _parted(items, radius, cell).repartition("cell")
    left = split.select("cell", F.col("node").alias("a"), *[F.col(c).alias(f"a_{c}") for c in others], _letters(F.col("key")).alias("_a"))
    right = split.select("cell", F.col("node").alias("b"), *[F.col(c).alias(f"b_{c}") for c in others], _letters(F.col("key")).alias("_b"))
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    # s swaps and o other edits, radius at most, are 2 s + o plain edits and change 2 o bits of letters
    bits = F.bit_count(F.col("_a").bitwiseXOR(F.col("_b")))
    plain = lambda x, y: F.call_function("levenshtein", x, y, F.lit(2 * radius) - F.shiftright(bits + 1, 1)) >= 0
    near = plain(a("key"), b("key"))
    if turned:
        near = near | ((F.size(b("turns")) > 0) & F.exists(b("turns"), lambda t: plain(a("key"), t)))
    near = (bits <= 2 * radius) & (F.abs(F.length(a("key")) - F.length(b("key"))) <= radius) & near
    met = left.join(right, "cell").where((F.col("a") < F.col("b")) & (near if fits is None else near & fits(a, b))).drop("cell", "_a", "_b")
    met = met.dropDuplicates(["a", "b", "a_key", "b_key"])
    at = {c: i for i, c in enumerate(met.columns)}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema.fields)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(at[c]).to_pylist() for c in ("a_key", "b_key"))
            d = [distance(p, q, radius) for p, q in zip(x, y, strict=True)]
            if turned:
                d = [min([n, *(distance(p, t, radius) for t in ts)]) for n, p, ts in zip(d, x, batch.column(at["b_turns"]).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d, pa.int32())], [*batch.schema.names, "d"])

    return met.mapInArrow(measure, schema + ", d int").where(F.col("d") <= radius)
