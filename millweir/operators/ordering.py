"""Row order, and fills along it, without gathering a table in one partition.

A table has an order by __row_id or by the columns that the context names. Global running steps work in two phases: rows are split by
range of the order key, each partition keeps what it needs from its end, and those few rows (one a partition) are carried on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millweir.functions import kernels as K
from millweir.functions.conditions import StepError
from millweir.operators.registry import ROW_ID, Context
from millweir.session import materialize
from millweir.skew import spread_join


def order_names(df: DataFrame, ctx: Context, first: str | None = None) -> list[str]:
    """The columns of the row order; first: one that goes before them."""
    names = [ROW_ID] if ROW_ID in df.columns else [c for c in ctx.order if c in df.columns]
    if first:
        names = [first, *[n for n in names if n != first]]
    if not names:
        raise StepError("this step depends on the order of rows: add __row_id or name the columns of the order")
    return names


def ascending(names: list[str]) -> list[Column]:
    return [K.col(c).asc_nulls_last() for c in names]


def rank_key(names: list[str]) -> Column:
    """A struct that compares as the order does, nulls last."""
    return F.struct(*[F.struct(K.col(c).isNull().alias("n"), K.col(c).alias("k")) for c in names])


def with_row_id(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """df with __row_id, ascending in the order of by, or in the order of the files. Written once, so that ids don't change."""
    rows = df
    if by:
        keys = [K.col(c).asc_nulls_last() for c in by]
        rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(rows.withColumn(ROW_ID, F.monotonically_increasing_id()), "rows")


def _slices(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows with the number of their range partition. Written once: bounds come from a sample and might differ if worked out twice."""
    return materialize(df.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id()), "slices")


def carry(df: DataFrame, names: list[str], values: dict[str, Column], forward: bool) -> DataFrame:
    """Each value replaced by the last non-null one up to its row (or the next one from it), over the whole table in its order."""
    keys = ascending(names)
    slices = _slices(df, keys)
    window = Window.partitionBy("_slice").orderBy(*keys)
    frame = window.rowsBetween(Window.unboundedPreceding, 0) if forward else window.rowsBetween(0, Window.unboundedFollowing)
    pick, edge = (F.last, F.max_by) if forward else (F.first, F.min_by)
    # what each slice hands over: its last (or first) non-null value
    ends = slices.groupBy("_slice").agg(*[edge(v, F.when(v.isNotNull(), rank_key(names))).alias(f"_end{i}") for i, v in enumerate(values.values())])
    along = Window.orderBy("_slice")  # one row a partition
    reach = along.rowsBetween(Window.unboundedPreceding, -1) if forward else along.rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select("_slice", *[pick(f"_end{i}", ignorenulls=True).over(reach).alias(f"_in{i}") for i in range(len(values))])
    joined = slices.join(F.broadcast(carried), "_slice")
    filled = {c: F.coalesce(pick(v, ignorenulls=True).over(frame), F.col(f"_in{i}")) for i, (c, v) in enumerate(values.items())}
    return joined.withColumns(filled).drop("_slice", *[f"_in{i}" for i in range(len(values))])


def running(df: DataFrame, names: list[str], value: Column, alias: str) -> DataFrame:
    """df with the running sum of value over the whole table in its order, nulls counting as 0."""
    keys = ascending(names)
    slices = _slices(df, keys).withColumn("_value", F.coalesce(value, F.lit(0)))
    sums = slices.groupBy("_slice").agg(F.sum("_value").alias("_sum"))
    before = sums.select("_slice", F.coalesce(F.sum("_sum").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum("_value").over(Window.partitionBy("_slice").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return slices.join(F.broadcast(before), "_slice").withColumn(alias, within + F.col("_before")).drop("_slice", "_value", "_before")


def exact_quantiles(df: DataFrame, value: Column, at: dict[str, float]) -> DataFrame:
    """One row with the interpolated quantiles of a numeric column, exact at any size: equal values are counted map-side, ranks come
    from running counts by range partition, and only the values at the wanted ranks are kept. Null and NaN are left out."""
    counts = df.select(value.cast("double").alias("v")).where("v is not null and not isnan(v)").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranked = running(counts, ["v"], F.col("n"), "upto")
    total = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    rows = ranked.select("v", "upto").crossJoin(F.broadcast(total))  # one row
    made = []
    for name, q in at.items():
        place = F.lit(q) * (F.col("total") - 1)
        low, high = F.min(F.when(F.col("upto") > F.floor(place), F.col("v"))), F.min(F.when(F.col("upto") > F.ceil(place), F.col("v")))
        part = F.max(place - F.floor(place))
        made.append((low + part * (high - low)).alias(name))
    return rows.agg(*made)


def ranks(df: DataFrame, key: str, alias: str, dense: bool = False) -> DataFrame:
    """df with the rank of each row's key over the whole table, null for null: running counts of the distinct keys, joined back."""
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_rank_key")).agg(F.count(F.lit(1)).alias("_rank_n"))
    step = F.lit(1).cast("long") if dense else F.col("_rank_n")
    placed = running(counts, ["_rank_key"], step, "_upto").select("_rank_key", (F.col("_upto") - (0 if dense else F.col("_rank_n") - 1)).cast("int").alias(alias))
    return spread_join(df.drop(alias) if alias in df.columns else df, placed, [(F.col(key), F.col("_rank_key"))], "left", nulls_match=False).drop("_rank_key")


#: Rows of a block in which neighbours of a row are looked up.
BLOCK_ROWS = 200_000


def in_blocks(df: DataFrame, names: list[str], made: Callable[[WindowSpec], Column], before: int, after: int, alias: str) -> DataFrame:
    """df with a window function that looks at so many rows before and after each row of the whole table.

    Rows are numbered in order and split into blocks; the rows at a block's ends stand in the neighbouring blocks as well, where they are
    only looked at. A block is larger than what a function looks at, so one neighbour on each side is enough.
    """
    size = max(BLOCK_ROWS, before, after)
    numbered = running(df, names, F.lit(1).cast("long"), "_at")
    block, place = F.floor((F.col("_at") - 1) / size), (F.col("_at") - 1) % size
    own = F.struct(block.alias("block"), F.lit(True).alias("own"))
    next_one = F.when(place >= size - before, F.struct((block + 1).alias("block"), F.lit(False).alias("own")))
    last_one = F.when(place < after, F.struct((block - 1).alias("block"), F.lit(False).alias("own")))
    spread = numbered.select("*", F.explode(F.filter(F.array(own, next_one, last_one), lambda x: x.isNotNull())).alias("_in"))
    window = Window.partitionBy("_in.block").orderBy("_at")
    return spread.withColumn(alias, made(window)).where("_in.own").drop("_in", "_at")


def group_quantiles(counts: DataFrame, group: list[str], at: dict[str, float], value: str = "v") -> DataFrame:
    """(group, quantiles): exact_quantiles of each group at once, from counts (group, value, n) with one row a group and value.

    Ranks come from running counts by range partition, so neither a task nor the driver gets all values of a group. NaN is left out;
    null is a group as well. Groups without values give no row.
    """
    keyed = counts.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.struct(*map(K.col, group)).alias("_g"), F.col(value).alias("v"), "n")
    slices = _slices(keyed, [F.col("_g").asc(), F.col("v").asc()])
    sums = slices.groupBy("_slice", "_g").agg(F.sum("n").alias("_sum"))
    in_group = Window.partitionBy("_g").orderBy("_slice")
    before = sums.select("_slice", "_g", (F.sum("_sum").over(in_group) - F.col("_sum")).alias("_before"), F.sum("_sum").over(Window.partitionBy("_g")).alias("_total"))
    within = F.sum("n").over(Window.partitionBy("_slice", "_g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = slices.withColumn("_upto", within).join(before, ["_slice", "_g"]).withColumn("_upto", F.col("_upto") + F.col("_before"))
    parts = []
    for i, q in enumerate(at.values()):
        place = F.lit(q) * (F.col("_total") - 1)
        parts += [F.min(F.when(F.col("_upto") > edge(place), F.col("v"))).alias(f"{name}{i}") for name, edge in (("low", F.floor), ("high", F.ceil))] + [F.max(place - F.floor(place)).alias(f"part{i}")]
    found = ranked.groupBy("_g").agg(*parts)
    return found.select(*[F.col("_g").getField(g).alias(g) for g in group], *[(F.col(f"low{i}") + F.col(f"part{i}") * (F.col(f"high{i}") - F.col(f"low{i}"))).alias(name) for i, name in enumerate(at)])
