"""Profile of every column by load, and the loads that depart from a column's usual state (problem 1).

Values are generalised to character-class masks: letters to a or A, digits to 9, runs collapsed in text; numbers keep their digit
count. The masks of a column that hold a share in its typical load are its dominant patterns, all others are rare-mask violations.
A load departs when its null share, its rate of violations, its distinct values, its range, or its distribution of masks and
values lies far from the median of all loads, measured by the spread of the loads themselves; medians ignore departing loads, so
a usual load after a departing one stays usual. Numbers are compared by the column's own data: exact values where a typical load
repeats few of them, otherwise bins between the quantiles of the typical load; values rare in it are the implausible ones.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millweir.session import materialize

QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]
#: The quantiles of the typical load that part a column's values into bins.
GRID = [k / 32 for k in range(1, 32)]
#: A column whose typical load has so many distinct numbers at most, each so often on average, is compared by exact values, kept apart within SPAN.
FEW_VALUES, REPEATED, SPAN = 256, 8, 4096
#: Buckets of whole texts, few so that unique values spread evenly at any size of a load, and of their endings.
TEXT_BUCKETS, ENDING_BUCKETS = 32, 256
#: A mask is dominant from this share of the typical load on.
DOMINANT_SHARE = 0.002
#: The least deviation from the column's median that may count, by metric; the last three are in units of the column's spread or ratio.
FLOORS = {"null_share": 0.04, "rare_share": 0.04, "mask_jsd": 0.02, "value_jsd": 0.03, "distinct": 0.12, "quantile": 0.25}
#: Deviations in robust standard deviations, and in standard errors of a share, from which on a load departs.
ROBUST_SDS, STANDARD_ERRORS = 8.0, 6.0


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def value_mask(col: Column, kind: T.DataType) -> Column:
    """The character-class mask of a value, null for null. Decimals count without closing noughts, whatever their magnitude."""
    text = col.cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        text = F.coalesce(F.regexp_replace(col.try_cast("decimal(38,6)").cast("string"), "0+$", ""), text)
    if not isinstance(kind, T.StringType):
        return F.translate(text, "012345678", "9" * 9)
    mask = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[\p{Ll}\p{Lo}]+", "a"), r"\p{Lu}+", "A"), r"\p{Nd}+", "9")
    # tokens that mix classes (serial numbers) and long runs of words would give a mask each
    return F.regexp_replace(F.regexp_replace(mask, r"[aA9]{4,}", "x"), r"([aAx9][^aAx9]){6,}", "+")


def value_bucket(col: Column, kind: T.DataType, bins: list[float] | None = None) -> Column:
    """A bucket of the value itself: of a whole text, or the sign and magnitude of a number with its bin.

    bins: the edges between bins; none at all ([]) for exact values, whole numbers SPAN apart or other numbers of one hash falling together
    only if their magnitudes do; None for the magnitude alone.
    """
    if isinstance(kind, T.StringType):
        return F.pmod(F.xxhash64(F.lower(col)), F.lit(TEXT_BUCKETS)).cast("long")
    if isinstance(kind, T.NumericType):
        number = col.cast("double")
        magnitude = (F.signum(number) * F.floor(F.log2(F.abs(number) + 1) * 2)).try_cast("int").cast("long")
        if bins is None:
            return magnitude
        if bins:
            part = reduce(lambda x, y: x + y, [(number >= F.lit(e)).cast("int") for e in bins])
        else:
            part = F.when(F.rint(number) == number, F.pmod(number, F.lit(float(SPAN))).try_cast("int")).otherwise(F.pmod(F.xxhash64(number), F.lit(SPAN)).cast("int"))
        return magnitude * (2 * SPAN) + part
    return F.lit(None).cast("long")


def ending_bucket(col: Column, kind: T.DataType) -> Column:
    """Of texts whose last part (a domain, a unit, a form of company) repeats more than the whole: a bucket of it; null for other types."""
    if not isinstance(kind, T.StringType):
        return F.lit(None).cast("long")
    return F.pmod(F.xxhash64(F.lower(F.regexp_extract(col, r"([^\s@,;/]*)\s*$", 1))), F.lit(ENDING_BUCKETS)).cast("long")


def _columns(df: DataFrame, load: str, columns: list[str] | None) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name != load and (columns is None or f.name in columns) and isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.BinaryType)]


def column_metrics(df: DataFrame, load: str, columns: list[str] | None = None, points: list[float] = QUANTILES) -> DataFrame:
    """A row for each column and load: rows, nulls, distinct values, least and greatest value, quantiles of numbers (at points).

    One scan and one aggregation whatever the number of columns, and for the exact distinct values a scan of each column alone, whose
    (load, value) pairs are combined before the shuffle; rows without a load are a load of their own (null).
    """
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for i, f in enumerate(_columns(df, load, columns)):
        c = _quoted(f.name)
        numeric = isinstance(f.dataType, T.NumericType)
        aggs += [F.count(c).alias(f"c{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
        if numeric:
            aggs.append(F.percentile_approx(c.cast("double"), points, 2000).alias(f"q{i}"))
        quantiles = F.col(f"q{i}") if numeric else F.lit(None).cast("array<double>")
        rows.append(F.struct(F.lit(f.name).alias("col_name"), (F.col("n") - F.col(f"c{i}")).alias("n_null"), F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"), quantiles.alias("quantiles")))
    wide = df.groupBy(_quoted(load).cast("int").alias("load_id")).agg(*aggs)
    if not rows:
        return wide.select("load_id", F.col("n").alias("n_rows"), *[F.lit(None).cast(t).alias(c) for c, t in (("col_name", "string"), ("n_null", "long"), ("min_value", "string"), ("max_value", "string"), ("quantiles", "array<double>"), ("n_distinct", "long"))]).limit(0)
    known = wide.select("load_id", F.col("n").alias("n_rows"), F.inline(F.array(*rows)))
    at = _quoted(load).cast("int")
    different = reduce(DataFrame.unionAll, [df.groupBy(at.alias("load_id")).agg(F.count_distinct(_quoted(f.name)).alias("n_distinct")).select("load_id", F.lit(f.name).alias("col_name"), "n_distinct") for f in _columns(df, load, columns)])
    different = F.broadcast(different.withColumnRenamed("load_id", "_load").withColumnRenamed("col_name", "_col"))  # a row a column and load
    return known.join(different, F.col("load_id").eqNullSafe(F.col("_load")) & (F.col("col_name") == F.col("_col")), "left").drop("_load", "_col")


def typical_bins(metrics: DataFrame) -> dict[str, list[float]]:
    """The bins of each column of numbers, for value_bucket; metrics have the quantiles QUANTILES + GRID. The driver gets len(GRID) numbers a column."""
    filled = metrics.where(F.col("quantiles").isNotNull())
    sizes = filled.groupBy("col_name").agg(F.median("n_distinct").alias("distinct"), F.median(F.col("n_rows") - F.col("n_null")).alias("n"))
    few = F.col("distinct") <= F.least(F.lit(FEW_VALUES), F.col("n") / REPEATED)
    edges = filled.select("col_name", F.posexplode(F.slice("quantiles", len(QUANTILES) + 1, len(GRID))).alias("at", "edge")).where(~F.isnan("edge")).groupBy("col_name", "at").agg(F.median("edge").alias("edge"))
    edges = edges.groupBy("col_name").agg(F.array_sort(F.collect_set("edge")).alias("edges"))
    return {r.col_name: [] if r.few else r.edges for r in sizes.join(edges, "col_name").select("col_name", few.alias("few"), "edges").collect()}


def mask_histogram(df: DataFrame, load: str, columns: list[str] | None = None, bins: dict[str, list[float]] | None = None) -> DataFrame:
    """(col_name, load_id, kind, item, n): how often each mask and each bucket of values occurs, combined before the shuffle."""
    parts = []
    for f in _columns(df, load, columns):
        c, kind = _quoted(f.name), f.dataType
        items = {"mask": value_mask(c, kind), "value": value_bucket(c, kind, (bins or {}).get(f.name)).cast("string"), "ending": ending_bucket(c, kind).cast("string")}
        parts += [F.struct(F.lit(f.name).alias("col_name"), F.lit(what).alias("kind"), item.alias("item")) for what, item in items.items() if what == "mask" or isinstance(kind, (T.StringType, T.NumericType)) and (what == "value" or isinstance(kind, T.StringType))]
    at = _quoted(load).cast("int").alias("load_id")
    if not parts:
        return df.select(at, *[F.lit(None).cast("string").alias(c) for c in ("col_name", "kind", "item")], F.lit(0).cast("long").alias("n")).limit(0)
    return df.select(at, F.inline(F.array(*parts))).where(F.col("item").isNotNull()).groupBy("load_id", "col_name", "kind", "item").agg(F.count(F.lit(1)).alias("n"))


def typical_items(hist: DataFrame) -> DataFrame:
    """hist with each item's share in its load and in the column's typical load (the median over loads, absent ones as 0)."""
    totals = hist.groupBy("load_id", "col_name", "kind").agg(F.sum("n").alias("total"))
    loads = totals.groupBy("col_name", "kind").agg(F.count(F.lit(1)).alias("loads"))
    shares = hist.join(totals, ["load_id", "col_name", "kind"]).withColumn("share", F.col("n") / F.col("total"))
    of_item = shares.groupBy("col_name", "kind", "item").agg(F.collect_list("share").alias("seen")).join(F.broadcast(loads), ["col_name", "kind"])
    padded = F.array_sort(F.concat("seen", F.array_repeat(F.lit(0.0), (F.col("loads") - F.size("seen")).cast("int"))))
    middle = lambda at: F.element_at(F.col("padded"), at.cast("int"))
    medians = of_item.withColumn("padded", padded).select("col_name", "kind", "item", ((middle(F.floor((F.col("loads") + 1) / 2)) + middle(F.floor(F.col("loads") / 2) + 1)) / 2).alias("typical"))
    return shares.join(medians, ["col_name", "kind", "item"])


def divergences(items: DataFrame) -> DataFrame:
    """Per column and load: the Jensen-Shannon divergence of masks and of values from the typical load, and the rates of rare masks and rare values.

    Items absent from a load need no rows: each adds half its typical share, so together half of what the present ones leave.
    """
    weight = items.select("col_name", "kind", "item", "typical").distinct().groupBy("col_name", "kind").agg(F.sum("typical").alias("weight"))
    p, q = F.col("share"), F.when(F.col("weight") > 0, F.col("typical") / F.col("weight")).otherwise(F.lit(0.0))
    mean = (p + F.col("q")) / 2
    term = p * F.log2(p / mean) + F.when(F.col("q") > 0, F.col("q") * F.log2(F.col("q") / mean)).otherwise(0.0)
    rows = items.join(F.broadcast(weight), ["col_name", "kind"]).withColumn("q", q)
    per = rows.groupBy("col_name", "load_id", "kind").agg(
        ((F.sum(term) + F.greatest(F.lit(0.0), 1 - F.sum("q"))) / 2).alias("jsd"),
        F.sum(F.when(F.col("typical") < DOMINANT_SHARE, p).otherwise(0.0)).alias("rare_share"),
    )
    one = lambda kind, what: F.max(F.when(F.col("kind") == kind, F.col(what)))
    return per.groupBy("col_name", "load_id").agg(one("mask", "jsd").alias("mask_jsd"), F.greatest(one("value", "jsd"), one("ending", "jsd")).alias("value_jsd"), one("mask", "rare_share").alias("rare_share"), one("value", "rare_share").alias("rare_values"))


_SCORED = "col_name string, load_id int, n_rows long, null_share double, n_distinct long, min_value string, max_value string, quantiles array<double>, rare_share double, mask_jsd double, value_jsd double, departs boolean, reasons array<string>"


def _far(x, floor, noise):  # noqa: ANN001, ANN202 - numpy arrays; numpy and pandas are loaded in the workers only
    import numpy as np

    middle = np.nanmedian(x)
    spread = 1.4826 * np.nanmedian(np.abs(x - middle))
    with np.errstate(invalid="ignore"):
        return np.abs(x - middle) > np.maximum(np.maximum(floor, ROBUST_SDS * spread), noise)


def score_loads(table):  # noqa: ANN001, ANN201 - an Arrow table to an Arrow table
    """One column's loads, each with the metrics in which it departs. Its size is the number of loads."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    rows = table.to_pandas()
    rows = rows.sort_values("load_id", na_position="first").reset_index(drop=True)
    n = rows["n_rows"].to_numpy(float)
    filled = np.maximum(n - rows["n_null"].to_numpy(float), 0)
    reasons: list[list[str]] = [[] for _ in rows.index]

    def note(name: str, flags) -> None:  # noqa: ANN001
        for i in np.flatnonzero(flags):
            if name not in reasons[i]:
                reasons[i].append(name)

    share_noise = lambda s, m: STANDARD_ERRORS * np.sqrt(np.maximum(np.nanmedian(s) * (1 - np.nanmedian(s)), 1e-4) / np.maximum(m, 1))
    nulls = np.where(n > 0, 1 - filled / np.maximum(n, 1), np.nan)
    rare = rows["rare_share"].fillna(0).to_numpy(float)
    note("null_share", _far(nulls, FLOORS["null_share"], share_noise(nulls, n)))
    enough = filled >= 10  # a load with a handful of values has no distribution
    blank = lambda x: np.where(enough, x, np.nan)
    if enough.any():
        note("rare_share", _far(blank(rare), FLOORS["rare_share"], share_noise(rare, filled)))
        for what in ("mask_jsd", "value_jsd"):
            x = blank(rows[what].to_numpy(float))
            if not np.isnan(x).all():
                note(what, (x > np.nanmedian(x)) & _far(x, FLOORS[what], 4 / np.maximum(filled, 1) ** 0.75))
        ratio = blank(rows["n_distinct"].to_numpy(float) / np.maximum(filled, 1))
        # a larger load repeats more of a fixed domain: compare the distinct values of a domain and of a key alike, in logs
        distinct = blank(np.log(np.maximum(rows["n_distinct"].to_numpy(float), 1)))
        logs, counts = np.log(np.maximum(ratio, 1e-9)), distinct
        noise = STANDARD_ERRORS / np.sqrt(np.maximum(rows["n_distinct"].to_numpy(float), 1))
        note("distinct", _far(logs, FLOORS["distinct"], noise) & _far(counts, FLOORS["distinct"], noise) & ((logs < np.nanmedian(logs)) == (counts < np.nanmedian(counts))))
        quantiles = [q if q is not None and len(q) == len(QUANTILES) else [math.nan] * len(QUANTILES) for q in rows["quantiles"]]
        q = np.where(enough[:, None], np.array(quantiles, float), np.nan)
        if not np.isnan(q).all():
            odd = rows["rare_values"].fillna(0).to_numpy(float)
            note("rare_values", _far(blank(odd), FLOORS["rare_share"], share_noise(odd, filled)))
            typical = np.nanmedian(q, axis=0)
            inner, outer = max(typical[3] - typical[1], 1e-9), max(typical[4] - typical[0], 1e-9)
            for k, unit in enumerate((outer, inner, inner, inner, outer)):
                note("range", _far(q[:, k], FLOORS["quantile"] * unit, 4 * unit / np.sqrt(np.maximum(filled, 1))))
    made = pd.DataFrame({"col_name": rows["col_name"], "load_id": rows["load_id"], "n_rows": rows["n_rows"], "null_share": nulls, "n_distinct": rows["n_distinct"], "min_value": rows["min_value"], "max_value": rows["max_value"], "quantiles": rows["quantiles"], "rare_share": rare, "mask_jsd": rows["mask_jsd"], "value_jsd": rows["value_jsd"], "departs": [bool(r) for r in reasons], "reasons": reasons})
    kinds = {"load_id": pa.int32(), "n_rows": pa.int64(), "n_distinct": pa.int64(), "min_value": pa.string(), "max_value": pa.string(), "col_name": pa.string(), "departs": pa.bool_(), "reasons": pa.list_(pa.string()), "quantiles": pa.list_(pa.float64())}
    return pa.Table.from_pandas(made, pa.schema([(c, kinds.get(c, pa.float64())) for c in made.columns]), preserve_index=False)


def profile_loads(df: DataFrame, load: str, columns: list[str] | None = None) -> DataFrame:
    """Every column by load, with what departs.

    Nulls count in null_share only; empty and blank texts are values with a mask of their own. A column that is null throughout a load
    has no masks there (rare_share 0, divergences null). A load with fewer than ten values is judged by its null share alone.
    columns: None for all; nested and binary columns are left out. An empty table gives no rows.
    """
    fine = materialize(column_metrics(df, load, columns, QUANTILES + GRID), "metrics")
    bins = typical_bins(fine)
    metrics = fine.withColumn("quantiles", F.slice("quantiles", 1, len(QUANTILES)))
    # the histogram is small and read several times: written once, it keeps the plans small
    parts = divergences(materialize(typical_items(materialize(mask_histogram(df, load, columns, bins), "masks")), "items"))
    both = metrics.join(parts, (metrics.col_name == parts.col_name) & metrics.load_id.eqNullSafe(parts.load_id), "left").drop(parts.col_name).drop(parts.load_id)
    return both.groupBy("col_name").applyInArrow(score_loads, _SCORED)


def mask_violations(df: DataFrame, load: str, columns: list[str] | None = None) -> DataFrame:
    """The rare masks of each column by load, with their number and share of the load."""
    items = typical_items(materialize(mask_histogram(df, load, columns), "masks"))
    return items.where((F.col("kind") == "mask") & (F.col("typical") < DOMINANT_SHARE)).select("col_name", "load_id", F.col("item").alias("mask"), "n", "share", "typical")
