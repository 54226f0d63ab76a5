"""Steps that change, join, group or order rows, and the shape of tables."""

from __future__ import annotations

import difflib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millweir.functions import kernels as K
from millweir.functions.conditions import StepError, combine, need
from millweir.operators.graph import components
from millweir.operators.ordering import ascending, carry, exact_quantiles, group_quantiles, in_blocks, order_names, rank_key, ranks, running
from millweir.operators.registry import ROW_ID, Context, step
from millweir.operators.scalar import cast, is_text, out, snake
from millweir.session import materialize
from millweir.skew import spread_join


def number(df: DataFrame, name: str) -> Column:
    return K.as_number(need(df, name), df.schema[name].dataType)


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """df with the columns of an aggregate that has exactly one row."""
    return df.crossJoin(F.broadcast(one_row))


def most_frequent(df: DataFrame, groups: list[str], value: Column, alias: str) -> DataFrame:
    """The most frequent value of each group, the least one of those as frequent. Counts are combined map-side."""
    counts = df.select(*map(K.col, groups), value.alias("_v")).where("_v is not null").groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*groups).agg(F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias(alias))


# ---- cleaning by frequency
@step("standardize_values", "clean", "column*:column mapping:mapping case:most_common|title|upper|lower=most_common")
def standardize_values(df, p, ctx):
    name = p["column"]
    plain = K.strip(K.col(name))
    common = F.regexp_replace(F.lower(plain), r"(?U)[^\w]", "")
    counts = df.select(common.alias("_key"), plain.alias("_v")).where("_v is not null").groupBy("_key", "_v").agg(F.count(F.lit(1)).alias("_n"))
    canonical = counts.groupBy("_key").agg(F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias("_canonical"))
    table = {str(k).strip().lower(): str(v) for k, v in (p.get("mapping") or {}).items()}
    chosen = F.coalesce(K.lookup(F.lower(plain), table), F.col("_canonical"))
    styled = {"most_common": lambda c: c, "title": K.title, "upper": F.upper, "lower": F.lower}[p["case"]](chosen)
    joined = spread_join(df.withColumn("_key", common), canonical.withColumnRenamed("_key", "_key2"), [(F.col("_key"), F.col("_key2"))], nulls_match=False)
    return joined.withColumn(name, F.when(K.col(name).isNotNull(), styled)).select(df.columns)


# ---- missing values
@step("flag_missing", "missing", "columns*:columns", stream=True)
def flag_missing(df, p, ctx):
    return df.withColumns({f"{c}_is_missing": K.blank(K.col(c)) for c in p["columns"]})


@step("drop_missing", "missing", "columns*:columns how:any|all=any", flags="DR", stream=True)
def drop_missing(df, p, ctx):
    blanks = [K.blank(K.col(c)) for c in p["columns"]]
    return df.where(~(K.any_of(blanks) if p["how"] == "any" else K.all_of(blanks)))


def filled(df: DataFrame, name: str, value: Column) -> Column:
    kind = df.schema[name].dataType
    c = K.col(name)
    new = value if isinstance(kind, T.StringType) else value.try_cast(kind.simpleString())
    return F.when(K.blank(c) if isinstance(kind, T.StringType) else c.isNull(), new.cast(kind)).otherwise(c)


@step("fill_constant", "missing", "columns*:columns value*:text=Unknown", stream=True)
def fill_constant(df, p, ctx):
    return df.withColumns({c: filled(df, c, F.lit(str(p["value"]))) for c in p["columns"]})


@step("fill_zero", "missing", "columns*:columns", stream=True)
def fill_zero(df, p, ctx):
    return df.withColumns({c: filled(df, c, F.lit("0")) for c in p["columns"]})


def _fill_from(df: DataFrame, columns: list[str], aggregate) -> DataFrame:  # noqa: ANN001
    """Blanks filled with a statistic of the column, all in one aggregate of one row."""
    one = df.agg(*[F.round(aggregate(number(df, c)), 2).alias(f"_fill{i}") for i, c in enumerate(columns)])
    wide = beside(df, one)
    return wide.withColumns({c: filled(df, c, K.text(F.col(f"_fill{i}")) if is_text(df, c) else F.col(f"_fill{i}")) for i, c in enumerate(columns)}).select(df.columns)


@step("fill_mean", "missing", "columns*:columns")
def fill_mean(df, p, ctx):
    return _fill_from(df, p["columns"], F.avg)


@step("fill_median", "missing", "columns*:columns")
def fill_median(df, p, ctx):
    for c in p["columns"]:
        wide = beside(df, exact_quantiles(df, number(df, c), {"_fill": 0.5}))
        value = F.round("_fill", 2)
        df = wide.withColumn(c, filled(df, c, K.text(value) if is_text(df, c) else value)).select(df.columns)
    return df


@step("fill_mode", "missing", "columns*:columns")
def fill_mode(df, p, ctx):
    for c in p["columns"]:
        shown = F.when(~K.blank(K.col(c)), K.col(c))
        df = beside(df, most_frequent(df, [], shown, "_mode")).withColumn(c, F.coalesce(shown, F.col("_mode"))).drop("_mode")
    return df


def _along(df: DataFrame, p: dict, ctx: Context, forward: bool) -> DataFrame:
    names = order_names(df, ctx, p.get("order_by"))
    return carry(df, names, {c: F.when(~K.blank(K.col(c)), K.col(c)) for c in p["columns"]}, forward)


@step("forward_fill", "missing", "columns*:columns order_by:column")
def forward_fill(df, p, ctx):
    return _along(df, p, ctx, True)


@step("backward_fill", "missing", "columns*:columns order_by:column")
def backward_fill(df, p, ctx):
    return _along(df, p, ctx, False)


@step("smart_impute", "missing", "column*:column group_by:columns value_kind:text")
def smart_impute(df, p, ctx):
    """Median (numbers) or most frequent value (text) of the group, else of the table. value_kind: number or text; looked up if not given."""
    name, groups = p["column"], p.get("group_by") or []
    numeric = isinstance(df.schema[name].dataType, T.NumericType)
    if not numeric:
        kind = p.get("value_kind")
        if kind is None:
            seen = df.agg(F.avg(K.numeric(K.col(name)).isNotNull().cast("double")).alias("share"), F.avg(F.when(~K.blank(K.col(name)), K.numeric(K.col(name)).isNotNull().cast("double"))).alias("filled")).first()
            kind = "number" if (seen.filled or 0) > 0.9 else "text"
        numeric = kind == "number"
    if numeric:
        v = number(df, name)
        by_group = df.groupBy(*groups).agg(F.median(v).alias("_group")) if groups else None
        one = exact_quantiles(df, v, {"_all": 0.5})
        full = F.round(F.coalesce(v, *([F.col("_group")] if groups else []), F.col("_all")), 2)
        value = K.text(full) if is_text(df, name) else full
    else:
        shown = F.when(~K.blank(K.col(name)), K.col(name))
        by_group = most_frequent(df, groups, shown, "_group") if groups else None
        one = most_frequent(df, [], shown, "_all")
        value = F.coalesce(shown, *([F.col("_group")] if groups else []), F.col("_all"))
    wide = null_safe_join(df, by_group, groups) if groups else df
    return beside(wide, one).withColumn(name, value).select(df.columns)


def null_safe_join(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys of which nulls match; other's keys are dropped. One key, null as well, may hold a large share of df."""
    right = other.select(*[K.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[K.col(c) for c in other.columns if c not in keys])
    return spread_join(df, right, [(K.col(k), F.col(f"_k{i}")) for i, k in enumerate(keys)], how).drop(*[f"_k{i}" for i in range(len(keys))])


# ---- duplicates
def _keys(df: DataFrame, names: list[str] | None) -> list[str]:
    return list(names or [c for c in df.columns if c != ROW_ID])


@step("flag_duplicates", "duplicates", "columns:columns output:text=is_duplicate")
def flag_duplicates(df, p, ctx):
    """Counts are combined map-side and joined back, so a key with many rows fills no single window."""
    keys = _keys(df, p.get("columns"))
    several = df.groupBy(*map(K.col, keys)).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return null_safe_join(df, several, keys).withColumn(p["output"], F.col("_n").isNotNull()).drop("_n")


@step("remove_duplicates", "duplicates", "columns:columns keep:first|last|latest|highest_quality=first order_by:column", flags="DR")
def remove_duplicates(df, p, ctx):
    """One row a key, chosen by an aggregate (combined map-side): the first or last in row order, the latest, or the fullest one."""
    keys = _keys(df, p.get("columns"))
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    names = order_names(df, ctx) if p["keep"] in ("first", "last") or ROW_ID in df.columns or ctx.order else df.columns
    place = rank_key(names)
    row = F.struct(*[K.col(c) for c in others])
    if p["keep"] == "last":
        best = F.max_by(row, place)
    elif p["keep"] == "latest":
        if not p.get("order_by"):
            raise StepError("keeping the latest record needs a date column")
        d = K.as_date(need(df, p["order_by"]), df.schema[p["order_by"]].dataType)
        best = F.min_by(row, F.struct(d.isNull(), -F.unix_date(d), place))
    elif p["keep"] == "highest_quality":
        full = reduce(lambda a, b: a + b, [(~K.blank(K.col(c))).cast("int") for c in df.columns if c != ROW_ID])
        best = F.min_by(row, F.struct(-full, place))
    else:
        best = F.min_by(row, place)
    return df.groupBy(*map(K.col, keys)).agg(best.alias("_row")).select(*[K.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])


def _pieces(text: Column, threshold: float) -> Column:
    """Pieces of a text of which two similar texts share one, whatever their lengths.

    A ratio of 2 M / (n + m) of at least t leaves at most k = (1 - t) (n + m) letters of both unmatched. Of as many pieces of the shorter
    text and one more, one is untouched. It stands in the longer one, moved by what is unmatched before it: of the k letters the longer
    text has (k + n - m) / 2 at most and the shorter one (k - n + m) / 2. Texts stand under the pieces of each length that a partner may have.
    """
    n = F.length(text)
    least = F.greatest(F.lit(0), F.ceil(n * threshold / (2 - threshold) - 1e-9)).cast("int")

    def of_length(m: Column) -> Column:
        # m: the shorter length of a pair, of which this text is the longer one, or both are as long
        parts = F.floor((1 - threshold) * (m + F.floor(m * (2 - threshold) / threshold + 1e-9)) + 1e-9).cast("int") + 1
        k, longer = F.floor((1 - threshold) * (m + n) + 1e-9).cast("int"), n - m
        shifts = F.sequence(-F.floor((k - longer) / 2).cast("int"), F.floor((k + longer) / 2).cast("int"))

        def piece(i: Column) -> Column:
            start, end = F.floor(m * i / parts).cast("int"), F.floor(m * (i + 1) / parts).cast("int")
            at = F.filter(F.transform(shifts, lambda d: start + d), lambda x: (x >= 0) & (x <= n - (end - start)))
            return F.transform(at, lambda x: F.xxhash64(m, i, F.substring(text, x + 1, end - start)))

        return F.when(k >= longer, F.flatten(F.transform(F.sequence(F.lit(0), parts - 1), piece))).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.least(least, n), n), of_length)))


def _ratios(threshold: float):  # noqa: ANN202
    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            kept, matcher, last = [], difflib.SequenceMatcher(None, "", "", autojunk=False), None
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if b != last:
                    matcher.set_seq2(b)
                    last = b
                matcher.set_seq1(a)
                if matcher.real_quick_ratio() >= threshold and matcher.quick_ratio() >= threshold and matcher.ratio() >= threshold:
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    return run


@step("fuzzy_duplicates", "duplicates", "columns*:columns threshold:number=90 action:flag|remove=flag", flags="R")
def fuzzy_duplicates(df, p, ctx):
    """Rows whose folded, sorted words are alike, with the same first two letters; what is like a like text is in one group.

    Only distinct texts are compared, and of those only texts that share a piece which likeness can't do without, so no link is lost
    and no task holds a block. A group's head is its first text in row order.
    """
    names, threshold = order_names(df, ctx), min(1.0, max(0.01, float(p["threshold"]) / 100))
    rows = df.withColumn("_text", K.name_key(F.concat_ws(" ", *[K.text(K.col(c)) for c in p["columns"]])))
    spelt = rows.groupBy("_text").agg(F.min(rank_key(names)).alias("_order"), F.count(F.lit(1)).alias("_n"))
    block = F.left("_text", F.lit(2))
    parts = materialize(spelt.select("_text", F.length("_text").alias("_length"), F.explode(_pieces(F.col("_text"), threshold)).alias("_piece"), block.alias("_block")), "pieces")
    a, b = parts.select("_block", "_piece", F.col("_text").alias("a"), F.col("_length").alias("n")), parts.select("_block", "_piece", F.col("_text").alias("b"), F.col("_length").alias("m"))
    met = a.join(b, ["_block", "_piece"]).where((F.col("a") < F.col("b")) & (2 * F.least("n", "m") >= threshold * (F.col("n") + F.col("m")))).select("a", "b").distinct()
    links = met.mapInArrow(_ratios(threshold), "a string, b string")
    comps = components(links).toDF("_text", "_comp")
    placed = spelt.join(comps, "_text", "left").withColumn("_comp", F.coalesce("_comp", "_text"))
    heads = placed.groupBy("_comp").agg(F.min_by("_text", "_order").alias("_head"), F.sum("_n").alias("_size"))
    of_text = placed.select(F.col("_text").alias("_text2"), "_comp").join(heads, "_comp").drop("_comp")
    full = spread_join(rows, of_text, [(F.col("_text"), F.col("_text2"))], "inner")
    if p["action"] == "flag":
        group = F.concat(F.left(F.col("_head"), F.lit(2)), F.lit("-"), F.left(F.sha2("_head", 256), F.lit(12)))
        return full.withColumn("similar_group", group).withColumn("has_similar", F.col("_size") > 1).select(*df.columns, "similar_group", "has_similar")
    row = F.struct(*map(K.col, df.columns))
    return full.groupBy("_head").agg(F.min_by(row, rank_key(names)).alias("_row")).select("_row.*")


@step("survivorship", "duplicates", "columns*:columns rules:survivorship order_by:column", flags="DR")
def survivorship(df, p, ctx):
    """One golden row a key; each other column by its rule. Blanks are nulls; recent rows come first when a date column is named."""
    keys = p["columns"]
    rules = p.get("rules") or {}
    if isinstance(rules, list):
        rules = {r["column"]: r["rule"] for r in rules}
    place = rank_key(order_names(df, ctx))
    if p.get("order_by"):
        d = K.as_date(need(df, p["order_by"]), df.schema[p["order_by"]].dataType)
        place = F.struct(d.isNull(), -F.unix_date(d), place)
    aggs = []
    modes = [c for c in df.columns if rules.get(c) == "most_common" and c not in keys]
    for c in df.columns:
        if c in keys or c in modes:
            continue
        v = F.when(~K.blank(K.col(c)), K.col(c))
        there = lambda key, v=v: F.when(v.isNotNull(), key)
        rule = rules.get(c, "first_non_null")
        if rule in ("max", "min"):
            agg = F.max(v) if rule == "max" else F.min(v)
        elif rule == "longest":
            agg = F.min_by(v, there(F.struct(-F.length(K.text(v)), place)))
        else:
            agg = F.min_by(v, there(place))
        aggs.append(agg.alias(c))
    golden = df.groupBy(*map(K.col, keys)).agg(*aggs) if aggs else df.select(*map(K.col, keys)).distinct()
    for c in modes:
        golden = null_safe_join(golden, most_frequent(df, keys, F.when(~K.blank(K.col(c)), K.col(c)), c), keys)
    return golden.select(df.columns)


# ---- filter, sort, limit
@step("filter_rows", "filter", "conditions*:conditions logic:and|or=and mode:keep|remove=keep", flags="DR", stream=True)
def filter_rows(df, p, ctx):
    chosen = combine(df, p["conditions"], p["logic"])
    return df.where(chosen if p["mode"] == "keep" else ~chosen)


def sort_key(df: DataFrame, name: str, kind: str | None) -> Column:
    """Text sorts as numbers if that is what it holds: by a hint, or by one small aggregate."""
    if not is_text(df, name):
        return need(df, name)
    if kind is None:
        share = df.agg(F.avg(F.when(~K.blank(K.col(name)), K.numeric(K.col(name)).isNotNull().cast("double"))).alias("s")).first().s
        kind = "number" if (share or 0) > 0.9 else "text"
    return K.numeric(K.col(name)) if kind == "number" else K.date(K.col(name)) if kind == "date" else K.col(name)


@step("sort_rows", "filter", "keys*:sort_keys", flags="R")
def sort_rows(df, p, ctx):
    keys = [k if isinstance(k, dict) else {"column": k} for k in p["keys"]]
    made = [(sort_key(df, k["column"], k.get("value_kind")), k.get("desc") or k.get("direction") == "desc") for k in keys]
    return df.orderBy(*[c.desc_nulls_last() if d else c.asc_nulls_last() for c, d in made])


@step("limit_rows", "filter", "n*:number=100", flags="DR")
def limit_rows(df, p, ctx):
    """The first n rows: of a sorted table, else by row order where there is one."""
    sorted_already = "Sort" in df._jdf.queryExecution().analyzed().nodeName()
    names = [ROW_ID] if ROW_ID in df.columns else [c for c in ctx.order if c in df.columns]
    return (df if sorted_already or not names else df.orderBy(*ascending(names))).limit(int(p["n"]))


# ---- joins and sets
HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


@step("join", "join", "right_dataset*:dataset left_on:columns right_on:columns_right how:inner|left|right|full|cross|semi|anti=left columns:columns_right", flags="RM")
def join(df, p, ctx):
    """Equi-join on keys compared as stripped text; nulls never match. The other side comes after its own steps."""
    left = df
    right = ctx.other(p["right_dataset"]).drop(ROW_ID)
    left_on, right_on = p.get("left_on") or [], p.get("right_on") or []
    left_on, right_on = ([x] if isinstance(x, str) else x for x in (left_on, right_on))
    if p["how"] == "cross":
        left_on = right_on = []
    elif not left_on or len(left_on) != len(right_on):
        raise StepError("a join needs as many columns on its right as on its left")
    for c in right_on:
        need(right, c)
    if p.get("columns"):
        right = right.select(*[c for c in right.columns if c in p["columns"] or c in right_on])
    renamed = right.select(*[K.col(c).alias(f"_r{i}") for i, c in enumerate(right.columns)])
    at = {c: f"_r{i}" for i, c in enumerate(right.columns)}
    if p["how"] == "cross":
        joined = left.crossJoin(renamed)
    else:
        on = [(K.strip(need(left, a)), K.strip(F.col(at[b]))) for a, b in zip(left_on, right_on, strict=True)]
        if p["how"] in ("right", "full"):
            joined = left.join(renamed, K.all_of([a == b for a, b in on]), HOW[p["how"]])
        else:
            joined = spread_join(left, renamed, on, HOW[p["how"]], nulls_match=False)
    if p["how"] in ("semi", "anti"):
        return joined
    keep_keys = p["how"] in ("right", "full")
    of_key = dict(zip(left_on, right_on, strict=True))
    own = [F.coalesce(K.text(K.col(c)), K.text(F.col(at[of_key[c]]))).alias(c) if keep_keys and c in of_key else K.col(c) for c in left.columns]
    others = [F.col(at[c]).alias(f"{c}_right" if c in left.columns else c) for c in right.columns if c not in right_on or (p.get("columns") and c in p["columns"] and c not in left_on)]
    return joined.select(*own, *others)


def _lookup(df: DataFrame, p: dict, ctx: Context, make_key, suffix: str, how: str = "left", columns: list[str] | None = None, flag: str | None = None) -> DataFrame:  # noqa: ANN001
    right = ctx.other(p["right_dataset"])
    key = need(right, p["right_on"])
    names = [c for c in right.columns if c != ROW_ID and c != p["right_on"] and (not columns or c in columns)]
    # one row a key: the first in row order, else the least
    order = [ROW_ID] if ROW_ID in right.columns else [c for c in ctx.order if c in right.columns] or right.columns
    first = right.withColumn("_key2", make_key(key)).where("_key2 is not null").groupBy("_key2").agg(F.min_by(F.struct(F.lit(True).alias("_there"), *map(K.col, names)), rank_key(order)).alias("_row"))
    joined = spread_join(df.withColumn("_key", make_key(need(df, p.get("left_on") or p.get("column")))), first, [(F.col("_key"), F.col("_key2"))], how, nulls_match=False)
    added = [F.col("_row").getField(c).alias(f"{c}{suffix}" if c in df.columns else c) for c in names]
    flags = [F.col("_row").isNotNull().alias(flag)] if flag else []
    return joined.select(*map(K.col, df.columns), *added, *flags)


@step("lookup", "join", "right_dataset*:dataset left_on*:column right_on*:text columns*:columns_right", flags="M")
def lookup(df, p, ctx):
    return _lookup(df, p, ctx, K.key, "_lookup", columns=p["columns"])


@step("fuzzy_join", "join", "right_dataset*:dataset left_on*:column right_on*:text how:left|inner=left", flags="RM")
def fuzzy_join(df, p, ctx):
    return _lookup(df, p, ctx, K.name_key, "_right", p["how"])


@step("reference_lookup", "enrich", "column*:column right_dataset*:dataset right_on*:text columns:columns_right flag:boolean=True", flags="M")
def reference_lookup(df, p, ctx):
    if not p.get("columns"):
        p = p | {"columns": ["\0"]}
    return _lookup(df, p, ctx, K.key, "_lookup", columns=p["columns"], flag=f"{p['column']}_in_reference" if p["flag"] else None)


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]
    ranks = [next((i for i, t in enumerate(order) if isinstance(x, t)), None) for x in (a, b)]
    if None not in ranks:
        return (a, b)[ranks[1] > ranks[0]] if {*map(type, (a, b))} != {T.LongType, T.FloatType} else T.DoubleType()
    if {type(a), type(b)} <= {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    if isinstance(a, T.DecimalType) and isinstance(b, T.NumericType) or isinstance(b, T.DecimalType) and isinstance(a, T.NumericType):
        return T.DoubleType()
    return T.StringType()


def stack(frames: list[DataFrame]) -> DataFrame:
    """All rows by column name; missing columns are null, and a column has the widest of its types."""
    frames = [f.drop(ROW_ID) for f in frames]
    kinds: dict[str, T.DataType] = {}
    for f in frames:
        for x in f.schema.fields:
            kinds[x.name] = _wider(kinds[x.name], x.dataType) if x.name in kinds else x.dataType
    wide = [f.select(*[K.col(n).cast(t).alias(n) if n in f.columns else F.lit(None).cast(t).alias(n) for n, t in kinds.items()]) for f in frames]
    return reduce(lambda a, b: a.unionAll(b), wide)


@step("union", "join", "datasets*:datasets", flags="RM")
def union(df, p, ctx):
    return stack([df, *map(ctx.other, p["datasets"])]).distinct()


@step("union_all", "join", "datasets*:datasets", flags="RM")
def union_all(df, p, ctx):
    return stack([df, *map(ctx.other, p["datasets"])])


# ---- aggregates and windows
def aggregate_of(df: DataFrame, spec: dict, ctx: Context) -> Column:
    name, fn = spec.get("column"), spec.get("fn", "count")
    alias = spec.get("alias") or (f"{fn}_{name}" if name else fn)
    if fn == "count":
        return F.count(need(df, name) if name else F.lit(1)).alias(alias)
    c = need(df, name)
    if fn == "count_distinct":  # null counts as a value
        return (F.countDistinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))).cast("long").alias(alias)
    if fn in ("first", "last"):
        return (F.min_by if fn == "first" else F.max_by)(c, rank_key(order_names(df, ctx))).alias(alias)
    v = c if fn in ("min", "max") and isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else number(df, name) if is_text(df, name) else c
    simple = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}
    if fn in simple:
        return simple[fn](v).alias(alias)
    raise StepError(f"there is no calculation {fn!r}")


def _quantile(fn: str) -> float | None:
    """Which quantile a calculation is: median or p followed by per cent."""
    return 0.5 if fn == "median" else int(fn[1:]) / 100 if fn[:1] == "p" and fn[1:].isdigit() else None


@step("aggregate", "aggregate", "group_by:columns aggregations*:aggregations", flags="R")
def aggregate(df, p, ctx):
    """Medians and percentiles come from ranks over counts of (group, value), so no task keeps a group's values; NaN has no rank."""
    groups, specs = p.get("group_by") or [], p["aggregations"]
    names = [a.get("alias") or (f"{a.get('fn', 'count')}_{a['column']}" if a.get("column") else a.get("fn", "count")) for a in specs]
    ranked: dict[str, dict[str, float]] = {}
    for a, name in zip(specs, names, strict=True):
        if (q := _quantile(a.get("fn", "count"))) is not None and a.get("column"):
            ranked.setdefault(a["column"], {})[name] = q
    plain = [aggregate_of(df, a, ctx) for a in specs if _quantile(a.get("fn", "count")) is None or not a.get("column")] or [F.count(F.lit(1)).alias("_n")]
    made = df.groupBy(*map(K.col, groups)).agg(*plain) if groups else df.agg(*plain)
    for c, at in ranked.items():
        need(df, c)
        if groups:
            counts = df.select(*map(K.col, groups), number(df, c).cast("double").alias("_v")).where("_v is not null").groupBy(*map(K.col, groups), "_v").agg(F.count(F.lit(1)).alias("n"))
            made = null_safe_join(made, group_quantiles(counts, groups, at, "_v"), groups)
        else:
            made = beside(made, exact_quantiles(df, number(df, c), at))
    return made.select(*map(K.col, groups), *map(K.col, names))


@step("window", "aggregate", "partition_by:columns order_by:column fn:row_number|rank|dense_rank|running_sum|running_avg|moving_avg|lag|lead|pct_of_total=row_number column:column window_size:number=3 output:text order_kind:text")
def window(df, p, ctx):
    """Nine window functions. Without a partition they run in phases, so that no task holds the table (ordering.py); order_kind hints what ordered text holds."""
    fn, parts, name = p["fn"], list(map(K.col, p.get("partition_by") or [])), p.get("column")
    v = number(df, name) if name else None
    if name is None and fn not in ("row_number", "rank", "dense_rank"):
        raise StepError(f"{fn} needs a value column")
    alias = out(p, fn)
    base = df.withColumn("_ord", sort_key(df, p["order_by"], p.get("order_kind"))) if p.get("order_by") else df
    ordered = order_names(base, ctx, "_ord" if p.get("order_by") else None) if p.get("order_by") or ROW_ID in df.columns or ctx.order else []
    if not ordered and fn != "pct_of_total" and fn not in ("rank", "dense_rank"):
        raise StepError("this calculation depends on the order of rows: name a column to order by")
    if fn == "pct_of_total":
        if parts:
            sums = df.groupBy(*parts).agg(F.sum(v).alias("_sum"))
            wide = null_safe_join(df, sums, p["partition_by"])
        else:
            wide = beside(df, df.agg(F.sum(v).alias("_sum")))
        return wide.withColumn(alias, F.round(F.try_divide(v, F.col("_sum")) * 100, 2)).drop("_sum")
    if not parts and fn in ("row_number", "running_sum", "running_avg"):
        if fn == "row_number":
            return running(base, ordered, F.lit(1).cast("long"), alias).drop("_ord")
        summed = running(base, ordered, v.cast("double"), alias)
        if fn == "running_avg":
            summed = running(summed, ordered, F.lit(1).cast("long"), "_rn").withColumn(alias, F.col(alias) / F.col("_rn")).drop("_rn")
        return summed.withColumn(alias, F.when(v.isNotNull(), F.col(alias))).drop("_ord")
    if not parts and fn in ("rank", "dense_rank"):
        key = F.col("_ord") if p.get("order_by") else v
        return ranks(base.withColumn("_key", key), "_key", alias, dense=fn == "dense_rank").drop("_key", "_ord")
    if not parts:
        size, value = int(p["window_size"]), v if fn == "moving_avg" else K.col(name)
        made, before, after = {"moving_avg": (lambda w: F.avg(value).over(w.rowsBetween(1 - size, 0)), size - 1, 0), "lag": (lambda w: F.lag(value).over(w), 1, 0), "lead": (lambda w: F.lead(value).over(w), 0, 1)}[fn]
        return in_blocks(base, ordered, made, before, after, alias).drop("_ord")
    w = Window.partitionBy(*parts)
    if fn in ("rank", "dense_rank"):
        key = F.col("_ord") if p.get("order_by") else v
        ranked = (F.rank if fn == "rank" else F.dense_rank)().over(w.orderBy(key.asc_nulls_last()))
        return base.withColumn(alias, F.when(key.isNotNull(), ranked)).drop("_ord")
    w = w.orderBy(*ascending(ordered))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    made = {
        "row_number": lambda: F.row_number().over(w),
        "running_sum": lambda: F.when(v.isNotNull(), F.sum(v).over(so_far)),
        "running_avg": lambda: F.when(v.isNotNull(), F.sum(v).over(so_far) / F.row_number().over(w)),
        "moving_avg": lambda: F.avg(v).over(w.rowsBetween(1 - int(p["window_size"]), 0)),
        "lag": lambda: F.lag(K.col(name)).over(w),
        "lead": lambda: F.lead(K.col(name)).over(w),
    }[fn]()
    return base.withColumn(alias, made).drop("_ord")


# ---- pivots
@step("pivot", "pivot", "index*:columns columns*:column values*:column agg:sum|mean|count|min|max|first=sum column_values:list", flags="R")
def pivot(df, p, ctx):
    """column_values: the values that become columns, which saves the scan that finds them."""
    v = number(df, p["values"]) if p["agg"] not in ("count", "first") else K.col(p["values"])
    agg = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "first": lambda c: F.min_by(c, rank_key(order_names(df, ctx)))}[p["agg"]](v)
    return df.withColumn("_pivot", K.text(K.col(p["columns"]))).groupBy(*map(K.col, p["index"])).pivot("_pivot", p.get("column_values")).agg(agg)


def _unpivot(df: DataFrame, ids: list[str], values: list[str] | None, name: str, value: str) -> DataFrame:
    chosen = values or [c for c in df.columns if c not in ids and c != ROW_ID]
    kind = reduce(_wider, [df.schema[c].dataType for c in chosen])
    return df.select(*map(K.col, ids), *[K.col(c).cast(kind).alias(c) for c in chosen]).unpivot(list(map(K.col, ids)), list(map(K.col, chosen)), name, value)


@step("unpivot", "pivot", "id_columns*:columns value_columns:columns variable_name:text=attribute value_name:text=value", flags="R", stream=True)
def unpivot(df, p, ctx):
    return _unpivot(df, p["id_columns"], p.get("value_columns"), p["variable_name"], p["value_name"])


@step("melt", "pivot", "id_columns*:columns value_columns:columns", flags="R", stream=True)
def melt(df, p, ctx):
    return _unpivot(df, p["id_columns"], p.get("value_columns"), "variable", "value")


@step("crosstab", "pivot", "row*:column column*:column column_values:list", flags="R")
def crosstab(df, p, ctx):
    counts = df.withColumn("_pivot", K.text(K.col(p["column"]))).groupBy(K.col(p["row"])).pivot("_pivot", p.get("column_values")).agg(F.count(F.lit(1)))
    return counts.na.fill(0).orderBy(K.col(p["row"]).asc_nulls_last())


# ---- schema and structure
@step("rename_columns", "schema", "mapping*:rename_map", stream=True)
def rename_columns(df, p, ctx):
    return df.withColumnsRenamed({k: v for k, v in p["mapping"].items() if k in df.columns})


@step("standardize_column_names", "schema", "style:snake|lower=snake", stream=True)
def standardize_column_names(df, p, ctx):
    used: dict[str, int] = {}
    names = []
    for c in df.columns:
        new = c if c == ROW_ID else snake(c) if p["style"] == "snake" else c.strip().lower()
        used[new] = used.get(new, 0) + 1
        names.append(new if used[new] == 1 else f"{new}_{used[new]}")
    return df.toDF(*names)


@step("drop_columns", "schema", "columns*:columns", flags="D", stream=True)
def drop_columns(df, p, ctx):
    return df.drop(*p["columns"])


@step("select_columns", "schema", "columns*:columns", flags="D", stream=True)
def select_columns(df, p, ctx):
    return df.select(*([F.col(ROW_ID)] if ROW_ID in df.columns and ROW_ID not in p["columns"] else []), *map(K.col, p["columns"]))


@step("add_column", "schema", "output*:text value:text value_type:text|number|current_timestamp=text", stream=True)
def add_column(df, p, ctx):
    value = {"text": lambda: F.lit(p.get("value")).cast("string"), "number": lambda: F.lit(None if p.get("value") in (None, "") else float(p["value"])).cast("double"), "current_timestamp": lambda: F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())}[p["value_type"]]()
    return df.withColumn(p["output"], value)


@step("reorder_columns", "schema", "order*:column_order", stream=True)
def reorder_columns(df, p, ctx):
    first = [c for c in p["order"] if c in df.columns]
    return df.select(*map(K.col, [*first, *[c for c in df.columns if c not in first]]))


def _flat(df: DataFrame, roots: list[str] | None, between: str, arrays: str) -> DataFrame:
    made: list[Column] = []

    def walk(name: str, c: Column, kind: T.DataType, depth: int) -> None:
        if isinstance(kind, T.StructType) and depth < 8:
            for f in kind.fields:
                walk(f"{name}{between}{f.name}", c.getField(f.name), f.dataType, depth + 1)
        elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.ArrayType)) and arrays != "keep":
            made.append((F.array_join(c.cast("array<string>"), ", ") if arrays == "join" else F.when(c.isNotNull(), F.size(c))).alias(name))
        else:
            made.append(c.alias(name))

    for f in df.schema.fields:
        if roots and f.name not in roots:
            made.append(K.col(f.name))
        else:
            walk(f.name, K.col(f.name), f.dataType, 0)
    return df.select(*made)


@step("flatten", "schema", "columns:columns separator:text=_ arrays:join|keep|count=join", stream=True)
def flatten(df, p, ctx):
    return _flat(df, p.get("columns"), p["separator"], p["arrays"])


@step("explode", "schema", "column*:column", flags="R", stream=True)
def explode(df, p, ctx):
    """A row for each item; a struct that only wraps a list is unwrapped, structs become columns, no items give one null row."""
    name = p["column"]
    kind, c = df.schema[name].dataType, K.col(name)
    while isinstance(kind, T.StructType) and len(kind.fields) == 1:
        kind, c = kind.fields[0].dataType, c.getField(kind.fields[0].name)
    if not isinstance(kind, T.ArrayType):
        raise StepError(f"{name} holds no list")
    rows = df.withColumn("_list", c).drop(name).select(*[K.col(x) for x in df.columns if x != name], F.explode_outer("_list").alias(name)).select(df.columns)
    return _flat(rows, [name], "_", "keep") if isinstance(kind.elementType, T.StructType) else rows


@step("extract_field", "schema", "column*:column path*:text output:text", stream=True)
def extract_field(df, p, ctx):
    c, kind = K.col(p["column"]), df.schema[p["column"]].dataType
    for part in p["path"].split("."):
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            raise StepError(f"there is no field {part!r} in {p['column']}")
        c, kind = c.getField(part), kind[part].dataType
    return df.withColumn(out(p, p["path"].split(".")[-1]), c)


@step("schema_mapping", "schema", "mappings*:schema_map drop_unmapped:boolean=False", stream=True)
def schema_mapping(df, p, ctx):
    made = {}
    for m in p["mappings"]:
        source, target = m["source"], m.get("target") or m["source"]
        made[target] = (source, cast(need(df, source), df.schema[source].dataType, m["type"]) if m.get("type") else K.col(source))
    sources = {s for s, _ in made.values()}
    rest = [] if p["drop_unmapped"] else [c for c in df.columns if c not in sources and c not in made]
    row_id = [ROW_ID] if ROW_ID in df.columns and ROW_ID not in rest else []
    return df.select(*map(K.col, [*row_id, *rest]), *[c.alias(t) for t, (_, c) in made.items()])


@step("schema_evolution_align", "schema", "target*:text sources*:columns", stream=True)
def schema_evolution_align(df, p, ctx):
    names = [c for c in [p["target"], *p["sources"]] if c in df.columns]
    kind = reduce(_wider, [df.schema[c].dataType for c in names])
    aligned = F.coalesce(*[F.when(~K.blank(K.col(c)), K.col(c).cast(kind)) for c in names])
    return df.withColumn(p["target"], aligned).drop(*[c for c in p["sources"] if c != p["target"]])


# ---- quality, by statistics
@step("clip_outliers", "quality", "column*:column factor:number=3")
def clip_outliers(df, p, ctx):
    """Values beyond factor times the interquartile range of the quartiles are set to that bound; by interpolated quartiles."""
    v, k = number(df, p["column"]), float(p["factor"])
    wide = beside(df, exact_quantiles(df, v, {"_q1": 0.25, "_q3": 0.75}))
    iqr = F.col("_q3") - F.col("_q1")
    bounded = F.round(F.when(v.isNotNull(), F.least(F.greatest(v, F.col("_q1") - k * iqr), F.col("_q3") + k * iqr)), 2)
    return wide.withColumn(p["column"], bounded).select(df.columns)
