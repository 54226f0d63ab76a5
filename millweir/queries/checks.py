"""Queries of the general problems: column profiles by load (p1) and orphan references (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millweir.operators.column_profile import column_metrics, mask_violations, profile_loads
from millweir.operators.orphans import find_orphans, orphan_counts, parent_validity
from millweir.session import table

#: The columns of p1_found; p1_profile, p1_masks and p1_extent cover every column of both tables.
WATCHED = {"inventory": ["list_price", "model_year"], "sales_reps": ["email"]}


def _both(spark: SparkSession, d: str, make) -> DataFrame:
    parts = [make(name, table(spark, d, name)).select(F.lit(name).alias("tbl_name"), "*") for name in WATCHED]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _both(spark, d, lambda name, df: profile_loads(df, "load_id", WATCHED[name]))
    return rows.where("departs").select("tbl_name", "col_name", "load_id")


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, lambda _, df: profile_loads(df, "load_id"))


def p1_masks(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, lambda _, df: mask_violations(df, "load_id")).select("tbl_name", "col_name", "load_id", "mask", "n")


def p1_extent(spark: SparkSession, d: str) -> DataFrame:
    rows = _both(spark, d, lambda _, df: column_metrics(df, "load_id"))
    # a decimal's digits don't depend on who writes it
    shown = lambda c: F.when(F.col("col_name") == "list_price", F.col(c).try_cast("double").cast("decimal(20,4)").cast("string")).otherwise(F.col(c)).alias(c)
    return rows.select("tbl_name", "col_name", "load_id", "n_rows", "n_null", "n_distinct", shown("min_value"), shown("max_value"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    validity = parent_validity(table(spark, d, "dealers"), table(spark, d, "dealer_deletions"), "dealer_id", "load_id")
    found = [
        find_orphans(table(spark, d, name), validity, row_id, "dealer_id", "load_id").select(F.lit(name).alias("tbl_name"), "row_id", "load_id", "kind")
        for name, row_id in (("sales_reps", "rep_id"), ("inventory", "stock_id"))
    ]
    return found[0].unionByName(found[1])


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(p5_found(spark, d))


QUERIES = {"p1_found": p1_found, "p1_profile": p1_profile, "p1_masks": p1_masks, "p1_extent": p1_extent, "p5_found": p5_found, "p5_counts": p5_counts}

_P5 = """
  select distinct r.tbl_name, r.row_id, r.load_id,
         case when d.valid_from is null then case when g.dealer_id is null then 'missing' else 'deleted' end else 'late' end as kind
  from (select 'sales_reps' as tbl_name, rep_id as row_id, dealer_id, load_id from sales_reps
        union all select 'inventory', stock_id, dealer_id, load_id from inventory) r
  left join (select dealer_id, min(load_id) as valid_from from dealers group by dealer_id) d on r.dealer_id = d.dealer_id
  left join (select distinct dealer_id from dealer_deletions) g on r.dealer_id = g.dealer_id
  where r.dealer_id is not null and (d.valid_from is null or d.valid_from > r.load_id)
"""


_COLUMNS = {
    "inventory": {"stock_id": "whole", "dealer_id": "whole", "vin": "text", "make": "text", "model": "text", "model_year": "whole", "list_price": "decimal", "status": "text", "modified_at": "time", "loaded_at": "time"},
    "sales_reps": {"rep_id": "whole", "dealer_id": "whole", "full_name": "text", "email": "text", "phone": "text", "hired_on": "text", "modified_at": "time", "loaded_at": "time"},
}


def _extent_sql() -> str:
    shown = lambda c, kind, of: f"cast(cast({of}({c}) as decimal(20,4)) as varchar)" if kind == "decimal" else f"cast({of}({c}) as varchar)"
    return "\nunion all ".join(
        f"select '{t}' as tbl_name, '{c}' as col_name, load_id, count(*) as n_rows, count(*) - count({c}) as n_null, count(distinct {c}) as n_distinct, {shown(c, kind, 'min')} as min_value, {shown(c, kind, 'max')} as max_value from {t} group by load_id"
        for t, columns in _COLUMNS.items()
        for c, kind in columns.items()
    )


def _masks_sql() -> str:
    def mask(c: str, kind: str) -> str:
        if kind != "text":
            text = f"regexp_replace(cast(cast({c} as decimal(38,6)) as varchar), '0+$', '')" if kind == "decimal" else f"cast({c} as varchar)"
            return f"regexp_replace({text}, '[0-8]', '9', 'g')"
        for pattern, by in (("[\\p{Ll}\\p{Lo}]+", "a"), ("\\p{Lu}+", "A"), ("\\p{Nd}+", "9"), ("[aA9]{4,}", "x"), ("([aAx9][^aAx9]){6,}", "+")):
            c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
        return c

    values = " union all ".join(f"select '{t}' as t, '{c}' as c, load_id, {mask(c, kind)} as mask from {t}" for t, columns in _COLUMNS.items() for c, kind in columns.items())
    return f"""
      with v as ({values}), n as (select t, c, load_id, mask, count(*) as n from v where mask is not null group by all), s as (select *, n / sum(n) over (partition by t, c, load_id) as share from n),
      l as (select t, c, count(distinct load_id) as loads from n group by all), k as (select t, c, mask, list(share) as seen from s group by all),
      m as (select k.t, k.c, k.mask, list_aggregate(list_concat(seen, list_transform(range(loads - len(seen)), lambda x: 0.0)), 'median') as typical from k join l on k.t = l.t and k.c = l.c)
      select s.t as tbl_name, s.c as col_name, s.load_id, s.mask, s.n from s join m on s.t = m.t and s.c = m.c and s.mask = m.mask where typical < 0.002"""


ORACLES = {
    "p1_extent": _extent_sql(),
    "p1_masks": _masks_sql(),
    "p5_found": _P5,
    "p5_counts": f"select tbl_name, load_id, kind, count(*) as n_rows from ({_P5}) group by all",
}
