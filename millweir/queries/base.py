"""Dirty views of the clean tables, as expressions that Spark and other SQL engines read alike."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

from millweir.operators import relational, scalar  # noqa: F401 - they register the steps
from millweir.operators.registry import Context, run
from millweir.session import table

TODAY = datetime.date(2024, 6, 30)
_PAD = "lpad(cast(c_custkey % 10000 as varchar(10)), 4, '0')"
_Y, _M, _D = "cast(2000 + c_custkey % 20 as varchar(4))", "lpad(cast(1 + c_custkey % 12 as varchar(2)), 2, '0')", "lpad(cast(1 + c_custkey % 28 as varchar(2)), 2, '0')"

_MONTH = "case 1 + c_custkey % 12 " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"], 1)) + " end"
_SHORT, _T = f"substr({_MONTH}, 1, 3)", "'12:30"
#: A day in each of the formats that are read; a month above 12 tells d/M from M/d.
_WRITTEN = [
    [_Y, "'-'", _M, "'-'", _D], [_M, "'/'", _D, "'/'", _Y], [_D, "' '", _SHORT, "' '", _Y], [_Y, "'/'", _M, "'/'", _D], [_D, "'-'", _M, "'-'", _Y], [_SHORT, "' '", _D, "', '", _Y], ["'28/'", _M, "'/'", _Y], [_Y, _M, _D], [_D, "'.'", _M, "'.'", _Y],
    [_MONTH, "' '", _D, "', '", _Y], [_D, "' '", _MONTH, "' '", _Y], [_Y, "'-'", _M, "'-'", _D, f"'T{_T[1:]}:00'"], [_Y, "'-'", _M, "'-'", _D, f"' {_T[1:]}:00'"], [_Y, "'-'", _M, "'-'", _D, f"'T{_T[1:]}:00.125'"], [_Y, "'-'", _M, "'-'", _D, f"'T{_T[1:]}:00Z'"], [_Y, "'-'", _M, "'-'", _D, f"'T{_T[1:]}:00.25Z'"], [_M, "'/'", _D, "'/'", _Y, f"' {_T[1:]}'"],
]

VIEWS = {
    "cust": ("customer", {
        "id": "c_custkey",
        "name": "case when c_custkey % 7 = 0 then null when c_custkey % 5 = 0 then concat('  ', upper(c_name), chr(9)) when c_custkey % 3 = 0 then concat('jean-luc  o''brien ', cast(c_custkey % 9 as varchar(2)), '!!') else c_name end",
        "email": "case when c_custkey % 11 = 0 then concat('bad', cast(c_custkey as varchar(10))) when c_custkey % 13 = 0 then '' when c_custkey % 3 = 0 then concat(' User', cast(c_custkey as varchar(10)), '@Mail.COM ') else concat('u.', cast(c_custkey as varchar(10)), '@x.org') end",
        "phone": f"case when c_custkey % 5 = 0 then concat('(555) 123-', {_PAD}) when c_custkey % 5 = 1 then concat('+44 20 7946 ', {_PAD}) when c_custkey % 5 = 2 then '12' when c_custkey % 5 = 3 then concat('1555123', {_PAD}) else null end",
        "country": "case when c_custkey % 6 = 0 then 'USA' when c_custkey % 6 = 1 then ' u.k. ' when c_custkey % 6 = 2 then 'Deutschland' when c_custkey % 6 = 3 then 'Atlantis' when c_custkey % 6 = 4 then 'fr' else null end",
        "amount": "case when c_custkey % 6 = 0 then concat('$', cast(1 + c_custkey % 9 as varchar(4)), ',', lpad(cast(c_custkey % 1000 as varchar(4)), 3, '0'), '.50') when c_custkey % 6 = 1 then concat('(', cast(c_custkey % 100 as varchar(4)), ')') when c_custkey % 6 = 2 then 'n/a' when c_custkey % 6 = 3 then ' ' when c_custkey % 6 = 4 then cast(c_custkey as varchar(10)) else null end",
        "joined": f"case when c_custkey % 5 = 0 then concat({_Y}, '-', {_M}, '-', {_D}) when c_custkey % 5 = 1 then concat({_M}, '/', {_D}, '/', {_Y}) when c_custkey % 5 = 2 then concat({_D}, '.', {_M}, '.', {_Y}) when c_custkey % 5 = 3 then 'soon' else null end",
        "flag": "case when c_custkey % 5 = 0 then ' Yes' when c_custkey % 5 = 1 then 'no' when c_custkey % 5 = 2 then '1' when c_custkey % 5 = 3 then 'maybe' else null end",
        "code": "case when c_custkey % 4 = 0 then concat(' a ', cast(c_custkey % 50 as varchar(3))) else concat('b', cast(c_custkey % 50 as varchar(3))) end",
        "cur": "case when c_custkey % 3 = 0 then 'eur' when c_custkey % 3 = 1 then ' USD ' else 'XXX' end",
        "segment": "c_mktsegment", "nation": "c_nationkey", "bal": "c_acctbal",
        "sparse": "case when c_custkey % 3 = 0 then null else c_acctbal end",
    }),
    "ord": ("orders", {"okey": "o_orderkey", "custkey": "case when o_orderkey % 17 = 0 then o_custkey + 1000000 else o_custkey end", "status": "o_orderstatus", "price": "o_totalprice", "odate": "cast(o_orderdate as date)", "prio": "o_orderpriority"}),
    "dup": ("customer", {"k": "c_custkey % 300", "v": "c_custkey", "seg": "c_mktsegment", "txt": "case when c_custkey % 4 = 0 then null else concat('v', cast(c_custkey % 7 as varchar(3))) end", "d": "case when c_custkey % 10 = 9 then null else concat('2020-01-', lpad(cast(1 + c_custkey % 28 as varchar(2)), 2, '0')) end"}),
    # values that only a rule of their own makes alike: near texts, wide letters, every date format, typed numbers
    "odd": ("customer", {
        "id": "c_custkey",
        "near": "case when c_custkey % 3 = 0 then md5(cast(c_custkey % 40 as varchar(4))) when c_custkey % 3 = 1 then concat(substr(md5(cast(c_custkey % 40 as varchar(4))), 1, 20), 'q', substr(md5(cast(c_custkey % 40 as varchar(4))), 21)) else concat(' ', upper(md5(cast(c_custkey % 40 as varchar(4)))), '!') end",
        "wide": "concat('Ａｂ', cast(c_custkey % 9 as varchar(2)), 'ﬁ  ½')",
        "item": "case when c_custkey % 4 = 0 then null when c_custkey % 4 = 1 then concat('ITEM-', cast(c_nationkey as varchar(4)), '  Élan') else concat('élan, item ', cast(c_nationkey as varchar(4))) end",
        "share": "case when c_custkey % 4 = 0 then concat(cast(c_custkey % 100 as varchar(4)), '%') when c_custkey % 4 = 1 then concat('0.', lpad(cast(c_custkey % 100 as varchar(4)), 2, '0')) when c_custkey % 4 = 2 then cast(c_custkey % 100 + 2 as varchar(4)) else 'none' end",
        "stamp": f"case when c_custkey % 3 = 0 then concat({_Y}, '-', {_M}, '-', {_D}, ' 07:08:09') when c_custkey % 3 = 1 then concat({_Y}, '-', {_M}, '-', {_D}, 'T07:08:09Z') else 'later' end",
        "day": "case " + " ".join(f"when c_custkey % 19 = {i} then concat({', '.join(parts)})" for i, parts in enumerate(_WRITTEN)) + " else 'no day' end",
        "made": f"cast(concat({_Y}, '-', {_M}, '-', {_D}) as date)",
    }),
    "item": ("nation", {"label": "concat('Item ', cast(n_nationkey as varchar(4)), ' élan')", "nname": "n_name"}),
    "half": ("nation", {"nkey": "cast(n_nationkey as double) + 0.5", "nname": "n_name", "region": "cast(n_regionkey as varchar(4))"}),
    "nat": ("nation", {"nkey": "n_nationkey", "nname": "n_name", "region": "n_regionkey"}),
}


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    return table(spark, d, source).selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def with_views(sql: str) -> str:
    """SQL with the views it names in front."""
    used = [n for n in VIEWS if f" {n}" in sql]
    ctes = [f"{n} as (select {', '.join(f'{e} as {c}' for c, e in VIEWS[n][1].items())} from {VIEWS[n][0]})" for n in used]
    body = sql.strip()
    if body.startswith("with "):
        return "with " + ", ".join(ctes) + ", " + body[5:]
    return "with " + ", ".join(ctes) + " " + body if ctes else body


def context(spark: SparkSession, d: str, order: list[str] | None = None) -> Context:
    return Context(dataset=lambda n: view(spark, d, n), today=TODAY, key=b"secret", order=order or [])


def steps(base: str, *chain: tuple[str, dict], keep: list[str] | None = None, order: list[str] | None = None):  # noqa: ANN201
    """A query that applies steps to a view."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        df = view(spark, d, base)
        for name, params in chain:
            df = run(df, name, params, context(spark, d, order))
        return df.select(*keep) if keep else df

    return query
