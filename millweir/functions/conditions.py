"""The 16 condition operators, as columns that are true or false, never null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millweir.functions import kernels as K

OPERATORS = ["equals", "not_equals", "gt", "gte", "lt", "lte", "between", "contains", "not_contains", "starts_with", "ends_with", "in_list", "not_in_list", "is_null", "is_not_null", "matches"]


class StepError(ValueError):
    """A step that can't be built: an unknown column, operator or parameter."""


def need(df: DataFrame, name: str | None) -> Column:
    if not name or name not in df.columns:
        raise StepError(f"there is no column {name!r}; there are {', '.join(df.columns)}")
    return K.col(name)


def _comparable(df: DataFrame, name: str, *values: object) -> tuple[Column, list[Column]]:
    """The column and values as numbers, dates or text, by the column's type and by what the values look like."""
    kind, c = df.schema[name].dataType, K.col(name)
    spelt = [str(v) for v in values]
    if isinstance(kind, T.NumericType):
        return c.cast("double"), [F.lit(v).try_cast("double") for v in spelt]
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("date"), [K.date(F.lit(v)) for v in spelt]
    try:
        return K.numeric(c), [F.lit(float(v.replace(",", ""))) for v in spelt]
    except ValueError:
        pass
    if all(len(v) == 10 and v[4] == v[7] == "-" for v in spelt):
        return K.date(c), [K.date(F.lit(v)) for v in spelt]
    return K.text(c), [F.lit(v) for v in spelt]


def condition(df: DataFrame, spec: dict) -> Column:
    name, op, value = spec.get("column"), spec.get("op", "equals"), spec.get("value")
    c = need(df, name)
    spelt, exact = "" if value is None else str(value), bool(spec.get("case_sensitive"))
    s = K.text(c)
    sure = lambda x: F.coalesce(x, F.lit(False))
    if op == "is_null":
        return K.blank(c)
    if op == "is_not_null":
        return ~K.blank(c)
    if op in ("equals", "not_equals"):
        if isinstance(df.schema[name].dataType, T.NumericType):
            same = c.cast("double") == F.lit(spelt).try_cast("double")
        else:
            same = s == spelt if exact else K.key(c) == spelt.lower().strip()
        return sure(same) if op == "equals" else ~sure(same)
    if op in ("contains", "starts_with", "ends_with", "not_contains"):
        base, needle = (s, spelt) if exact and op != "not_contains" else (F.lower(s), spelt.lower())
        found = {"starts_with": base.startswith, "ends_with": base.endswith}.get(op, base.contains)(F.lit(needle))
        return ~sure(found) if op == "not_contains" else sure(found)
    if op in ("in_list", "not_in_list"):
        items = [str(x).strip().lower() for x in (value if isinstance(value, list) else spelt.split(","))]
        found = sure(K.key(c).isin(items))
        return found if op == "in_list" else ~found
    if op == "matches":
        return sure(s.rlike("(?U)" + spelt))
    if op == "between":
        e, (low, high) = _comparable(df, name, value, spec.get("value2"))
        return sure(e.between(low, high))
    if op in ("gt", "gte", "lt", "lte"):
        e, (v,) = _comparable(df, name, value)
        return sure({"gt": e > v, "gte": e >= v, "lt": e < v, "lte": e <= v}[op])
    raise StepError(f"there is no condition {op!r}")


def combine(df: DataFrame, specs: list[dict], logic: str = "and") -> Column:
    parts = [condition(df, s) for s in specs or []]
    return (K.all_of if logic == "and" else K.any_of)(parts) if parts else F.lit(True)
