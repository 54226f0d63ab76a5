"""Quality predicates written in SQL: one boolean expression, checked against an allow-list and made safe for dirty text.

Spark's own parser reads the expression; its tree is walked and compiled anew to columns, so nothing but the listed operators and
functions can run. Comparisons read text as the other side's type; a null result passes.
"""

from __future__ import annotations

import datetime
import difflib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millweir.functions import kernels as K
from millweir.functions.conditions import StepError

# The functions a predicate may use.
ALLOWED = {
    "length", "char_length", "character_length", "len", "upper", "ucase", "lower", "lcase", "trim", "ltrim", "rtrim", "abs", "round", "coalesce", "nvl", "ifnull", "current_date", "current_timestamp", "now", "to_date", "year", "month", "day", "dayofmonth",
    "datediff", "date_diff", "regexp_replace", "substring", "substr", "concat", "startswith", "endswith", "contains", "isnull", "isnotnull", "if",
}
_COMPARISONS = {"EqualTo": "=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<="}
_ARITHMETIC = {"Add": "+", "Subtract": "-", "Multiply": "*", "Divide": "/", "Remainder": "%"}
#: The order in which types win when two sides differ.
_RANK = {"ts": 4, "date": 3, "num": 2, "bool": 1, "str": 0, "null": -1}


def _kind(kind: T.DataType) -> str:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "ts"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, T.NumericType):
        return "num"
    return "bool" if isinstance(kind, T.BooleanType) else "str"


def _bare(name: str) -> str:
    return re.sub(r"[\s_]+", "", name).lower()


def resolve(name: str, columns: list[str]) -> str:
    """A column by its name without regard to case, blanks and underscores."""
    if name in columns:
        return name
    found = [c for c in columns if _bare(c) == _bare(name)]
    if len(found) == 1:
        return found[0]
    near = difflib.get_close_matches(name.lower(), [c.lower() for c in columns], 1)
    raise StepError(f"there is no column {name!r}" + (f"; did you mean {near[0]}?" if near else ""))


class Predicate:
    """A parsed predicate: its columns, and its column expression on a DataFrame."""

    def __init__(self, sql: str, df: DataFrame, today: datetime.date | None = None) -> None:
        text = sql.strip()
        if not text or ";" in re.sub(r"'(?:[^']|'')*'", "", text):
            raise StepError("a predicate is one expression, without semicolons")
        if re.match(r"(?i)\s*(select|with|insert|update|delete|drop|create|alter|merge|set|use|grant)\b", text):
            raise StepError("a predicate is an expression, not a statement")
        spark = df.sparkSession
        self.df, self.today, self.columns = df, today, set()
        try:
            tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
        except Exception as e:  # noqa: BLE001 - the parser's error comes wrapped
            raise StepError(f"the expression can't be read: {str(e).splitlines()[0]}") from None
        column, kind = self._walk(tree)
        if kind not in ("bool", "null"):
            raise StepError("a predicate must be true or false")
        self.column = F.coalesce(column, F.lit(True))

    def _children(self, node) -> list:  # noqa: ANN001
        kids = node.children()
        return [kids.apply(i) for i in range(kids.size())]

    def _as(self, c: Column, kind: str, to: str) -> Column:
        if kind == to or kind == "null":
            return c
        if to == "num":
            return K.numeric(c) if kind == "str" else c.try_cast("double")
        if to == "date":
            return K.date(c) if kind == "str" else c.try_cast("date")
        if to == "ts":
            return K.timestamp(c) if kind == "str" else c.try_cast("timestamp_ntz")
        if to == "bool":
            return K.boolean(c)
        return K.text(c)

    def _pair(self, nodes: list, least: str = "str") -> tuple[list[Column], str]:
        parts = [self._walk(n) for n in nodes]
        to = max([k for _, k in parts] + [least], key=_RANK.__getitem__)
        to = "str" if to == "null" else to
        return [self._as(c, k, to) for c, k in parts], to

    def _walk(self, node) -> tuple[Column, str]:  # noqa: ANN001, C901
        name, kids = node.nodeName(), self._children(node)
        if name == "UnresolvedAttribute":
            found = resolve(".".join(str(node.nameParts().apply(i)) for i in range(node.nameParts().size())), self.df.columns)
            self.columns.add(found)
            return K.col(found), _kind(self.df.schema[found].dataType)
        if name == "Literal":
            kind = node.dataType().simpleString()
            value = node.value()
            if value is None:
                return F.lit(None), "null"
            if kind.startswith("string"):
                return F.lit(value.toString()), "str"
            if kind == "boolean":
                return F.lit(bool(value)), "bool"
            if kind.startswith(("date", "timestamp")):
                return K.date(F.lit(node.toString()[:10])), "date"
            return F.lit(float(str(node.toString()))), "num"
        if name in ("And", "Or"):
            a, b = (self._as(*self._walk(k), "bool") for k in kids)
            return (a & b if name == "And" else a | b), "bool"
        if name in ("Not", "UnresolvedNot"):
            return ~self._as(*self._walk(kids[0]), "bool"), "bool"
        if name in _COMPARISONS:
            (a, b), to = self._pair(kids)
            if to == "str":
                a, b = K.strip(a), K.strip(b)
            return {"=": lambda: a == b, ">": lambda: a > b, ">=": lambda: a >= b, "<": lambda: a < b, "<=": lambda: a <= b}[_COMPARISONS[name]](), "bool"
        if name in _ARITHMETIC:
            (a, b), _ = self._pair(kids, "num")
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: F.when(b != 0, a % b)}[_ARITHMETIC[name]](), "num"
        if name in ("UnaryMinus", "UnaryPositive"):
            c = self._as(*self._walk(kids[0]), "num")
            return (-c if name == "UnaryMinus" else c), "num"
        if name in ("IsNull", "IsNotNull"):
            c, _ = self._walk(kids[0])
            return (c.isNull() if name == "IsNull" else c.isNotNull()), "bool"
        if name == "In":
            parts, to = self._pair(kids)
            if to == "str":
                parts = [K.strip(c) for c in parts]
            return reduce(lambda a, b: a | b, [parts[0] == x for x in parts[1:]]), "bool"
        if name in ("UnresolvedBetween", "Between"):
            (c, low, high), _ = self._pair(kids[:3])
            return c.between(low, high), "bool"
        if name in ("Like", "ILike", "RLike"):
            c, pattern = (K.text(self._walk(k)[0]) for k in kids[:2])
            return {"Like": F.like, "ILike": F.ilike, "RLike": F.rlike}[name](c, pattern), "bool"
        if name == "CaseWhen":
            whens, values = kids[0 : len(kids) - len(kids) % 2 : 2], [*kids[1 : len(kids) - len(kids) % 2 : 2], *kids[len(kids) - len(kids) % 2 :]]
            made, kind = self._pair(values)
            out = made[-1] if len(kids) % 2 else F.lit(None)
            for w, v in reversed(list(zip(whens, made[: len(whens)], strict=True))):
                out = F.when(self._as(*self._walk(w), "bool"), v).otherwise(out)
            return out, kind
        if name == "Cast":
            c, kind = self._walk(kids[0])
            to = node.dataType().simpleString()
            if to.startswith(("array", "map", "struct", "binary", "interval")):
                raise StepError(f"a predicate can't cast to {to}")
            target = "ts" if to.startswith("timestamp") else "date" if to == "date" else "bool" if to == "boolean" else "str" if to == "string" else "num"
            return self._as(c, kind, target), target
        if name == "UnresolvedFunction":
            return self._call(str(node.nameParts().apply(node.nameParts().size() - 1)).lower(), kids)
        raise StepError(f"a predicate can't contain {name}")

    def _call(self, name: str, kids: list) -> tuple[Column, str]:  # noqa: C901
        if name == "between":
            (c, low, high), _ = self._pair(kids[:3])
            return c.between(low, high), "bool"
        if name not in ALLOWED:
            raise StepError(f"the function {name} is not allowed")
        text = lambda i: K.text(self._walk(kids[i])[0])
        as_date = lambda i: self._as(*self._walk(kids[i]), "date")
        if name in ("current_date", "current_timestamp", "now"):
            today = F.lit(self.today) if self.today else F.current_date()
            return (today, "date") if name == "current_date" else (today.cast("timestamp_ntz") if self.today else F.localtimestamp(), "ts")
        try:
            if name in ("length", "char_length", "character_length", "len"):
                return F.char_length(text(0)), "num"
            if name in ("upper", "ucase", "lower", "lcase"):
                return (F.upper if name in ("upper", "ucase") else F.lower)(text(0)), "str"
            if name in ("trim", "ltrim", "rtrim"):
                return {"trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim}[name](text(0)), "str"
            if name in ("abs", "round"):
                c = self._as(*self._walk(kids[0]), "num")
                return (F.abs(c) if name == "abs" else F.round(c, int(kids[1].toString()) if len(kids) > 1 else 0)), "num"
            if name in ("coalesce", "nvl", "ifnull"):
                parts, kind = self._pair(kids)
                return F.coalesce(*parts), kind
            if name == "to_date":
                return as_date(0), "date"
            if name in ("year", "month", "day", "dayofmonth"):
                return {"year": F.year, "month": F.month}.get(name, F.dayofmonth)(as_date(0)), "num"
            if name in ("datediff", "date_diff"):
                return F.datediff(as_date(0), as_date(1)), "num"
            if name == "regexp_replace":
                return F.regexp_replace(text(0), text(1), text(2)), "str"
            if name in ("substring", "substr"):
                return F.substr(text(0), self._walk(kids[1])[0].cast("int"), *([self._walk(kids[2])[0].cast("int")] if len(kids) > 2 else [])), "str"
            if name == "concat":
                return F.concat(*[text(i) for i in range(len(kids))]), "str"
            if name in ("startswith", "endswith", "contains"):
                return {"startswith": F.startswith, "endswith": F.endswith, "contains": F.contains}[name](text(0), text(1)), "bool"
            if name in ("isnull", "isnotnull"):
                c, _ = self._walk(kids[0])
                return (c.isNull() if name == "isnull" else c.isNotNull()), "bool"
            (a, b), kind = self._pair(kids[1:3])  # if
            return F.when(self._as(*self._walk(kids[0]), "bool"), a).otherwise(b), kind
        except IndexError:
            raise StepError(f"{name} lacks an argument") from None
