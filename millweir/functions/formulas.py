"""Formula trees: validated, then compiled to columns.

A node is {"type": "column", "name"}, {"type": "literal", "value"}, {"type": "op", "op", "left", "right"}, {"type": "func", "name", "args"},
{"type": "if", "condition", "then", "else"} or {"type": "not", "arg"}. The remainder has the sign of the dividend, as in SQL.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millweir.functions import kernels as K
from millweir.functions.conditions import StepError, need

DEEPEST = 40
OPERATORS = ["+", "-", "*", "/", "%", "==", "!=", ">", "<", ">=", "<=", "and", "or"]


def _years(start: Column, end: Column) -> Column:
    early = F.struct(F.month(end), F.dayofmonth(end)) < F.struct(F.month(start), F.dayofmonth(start))
    return (F.year(end) - F.year(start) - F.when(early, 1).otherwise(0)).cast("long")


FUNCTIONS: dict[str, tuple[int, int, Callable[..., Column]]] = {
    "upper": (1, 1, lambda a: F.upper(K.text(a))),
    "lower": (1, 1, lambda a: F.lower(K.text(a))),
    "trim": (1, 1, K.strip),
    "length": (1, 1, lambda a: F.char_length(K.text(a)).cast("long")),
    "concat": (1, 99, lambda *a: F.concat_ws("", *map(K.text, a))),
    "left": (2, 2, lambda a, n: F.left(K.text(a), n.cast("int"))),
    "contains": (2, 2, lambda a, b: F.contains(K.text(a), K.text(b))),
    "replace": (3, 3, lambda a, b, c: F.replace(K.text(a), K.text(b), K.text(c))),
    "coalesce": (1, 99, F.coalesce),
    "is_empty": (1, 1, K.blank),
    "to_number": (1, 1, K.numeric),
    "round": (1, 2, lambda a, n=None: F.round(a, F.lit(0) if n is None else n.cast("int"))),
    "abs": (1, 1, F.abs),
    "floor": (1, 1, F.floor),
    "ceil": (1, 1, F.ceil),
    "to_text": (1, 1, K.text),
    "to_date": (1, 1, K.date),
    "today": (0, 0, None),
    "year": (1, 1, F.year),
    "month": (1, 1, F.month),
    "day": (1, 1, F.dayofmonth),
    "quarter": (1, 1, F.quarter),
    "days_between": (2, 2, lambda a, b: F.datediff(b, a).cast("long")),
    "years_between": (2, 2, _years),
    "add_days": (2, 2, lambda a, n: F.date_add(a, n.cast("int"))),
}
#: Whose arguments are read as numbers or dates when they are text.
OF_NUMBERS, OF_DATES = {"round", "abs", "floor", "ceil"}, {"year", "month", "day", "quarter", "days_between", "years_between", "add_days"}


def validate(node: dict, columns: list[str], depth: int = 0) -> list[str]:
    """What is wrong with a tree, empty if nothing."""
    if depth > DEEPEST:
        return [f"the formula is nested deeper than {DEEPEST} levels"]
    if not isinstance(node, dict):
        return ["a node must be an object"]
    kind, below = node.get("type"), []
    if kind == "column":
        return [] if node.get("name") in columns else [f"there is no column {node.get('name')!r}"]
    if kind == "literal":
        return [] if isinstance(node.get("value"), (str, int, float, bool, type(None))) else ["a literal must be text, a number, true, false or null"]
    if kind == "op":
        if node.get("op") not in OPERATORS:
            return [f"there is no operator {node.get('op')!r}"]
        below = [node.get("left"), node.get("right")]
    elif kind == "func":
        args, known = node.get("args") or [], FUNCTIONS.get(node.get("name", ""))
        if not known:
            return [f"there is no function {node.get('name')!r}"]
        if not known[0] <= len(args) <= known[1]:
            return [f"{node['name']} takes {known[0]} to {known[1]} arguments, not {len(args)}"]
        below = args
    elif kind == "if":
        below = [node.get("condition"), node.get("then"), node.get("else", {"type": "literal", "value": None})]
    elif kind == "not":
        below = [node.get("arg")]
    else:
        return [f"there is no node type {kind!r}"]
    return [problem for x in below for problem in validate(x, columns, depth + 1)]


def compile_formula(node: dict, df: DataFrame, today: datetime.date) -> Column:
    """The column of a valid tree. Arithmetic and comparisons of order read text as numbers; == and != do not."""

    def is_text(n: dict) -> bool:
        return n["type"] == "column" and isinstance(df.schema[n["name"]].dataType, T.StringType)

    def number(n: dict) -> Column:
        if n["type"] == "literal" and isinstance(n["value"], str):
            try:
                return F.lit(float(n["value"]))
            except ValueError:
                return F.lit(n["value"])
        return K.numeric(walk(n)) if is_text(n) else walk(n)

    def walk(n: dict) -> Column:
        kind = n["type"]
        if kind == "column":
            return need(df, n["name"])
        if kind == "literal":
            return F.lit(n["value"])
        if kind == "not":
            return ~walk(n["arg"])
        if kind == "if":
            return F.when(walk(n["condition"]), walk(n["then"])).otherwise(walk(n.get("else") or {"type": "literal", "value": None}))
        if kind == "func":
            name, args = n["name"], n.get("args") or []
            if name == "today":
                return F.lit(today)
            read = number if name in OF_NUMBERS else (lambda x: K.date(walk(x)) if is_text(x) or x["type"] == "literal" and isinstance(x["value"], str) else walk(x)) if name in OF_DATES else walk
            return FUNCTIONS[name][2](*map(read, args))
        op = n["op"]
        if op in ("and", "or"):
            a, b = walk(n["left"]), walk(n["right"])
            return a & b if op == "and" else a | b
        if op in ("==", "!="):
            a, b = walk(n["left"]), walk(n["right"])
            return a == b if op == "==" else a != b
        a, b = number(n["left"]), number(n["right"])
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a.cast("double"), b.cast("double")), "%": lambda: F.when(b != 0, a % b), ">": lambda: a > b, "<": lambda: a < b, ">=": lambda: a >= b, "<=": lambda: a <= b}[op]()

    problems = validate(node, df.columns)
    if problems:
        raise StepError("; ".join(problems))
    return walk(node)


def describe(node: dict) -> str:
    """A tree in words."""
    kind = node["type"]
    if kind == "column":
        return node["name"]
    if kind == "literal":
        return "nothing" if node["value"] is None else repr(node["value"])
    if kind == "not":
        return f"not ({describe(node['arg'])})"
    if kind == "if":
        return f"if {describe(node['condition'])} then {describe(node['then'])} else {describe(node.get('else') or {'type': 'literal', 'value': None})}"
    if kind == "func":
        return f"{node['name']}({', '.join(map(describe, node.get('args') or []))})"
    return f"({describe(node['left'])} {node['op']} {describe(node['right'])})"
