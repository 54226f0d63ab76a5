"""Quality rules from a sheet: a row a rule, told by a type with parameters, a predicate, or a plain sentence.

A sheet is a bounded table (read_sheet or read_csv), so its rows are read on the driver; each comes out as a rule or as a problem.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from millweir.functions.conditions import StepError
from millweir.operators.scalar import snake
from millweir.plans.english import to_rule
from millweir.plans.predicates import Predicate
from millweir.plans.quality import ACTIONS, RULES, SEVERITY, Rule

# Headings that a sheet may use for each field, and words for actions.
HEADINGS = {
    "name": ("rule name", "name"), "dataset": ("dataset", "table", "sheet"), "column": ("column", "field"), "type": ("rule type", "type", "check"), "params": ("parameters", "params"),
    "text": ("rule (plain english)", "rule", "description", "business rule", "plain english"), "sql": ("sql condition", "sql", "condition", "expression"), "severity": ("severity", "priority"), "action": ("on failure", "action", "on fail", "handling"),
    "green": ("green ≥ %", "green", "green %", "green threshold"), "amber": ("amber ≥ %", "amber", "amber %", "amber threshold"), "enabled": ("enabled", "active"),
}
ACTION_NAMES = {"flag & load": "flag", "flag": "flag", "warn": "flag", "quarantine": "quarantine", "park": "quarantine", "drop": "drop", "fail pipeline": "fail", "fail": "fail", "fail the run": "fail"}
OFF = ("no", "false", "0", "n")
#: Rows of a sheet that may come before its headings, and rows that may come in all.
LATEST_HEADING, MOST_ROWS = 10, 100_000


@dataclass
class Imported:
    row: int
    rule: Rule | None = None
    dataset: str | None = None
    problem: str = ""


def _number(text: str, otherwise: float) -> float:
    if not text:
        return otherwise
    if not re.fullmatch(r"\d+(\.\d+)?%?", text):
        raise StepError(f"{text!r} is no percentage")
    return float(text.rstrip("%"))


def parameters(kind: str, text: str) -> dict:
    """"min=1; max=today", "values=a, b", "length=3" or "pattern=^x"; in_set takes a bare list as well."""
    given = dict(re.findall(r"(?:^|[;\n])\s*(\w+)\s*=\s*([^;\n]*)", text))
    given = {k.lower(): v.strip() for k, v in given.items()}
    listed = next((given[k] for k in ("values", "value", "list") if k in given), text if kind == "in_set" and not given else None)
    made: dict = {k: float(given[k]) if re.fullmatch(r"-?\d+(\.\d+)?", given[k]) else given[k] for k in ("min", "max") if k in given}
    made |= {"pattern": given["pattern"]} if "pattern" in given else {}
    made |= {"length": int(float(given["length"]))} if "length" in given else {}
    return made | ({"values": [v.strip() for v in listed.split(",") if v.strip()]} if listed else {})


def _headings(rows: list[list[str]]) -> tuple[int, dict[str, int]]:
    known = {alias: fieldname for fieldname, aliases in HEADINGS.items() for alias in aliases}
    for at, row in enumerate(rows[:LATEST_HEADING]):
        found = {known[cell.lower()]: i for i, cell in reversed(list(enumerate(row))) if cell.lower() in known}
        if len(found) >= 2:
            return at, found
    raise StepError("the sheet has no row of headings such as column, rule type and severity")


def _rule(cells: dict[str, str], frames: Mapping[str, DataFrame]) -> tuple[str, Rule]:
    names = {n.lower(): n for n in frames}
    said = " ".join(cells[k] for k in ("column", "sql", "text")).lower()
    if cells["dataset"] and cells["dataset"].lower() not in names:
        raise StepError(f"there is no dataset {cells['dataset']!r}")
    name = names[cells["dataset"].lower()] if cells["dataset"] else next((n for n, df in frames.items() if any(c.lower() in said for c in df.columns)), next(iter(frames)))
    df = frames[name]
    column = next((c for c in df.columns if snake(c).replace("_", "") == snake(cells["column"]).replace("_", "")), None) if cells["column"] else None
    if cells["column"] and column is None:
        raise StepError(f"{name} has no column {cells['column']!r}")
    kind = cells["type"].lower().replace(" ", "_")
    if cells["sql"]:
        made = Rule("expression", min(Predicate(cells["sql"], df).columns, default=None), {"sql": cells["sql"]}, dimension="custom")
    elif kind:
        if kind not in RULES or kind == "expression" or column is None:
            raise StepError(f"{cells['type']!r} is no type of rule" if kind not in RULES else f"{cells['type']!r} needs a column")
        made = Rule(kind, column, parameters(kind, cells["params"]))
    else:
        made = to_rule(cells["text"] if column is None or column.lower() in cells["text"].lower() else f"{column} {cells['text']}", df)
    action, severity = cells["action"].lower(), cells["severity"].lower()
    if action and ACTION_NAMES.get(action) not in ACTIONS or severity and severity not in SEVERITY:
        raise StepError(f"{cells['action'] or cells['severity']!r} is no action or severity")
    made.on_fail, made.severity = ACTION_NAMES.get(action, made.on_fail), severity or made.severity
    made.green, made.amber = _number(cells["green"], 99.0), _number(cells["amber"], 95.0)
    if not 0 <= made.amber <= made.green <= 100:
        raise StepError("amber may not be above green, nor green above 100")
    made.enabled = cells["enabled"].lower() not in OFF
    made.name = cells["name"] or made.name
    made.id = cells["name"] or made.id
    return name, made


def import_rules(sheet: DataFrame, frames: Mapping[str, DataFrame]) -> list[Imported]:
    """A result for each filled row: frames are the datasets by name. Headings may stand in the column names or in one of the first rows."""
    body = [[(v or "").strip() for v in r] for r in sheet.limit(MOST_ROWS + 1).collect()]
    if len(body) > MOST_ROWS:
        raise StepError(f"a sheet of rules has {MOST_ROWS} rows at most")
    rows = [[c.strip() for c in sheet.columns], *body]
    at, where = _headings(rows)
    out = []
    for n, row in enumerate(rows[at + 1 :], at + 2):
        cells = {f: row[where[f]] if f in where and where[f] < len(row) else "" for f in HEADINGS}
        if any(cells[f] for f in ("column", "type", "text", "sql")):
            try:
                dataset, rule = _rule(cells, frames)
                out.append(Imported(n, rule, dataset))
            except StepError as e:
                out.append(Imported(n, problem=str(e)))
    return out
