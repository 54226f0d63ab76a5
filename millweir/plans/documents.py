"""Documents over time: versions with undo, templates for other tables, and whether a document is ready to run."""

from __future__ import annotations

import copy
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from millweir.functions.conditions import StepError
from millweir.operators.registry import STEPS, check
from millweir.operators.scalar import snake
from millweir.plans.pipeline import Pipeline, policy_problems
from millweir.plans.quality import Rule, results


@dataclass
class Versions:
    """A document and its versions. A change after an undo drops what was undone."""

    document: dict
    past: list[dict] = field(default_factory=list)
    undone: list[dict] = field(default_factory=list)

    def change(self, make: Callable[[dict], None]) -> dict:
        """A new version, which make() alters; one that the policy refuses isn't kept."""
        new = copy.deepcopy(self.document)
        make(new)
        if problems := policy_problems(new):
            raise StepError("; ".join(problems))
        self.past.append(self.document)
        self.document, self.undone = new, []
        return new

    def undo(self) -> dict:
        return self._move(self.past, self.undone)

    def redo(self) -> dict:
        return self._move(self.undone, self.past)

    def _move(self, source: list[dict], target: list[dict]) -> dict:
        if source:
            target.append(self.document)
            self.document = source.pop()
        return self.document


def template(document: dict) -> list[dict]:
    """The steps of a document that can be used for other tables: enabled ones of a single dataset."""
    kept = (s for s in document.get("steps", []) if s.get("enabled", True) and not STEPS[s["type"]].several_datasets)
    return [{"type": s["type"], "params": copy.deepcopy(s.get("params") or {})} for s in kept]


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", snake(name))


def bind(steps: list[dict], df: DataFrame, dataset: str) -> tuple[list[dict], list[dict]]:
    """(steps for a table, steps that don't fit it): columns are found by name, whatever its case and signs.

    A step fits if all columns that it must have are there; of a list of columns those that are there are taken. Steps see the columns
    that the steps before them leave.
    """
    known = {_plain(c): c for c in df.columns}
    fitting, others = [], []
    for s in steps:
        params, whole = dict(s["params"]), True
        for p in STEPS[s["type"]].params:
            value = params.get(p.name)
            if p.kind == "column" and value:
                params[p.name] = known.get(_plain(value))
                whole = whole and (params[p.name] is not None or not p.required)
            elif p.kind == "columns" and value:
                params[p.name] = [known[_plain(c)] for c in value if _plain(c) in known]
                whole = whole and bool(params[p.name])
        params = {k: v for k, v in params.items() if v is not None}
        if whole and not check(df, s["type"], params):
            fitting.append({"id": f"{dataset}-t{len(fitting) + 1}", "dataset": dataset, "type": s["type"], "params": params})
        else:
            others.append(s)
    return fitting, others


@dataclass(frozen=True)
class Check:
    what: str
    state: str
    problems: tuple[str, ...] = ()


def _problems(pipeline: Pipeline) -> Iterator[tuple[str, str, list[str]]]:
    """(what is looked at, how grave a problem is, problems)."""
    doc = pipeline.document
    datasets = list(doc.get("datasets", {}))
    yield "datasets", "fail", [] if datasets else ["there are none"]
    unread, columns = [], {}
    for d in datasets:
        try:
            columns[d] = pipeline.load(d).columns
        except Exception as e:  # noqa: BLE001 - sources raise errors of their own
            unread.append(f"{d}: {str(e).splitlines()[0]}")
    yield "sources", "fail", unread
    readable = [d for d in datasets if d in columns]
    yield "steps", "fail", [f"{d}: {x['type']} {x.get('message', '')}" for d in readable for x in pipeline.result(d).log if x["status"] == "failed"]
    rules = doc.get("rules", [])
    yield "rules cover the datasets", "warn", [d for d in datasets if d not in {r.get("dataset") for r in rules if r.get("enabled", True)}]
    broken = []
    for d in readable:
        made = [Rule(**{k: v for k, v in r.items() if k != "dataset"}) for r in rules if r.get("dataset") == d]
        found = results(pipeline.result(d).df.limit(0), made, lambda n: pipeline.result(n).df)
        broken += [f"{d}: {r["name"]} {r["message"]}" for r in found.where("status = 'error'").collect()]
    yield "rules", "fail", broken
    gold = doc.get("gold", [])
    names = [snake(d) for d in datasets] + [g["name"] for g in gold]
    yield "table names", "fail", [n for n in names if not re.fullmatch(r"[a-z_]\w*", n)] + sorted({n for n in names if names.count(n) > 1})
    used = [(g["name"], d) for g in gold for d in [g["dataset"], *(r["dataset"] for r in g.get("related", []))]]
    yield "gold", "fail", [f"{n} reads {d}" for n, d in used if d not in datasets]
    yield "targets", "warn", [] if doc.get("targets") else ["nothing is published"]
    yield "targets", "fail", [f"{t.get('path', '?')}: a merge needs keys" for t in doc.get("targets", []) if t.get("mode") == "merge" and not t.get("keys")]


def readiness(pipeline: Pipeline) -> list[Check]:
    """Whether a document can run: pass, warn or fail for each thing looked at. Plans are built and rules checked on no rows."""
    found: dict[str, Check] = {}
    for what, grave, problems in _problems(pipeline):
        new = Check(what, grave if problems else "pass", tuple(problems))
        old = found.get(what)
        found[what] = new if old is None or old.state == "pass" or new.state == "fail" else old
    return list(found.values())
