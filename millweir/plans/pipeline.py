"""Pipelines: a declarative document of datasets and steps becomes lazy plans; previews, diffs and lineage come from the same document.

{"datasets": {name: {...source}}, "steps": [{"id", "type", "dataset", "params", "enabled"}], "rules": [...], "gold": [...], "targets": [...]}
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millweir.functions import kernels as K
from millweir.functions.conditions import StepError
from millweir.operators import relational, scalar  # noqa: F401 - they register the steps
from millweir.operators.registry import ROW_ID, STEPS, Context, check, run

#: Keys that may not stand anywhere in a document (a pipeline carries no code; the predicates of rules are checked by
#: their own grammar), and the most letters of a text.
FORBIDDEN, MOST_LETTERS = {"code", "sql", "python", "script", "exec", "eval", "command", "notebook", "query_text"}, 2000


def policy_problems(document: object, where: str = "") -> list[str]:
    """Forbidden keys and overlong texts anywhere in a document."""
    if isinstance(document, dict):
        here = [f"{where}/{k}: pipelines carry no code" for k in document if str(k).lower() in FORBIDDEN and not (k == "sql" and re.fullmatch(r"/rules/\d+/params", where))]
        return here + [p for k, v in document.items() for p in policy_problems(v, f"{where}/{k}")]
    if isinstance(document, list):
        return [p for i, v in enumerate(document) for p in policy_problems(v, f"{where}/{i}")]
    return [f"{where}: longer than {MOST_LETTERS} letters"] if isinstance(document, str) and len(document) > MOST_LETTERS else []


@dataclass
class Outcome:
    """A dataset after its steps, and what became of each step."""

    df: DataFrame
    log: list[dict] = field(default_factory=list)


class Pipeline:
    """load: gives a dataset's raw rows. on_error: skip reports a step that can't be built and goes on; raise stops."""

    def __init__(self, document: dict, load: Callable[[str], DataFrame], today: datetime.date | None = None, key: bytes = b"millweir", on_error: str = "skip", order: dict[str, list[str]] | None = None) -> None:
        problems = policy_problems(document)
        if problems:
            raise StepError("; ".join(problems))
        self.document, self.load, self.on_error, self.order = document, load, on_error, order or {}
        self.today, self.key = today or datetime.date.today(), key
        self.done: dict[str, Outcome] = {}
        self.running: list[str] = []

    def steps(self, dataset: str) -> list[dict]:
        return [s for s in self.document.get("steps", []) if s.get("dataset") == dataset and s.get("enabled", True)]

    def context(self, dataset: str) -> Context:
        return Context(dataset=lambda n: self.result(n).df, today=self.today, key=self.key, order=self.order.get(dataset, []))

    def apply(self, df: DataFrame, dataset: str, steps: list[dict]) -> Outcome:
        log = []
        for s in steps:
            try:
                df = run(df, s["type"], s.get("params") or {}, self.context(dataset))
                df.schema  # noqa: B018 - analyses the plan now, so that what can't work shows here
                log.append({"id": s.get("id"), "type": s["type"], "status": "ok"})
            except (StepError, AnalysisException, KeyError, ValueError, TypeError) as e:
                if self.on_error == "raise":
                    raise
                log.append({"id": s.get("id"), "type": s["type"], "status": "failed", "message": str(e).splitlines()[0]})
        return Outcome(df, log)

    def result(self, dataset: str) -> Outcome:
        """A dataset after its own steps; datasets that it joins come after theirs. A cycle is an error."""
        if dataset in self.running:
            raise StepError(f"datasets depend on each other in a circle: {' -> '.join([*self.running, dataset])}")
        if dataset not in self.done:
            self.running.append(dataset)
            try:
                self.done[dataset] = self.apply(self.load(dataset), dataset, self.steps(dataset))
            finally:
                self.running.pop()
        return self.done[dataset]

    def problems(self) -> list[dict]:
        """What is wrong with the steps, without reading any data."""
        found = [{"id": s.get("id"), "message": m} for s in self.document.get("steps", []) for m in check(None, s.get("type", ""), s.get("params") or {})]
        for name in {s.get("dataset") for s in self.document.get("steps", [])}:
            found += [{"id": x["id"], "message": x["message"]} for x in self.result(name).log if x["status"] == "failed"]
        return found

    def stream_unsafe(self, dataset: str) -> list[str]:
        """Steps of a dataset that can't run on a stream."""
        return [s["type"] for s in self.steps(dataset) if not STEPS[s["type"]].stream_safe]

    def preview(self, dataset: str, step_id: str | None = None, draft: dict | None = None, rows: int = 60) -> dict:
        """Rows before and after a step (the last one by default), or after a draft put at the end, and what changed."""
        steps = self.steps(dataset)
        at = next((i for i, s in enumerate(steps) if s.get("id") == step_id), len(steps) - 1) if step_id else len(steps) - 1
        before_steps, after_steps = (steps, [*steps, draft]) if draft else (steps[: max(at, 0)], steps[: at + 1])
        raw = self.load(dataset)
        before, after = self.apply(raw, dataset, before_steps), self.apply(raw, dataset, after_steps)
        aligned = ROW_ID in before.df.columns and ROW_ID in after.df.columns
        return {
            "before": [r.asDict() for r in before.df.drop(ROW_ID).limit(rows).collect()],
            "after": [r.asDict() for r in after.df.drop(ROW_ID).limit(rows).collect()],
            "changes": {r["column"]: r["changed"] for r in changes(before.df, after.df).collect()} if aligned else None,
            "removed": before.df.join(after.df, ROW_ID, "left_anti").count() if aligned else None,
            "log": after.log,
        }


def changes(before: DataFrame, after: DataFrame, key: str = ROW_ID) -> DataFrame:
    """(column, changed): cells that differ as text between rows of the same key, by one join and one aggregate."""
    shared = [c for c in before.columns if c in after.columns and c != key]
    if not shared:
        return before.sparkSession.createDataFrame([], "`column` string, changed long")
    left = before.select(K.col(key).alias("_key"), *[K.text(K.col(c)).alias(f"b{i}") for i, c in enumerate(shared)])
    right = after.select(K.col(key).alias("_key"), *[K.text(K.col(c)).alias(f"a{i}") for i, c in enumerate(shared)])
    sums = left.join(right, "_key").agg(*[F.coalesce(F.sum((~F.col(f"b{i}").eqNullSafe(F.col(f"a{i}"))).cast("long")), F.lit(0)).alias(f"n{i}") for i in range(len(shared))])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("changed")) for i, c in enumerate(shared)]))).where("changed > 0")


def lineage(document: dict) -> dict:
    """Nodes and edges from sources over raw, bronze, steps, silver and gold to dashboards."""
    nodes, edges = [], []

    def node(kind: str, name: str, label: str) -> str:
        ident = f"{kind}:{name}"
        if ident not in {n["id"] for n in nodes}:
            nodes.append({"id": ident, "type": kind, "label": label})
        return ident

    def edge(a: str, b: str) -> None:
        if {"from": a, "to": b} not in edges:
            edges.append({"from": a, "to": b})

    for name, source in document.get("datasets", {}).items():
        at = node("source", source.get("source", name), source.get("source", name))
        for kind in ("raw", "bronze"):
            new = node(kind, name, name)
            edge(at, new)
            at = new
        for i, s in enumerate(x for x in document.get("steps", []) if x.get("dataset") == name and x.get("enabled", True)):
            new = node("transformation", s.get("id") or f"{name}:{i}", s["type"].replace("_", " "))
            edge(at, new)
            params = s.get("params") or {}
            for other in [params.get("right_dataset"), *(params.get("datasets") or [])]:
                if other in document.get("datasets", {}):
                    edge(node("silver", other, other), new)
            at = new
        edge(at, node("silver", name, name))
    for g in document.get("gold", []):
        gold = node("gold", g["name"], g["name"])
        for name in [g["dataset"], *(t["dataset"] for t in g.get("related", []))]:
            edge(node("silver", name, name), gold)
        edge(gold, node("dashboard", g["name"], f"{g['name']} dashboard"))
    return {"nodes": nodes, "edges": edges}
