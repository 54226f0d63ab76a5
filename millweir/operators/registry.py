"""The registry of transformation steps: their parameters, what they change, and their validation."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from millweir.functions.conditions import StepError

ROW_ID = "__row_id"


@dataclass
class Context:
    """What steps need besides their data. dataset: another dataset after its own steps; order: columns that give the row order
    where there is no __row_id; key: the secret of hashes, tokens and encryption."""

    dataset: Callable[[str], DataFrame] | None = None
    today: datetime.date = field(default_factory=datetime.date.today)
    key: bytes = b"millweir"
    order: list[str] = field(default_factory=list)

    def other(self, name: str | None) -> DataFrame:
        if self.dataset is None or not name:
            raise StepError(f"there is no dataset {name!r}")
        return self.dataset(name)


@dataclass(frozen=True)
class Param:
    name: str
    kind: str
    required: bool = False
    default: object = None
    choices: tuple = ()


@dataclass(frozen=True)
class Step:
    name: str
    category: str
    build: Callable[[DataFrame, dict, Context], DataFrame]
    params: tuple[Param, ...]
    keeps_rows: bool
    destructive: bool
    several_datasets: bool
    stream_safe: bool

    @property
    def label(self) -> str:
        return self.name.replace("_", " ").capitalize()


STEPS: dict[str, Step] = {}


def _param(text: str) -> Param:
    """From "name*:kind=default" or "name:one|two|three=default"."""
    head, _, default = text.partition("=")
    name, _, kind = head.partition(":")
    choices = tuple(kind.split("|")) if "|" in kind else ()
    value = {"True": True, "False": False}.get(default, default if default != "" else None)
    if kind == "number" and value is not None:
        value = float(default) if "." in default else int(default)
    if kind == "columns" and isinstance(value, str):
        value = value.split("|")
    return Param(name.rstrip("*"), "select" if choices else kind or "text", name.endswith("*"), value, choices)


def step(name: str, category: str, params: str = "", *, flags: str = "", stream: bool = False):  # noqa: ANN201
    """Register a step. params: blank-separated parameters; flags: D destructive, R changes rows, M several datasets."""

    def add(build):  # noqa: ANN001, ANN202
        STEPS[name] = Step(name, category, build, tuple(map(_param, params.split())), "R" not in flags, "D" in flags, "M" in flags, stream)
        return build

    return add


def check(df: DataFrame | None, name: str, params: dict) -> list[str]:
    """What is wrong with a step's parameters; with a DataFrame, whether its columns exist as well."""
    spec = STEPS.get(name)
    if not spec:
        return [f"there is no step {name!r}"]
    problems = []
    for p in spec.params:
        value = params.get(p.name)
        if p.required and value in (None, "", [], {}):
            problems.append(f"{name} needs {p.name}")
        elif p.choices and value not in (None, "") and str(value) not in p.choices:
            problems.append(f"{p.name} must be one of {', '.join(p.choices)}, not {value!r}")
        elif df is not None and p.kind in ("column", "columns") and value and not p.name.startswith("right"):
            names = value if isinstance(value, list) else [value]
            problems += [f"there is no column {c!r}" for c in names if c not in df.columns]
    return problems


def run(df: DataFrame, name: str, params: dict, context: Context) -> DataFrame:
    """df after one step; raises StepError if the step can't be built."""
    problems = check(df, name, params)
    if problems:
        raise StepError("; ".join(problems))
    spec = STEPS[name]
    full = {p.name: p.default for p in spec.params} | {k: v for k, v in params.items() if v is not None}
    return spec.build(df, full, context)
