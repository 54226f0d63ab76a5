"""Advice from profiles: what is striking, which steps and rules would help, how to load, table and protect data.

A profile (profiling.profile) is a bounded document, so this works on the driver alone. Steps come from a table of observations: each
looks at one column, or at the table, and says which step it calls for. Steps that come out are checked like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millweir.functions import kernels as K
from millweir.operators.registry import ROW_ID
from millweir.operators.scalar import snake
from millweir.plans.profiling import name_words, profile
from millweir.plans.quality import Rule
from millweir.sources.readers import incremental_column

#: What a column's meaning becomes as a type; what protects each kind of personal data.
TYPED = {"integer": "integer", "decimal": "decimal", "currency": "currency", "percentage": "percentage", "boolean": "boolean", "timestamp": "timestamp"}
PROTECTION = {"email": "mask", "phone": "mask", "date_of_birth": "mask", "government_id": "tokenize", "financial": "encrypt"}
#: Rows from which on a table is worth partitioning.
LARGE = 100_000_000


@dataclass(frozen=True)
class Advice:
    step: str
    params: dict
    why: str
    rows: int = 0
    removes_rows: bool = False
    sure: float = 0.9


@dataclass
class Table:
    """A dataset as advice sees it."""

    name: str
    df: DataFrame
    found: dict
    columns: dict[str, dict] = field(init=False)

    def __post_init__(self) -> None:
        self.columns = {m["column"]: m | {"filled": m["rows"] - m["null_count"]} for m in self.found["columns"]}

    def of(self, *meanings: str) -> Iterator[dict]:
        return (m for m in self.columns.values() if m["semantic_type"] in meanings)

    @property
    def key(self) -> dict | None:
        return self.found["keys"][0] if self.found["keys"] else None

    @property
    def nested(self) -> list[str]:
        return [f.name for f in self.df.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]

    @property
    def changed(self) -> str | None:
        """The column that tells when a row changed."""
        return incremental_column(list(self.columns))

    def twins(self) -> list[list[str]]:
        """Columns whose names are the same words."""
        by_words: dict[str, list[str]] = {}
        for name in self.columns:
            by_words.setdefault("".join(name_words(name)), []).append(name)
        return [names for names in by_words.values() if len(names) > 1]


def look(name: str, df: DataFrame) -> Table:
    return Table(name, df, profile(df))


def _share(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


def _untidy(m: dict) -> int:
    return m["whitespace_issues"] + m["all_lower"]


def _spread_country(t: Table) -> str | None:
    return next((m["column"] for m in t.of("country")), None)


#: (meanings, when, what): for a column of such a meaning, the step that an observation calls for.
OF_COLUMNS: list[tuple[tuple[str, ...], Callable[[dict], bool], Callable[[dict, Table], Advice]]] = [
    (("identifier",), lambda m: 0 < _untidy(m) < m["rows"] / 2, lambda m, t: Advice("standardize_codes", {"columns": [m["column"]], "case": "upper"}, "keys in other case or with blanks don't join", _untidy(m))),
    (("phone",), lambda m: len(m["patterns"]) > 2, lambda m, t: Advice("standardize_phone", {"column": m["column"]} | ({"country_column": c} if (c := _spread_country(t)) else {}), f"numbers are written in {len(m['patterns'])} or more ways", m["filled"])),
    (("email",), lambda m: m["invalid_count"] + m["all_upper"] + m["whitespace_issues"] > 0, lambda m, t: Advice("validate_email", {"column": m["column"], "invalid": "null"}, "some addresses can't be right or are spelt otherwise", m["invalid_count"])),
    (("email",), lambda m: _share(m["null_count"], m["rows"]) >= 0.01, lambda m, t: Advice("flag_missing", {"columns": [m["column"]]}, "an address can't be guessed, but its lack can be seen", m["null_count"], sure=0.8)),
    (("date", "date_of_birth"), lambda m: m["type"] == "string", lambda m, t: Advice("parse_date", {"columns": [m["column"]]}, "dates kept as text don't sort", m["filled"])),
    (("country",), lambda m: m["distinct_count"] > len({_country(v) for v, _ in m["top_values"]}), lambda m, t: Advice("standardize_country", {"column": m["column"], "output_format": "name"}, "one country is spelt in several ways", m["filled"])),
    (("category",), lambda m: m["case_variants"] > 0, lambda m, t: Advice("standardize_values", {"column": m["column"], "case": "most_common"}, "values differ by case or blanks alone", m["case_variants"], sure=0.88)),
    (("person_name",), lambda m: _untidy(m) + m["all_upper"] > 0, lambda m, t: Advice("titlecase", {"columns": [m["column"]]}, "names in capitals, in small letters or with blanks", _untidy(m) + m["all_upper"], sure=0.85)),
    (("category",), lambda m: 0.02 <= _share(m["null_count"], m["rows"]) < 0.3, lambda m, t: Advice("smart_impute", {"column": m["column"], "group_by": [c for c in [_spread_country(t)] if c and c != m["column"]]}, "the value most frequent among like rows may fill gaps", m["null_count"], sure=0.7)),
    (("date_of_birth",), lambda m: True, lambda m, t: Advice("calculate_age", {"column": m["column"], "output": "age"}, "an age follows from a date of birth", m["filled"], sure=0.8)),
]


def _country(value: str) -> str:
    row = K.country_names().get(" ".join(value.lower().split()))
    return row[0] if row else value


def _of_table(t: Table) -> Iterator[Advice]:
    for names in t.twins():
        kept = min(names, key=lambda n: t.columns[n]["null_count"])
        yield Advice("schema_evolution_align", {"target": kept, "sources": [n for n in names if n != kept]}, "one field under several names", sure=0.95)
    if t.nested:
        yield Advice("flatten", {"columns": t.nested}, "nested values become columns", sure=0.93)
    if t.key and t.key["duplicates"]:
        keep = {"keep": "latest", "order_by": t.changed} if t.changed else {"keep": "highest_quality"}
        yield Advice("remove_duplicates", {"columns": [t.key["column"]]} | keep, "a key stands for one row", t.key["duplicates"], True, min(0.97, t.key["confidence"]))
    elif t.found["duplicate_rows"]:
        yield Advice("remove_duplicates", {"columns": [], "keep": "first"}, "equal rows count twice", t.found["duplicate_rows"], True, 0.97)
    typed = [{"column": m["column"], "to": TYPED[m["semantic_type"]]} for m in t.of(*TYPED) if m["type"] == "string"]
    if typed:
        yield Advice("convert_types", {"conversions": typed}, "numbers, times and truth values are kept as text")
    blanks = [m["column"] for m in t.columns.values() if m["whitespace_issues"] and m["semantic_type"] not in ("person_name", "email", "identifier")]
    if blanks:
        yield Advice("trim_whitespace", {"columns": blanks}, "outer blanks make equal values differ", sum(t.columns[c]["whitespace_issues"] for c in blanks), sure=0.95)
    if any(snake(c) != c for c in t.df.columns if c != ROW_ID):
        yield Advice("standardize_column_names", {"style": "snake"}, "names in one style", sure=0.8)


def recommend_steps(t: Table) -> list[Advice]:
    """Steps that the profile calls for, in an order in which they can run: the table's shape, its columns, then names."""
    of_table = list(_of_table(t))
    of_columns = [make(m, t) for meanings, when, make in OF_COLUMNS for m in t.of(*meanings) if when(m)]
    # types and names change last, because the other steps name columns and read text
    last = [a for a in of_table if a.step in ("convert_types", "standardize_column_names")]
    return [*(a for a in of_table if a not in last), *of_columns, *last]


def as_steps(advice: list[Advice], dataset: str) -> list[dict]:
    """Advice as steps of a pipeline document."""
    return [{"id": f"{dataset}-{i}", "dataset": dataset, "type": a.step, "params": a.params} for i, a in enumerate(advice, 1)]


#: Rules that a meaning calls for: (meaning, rule, dimension, parameters).
RULES_BY_MEANING = [
    ("email", "email", "validity", {}), ("phone", "phone", "validity", {}), ("country", "in_reference", "consistency", {}), ("date", "date", "validity", {}), ("date_of_birth", "range", "accuracy", {"min": "1900-01-01", "max": "today"}),
]


def recommend_rules(t: Table, found: list[dict] | None = None) -> list[Rule]:
    """Rules of a table by its key, its columns' meanings, and the relationships (profiling.relationships) that start in it."""
    made = []
    if t.key:
        made += [Rule("not_null", t.key["column"], dimension="completeness", on_fail="quarantine"), Rule("unique", t.key["column"], dimension="uniqueness")]
    made += [Rule(rule, m["column"], dict(params), dimension=dimension) for meaning, rule, dimension, params in RULES_BY_MEANING for m in t.of(meaning)]
    return made + [Rule("in_dataset", r["from_column"], {"dataset_id": r["to_dataset"], "column": r["to_column"]}, dimension="referential_integrity") for r in found or [] if r["from_dataset"] == t.name]


def insights(t: Table, found: list[dict] | None = None) -> list[dict]:
    """(severity, what, column, n) of what strikes in a profile, the gravest first."""
    seen: list[tuple[str, str, str | None, int]] = [("info", "rows", None, t.found["rows"])]
    if t.key:
        seen.append(("warning" if t.key["duplicates"] else "success", "key repeats" if t.key["duplicates"] else "key", t.key["column"], t.key["duplicates"]))
    if t.found["duplicate_rows"]:
        seen.append(("warning", "equal rows", None, t.found["duplicate_rows"]))
    for c, m in t.columns.items():
        tests = [("missing", m["null_count"], 0.01 * m["rows"], 0.1 * m["rows"]), ("invalid", m["invalid_count"], 1, 1), ("case variants", m["case_variants"] if m["semantic_type"] in ("category", "boolean", "country") else 0, 1, 10**18), ("personal data", m["filled"] if m["pii"] else 0, 1, 10**18)]
        seen += [("warning" if n >= grave else "info", what, c, n) for what, n, least, grave in tests if n and n >= least]
        if m["type"] == "string" and m["semantic_type"] in ("phone", "date", "date_of_birth") and len(m["patterns"]) > 1:
            seen.append(("warning", "formats", c, len(m["patterns"])))
    seen += [("info", "nested", c, 1) for c in t.nested] + [("warning", "one field under several names", " ".join(names), len(names)) for names in t.twins()]
    seen += [("warning" if r["orphan_rows"] else "success", f"refers to {r['to_dataset']}", r["from_column"], r["orphan_rows"]) for r in found or [] if r["from_dataset"] == t.name]
    order = {"warning": 0, "success": 1, "info": 2}
    return [dict(zip(("severity", "what", "column", "n"), x, strict=True)) for x in sorted(seen, key=lambda x: order[x[0]])]


def plan_loading(t: Table, kind: str = "files") -> dict:
    """How to load a source of such a kind (files, stream, table, api): the engine, and whether a column tells what is new."""
    engine = {"files": "file_stream", "stream": "stream", "table": "jdbc", "api": "pages"}.get(kind, "batch")
    new_only = engine in ("file_stream", "stream") or t.changed is not None
    return {"engine": engine, "mode": "incremental" if new_only else "full", "high_water": t.changed if engine not in ("file_stream", "stream") else None, "unknown_columns": "rescue" if t.nested else "add", "checkpoint": engine in ("file_stream", "stream")}


def plan_tables(tables: list[Table], found: list[dict]) -> list[dict]:
    """Bronze and silver of each dataset, and gold: a row an entity with counts of what refers to it, and summaries by time or category."""
    made = []
    for t in tables:
        silver = snake(t.name)
        cluster = [snake(c) for c in [t.key and t.key["column"], t.changed] if c]
        made += [{"layer": "bronze", "name": f"{silver}_raw", "dataset": t.name}, {"layer": "silver", "name": silver, "dataset": t.name, "key": cluster[:1] if t.key else [], "cluster_by": cluster, "partition_by": cluster[-1:] if t.changed and t.found["rows"] > LARGE else []}]
        children = [r for r in found if r["to_dataset"] == t.name]
        dates = [m["column"] for m in t.of("date", "timestamp")]
        if children and t.key:
            made.append({"layer": "gold", "name": f"{silver}_360", "kind": "entity_360", "dataset": t.name, "key": t.key["column"], "related": [{"dataset": r["from_dataset"], "key": r["from_column"]} for r in children]})
        elif dates:
            made.append({"layer": "gold", "name": f"{silver}_by_month", "kind": "time_summary", "dataset": t.name, "column": dates[0], "unit": "month"})
        else:
            made += [{"layer": "gold", "name": f"{silver}_by_{snake(m['column'])}", "kind": "dimension_summary", "dataset": t.name, "column": m["column"]} for m in list(t.of("category", "country"))[:1]]
    return made


def plan_protection(tables: list[Table]) -> dict:
    """Which columns hold personal data, what protects each, and who reads which layer."""
    fields = [{"dataset": t.name, "column": c, "category": m["pii"]["category"], "sensitivity": m["pii"]["sensitivity"], "protect": PROTECTION.get(m["pii"]["category"], "tag")} for t in tables for c, m in t.columns.items() if m["pii"]]
    return {"fields": fields, "classification": "confidential" if fields else "internal", "read": {"engineers": ["bronze", "silver", "gold"], "analysts": ["silver", "gold"], "users": ["gold"]}}


def document(tables: list[Table], found: list[dict]) -> dict:
    """A pipeline document of all advice, ready for Pipeline and lakehouse.build."""
    return {
        "datasets": {t.name: {} for t in tables}, "steps": [s for t in tables for s in as_steps(recommend_steps(t), t.name)],
        "rules": [{k: v for k, v in asdict(r).items() if k not in ("id", "name")} | {"dataset": t.name} for t in tables for r in recommend_rules(t, found)],
        "gold": [{k: v for k, v in g.items() if k != "layer"} for g in plan_tables(tables, found) if g["layer"] == "gold"],
    }
