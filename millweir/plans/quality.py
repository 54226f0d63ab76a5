"""Quality rules: evaluated in one pass, stamped on rows, and routed to loaded, quarantined and dropped rows."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millweir.functions import kernels as K
from millweir.functions.conditions import StepError
from millweir.operators.relational import null_safe_join
from millweir.operators.scalar import snake
from millweir.plans.predicates import Predicate
from millweir.skew import spread_join

RULES = ["not_null", "unique", "email", "phone", "date", "range", "in_set", "in_reference", "in_dataset", "regex", "min_length", "expression"]
SEVERITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}
RESULT_COLUMNS = [*((c, "string") for c in ("rule_id", "name", "column", "dimension", "severity", "action")), ("failed", "long"), ("pass_rate", "double"), ("rag", "string"), ("status", "string"), ("message", "string")]
ACTIONS = {"flag": 1, "quarantine": 2, "drop": 3, "fail": 4}


class QualityFailure(RuntimeError):
    """A rule whose action is fail was broken, or the score fell below the least that a run may have."""


@dataclass
class Rule:
    rule: str
    column: str | None = None
    params: dict = field(default_factory=dict)
    id: str = ""
    name: str = ""
    dimension: str = "validity"
    severity: str = "medium"
    on_fail: str = "flag"
    green: float = 99.0
    amber: float = 95.0
    enabled: bool = True

    def __post_init__(self) -> None:
        self.on_fail = {"warn": "flag"}.get(self.on_fail, self.on_fail)
        self.name = self.name or f"{self.column or 'row'}: {self.rule.replace('_', ' ')}"
        self.id = self.id or self.name


def _membership(df: DataFrame, keys: DataFrame, column: str, made: Column, flag: str) -> DataFrame:
    """df with a flag whether its key is among the distinct keys; one key, null as well, may hold a large share of df."""
    there = keys.select(made.alias("_key2")).where("_key2 is not null").distinct().withColumn(flag, F.lit(True))
    return spread_join(df.withColumn("_key", F.upper(K.strip(K.col(column)))), there, [(F.col("_key"), F.col("_key2"))], nulls_match=False).drop("_key", "_key2")


def passes(df: DataFrame, rules: list[Rule], load: Callable[[str], DataFrame] | None = None, today: datetime.date | None = None) -> tuple[DataFrame, list[tuple[Rule, Column | None, str]]]:
    """(df with what the rules need joined to it, a true/false column for each rule or why there is none). Blanks pass all but not_null."""
    made: list[tuple[Rule, Column | None, str]] = []
    wide = df
    # the costly reading of dates is shared by the rules of a column
    dated = {r.column for r in rules if r.enabled and r.column in df.columns and (r.rule == "date" or r.rule == "range" and _of_dates(r))}
    wide = wide.withColumns({f"_date{i}": K.as_date(K.col(c), df.schema[c].dataType) for i, c in enumerate(sorted(dated))})
    as_date = {c: F.col(f"_date{i}") for i, c in enumerate(sorted(dated))}
    for i, r in enumerate(x for x in rules if x.enabled):
        if r.column and r.column not in df.columns:
            made.append((r, None, f"the column {r.column!r} isn't in the output"))
            continue
        try:
            c = K.col(r.column) if r.column else None
            p, flag = r.params or {}, f"_rule{i}"
            if r.rule == "expression":
                good = Predicate(p.get("sql") or "true", df, today).column
            elif r.rule == "not_null":
                good = ~K.blank(c)
            elif r.rule == "unique":
                several = df.groupBy(c).agg(F.count(F.lit(1)).alias(flag)).where(f"{flag} > 1")
                wide = null_safe_join(wide, several, [r.column])
                good = F.col(flag).isNull()
            elif r.rule == "email":
                good = K.strip(c).rlike(K.EMAIL)
            elif r.rule == "phone":
                good = F.length(F.regexp_replace(K.strip(c), r"\D", "")).between(7, 15)
            elif r.rule == "date":
                good = as_date[r.column].isNotNull()
            elif r.rule == "range":
                good = _in_range(df, r, today, as_date.get(r.column))
            elif r.rule == "in_set":
                good = K.key(c).isin([str(v).strip().lower() for v in p.get("values") or []])
            elif r.rule == "in_reference":
                good = K.country(c).isNotNull()
            elif r.rule == "in_dataset":
                other = load(p["dataset_id"]) if load else None
                name = next((n for n in (p["column"], snake(p["column"])) if other is not None and n in other.columns), None)
                if name is None:
                    good = F.lit(True)
                else:
                    wide = _membership(wide, other, r.column, F.upper(K.strip(K.col(name))), flag)
                    good = F.col(flag).isNotNull()
            elif r.rule == "regex":
                good = K.strip(c).rlike("(?U)" + (p.get("pattern") or ".*"))
            elif r.rule == "min_length":
                good = F.char_length(K.strip(c)) >= int(p.get("length") or 1)
            else:
                raise StepError(f"there is no rule {r.rule!r}")
            if r.rule not in ("expression", "not_null"):
                good = K.blank(c) | good
            made.append((r, F.coalesce(good, F.lit(True)), ""))
        except (StepError, KeyError) as e:
            made.append((r, None, str(e)))
    return wide, made


def _of_dates(r: Rule) -> bool:
    return any(isinstance(x, str) and (x == "today" or x[:4].isdigit() and "-" in x) for x in ((r.params or {}).get("min"), (r.params or {}).get("max")))


def _in_range(df: DataFrame, r: Rule, today: datetime.date | None, as_date: Column | None) -> Column:
    low, high = ((r.params or {}).get(k) for k in ("min", "max"))
    kind = df.schema[r.column].dataType
    if as_date is not None and _of_dates(r):
        v = as_date
        day = lambda x: (F.lit(today) if today else F.current_date()) if x == "today" else F.lit(datetime.date.fromisoformat(x))
    else:
        v, day = K.as_number(K.col(r.column), kind), lambda x: F.lit(float(x))
    parts = [v >= day(low)] if low not in (None, "") else []
    parts += [v <= day(high)] if high not in (None, "") else []
    return F.coalesce(K.all_of(parts), F.lit(True)) if parts else F.lit(True)


def stamp(df: DataFrame, rules: list[Rule], load: Callable[[str], DataFrame] | None = None, today: datetime.date | None = None) -> DataFrame:
    """df with _dq_issues (names of broken rules), _dq_action (the strictest) and _dq_status."""
    wide, made = passes(df, rules, load, today)
    known = [(r, c) for r, c, _ in made if c is not None]
    issues = F.filter(F.array(*[F.when(~c, F.lit(r.name)) for r, c in known]), lambda x: x.isNotNull()) if known else F.array().cast("array<string>")
    rank = F.greatest(F.lit(0), *[F.when(~c, F.lit(ACTIONS[r.on_fail])).otherwise(0) for r, c in known]) if known else F.lit(0)
    action = K.lookup(F.col("_rank"), {v: k for k, v in ACTIONS.items()})
    full = wide.withColumn("_dq_issues", issues).withColumn("_rank", rank)
    return full.withColumn("_dq_action", action).withColumn("_dq_status", F.when(F.col("_rank") == 0, "PASSED").otherwise("FAILED")).select(*map(K.col, df.columns), "_dq_issues", "_dq_action", "_dq_status")


def split(stamped: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(loaded, quarantined, dropped) of stamped rows; flagged and failing rows are loaded, a failing rule stops the run elsewhere."""
    action = F.coalesce("_dq_action", F.lit(""))
    return stamped.where(~action.isin("quarantine", "drop")), stamped.where(action == "quarantine"), stamped.where(action == "drop")


Passed = tuple[DataFrame, list[tuple[Rule, Column | None, str]]]


def measure(df: DataFrame, rules: list[Rule], load: Callable[[str], DataFrame] | None = None, today: datetime.date | None = None) -> DataFrame:
    """One row: rows, failures by rule (f0, f1, ...), failing rows, and rows by their strictest action. One pass over the data."""
    return _measured(passes(df, rules, load, today))


def _measured(passed: Passed) -> DataFrame:
    wide, made = passed
    known = [(i, r, c) for i, (r, c, _) in enumerate(made) if c is not None]
    marks = wide.select(*[(~c).alias(f"f{i}") for i, _, c in known]) if known else wide.select(F.lit(False).alias("f"))
    worst = {a: K.any_of([F.col(f"f{i}") for i, r, _ in known if r.on_fail == a] or [F.lit(False)]) for a in ACTIONS}
    any_failed = K.any_of(list(worst.values()))
    total = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    return marks.agg(
        F.count(F.lit(1)).alias("records"), *[total(F.col(f"f{i}"), f"f{i}") for i, _, _ in known], total(any_failed, "failing"), total(worst["drop"], "dropped"),
        total(worst["quarantine"] & ~worst["drop"], "quarantined"), total(worst["flag"] & ~worst["quarantine"] & ~worst["drop"], "flagged"), total(worst["quarantine"] | worst["drop"], "kept_out"),
    )


def results(df: DataFrame, rules: list[Rule], load: Callable[[str], DataFrame] | None = None, today: datetime.date | None = None) -> DataFrame:
    """A row for each rule, as a lazy DataFrame: failures, pass rate and colour."""
    passed = passes(df, rules, load, today)
    return _results(_measured(passed), passed[1])


def _results(one: DataFrame, made: list[tuple[Rule, Column | None, str]]) -> DataFrame:
    rows = []
    for i, (r, c, problem) in enumerate(made):
        failed = F.col(f"f{i}") if c is not None else F.lit(None).cast("long")
        rate = F.when(F.col("records") > 0, F.round((1 - failed / F.col("records")) * 100, 2)).otherwise(100.0) if c is not None else F.lit(None).cast("double")
        colour = F.when(rate >= r.green, "green").when(rate >= r.amber, "amber").otherwise("red")
        status = F.lit("error") if c is None else F.when(failed == 0, "passed").otherwise("failed")
        rows.append(F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("name"), F.lit(r.column).cast("string").alias("column"), F.lit(r.dimension).alias("dimension"), F.lit(r.severity).alias("severity"), F.lit(r.on_fail).alias("action"), failed.alias("failed"), rate.alias("pass_rate"), colour.alias("rag"), status.alias("status"), F.lit(problem).alias("message")))
    if not rows:
        return one.where("false").select(*[F.lit(None).cast(t).alias(c) for c, t in RESULT_COLUMNS])
    return one.select(F.inline(F.array(*rows)))


def dimensions(found: DataFrame) -> DataFrame:
    """(dimension, n_rules, pass_rate) of results: the mean of the rules that could be checked."""
    return found.where("status <> 'error'").groupBy("dimension").agg(F.count(F.lit(1)).alias("n_rules"), F.round(F.avg("pass_rate"), 1).alias("pass_rate"))


def scores(found: DataFrame) -> DataFrame:
    """One row of results: the score (pass rates weighted by severity, null without a rule that could be checked), failures, and rules by colour."""
    checked = F.col("status") != "error"
    weight = F.when(checked, F.coalesce(K.lookup(F.col("severity"), SEVERITY), F.lit(SEVERITY["medium"])))
    colours = [F.count(F.when(F.col("rag") == c, 1)).alias(c) for c in ("green", "amber", "red")]
    return found.agg(F.round(F.try_divide(F.sum(F.col("pass_rate") * weight), F.sum(weight)), 1).alias("score"), F.coalesce(F.sum("failed"), F.lit(0)).alias("issues"), *colours)


def broken_values(df: DataFrame, rules: list[Rule], load: Callable[[str], DataFrame] | None = None, today: datetime.date | None = None, examples: int = 5) -> DataFrame:
    """(place, examples): up to so many values that break each rule of a column, the least of each hash bucket, from one pass."""
    return _broken(passes(df, rules, load, today), examples)


def _broken(passed: Passed, examples: int) -> DataFrame:
    wide, made = passed
    marks = [F.struct(F.lit(i).alias("place"), F.when(~c, K.text(K.col(r.column))).alias("value")) for i, (r, c, _) in enumerate(made) if c is not None and r.column]
    if not marks:
        return wide.sparkSession.createDataFrame([], "place int, examples array<string>")
    values = wide.select(F.inline(F.array(*marks))).where("value is not null")
    some = values.groupBy("place", F.pmod(F.xxhash64("value"), F.lit(examples)).alias("bucket")).agg(F.min("value").alias("value"))
    return some.groupBy("place").agg(F.array_sort(F.collect_list("value")).alias("examples"))


def evaluate(df: DataFrame, rules: list[Rule], load: Callable[[str], DataFrame] | None = None, today: datetime.date | None = None, examples: int = 5) -> dict:
    """The report of a table: its results, dimensions, scores and broken values as a document, from one pass for the counts and one for
    the values where rules are broken. The driver gets a row a rule."""
    passed = passes(df, rules, load, today)
    spark, measured = df.sparkSession, _measured(passed)
    counts = measured.first()
    found = _results(spark.createDataFrame([counts], measured.schema), passed[1])
    rows = [r.asDict() for r in found.collect()]
    total = scores(found).first()
    shown = {r.place: r.examples for r in _broken(passed, examples).collect()} if total.issues else {}
    for place, row in enumerate(rows):
        row["examples"] = shown.get(place, [])
    handled = {what: counts[what] for what in ("quarantined", "dropped", "flagged")}
    return {
        "score": total.score, "issues": total.issues, "rag": {c: total[c] for c in ("green", "amber", "red")}, "dimensions": {r.dimension: r.pass_rate for r in dimensions(found).collect()}, "rules": rows,
        "records": counts.records, "failing_records": counts.failing, "handling": handled | {"loaded": counts.records - counts.kept_out, "fail_rules_triggered": sum(bool(r["failed"]) for r in rows if r["action"] == "fail")},
    }


def enforce(report: dict, least_score: float | None = None) -> None:
    """Raise QualityFailure if a failing rule was broken or the score is too low."""
    broken = [r["name"] for r in report["rules"] if r["action"] == "fail" and r.get("failed")]
    if broken:
        raise QualityFailure(f"broken: {', '.join(broken)}")
    if least_score is not None and report["score"] is not None and report["score"] < least_score:
        raise QualityFailure(f"the score {report['score']} is below {least_score}")


