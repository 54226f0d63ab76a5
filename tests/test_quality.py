import datetime

import pytest

from millweir.functions.conditions import StepError
from millweir.plans.english import to_rule
from millweir.plans.predicates import Predicate
from millweir.plans.profiling import hints, light_quality, profile, relationships
from millweir.plans.quality import QualityFailure, Rule, enforce, evaluate, split, stamp


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([("5", "2024-01-01", "2024-01-05"), ("40", "2024-02-01", "2024-01-01"), (None, "x", None)], "Age string, Start string, End string")


def test_predicates(df):
    p = Predicate("age between 18 and 120 and to_date(end) >= to_date(start)", df)
    assert sorted(p.columns) == ["Age", "End", "Start"]
    assert [r[0] for r in df.select(p.column).collect()] == [False, False, True]
    for bad in ("SELECT 1", "Age > 1; DELETE FROM t", "Age IN (SELECT 1)", "evil(Age)", "Agee > 1", "1=1; DROP TABLE x", "Age + 1", "", "reflect('java.lang.System', 'exit', 1) = 1", "java_method('a','b') = 'x'"):
        with pytest.raises(StepError):
            Predicate(bad, df)


def test_evaluation_and_routing(df):
    rules = [Rule("not_null", "Age", on_fail="drop"), Rule("range", "Age", {"min": 18}, on_fail="quarantine"), Rule("date", "Start", severity="critical"), Rule("email", "Nope")]
    report = evaluate(df, rules)
    assert report["handling"] == {"quarantined": 1, "dropped": 1, "flagged": 0, "loaded": 1, "fail_rules_triggered": 0}
    assert report["score"] == 66.7 and report["rules"][3]["status"] == "error"
    loaded, quarantined, dropped = split(stamp(df, rules))
    assert [x.count() for x in (loaded, quarantined, dropped)] == [1, 1, 1]
    with pytest.raises(QualityFailure):
        enforce(report, 90)
    assert evaluate(df.limit(0), rules)["score"] == 100.0


@pytest.mark.parametrize(
    ("text", "rule", "sql", "action"),
    [
        ("Age must be unique", "unique", None, "flag"), ("Start is required, otherwise drop the row", "not_null", None, "drop"), ("Age must be between 18 and 120; quarantine the rest", "expression", "(`Age` BETWEEN 18 AND 120)", "quarantine"), ("Age must not exceed 99", "expression", "`Age` <= 99", "flag"),
        ("End must be on or after Start", "expression", "`End` >= `Start`", "flag"), ("Start must not be in the future", "expression", "to_date(`Start`) <= current_date()", "flag"), ("Age must be one of 5, 40 or 60", "in_set", None, "flag"), ("if Age is greater than 18 then End is required", "expression", "NOT (`Age` > 18) OR ((`End` IS NOT NULL AND trim(`End`) <> ''))", "flag"),
        ("Age > 3 and Age < 90", "expression", "Age > 3 and Age < 90", "flag"), ("Start must start with '20'", "expression", "startswith(`Start`, '20')", "flag"),
    ],
)
def test_english(df, text, rule, sql, action):
    r = to_rule(text, df)
    assert (r.rule, r.params.get("sql"), r.on_fail) == (rule, sql, action)


def test_profile(spark):
    rows = [(str(i), f"u{i}@x.org", "+1555123%04d" % i, str(datetime.date(2020, 1, 1 + i % 28)), ["USA", "usa "][i % 2], f"${i}.00") for i in range(50)]
    df = spark.createDataFrame(rows, "cust_id string, mail string, phone string, dob string, country string, amount string")
    p = profile(df.unionByName(df.limit(1)))
    assert {c["column"]: c["semantic_type"] for c in p["columns"]} == {"cust_id": "identifier", "mail": "email", "phone": "phone", "dob": "date_of_birth", "country": "country", "amount": "currency"}
    assert p["duplicate_rows"] == 1 and p["keys"][0]["column"] == "cust_id"
    assert {c["column"] for c in p["columns"] if c["pii"]} == {"mail", "phone", "dob"}
    orders = spark.createDataFrame([("1",), ("1",), (" 2",), ("999",)], "cust_id string")
    found = relationships({"cust": df, "orders": orders}, {"cust": "cust_id"})
    assert [(r["from_dataset"], r["match_pct"], r["orphan_rows"]) for r in found] == [("orders", 66.7, 1)]


def test_names_hint_at_meanings():
    assert hints("Contact-Email") == {"email"} and "phone" in hints("mobileNumber") and hints("custId") == hints("cust_id") == hints("ID") == {"identifier"}
    assert hints("grid_size") == set() and "date_of_birth" in hints("DOB")


def test_light_quality(spark):
    rows = [(f"u{i}@x.org" if i % 5 else "bad", f"+1555123{i:04d}" if i % 2 else f"555-{i:04d}", None if i % 10 == 0 else "2020-01-01") for i in range(100)]
    q = light_quality(spark.createDataFrame([*rows, rows[1]], "mail string, phone string, made string"))
    assert (q["rows"], q["null_cells"], q["duplicates"]) == (101, 10, 1)
    assert q["invalid_by_type"]["email"] == {"invalid": 20, "values": 101, "pct": 19.8} and q["invalid_by_type"]["phone"]["invalid"] == 50
    empty = light_quality(spark.createDataFrame([], "a string"))
    assert empty["rows"] == 0 and empty["null_pct"] == 0.0


def test_sentences():
    from millweir.plans.english import requirement

    columns = ["Age", "Start", "End", "Name"]
    said = {
        "Age should be no more than 5": "`Age` <= 5", "Name must end with x": "endswith(`Name`, 'x')", "Name contains only letters": "(`Name` RLIKE '^[A-Za-z]+$')", "Age must be at least 18 years": "datediff(current_date(), to_date(`Age`)) >= 6574", "Name must have 5 digits": "length(trim(`Name`)) = 5 AND trim(`Name`) RLIKE '^[0-9]+$'",
        "Age cannot be negative": "`Age` >= 0", "Name must not be one of 'a b', c or d": "NOT (lower(trim(`Name`)) IN ('a b', 'c', 'd'))", "Age greater than 1,000.5": "`Age` > 1000.5", "Start must be on or before End": "`Start` <= `End`",
    }
    assert {t: requirement(t, columns)["sql"] for t in said} == said
    for bad in ("nothing here", "Age", "Age must be null", "Age must be between 3"):
        with pytest.raises(StepError):
            requirement(bad, columns)
