"""Advice from profiles, rules from sheets, discovery of databases, anomalies by hour and by rule."""

import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from millweir.functions.conditions import StepError
from millweir.plans import advice
from millweir.plans.documents import Versions, bind, readiness, template
from millweir.plans.lakehouse import build
from millweir.plans.monitor import anomalies, rule_anomalies
from millweir.plans.pipeline import Pipeline
from millweir.plans.profiling import relationships
from millweir.plans.rule_import import import_rules, parameters
from millweir.sources.discovery import discover
from millweir.sources.readers import read_file, read_table
from millweir.sources.writers import write_table


@pytest.fixture(scope="module")
def frames(spark):
    people = [(str(i), f"U{i}@X.ORG" if i % 3 else "n/a", [f"(555) 123-{i:04d}", f"555.123.{i:04d}", f"+1555123{i:04d}"][i % 3], f"{1 + i % 12:02d}/{1 + i % 28:02d}/1980", ["USA", "u.s.a.", "Germany"][i % 3], ["retail", "Retail ", None, "fleet", "Fleet"][i % 5], f"${i}.50", "ann LEE ") for i in range(60)]
    cust = spark.createDataFrame([*people, people[0]], "cust_id string, email string, phone string, birth_date string, country string, segment string, Amount string, full_name string")
    orders = spark.createDataFrame([(str(i), str(i % 50), "2024-01-%02d" % (1 + i % 28), (i, "x")) for i in range(200)], "order_id string, cust_id string, updated_at string, item struct<n: int, kind: string>")
    return {"cust": cust, "orders": orders}


def test_advice_runs_as_a_pipeline(frames, spark):
    tables = [advice.look(n, df) for n, df in frames.items()]
    found = relationships(frames, {"cust": "cust_id"})
    made = {a.step: a for a in advice.recommend_steps(tables[0])}
    assert {"remove_duplicates", "standardize_phone", "validate_email", "parse_date", "standardize_country", "standardize_values", "titlecase", "smart_impute", "convert_types", "standardize_column_names", "calculate_age"} <= set(made)
    assert made["standardize_phone"].params == {"column": "phone", "country_column": "country"} and made["remove_duplicates"].rows == 1
    assert [a.step for a in advice.recommend_steps(tables[1])][0] == "flatten"
    assert {(r.rule, r.column) for r in advice.recommend_rules(tables[1], found)} >= {("not_null", "order_id"), ("unique", "order_id"), ("in_dataset", "cust_id")}
    assert {x["what"] for x in advice.insights(tables[0], found)} >= {"key repeats", "equal rows", "invalid", "formats", "personal data"}
    assert advice.plan_loading(tables[1], "table") == {"engine": "jdbc", "mode": "incremental", "high_water": "updated_at", "unknown_columns": "rescue", "checkpoint": False}
    assert {f["column"]: f["protect"] for f in advice.plan_protection(tables)["fields"]}["email"] == "mask"
    doc = advice.document(tables, found)
    order = {"cust": ["cust_id"], "orders": ["order_id"]}
    p = Pipeline(doc, frames.__getitem__, datetime.date(2024, 6, 30), order=order)
    assert {s["type"] for s in doc["steps"] if s["dataset"] == "cust"} == set(made) and len(doc["steps"]) == 14
    assert not p.problems() and all(s["status"] == "ok" for n in frames for s in p.result(n).log)
    gold = build(Pipeline(doc, frames.__getitem__, datetime.date(2024, 6, 30), order=order)).gold["cust_360"]
    assert gold.count() == 60 and gold.agg(F.sum("orders_count")).first()[0] == 200


def test_advice_on_an_empty_table(spark):
    t = advice.look("none", spark.createDataFrame([], "a string, b int"))
    assert advice.recommend_rules(t) == [] and [a.step for a in advice.recommend_steps(t)] == [] and advice.insights(t)[0]["n"] == 0


def test_rules_from_a_sheet(spark, tmp_path, frames):
    rows = [("Our rules", "", "", "", "", ""), ("Rule name", "Column", "Rule type", "Parameters", "On failure", "Severity"), ("mails", "E-Mail", "email", "", "Quarantine", "High"), ("", "amount", "range", "min=0; max=50", "drop", ""), ("", "segment", "in set", "retail, fleet", "", ""),
            ("", "nope", "email", "", "", ""), ("", "phone", "odd", "", "", ""), ("", "phone", "phone", "", "explode", ""), ("", "", "", "", "", "")]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = "".join(f"<row>{''.join(f'<c r={chr(34)}{chr(65 + j)}{i + 1}{chr(34)} t={chr(34)}inlineStr{chr(34)}><is><t>{v}</t></is></c>' for j, v in enumerate(r))}</row>" for i, r in enumerate(rows))
    with zipfile.ZipFile(tmp_path / "r.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    found = import_rules(read_file(spark, str(tmp_path / "r.xlsx")), frames)
    good = [f.rule for f in found if f.rule]
    assert [(r.rule, r.column, r.on_fail, r.severity) for r in good] == [("email", "email", "quarantine", "high"), ("range", "Amount", "drop", "medium"), ("in_set", "segment", "flag", "medium")]
    assert good[1].params == {"min": 0.0, "max": 50.0} and good[2].params == {"values": ["retail", "fleet"]} and len([f for f in found if f.problem]) == 3
    text = spark.createDataFrame([("orders", "order_id must be unique", None, "98"), (None, None, "Amount is not null", "x"), (None, None, "evil(1)", None)], "Dataset string, Description string, SQL string, `Green %` string")
    found = import_rules(text, frames)
    assert (found[0].dataset, found[0].rule.rule, found[0].rule.green) == ("orders", "unique", 98.0) and not found[1].rule and not found[2].rule
    with pytest.raises(StepError):
        import_rules(spark.createDataFrame([("a",)], "x string"), frames)
    assert parameters("regex", "pattern=^a=b$") == {"pattern": "^a=b$"} and parameters("min_length", "length=3") == {"length": 3}


def test_discovery_of_a_database(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    jvm = spark.sparkContext._jvm
    jvm.org.apache.spark.util.Utils.classForName(driver, True, False)
    connection = jvm.java.sql.DriverManager.getConnection(url)
    for sql in ("create table parent (id int not null primary key, updated_at timestamp)", "create table child (k int not null, p int references parent (id), v varchar(20), primary key (k))", "insert into parent (id) values (1), (2)"):
        connection.createStatement().execute(sql)
    connection.close()
    write_table(spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, 1, "c")], "k int, p int, v string"), url, "child", driver=driver)
    found = {t.name: t for t in discover(spark, url, "APP", driver=driver)}
    assert set(found) == {"PARENT", "CHILD"} and (found["PARENT"].rows, found["CHILD"].rows) == (2, 3)
    assert found["PARENT"].primary_key == ["ID"] and found["PARENT"].incremental == "UPDATED_AT"
    assert found["CHILD"].foreign_keys == [{"column": "P", "table": "PARENT", "references": "ID"}] and [c["nullable"] for c in found["CHILD"].columns] == [False, True, True]
    rows = read_table(spark, url, "child", "k", (1, 3), 2, driver=driver)
    assert sorted((r.K, r.V) for r in rows.collect()) == [("1", "a"), ("2", "b"), ("3", "c")]


def test_anomalies_against_the_same_hour(spark):
    """Busy days and quiet nights: a quiet noon is odd though half of all runs are quiet, once five noons are known."""
    rows = []
    for day in range(1, 12):
        for hour, n in ((3, 10), (12, 1000)):
            rows.append(("p", day * 100 + hour, datetime.datetime(2024, 1, day, hour), "succeeded", 10 if (day, hour) == (11, 12) else n + day % 3, 99.0, 5.0, 1.0, "h", 0))
    runs = spark.createDataFrame(rows, "pipeline string, run_id int, started_at timestamp, status string, records long, quality double, duration double, cost double, schema_hash string, failed long")
    assert [(r.run_id, r.kind) for r in anomalies(runs).where("run_id > 600").collect()] == [(1112, "volume_drop")]
    results = runs.select("pipeline", "run_id", "started_at", F.lit("r").alias("rule_id"), F.when(F.col("run_id") == 1112, 500).otherwise(F.col("run_id") % 4).alias("failed"), F.lit("red").alias("rag"))
    assert [r.run_id for r in rule_anomalies(results).collect()] == [1112]


def test_versions_templates_and_readiness(spark, frames):
    versions = Versions({"datasets": {"cust": {}}, "steps": []})
    steps = [{"id": "1", "dataset": "cust", "type": "titlecase", "params": {"columns": ["full_name", "nickname"]}}, {"id": "2", "dataset": "cust", "type": "validate_email", "params": {"column": "email"}}, {"id": "3", "dataset": "cust", "type": "union", "params": {"datasets": ["x"]}}]
    versions.change(lambda d: d["steps"].extend(steps))
    versions.change(lambda d: d["steps"].pop(0))
    assert len(versions.document["steps"]) == 2 and len(versions.undo()["steps"]) == 3 and len(versions.redo()["steps"]) == 2 and versions.redo() is versions.document
    with pytest.raises(StepError):
        versions.change(lambda d: d.update(code="x"))
    versions.undo()
    other = spark.createDataFrame([("ann lee", "x")], "`Full Name` string, mail string")
    fitting, rest = bind(template(versions.document), other, "people")
    assert [(s["type"], s["params"]) for s in fitting] == [("titlecase", {"columns": ["Full Name"]})] and [s["type"] for s in rest] == ["validate_email"]
    doc = {"datasets": {"cust": {}, "orders": {}, "gone": {}}, "steps": [{"id": "1", "dataset": "cust", "type": "uppercase", "params": {"columns": ["nope"]}}], "rules": [{"dataset": "cust", "rule": "email", "column": "email"}, {"dataset": "orders", "rule": "email", "column": "none"}], "gold": [{"name": "g", "kind": "entity_360", "dataset": "nowhere"}], "targets": [{"path": "/x", "mode": "merge"}]}
    state = {c.what: c.state for c in readiness(Pipeline(doc, frames.__getitem__, order={"cust": ["cust_id"]}))}
    assert state == {"datasets": "pass", "sources": "fail", "steps": "fail", "rules cover the datasets": "warn", "rules": "fail", "table names": "pass", "gold": "fail", "targets": "fail"}
    assert {c.state for c in readiness(Pipeline({"datasets": {"cust": {}}, "rules": doc["rules"][:1]}, frames.__getitem__))} == {"pass", "warn"}
