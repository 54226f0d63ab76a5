import datetime

import pytest

from millweir.functions import kernels as K
from millweir.functions.conditions import StepError
from millweir.functions.formulas import describe, validate
from millweir.operators.ordering import exact_quantiles, with_row_id
from millweir.operators.registry import STEPS, Context, check, run
from millweir.plans.pipeline import Pipeline, lineage

ROWS = [
    ("7", "MARTA  de-vries", "Marta@Yard.example", "0044 20 7946 0123", "4 Mar 1971", "uk", "£2,050"), ("8", None, "yard", "(555) 010-9999", "1971/03/04", "usa", "(20)"),
    ("7", " o'brien", " lou@yard.example ", "12", "19710304", "Eire", "35%"), ("9", "Lou", None, None, "never", None, "n/a"),
]
COLUMNS = "id string, name string, email string, phone string, dob string, country string, amount string"


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, *r) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "__row_id long, " + COLUMNS)


def after(df, name, got=None, /, **params):
    out = run(df, name, params, Context(today=datetime.date(2025, 1, 31), key=b"k"))
    return [r[got] for r in out.orderBy("__row_id").collect()] if got else out


def test_the_registry_is_whole():
    assert len(STEPS) == 88
    assert {s.category for s in STEPS.values()} == {"clean", "types", "text", "datetime", "missing", "duplicates", "filter", "join", "aggregate", "pivot", "schema", "derived", "enrich", "quality", "pii"}


BORN = datetime.date(1971, 3, 4)
#: (step, parameters, column to look at, its values in row order)
CELLS = [
    ("titlecase", {"columns": ["name"]}, "name", ["Marta De-Vries", None, "O'Brien", "Lou"]),
    ("trim_whitespace", {"columns": ["name"]}, "name", ["MARTA  de-vries", None, "o'brien", "Lou"]),
    ("parse_date", {"columns": ["dob"]}, "dob", [BORN, BORN, BORN, None]),
    ("calculate_age", {"column": "dob"}, "age", [53, 53, 53, None]),
    ("convert_types", {"conversions": [{"column": "amount", "to": "currency"}]}, "amount", [2050, -20, 35, None]),
    ("convert_types", {"conversions": [{"column": "amount", "to": "percentage"}]}, "amount", [20.5, -20, 0.35, None]),
    ("standardize_country", {"column": "country", "output_format": "iso3"}, "country", ["GBR", "USA", "IRL", None]),
    ("validate_email", {"column": "email", "invalid": "flag"}, "email_is_valid", [True, False, True, False]),
    ("standardize_phone", {"column": "phone"}, "phone", ["+442079460123", "+15550109999", None, None]),
    ("mask", {"columns": ["dob"], "style": "partial"}, "dob", ["••••••1971", "••••••3/04", "••••0304", "•ever"]),
    ("forward_fill", {"columns": ["name"]}, "name", ["MARTA  de-vries", "MARTA  de-vries", " o'brien", "Lou"]),
    ("window", {"fn": "running_sum", "column": "amount", "order_by": "__row_id", "output": "x"}, "x", [2050, 2030, 2065, None]),
    ("window", {"fn": "rank", "column": "amount", "output": "x"}, "x", [3, 1, 2, None]),
    ("flag_duplicates", {"columns": ["id"]}, "is_duplicate", [True, False, True, False]),
]


@pytest.mark.parametrize(("step", "params", "column", "values"), CELLS, ids=lambda v: v if isinstance(v, str) else "")
def test_cells(df, step, params, column, values):
    assert after(df, step, column, **params) == values


@pytest.mark.parametrize(
    ("step", "params", "rows"),
    [("remove_duplicates", {"columns": ["id"]}, [0, 1, 3]), ("remove_duplicates", {"columns": ["id"], "keep": "last"}, [1, 2, 3]), ("remove_invalid", {"column": "amount", "check": "number"}, [0, 1, 2]), ("filter_rows", {"conditions": [{"column": "amount", "op": "lt", "value": 36}]}, [1, 2]), ("drop_missing", {"columns": ["name", "email"]}, [0, 2])],
)
def test_which_rows_stay(df, step, params, rows):
    assert sorted(r["__row_id"] for r in after(df, step, **params).collect()) == rows


def test_sums_by_group(df):
    made = after(df, "aggregate", group_by=["id"], aggregations=[{"column": "amount", "fn": "sum", "alias": "s"}, {"fn": "count", "alias": "n"}])
    assert {r.id: (r.s, r.n) for r in made.collect()} == {"7": (2085, 2), "8": (-20, 1), "9": (None, 1)}


def test_formulas_hold_no_code(df):
    small = {"type": "op", "op": "<", "left": {"type": "func", "name": "abs", "args": [{"type": "column", "name": "amount"}]}, "right": {"type": "literal", "value": 30}}
    tree = {"type": "if", "condition": small, "then": {"type": "literal", "value": "low"}, "else": {"type": "literal", "value": "other"}}
    assert after(df, "derive_column", "x", output="x", expression=tree) == ["other", "low", "other", "other"]
    assert "amount" in describe(tree)
    for bad in ({"type": "func", "name": "__import__", "args": []}, {"type": "column", "name": "unknown"}, {"type": "code"}):
        assert validate(bad, ["amount"])


def test_tokens_are_keyed_hashes(df):
    import hashlib
    import hmac

    tokens = after(df, "tokenize", "id", columns=["id"])
    assert tokens[0] == tokens[2] == "tok_" + hmac.new(b"k", b"7", hashlib.sha256).hexdigest()[:16] and len(set(tokens)) == 3


def test_fuzzy_duplicates_and_survivorship(spark):
    df = spark.createDataFrame([(0, "Anna Smith", None), (1, "smith anna", "x"), (2, "Anna Smyth", "yy"), (3, "Zed", ""), (4, None, None)], "__row_id long, name string, v string")
    got = after(df, "fuzzy_duplicates", columns=["name"], threshold=85).orderBy("__row_id").collect()
    assert [r.has_similar for r in got] == [True, True, True, False, False]
    assert len({r.similar_group for r in got[:3]}) == 1
    assert after(df, "fuzzy_duplicates", columns=["name"], threshold=85, action="remove").count() == 3
    golden = after(df.withColumn("k", df["__row_id"] > 2), "survivorship", columns=["k"], rules={"v": "longest"})
    assert {r.k: (r.name, r.v) for r in golden.collect()} == {False: ("Anna Smith", "yy"), True: ("Zed", None)}


def test_edges(spark):
    empty = spark.createDataFrame([], "__row_id long, " + COLUMNS)
    for name, params in {"fill_median": {"columns": ["amount"]}, "clip_outliers": {"column": "amount"}, "forward_fill": {"columns": ["name"]}, "remove_duplicates": {}, "fuzzy_duplicates": {"columns": ["name"]}, "standardize_values": {"column": "name"}, "smart_impute": {"column": "name"}, "fill_mode": {"columns": ["name"]}}.items():
        assert after(empty, name, **params).count() == 0, name
    with pytest.raises(StepError):
        run(empty, "uppercase", {"columns": ["nope"]}, Context())
    assert check(None, "mask", {"columns": ["a"], "style": "odd"}) and check(None, "no_such_step", {})


def test_numbers_and_phones(spark):
    values = ["(12)", "1,234.5", "€ 7", "5%", "1d", "NaN", "", None, " -3e2 ", "12 345"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(K.numeric(K.col("v"))).collect()
    assert [r[0] for r in rows] == [-12, 1234.5, 7, 5, None, None, None, None, -300, 12345]
    phones = ["0044 20 7946 0958", "030 1234567", "1 555 123 4567", "12", "  "]
    got = spark.createDataFrame([(v,) for v in phones], "v string").select(K.phone(K.col("v"), "DE"), K.phone(K.col("v"))).collect()
    assert [tuple(r) for r in got] == [("+442079460958", "+442079460958"), ("+49301234567", "+10301234567"), ("+4915551234567", "+15551234567"), (None, None), (None, None)]


def test_exact_quantiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 1, 9, 3, 3, 3, 7)] + [(None,)], "v double")
    r = exact_quantiles(df, df.v, {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    import numpy as np

    assert np.allclose(list(r), np.quantile([5, 1, 1, 9, 3, 3, 3, 7], [0.25, 0.5, 0.9]))


def test_row_ids_follow_an_order(spark):
    rows = with_row_id(spark.range(100).selectExpr("100 - id as k"), ["k"]).orderBy("__row_id").collect()
    assert [r.k for r in rows] == list(range(1, 101))


def test_pipeline_skips_what_fails_and_refuses_cycles_and_code(spark, df):
    doc = {"datasets": {"a": {}, "b": {}}, "steps": [{"id": "1", "dataset": "a", "type": "uppercase", "params": {"columns": ["name"]}}, {"id": "2", "dataset": "a", "type": "drop_columns", "params": {"columns": ["nope"]}}, {"id": "3", "dataset": "b", "type": "join", "params": {"right_dataset": "a", "left_on": ["id"], "right_on": ["id"]}}], "gold": [{"name": "g", "dataset": "a", "kind": "dimension_summary"}]}
    p = Pipeline(doc, lambda n: df)
    assert [x["status"] for x in p.result("a").log] == ["ok", "failed"] and p.result("b").df.count() == 6
    seen = p.preview("a", "1")
    assert seen["changes"] == {"name": 3} and seen["removed"] == 0
    assert {n["type"] for n in lineage(doc)["nodes"]} == {"source", "raw", "bronze", "transformation", "silver", "gold", "dashboard"}
    circle = {"steps": [{"dataset": x, "type": "union_all", "params": {"datasets": [y]}} for x, y in (("a", "b"), ("b", "a"))]}
    with pytest.raises(StepError):
        Pipeline(circle, lambda n: df, on_error="raise").result("a")
    with pytest.raises(StepError):
        Pipeline({"steps": [{"params": {"code": "x"}}]}, lambda n: df)
