import math

import pyarrow as pa
from pyspark.sql import functions as F

from millweir.operators.column_profile import mask_violations, profile_loads, score_loads
from millweir.operators.orphans import find_orphans, parent_validity
from millweir.queries.checks import QUERIES
from millweir.skew import hot_keys, salted_join

DEALERS = "dealer_id long, load_id int, kind string"


def _validity(spark, dealers, gone):
    return parent_validity(spark.createDataFrame(dealers, DEALERS), spark.createDataFrame(gone, DEALERS), "dealer_id", "load_id")


def test_orphans_kinds(spark):
    validity = _validity(spark, [(1, 1, "x"), (2, 5, "x"), (3, 1, None), (None, 1, "x"), (6, None, "x")], [(4, 2, "x"), (3, 2, "x"), (4, 3, "x")])
    refs = spark.createDataFrame(
        [(10, 1, 1, "a"), (11, 2, 4, "a"), (12, 2, 5, "a"), (13, 3, 1, "a"), (14, 4, 1, "a"), (15, 9, 1, "a"), (15, 9, 1, "a"), (15, 9, 2, "a"), (16, None, 1, "a"), (17, 0, 1, "a"), (18, 6, 1, "a"), (19, 2, None, "a")],
        "row long, dealer_id long, load_id int, kind string",  # kind: a clashing name
    )
    found = {tuple(r) for r in find_orphans(refs, validity, "row", "dealer_id", "load_id").collect()}
    assert found == {(11, 4, "late"), (14, 1, "deleted"), (15, 1, "missing"), (15, 2, "missing"), (17, 1, "missing")}


def test_orphans_hot_key_and_empty(spark, monkeypatch):
    monkeypatch.setattr("millweir.skew.LEAST_ROWS", 100)
    validity = _validity(spark, [(1, 1, "x")], [])
    refs = spark.range(3000).selectExpr("id as row", "case when id % 3 = 0 then 7 when id % 3 = 1 then 1 else id end as dealer_id", "1 as load_id")
    assert {k for k, _ in hot_keys(refs, "dealer_id")} == {7, 1}
    found = find_orphans(refs, validity, "row", "dealer_id", "load_id")
    assert found.count() == 2000 and found.select("row_id").distinct().count() == 2000
    assert find_orphans(refs.limit(0), validity, "row", "dealer_id", "load_id").count() == 0
    assert find_orphans(refs, _validity(spark, [], []), "row", "dealer_id", "load_id").count() == 3000


def test_salted_join_equals_join(spark, monkeypatch):
    monkeypatch.setattr("millweir.skew.LEAST_ROWS", 10)
    rows = spark.range(1000).selectExpr("id", "if(id % 2 = 0, 0, id % 10) as k")
    keyed = spark.range(8).selectExpr("id as k", "id * 2 as v")
    assert sorted(map(tuple, salted_join(rows, keyed, "k", rows["id"]).collect())) == sorted(map(tuple, rows.join(keyed, "k").collect()))


def _loads(spark, changed):
    rows = []
    for load in range(1, 9):
        for i in range(400):
            mail = None if i % 50 == 0 else f"ann.bee{i}@shop.test"
            price = 1000.0 + (i * 37) % 900
            if load == 3 and changed == "null" and i % 2:
                mail = None
            if load == 4 and changed == "mask" and i % 2:
                mail = "unknown"
            if load == 5 and changed == "range":
                price *= 3
            rows.append((load, mail, price, "  "))
    return spark.createDataFrame(rows, "load int, mail string, price double, n_rows string")


def test_profile_finds_the_departing_load_only(spark):
    for changed, expected in (("none", set()), ("null", {("mail", 3)}), ("mask", {("mail", 4)}), ("range", {("price", 5)})):
        rows = profile_loads(_loads(spark, changed), "load").where("departs").collect()
        assert {(r.col_name, r.load_id) for r in rows} == expected, changed


def test_profile_sees_changes_among_plausible_years(spark):
    """Defaults, a shift by one year and an implausible year leave masks, magnitudes and most quantiles as they are."""
    # as in a table of cars: 24 % of the newest year, each year before it a quarter less
    usual = [2024 - min(14, int(-3.6 * math.log(1 - (i * 0.618034) % 1))) for i in range(2000)]
    odd = {3: lambda i, y: 2022 if i % 5 == 0 else y, 5: lambda i, y: y - 1, 7: lambda i, y: 2018 if i % 20 < 3 else y, 8: lambda i, y: 2040 if i % 200 < 9 else y}
    rows = [(load, odd.get(load, lambda i, y: y)(i, y), 1000.0 + (i * 7919 + load * 31) % 90_001 / 3) for load in range(1, 13) for i, y in enumerate(usual)]
    rows = [(load, y, 15_000.0 if load == 9 and i % 5 == 0 else price) for i, (load, y, price) in enumerate(rows)]
    found = profile_loads(spark.createDataFrame(rows, "load int, year int, price double"), "load").where("departs").collect()
    assert {(r.col_name, r.load_id) for r in found} == {("year", x) for x in odd} | {("price", 9)}


def test_distinct_values_are_compared_on_both_sides():
    rows = [("k", load, 2000, 0, 1000 if load == 3 else 400 if load == 5 else 700, "a", "b", None, 0.0, 0.0, 0.0, 0.0) for load in range(1, 9)]
    names = ["col_name", "load_id", "n_rows", "n_null", "n_distinct", "min_value", "max_value", "quantiles", "rare_share", "mask_jsd", "value_jsd", "rare_values"]
    got = score_loads(pa.table({c: [r[i] for r in rows] for i, c in enumerate(names)})).to_pylist()
    assert {r["load_id"]: r["reasons"] for r in got if r["departs"]} == {3: ["distinct"], 5: ["distinct"]}


def test_masks_query_lists_every_column(spark, tmp_path):
    n = spark.range(3000).withColumn("load_id", F.expr("cast(id % 3 as int)"))
    n.selectExpr("load_id", "if(id = 7, '?', 'AB12') as vin", "if(id = 8, '--', 'sold') as status", "if(id = 9, 12345, 12) as dealer_id", "2020 as model_year").write.parquet(f"{tmp_path}/inventory.parquet")
    n.selectExpr("load_id", "if(id = 7, '?!', 'Ann Bee') as full_name", "if(id = 8, 'none', '12 34') as phone").write.parquet(f"{tmp_path}/sales_reps.parquet")
    got = {(r.tbl_name, r.col_name, r.load_id, r.mask, r.n) for r in QUERIES["p1_masks"](spark, str(tmp_path)).collect()}
    assert got == {("inventory", "vin", 1, "?", 1), ("inventory", "status", 2, "--", 1), ("inventory", "dealer_id", 0, "99999", 1), ("sales_reps", "full_name", 1, "?!", 1), ("sales_reps", "phone", 2, "a", 1)}


def test_profile_edges(spark):
    df = spark.createDataFrame([(1, None, 1.5), (None, "x" * 50_000, None), (2, "", float("nan")), (2, "", float("nan"))], "load int, a string, `b.c` double")
    rows = profile_loads(df, "load").collect()
    assert {(r.col_name, r.load_id) for r in rows} == {(c, x) for c in ("a", "b.c") for x in (1, 2, None)}
    assert profile_loads(df.limit(0), "load").count() == 0
    assert mask_violations(df.limit(0), "load").count() == 0
