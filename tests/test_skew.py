"""Joins on hot keys, windows over whole tables, quantiles by group and likeness, against plain versions on small tables."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from millweir import skew
from millweir.operators import ordering, relational  # noqa: F401 - it registers the steps
from millweir.operators.graph import components
from millweir.operators.registry import Context, run
from millweir.skew import spread_join


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("nulls_match", [True, False])
def test_spread_join_equals_join(spark, monkeypatch, how, nulls_match):
    monkeypatch.setattr(skew, "LEAST_BYTES", 0)
    monkeypatch.setattr(skew, "LEAST_ROWS", 20)
    rows = spark.range(900).selectExpr("id", "if(id % 3 = 0, null, if(id % 3 = 1, 7, id % 20)) as k")
    other = spark.createDataFrame([(None, "n"), (7, "a"), (7, "b"), (3, "c"), (99, "d")], "k2 long, v string")
    on = [(F.col("k"), F.col("k2"))]
    plain = rows.join(other, F.col("k").eqNullSafe(F.col("k2")) if nulls_match else F.col("k") == F.col("k2"), how)
    made = spread_join(rows, other, on, how, nulls_match)
    assert made.columns == plain.columns
    assert sorted(map(str, made.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("fn", ["rank", "dense_rank", "lag", "lead", "moving_avg"])
def test_windows_over_whole_tables(spark, monkeypatch, fn):
    monkeypatch.setattr(ordering, "BLOCK_ROWS", 7)
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1, 2, 3, 5]), rng.choice([None, float(i % 11)])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k int, v double")
    got = {r.id: r.x for r in run(df, "window", {"order_by": "k", "fn": fn, "column": "v", "output": "x", "window_size": 9}, Context(order=["id"])).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    for at, (i, k, _) in enumerate(order):
        near = [r[2] for r in order[max(0, at - 8) : at + 1] if r[2] is not None]
        want = {"lag": order[at - 1][2] if at else None, "lead": order[at + 1][2] if at + 1 < len(order) else None, "moving_avg": sum(near) / len(near) if near else None,
                "rank": None if k is None else 1 + sum(r[1] is not None and r[1] < k for r in rows), "dense_rank": None if k is None else 1 + len({r[1] for r in rows if r[1] is not None and r[1] < k})}[fn]
        assert got[i] == pytest.approx(want) if want is not None else got[i] is None, (i, k)


def test_quantiles_by_group(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), float(rng.randint(0, 40))) for _ in range(500)] + [("z", None), ("n", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.m, r.p, r.n) for r in run(df, "aggregate", {"group_by": ["g"], "aggregations": [{"column": "v", "fn": "median", "alias": "m"}, {"column": "v", "fn": "p90", "alias": "p"}, {"fn": "count", "alias": "n"}]}, Context()).collect()}
    for g in ("a", "b", None):
        values = sorted(v for x, v in rows if x == g)
        at = lambda q, values=values: values[int(q * (len(values) - 1))] + (q * (len(values) - 1) % 1) * (values[min(len(values) - 1, int(q * (len(values) - 1)) + 1)] - values[int(q * (len(values) - 1))])
        assert got[g] == (pytest.approx(at(0.5)), pytest.approx(at(0.9)), len(values))
    assert got["z"] == (None, None, 1)


@pytest.mark.parametrize("threshold", [70, 85, 95])
def test_likeness_equals_brute_force(spark, threshold):
    rng = random.Random(threshold)
    words = [f"ab{''.join(rng.choice('cde') for _ in range(rng.randint(0, 14)))}" for _ in range(150)] + ["", "", "x"]
    df = spark.createDataFrame(list(enumerate(words)), "id long, w string")
    got = {}
    for r in run(df, "fuzzy_duplicates", {"columns": ["w"], "threshold": threshold}, Context(order=["id"])).collect():
        got.setdefault(r.similar_group, set()).add(r.id)
    group = list(range(len(words)))
    for i in range(len(words)):
        for j in range(i):
            a, b = sorted((words[i], words[j]))
            if words[i][:2] == words[j][:2] and difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= threshold / 100 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = {}
    for i, g in enumerate(group):
        want.setdefault(g, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 99), (99, 100), (100, 100), (200, 201)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {99: 99, 100: 99, 200: 200, 201: 200}


def test_release_deletes_what_was_written(spark):
    from millweir import session

    df = session.materialize(spark.range(5))
    assert df.count() == 5 and session.release() >= 1 and session.release() == 0
    folder = session.shared_folder(spark).removeprefix("file://")
    import os

    assert not [x for x in os.listdir(folder) if x.startswith("millweir-cut")]
