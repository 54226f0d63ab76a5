from collections import defaultdict

from millweir.llm.copies import collapse, find_copies

ROWS = [
    (1, "A.b@x.test", "+1 23", "p"), (2, "ab@XTEST", "123", "p"), (3, "1-23", "abxtest", None), (4, "abx.test", None, "p"), (5, "", "", "p"), (6, "", "", "p"),
    (7, "ba@xtest", "123", "p"), (8, "abxtest", "1 23", "p"), (9, "é", "5", "p"), (10, "ü", "5", "p"), (11, "q" * 70_000, "9", "p"), (12, "Q" * 70_000, "9", "p"),
]


def test_groups(spark):
    df = spark.createDataFrame(ROWS, "rep_id long, email string, phone string, n_copies string")
    found = find_copies(df, "rep_id", ["email", "phone"])
    groups = defaultdict(set)
    for r in found.collect():
        groups[r.kept_id].add((r.row_id, r.n_copies))
    assert groups == {1: {(1, 4), (2, 4), (3, 4), (8, 4)}, 11: {(11, 2), (12, 2)}}
    left = collapse(df.drop("n_copies"), "rep_id", found)
    assert {r.rep_id: r.n_copies for r in left.collect()} == {1: 4, 4: 1, 5: 1, 6: 1, 7: 1, 9: 1, 10: 1, 11: 2}


def test_hot_group_repeated_rows_and_empty(spark, monkeypatch):
    monkeypatch.setattr("millweir.skew.LEAST_ROWS", 100)
    df = spark.range(900).selectExpr("id as rep_id", "if(id % 3 = 0, 'a@b.test', concat('m', id, '@b.test')) as email", "if(id % 3 = 0, '12', cast(id as string)) as phone")
    found = find_copies(df, "rep_id", ["email", "phone"])
    assert found.count() == 300 and {r.kept_id for r in found.collect()} == {0}
    twice = df.where("rep_id < 2").unionByName(df.where("rep_id < 2"))
    assert {tuple(r) for r in find_copies(twice, "rep_id", ["email", "phone"]).collect()} == {(0, 0, 2), (1, 1, 2)}
    assert find_copies(df.limit(0), "rep_id", ["email", "phone"]).count() == 0
