import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from millweir.operators.registry import Context
from millweir.plans.lakehouse import build
from millweir.plans.pipeline import Pipeline, policy_problems
from millweir.session import shared_folder
from millweir.sources.connectors import connect, connector
from millweir.sources.readers import incremental_column, json_entities, read_file, sniff_delimiter, sniff_encoding, sniff_format, unzip
from millweir.sources.rest import MorePages, pages, read_pages
from millweir.sources.writers import Target, merge_sql, write
from millweir.streaming.stream import apply_steps, file_stream, for_each_batch
from millweir.functions.conditions import StepError


def test_sniffing():
    assert sniff_format("x.dat", b"PAR1....") == "parquet" and sniff_format("x", b' {"a"') == "json" and sniff_format("x", b"<a>") == "xml" and sniff_format("a.xlsx", b"PK\x03") == "xlsx"
    assert sniff_encoding("é".encode("latin-1") + b" abcdef") == "ISO-8859-1" and sniff_encoding("é".encode()) == "UTF-8"
    assert sniff_delimiter('a;"b,c,d";e') == ";" and incremental_column(["a", "Modified_At"]) == "Modified_At"


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id;näme\n1;x\n2\n".encode("latin-1"))
    assert [tuple(r) for r in read_file(spark, str(tmp_path / "a.csv")).collect()] == [("1", "x"), ("2", None)]
    (tmp_path / "b.json").write_text('{"cars": [{"v": 1, "o": {"x": 2.5}}, {"v": "a"}], "n": 3}')
    assert json_entities(read_file(spark, str(tmp_path / "b.json"))) == ["cars"]
    assert [r.v for r in read_file(spark, str(tmp_path / "b.json"), entity="cars").collect()] == ["1", "a"]
    (tmp_path / "c.xml").write_text('<all><r id="1"><c cur="EUR">5</c></r><r id="2"><c cur="USD">6</c></r></all>')
    assert sorted((r.id, r.c.cur, r.c.value) for r in read_file(spark, str(tmp_path / "c.xml")).collect()) == [("1", "EUR", "5"), ("2", "USD", "6")]
    with gzip.open(tmp_path / "d.csv.gz", "wt") as f:
        f.write("k,v\n1,2\n")
    assert read_file(spark, str(tmp_path / "d.csv.gz")).count() == 1
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("export/a.csv", "a\n1\n")
        z.writestr("README.md", "no data")
    assert [p.rsplit("/", 1)[-1] for p in unzip(spark, str(tmp_path / "e.zip"), str(tmp_path / "out"))] == ["a.csv"]
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("../evil.csv", "a")
    with pytest.raises(ValueError):
        unzip(spark, str(tmp_path / "f.zip"), str(tmp_path / "out"))


def test_json_lines_in_a_json_file(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"a": 1}\n{"a": 2, "b": "x"}\n')
    assert sorted(r.a for r in read_file(spark, str(tmp_path / "l.json")).collect()) == ["1", "2"]
    (tmp_path / "m.json").write_text('{"a": 1,\n "b": {"c": 2}}\n')
    assert read_file(spark, str(tmp_path / "m.json")).first().a == "1"


def test_csv_keeps_blanks_and_quotes(spark, tmp_path):
    rows = [(" a ", 'say "hi", now'), ("b\\", ""), ("c", "semi;colon")]
    write(spark.createDataFrame(rows, "k string, v string"), Target(str(tmp_path / "c"), "csv", "overwrite"))
    assert sorted((r.k, r.v or "") for r in read_file(spark, str(tmp_path / "c"), format="csv").collect()) == sorted(rows)


def test_sheet(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>x</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>0</v></c></row><row/><row><c r="A3"><v>7</v></c><c r="B3" t="s"><v>1</v></c></row></sheetData></worksheet>')
    df = read_file(spark, str(tmp_path / "w.xlsx"))
    assert df.columns == ["id", "id_2"] and [tuple(r) for r in df.collect()] == [("7", "x")]


def test_pages():
    data = [{"i": i} for i in range(7)]

    def fetch(url, q):
        if "page" in q:
            return {"items": data[(q["page"] - 1) * 3 : q["page"] * 3]}
        at = int(q.get("cursor", 0))
        return {"items": data[at : at + 3], "next_cursor": str(at + 3) if at + 3 < 7 else None}

    assert list(pages(fetch, "u", "page", "items", 3)) == data == list(pages(fetch, "u", "cursor", "items", 3))
    with pytest.raises(MorePages):
        list(pages(fetch, "u", "page", "items", 3, most=2))
    assert list(pages(fetch, "u", "page", "items", 3, most=3)) == data


def test_read_pages_fetches_each_page_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def fetch(url, q):
        with open(log, "a") as f:
            f.write(f"{url} {q['page']}\n")
        return [{"i": f"{url}{q['page']}{k}", "at": {"k": k}} for k in range(2 if q["page"] == 1 else 1)]

    df = read_pages(spark, fetch, ["u", "v"], style="page", size=2)
    assert sorted((r.i, r["at"].k) for r in df.collect()) == sorted((f"{u}{p}{k}", str(k)) for u in "uv" for p, k in ((1, 0), (1, 1), (2, 0)))
    assert len(open(log).read().splitlines()) == 4


def test_archives_through_the_dispatcher(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("x/a.csv", "a,b\n1,2\n")
        z.writestr("x/b.csv", "a,c\n3,4\n")
    assert sorted(map(tuple, read_file(spark, f"file://{tmp_path}/e.zip").collect())) == [("1", "2", None), ("3", None, "4")]
    assert read_file(spark, str(tmp_path / "e.zip"), member="b.csv").columns == ["a", "c"]
    with pytest.raises(ValueError):
        read_file(spark, str(tmp_path / "e.zip"), member="none.csv")


def test_merges(spark, tmp_path):
    target = Target(str(tmp_path / "t"), mode="merge", keys=["k"])
    write(spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string"), target)
    write(spark.createDataFrame([(2, "c"), (3, "d"), (None, "m")], "k int, v string"), target)
    assert sorted((r.k or 0, r.v) for r in spark.read.parquet(target.path).collect()) == [(0, "m"), (1, "a"), (2, "c"), (3, "d")]
    assert merge_sql("snowflake", "t", "s", ["a", "b"], ["a"]).startswith("MERGE INTO t AS t USING s")
    assert "ON DUPLICATE KEY UPDATE `b` = VALUES(`b`)" in merge_sql("mysql", "t", "s", ["a", "b"], ["a"])
    assert "ON CONFLICT (\"a\") DO UPDATE SET" in merge_sql("postgresql", "t", "s", ["a", "b"], ["a"])


def test_lakehouse(spark, tmp_path):
    cust = spark.createDataFrame([("1", "a@x.org"), ("2", "bad"), ("3", None)], "id string, email string")
    orders = spark.createDataFrame([("1", "2024-01-05"), ("1", "2024-02-01"), ("9", "x")], "cust string, day string")
    doc = {"datasets": {"cust": {}, "orders": {}}, "rules": [{"dataset": "cust", "rule": "email", "column": "email", "on_fail": "quarantine"}], "gold": [{"name": "c360", "kind": "entity_360", "dataset": "cust", "key": "id", "related": [{"dataset": "orders", "key": "cust"}]}, {"name": "months", "kind": "time_summary", "dataset": "orders", "column": "day"}]}
    tables = build(Pipeline(doc, {"cust": cust, "orders": orders}.__getitem__), str(tmp_path))
    assert {r.id: r.orders_count for r in spark.read.parquet(f"{tmp_path}/gold/c360").collect()} == {"1": 2, "3": 0}
    assert tables.quarantine["cust"].count() == 1 and spark.read.parquet(f"{tmp_path}/gold/months").count() == 3


def test_stream(spark, tmp_path):
    spark.range(20).selectExpr("id", "concat(' x', id) as v").write.parquet(str(tmp_path / "in"))
    stream = file_stream(spark, str(tmp_path / "in"), "id long, v string")
    made = apply_steps(stream, [{"type": "trim_whitespace"}, {"type": "filter_rows", "params": {"conditions": [{"column": "id", "op": "lt", "value": 5}]}}], Context())
    with pytest.raises(StepError):
        apply_steps(stream, [{"type": "remove_duplicates", "params": {}}], Context())
    seen = []
    for_each_batch(made, lambda df, n: seen.extend(r.v for r in df.where(F.col("_source_file").isNotNull()).collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["x0", "x1", "x2", "x3", "x4"]


def test_a_cluster_needs_a_shared_folder():
    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        shared_folder(Elsewhere)


def test_policy():
    assert policy_problems({"steps": [{"params": {"sql": "x"}}]}) and policy_problems({"a": ["x" * 2001]}) and policy_problems({"steps": [{"Code": 1}]})
    assert not policy_problems({"rules": [{"rule": "expression", "params": {"sql": "a > 1"}}]})


def test_connectors_share_their_verbs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,updated_at\n1,2024-01-01\n2,2024-01-02\n")
    files = connect(spark, "file", folder=str(tmp_path))
    assert files.test() is None and [f.name for f in files.discover()] == ["a.csv"] and files.incremental("a.csv") == "updated_at"
    assert files.read("a.csv", 1).count() == 1 and files.profile("a.csv")["rows"] == 2 and files.schema("a.csv")[0] == {"name": "id", "type": "string"}
    with pytest.raises(ValueError):
        files.read("../a.csv")
    assert connect(spark, "file", folder=str(tmp_path / "none")).test()
    api = connect(spark, "api", fetch=lambda url, q: [{"id": url}], endpoints={"cars": "http://x/cars"})
    assert api.read("cars").first().id == "http://x/cars"
    assert connect(spark, "postgresql", host="h", database="d").url == "jdbc:postgresql://h:5432/d" and connect(spark, "s3", folder="b/x").folder == "s3a://b/x"
    connector("mine", "format", lambda spark, **k: connect(spark, "file", folder=str(tmp_path)))
    assert connect(spark, "mine").discover()[0].name == "a.csv"
    with pytest.raises(ValueError):
        connect(spark, "unknown")
