import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_flagship_and_catalogue(spark):
    assert entry.entry(spark).columns == ["c_mktsegment", "order_year", "revenue", "items"]
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 180


def test_nothing_outside_imports_the_llm_package():
    for source in (ROOT / "millweir").rglob("*.py"):
        if "llm" in source.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(source.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("millweir.llm") for n in names), source


def test_hot_steps_stay_in_the_jvm(spark):
    """Row-local steps become projections: no Python, no shuffle."""
    for name in ("trim_whitespace", "standardize_phone", "convert_types", "parse_date", "derive_column_if", "mask", "tokenize", "map_codes"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    from millweir.session import table

    plan = table(spark, "/root/testdata/sf0.001", "orders").where("o_totalprice > 1000").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in plan and "o_orderdate" not in plan.split("ReadSchema")[1]
