import ast
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tessella.plans import catalogue

SF = "/root/testdata/sf0.001"
ROOT = Path(entry.__file__).parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET memory_limit = '4GB'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{SF}/lineitem.parquet')")
    return con


def value(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else x


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(map(value, r)) for r in df.select(*columns).collect()]
    assert rows or name in ("sign_test", "sign_test_counts")
    if name in catalogue.ORACLES:
        rel = duck.sql(catalogue.ORACLES[name])
        assert sorted(rel.columns) == columns
        assert sorted(rows, key=repr) == sorted((tuple(map(value, r)) for r in rel.select(*columns).fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["slide_id", "overlap_pct", "nms_method", "label", "count", "rel_count"]


def test_the_library_does_not_import_the_corpus_operators():
    for path in (ROOT / "tessella").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path
