"""Every registered query against its SQL twin on the smallest tables."""

import ast
from pathlib import Path

import oracle
import pytest

import __spark_entry__ as driver
from servicelens.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
ROWS_ONLY = {"vector_ivf", "vector_recall", "fuzzy_documents", "chunk_texts"}


@pytest.fixture(scope="module")
def tables():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(spark, tables, name):
    df = driver.queries()[name](spark, SF_DIR)
    assert oracle.differences(df, tables, driver.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_query_without_sql_runs(spark, name):
    df = driver.queries()[name](spark, SF_DIR)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_registration_is_complete():
    assert set(catalog.QUERIES) - set(catalog.SQL) == ROWS_ONLY
    assert set(catalog.QUERIES) <= set(driver.queries())


def test_entry(spark):
    out = driver.entry(spark)
    assert out.columns == ["machine_model", "malfunctions", "cases", "rate_pct"]
    assert out.count() == 20


def test_library_does_not_collect():
    """No `collect`, `toPandas` or `localCheckpoint` call anywhere outside of `llm`."""
    package = Path(driver.__file__).parent / "servicelens"
    calls = {(path.name, node.func.attr) for path in package.rglob("*.py") if "llm" not in path.parts
             for node in ast.walk(ast.parse(path.read_text(encoding="utf-8")))
             if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute)
             and node.func.attr in {"collect", "toPandas", "localCheckpoint", "toLocalIterator"}}
    assert calls == set()
