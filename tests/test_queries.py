"""Every registered query against its DuckDB SQL, over the smallest test tables."""

from __future__ import annotations

import ast
from pathlib import Path

import duckdb
import pytest

from provenant.plans import catalog

from .conftest import TESTDATA

ROOT = Path(__file__).resolve().parent.parent
SF = TESTDATA / "sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "embeddings", "conversations")

pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the test tables")


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, str(SF))
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == order
    at = [columns.index(c) for c in order]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_the_rest_does_not_import_the_subpackage():
    for path in (ROOT / "provenant").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path
