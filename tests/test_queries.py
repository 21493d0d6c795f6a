"""Every registered query with SQL against DuckDB."""

import decimal
import math

import duckdb
import pytest

from tributary.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    names = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
    if name not in catalogue.oracle_sql():
        assert rows
        return
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_entry_without_corpus_operators():
    """Nothing outside the corpus folder imports it, save the entry's own guard."""
    import pathlib

    root = pathlib.Path(__file__).parent.parent
    for p in (root / "tributary").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text()
