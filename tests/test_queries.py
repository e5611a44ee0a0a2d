"""Every table query against its DuckDB equivalent."""

import datetime
import decimal

import duckdb
import pytest

from quillon.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def rows(columns, values):
    def plain(v):
        return float(v) if isinstance(v, decimal.Decimal) else v.isoformat() if isinstance(v, datetime.date) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(v[i]) for i in order]) for v in values)


@pytest.mark.parametrize("name", catalog.queries())
def test_query_matches_sql(spark, small, duck, name):
    got = catalog.queries()[name](spark, small)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(columns, want.fetchall())


def test_entry_imports_without_the_training_package(monkeypatch):
    import importlib
    import sys

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "quillon.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for m in [m for m in sys.modules if m.startswith(("corpus_pipeline", "quillon.llm", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(catalog.queries()) and set(entry.oracle_sql()) == set(catalog.oracle_sql())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
