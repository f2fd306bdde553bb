"""Every registered query of the engine against its DuckDB oracle."""

from __future__ import annotations

import duckdb
import pytest

from sparkfold.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("null" if r[i] is None else repr(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    true = duck.execute(catalog.ORACLES[name])
    names, kinds = [d[0] for d in true.description], {d[0]: str(d[1]) for d in true.description}
    assert sorted(frame.columns) == sorted(names)
    assert {c: KINDS.get(k, k) for c, k in frame.dtypes} == kinds
    assert rows(frame.collect(), frame.columns) == rows(true.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
