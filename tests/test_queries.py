"""Every registered query runs at sf0.001 and, where it has one, matches its DuckDB oracle."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import digest  # noqa: E402

from sway.plans.catalog import load_all  # noqa: E402
from sway.sources.tables import TABLES, table_path  # noqa: E402

REG = load_all()

# Spark simple type -> DuckDB type name
DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "array<bigint>": "BIGINT[]", "array<string>": "VARCHAR[]"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


@pytest.mark.parametrize("name", sorted(REG))
def test_query_matches_oracle(name, spark, sf_dir, duck):
    q = REG[name]
    df = q.build(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns, name
    if q.sql is None:
        return
    res = duck.execute(q.sql)
    cols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(cols)
    types = dict(zip(cols, (str(d[1]) for d in res.description)))
    for f in df.schema.fields:
        assert DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) == types[f.name], f.name
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(cols, orows)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
