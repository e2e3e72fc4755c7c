"""Every registered query of the session-log operators against its SQL, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from turnledger.plans import registry

SF = Path(os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(rows):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=key)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    picked = duck.sql(f"select {', '.join(f'\"{c}\"' for c in columns)} from ({registry.oracle_sql()[name]}) q").fetchall()
    assert plain(df.select(*columns).collect()) == plain(picked)
