"""Every query with SQL gives the SQL's rows, every other one runs, on the smallest tables."""

import os

import duckdb
import pytest

from kvern.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
CASES = [(m, name) for m in catalogue.MODULES for name in m.QUERIES]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set TimeZone='UTC'")
    for file in os.listdir(FOLDER):
        c.sql(f"create view {file.removesuffix('.parquet')} as select * from '{FOLDER}/{file}'")
    return c


@pytest.mark.parametrize("module, name", CASES, ids=[name for _, name in CASES])
def test_rows(spark, duck, tmp_path, module, name):
    out = module.QUERIES[name](spark, FOLDER)
    out.write.parquet(f"{tmp_path}/out")
    if name not in module.ORACLES:
        return
    columns = ", ".join(f'"{c}"' for c in sorted(out.columns))
    mine, theirs = f"select {columns} from '{tmp_path}/out/*.parquet'", f"select {columns} from ({module.ORACLES[name]})"
    for a, b in ((mine, theirs), (theirs, mine)):
        assert duck.sql(f"({a}) except all ({b}) limit 3").fetchall() == []


def test_entry_points():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
