"""Every registered core query against its SQL in DuckDB on the smallest tables; those without SQL must run."""

import glob
import os

import pytest

from tacitra.plans import registry

SF = os.environ.get("TACITRA_SF", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(SF + "/*.parquet"):
        c.execute(f"CREATE VIEW \"{os.path.basename(f)[:-8]}\" AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows or name in {"simulation_losses"}
        return
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert rows == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in got.fetchall())
