"""Every query with SQL against DuckDB on the smallest tables, and the contract of the entry module."""

import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402
from compare import rows as plain  # noqa: E402
from tidewatch.plans import catalogue  # noqa: E402

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = df.toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.queries()) <= set(entry.queries())
