"""Every registered query against its DuckDB twin on the smallest scale
(the driver runs the same comparison at sf0.01)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import rows_of  # noqa: E402
from verdigris.plans import logical as L  # noqa: E402
from verdigris.plans.catalog import entries  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

ENTRIES = entries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in L.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query_matches_oracle(spark, duck, name):
    e = ENTRIES[name]
    df = e.build(spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    if not e.sql:
        assert len(df.columns) > 0 and len(srows) > 0
        return
    cur = duck.execute(e.sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows_of(df.columns, srows) == rows_of(dcols, drows)


def test_entry_smoke(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as se
    out = se.entry(spark)
    assert out.columns == ["ts", "facility_id", "co2_kg", "z_score"]
    assert out.count() >= 0
    assert set(se.oracle_sql()) <= set(se.queries())
