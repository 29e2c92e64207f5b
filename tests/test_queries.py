"""Every query of the core over the smallest tables against its SQL in DuckDB."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from spanlake.plans import intervals, problems, surface
from tools.compare import cell

DATA = Path("/root/testdata/sf0.001")
SETS = problems.QUERIES | intervals.QUERIES | surface.QUERIES
SQL = problems.ORACLE | intervals.ORACLE | surface.ORACLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, con, name):
    df, rel = SETS[name](spark, str(DATA)), con.sql(SQL[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    got = Counter(tuple(cell(r[c]) for c in columns) for r in df.collect())
    assert got == Counter(tuple(cell(r[i]) for i in at) for r in rel.fetchall())


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
