"""Every registered query of the engine with SQL gives DuckDB's rows."""

import duckdb
import pytest

from tidewell.plans import registry

SF = "/root/testdata/sf0.001"


def normal(rows):
    return sorted(str(tuple(f"{x:.9g}" if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert rows
    if name in registry.oracle_sql():
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
        want = con.sql(registry.oracle_sql()[name])
        assert sorted(want.columns) == columns
        assert normal(rows) == normal(want.select(*(f'"{c}"' for c in columns)).fetchall())
