"""Every registered query with SQL gives that SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

from tarn.plans.catalog import ORACLES, QUERIES

from .conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    r = con.execute(ORACLES[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    show = lambda rows: sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in x) for x in rows)
    assert show(r.fetchall()) == show(tuple(x) for x in df.select(*cols).collect())
