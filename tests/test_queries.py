"""Each query against its SQL in DuckDB, as multisets of rows."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return f"{v:.9g}" if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(entry.queries().keys() - {"pipeline"} - {n for n in entry.queries() if n.startswith("op")}))
def test_matches_sql(spark, name):
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = Counter(tuple(plain(r[c]) for c in cols) for r in got.collect())
    if name not in SQL:
        assert rows
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
