"""Every panel query gives the rows of its SQL twin."""

import math
from collections import Counter

import duckdb
import pytest

from panelwright import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    return x


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, con, name):
    want = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    rows = Counter(tuple(map(plain, r)) for r in want.fetchall())
    assert rows
    assert Counter(tuple(plain(r[c]) for c in cols) for r in got.collect()) == rows
