"""Queries on tables that the small sets don't show, against their SQL twins."""

import shutil
from collections import Counter

import duckdb
import pytest
from test_sql_twins import SF, TABLES, plain

from panelwright import queries


def twin(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in want.description]
    got = Counter(tuple(plain(r[c]) for c in cols) for r in queries.QUERIES[name](spark, str(folder)).collect())
    rows = Counter(tuple(map(plain, r)) for r in want.fetchall())
    assert rows and got == rows
    return [dict(zip(cols, r)) for r in rows]


def changed(folder, name, sql):
    """The small tables with ``name`` made by ``sql`` over it."""
    for t in TABLES:
        if t != name:
            shutil.copyfile(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    duckdb.connect().execute(f"COPY ({sql.format(table=f"'{SF}/{name}.parquet'")}) TO '{folder}/{name}.parquet'")


@pytest.mark.parametrize("name", ["rg7_value_added", "rg18_tradeability"])
def test_prices_that_never_move(spark, tmp_path, name):
    """No label leaves its middle, nothing is traded, and returns have no deviation."""
    changed(tmp_path, "lineitem", "SELECT * REPLACE (l_quantity * 1000 AS l_extendedprice) FROM {table}")
    rows = twin(spark, name, tmp_path)
    assert len(rows) == 10 and all(r.get("regime", "nan") == "nan" for r in rows)


def test_average_of_a_series_of_two_million():
    """The SQL of the long average stays a number where a power of all bars so far would not, and is the plain fold."""
    con, n = duckdb.connect(), 2_000_000
    con.execute(f"CREATE VIEW events AS SELECT 2 * i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) SECOND AS ts, 'view' AS event_type, CAST(hash(i) % 10000 AS DOUBLE) / 100 AS value FROM range({n}) t(i)")
    got = dict(con.execute(f"SELECT event_id, vol FROM ({queries.ORACLES['wn27_long_ewma']}) WHERE event_id % 20000 = 0 OR event_id < 100").fetchall())
    squares = con.execute("SELECT ((value - 50) / 5000) * ((value - 50) / 5000) AS sq FROM events ORDER BY ts").df()["sq"]
    want = (squares.ewm(alpha=2.0 / 5001, adjust=False).mean() * 252) ** 0.5
    assert len(got) == n // 10000 + 49 and all(abs(v - want[i // 2]) < 2e-6 for i, v in got.items())


def test_value_at_the_limit_has_not_tripped(spark, tmp_path):
    """Users who end at exactly 80 % of their peak, by moves whose sums in doubles do not; and users a cent below."""
    import random
    from datetime import datetime, timedelta

    rng, rows = random.Random(4), []
    for user in range(60):
        cents, moves = -(20000 + user % 2), []
        while cents:
            moves.append(max(cents, -rng.randrange(1, 3000)))
            cents -= moves[-1]
        rows += [(len(rows) + k, datetime(2024, 1, 1) + timedelta(minutes=k), user, "view", (5000 + m) / 100, "{}") for k, m in enumerate(moves)]
    rows.append((len(rows), datetime(2024, 3, 1), 0, "view", 50.0, "{}"))
    changed(tmp_path, "events", "SELECT * FROM {table} LIMIT 0")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").toPandas().to_parquet(f"{tmp_path}/events.parquet", coerce_timestamps="us")
    got = twin(spark, "sm6_live_breaker", tmp_path)
    assert {r["user_id"] for r in got if r["tripped"]} == set(range(1, 60, 2))
