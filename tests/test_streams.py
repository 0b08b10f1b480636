"""Streams in order of time whatever their batches, ingest once for good, and stored upserts with deletes and failures."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from panelwright.sources import versioned
from panelwright.sources.shared import shared_folder
from panelwright.streaming import live

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
START = datetime(2024, 1, 1)
FOLLOWS = {"view": ("view", "click"), "click": ("view",)}


def made(n=600, seed=2):
    rng = random.Random(seed)
    rows = [(i, START + timedelta(minutes=rng.randrange(30 * 24 * 60), microseconds=rng.randrange(5)), rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["view", "click", "error", None]), rng.choice([None, rng.uniform(0, 100)]), "{}") for i in range(n)]
    return rows + [(n, START + timedelta(days=40), 9, "view", 1.0, "{}")]


FORMS = {
    "jumps": lambda s: live.jumps(s, 0.5, "4 days"),
    "transitions": lambda s: live.transition_signals(s, 20.0, 60.0, 2, "4 days"),
    "lifecycle": lambda s: live.lifecycle_violations(s, FOLLOWS, "4 days"),
    "breaker": lambda s: live.drawdown_breaker(s, 1000.0, 50.0, 0.05, "4 days"),
    "pairs": lambda s: live.pair_signals(s, "view", "click", 0.0, 40.0, 1.0, 0.25, "4 days"),
    "silent": lambda s: live.jumps(s, 0.5, "4 days", idle=10 * 3600 * 1000),
}


def files(spark, folder, rows, n):
    """``n`` files, each with events of up to three days about its own time, so rows of one key come out of order across them."""
    rng = random.Random(7)
    order = sorted(rows, key=lambda r: r[1] + timedelta(days=rng.uniform(0, 3)) if r[0] < 600 else r[1])
    for k in range(n):
        part = order[k * len(order) // n : (k + 1) * len(order) // n]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{k:02d}")


def run(spark, form, path, out, per_batch, schema):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
    live_rows = FORMS[form](stream)
    live_rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return sorted(map(tuple, spark.read.schema(live_rows.schema).parquet(f"{out}/rows").collect()), key=str)


@pytest.mark.parametrize("form", FORMS)
def test_same_rows_whatever_the_batches(spark, tmp_path, form):
    """All in one batch; ten shuffled files, one a batch; four of them, then a restart and the rest."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rows, schema = made(), spark.createDataFrame([], SCHEMA).schema
        files(spark, tmp_path / "in", rows, 10)
        one = run(spark, form, f"{tmp_path}/in/*", f"{tmp_path}/one", 100, schema)
        assert one and run(spark, form, f"{tmp_path}/in/*", f"{tmp_path}/ten", 1, schema) == one
        held = tmp_path / "grows"
        held.mkdir()
        for k in range(10):
            if k == 4:
                run(spark, form, f"{held}/*", f"{tmp_path}/again", 2, schema)
            (tmp_path / "in" / f"{k:02d}").rename(held / f"{k:02d}")
        assert run(spark, form, f"{held}/*", f"{tmp_path}/again", 2, schema) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    by_user = defaultdict(list)
    for i, ts, user, kind, value, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if i < 600 and user is not None:
            by_user[user].append((ts, i, kind, value))
    if form == "lifecycle":
        want = [(u, b[1], a[2], b[2]) for u, x in by_user.items() for x in [[e for e in x if e[2]]] for a, b in zip(x, x[1:]) if b[2] not in FOLLOWS.get(a[2], ())]
        assert one == sorted(want, key=str)
    if form in ("jumps", "silent"):
        gap = timedelta(hours=10) if form == "silent" else timedelta.max
        want = [(u, b[1], b[3], a[3]) for u, x in by_user.items() for x in [[e for e in x if e[3] is not None]] for a, b in zip(x, x[1:]) if b[0] - a[0] <= gap and abs(b[3] - a[3]) >= 0.5 * abs(a[3])]
        assert one == sorted(want, key=str)


def test_ingest_is_once_for_good(spark, tmp_path):
    """Copies in a batch, in later batches and in a replay with new state; a batch that was stored but not noted."""
    rows, schema = made(), spark.createDataFrame([], SCHEMA).schema
    files(spark, tmp_path / "in", [r for r in rows if r[0] % 2 == 0] + rows[:50] * 2, 4)
    read = lambda per: spark.readStream.schema(schema).option("maxFilesPerTrigger", per).parquet(f"{tmp_path}/in/*")
    ledger = f"{tmp_path}/ledger"
    first = live.ingest_once(read(1), "event_id", ledger, f"{tmp_path}/s1")
    want = sorted({r[0] for r in rows if r[0] % 2 == 0} | set(range(50)))
    assert sorted(r.event_id for r in first.collect()) == want
    files(spark, tmp_path / "in", rows, 3)  # the same ids again and the others
    assert sorted(r.event_id for r in live.ingest_once(read(2), "event_id", ledger, f"{tmp_path}/s1").collect()) == list(range(601))
    assert sorted(r.event_id for r in live.ingest_once(read(5), "event_id", ledger, f"{tmp_path}/s2").collect()) == list(range(601))


def test_upserts_deletes_and_a_failure(spark, monkeypatch):
    schema = spark.createDataFrame([], "k long, at long, v string").schema
    df = lambda rows: spark.createDataFrame(rows, "k long, at long, v string, gone boolean")
    rows = lambda t: sorted((r.k, r["at"], r.v) for r in t.read().collect())
    path = shared_folder(spark, "versioned")
    t = versioned.Versioned(spark, path, schema, ["k"], buckets=5)
    assert rows(t) == [] and t.version() == 0
    t.upsert(df([(i, 1, "a", False) for i in range(20)] + [(3, 1, "z", False)]), newest="at", deleted="gone")
    t.upsert(df([(1, 2, "b", False), (2, 0, "old", False), (4, 5, None, True), (6, 0, None, True), (30, 1, "new", None)]), newest="at", deleted="gone")
    want = {i: (1, "a") for i in range(20)} | {1: (2, "b"), 3: (1, "z"), 30: (1, "new")}
    del want[4]
    assert rows(t) == sorted((k, *v) for k, v in want.items())

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(versioned.Versioned, "_publish", fails)
        with pytest.raises(OSError):
            t.upsert(df([(1, 9, "half", False)]), newest="at")
    again = versioned.Versioned(spark, path, schema, ["k"], buckets=5)
    assert rows(again) == sorted((k, *v) for k, v in want.items()) and again.version() == 2
    again.upsert(df([(i, 9, None, True) for i in range(31)]), newest="at", deleted="gone")
    assert rows(again) == [] and len(again.read(1).collect()) == 20
    again.upsert(df([]), newest="at")
    assert again.version() == 3


def test_a_closed_account_leaves_the_snapshot(spark):
    schema = spark.createDataFrame([], "account long, symbol string, shares double").schema
    t = versioned.Versioned(spark, shared_folder(spark, "held"), schema, ["account", "symbol"], ["account"], 3)
    df = lambda rows: spark.createDataFrame(rows, schema)
    versioned.sync_snapshot(t, *[df([(1, "A", 5.0), (1, "B", 1.0), (2, "A", 7.0), (3, "C", 2.0)])] * 2)
    today = df([(1, "A", 0.0), (1, "B", 1e-9), (2, "B", 1.0)])
    versioned.sync_snapshot(t, today, today)
    assert sorted(map(tuple, t.read().collect())) == [(2, "B", 1.0), (3, "C", 2.0)]
    versioned.sync_snapshot(t, df([]), df([(3, None, None)]))
    assert sorted(map(tuple, t.read().collect())) == [(2, "B", 1.0)]


def test_calls_don_t_grow_with_keys(spark, tmp_path):
    """Twenty thousand users in one stream: state is kept for buckets of them, and each user's events are folded on their own."""
    rows = [(2 * u + k, START + timedelta(minutes=2 * u % 977 + k), u, "view", float(10 + 90 * k), "{}") for u in range(20_000) for k in (0, 1)] + [(50_000, START + timedelta(days=9), 0, "view", 1.0, "{}")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/00")
    out = f"{tmp_path}/one"
    assert run(spark, "jumps", f"{tmp_path}/in/*", out, 1, spark.createDataFrame([], SCHEMA).schema) == sorted(((u, 2 * u + 1, 100.0, 10.0) for u in range(20_000)), key=str)
    kept = spark.read.format("statestore").load(f"{out}/state")
    assert kept.count() <= live.BUCKETS
