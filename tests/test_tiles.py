"""Products of tiles and closest pairs against numpy over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions.maths import half_up
from panelwright.operators import pairs, quantiles, tiles


def made(symbols, bars, holes, seed=1):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(0, 0.02, (symbols, bars)), axis=1) + rng.uniform(0, 3, (symbols, 1))
    x[rng.random(x.shape) < holes] = np.nan
    return [f"S{(i * 37) % symbols:03d}" for i in range(symbols)], x


def frame(spark, names, x):
    rows = [(n, t, None if np.isnan(v) else float(v), "clash") for n, line in zip(names, x) for t, v in enumerate(line) if not (np.isnan(v) and t % 2)]
    return spark.createDataFrame(rows, "symbol string, bar_ts int, close double, block string")


@pytest.mark.parametrize("side, length", [(64, 256), (5, 7)])
def test_pair_sums(spark, side, length):
    names, x = made(23, 40, 0.2)
    x[3] = np.nan
    x[4, 1:] = np.nan
    got = {(r.i, r.j): r for r in tiles.pair_sums(frame(spark, names, x), side=side, length=length).collect()}
    want = {}
    for a in range(len(names)):
        for b in range(len(names)):
            both = ~np.isnan(x[a]) & ~np.isnan(x[b])
            if names[a] < names[b] and both.any():
                p, q = x[a][both], x[b][both]
                want[names[a], names[b]] = (both.sum(), p.sum(), q.sum(), (p * p).sum(), (q * q).sum(), (p * q).sum())
    assert got.keys() == want.keys()
    assert all(np.allclose([got[k][c] for c in tiles.SUMS], want[k], rtol=1e-12, atol=1e-12) for k in want)


def test_statistics(spark):
    names, x = made(6, 60, 0.1)
    x[0] = 2.0  # a flat series has no correlation
    x[1] = 3 * x[2]  # and one that is another's multiple no finite condition
    for r in tiles.pair_statistics(tiles.pair_sums(frame(spark, names, x))).collect():
        p, q = x[names.index(r.i)], x[names.index(r.j)]
        both = ~np.isnan(p) & ~np.isnan(q)
        p, q = p[both], q[both]
        assert np.isclose(r.dist, np.mean((p - q) ** 2)) and np.isclose(r.mean, np.mean(p - q)) and np.isclose(r.sd, max(np.std(p - q, ddof=1), 1e-4))
        if np.ptp(q) == 0:
            assert r.slope is None and r.corr is None
        else:
            assert np.isclose(r.slope, np.polyfit(q, p, 1)[0])
        k = np.linalg.cond(np.column_stack([p, q]))
        assert r.kappa is None if k > 1e8 else np.isclose(r.kappa, k, rtol=1e-6)


def test_overlapping_windows(spark):
    """Windows of 12 dates every 4, with series that begin late, end early or have gaps."""
    names, x = made(7, 43, 0.3)
    x[1, :20] = np.nan
    x[2, 9:] = np.nan
    x[3, 8:30] = np.nan
    got = {(r.c, r.i, r.j): r for r in tiles.window_sums(frame(spark, names, x), 12, 4, side=3).collect()}
    want = {}
    for c in range((43 - 12) // 4 + 1):
        for a in range(7):
            for b in range(7):
                p, q = x[a][4 * c : 4 * c + 12], x[b][4 * c : 4 * c + 12]
                both = ~np.isnan(p) & ~np.isnan(q)
                if names[a] < names[b] and both.any():
                    want[c, names[a], names[b]] = (both.sum(), (p[both] * q[both]).sum())
    assert got.keys() == want.keys() and all(np.allclose([got[k].n, got[k].sxy], want[k]) for k in want)
    assert tiles.window_sums(frame(spark, names, x), 44, 4).count() == 0


def test_closest_pairs_touch_few(spark, monkeypatch):
    """The same pairs as all of them give, with a small share measured; incomplete series take no part."""
    names, x = made(300, 64, 0.0)
    x[7, 5] = np.nan
    touched = []
    monkeypatch.setattr(tiles, "_met", lambda *a, f=tiles._met: touched.append(f(*a)) or touched[-1])
    got = [(r.i, r.j) for r in tiles.closest_pairs(frame(spark, names, x), 15).orderBy("place").collect()]
    d = {(names[a], names[b]): np.mean((x[a] - x[b]) ** 2) for a in range(300) for b in range(300) if names[a] < names[b] and 7 not in (a, b)}
    assert got == sorted(d, key=lambda k: (d[k], k))[:15]
    assert touched[0].count() < 0.2 * len(d)


def test_closest_pairs_where_guesses_are_too_few_or_all_alike(spark):
    names, x = made(4, 10, 0.0)
    got = [(r.i, r.j) for r in tiles.closest_pairs(frame(spark, names, x), 50).orderBy("place").collect()]
    d = {(names[a], names[b]): np.mean((x[a] - x[b]) ** 2) for a in range(4) for b in range(4) if names[a] < names[b]}
    assert got == sorted(d, key=lambda k: (d[k], k))
    same = frame(spark, [f"S{i}" for i in range(12)], np.ones((12, 6)))
    assert [(r.i, r.j) for r in tiles.closest_pairs(same, 3).orderBy("place").collect()] == [("S0", "S1"), ("S0", "S10"), ("S0", "S11")]
    assert tiles.closest_pairs(same.limit(0), 3).count() == 0


def test_sketches_merge_within_their_error(spark):
    """Two levels of merging, a group with most values, ties, nulls and NaN."""
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.8 else "b", i % 30, rng.choice([rng.gauss(0, 1), 5.0, None, float("nan")])) for i in range(40_000)]
    df = spark.createDataFrame(rows, "k string, day int, x double")
    days = quantiles.sketched(df, ["k", "day"], "x")
    weeks = quantiles.merged(days.withColumn("day", days.day % 7), ["k", "day"])
    shares = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]
    for sketches in (quantiles.sketched(df, ["k"], "x"), quantiles.merged(weeks, ["k"])):
        found = quantiles.points(sketches, shares).collect()
        assert len(found) == 12
        for r in found:
            xs = [x for k, _, x in rows if k == r.k and x is not None and x == x]
            assert r.n == len(xs)
            assert sum(x < r.value for x in xs) / len(xs) <= r.share + 2 * quantiles.rank_error() and sum(x <= r.value for x in xs) / len(xs) >= r.share - 2 * quantiles.rank_error()
    assert quantiles.sketched(df.limit(0), ["k"], "x").count() == 0


def test_all_pairs_in_blocks(spark):
    from panelwright.plans.explain import every_pair_joins

    names = [f"N{random.Random(i).random()}" for i in range(40)]
    got = pairs.all_pairs(spark.createDataFrame([(n,) for n in names], "symbol string"))
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a in names for b in names if a < b)
    assert every_pair_joins(got) == 0


@pytest.mark.parametrize("form", ["pairs", "windows"])
def test_rows_of_pairs_are_not_shuffled(spark, form):
    """What a pair's task makes goes out as it is: nothing above it but projections and filters."""
    names, x = made(60, 40, 0.1)
    rows = frame(spark, names, x)
    out = tiles.pair_statistics(tiles.pair_sums(rows) if form == "pairs" else tiles.window_sums(rows, 12, 4))
    above = out._jdf.queryExecution().optimizedPlan().toString().partition("FlatMapGroupsInArrow")
    assert above[1] and not any(word in above[0] for word in ("Join", "Aggregate", "Window", "Sort"))


def test_long_calendars_are_cut(spark):
    """Windows that reach over the cuts of a long calendar are the same ones."""
    names, x = made(5, 60, 0.2)
    rows = frame(spark, names, x)
    get = lambda length: {(r.c, r.i, r.j): (r.n, round(r.sxy, 9)) for r in tiles.window_sums(rows, 6, 2, length=length).collect()}
    assert get(24) == get(4096) != {}


def test_closest_pairs_of_noise(spark, monkeypatch):
    """Series of independent noise, whose means tell nothing: only the pairs that may be among the closest become rows."""
    x = np.random.default_rng(3).normal(0, 1, (200, 24))
    names = [f"S{i:03d}" for i in range(200)]
    touched = []
    monkeypatch.setattr(tiles, "_met", lambda *a, f=tiles._met: touched.append(f(*a)) or touched[-1])
    got = [(r.i, r.j) for r in tiles.closest_pairs(frame(spark, names, x), 10).orderBy("place").collect()]
    d = {(names[a], names[b]): np.mean((x[a] - x[b]) ** 2) for a in range(200) for b in range(a + 1, 200)}
    assert got == sorted(d, key=lambda k: (d[k], k))[:10]
    assert touched[0].count() < 0.1 * len(d)


@pytest.mark.parametrize("q", [2, 3, 7])
def test_blocks_meet_once_on_few_lines(spark, q):
    """Any two blocks are on one line, a line is a task, and a series is shuffled q + 1 times, for q (q + 1) tasks."""
    names = [f"S{i:04d}" for i in range(40 * q * q)]
    rows = spark.createDataFrame([(n, 0, 0, 1.0) for n in names], "symbol string, tile long, t int, x double")
    met = tiles._lines(rows, q, 1)._df
    assert met.count() == (q + 1) * len(names)
    lines = met.withColumn("task", F.spark_partition_id()).groupBy("part").agg(F.collect_set("block").alias("blocks"), F.collect_set("task").alias("tasks")).collect()
    assert len(lines) == q * q + q and all(len(r.blocks) == q and r.tasks == [r.part] for r in lines)
    pairs = [(a, b) for r in lines for a in r.blocks for b in r.blocks if a < b]
    assert len(pairs) == len(set(pairs)) == q * q * (q * q - 1) // 2


def test_bars_are_copied_by_tasks_not_by_symbols(spark):
    """More symbols make no more copies until a task's bars are too many; few rows make few tasks."""
    get = lambda symbols, width=83, tiles_=1, windows=1: tiles._plane(spark.range(1), symbols, None, width, tiles_, windows)
    cores = spark.sparkContext.defaultParallelism
    assert get(10) == 2 and get(0, 1) == 2
    assert get(6_000) == get(360_000) and get(60_000) ** 2 + get(60_000) >= max(48, 4 * cores)
    q = get(10_000_000)
    assert q > get(360_000) and q * tiles.HELD >= 10_000_000 * 83


@pytest.mark.parametrize("form", ["pr1_tile_products", "jn13_window_products"])
def test_rows_of_pairs_are_rounded_by_whole_numbers(spark, form):
    """What is rounded by decimals is only what whole numbers can't hold."""
    import re

    from panelwright.queries import QUERIES

    plan = QUERIES[form](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().partition("FlatMapGroupsInArrow")[0]
    assert re.search(r"\bround\(", plan)
    assert all(part.rstrip().endswith("ELSE") for part in re.split(r"\bround\(", plan)[:-1])


def test_half_up(spark):
    """As SQL's round: halves away from zero, what is just below a half not; numbers too large for it, infinite and NaN as they are."""
    import duckdb

    rng = random.Random(5)
    xs = [0.0, -0.0, 5e-7, -5e-7, 0.5e-6 - 1e-22, 1.5e-6, 2.5e-6, -2.5e-6, 1.0000005, 123456.7890125, -0.2e-6, 1e8 - 1e-7, 1e8, -3.3e15, 1.7e308, float("inf"), float("-inf"), float("nan"), None]
    xs += [rng.gauss(0, 10.0**k) for k in range(-7, 7) for _ in range(200)]
    got = [r.y for r in spark.createDataFrame(list(enumerate(xs)), "k int, x double").select("k", half_up(F.col("x"), 6).alias("y")).orderBy("k").collect()]
    want = [r[0] for r in duckdb.execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [xs]).fetchall()]
    same = lambda a, b: a is b is None or a is not None and b is not None and (a == b or a != a and b != b)
    assert [(x, a, b) for x, a, b in zip(xs, got, want) if not same(a, b)] == []
    assert all(math.copysign(1, y) == 1 for y in got if y == 0)
