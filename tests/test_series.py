"""Scans in blocks of time and as-of joins against plain loops, with series longer than any block."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelwright.operators import scan as S
from panelwright.operators import windows as W


def near(a, b):
    return a is None and b is None or a is not None and b is not None and abs(a - b) <= 1e-9 * max(1, abs(b))


@pytest.mark.parametrize("span", [5, 1000, 5000])
def test_exponential_average_of_a_long_span(spark, span):
    """8,000 bars, a span that reaches back over all of them."""
    rng = random.Random(3)
    bars = [("A", i, rng.gauss(0, 0.02)) for i in range(8000)] + [("B", 5 * i, 0.5) for i in range(7)]
    rows = spark.createDataFrame(bars, "symbol string, bar_ts long, ret double")
    a, want, state = 2.0 / (span + 1), {}, {}
    for s, t, x in bars:
        state[s] = x * x if s not in state else (1 - a) * state[s] + a * x * x
        want[s, t] = (state[s] * 252) ** 0.5
    for per_block in (100, 50_000):
        got = {(r.symbol, r.bar_ts): r.vol for r in W.ewma_unbounded(rows, "ret", span, 252, "vol", per_block).collect()}
        assert got.keys() == want.keys() and all(near(got[k], want[k]) for k in want)


def test_exponential_average_with_nulls(spark):
    xs = [None, None, 4.0, None, 1.0] + [None] * 30 + [2.0, 8.0]
    rows = spark.createDataFrame([("A", i, x, "kept") for i, x in enumerate(xs)] + [(None, 1, 3.0, "null key")], "k string, t long, x double, note string")
    got = {(r.k, r.t): r.out for r in S.exponential(rows, "x", 0.5, ["k"], ["t"], "out", 4).collect()}
    state = None
    for i, x in enumerate(xs):
        state = state if x is None else x if state is None else 0.5 * state + 0.5 * x
        assert near(got["A", i], state)
    assert got[None, 1] == 3.0


@pytest.mark.parametrize("per_block", [3, 1000])
def test_running_values(spark, per_block):
    """Gaps in time, many rows of one time, nulls and a null key."""
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([0, 1, 50, 51, 1000]) + rng.randrange(3), i, rng.choice([None, 1.5, -2.0, 0.5])) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, t long, i long, x double")
    columns = {"total": ("sum", F.col("x")), "most": ("max", F.col("x")), "least": ("min", F.col("x")), "times": ("product", F.col("x")), "known": ("last", F.col("x")), "before": ("lag", F.col("x"))}
    got = {r.i: r for r in S.running(df, ["k"], ["t", "i"], columns, per_block).collect()}
    assert len(got) == len(rows)
    seen = {}
    for k, t, i, x in sorted(rows, key=lambda r: (r[1], r[2])):
        old = seen.setdefault(k, [])
        r = got[i]
        assert r.before == (old[-1] if old else None)
        old.append(x)
        xs = [v for v in old if v is not None]
        product = 1.0
        for v in xs:
            product *= v
        assert near(r.total, sum(xs) if xs else None) and near(r.times, product if xs else None)
        assert (r.most, r.least, r.known) == ((max(xs), min(xs), xs[-1]) if xs else (None, None, None))


def test_blocks_stay_small_however_long_the_series(spark):
    for n in (1_000, 20_000):
        rows = spark.range(n).select(F.lit("one").alias("k"), F.col("id").alias("t"))
        assert S.blocked(rows, ["k"], "t", 200).groupBy("k", "__b").count().agg(F.max("count")).first()[0] <= 201
    assert S.running(spark.range(0).select(F.lit("a").alias("k"), F.col("id").alias("t")), ["k"], ["t"], {"n": ("sum", F.lit(1))}).count() == 0


@pytest.mark.parametrize("forward, strict, tolerance, per_block", [(False, False, None, 4), (True, False, None, 4), (False, True, 20, 1000), (True, True, 20, 7)])
def test_asof_against_loop(spark, forward, strict, tolerance, per_block):
    rng = random.Random(4)
    key = lambda: rng.choice(["hot"] * 6 + ["b", "c", None])
    left = [(i, key(), rng.choice([None, *range(60)] + [200])) for i in range(80)] + [(500, "hot", 30)] * 2
    right = [(key(), rng.choice([None, *range(0, 60, 2)]), rng.choice([None, 1, 2, 3])) for _ in range(60)]
    a = spark.createDataFrame(left, "id long, k string, at long")
    b = spark.createDataFrame(right, "k string, t long, v long")
    got = Counter((r.id, r.k, r["at"], r.t, r.v) for r in S.asof(a, b, ["k"], "at", "t", ["t", "v"], forward, strict, tolerance, per_block).collect())
    want = Counter()
    rank = lambda v: -1 if v is None else v
    for i, k, at in left:
        fits = [] if k is None or at is None else [(t, v) for kk, t, v in right if kk == k and t is not None and (t >= at if forward else t <= at) and not (strict and t == at)]
        t, v = (min if forward else max)(fits, key=lambda x: (x[0], rank(x[1])), default=(None, None))
        if t is not None and tolerance is not None and abs(t - at) > tolerance:
            t = v = None
        want[i, k, at, t, v] += 1
    assert got == want
    assert S.asof(a, b.limit(0), ["k"], "at", "t", ["t", "v"]).filter("t is not null").count() == 0
    assert S.asof(a.limit(0), b, ["k"], "at", "t", ["t", "v"]).count() == 0


@pytest.mark.parametrize("n, per_block", [(10_000, 50), (7, 20), (1, 20)])
def test_order_statistics_of_long_windows(spark, n, per_block):
    """A window of 10,000 bars over 25,000, and short ones over many blocks; ties, a null, a short series."""
    import bisect

    rng = random.Random(6)
    bars = [("A", i, None if i == 12 else float(rng.randrange(500))) for i in range(25_000 if n > 100 else 300)] + [("B", i, 1.0) for i in range(5)]
    rows = spark.createDataFrame(bars, "symbol string, t long, x double").repartition(6)
    got = {(r.symbol, r.t): (r.med, r.share) for r in S.order_statistics(rows, ["symbol"], ["t"], "x", n, "med", "share", per_block).collect()}
    assert len(got) == len(bars)
    for name in "AB":
        xs, window = [x for s, _, x in bars if s == name], []
        for i, x in enumerate(xs):
            if x is not None:
                bisect.insort(window, x)
            if i >= n and xs[i - n] is not None:
                window.pop(bisect.bisect_left(window, xs[i - n]))
            want = (None, None)
            if len(window) == n and x is not None:
                want = ((window[(n - 1) // 2] + window[n // 2]) / 2, bisect.bisect_right(window, x) / n)
            assert got[name, i] == pytest.approx(want) if want[0] is not None else got[name, i] == want
