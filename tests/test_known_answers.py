"""Known answers, solves against numpy, and what must not depend on the future."""

import math
from datetime import timedelta
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions.maths import normal_cdf, normal_quantile, wilson
from panelwright.operators import backoffice as B
from panelwright.operators import inference as I
from panelwright.operators import pairs as C
from panelwright.operators import performance as P
from panelwright.operators import quality as Q
from panelwright.operators import regime as R
from panelwright.operators import windows as W
from panelwright.queries import QUERIES, pairs, signals
from panelwright.sources import shared
from panelwright.sources.panels import weekly_panel

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_wilson_and_effective_n(spark):
    low, high = one(spark, *wilson(F.lit(416 / 656), F.lit(656 / 20)))
    assert abs(low - 0.463) < 0.002 and abs(high - 0.777) < 0.002


def test_p_value_correction(spark):
    real = spark.createDataFrame([("a", 9.0)], "symbol string, v double")
    null = spark.createDataFrame([("a", i / 1000) for i in range(999)], "symbol string, v double")
    got = I.empirical(real, null, "v").first()
    assert got.p == 1 / 1000 and got.percentile == 100


def test_deflated_ratio(spark):
    s, trials, var, skew, kurt, n = 0.6022, 29, 0.0125, -0.15, 0.05, 1739
    g = 0.5772156649015329
    q = normal_quantile
    bench = F.lit(math.sqrt(var)) * ((1 - g) * q(F.lit(1 - 1 / trials)) + g * q(F.lit(1 - 1 / (trials * math.e))))
    k = math.sqrt(252)
    se = F.lit(math.sqrt((1 - skew * s / k + (kurt + 2) / 4 * (s / k) ** 2) / (n - 1)) * k)
    assert abs(one(spark, normal_cdf((F.lit(s) - bench) / se))[0] - 0.835) < 0.05
    assert abs(one(spark, normal_cdf(F.lit(0.0)))[0] - 0.5) < 1e-7


def test_sizing_and_drift(spark):
    rows = spark.createDataFrame([(0.4, 200.0), (-0.3, 100.0), (0.4, 0.0)], "w double, p double")
    got = [r[0] for r in rows.select(B.target_shares(F.col("w"), F.lit(100_000.0), F.col("p"))).collect()]
    assert got == [200, -300, 0]
    held = spark.createDataFrame([("x", "A", 1.0, 75.0, 0.0), ("x", "B", 1.0, 25.0, 0.0)], "account string, symbol string, shares double, price double, cash double")
    assert {r.symbol: r.weight for r in B.marked(held, "account").collect()} == {"A": 0.75, "B": 0.25}


def test_artifacts_and_costs(spark):
    bars = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 0.0)] * 3 + [(1.0, 2.0, 1.0, 1.5, 5.0), (1.0, 1.0, 1.0, 1.0, None)], "open double, high double, low double, close double, volume double")
    assert Q.split_artifacts(bars).filter("not artifact").count() == 2
    pos = spark.createDataFrame([("a", i, p, 0.0) for i, p in enumerate([0.0, 1.0, 1.0, 0.0])], "symbol string, bar_ts int, pos double, ret double")
    rows = P.earned(pos, ["symbol"]).orderBy("bar_ts").collect()
    assert [round(-r.net * 1e4, 9) for r in rows] == [0, 10, 0, 10] and sum(r.turnover for r in rows) == 2


def test_condition_number(spark):
    x = spark.createDataFrame([(1.0, 0.0, 10.0, 0.0), (0.0, 1.0, 0.0, 1.0)], "a double, b double, c double, d double")
    got = x.agg(C.gram_condition("a", "b"), C.gram_condition("c", "d")).first()
    assert abs(got[0] - 1) < 1e-9 and abs(got[1] - 10) < 1e-9


def test_critical_values(spark):
    assert C.critical_value(1) == -3.336 and abs(C.critical_value(5, 0) - (-3.896 - 4 * 0.35)) < 1e-12
    p = [one(spark, C.approximate_p(F.lit(s)))[0] for s in (-3.336, -5.336, 9.0)]
    assert abs(p[0] - 0.05) < 1e-9 and abs(p[1] - 0.05 * math.exp(-2.4)) < 1e-9 and p[2] == 1.0


def plain_residual_test(u, max_lags=5):
    d, best = np.diff(u), (math.inf, None, None)
    for lag in range(1, min(max_lags + 1, (len(u) - 5) // 2)):
        y = d[lag:]
        x = np.column_stack([u[lag:-1], *[d[lag - i : len(d) - i] for i in range(1, lag)]])
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        rss = float(((y - x @ beta) ** 2).sum())
        se = math.sqrt(rss / (len(y) - lag) * np.linalg.inv(x.T @ x)[0, 0])
        aic = len(y) * math.log(rss / len(y)) + 2 * lag
        if aic < best[0]:
            best = (aic, beta[0] / se, lag)
    return best[1:]


def test_cases_of_cointegration(spark):
    """Independent walks, a cointegrated pair (slope 1.5), correlated walks: against numpy, and the verdicts that they must get."""
    rng, rows, series = np.random.default_rng(7), [], {}
    walk = lambda: np.cumsum(rng.normal(size=1000)) + 100
    x = walk()
    shared_step = rng.normal(size=1000)
    cases = {"A": (walk(), walk()), "B": (5 + 1.5 * x + rng.normal(size=1000), x), "E": (100 + np.cumsum(shared_step + 0.25 * rng.normal(size=1000)), 100 + np.cumsum(shared_step + 0.25 * rng.normal(size=1000)))}
    for name, (y, z) in cases.items():
        series[name] = (y, z)
        rows += [(name, t, s, float(v)) for s, side in (("P1", y), ("P2", z)) for t, v in enumerate(side)]
    df = spark.createDataFrame(rows, "kind string, bar_ts int, symbol string, close double")
    got = {r.kind: r for r in C.scan_pairs(df, ["kind"]).collect()}
    for name, (y, z) in series.items():
        slope, icpt = np.polyfit(z, y, 1)
        stat, lag = plain_residual_test(y - icpt - slope * z)
        assert abs(got[name].slope - slope) < 1e-6 and got[name].lag == lag and abs(got[name].stat - stat) < 1e-5
    assert got["B"].cointegrated and abs(got["B"].slope - 1.5) < 0.05 and not got["A"].cointegrated and not got["E"].cointegrated


def test_walk_forward_reads_no_future(spark):
    whole = {r.bar_ts: (r.spread, r.active) for r in pairs.week_walk(spark, SF)[1].collect()}
    cut = sorted(whole)[len(whole) // 2]
    early = {r.bar_ts: (r.spread, r.active) for r in C.walk_forward_pairs(weekly_panel(spark, SF).filter(F.col("bar_ts") <= cut), 104, 13, 1.0, 2)[1].collect()}
    assert len(early) > 50 and all(abs(whole[t][0] - v[0]) < 1e-6 and whole[t][1] == v[1] for t, v in early.items())
    assert QUERIES["ci9_gated_spread"](spark, SF).count() == len(whole)


@pytest.mark.parametrize("name, xs", [("st15_six_factors", ["mkt", "smb", "hml", "mom", "srv", "lrv"]), ("st16_macro_risk", ["def", "term", "mkt"])])
def test_factor_models_against_numpy(spark, name, xs):
    from panelwright.queries.inference import week_market_factors, week_returns

    rows = week_returns(spark, SF).select("symbol", "bar_ts", "ret").join(week_market_factors(spark, SF), "bar_ts").dropna().orderBy("bar_ts").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.symbol].append(r)
    got = {(r.symbol, r.factor): r for r in QUERIES[name](spark, SF).collect()}
    for symbol, rs in list(by.items())[:4]:
        x = np.array([[1.0, *[r[c] for c in xs]] for r in rs])
        y = np.array([r.ret for r in rs])
        inv = np.linalg.pinv(x.T @ x)
        beta = inv @ x.T @ y
        u = y - x @ beta
        g = x * u[:, None]
        s = g.T @ g
        for lag in range(1, 7):
            c = g[lag:].T @ g[:-lag]
            s += (1 - lag / 7) * (c + c.T)
        t = beta / np.sqrt(np.maximum(1e-12, np.diag(inv @ s @ inv)))
        for k, f in enumerate(["const", *xs]):
            assert abs(got[symbol, f].beta - beta[k]) < 1e-4 * max(1, abs(beta[k])) and abs(got[symbol, f].t - t[k]) < 1e-3 * max(1, abs(t[k]))


def test_clusters_keep_the_invariant(spark):
    got = QUERIES["rg2_cluster_labels"](spark, SF).groupBy("state").agg(F.avg("wret").alias("m"), F.count(F.lit(1)).alias("n")).orderBy("state").collect()
    assert [r.state for r in got] == [0, 1, 2] and got[0].m < got[1].m < got[2].m


def test_resampling_draws_with_repeats(spark):
    n = 200
    k = spark.range(1000 * n).select((F.col("id") % n).alias("k"), F.floor(F.col("id") / n).alias("draw"))
    distinct = k.select("draw", I.picked(F.lit(n), F.col("draw"), F.col("k")).alias("p")).groupBy("draw").agg(F.count_distinct("p").alias("d")).agg(F.avg("d")).first()[0]
    assert abs(distinct / n - (1 - (1 - 1 / n) ** n)) < 0.01  # about 63 %
    row = QUERIES["st12_bootstrap_mean"](spark, SF).first()
    assert row.lo < row.mid < row.hi and row.lo < row["mean"] < row.hi
    for r in QUERIES["st8_block_bootstrap"](spark, SF).collect():
        assert r.sharpe_lo < r.sharpe_mid < r.sharpe_hi and r.max_drawdown_lo <= r.max_drawdown_hi


def test_cohort_weights_against_loop(spark):
    rows = sorted(pairs.week_trades(spark, SF).collect(), key=lambda r: (r.c, r.i, r.j, r.bar_ts))
    by = defaultdict(dict)
    for r in rows:
        by[r.c, r.i, r.j][r.bar_ts] = r
    want = defaultdict(lambda: [0.0, 0.0, 0.0])
    m = defaultdict(int)
    for key, days in by.items():
        m[key[0]] += 1
        w, live, before, order = 1.0, False, 0.0, sorted(days)
        for t, day in enumerate(order):
            r = days[day]
            if abs(r.ret) > 1e-12:
                w = w * (1 + before) if live else 1.0
                live = True
            else:
                w, live = 1.0, False
            before = r.ret
            cell = want[key[0], day]
            cell[0] += w * r.ret
            cell[1] += w
            done = day if r.action == "HORIZON" else order[t + 1] if r.action in ("ENTER", "EXIT") else None
            if done:
                want[key[0], done][2] += 2 * 10 / 1e4
    got = {(r.c, r.bar_ts): r for r in C.cohort_returns(pairs.week_trades(spark, SF)).collect()}
    assert got.keys() == want.keys()
    for k, (a, b, cost) in want.items():
        assert math.isclose(got[k].gross, a / max(1e-8, b), rel_tol=1e-6, abs_tol=1e-9) and abs(got[k].cost - cost / m[k[0]]) < 1e-12


def test_configurations_hold_the_plain_strategy(spark):
    got = {r.config: r for r in QUERIES["pr11_configurations"](spark, SF).collect()}
    plain = QUERIES["pr8_strategy_returns"](spark, SF)
    assert set(got) == {"T2", "T5", "same_sector", "cointegrated"} and got["T5"].n == plain.count()
    for r in QUERIES["ci8_cointegrated_pairs"](spark, SF).collect():
        assert r.place <= 5 and r.stat < 0
    stats = [r.stat for r in QUERIES["ci5_scan"](spark, SF).collect()]
    assert stats == sorted(stats)


def test_live_pairs_against_loop(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").filter("value is not null and user_id is not null and event_type in ('view', 'click')").collect()
    by, want, passed = defaultdict(list), set(), max(r.ts for r in rows) - timedelta(hours=1)
    for r in rows:
        by[r.user_id].append(r)
    for user, events in by.items():
        x = y = None
        pos = 0
        for r in sorted(events, key=lambda r: (r.ts, r.event_id)):
            x, y = (r.value, y) if r.event_type == "view" else (x, r.value)
            if x is None or y is None:
                continue
            z = (x - y) / 40
            was, side = pos, (z > 0) - (z < 0)
            if pos:
                pos = 0 if side != pos or abs(z) <= 0.25 else pos
                action = "HOLD" if pos else "EXIT"
            else:
                pos = side if abs(z) > 1 else 0
                action = "ENTER" if pos else "HOLD"
            if r.ts < passed:
                want.add((user, r.event_id, round(z, 5), was, action))
    got = {(r.user_id, r.event_id, round(r.z, 5), r.held, r.action) for r in QUERIES["sm7_live_pairs"](spark, SF).collect()}
    assert got == want and {w[-1] for w in want} == {"ENTER", "EXIT", "HOLD"}


def test_extension_points_are_functions(spark):
    """A strategy is any function from panel to weights, a null any pipeline that keeps its draws apart, a rule any function to violations."""
    panel = weekly_panel(spark, SF)
    strategy = lambda p: p.withColumn("weight", F.lit(0.1))
    rules = [lambda w: w.filter("abs(weight) > 0.05").select(F.lit("SINGLE").alias("rule"), "symbol"), lambda w: w.filter("weight < 0").select(F.lit("SHORT").alias("rule"), "symbol")]
    found = Q.violations({"single": rules[0](strategy(panel)).withColumnRenamed("symbol", "key"), "short": rules[1](strategy(panel)).withColumnRenamed("symbol", "key")})
    assert {r.check for r in found.select("check").distinct().collect()} == {"single"}
    labelled = R.labels(panel, 4, 0.05)
    base = spark.createDataFrame([], "symbol string, bar_ts date, base double")
    with_base = W.reindexed(labelled, base, ["symbol", "bar_ts"], {"base": 0.0})
    assert with_base.filter("base <> 0").count() == 0


def test_unbounded_ewma_equals_the_fold(spark):
    rng = np.random.default_rng(3)
    r = rng.normal(size=700) * 0.02
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(r)], "symbol string, bar_ts int, ret double")
    got = [x.v for x in W.ewma_unbounded(df, "ret", 32, 252, "v").orderBy("bar_ts").collect()]
    var, want = r[0] ** 2, []
    for i, v in enumerate(r):
        var = var if i == 0 else var * (31 / 33) + v * v * (2 / 33)
        want.append(math.sqrt(var * 252))
    assert np.allclose(got, want, rtol=1e-10)


def test_shared_folder_needs_its_setting_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError):
        shared.shared_folder(Session(), "x")
    assert shared.panel_key(["b", "a"], "1", "2", "p") == shared.panel_key(["a", "b"], "1", "2", "p")
    assert signals.PERIODS
