"""Rows of the cointegration queries against plain loops over the panel."""

import math
from collections import defaultdict
from itertools import combinations

import numpy as np

from panelwright.operators import pairs as C
from panelwright.queries import QUERIES, pairs
from panelwright.sources.panels import weekly_panel
from tests.test_known_answers import SF, plain_residual_test


#: Formation needs more pairs with enough bars in common than the smallest tables have.
LARGER = "/root/testdata/sf0.01"


def near(a, b):
    return a is None and b is None or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-5, abs_tol=2e-5)


def plain_scan(series, kappa, max_lags):
    """(i, j) -> statistics of the pairs of ``series`` (symbol -> date -> close) that pass the screen."""
    out = {}
    for i, j in combinations(sorted(series), 2):
        days = sorted(series[i].keys() & series[j].keys())
        y, x = (np.array([series[s][t] for t in days]) for s in (i, j))
        if len(days) < 20 or np.linalg.cond(np.column_stack([y, x])) < kappa:
            continue
        slope, icpt = np.polyfit(x, y, 1)
        u = y - icpt - slope * x
        stat, lag = plain_residual_test(u, max_lags)
        lam = np.polyfit(u[:-1], np.diff(u), 1)[0]
        life = None if lam >= -1e-6 else 1.0 if lam <= -1 else max(1.0, -math.log(2) / math.log(1 + lam))
        gap = stat + 3.336
        p = max(1e-6, 0.05 * math.exp(1.2 * gap) if gap < 0 else min(1.0, 0.05 + 0.15 * gap))
        out[i, j] = {"n": len(days), "slope": slope, "intercept": icpt, "r2": np.corrcoef(x, y)[0, 1] ** 2, "stat": stat, "lag": lag, "p": p, "half_life": life, "cointegrated": p <= 0.05}
    return out


def test_scan(spark):
    series = defaultdict(lambda: defaultdict(dict))
    for r in weekly_panel(spark, SF).collect():
        if r.close is not None:
            series[r.sector][r.symbol][r.bar_ts] = r.close
    # The query's screen leaves few pairs of these tables; without it all pairs of a sector are held against the loop.
    every = C.scan_pairs(weekly_panel(spark, SF).select("sector", "bar_ts", "symbol", "close"), ["sector"])
    for rows, kappa, least in ((QUERIES["ci5_scan"](spark, SF), 2.0, 1), (every, 0.0, 8)):
        want = {(sector, *k): v for sector in series for k, v in plain_scan(series[sector], kappa, 5).items()}
        got = {(r.sector, r.i, r.j): r.asDict() for r in rows.collect()}
        assert got.keys() == want.keys() and len(got) >= least
        for k, v in want.items():
            assert all(got[k][c] == v[c] for c in ("n", "lag", "cointegrated")), k
            assert all(near(got[k][c], v[c]) for c in ("slope", "intercept", "r2", "stat", "p", "half_life")), k


def test_walk_forward_choices(spark):
    """Of every window of 104 bars the pair with the smallest statistic that passes, and its spread on the 13 bars after."""
    panel = weekly_panel(spark, SF).collect()
    days = sorted({r.bar_ts for r in panel})
    close = defaultdict(dict)
    for r in panel:
        if r.close is not None:
            close[r.symbol][r.bar_ts] = r.close
    choices, want = {}, {}
    for c in range((len(days) - 104 + 12) // 13):
        window = set(days[c * 13 : c * 13 + 104])
        found = plain_scan({s: {t: v for t, v in x.items() if t in window} for s, x in close.items()}, 1.0, 2)
        passed = sorted((v["stat"], *k) for k, v in found.items() if v["cointegrated"])
        for t in days[c * 13 + 104 : c * 13 + 117]:
            want[t] = (0.0, False)
            if passed:
                _, i, j = passed[0]
                choices[c] = (i, j)
                if t in close[i] and t in close[j]:
                    want[t] = (close[i][t] - found[i, j]["intercept"] - found[i, j]["slope"] * close[j][t], True)
    choice, spreads = pairs.week_walk(spark, SF)
    assert {r.c: (r.i, r.j) for r in choice.collect()} == choices and len(choices) > 5
    got = {r.bar_ts: (r.spread, r.active) for r in spreads.collect()}
    assert got.keys() == want.keys()
    assert all(got[t][1] == v[1] and math.isclose(got[t][0], v[0], rel_tol=1e-6, abs_tol=1e-4) for t, v in want.items())


def cohort_bars(spark):
    """cohort -> symbol -> [(bar_ts, u, p, ret)], and each symbol's sector; these rows have SQL of their own (PR-4)."""
    bars = defaultdict(lambda: defaultdict(list))
    for r in pairs.week_cohorts(spark, LARGER).orderBy("bar_ts").collect():
        bars[r.c][r.symbol].append((r.bar_ts, r.u, r.p, r.ret))
    return bars, {r.symbol: r.sector for r in weekly_panel(spark, LARGER).select("symbol", "sector").distinct().collect()}


def plain_formation(bars, top, alike=lambda i, j: True):
    """cohort -> [(dist, i, j, mean, sd, n)], the ``top`` closest."""
    out = {}
    for c, symbols in bars.items():
        early = {s: {t: p for t, u, p, _ in x if u < pairs.FORM and p is not None} for s, x in symbols.items()}
        found = []
        for i, j in combinations(sorted(early), 2):
            d = np.array([early[i][t] - early[j][t] for t in sorted(early[i].keys() & early[j].keys())])
            if len(d) >= int(0.8 * pairs.FORM) and alike(i, j):
                found.append((float((d * d).mean()), i, j, float(d.mean()), math.sqrt(max(float(d.var(ddof=1)), 1e-8)), len(d)))
        out[c] = sorted(found)[:top]
    return out


def plain_cointegrated(bars, top=5):
    """cohort -> [(stat, half-life, formation row)] of the pairs that pass among the closest 100, the most negative statistic first."""
    out = {}
    for c, formed in plain_formation(bars, 100).items():
        early = {s: {t: p for t, u, p, _ in x if u < pairs.FORM} for s, x in bars[c].items()}
        tested = plain_scan(early, 0.0, 3)
        passed = [(tested[f[1], f[2]], f) for f in formed if tested.get((f[1], f[2]), {"cointegrated": False})["cointegrated"]]
        out[c] = sorted(((v["stat"], v["half_life"], f) for v, f in passed), key=lambda x: (x[0], x[2][1], x[2][2]))[:top]
    return out


def plain_strategy(bars, formed, enter=1.0, leave=0.5, bps=10.0):
    """bar -> net return, the mean over cohorts; pairs are opened, held, closed and charged by a loop over bars."""
    nets = defaultdict(list)
    for c, chosen in formed.items():
        earned, weights, acts, traded = defaultdict(float), defaultdict(float), defaultdict(int), 0
        for _, i, j, mean, sd, _ in chosen:
            a, b = ({t: (p, r or 0.0) for t, u, p, r in bars[c][s] if u >= pairs.FORM} for s in (i, j))
            days = sorted(a.keys() & b.keys())
            traded += bool(days)
            pos, weight = 0, 1.0
            for k, t in enumerate(days):
                z, last = (a[t][0] - b[t][0] - mean) / sd, k == len(days) - 1
                ret = -pos * (a[t][1] - b[t][1])
                earned[t] += weight * ret if abs(ret) > 1e-12 else ret
                weights[t] += weight if abs(ret) > 1e-12 else 1.0
                weight = weight * (1 + ret) if abs(ret) > 1e-12 else 1.0
                if pos == 0 and abs(z) > enter and not last:
                    pos, done = int(np.sign(z)), days[k + 1]
                elif pos and (last or np.sign(z) != pos or abs(z) <= leave):
                    pos, done = 0, t if last else days[k + 1]
                else:
                    continue
                acts[done] += 1
        for t in earned:
            nets[t].append(earned[t] / max(1e-8, weights[t]) - acts[t] * 2 * bps / 1e4 / traded)
    return {t: sum(v) / len(v) for t, v in nets.items()}


def test_cointegrated_formation(spark):
    bars, _ = cohort_bars(spark)
    want = {(c, place): v for c, found in plain_cointegrated(bars).items() for place, v in enumerate(found, 1)}
    got = {(r.c, r.place): r for r in QUERIES["ci8_cointegrated_pairs"](spark, LARGER).collect()}
    assert got.keys() == want.keys() and len(got) > 20
    for k, (stat, life, (_, i, j, mean, sd, n)) in want.items():
        r = got[k]
        assert (r.i, r.j, r.n) == (i, j, n) and all(near(x, y) for x, y in ((r.stat, stat), (r.half_life, life), (r.mean, mean), (r.sd, sd))), k


def test_configurations(spark):
    bars, sector = cohort_bars(spark)
    forms = {
        "T2": plain_formation(bars, 2), "T5": plain_formation(bars, 5), "same_sector": plain_formation(bars, 5, lambda i, j: sector[i] == sector[j]),
        "cointegrated": {c: [f for _, _, f in found] for c, found in plain_cointegrated(bars).items()},
    }
    got = {r.config: r for r in QUERIES["pr11_configurations"](spark, LARGER).collect()}
    assert got.keys() == forms.keys()
    for name, formed in forms.items():
        net = np.array(list(plain_strategy(bars, formed).values()))
        assert got[name].n == len(net) > 10 and near(got[name].total, net.sum()) and near(got[name].sharpe, net.mean() / net.std(ddof=1) * math.sqrt(52)), name


def test_gated_spread(spark):
    """The gate over the walk's spread, bar by bar; the spread itself is held against a loop above."""
    rows = pairs.week_walk(spark, SF)[1].orderBy("bar_ts").collect()
    s, got = [r.spread for r in rows], {r.bar_ts: r for r in QUERIES["ci9_gated_spread"](spark, SF).collect()}
    assert len(got) == len(rows)
    state, counts, was = [], np.zeros((3, 3), int), (0.0, 0.0)
    gated_bars = 0
    for t, r in enumerate(rows):
        own = np.array(s[max(0, t - 59) : t + 1])
        z = (s[t] - own.mean()) / (own.std(ddof=1) + 1e-8) if len(own) == 60 else s[t] / (1 + 1e-8)
        moved = (s[t] - s[t - 4]) / abs(s[t - 4]) if t >= 4 and s[t - 4] else 0.0
        state.append(2 if moved >= 0.05 else 0 if moved <= -0.05 else 1)
        if t >= 4:
            counts[state[t - 4], state[t]] += 1
        row = counts[state[t]]
        signal = None if got[r.bar_ts].signal is None else (row[2] - row[0]) / row.sum() if row.sum() else 0.0
        raw = (1.0 if z < -1.5 else -1.0 if z > 1.5 else 0.0) if r.active else 0.0
        against = signal is not None and (raw == 1 and signal < -0.05 or raw == -1 and signal > 0.05)
        gated = 0.0 if against else raw
        change = s[t] - s[t - 1] if t else 0.0
        g = got[r.bar_ts]
        assert (g.raw, g.gated) == (raw, gated) and math.isclose(g.z, z, rel_tol=1e-5, abs_tol=1e-5) and near(g.signal, signal)
        assert math.isclose(g.raw_return, was[0] * change, rel_tol=1e-5, abs_tol=1e-4) and math.isclose(g.gated_return, was[1] * change, rel_tol=1e-5, abs_tol=1e-4)
        was = (raw, gated)
        gated_bars += against
    signals = [got[r.bar_ts].signal for r in rows]
    assert signals[0] is None and signals[-1] is not None and all(x is not None for x in signals[signals.index(next(x for x in signals if x is not None)) :])
    assert gated_bars > 0


def test_cluster_labels(spark):
    """A fixed point of k-means: every row is nearest to the mean of its own state, in standardised features, and states ascend by trailing return."""
    from panelwright.operators import regime
    from panelwright.queries.studies import hour_features

    names = ["wret", "atr", "rel"]
    rows = regime.cluster_labels(hour_features(spark, SF), names).collect()
    x = np.array([[r[c] for c in names] for r in rows])
    x, state = (x - x.mean(0)) / x.std(0, ddof=1), np.array([r.state for r in rows])
    centres = np.array([x[state == k].mean(0) for k in range(3)])
    nearest = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (nearest[np.arange(len(x)), state] <= nearest.min(1) + 0.05).mean() > 0.99
    assert (np.diff(centres[:, 0]) > 0).all()
    assert QUERIES["rg2_cluster_labels"](spark, SF).count() == len(rows)
