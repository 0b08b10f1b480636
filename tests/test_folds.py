"""Folds over time against plain loops, and streams against batches."""

from collections import defaultdict

from panelwright.operators import factors as A
from panelwright.operators import pairs as C
from panelwright.queries import QUERIES, factors, pairs

SF = "/root/testdata/sf0.001"


def test_hysteresis_against_loop(spark):
    ranks = factors.week_returns(spark, SF).withColumn("mom", A.skip_momentum(26, 4)).filter("mom is not null").withColumn("rnk", factors.W.rank("mom"))
    days = defaultdict(list)
    for x in ranks.select("bar_ts", "symbol", "rnk").collect():
        days[x.bar_ts].append((x.rnk, x.symbol))
    want, l, s = {}, [], []
    for day in sorted(days):
        order = sorted(days[day])
        keep = [n for k, n in order if n in l and k <= 4]
        longs = (keep + [n for _, n in order if n not in keep])[:2]
        back = order[::-1]
        keep = [n for k, n in back if n in s and k >= 4 and n not in longs]
        s = (keep + [n for _, n in back if n not in keep and n not in longs])[:2]
        l = longs
        want[day] = (l, s)
    got = {x.bar_ts: (x.longs, x.shorts) for x in factors.week_hysteresis(spark, SF).collect()}
    assert got == want and len(got) > 50


def test_pair_trades_against_loop(spark):
    rows = pairs.week_cohorts(spark, SF)
    formed = C.form_pairs(rows, 52, 5).collect()
    later = defaultdict(dict)
    for x in rows.filter("u >= 52").collect():
        later[x.c, x.symbol][x.bar_ts] = (x.p, x.ret or 0.0)
    want = {}
    for f in formed:
        a, b = later[f.c, f.i], later[f.c, f.j]
        days, pos = sorted(a.keys() & b.keys()), 0
        for day in days:
            z = (a[day][0] - b[day][0] - f["mean"]) / f.sd
            ret, was = -pos * (a[day][1] - b[day][1]), pos
            if pos == 0:
                act = "ENTER" if abs(z) > 1 and day != days[-1] else "HOLD"
                pos = (1 if z > 0 else -1) if act == "ENTER" else 0
            elif day == days[-1]:
                act, pos = "HORIZON", 0
            elif (z > 0) - (z < 0) != pos or abs(z) <= 0.5:
                act, pos = "EXIT", 0
            else:
                act = "HOLD"
            want[f.c, f.i, f.j, day] = (was, round(ret, 5), act)
    got = {(x.c, x.i, x.j, x.bar_ts): (x.held, round(x.ret, 5) + 0.0, x.action) for x in C.trade_pairs(rows, C.form_pairs(rows, 52, 5), 52, 1.0).collect()}
    assert got == want and len({v[2] for v in got.values()}) >= 3


def test_strategy_returns(spark):
    out = QUERIES["pr8_strategy_returns"](spark, SF).collect()
    assert out and all(x.cohorts >= 1 for x in out)
