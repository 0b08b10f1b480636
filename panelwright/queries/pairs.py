"""Registered queries of pairs, cointegration and the streaming twins, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.maths import sharpe_ratio
from ..operators import pairs as C
from ..operators import performance as P
from ..operators import regime as R
from ..sources.panels import table, weekly_panel
from ..sources.shared import shared_folder
from ..streaming import live
from .panel import HOUR, QUERIES, WEEK, r, register, rounded, week_returns

#: Weeks of formation, trading, and between cohorts; pairs kept of each.
FORM, TRADE, STEP, TOP = 52, 26, 26, 5
COHORTS = f"""
cal AS (SELECT bar_ts, row_number() OVER (ORDER BY bar_ts) - 1 AS t, count(*) OVER () AS total FROM (SELECT DISTINCT bar_ts FROM panel)),
ch AS (SELECT c, symbol, bar_ts, close, ret, t - {STEP} * c AS u FROM rets JOIN cal USING (bar_ts) JOIN (SELECT unnest(range(0, 1000)) AS c) ON t >= {STEP} * c AND t < {STEP} * c + {FORM + TRADE} AND {STEP} * c + {FORM} <= total),
np AS (SELECT *, close / first_value(close) OVER (PARTITION BY c, symbol ORDER BY bar_ts) AS p FROM ch),
ds AS (SELECT a.c, a.symbol AS i, b.symbol AS j, avg((a.p - b.p) * (a.p - b.p)) AS dist, avg(a.p - b.p) AS mean, sqrt(greatest(var_samp(a.p - b.p), 1e-8)) AS sd, count(*) AS n FROM np a JOIN np b ON a.c = b.c AND a.bar_ts = b.bar_ts AND a.symbol < b.symbol WHERE a.u < {FORM} GROUP BY 1, 2, 3 HAVING count(*) >= {int(0.8 * FORM)}),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY dist, i, j) AS place FROM ds) WHERE place <= {TOP})"""


def week_cohorts(spark, d):
    return C.cohorts(week_returns(spark, d).select("symbol", "bar_ts", "close", "ret"), FORM, TRADE, STEP)


def week_trades(spark, d):
    rows = week_cohorts(spark, d)
    return C.trade_pairs(rows, C.form_pairs(rows, FORM, TOP), FORM, 1.0)


@register("pr4_cohorts", f"WITH {WEEK}, {COHORTS} SELECT c, symbol, bar_ts, u, {r('p')} FROM np")
def _(spark, d):
    return rounded(week_cohorts(spark, d).select("c", "symbol", "bar_ts", "u", "p"))


@register("pr3_formation", f"WITH {WEEK}, {COHORTS} SELECT c, i, j, n, place, {r('dist', 'mean', 'sd')} FROM tp")
def _(spark, d):
    return rounded(C.form_pairs(week_cohorts(spark, d), FORM, TOP))


#: The trades' state, bar by bar: a recursion over each pair's trading window.
AFTER = "CASE WHEN {pos} = 0 THEN CASE WHEN abs(z) > 1 AND k < n THEN CAST(sign(z) AS INT) ELSE 0 END WHEN k = n OR sign(z) <> {pos} OR abs(z) <= 0.5 THEN 0 ELSE {pos} END"
TRADED = f"""
tx AS (SELECT tp.c, tp.i, tp.j, a.bar_ts, (a.p - b.p - tp.mean) / tp.sd AS z, coalesce(a.ret, 0) - coalesce(b.ret, 0) AS d, row_number() OVER (PARTITION BY tp.c, tp.i, tp.j ORDER BY a.bar_ts) AS k, count(*) OVER (PARTITION BY tp.c, tp.i, tp.j) AS n
  FROM tp JOIN np a ON a.c = tp.c AND a.symbol = tp.i AND a.u >= {FORM} JOIN np b ON b.c = tp.c AND b.symbol = tp.j AND b.bar_ts = a.bar_ts),
ts AS (SELECT c, i, j, k, 0 AS held, {AFTER.format(pos='0')} AS pos FROM tx WHERE k = 1 UNION ALL SELECT tx.c, tx.i, tx.j, tx.k, ts.pos, {AFTER.format(pos='ts.pos').replace('k <', 'tx.k <').replace('k =', 'tx.k =')} FROM ts JOIN tx ON tx.c = ts.c AND tx.i = ts.i AND tx.j = ts.j AND tx.k = ts.k + 1),
tt AS (SELECT tx.c, tx.i, tx.j, bar_ts, z, held, -held * d AS ret, CASE WHEN held = 0 AND pos <> 0 THEN 'ENTER' WHEN held <> 0 AND k = n THEN 'HORIZON' WHEN held <> 0 AND pos = 0 THEN 'EXIT' ELSE 'HOLD' END AS action FROM tx JOIN ts USING (c, i, j, k))"""
COHORT_RETURNS = """
w0 AS (SELECT *, abs(ret) > 1e-12 AS live, sum(CASE WHEN abs(ret) > 1e-12 THEN 0 ELSE 1 END) OVER (PARTITION BY c, i, j ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS run, CASE WHEN action = 'HORIZON' THEN bar_ts WHEN action <> 'HOLD' THEN lead(bar_ts) OVER (PARTITION BY c, i, j ORDER BY bar_ts) END AS done FROM tt),
w1 AS (SELECT *, CASE WHEN live THEN coalesce(product(1 + ret) OVER (PARTITION BY c, i, j, run, live ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) ELSE 1 END AS w FROM w0),
cm AS (SELECT c, count(*) AS m FROM (SELECT DISTINCT c, i, j FROM tt) GROUP BY 1),
cg AS (SELECT c, bar_ts, sum(w * ret) / greatest(1e-8, sum(w)) AS gross FROM w1 GROUP BY 1, 2),
ca AS (SELECT c, done AS bar_ts, count(*) AS acts FROM w1 WHERE done IS NOT NULL GROUP BY 1, 2),
cr AS (SELECT c, bar_ts, gross, coalesce(acts * 2 * 10 / 1e4 / m, 0) AS cost, gross - coalesce(acts * 2 * 10 / 1e4 / m, 0) AS net FROM cg JOIN cm USING (c) LEFT JOIN ca USING (c, bar_ts)),
sr AS (SELECT bar_ts, avg(gross) AS gross, avg(net) AS net, count(*) AS cohorts FROM cr GROUP BY 1)"""
COMPLETED = """
k0 AS (SELECT *, lead(bar_ts) OVER q AS nx, lead(z) OVER q AS nz, sum(CASE WHEN action = 'ENTER' THEN 1 ELSE 0 END) OVER (PARTITION BY c, i, j ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS trade FROM tt WINDOW q AS (PARTITION BY c, i, j ORDER BY bar_ts)),
k1 AS (SELECT c, i, j, trade, max(nx) FILTER (action = 'ENTER') AS entered, max(z) FILTER (action = 'ENTER') AS z0, max(CASE action WHEN 'HORIZON' THEN bar_ts WHEN 'EXIT' THEN nx END) AS gone, max(CASE action WHEN 'HORIZON' THEN z WHEN 'EXIT' THEN nz END) AS z1, max(CASE action WHEN 'HORIZON' THEN 'HORIZON_END' WHEN 'EXIT' THEN 'CONVERGENCE' END) AS reason FROM k0 WHERE action <> 'HOLD' GROUP BY 1, 2, 3, 4),
ct AS (SELECT c, i, j, entered, gone AS left, -sign(z0) * (z1 - z0) AS spread_return, gone - entered AS days, reason FROM k1 WHERE entered <= gone)"""
PAIRED_TRADES = f"WITH RECURSIVE {WEEK}, {COHORTS}, {TRADED}"
REPORT = "count(*) AS trades, " + r("avg(CAST(spread_return > 0 AS INT)) AS win_rate", "avg(CAST(reason = 'CONVERGENCE' AS INT)) AS convergence_rate", "avg(CAST(reason = 'HORIZON_END' AS INT)) AS forced_rate", "avg(spread_return) AS mean", "median(spread_return) AS median", "max(spread_return) AS best", "min(spread_return) AS worst", "avg(days) AS days")


@register("pr5_pair_trades", f"{PAIRED_TRADES} SELECT c, i, j, bar_ts, {r('z')}, held, {r('ret')}, action FROM tt")
def _(spark, d):
    return rounded(week_trades(spark, d))


@register("pr6_cohort_returns", f"{PAIRED_TRADES}, {COHORT_RETURNS} SELECT c, bar_ts, {r('gross', 'cost', 'net')} FROM cr")
def _(spark, d):
    return rounded(C.cohort_returns(week_trades(spark, d)))


@register("pr8_strategy_returns", f"{PAIRED_TRADES}, {COHORT_RETURNS} SELECT bar_ts, {r('gross', 'net')}, cohorts FROM sr")
def _(spark, d):
    return rounded(C.strategy_returns(week_trades(spark, d)))


@register("pr9_trade_report", f"{PAIRED_TRADES}, {COMPLETED} SELECT {REPORT}, round(count(*) * 2.0 / {TOP} / any_value(years), 6) AS annual_turnover FROM ct, (SELECT count(DISTINCT bar_ts) / 52.0 AS years FROM tt)")
def _(spark, d):
    traded = week_trades(spark, d)
    years = traded.agg((F.count_distinct("bar_ts") / 52.0).alias("years"))
    out = C.trade_report(C.completed_trades(traded)).crossJoin(F.broadcast(years))  # one row each
    return rounded(out.withColumn("annual_turnover", F.col("trades") * 2.0 / TOP / F.col("years")).drop("years"))


@register("pr9_performance", f"{PAIRED_TRADES}, {COHORT_RETURNS}, x AS (SELECT *, product(1 + net) OVER (ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS eq FROM sr), y AS (SELECT *, eq / greatest(1.0, max(eq) OVER (ORDER BY bar_ts ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM x), g AS (SELECT count(net) AS n, avg(net) AS m, stddev_samp(net) AS s, stddev_samp(net) FILTER (net < 0) AS sd, product(1 + net) AS growth, min(dd) AS dd, stddev_samp(gross) AS gs, avg(gross) AS gm FROM y), h AS (SELECT *, CASE WHEN growth > 0 THEN growth ** (52.0 / n) - 1 ELSE -1.0 END AS cagr FROM g) SELECT n AS n_bars, {r('CASE WHEN s > 0 THEN m / s * sqrt(52) ELSE 0 END AS sharpe', 's * sqrt(52) AS volatility', 'cagr', 'dd AS max_drawdown', 'CASE WHEN sd > 0 THEN cagr / (sd * sqrt(52)) END AS sortino', 'CASE WHEN dd < 0 THEN cagr / -dd END AS calmar', 'gm / gs * sqrt(52) AS gross_sharpe')} FROM h")
def _(spark, d):
    s = C.strategy_returns(week_trades(spark, d)).withColumn("all", F.lit("all"))
    gross = s.agg(sharpe_ratio("gross", 52).alias("gross_sharpe"))
    m = P.metrics(s, ["all"], "net", 52).select("n_bars", "sharpe", "volatility", "cagr", "max_drawdown", "sortino", "calmar")
    return rounded(m.crossJoin(F.broadcast(gross)))  # one row each


@register("ag22_pair_concentration", f"{PAIRED_TRADES}, g AS (SELECT i, j, count(*) FILTER (action = 'ENTER') AS trades, sum(ret) AS total FROM tt GROUP BY 1, 2) SELECT i, j, trades, {r('total', 'total / nullif(trades, 0) AS mean')} FROM g ORDER BY round(total, 6) DESC, i, j LIMIT 10")
def _(spark, d):
    g = week_trades(spark, d).groupBy("i", "j").agg(F.count_if(F.col("action") == "ENTER").alias("trades"), F.sum("ret").alias("total"))
    return rounded(g.withColumn("mean", F.col("total") / F.nullif("trades", F.lit(0)))).orderBy(F.desc("total"), "i", "j").limit(10)


#: name: number, pairs kept, whether pairs must share a sector.
UNIVERSES = {"all": (0, 5, False), "top_two": (1, 2, False), "subset": (2, 5, False), "attrition": (3, 5, False), "same_sector": (4, 5, True), "liquid": (5, 5, False)}
MEMBER = {"subset": "symbol < 'NATION_4'", "attrition": "('0x' || substr(md5('17|' || symbol), 1, 8))::BIGINT % 5 <> 0", "liquid": "av >= med"}


def universe_rows(spark, d):
    """Cohort rows of every universe, its number in the cohort's: number * 1000 + cohort."""
    x = week_returns(spark, d).select("symbol", "sector", "bar_ts", "close", "ret", "volume")
    av = x.groupBy("symbol").agg(F.avg("volume").alias("av"))
    liquid = av.join(F.broadcast(av.agg(F.percentile("av", 0.5).alias("med")))).filter("av >= med").select("symbol", F.lit(True).alias("liquid"))
    x = x.join(liquid, "symbol", "left")
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit("17|"), F.col("symbol"))), 1, 8), 16, 10).cast("long") % 5
    keep = {"subset": F.col("symbol") < "NATION_4", "attrition": hashed != 0, "liquid": F.col("liquid").isNotNull()}
    numbers = F.explode(F.array_compact(F.array(*[F.when(keep.get(n, F.lit(True)), F.lit(v[0])) for n, v in UNIVERSES.items()]))).alias("uni")
    rows = C.cohorts(x.drop("volume", "liquid"), FORM, TRADE, STEP)
    wide = rows.join(liquid.hint("merge"), "symbol", "left").select("*", numbers).drop("liquid")
    return wide.withColumn("c", F.col("uni") * 1000 + F.col("c"))


def universe_trades(spark, d):
    rows, formed = universe_rows(spark, d), None
    for number, top, same in UNIVERSES.values():
        one = C.form_pairs(rows.filter(F.col("uni") == number), FORM, top, same="sector" if same else None)
        formed = one if formed is None else formed.unionByName(one)
    return C.trade_pairs(rows, formed, FORM, 1.0)


STRESS = f"""
cal AS (SELECT bar_ts, row_number() OVER (ORDER BY bar_ts) - 1 AS t, count(*) OVER () AS total FROM (SELECT DISTINCT bar_ts FROM panel)),
av0 AS (SELECT symbol, avg(volume) AS av FROM panel GROUP BY 1), av1 AS (SELECT *, (SELECT median(av) FROM av0) AS med FROM av0),
un AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {v[0]}, {v[1]}, {str(v[2]).lower()})" for n, v in UNIVERSES.items())}) AS v(name, uni, top, same)),
mb AS (SELECT uni, symbol FROM av1, un WHERE CASE name {' '.join(f"WHEN '{n}' THEN {c}" for n, c in MEMBER.items())} ELSE true END),
ch AS (SELECT uni, uni * 1000 + c AS c, symbol, sector, bar_ts, close, ret, t - {STEP} * c AS u FROM rets JOIN mb USING (symbol) JOIN cal USING (bar_ts) JOIN (SELECT unnest(range(0, 1000)) AS c) ON t >= {STEP} * c AND t < {STEP} * c + {FORM + TRADE} AND {STEP} * c + {FORM} <= total),
np AS (SELECT *, close / first_value(close) OVER (PARTITION BY c, symbol ORDER BY bar_ts) AS p FROM ch),
ds AS (SELECT a.uni, a.c, a.symbol AS i, b.symbol AS j, any_value(a.sector = b.sector) AS alike, avg((a.p - b.p) * (a.p - b.p)) AS dist, avg(a.p - b.p) AS mean, sqrt(greatest(var_samp(a.p - b.p), 1e-8)) AS sd, count(*) AS n FROM np a JOIN np b ON a.c = b.c AND a.bar_ts = b.bar_ts AND a.symbol < b.symbol WHERE a.u < {FORM} GROUP BY 1, 2, 3, 4 HAVING count(*) >= {int(0.8 * FORM)}),
tp AS (SELECT * FROM (SELECT ds.*, top, row_number() OVER (PARTITION BY c ORDER BY dist, i, j) AS place FROM ds JOIN un USING (uni) WHERE alike OR NOT same) WHERE place <= top)"""


@register("pr10_universe_stress", f"WITH RECURSIVE {WEEK}, {STRESS}, {TRADED}, {COHORT_RETURNS}, x AS (SELECT c // 1000 AS uni, bar_ts, avg(net) AS net FROM cr GROUP BY 1, 2) SELECT name AS universe, count(*) AS n, {r('median(net) AS median', 'avg(CAST(net > 0 AS INT)) AS positive', 'avg(net) / nullif(stddev_samp(net), 0) * sqrt(52) AS sharpe')} FROM x JOIN un USING (uni) GROUP BY 1")
def _(spark, d):
    net = C.cohort_returns(universe_trades(spark, d)).groupBy(F.floor(F.col("c") / 1000).alias("uni"), "bar_ts").agg(F.avg("net").alias("net"))
    names = F.element_at(F.array(*[F.lit(n) for n in UNIVERSES]), F.col("uni").cast("int") + 1)
    g = net.groupBy(names.alias("universe")).agg(F.count(F.lit(1)).alias("n"), F.percentile("net", 0.5).alias("median"), F.avg((F.col("net") > 0).cast("int")).alias("positive"), (F.avg("net") / F.nullif(F.stddev_samp("net"), F.lit(0.0)) * 52**0.5).alias("sharpe"))
    return rounded(g)


def cointegrated_pairs(spark, d, top: int = 5):
    """Pairs of each cohort that pass the residual test on its formation, the most negative statistic first, after the distance screen (SO-3, SO-2)."""
    rows = week_cohorts(spark, d)
    near = C.form_pairs(rows, FORM, max(5 * top, 100))
    early = rows.filter(F.col("u") < FORM).select("c", "bar_ts", "symbol", F.col("p").alias("close"))
    found = C.scan_pairs(early, ["c"], near.select("c", "i", "j"), max_lags=3).filter("cointegrated")
    place = F.row_number().over(C.Window.partitionBy("c").orderBy("stat", "i", "j"))
    return near.drop("place").join(found.select("c", "i", "j", "stat", "half_life").hint("merge"), ["c", "i", "j"]).withColumn("place", place).filter(F.col("place") <= top)


def _cointegrated(spark, d):
    """CI-8, SO-2, SO-3: lags chosen by Akaike's criterion; the tests hold the statistics against numpy."""
    return rounded(cointegrated_pairs(spark, d).select("c", "i", "j", "place", "n", "stat", "half_life", "mean", "sd"))


def _configurations(spark, d):
    """PR-11: named configurations side by side, the cointegrated one among them."""
    rows = week_cohorts(spark, d)
    sectors = weekly_panel(spark, d).select("symbol", "sector").distinct()
    with_sector = rows.join(sectors.hint("merge"), "symbol")
    forms = {"T2": C.form_pairs(rows, FORM, 2), "T5": C.form_pairs(rows, FORM, TOP), "same_sector": C.form_pairs(with_sector, FORM, TOP, same="sector"), "cointegrated": cointegrated_pairs(spark, d).drop("stat", "half_life")}
    out = None
    for name, formed in forms.items():
        s = C.strategy_returns(C.trade_pairs(rows, formed, FORM, 1.0))
        one = s.agg(F.count(F.lit(1)).alias("n"), F.sum("net").alias("total"), (F.avg("net") / F.nullif(F.stddev_samp("net"), F.lit(0.0)) * 52**0.5).alias("sharpe")).select(F.lit(name).alias("config"), "n", "total", "sharpe")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


def _scan(spark, d):
    """CI-5: all pairs of a sector, condition screen, then the test, sorted by statistic."""
    x = C.scan_pairs(weekly_panel(spark, d).select("sector", "bar_ts", "symbol", "close"), ["sector"], kappa=2.0)
    return rounded(x.orderBy("stat", "i", "j"))


def week_walk(spark, d):
    return C.walk_forward_pairs(weekly_panel(spark, d), 104, 13, 1.0, 2)


def _walk(spark, d):
    """CI-6: the best pair by trailing window and its spread until the next choice; a test cuts the future off and finds the same rows."""
    return rounded(week_walk(spark, d)[1])


def _hybrid(spark, d):
    """CI-9: spread trading with and without the regime gate: z beyond 1.5 enters, a signal of the spread's own regime against it stays out; yesterday's position earns today's change."""
    s = week_walk(spark, d)[1].withColumn("symbol", F.lit("spread"))
    x = C.spread_z(s, ["symbol"], 60)
    w = C.Window.partitionBy("symbol").orderBy("bar_ts")
    wret = (F.col("spread") - F.lag("spread", 4).over(w)) / F.nullif(F.abs(F.lag("spread", 4).over(w)), F.lit(0.0))
    lab = x.withColumn("wret", wret).withColumn("state", F.when(F.col("wret") >= 0.05, 2).when(F.col("wret") <= -0.05, 0).otherwise(1)).withColumn("idx", F.col("t")).withColumn("close", F.col("spread"))
    sig = R.walk_forward(lab, 4, 52)
    raw = F.when(F.col("active") & (F.col("z") < -1.5), 1.0).when(F.col("active") & (F.col("z") > 1.5), -1.0).otherwise(0.0)
    gate = ((F.col("raw") == 1) & (F.col("signal") < -0.05)) | ((F.col("raw") == -1) & (F.col("signal") > 0.05))
    p = sig.withColumn("raw", raw).withColumn("gated", F.when(F.coalesce(gate, F.lit(False)), 0.0).otherwise(F.col("raw"))).withColumn("change", F.coalesce(F.col("spread") - F.lag("spread").over(w), F.lit(0.0)))
    held = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0.0))
    return rounded(p.select("bar_ts", "t", "active", "z", "signal", "raw", "gated", (held("raw") * F.col("change")).alias("raw_return"), (held("gated") * F.col("change")).alias("gated_return")))


QUERIES |= {"ci8_cointegrated_pairs": _cointegrated, "pr11_configurations": _configurations, "ci5_scan": _scan, "ci6_walk_forward": _walk, "ci9_gated_spread": _hybrid}

EG = """
bp AS (SELECT a.symbol AS i, b.symbol AS j, a.bar_ts, a.close AS y, b.close AS x FROM panel a JOIN panel b ON a.sector = b.sector AND a.bar_ts = b.bar_ts AND a.symbol < b.symbol),
ef AS (SELECT i, j, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, sum(y * y) AS yy, sum(x * x) AS xx, sum(x * y) AS xy FROM bp GROUP BY 1, 2),
er AS (SELECT bp.i, bp.j, bar_ts, y - intercept - slope * x AS s FROM bp JOIN ef USING (i, j)),
e1 AS (SELECT *, lag(s) OVER (PARTITION BY i, j ORDER BY bar_ts) AS s1 FROM er),
e2 AS (SELECT *, s - s1 AS dd, lag(s - s1) OVER (PARTITION BY i, j ORDER BY bar_ts) AS d1 FROM e1),
eh AS (SELECT i, j, regr_slope(dd, s1) AS lam FROM e2 GROUP BY 1, 2),
e3 AS (SELECT i, j, count(*) AS m, sum(s1 * s1) AS a11, sum(s1 * d1) AS a12, sum(d1 * d1) AS a22, sum(s1 * dd) AS y1, sum(d1 * dd) AS y2, sum(dd * dd) AS q FROM e2 WHERE d1 IS NOT NULL GROUP BY 1, 2),
e4 AS (SELECT *, a11 * a22 - a12 * a12 AS det, (a22 * y1 - a12 * y2) / (a11 * a22 - a12 * a12) AS b1, (a11 * y2 - a12 * y1) / (a11 * a22 - a12 * a12) AS b2 FROM e3),
e5 AS (SELECT *, b1 / sqrt((q - b1 * y1 - b2 * y2) / (m - 2) * a22 / det) AS adf_t FROM e4)"""


@register("ci8_engle_granger", f"WITH {WEEK}, {EG} SELECT i, j, n, {r('slope', 'r2', 'adf_t')}, round(intercept, 4) AS intercept, round(((yy + xx + sqrt((yy - xx) * (yy - xx) + 4 * xy * xy)) / 2) / sqrt(yy * xx - xy * xy), 4) AS kappa, round(CASE WHEN lam >= 0 THEN NULL WHEN lam <= -1 THEN 1 ELSE greatest(1, -ln(2) / ln(1 + lam)) END, 6) AS half_life, adf_t < -3.3377 AS cointegrated FROM ef JOIN e5 USING (i, j) JOIN eh USING (i, j)")
def _(spark, d):
    x = C.engle_granger(weekly_panel(spark, d), ["sector", "bar_ts"])
    return x.select("i", "j", "n", *[F.round(c, 4 if c in ("intercept", "kappa") else 6).alias(c) for c in ("slope", "r2", "adf_t", "intercept", "kappa", "half_life")], "cointegrated")


LAGS2 = """
l0 AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY bar_ts) - 1 AS k FROM e2),
l1 AS (SELECT i, j, count(*) FILTER (k > 1) AS m1, sum(s1 * s1) FILTER (k > 1) AS a, sum(s1 * dd) FILTER (k > 1) AS y, sum(dd * dd) FILTER (k > 1) AS q1, count(*) FILTER (k > 2) AS m2, sum(s1 * s1) FILTER (k > 2) AS a11, sum(s1 * d1) FILTER (k > 2) AS a12, sum(d1 * d1) FILTER (k > 2) AS a22, sum(s1 * dd) FILTER (k > 2) AS y1, sum(d1 * dd) FILTER (k > 2) AS y2, sum(dd * dd) FILTER (k > 2) AS q2 FROM l0 GROUP BY 1, 2),
l2 AS (SELECT *, y / a AS g1, q1 - y * y / a AS r1, a11 * a22 - a12 * a12 AS det, (a22 * y1 - a12 * y2) / (a11 * a22 - a12 * a12) AS b1, (a11 * y2 - a12 * y1) / (a11 * a22 - a12 * a12) AS b2 FROM l1),
l3 AS (SELECT *, q2 - b1 * y1 - b2 * y2 AS r2s FROM l2),
l4 AS (SELECT i, j, g1 / sqrt(r1 / (m1 - 1) / a) AS t1, m1 * ln(r1 / m1) + 2 AS c1, b1 / sqrt(r2s / (m2 - 2) * a22 / det) AS t2, m2 * ln(r2s / m2) + 4 AS c2 FROM l3),
l5 AS (SELECT i, j, CASE WHEN c2 < c1 THEN t2 ELSE t1 END AS stat, CASE WHEN c2 < c1 THEN 2 ELSE 1 END AS lag FROM l4),
l6 AS (SELECT *, greatest(1e-6, least(1.0, CASE WHEN stat < -3.336 THEN 0.05 * exp(1.2 * (stat + 3.336)) ELSE least(1.0, 0.05 + 0.15 * (stat + 3.336)) END)) AS p FROM l5)"""


@register("ci3_lag_by_criterion", f"WITH {WEEK}, {EG}, {LAGS2} SELECT i, j, lag, {r('stat', 'p', 'slope')}, p <= 0.05 OR stat < -3.336 AS cointegrated FROM l6 JOIN ef USING (i, j)")
def _(spark, d):
    x = C.scan_pairs(weekly_panel(spark, d).select("sector", "bar_ts", "symbol", "close"), ["sector"], max_lags=2)
    return rounded(x.select("i", "j", "lag", "stat", "p", "slope", "cointegrated"))


@register("sm1_live_bars", f"WITH {HOUR}, m AS (SELECT max(ts) AS now FROM events WHERE value IS NOT NULL) SELECT symbol, bar_ts, open, high, low, close, volume FROM bars, m WHERE bar_ts + INTERVAL 1 HOUR <= now - INTERVAL 1 HOUR")
def _(spark, d):
    return live.settled(live.bars(live.source(spark, f"{d}/events.parquet"), "1 hour", "1 hour"), "bars")


@register("sm2_live_once", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, d):
    ev = live.source(spark, f"{d}/events.parquet")
    return live.settled(live.once(ev.unionByName(ev), "event_id", "1 hour").select("event_id", "user_id", "event_type", "value"), "once")


@register("sm2_ingest_ledger", "SELECT event_id, user_id, event_type, value FROM events WHERE event_id IS NOT NULL")
def _(spark, d):
    # Every event twice, then all of them again as after the loss of the stream's own state.
    ev, at = live.source(spark, f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value"), shared_folder(spark, "ingest")
    live.ingest_once(ev.unionByName(ev), "event_id", f"{at}/ledger", f"{at}/first")
    return live.ingest_once(ev, "event_id", f"{at}/ledger", f"{at}/again")


#: Events that the watermark, an hour behind the newest, has passed at the end.
PASSED = "epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 3600000 FROM events WHERE value IS NOT NULL)"
LATE = "1 hour"


@register("sm4_live_jumps", f"WITH l AS (SELECT user_id, event_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events WHERE value IS NOT NULL) SELECT user_id, event_id, value, was FROM l WHERE abs(value - was) >= 0.5 * abs(was) AND was IS NOT NULL AND user_id IS NOT NULL AND {PASSED}")
def _(spark, d):
    return live.settled(live.jumps(live.source(spark, f"{d}/events.parquet"), 0.5, LATE), "jumps")


@register("sm3_live_transitions", "WITH l AS (SELECT user_id AS symbol, event_id, ts, CASE WHEN value < 20 THEN 0 WHEN value >= 60 THEN 2 ELSE 1 END AS state FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL), p AS (SELECT *, lag(state, 4) OVER w AS was FROM l WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)), c AS (SELECT *, " + ", ".join(f"sum(CASE WHEN was = {i} AND state = {j} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n{i}{j}" for i in range(3) for j in range(3)) + " FROM p), q AS (SELECT symbol, event_id, ts, state, " + ", ".join(f"CASE state WHEN 0 THEN n0{j} WHEN 1 THEN n1{j} ELSE n2{j} END AS k{j}" for j in range(3)) + f" FROM c) SELECT symbol, event_id, state, round(CASE WHEN k0 + k1 + k2 > 0 THEN (k2 - k0) / (k0 + k1 + k2) ELSE 0 END, 6) AS signal FROM q WHERE {PASSED}")
def _(spark, d):
    return rounded(live.settled(live.transition_signals(live.source(spark, f"{d}/events.parquet"), 20.0, 60.0, 4, LATE, "user_id"), "transitions"))


#: What may follow what.
FOLLOWS = {"signup": ("view", "click", "signup"), "view": ("view", "click", "purchase", "error"), "click": ("view", "click", "purchase"), "purchase": ("view", "purchase"), "error": ("error",)}


@register("sm5_live_lifecycle", f"WITH l AS (SELECT user_id, event_id, event_type, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL), a AS (SELECT * FROM (VALUES {', '.join(f'{(k, v)}' for k, vs in FOLLOWS.items() for v in vs)}) AS t(was, event_type)) SELECT user_id, event_id, was, event_type FROM l ANTI JOIN a USING (was, event_type) WHERE was IS NOT NULL AND epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 3600000 FROM l)")
def _(spark, d):
    return live.settled(live.lifecycle_violations(live.source(spark, f"{d}/events.parquet"), FOLLOWS, LATE), "lifecycle")


@register("sm6_live_breaker", f"WITH n AS (SELECT user_id, event_id, ts, 1000 + sum(value - 50) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nav FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL), p AS (SELECT *, greatest(1000, max(nav) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS peak FROM n) SELECT user_id, event_id, round(nav, 6) AS nav, round(peak, 6) AS peak, CAST(round(nav * 1000000) AS BIGINT) * 5 < CAST(round(peak * 1000000) AS BIGINT) * 4 AS tripped FROM p WHERE {PASSED}")
def _(spark, d):
    return rounded(live.settled(live.drawdown_breaker(live.source(spark, f"{d}/events.parquet"), 1000.0, 50.0, 0.2, LATE), "breaker"))


def _live_pairs(spark, d):
    """SM-7: the pair's state goes from event to event; the tests hold it against a loop."""
    return rounded(live.settled(live.pair_signals(live.source(spark, f"{d}/events.parquet"), "view", "click", 0.0, 40.0, 1.0, 0.25, LATE), "pairs"))


QUERIES["sm7_live_pairs"] = _live_pairs
