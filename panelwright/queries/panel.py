"""Queries over the weekly panel and the hourly bars, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import performance as P
from ..operators import quality as Q
from ..operators import regime as R
from ..operators import windows as W
from ..sources.panels import hourly_bars, table, weekly_panel
from ..sources.shared import staged

QUERIES, ORACLES = {}, {}
#: Weekly parameters: trailing window and stride, bars before the first signal, bars a year.
WIN, MIN_TRAIN, YEAR = 4, 52, 52

WEEK = """
wk AS (SELECT n_name AS symbol, r_name AS sector, CAST(date_trunc('week', l_shipdate) AS DATE) AS bar_ts, floor(round(sum(l_extendedprice) * 100) / sum(l_quantity)) / 100 AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
panel AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS idx FROM wk),
rets AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS ret FROM panel)"""
HOUR = """
bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS bar_ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume
  FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"""
LABELS = f"""
lab0 AS (SELECT *, close / lag(close, {WIN}) OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS wret FROM panel),
lab AS (SELECT symbol, bar_ts, idx, close, wret, CASE WHEN wret >= 0.05 THEN 2 WHEN wret <= -0.05 THEN 0 ELSE 1 END AS state FROM lab0 WHERE wret IS NOT NULL)"""
COUNTS = f"""
pairs AS (SELECT symbol, state AS from_state, lead(state, {WIN}) OVER (PARTITION BY symbol ORDER BY bar_ts) AS to_state FROM lab),
cnt AS (SELECT symbol, from_state, to_state, count(*) AS n FROM pairs WHERE to_state IS NOT NULL GROUP BY 1, 2, 3),
grid AS (SELECT symbol, f AS from_state, t AS to_state FROM (SELECT DISTINCT symbol FROM cnt), (SELECT unnest([0, 1, 2]) AS f), (SELECT unnest([0, 1, 2]) AS t)),
mat0 AS (SELECT grid.*, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY grid.symbol, grid.from_state) AS BIGINT) AS row_total FROM grid LEFT JOIN cnt USING (symbol, from_state, to_state)),
mat AS (SELECT *, CASE WHEN row_total > 0 THEN n / row_total ELSE 1.0 / 3 END AS p, row_total = 0 AS unobserved FROM mat0)"""
SIGNALS = (
    f"sig0 AS (SELECT *, lag(state, {WIN}) OVER w AS was, row_number() OVER w - 1 AS k FROM lab WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)),\nsig1 AS (SELECT *, "
    + ", ".join(f"sum(CASE WHEN was = {s} THEN state - 1 ELSE 0 END) OVER u AS net{s}, sum(CASE WHEN was = {s} THEN 1 ELSE 0 END) OVER u AS tot{s}" for s in range(3))
    + f""" FROM sig0 WINDOW u AS (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING)),
sig2 AS (SELECT *, CASE state WHEN 0 THEN net0 WHEN 1 THEN net1 ELSE net2 END AS net, CASE state WHEN 0 THEN tot0 WHEN 1 THEN tot1 ELSE tot2 END AS total FROM sig1),
sig AS (SELECT symbol, bar_ts, idx, close, wret, state, CASE WHEN k >= {MIN_TRAIN} THEN CASE WHEN total > 0 THEN net / total ELSE 0 END END AS signal FROM sig2)"""
)
EARNED = """
pos AS (SELECT sig.symbol, sig.bar_ts, CASE WHEN signal > 0.05 THEN CAST(0.1 AS DOUBLE) WHEN signal < -0.05 THEN CAST(-0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS pos, ret FROM sig JOIN rets USING (symbol, bar_ts)),
held AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY bar_ts), 0) AS was FROM pos),
ern AS (SELECT symbol, bar_ts, pos, was * coalesce(ret, 0) AS gross, abs(pos - was) AS turnover, was * coalesce(ret, 0) - abs(pos - was) * 10 / 1e4 AS net FROM held)"""


def register(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def rounded(df, digits: int = 6):
    return df.select(*[(F.round(c, digits) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes])


def r(*names: str) -> str:
    """``round(x, 6) AS x`` of each name (or ``expression AS name``)."""
    return ", ".join(f"round({n.rpartition(' AS ')[0] or n}, 6) AS {n.rpartition(' AS ')[2]}" for n in names)


def week_returns(spark, d):
    return weekly_panel(spark, d).withColumn("ret", W.trailing_return(1))


def week_labels(spark, d):
    return R.labels(weekly_panel(spark, d), WIN, 0.05)


def week_matrix(spark, d):
    return R.matrix(R.transitions(week_labels(spark, d), WIN))


def week_earned(spark, d):
    signals = R.walk_forward(week_labels(spark, d), WIN, MIN_TRAIN)
    pos = signals.join(week_returns(spark, d).select("symbol", "bar_ts", "ret"), ["symbol", "bar_ts"]).withColumn("pos", R.filter_position(F.col("signal"), 0.05, F.lit(0.1)))
    return P.earned(pos.select("symbol", "bar_ts", "pos", "ret"), ["symbol"])


@register("src8_weekly_panel", f"WITH {WEEK} SELECT symbol, sector, bar_ts, close, volume, idx FROM panel")
def _(spark, d):
    return weekly_panel(spark, d)


@register("src8_hourly_bars", f"WITH {HOUR} SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS idx FROM bars")
def _(spark, d):
    return hourly_bars(spark, d)


@register("dq1_artifacts", f"WITH {HOUR} SELECT symbol, bar_ts, coalesce(volume = 0 AND greatest(open, high, low, close) = least(open, high, low, close), false) AS artifact FROM bars")
def _(spark, d):
    return Q.split_artifacts(hourly_bars(spark, d)).select("symbol", "bar_ts", "artifact")


@register("dq2_anomalies", f"WITH {WEEK} SELECT symbol, bar_ts, {r('ret')}, CASE WHEN ret < 0 THEN 'drop' ELSE 'jump' END AS kind FROM rets WHERE abs(ret) >= 0.15")
def _(spark, d):
    return rounded(Q.anomalies(weekly_panel(spark, d)))


@register("dq3_integrity_gate", f"WITH {WEEK} SELECT symbol, count(*) AS n_bars, count(*) FILTER (close IS NULL) AS n_null, count(*) FILTER (abs(ret) >= 0.15) AS n_anomalies, count(*) FILTER (abs(ret) >= 0.15) = 0 AND count(*) FILTER (close IS NULL) = 0 AND count(*) >= 10 AS passed FROM rets GROUP BY symbol")
def _(spark, d):
    return Q.integrity_gate(weekly_panel(spark, d))


@register("dq8_forward_fill", f"WITH {WEEK}, g AS (SELECT * FROM (SELECT DISTINCT bar_ts FROM panel), (SELECT DISTINCT symbol FROM panel)) SELECT symbol, bar_ts, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS close, close IS NULL AS filled FROM g LEFT JOIN panel USING (symbol, bar_ts)")
def _(spark, d):
    return Q.aligned(staged(weekly_panel(spark, d), "panel"))


@register("dq10_coverage", f"WITH {WEEK}, t AS (SELECT count(DISTINCT bar_ts) AS total FROM panel) SELECT symbol, count(close) AS n_bars, count(close) >= 0.8 * any_value(total) AND min(close) > 0 AS kept FROM panel, t GROUP BY symbol")
def _(spark, d):
    return Q.coverage(weekly_panel(spark, d))


@register("dq11_liquidity", f"WITH {WEEK}, l AS (SELECT symbol, avg(volume) AS avg_volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) AS k FROM panel) WHERE k <= 5 GROUP BY 1), c AS (SELECT quantile_cont(avg_volume, 0.5) AS cutoff FROM l) SELECT symbol, {r('avg_volume', 'cutoff')}, avg_volume >= cutoff AS liquid FROM l, c")
def _(spark, d):
    return rounded(Q.liquidity(weekly_panel(spark, d)))


@register("dq5_backward_adjustment", f"WITH {WEEK}, ev AS (SELECT DISTINCT symbol, DATE '1996-06-03' AS event_date, 0.5 AS factor FROM panel UNION ALL SELECT DISTINCT symbol, DATE '1997-01-06', 0.8 FROM panel WHERE symbol < 'F') SELECT p.symbol, p.bar_ts, round(p.close * coalesce(product(factor), 1), 6) AS close, round(p.volume / coalesce(product(factor), 1), 6) AS volume FROM panel p LEFT JOIN ev ON ev.symbol = p.symbol AND ev.event_date > p.bar_ts GROUP BY p.symbol, p.bar_ts, p.close, p.volume")
def _(spark, d):
    panel = weekly_panel(spark, d)
    names = panel.select("symbol").distinct()
    first = names.select("symbol", F.lit("1996-06-03").cast("date").alias("event_date"), F.lit(0.5).alias("factor"))
    second = names.filter("symbol < 'F'").select("symbol", F.lit("1997-01-06").cast("date").alias("event_date"), F.lit(0.8).alias("factor"))
    return rounded(Q.backward_adjusted(panel, first.unionByName(second)))


@register("dq14_feed_health", "WITH m AS (SELECT max(ts) AS now FROM events), l AS (SELECT event_type AS feed, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY 1) SELECT feed, last_ts, n, CAST(floor(epoch(now) - epoch(last_ts)) AS BIGINT) AS age_s, CASE WHEN now - last_ts < INTERVAL 3601 SECOND THEN 'healthy' WHEN now - last_ts < INTERVAL 86401 SECOND THEN 'stale' ELSE 'unavailable' END AS state FROM l, m")
def _(spark, d):
    ev = table(spark, d, "events")
    return Q.feed_health(ev, ev.agg(F.max("ts").alias("now")))


@register("jn5_asof_backward", "SELECT o_orderkey, o_orderdate, (SELECT max(e.o_orderdate) FROM orders e WHERE e.o_custkey = o.o_custkey AND e.o_orderdate < o.o_orderdate) AS prev_date FROM orders o")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    days = o.select("o_custkey", "o_orderdate").distinct()
    before = days.withColumn("prev_date", F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate")))
    return o.join(before, ["o_custkey", "o_orderdate"], "left").select("o_orderkey", "o_orderdate", "prev_date")


@register("jn7_same_sector_pairs", f"WITH {WEEK}, s AS (SELECT DISTINCT symbol, sector FROM panel) SELECT a.sector, a.symbol AS asset_i, b.symbol AS asset_j FROM s a JOIN s b ON a.sector = b.sector AND a.symbol < b.symbol")
def _(spark, d):
    s = weekly_panel(spark, d).select("symbol", "sector").distinct()
    return s.withColumnRenamed("symbol", "asset_i").join(s.withColumnRenamed("symbol", "asset_j"), "sector").filter("asset_i < asset_j").select("sector", "asset_i", "asset_j")


ROLL = "OVER (PARTITION BY symbol ORDER BY bar_ts ROWS 11 PRECEDING)"
FULL = "CASE WHEN count({x}) " + ROLL + " = 12 THEN {f} " + ROLL + " END"


@register("wn2_rolling", f"WITH {WEEK} SELECT symbol, bar_ts, round({FULL.format(x='close', f='avg(close)')}, 6) AS mean, round({FULL.format(x='close', f='stddev_samp(close)')}, 6) AS sd, round({FULL.format(x='close', f='median(close)')}, 4) AS med FROM panel")
def _(spark, d):
    return rounded(weekly_panel(spark, d).select("symbol", "bar_ts", W.rolling_mean("close", 12).alias("mean"), W.rolling_std("close", 12).alias("sd"), F.round(W.rolling_median("close", 12), 4).alias("med")))


@register("wn3_atr", f"WITH {HOUR}, t AS (SELECT symbol, bar_ts, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)) SELECT symbol, bar_ts, {r('tr')}, round(CASE WHEN count(tr) OVER v = 14 THEN avg(tr) OVER v END, 6) AS atr FROM t WINDOW v AS (PARTITION BY symbol ORDER BY bar_ts ROWS 13 PRECEDING)")
def _(spark, d):
    b = hourly_bars(spark, d).withColumn("tr", W.true_range())
    return rounded(b.withColumn("atr", W.rolling_mean("tr", 14)).select("symbol", "bar_ts", "tr", "atr"))


@register("wn5_trailing_vol", f"WITH {WEEK}, v AS (SELECT symbol, bar_ts, CASE WHEN count(ret) OVER w = 12 THEN stddev_samp(ret) OVER w * sqrt(52) END AS vol FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) SELECT symbol, bar_ts, round(coalesce(nullif(vol, 0), avg(vol) OVER (PARTITION BY bar_ts), 0.15), 6) AS vol FROM v")
def _(spark, d):
    v = week_returns(spark, d).withColumn("vol", W.trailing_vol("ret", 12, YEAR))
    return rounded(v.select("symbol", "bar_ts", F.coalesce(F.nullif("vol", F.lit(0.0)), F.avg("vol").over(W.cross()), F.lit(0.15)).alias("vol")))


CURVE = "cv0 AS (SELECT symbol, bar_ts, product(1 + coalesce(ret, 0)) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS eq FROM rets), cv AS (SELECT *, eq / max(eq) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM cv0)"


def week_curve(spark, d):
    x = week_returns(spark, d).withColumn("ret", F.coalesce("ret", F.lit(0.0))).withColumn("eq", W.equity("ret"))
    return x.withColumn("dd", W.drawdown("eq")).select("symbol", "bar_ts", "eq", "dd")


@register("wn7_drawdown", f"WITH {WEEK}, {CURVE} SELECT symbol, bar_ts, {r('eq', 'dd')} FROM cv")
def _(spark, d):
    return rounded(week_curve(spark, d))


@register("wn25_drawdown_events", f"""WITH {WEEK}, {CURVE}, l AS (SELECT *, coalesce(last_value(CASE WHEN dd < -0.02 THEN 1 WHEN dd >= -0.005 THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING), 0) AS f FROM cv),
g AS (SELECT *, CASE WHEN f <> coalesce(lag(f) OVER (PARTITION BY symbol ORDER BY bar_ts), 0) THEN 1 ELSE 0 END AS c FROM l), i AS (SELECT *, CAST(sum(c) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spell FROM g)
SELECT symbol, spell, min(bar_ts) AS start_ts, arg_min(bar_ts, (dd, bar_ts)) AS trough_ts, max(bar_ts) AS end_ts, count(*) AS bars, round(min(dd), 6) AS depth FROM i a WHERE f = 1 AND spell < (SELECT max(spell) FROM i b WHERE a.symbol = b.symbol) GROUP BY 1, 2""")
def _(spark, d):
    return rounded(W.drawdown_events(week_curve(spark, d)))


@register("wn11_zscore_rank", f"WITH {WEEK}, m AS (SELECT symbol, bar_ts, close / lag(close, 12) OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS mom FROM panel) SELECT symbol, bar_ts, round(CASE WHEN count(mom) OVER x >= 6 THEN (mom - avg(mom) OVER x) / (stddev_samp(mom) OVER x + 1e-8) END, 6) AS z, row_number() OVER (PARTITION BY bar_ts ORDER BY mom DESC NULLS LAST, symbol) AS rnk FROM m WINDOW x AS (PARTITION BY bar_ts)")
def _(spark, d):
    m = weekly_panel(spark, d).withColumn("mom", W.trailing_return(12))
    return rounded(m.select("symbol", "bar_ts", W.zscore("mom").alias("z"), W.rank("mom").alias("rnk")))


@register("wn17_breadth_dispersion", f"WITH {WEEK}, m AS (SELECT bar_ts, close / lag(close, {WIN}) OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS r4 FROM panel) SELECT bar_ts, round(avg(CASE WHEN r4 > 0 THEN 1.0 WHEN r4 <= 0 THEN 0.0 END), 6) AS breadth, {r('stddev_samp(r4) AS dispersion')} FROM m GROUP BY 1")
def _(spark, d):
    m = weekly_panel(spark, d).withColumn("r4", W.trailing_return(WIN))
    return rounded(m.groupBy("bar_ts").agg(F.avg(F.when(F.col("r4") > 0, 1.0).when(F.col("r4") <= 0, 0.0)).alias("breadth"), F.stddev_samp("r4").alias("dispersion")))


@register("wn21_normalised", f"WITH {WEEK} SELECT symbol, bar_ts, round(close / first_value(close) OVER (PARTITION BY symbol ORDER BY bar_ts), 6) AS p FROM panel")
def _(spark, d):
    return rounded(weekly_panel(spark, d).select("symbol", "bar_ts", W.normalised().alias("p")))


@register("wn24_split", f"WITH {WEEK}, x AS (SELECT bar_ts, row_number() OVER (ORDER BY bar_ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT bar_ts FROM panel)) SELECT bar_ts, CASE WHEN i < floor(n * 0.6) THEN 'TRAIN' WHEN i < floor(n * 0.8) THEN 'VALIDATION' ELSE 'TRUE_OOS' END AS split FROM x")
def _(spark, d):
    return W.split_of(weekly_panel(spark, d))


@register("rg1_labels", f"WITH {WEEK}, {LABELS} SELECT symbol, bar_ts, idx, close, {r('wret')}, state FROM lab")
def _(spark, d):
    return rounded(week_labels(spark, d))


@register("ag1_transitions", f"WITH {WEEK}, {LABELS}, {COUNTS} SELECT symbol, from_state, to_state, n FROM cnt")
def _(spark, d):
    return R.transitions(week_labels(spark, d), WIN)


@register("ag3_matrix", f"WITH {WEEK}, {LABELS}, {COUNTS} SELECT symbol, from_state, to_state, n, row_total, {r('p')}, unobserved FROM mat")
def _(spark, d):
    return rounded(week_matrix(spark, d))


@register("ag5_base_rates", f"WITH {WEEK}, {LABELS} SELECT symbol, state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 6) AS base FROM lab GROUP BY 1, 2")
def _(spark, d):
    return rounded(R.base_rates(week_labels(spark, d)))


Z = 1.959963984540054
BOUND = f"(p + {Z * Z} / (2 * n_eff) {{s}} {Z} * sqrt(p * (1 - p) / n_eff + {Z * Z} / (4 * n_eff * n_eff))) / (1 + {Z * Z} / n_eff)"


@register("rg10_cell_stats", f"""WITH {WEEK}, {LABELS}, {COUNTS}, b AS (SELECT symbol, state AS to_state, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS base FROM lab GROUP BY 1, 2),
c AS (SELECT mat.*, coalesce(base, 0) AS base, row_total / {WIN}.0 AS n_eff FROM mat LEFT JOIN b USING (symbol, to_state)),
e AS (SELECT *, CASE WHEN n_eff > 0 THEN greatest(0.0, least(1.0, {BOUND.format(s='-')})) END AS lo, CASE WHEN n_eff > 0 THEN greatest(0.0, least(1.0, {BOUND.format(s='+')})) END AS hi FROM c)
SELECT symbol, from_state, to_state, n, row_total, {r('p', 'n_eff', 'base', '100 * (p - base) AS lift_pp', 'lo', 'hi')}, coalesce(base >= lo AND base <= hi, true) AS contains_base, n_eff < 30 AS thin FROM e""")
def _(spark, d):
    return rounded(R.cell_stats(week_labels(spark, d), WIN))


@register("rg3_walk_forward", f"WITH {WEEK}, {LABELS}, {SIGNALS} SELECT symbol, bar_ts, state, {r('signal')} FROM sig")
def _(spark, d):
    return rounded(R.walk_forward(week_labels(spark, d), WIN, MIN_TRAIN).select("symbol", "bar_ts", "state", "signal"))


@register("rg12_stationary", f"WITH {WEEK}, {LABELS}, {COUNTS}, v AS (SELECT symbol, " + ", ".join(f"max(p) FILTER (from_state = {i} AND to_state = {j}) AS p{i}{j}" for i in range(3) for j in range(3)) + " FROM mat GROUP BY 1), w AS (SELECT symbol, p10*p20 + p10*p21 + p12*p20 AS a, p01*p21 + p01*p20 + p02*p21 AS b, p02*p12 + p02*p10 + p01*p12 AS c FROM v) SELECT symbol, " + ", ".join(f"round(CASE WHEN a + b + c > 0 THEN {x} / (a + b + c) END, 6) AS pi{i}" for i, x in enumerate("abc")) + " FROM w")
def _(spark, d):
    return rounded(R.stationary(week_matrix(spark, d)))


@register("rg13_two_step", f"WITH {WEEK}, {LABELS}, {COUNTS} SELECT a.symbol, a.from_state, b.to_state, round(sum(a.p * b.p), 6) AS p FROM mat a JOIN mat b ON a.symbol = b.symbol AND a.to_state = b.from_state GROUP BY 1, 2, 3")
def _(spark, d):
    return rounded(R.n_step(week_matrix(spark, d), 2))


@register("rg15_signal_vector", f"WITH {WEEK}, {LABELS}, {COUNTS} SELECT symbol, from_state, round(sum(CASE to_state WHEN 2 THEN p WHEN 0 THEN -p ELSE 0 END), 6) AS signal FROM mat GROUP BY 1, 2")
def _(spark, d):
    return rounded(R.signal_vector(week_matrix(spark, d)))


@register("rg11_persistence", f"WITH {WEEK}, {LABELS}, {COUNTS} SELECT symbol, round(avg(p) FILTER (from_state = to_state), 6) AS persistence FROM mat GROUP BY 1")
def _(spark, d):
    return rounded(R.persistence(week_matrix(spark, d)))


@register("wn20_earned", f"WITH {WEEK}, {LABELS}, {SIGNALS}, {EARNED} SELECT symbol, bar_ts, pos, {r('gross', 'turnover', 'net')} FROM ern")
def _(spark, d):
    return rounded(week_earned(spark, d).select("symbol", "bar_ts", "pos", "gross", "turnover", "net"))


INF = "CAST('inf' AS DOUBLE)"
METRICS = """mc AS (SELECT *, product(1 + net) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS eq FROM ern),
md AS (SELECT *, eq / greatest(1.0, max(eq) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM mc),
mm AS (SELECT symbol, count(net) AS n_bars, count(*) FILTER (net > 0) AS wins, count(*) FILTER (net <> 0) AS active, coalesce(sum(net) FILTER (net > 0), 0) AS up, coalesce(-sum(net) FILTER (net < 0), 0) AS down, avg(net) AS mean, stddev_samp(net) AS sd, stddev_samp(net) FILTER (net < 0) AS sdd, product(1 + net) AS growth, min(dd) AS max_drawdown FROM md GROUP BY 1),
mx AS (SELECT *, CASE WHEN growth > 0 THEN growth ** (52.0 / n_bars) - 1 ELSE -1.0 END AS cagr FROM mm)"""


@register("ag6_metrics", f"WITH {WEEK}, {LABELS}, {SIGNALS}, {EARNED}, {METRICS} SELECT symbol, n_bars, {r('wins / nullif(active, 0) AS win_rate', 'CASE WHEN down > 0 THEN up / down WHEN up > 0 THEN ' + INF + ' ELSE 0 END AS profit_factor')}, round(CASE WHEN sd > 0 THEN mean / sd * sqrt(52) ELSE 0 END, 6) AS sharpe, {r('sd * sqrt(52) AS volatility', 'cagr', 'max_drawdown', 'active / n_bars AS exposure')}, round(CASE WHEN sdd > 0 THEN cagr / (sdd * sqrt(52)) END, 6) AS sortino, round(CASE WHEN max_drawdown < 0 THEN cagr / -max_drawdown END, 6) AS calmar FROM mx")
def _(spark, d):
    return rounded(P.metrics(week_earned(spark, d), ["symbol"], "net", YEAR))


@register("st4_sharpe_stats", f"WITH {WEEK}, q AS (SELECT symbol, count(ret) AS n, avg(ret) / stddev_samp(ret) AS s, skewness(ret) AS skew, kurtosis(ret) AS kurt FROM rets GROUP BY 1), z AS (SELECT *, s * sqrt(52) AS sharpe, sqrt((1 - skew * s + (kurt + 2) / 4 * s * s) / (n - 1)) * sqrt(52) AS se FROM q) SELECT symbol, n, {r('sharpe', 'se', 'sharpe / se AS t', 'sharpe - 1.96 * se AS lo', 'sharpe + 1.96 * se AS hi', 'skew', 'kurt')} FROM z")
def _(spark, d):
    return rounded(P.sharpe_stats(week_returns(spark, d), ["symbol"], "ret", YEAR))


@register("ag11_summary", f"WITH {WEEK} SELECT sector, count(ret) AS n, {r('avg(ret) AS mean', 'median(ret) AS median', 'stddev_samp(ret) AS sd', 'min(ret) AS least', 'max(ret) AS most', 'quantile_cont(ret, 0.25) AS q25', 'quantile_cont(ret, 0.75) AS q75', 'avg(CAST(ret > 0 AS INT)) AS positive')} FROM rets GROUP BY 1")
def _(spark, d):
    return rounded(P.summary(week_returns(spark, d), ["sector"], "ret"))


@register("ag14_calendar_years", f"WITH {WEEK} SELECT symbol, CAST(year(bar_ts) AS INT) AS yr, round(product(1 + ret) - 1, 6) AS total, count(ret) AS n FROM rets WHERE ret IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    x = week_returns(spark, d).filter("ret is not null")
    return rounded(x.groupBy("symbol", F.year("bar_ts").alias("yr")).agg((F.product(1 + F.col("ret")) - 1).alias("total"), F.count("ret").alias("n")))


@register("ag34_rollup", f"WITH {WEEK} SELECT sector, symbol, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM panel GROUP BY ROLLUP (sector, symbol)")
def _(spark, d):
    return weekly_panel(spark, d).rollup("sector", "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").cast("long").alias("volume"))
