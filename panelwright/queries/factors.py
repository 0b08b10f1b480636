"""Registered queries of factors, weights and portfolios on the weekly panel, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import factors as A
from ..operators import performance as P
from ..operators import windows as W
from ..sources.panels import weekly_panel
from ..sources.shared import staged
from .panel import WEEK, r, register, rounded, week_returns

#: Rebalance every 4 weeks, two names a side, at most 0.3 each; the calendar's bars are numbered from 0.
EVERY, K, CAP, MOM, SKIP, VAL, VOL = 4, 2, 0.3, 26, 4, 52, 12
SCORES = f"""
fs0 AS (SELECT symbol, sector, bar_ts, ret, close, lag(close, {SKIP}) OVER w / lag(close, {MOM}) OVER w - 1 AS mom,
  CASE WHEN count(close) OVER v = {VAL} AND stddev_samp(close) OVER v > 1e-12 THEN -(close - avg(close) OVER v) / stddev_samp(close) OVER v END AS val,
  CASE WHEN count(ret) OVER q = {VOL} THEN stddev_samp(ret) OVER q * sqrt(52) END AS vol
  FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts), v AS (PARTITION BY symbol ORDER BY bar_ts ROWS {VAL - 1} PRECEDING), q AS (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN {VOL} PRECEDING AND 1 PRECEDING)),
fs AS (SELECT *, CASE WHEN count(mom) OVER x >= 6 THEN (mom - avg(mom) OVER x) / (stddev_samp(mom) OVER x + 1e-8) END AS zm, CASE WHEN count(val) OVER x >= 6 THEN (val - avg(val) OVER x) / (stddev_samp(val) OVER x + 1e-8) END AS zv FROM fs0 WINDOW x AS (PARTITION BY bar_ts)),
cfg AS (SELECT * FROM (VALUES ('mom', 1, 0), ('val', 0, 1), ('both', 1, 1)) AS c(config, um, uv)),
sc AS (SELECT config, symbol, bar_ts, ret, vol, CASE WHEN um = 1 AND uv = 1 THEN CASE WHEN zm IS NULL AND zv IS NULL THEN NULL ELSE (coalesce(zm, 0) + coalesce(zv, 0)) / ((zm IS NOT NULL)::INT + (zv IS NOT NULL)::INT) END WHEN um = 1 THEN zm ELSE zv END AS score FROM fs, cfg),
rk AS (SELECT *, row_number() OVER (PARTITION BY config, bar_ts ORDER BY score DESC, symbol) AS up, count(*) OVER (PARTITION BY config, bar_ts) AS n FROM sc WHERE score IS NOT NULL AND vol IS NOT NULL),
sel AS (SELECT *, CASE WHEN up <= {K} THEN 1 ELSE -1 END AS side FROM rk WHERE n >= {2 * K} AND (up <= {K} OR up > n - {K})),
wt AS (SELECT config, symbol, bar_ts, side, side * 0.5 * (1 / (vol + 1e-8)) / sum(1 / (vol + 1e-8)) OVER (PARTITION BY config, bar_ts, side) AS weight FROM sel)"""
HELD = f"""
cal AS (SELECT bar_ts, row_number() OVER (ORDER BY bar_ts) - 1 AS t FROM (SELECT DISTINCT bar_ts FROM panel)),
gr AS (SELECT config, symbol, bar_ts, ret, t, CASE WHEN t % {EVERY} = 0 THEN coalesce(weight, 0) END AS s FROM (SELECT config, symbol, bar_ts, ret FROM rets, cfg) JOIN cal USING (bar_ts) LEFT JOIN wt USING (config, symbol, bar_ts)),
hd AS (SELECT config, symbol, bar_ts, ret, t, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY config, symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING), 0) AS weight FROM gr),
pl AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY config, symbol ORDER BY bar_ts), 0) AS was FROM hd),
pf AS (SELECT config, bar_ts, sum(was * coalesce(ret, 0)) AS gross, sum(abs(weight - was)) AS turnover, sum(was * coalesce(ret, 0)) - sum(abs(weight - was)) * 10 / 1e4 AS net FROM pl GROUP BY 1, 2)"""


def week_factors(spark, d, x=None):
    x = (week_returns(spark, d) if x is None else x).withColumn("mom", A.skip_momentum(MOM, SKIP)).withColumn("val", A.value_score(VAL)).withColumn("vol", W.trailing_vol("ret", VOL, 52))
    return x.withColumn("zm", W.zscore("mom")).withColumn("zv", W.zscore("val"))


def configs():
    """The ablation grid: every configuration with its score, three to a row of the panel."""
    return F.inline(F.array(*[F.struct(F.lit(n).alias("config"), s.alias("score")) for n, s in (("mom", F.col("zm")), ("val", F.col("zv")), ("both", A.composite("zm", "zv")))]))


def week_weights(spark, d, x=None):
    s = week_factors(spark, d, x).select("symbol", "bar_ts", "ret", "vol", configs()).filter("vol is not null")
    return A.inverse_vol(A.both_ends(s, "score", K, ["config"]), "vol", ["config"])


def week_held(spark, d):
    # Dates, weights and the grid come from one table of returns.
    x = staged(week_returns(spark, d), "returns")
    days = W.split_of(x).select("bar_ts", (F.row_number().over(W.Window.orderBy("bar_ts")) - 1).alias("t"))  # one row per date
    names = F.explode(F.array(*[F.lit(n) for n in ("mom", "val", "both")])).alias("config")
    grid = x.join(days, "bar_ts").select(names, "symbol", "bar_ts", "ret", "t")
    return A.held_between(grid, week_weights(spark, d, x), EVERY, ["config"])


def week_portfolio(spark, d, bps: float = 10.0):
    return A.portfolio(week_held(spark, d), bps, ["config"])


@register("fa1_momentum_value", f"WITH {WEEK}, {SCORES} SELECT symbol, bar_ts, {r('mom', 'val', 'vol', 'zm', 'zv')} FROM fs")
def _(spark, d):
    return rounded(week_factors(spark, d).select("symbol", "bar_ts", "mom", "val", "vol", "zm", "zv"))


@register("fa6_composite", f"WITH {WEEK}, {SCORES} SELECT config, symbol, bar_ts, {r('score')} FROM sc WHERE score IS NOT NULL")
def _(spark, d):
    return rounded(week_factors(spark, d).select("symbol", "bar_ts", configs()).filter("score is not null"))


@register("fa9_inverse_vol", f"WITH {WEEK}, {SCORES} SELECT config, symbol, bar_ts, side, {r('weight')} FROM wt")
def _(spark, d):
    return rounded(week_weights(spark, d).select("config", "symbol", "bar_ts", "side", "weight"))


@register("fa10_capped", f"WITH {WEEK}, {SCORES}, c AS (SELECT *, abs(weight) AS a, sum(abs(weight)) OVER (PARTITION BY config, bar_ts, side) AS whole FROM wt) SELECT config, symbol, bar_ts, side, round(side * CASE WHEN a >= {CAP} THEN {CAP} ELSE greatest(a, whole - {CAP}, 0) * CASE WHEN max(a) OVER (PARTITION BY config, bar_ts, side) >= {CAP} THEN 1 ELSE a / greatest(a, whole - {CAP}, 1e-300) END END, 6) AS weight FROM c")
def _(spark, d):
    return rounded(A.capped(week_weights(spark, d), CAP, K, ["config"]).select("config", "symbol", "bar_ts", "side", "weight"))


@register("wn19_held", f"WITH {WEEK}, {SCORES}, {HELD} SELECT config, symbol, bar_ts, t, {r('weight')} FROM hd")
def _(spark, d):
    return rounded(week_held(spark, d).select("config", "symbol", "bar_ts", "t", "weight"))


@register("fa_portfolio", f"WITH {WEEK}, {SCORES}, {HELD} SELECT config, bar_ts, {r('gross', 'turnover', 'net')} FROM pf")
def _(spark, d):
    return rounded(week_portfolio(spark, d))


@register("fa14_ablation", f"WITH {WEEK}, {SCORES}, {HELD} SELECT config, count(*) AS n, {r('avg(net) * 52 AS mean', 'stddev_samp(net) * sqrt(52) AS vol', 'avg(net) / stddev_samp(net) * sqrt(52) AS sharpe', 'sum(net) AS total')} FROM pf GROUP BY 1")
def _(spark, d):
    g = week_portfolio(spark, d).groupBy("config").agg(F.count("net").alias("n"), F.avg("net").alias("m"), F.stddev_samp("net").alias("s"), F.sum("net").alias("g"))
    return rounded(g.select("config", "n", (F.col("m") * 52).alias("mean"), (F.col("s") * 52**0.5).alias("vol"), A.annual(F.col("m"), F.col("s"), 52).alias("sharpe"), F.col("g").alias("total")))


@register("fa16_cost_sweep", f"WITH {WEEK}, {SCORES}, {HELD}, b AS (SELECT unnest([0, 5, 10, 25, 50]) AS bps) SELECT config, bps, {r('sum(gross) - sum(turnover) * bps / 1e4 AS net_sum', 'sum(gross) / sum(turnover) * 1e4 AS break_even_bps')} FROM pf, b GROUP BY 1, 2")
def _(spark, d):
    # Cost is linear in turnover, so the grid never replays the portfolio.
    g = week_portfolio(spark, d).groupBy("config").agg(F.sum("gross").alias("g"), F.sum("turnover").alias("t"))
    out = g.select("config", "g", "t", F.explode(F.array(*[F.lit(x) for x in (0, 5, 10, 25, 50)])).alias("bps"))
    return rounded(out.select("config", "bps", (F.col("g") - F.col("t") * F.col("bps") / 1e4).alias("net_sum"), (F.col("g") / F.col("t") * 1e4).alias("break_even_bps")))


@register("ag13_attribution", f"WITH {WEEK}, {SCORES}, {HELD} SELECT config, symbol, {r('sum(was * coalesce(ret, 0)) AS pnl', 'avg(weight) AS avg_weight', 'max(abs(weight)) AS most')}, count(*) FILTER (was <> 0) AS active, {r('avg(CASE WHEN was <> 0 THEN CASE WHEN was * coalesce(ret, 0) > 0 THEN 1.0 ELSE 0.0 END END) AS hit_rate')} FROM pl GROUP BY 1, 2")
def _(spark, d):
    was = F.coalesce(F.lag("weight").over(W.Window.partitionBy("config", "symbol").orderBy("bar_ts")), F.lit(0.0))
    x = week_held(spark, d).withColumn("was", was).withColumn("p", F.col("was") * F.coalesce("ret", F.lit(0.0)))
    return rounded(x.groupBy("config", "symbol").agg(F.sum("p").alias("pnl"), F.avg("weight").alias("avg_weight"), F.max(F.abs("weight")).alias("most"), F.count_if(F.col("was") != 0).alias("active"), F.avg(F.when(F.col("was") != 0, F.when(F.col("p") > 0, 1.0).otherwise(0.0))).alias("hit_rate")))


@register("ag18_split_metrics", f"WITH {WEEK}, {SCORES}, {HELD}, x AS (SELECT bar_ts, t AS i, count(*) OVER () AS n FROM cal), s AS (SELECT bar_ts, CASE WHEN i < floor(n * 0.6) THEN 'TRAIN' WHEN i < floor(n * 0.8) THEN 'VALIDATION' ELSE 'TRUE_OOS' END AS split FROM x) SELECT config, split, count(*) AS n, {r('sum(net) AS total', 'stddev_samp(net) * sqrt(52) AS vol', 'sum(turnover) AS turnover')} FROM pf JOIN s USING (bar_ts) GROUP BY 1, 2")
def _(spark, d):
    x = week_portfolio(spark, d).join(W.split_of(weekly_panel(spark, d)).hint("merge"), "bar_ts")
    return rounded(x.groupBy("config", "split").agg(F.count("net").alias("n"), F.sum("net").alias("total"), (F.stddev_samp("net") * 52**0.5).alias("vol"), F.sum("turnover").alias("turnover")))


@register("ag20_factor_correlation", f"WITH {WEEK}, {SCORES}, z AS (SELECT * FROM fs WHERE zm IS NOT NULL AND zv IS NOT NULL AND vol IS NOT NULL) SELECT count(*) AS n, {r('corr(zm, zv) AS mom_val', 'corr(zm, vol) AS mom_vol', 'corr(zv, vol) AS val_vol')} FROM z")
def _(spark, d):
    z = week_factors(spark, d).filter("zm is not null and zv is not null and vol is not null")
    return rounded(z.agg(F.count(F.lit(1)).alias("n"), F.corr("zm", "zv").alias("mom_val"), F.corr("zm", "vol").alias("mom_vol"), F.corr("zv", "vol").alias("val_vol")))


@register("wn9_rolling_correlation", f"WITH {WEEK}, {SCORES}, {HELD}, v AS (SELECT a.bar_ts, a.net AS x, b.net AS y FROM pf a JOIN pf b ON a.bar_ts = b.bar_ts AND a.config = 'mom' AND b.config = 'val') SELECT bar_ts, round(CASE WHEN count(*) OVER w = 52 AND stddev_samp(x) OVER w > 1e-12 AND stddev_samp(y) OVER w > 1e-12 THEN corr(x, y) OVER w END, 6) AS corr, round(CASE WHEN count(*) OVER w = 52 THEN covar_samp(x, y) OVER w END, 9) AS cov FROM v WINDOW w AS (ORDER BY bar_ts ROWS 51 PRECEDING)")
def _(spark, d):
    p = week_portfolio(spark, d)
    v = p.groupBy("bar_ts").pivot("config", ["mom", "val"]).agg(F.first("net"))
    w = W.Window.orderBy("bar_ts").rowsBetween(-51, 0)  # one row per date
    whole = F.count(F.lit(1)).over(w) == 52
    moves = (F.stddev_samp("mom").over(w) > 1e-12) & (F.stddev_samp("val").over(w) > 1e-12)
    return v.select("bar_ts", F.round(F.when(whole & moves, F.try_divide(F.covar_samp("mom", "val").over(w), F.stddev_samp("mom").over(w) * F.stddev_samp("val").over(w))), 6).alias("corr"), F.round(F.when(whole, F.covar_samp("mom", "val").over(w)), 9).alias("cov"))


HYSTERESIS = f"""
hm AS (SELECT symbol, bar_ts, lag(close, {SKIP}) OVER w / lag(close, {MOM}) OVER w - 1 AS mom FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)),
hl AS (SELECT bar_ts, list(symbol ORDER BY mom DESC, symbol) AS names, row_number() OVER (ORDER BY bar_ts) AS k FROM hm WHERE mom IS NOT NULL GROUP BY 1),
h0 AS (SELECT 0 AS k, NULL::DATE AS bar_ts, []::VARCHAR[] AS longs, []::VARCHAR[] AS shorts
  UNION ALL SELECT q.k, q.bar_ts, q.longs, list_concat(q.ks, list_filter(list_reverse(q.names), lambda s: NOT list_contains(q.ks, s) AND NOT list_contains(q.longs, s)))[1:{K}] FROM (
    SELECT p.*, list_filter(list_reverse(p.names), lambda s: list_contains(p.ps, s) AND list_position(p.names, s) >= 4 AND NOT list_contains(p.longs, s)) AS ks FROM (
      SELECT o.*, list_concat(o.kl, list_filter(o.names, lambda s: NOT list_contains(o.kl, s)))[1:{K}] AS longs FROM (
        SELECT hl.k, hl.bar_ts, hl.names, h0.shorts AS ps, list_filter(hl.names, lambda s: list_contains(h0.longs, s) AND list_position(hl.names, s) <= {K + 2}) AS kl FROM h0 JOIN hl ON hl.k = h0.k + 1) o) p) q)"""


@register("fa8_hysteresis", f"WITH RECURSIVE {WEEK}, {HYSTERESIS} SELECT bar_ts, array_to_string(longs, ',') AS longs, array_to_string(shorts, ',') AS shorts FROM h0 WHERE k > 0")
def _(spark, d):
    return week_hysteresis(spark, d).select("bar_ts", F.array_join("longs", ",").alias("longs"), F.array_join("shorts", ",").alias("shorts"))


def week_hysteresis(spark, d):
    ranks = week_returns(spark, d).withColumn("mom", A.skip_momentum(MOM, SKIP)).filter("mom is not null").withColumn("rnk", W.rank("mom"))
    return A.hysteresis(ranks.select(F.lit("all").alias("config"), "bar_ts", "symbol", "rnk"), K, K + 2, 4, ["config"]).drop("config")
