"""Registered queries of reports, window analytics and alignments on the panels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import quality as Q
from ..operators import regime as R
from ..operators import windows as W
from ..sources.panels import hourly_bars, table, weekly_panel
from .factors import HELD, SCORES, week_portfolio, week_weights
from .ledger import MARKED, TRADES, marked
from .panel import COUNTS, EARNED, HOUR, LABELS, SIGNALS, WEEK, WIN, MIN_TRAIN, r, register, rounded, week_earned, week_labels, week_matrix, week_returns

BY = "PARTITION BY symbol ORDER BY bar_ts"


@register("ag2_single_transitions", f"WITH {WEEK}, {LABELS}, k AS (SELECT *, row_number() OVER ({BY}) - 1 AS k FROM lab), p AS (SELECT symbol, state AS from_state, lead(state) OVER ({BY}) AS to_state FROM k WHERE k % {WIN} = 0) SELECT symbol, from_state, to_state, count(*) AS n FROM p WHERE to_state IS NOT NULL GROUP BY 1, 2, 3")
def _(spark, d):
    return R.transitions(week_labels(spark, d), WIN, "single")


@register("ag9_trade_analytics", f"WITH {WEEK}, {LABELS}, {SIGNALS}, {EARNED}, i AS (SELECT *, sum(CASE WHEN pos <> coalesce(lagp, 0) THEN 1 ELSE 0 END) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS trade FROM (SELECT *, lag(pos) OVER ({BY}) AS lagp, lead(gross) OVER ({BY}) AS earned FROM ern)), t AS (SELECT symbol, trade, sum(earned) AS pnl, count(*) AS bars FROM i WHERE pos <> 0 AND earned IS NOT NULL GROUP BY 1, 2) SELECT symbol, count(*) AS trades, {r('avg(CAST(pnl > 0 AS INT)) AS win_rate', 'avg(pnl) AS mean', 'median(pnl) AS median', 'max(pnl) AS best', 'min(pnl) AS worst', 'avg(bars) AS bars')} FROM t GROUP BY 1")
def _(spark, d):
    w = W.by_time()
    x = week_earned(spark, d).withColumn("before", F.coalesce(F.lag("pos").over(w), F.lit(0.0))).withColumn("earned", F.lead("gross").over(w))
    x = x.withColumn("trade", F.sum(F.when(F.col("pos") != F.col("before"), 1).otherwise(0)).over(W.so_far())).filter("pos <> 0 and earned is not null")
    t = x.groupBy("symbol", "trade").agg(F.sum("earned").alias("pnl"), F.count(F.lit(1)).alias("bars"))
    return rounded(t.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), F.avg((F.col("pnl") > 0).cast("int")).alias("win_rate"), F.avg("pnl").alias("mean"), F.percentile("pnl", 0.5).alias("median"), F.max("pnl").alias("best"), F.min("pnl").alias("worst"), F.avg("bars").alias("bars")))


@register("ag15_monthly", f"WITH {WEEK}, m AS (SELECT symbol, CAST(date_trunc('month', bar_ts) AS DATE) AS month, sum(ln(1 + ret)) AS g FROM rets WHERE ret IS NOT NULL GROUP BY 1, 2) SELECT symbol, count(*) AS months, {r('avg(CAST(g > 0 AS INT)) AS win_rate', 'min(exp(g) - 1) AS worst')} FROM m GROUP BY 1")
def _(spark, d):
    m = week_returns(spark, d).filter("ret is not null").groupBy("symbol", F.trunc("bar_ts", "month").alias("month")).agg(F.sum(F.log1p("ret")).alias("g"))
    return rounded(m.groupBy("symbol").agg(F.count(F.lit(1)).alias("months"), F.avg((F.col("g") > 0).cast("int")).alias("win_rate"), F.min(F.exp("g") - 1).alias("worst")))


@register("ag16_tails", f"WITH {WEEK} SELECT symbol, {r('min(ret) AS worst', 'quantile_cont(ret, 0.01) AS p01', 'quantile_cont(ret, 0.05) AS p05', 'avg(ret) FILTER (ret < 0) AS mean_loss')} FROM rets GROUP BY 1")
def _(spark, d):
    return rounded(week_returns(spark, d).groupBy("symbol").agg(F.min("ret").alias("worst"), F.percentile("ret", 0.01).alias("p01"), F.percentile("ret", 0.05).alias("p05"), F.avg(F.when(F.col("ret") < 0, F.col("ret"))).alias("mean_loss")))


@register("ag17_regime_metrics", f"WITH {WEEK}, {LABELS} SELECT lab.symbol, state, count(ret) AS n, {r('avg(ret) AS mean', 'stddev_samp(ret) AS sd', 'count(*) / sum(count(*)) OVER (PARTITION BY lab.symbol) AS share')} FROM lab JOIN rets USING (symbol, bar_ts) GROUP BY 1, 2")
def _(spark, d):
    x = week_labels(spark, d).join(week_returns(spark, d).select("symbol", "bar_ts", "ret"), ["symbol", "bar_ts"])
    g = x.groupBy("symbol", "state").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.count(F.lit(1)).alias("k"))
    return rounded(g.withColumn("share", F.col("k") / F.sum("k").over(Window.partitionBy("symbol"))).drop("k"))


@register("ag19_spearman", f"WITH {WEEK}, m AS (SELECT symbol, ret, volume FROM rets WHERE ret IS NOT NULL), k AS (SELECT symbol, ret, volume, rank() OVER (PARTITION BY symbol ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, ret) - 1) / 2 AS a, rank() OVER (PARTITION BY symbol ORDER BY volume) + (count(*) OVER (PARTITION BY symbol, volume) - 1) / 2 AS b FROM m) SELECT symbol, {r('corr(ret, volume) AS pearson', 'corr(a, b) AS spearman')} FROM k GROUP BY 1")
def _(spark, d):
    x = week_returns(spark, d).filter("ret is not null").withColumn("a", W.average_rank("ret", "symbol")).withColumn("b", W.average_rank("volume", "symbol"))
    return rounded(x.groupBy("symbol").agg(F.corr("ret", "volume").alias("pearson"), F.corr("a", "b").alias("spearman")))


@register("ag29_benchmark", f"WITH {WEEK} SELECT bar_ts, {r('avg(ret) AS ret')}, count(ret) AS n FROM rets GROUP BY 1 HAVING count(ret) > 0")
def _(spark, d):
    return rounded(week_returns(spark, d).groupBy("bar_ts").agg(F.avg("ret").alias("ret"), F.count("ret").alias("n")).filter("n > 0"))


@register("ag31_agreement", f"WITH {WEEK}, {LABELS}, b AS (SELECT symbol, bar_ts, state AS a, lag(state) OVER ({BY}) AS b FROM lab) SELECT a, b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY a), 6) AS share FROM b WHERE b IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    x = week_labels(spark, d).select(F.col("state").alias("a"), F.lag("state").over(W.by_time()).alias("b")).filter("b is not null")
    n = x.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return rounded(n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("a"))))


@register("ag23_status_counts", "SELECT o_orderdate AS day, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS filled, count(*) FILTER (o_orderstatus = 'O') AS open, round(sum(o_totalprice), 2) AS notional FROM orders GROUP BY 1")
def _(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").groupBy(F.col("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(s == "F").alias("filled"), F.count_if(s == "O").alias("open"), F.round(F.sum("o_totalprice"), 2).alias("notional"))


@register("wn4_relative_volume", f"WITH {WEEK} SELECT symbol, bar_ts, round(CASE WHEN count(*) OVER w = 12 THEN volume / avg(volume) OVER w END, 6) AS rel FROM panel WINDOW w AS ({BY} ROWS 11 PRECEDING)")
def _(spark, d):
    return rounded(weekly_panel(spark, d).select("symbol", "bar_ts", (F.col("volume") / W.rolling_mean("volume", 12)).alias("rel")))


@register("wn8_rolling_sharpe", f"WITH {WEEK}, s AS (SELECT symbol, CASE WHEN count(ret) OVER w = 52 THEN avg(ret) OVER w / (stddev_samp(ret) OVER w + 1e-8) * sqrt(52) END AS s FROM rets WINDOW w AS ({BY} ROWS 51 PRECEDING)) SELECT symbol, {r('min(s) AS least', 'max(s) AS most', 'median(s) AS median', 'avg(CAST(s > 0 AS INT)) AS positive')} FROM s WHERE s IS NOT NULL GROUP BY 1")
def _(spark, d):
    s = week_returns(spark, d).select("symbol", (W.rolling_mean("ret", 52) / (W.rolling_std("ret", 52) + 1e-8) * 52**0.5).alias("s")).filter("s is not null")
    return rounded(s.groupBy("symbol").agg(F.min("s").alias("least"), F.max("s").alias("most"), F.percentile("s", 0.5).alias("median"), F.avg((F.col("s") > 0).cast("int")).alias("positive")))


@register("wn15_percentile_of_last", f"WITH {WEEK}, l AS (SELECT symbol, bar_ts, close, list(close) OVER ({BY} ROWS 51 PRECEDING) AS h FROM panel) SELECT symbol, bar_ts, round(CASE WHEN len(h) = 52 THEN len(list_filter(h, lambda v: v <= close)) / 52 END, 6) AS pct FROM l")
def _(spark, d):
    x = weekly_panel(spark, d).withColumn("h", F.collect_list("close").over(W.last(52)))
    return rounded(x.select("symbol", "bar_ts", F.when(F.size("h") == 52, F.size(F.filter("h", lambda v: v <= F.col("close"))) / 52).alias("pct")))


@register("wn23_hit_rate", f"WITH {WEEK}, {LABELS}, {SIGNALS}, f AS (SELECT symbol, bar_ts, lead(ret) OVER ({BY}) AS fwd FROM rets) SELECT symbol, count(*) AS n, round(avg(CAST(sign(signal) = sign(fwd) AS INT)), 6) AS hit FROM sig JOIN f USING (symbol, bar_ts) WHERE abs(signal) > 0.05 AND fwd IS NOT NULL GROUP BY 1")
def _(spark, d):
    fwd = week_returns(spark, d).select("symbol", "bar_ts", F.lead("ret").over(W.by_time()).alias("fwd"))
    x = R.walk_forward(week_labels(spark, d), WIN, MIN_TRAIN).join(fwd, ["symbol", "bar_ts"]).filter("abs(signal) > 0.05 and fwd is not null")
    return rounded(x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg((F.signum("signal") == F.signum("fwd")).cast("int")).alias("hit")))


@register("wn28_vol_target", f"WITH {WEEK}, v AS (SELECT symbol, bar_ts, CASE WHEN count(ret) OVER w = 12 THEN stddev_samp(ret) OVER w * sqrt(52) END AS vol FROM rets WINDOW w AS ({BY} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) SELECT symbol, bar_ts, round(CASE WHEN vol > 0 THEN least(1.0, 0.5 / vol) ELSE 1.0 END, 6) AS scale FROM v")
def _(spark, d):
    v = week_returns(spark, d).withColumn("vol", W.trailing_vol("ret", 12, 52))
    return rounded(v.select("symbol", "bar_ts", F.when(F.col("vol") > 0, F.least(F.lit(1.0), 0.5 / F.col("vol"))).otherwise(F.lit(1.0)).alias("scale")))


@register("rg14_convergence", f"WITH {WEEK}, {LABELS}, {COUNTS}, m2 AS (SELECT a.symbol, a.from_state, b.to_state, sum(a.p * b.p) AS p FROM mat a JOIN mat b ON a.symbol = b.symbol AND a.to_state = b.from_state GROUP BY 1, 2, 3), m4 AS (SELECT a.symbol, a.from_state, b.to_state, sum(a.p * b.p) AS p FROM m2 a JOIN m2 b ON a.symbol = b.symbol AND a.to_state = b.from_state GROUP BY 1, 2, 3), u AS (SELECT symbol, 1 AS steps, from_state, to_state, p FROM mat UNION ALL SELECT symbol, 2, from_state, to_state, p FROM m2 UNION ALL SELECT symbol, 4, from_state, to_state, p FROM m4), s AS (SELECT symbol, steps, from_state, sum(CASE to_state WHEN 2 THEN p WHEN 0 THEN -p ELSE 0 END) AS s FROM u GROUP BY 1, 2, 3) SELECT symbol, steps, {r('max(abs(s)) AS strongest')} FROM s GROUP BY 1, 2")
def _(spark, d):
    m, out = week_matrix(spark, d), None
    for steps in (1, 2, 4):
        s = R.signal_vector(R.n_step(m, steps)).groupBy("symbol").agg(F.max(F.abs("signal")).alias("strongest")).select("symbol", F.lit(steps).alias("steps"), "strongest")
        out = s if out is None else out.unionByName(s)
    return rounded(out)


@register("rg22_masks", f"WITH {WEEK}, x AS (SELECT symbol, bar_ts, close, count(close) OVER w AS n, avg(close) OVER w AS ma, max(close) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS peak FROM panel WINDOW w AS ({BY} ROWS 25 PRECEDING)) SELECT symbol, bar_ts, coalesce(n = 26 AND close > ma, false) AS above_ma, close / peak - 1 < -0.1 AS in_drawdown FROM x")
def _(spark, d):
    p = weekly_panel(spark, d).withColumn("peak", F.max("close").over(W.so_far()))
    return p.select("symbol", "bar_ts", F.coalesce(F.col("close") > W.rolling_mean("close", 26), F.lit(False)).alias("above_ma"), (F.col("close") / F.col("peak") - 1 < -0.1).alias("in_drawdown"))


@register("dq17_unhandled", f"WITH {WEEK}, a AS (SELECT symbol, bar_ts, ret FROM rets WHERE abs(ret) >= 0.15), h AS (SELECT symbol, bar_ts FROM panel WHERE month(bar_ts) = 1) SELECT symbol, bar_ts, {r('ret')} FROM a ANTI JOIN h USING (symbol, bar_ts)")
def _(spark, d):
    p = weekly_panel(spark, d)
    handled = p.filter(F.month("bar_ts") == 1).select("symbol", "bar_ts")
    return rounded(Q.anomalies(p).join(handled, ["symbol", "bar_ts"], "left_anti").select("symbol", "bar_ts", "ret"))


@register("dq18_completeness", "WITH n AS (SELECT n_name AS symbol, count(*) AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) SELECT n_name AS symbol, coalesce(k, 0) AS n, CASE WHEN k IS NULL THEN 'no bars' WHEN k < 100 THEN 'too few' ELSE 'ok' END AS reason FROM nation LEFT JOIN n ON symbol = n_name")
def _(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_suppkey").count().join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.sum("count").alias("k"))
    out = table(spark, d, "nation").join(per, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    k = F.col("k")
    return out.select(F.col("n_name").alias("symbol"), F.coalesce(k, F.lit(0)).alias("n"), F.when(k.isNull(), "no bars").when(k < 100, "too few").otherwise("ok").alias("reason"))


@register("jn4_asof_forward", f"WITH {HOUR} SELECT e.event_id, min(b.bar_ts) AS bar_ts FROM events e LEFT JOIN bars b ON b.symbol = e.event_type AND b.bar_ts >= e.ts GROUP BY 1")
def _(spark, d):
    # Hours are a function of time: an event on the hour takes that hour's bar, any other the first bar of a later hour. Only hours are ordered, one row each;
    # events meet them by equality on (symbol, hour).
    bars = hourly_bars(spark, d).select("symbol", "bar_ts")
    ev = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("at"), "event_id").withColumn("hour", F.date_trunc("hour", "at").cast("timestamp_ntz"))
    hours = ev.select("symbol", "hour").distinct().withColumn("bar_ts", F.lit(None).cast("timestamp_ntz")).unionByName(bars.select("symbol", F.col("bar_ts").alias("hour"), "bar_ts"))
    hours = hours.groupBy("symbol", "hour").agg(F.max("bar_ts").alias("bar_ts"))
    w = Window.partitionBy("symbol").orderBy("hour")
    later = F.first("bar_ts", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    known = hours.select("symbol", "hour", "bar_ts", later.alias("later"))
    out = ev.join(known.hint("merge"), ["symbol", "hour"], "left")
    return out.select("event_id", F.when((F.col("at") == F.col("hour")) & F.col("bar_ts").isNotNull(), F.col("bar_ts")).otherwise(F.col("later")).alias("bar_ts"))


@register("jn12_leave_one_out", f"WITH {WEEK}, s AS (SELECT DISTINCT symbol AS dropped FROM panel) SELECT dropped, bar_ts, {r('avg(ret) AS ret')} FROM rets JOIN s ON symbol <> dropped WHERE ret IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    # The mean without one name from the date's totals: nothing is replayed per dropped name.
    x = week_returns(spark, d)
    day = x.filter("ret is not null").groupBy("bar_ts").agg(F.sum("ret").alias("s"), F.count("ret").alias("n"))
    names = x.select(F.col("symbol").alias("dropped")).distinct()
    own = x.select(F.col("symbol").alias("dropped"), "bar_ts", F.col("ret").alias("own"))
    all_days = day.crossJoin(names).join(own, ["dropped", "bar_ts"], "left")  # the result's own grid
    left = F.col("n") - F.col("own").isNotNull().cast("int")
    return rounded(all_days.filter(left > 0).select("dropped", "bar_ts", ((F.col("s") - F.coalesce("own", F.lit(0.0))) / left).alias("ret")))


@register("pf9_drift", f"WITH {TRADES}, {MARKED} SELECT account, symbol, {r('weight AS actual', '0.04 - weight AS drift')} FROM mk WHERE abs(0.04 - weight) > 0.01")
def _(spark, d):
    m = marked(spark, d).select("account", "symbol", F.col("weight").alias("actual"), (0.04 - F.col("weight")).alias("drift"))
    return rounded(m.filter(F.abs("drift") > 0.01))


@register("rk2_concentration", f"WITH {TRADES}, {MARKED} SELECT account, symbol, {r('weight')} FROM mk WHERE abs(weight) > 0.25 + 1e-6")
def _(spark, d):
    return rounded(marked(spark, d).filter(F.abs("weight") > 0.25 + 1e-6).select("account", "symbol", "weight"))


MOVED = f"{WEEK}, {SCORES}, {HELD}"


@register("fa15_ensemble", f"WITH {MOVED}, v AS (SELECT config, bar_ts, net, CASE WHEN count(net) OVER w = 26 THEN stddev_samp(net) OVER w END AS sd FROM pf WINDOW w AS (PARTITION BY config ORDER BY bar_ts ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)) SELECT bar_ts, round(sum(net / (sd + 1e-8)) / sum(1 / (sd + 1e-8)), 6) AS net FROM v WHERE sd > 1e-9 GROUP BY 1")
def _(spark, d):
    w = Window.partitionBy("config").orderBy("bar_ts").rowsBetween(-26, -1)
    v = week_portfolio(spark, d).withColumn("sd", F.when(F.count("net").over(w) == 26, F.stddev_samp("net").over(w))).filter("sd > 1e-9")
    inv = 1 / (F.col("sd") + 1e-8)
    return rounded(v.groupBy("bar_ts").agg((F.sum(F.col("net") * inv) / F.sum(inv)).alias("net")))


@register("ag32_divergence", f"WITH {MOVED}, x AS (SELECT a.bar_ts, a.net - b.net AS diff FROM pf a JOIN pf b ON a.bar_ts = b.bar_ts AND a.config = 'mom' AND b.config = 'both') SELECT count(*) AS n, {r('avg(diff) AS mean', 'stddev_samp(diff) AS sd', 'max(abs(diff)) AS most', 'sum(diff) AS total')} FROM x")
def _(spark, d):
    x = week_portfolio(spark, d).groupBy("bar_ts").pivot("config", ["mom", "both"]).agg(F.first("net")).withColumn("diff", F.col("mom") - F.col("both"))
    return rounded(x.agg(F.count("diff").alias("n"), F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("sd"), F.max(F.abs("diff")).alias("most"), F.sum("diff").alias("total")))


@register("rg20_regime_gate", f"WITH {WEEK}, {LABELS}, {SIGNALS}, {SCORES} SELECT config, symbol, bar_ts, side, {r('weight')} FROM wt JOIN sig USING (symbol, bar_ts) WHERE NOT coalesce((side = 1 AND signal < -0.05) OR (side = -1 AND signal > 0.05), false)")
def _(spark, d):
    s = R.walk_forward(week_labels(spark, d), WIN, MIN_TRAIN).select("symbol", "bar_ts", "signal")
    drop = F.coalesce(((F.col("side") == 1) & (F.col("signal") < -0.05)) | ((F.col("side") == -1) & (F.col("signal") > 0.05)), F.lit(False))
    return rounded(week_weights(spark, d).hint("merge").join(s.hint("merge"), ["symbol", "bar_ts"]).filter(~drop).select("config", "symbol", "bar_ts", "side", "weight"))


@register("rg19_calibration", f"WITH {WEEK}, {LABELS}, x AS (SELECT symbol, bar_ts, state, lag(state, {WIN}) OVER w AS was, lead(state, {WIN}) OVER w AS truth FROM lab WINDOW w AS ({BY})), c AS (SELECT *, " + ", ".join(f"sum(CASE WHEN was = {i} AND state = {j} THEN 1 ELSE 0 END) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS n{i}{j}" for i in range(3) for j in range(3)) + " FROM x), p AS (SELECT symbol, state, truth, " + ", ".join(f"(CASE state WHEN 0 THEN n0{j} WHEN 1 THEN n1{j} ELSE n2{j} END + 1) AS k{j}" for j in range(3)) + f" FROM c WHERE truth IS NOT NULL) SELECT symbol, count(*) AS n, {r('avg(-ln((CASE truth WHEN 0 THEN k0 WHEN 1 THEN k1 ELSE k2 END) / (k0 + k1 + k2))) AS log_loss')} FROM p GROUP BY 1")
def _(spark, d):
    w = W.by_time()
    x = week_labels(spark, d).withColumn("was", F.lag("state", WIN).over(w)).withColumn("truth", F.lead("state", WIN).over(w))
    # Running counts with one added to each cell, of the row that the current state picks.
    for j in range(3):
        row = [F.sum(F.when((F.col("was") == i) & (F.col("state") == j), 1).otherwise(0)).over(W.so_far()) for i in range(3)]
        x = x.withColumn(f"k{j}", F.when(F.col("state") == 0, row[0]).when(F.col("state") == 1, row[1]).otherwise(row[2]) + 1)
    x = x.filter("truth is not null")
    hit = F.when(F.col("truth") == 0, F.col("k0")).when(F.col("truth") == 1, F.col("k1")).otherwise(F.col("k2"))
    return rounded(x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(-F.ln(hit / (F.col("k0") + F.col("k1") + F.col("k2")))).alias("log_loss")))


@register("wn27_ewma_vol", f"WITH {WEEK}, l AS (SELECT symbol, bar_ts, list(ret * ret) OVER ({BY} ROWS 59 PRECEDING) AS h FROM rets WHERE ret IS NOT NULL) SELECT symbol, bar_ts, round(sqrt(list_reduce(h, lambda a, x: a * (31.0 / 33) + x * (2.0 / 33)) * 52), 6) AS vol FROM l")
def _(spark, d):
    # Span 32 over at most 60 bars up to this one, seeded by the first of them; ``wn27_ewma_forms`` has the bars before the decision and the unbounded form.
    x = week_returns(spark, d).filter("ret is not null").withColumn("h", F.collect_list(F.col("ret") * F.col("ret")).over(W.last(60)))
    ewma = F.aggregate(F.slice("h", 2, 60), F.element_at("h", 1), lambda a, v: a * (31.0 / 33) + v * (2.0 / 33))
    return rounded(x.select("symbol", "bar_ts", F.sqrt(ewma * 52).alias("vol")))
