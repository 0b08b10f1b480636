"""Registered queries of studies: summaries, ledgers over time, selections, grids and conditional statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.maths import adjusted_kurtosis, adjusted_skew
from ..operators import backoffice as B
from ..operators import factors as A
from ..operators import regime as R
from ..operators import windows as W
from ..sources.panels import hourly_bars, read_bars_csv, read_wide_csv, table, trades, vendor_bars, weekly_panel
from ..sources.shared import shared_folder
from .factors import HELD, SCORES, configs, week_factors, week_portfolio
from .ledger import BROKER, ISSUES, KEYS, MARKED, OPENING, TRADES, books, broker, marked
from .panel import COUNTS, EARNED, HOUR, LABELS, MIN_TRAIN, SIGNALS, WEEK, WIN, YEAR, r, register, rounded, week_earned, week_labels, week_returns

BY = "PARTITION BY symbol ORDER BY bar_ts"
MOVED = f"{WEEK}, {SCORES}, {HELD}"
EARN = f"{WEEK}, {LABELS}, {SIGNALS}, {EARNED}"
SPLIT = "xs AS (SELECT bar_ts, row_number() OVER (ORDER BY bar_ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT bar_ts FROM panel)), spl AS (SELECT bar_ts, CASE WHEN i < floor(n * 0.6) THEN 'TRAIN' WHEN i < floor(n * 0.8) THEN 'VALIDATION' ELSE 'TRUE_OOS' END AS split FROM xs)"


def share(condition):
    return F.avg(condition.cast("int"))


@register("ag4_estimators", f"""WITH {WEEK}, {LABELS}, {COUNTS}, sk AS (SELECT symbol, state, bar_ts, row_number() OVER ({BY}) - 1 AS k FROM lab), sp AS (SELECT symbol, state AS from_state, lead(state) OVER ({BY}) AS to_state FROM sk WHERE k % {WIN} = 0),
sc1 AS (SELECT symbol, from_state, to_state, count(*) AS n FROM sp WHERE to_state IS NOT NULL GROUP BY 1, 2, 3)
SELECT 'phase' AS kind, symbol, from_state, to_state, n, round(n / sum(n) OVER (PARTITION BY symbol, from_state), 6) AS p FROM cnt UNION ALL SELECT 'single', symbol, from_state, to_state, n, round(n / sum(n) OVER (PARTITION BY symbol, from_state), 6) FROM sc1""")
def _(spark, d):
    lab = week_labels(spark, d)
    both = None
    for kind in ("phase", "single"):
        c = R.transitions(lab, WIN, kind).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("symbol", "from_state"))).select(F.lit(kind).alias("kind"), "symbol", "from_state", "to_state", "n", "p")
        both = c if both is None else both.unionByName(c)
    return rounded(both)


@register("ag8_turnover", f"WITH {EARN} SELECT symbol, {r('sum(turnover) AS total', 'avg(turnover) AS per_bar', 'avg(turnover) * 52 AS annual')} FROM ern GROUP BY 1")
def _(spark, d):
    return rounded(week_earned(spark, d).groupBy("symbol").agg(F.sum("turnover").alias("total"), F.avg("turnover").alias("per_bar"), (F.avg("turnover") * YEAR).alias("annual")))


@register("ag10_pass_rates", f"WITH {WEEK}, g AS (SELECT symbol, count(*) FILTER (abs(ret) >= 0.15) = 0 AS clean, count(*) >= 300 AS long, min(close) > 0 AS positive FROM rets GROUP BY 1), u AS (SELECT 'clean' AS gate, clean AS ok FROM g UNION ALL SELECT 'long', long FROM g UNION ALL SELECT 'positive', positive FROM g UNION ALL SELECT 'all', clean AND long AND positive FROM g) SELECT gate, count(*) AS n, count(*) FILTER (ok) AS passed, round(avg(CAST(ok AS INT)), 6) AS rate FROM u GROUP BY 1")
def _(spark, d):
    g = week_returns(spark, d).groupBy("symbol").agg((F.count_if(F.abs("ret") >= 0.15) == 0).alias("clean"), (F.count(F.lit(1)) >= 300).alias("long"), (F.min("close") > 0).alias("positive"))
    gates = g.withColumn("all", F.col("clean") & F.col("long") & F.col("positive")).unpivot("symbol", ["clean", "long", "positive", "all"], "gate", "ok")
    return rounded(gates.groupBy("gate").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("passed"), share(F.col("ok")).alias("rate")))


@register("ag12_sector_rollup", f"WITH {EARN}, m AS (SELECT symbol, avg(net) / nullif(stddev_samp(net), 0) * sqrt(52) AS sharpe, sum(net) AS total, sum(turnover) AS turnover, count(net) AS n FROM ern GROUP BY 1), s AS (SELECT DISTINCT symbol, sector FROM panel) SELECT sector, count(*) AS symbols, {r('avg(sharpe) AS mean_sharpe', 'median(sharpe) AS median_sharpe', 'max(sharpe) AS best', 'min(sharpe) AS worst', 'avg(CAST(sharpe > 0 AS INT)) AS positive', 'sum(total) AS total', 'avg(turnover) AS turnover')} FROM m JOIN s USING (symbol) GROUP BY 1")
def _(spark, d):
    m = week_earned(spark, d).groupBy("symbol").agg((F.avg("net") / F.nullif(F.stddev_samp("net"), F.lit(0.0)) * YEAR**0.5).alias("sharpe"), F.sum("net").alias("total"), F.sum("turnover").alias("turnover"))
    s = weekly_panel(spark, d).select("symbol", "sector").distinct()
    x = F.col("sharpe")
    return rounded(m.join(s, "symbol").groupBy("sector").agg(F.count(F.lit(1)).alias("symbols"), F.avg(x).alias("mean_sharpe"), F.percentile(x, 0.5).alias("median_sharpe"), F.max(x).alias("best"), F.min(x).alias("worst"), share(x > 0).alias("positive"), F.sum("total").alias("total"), F.avg("turnover").alias("turnover")))


@register("ag15_weekly", f"WITH {HOUR}, d AS (SELECT symbol, CAST(bar_ts AS DATE) AS day, arg_max(close, bar_ts) AS close FROM bars GROUP BY 1, 2), q AS (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM d), w AS (SELECT symbol, CAST(date_trunc('week', day) AS DATE) + 6 AS week_end, product(1 + ret) - 1 AS ret, count(*) AS n FROM q WHERE ret IS NOT NULL GROUP BY 1, 2) SELECT symbol, week_end, n, {r('ret')}, rank() OVER (PARTITION BY symbol ORDER BY ret) = 1 AS worst FROM w")
def _(spark, d):
    day = hourly_bars(spark, d).groupBy("symbol", F.to_date("bar_ts").alias("day")).agg(F.max_by("close", "bar_ts").alias("close"))
    q = day.withColumn("ret", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("day")) - 1).filter("ret is not null")
    w = q.groupBy("symbol", F.date_add(F.trunc("day", "week"), 6).alias("week_end")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"), F.count(F.lit(1)).alias("n"))
    return rounded(w.withColumn("worst", F.rank().over(Window.partitionBy("symbol").orderBy("ret")) == 1))


@register("ag16_moments", f"WITH {WEEK} SELECT symbol, count(ret) AS n, {r('skewness(ret) AS skew', 'kurtosis(ret) AS kurt')} FROM rets GROUP BY 1")
def _(spark, d):
    m = week_returns(spark, d).groupBy("symbol").agg(F.count("ret").alias("n"), F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2"))
    n = F.col("n").cast("double")
    return rounded(m.select("symbol", "n", adjusted_skew(F.col("g1"), n).alias("skew"), adjusted_kurtosis(F.col("g2"), n).alias("kurt")))


MASKS = """
mk0 AS (SELECT symbol, bar_ts, ret, close, CASE WHEN count(close) OVER a = 10 THEN avg(close) OVER a END AS ma10, CASE WHEN count(close) OVER b = 40 THEN avg(close) OVER b END AS ma40, CASE WHEN count(ret) OVER a = 10 THEN sum(ret) OVER a END AS rate, CASE WHEN count(ret) OVER c = 12 THEN stddev_samp(ret) OVER c END AS vol,
  close / max(close) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM rets WINDOW a AS (PARTITION BY symbol ORDER BY bar_ts ROWS 9 PRECEDING), b AS (PARTITION BY symbol ORDER BY bar_ts ROWS 39 PRECEDING), c AS (PARTITION BY symbol ORDER BY bar_ts ROWS 11 PRECEDING)),
md AS (SELECT symbol, median(vol) AS med FROM mk0 GROUP BY 1),
msk AS (SELECT mk0.*, coalesce(close > ma10, false) AS above_short, coalesce(close > ma40, false) AS above_long, coalesce(rate > 0, false) AS rising, coalesce(vol > med, false) AS high_vol, coalesce(vol <= med, false) AS low_vol, coalesce(dd < -0.1, false) AS market_down FROM mk0 JOIN md USING (symbol))"""
MASK_NAMES = ["above_short", "above_long", "rising", "high_vol", "low_vol", "market_down"]


def masks(spark, d):
    x = week_returns(spark, d).withColumn("vol", W.rolling_std("ret", 12)).withColumn("dd", F.col("close") / F.max("close").over(W.so_far()) - 1)
    x = x.withColumn("ma10", W.rolling_mean("close", 10)).withColumn("ma40", W.rolling_mean("close", 40)).withColumn("rate", W.rolling_mean("ret", 10))
    med = x.groupBy("symbol").agg(F.percentile("vol", 0.5).alias("med"))
    true = lambda c: F.coalesce(c, F.lit(False))
    c = F.col
    return x.join(med, "symbol").select("symbol", "bar_ts", "ret", true(c("close") > c("ma10")).alias("above_short"), true(c("close") > c("ma40")).alias("above_long"), true(c("rate") > 0).alias("rising"), true(c("vol") > c("med")).alias("high_vol"), true(c("vol") <= c("med")).alias("low_vol"), true(c("dd") < -0.1).alias("market_down"))


@register("rg22_six_masks", f"WITH {WEEK}, {MASKS} SELECT symbol, bar_ts, {', '.join(MASK_NAMES)} FROM msk")
def _(spark, d):
    return masks(spark, d).drop("ret")


@register("ag17_masked_metrics", f"WITH {WEEK}, {MASKS}, u AS ({' UNION ALL '.join(f'''SELECT '{m}' AS mask, symbol, ret, {m} AS held FROM msk WHERE ret IS NOT NULL''' for m in MASK_NAMES)}) SELECT mask, symbol, count(*) FILTER (held) AS n, {r('avg(ret) FILTER (held) AS mean', 'stddev_samp(ret) FILTER (held) * sqrt(52) AS vol', 'avg(ret) FILTER (held) / nullif(stddev_samp(ret) FILTER (held), 0) * sqrt(52) AS sharpe', 'avg(CAST(held AS INT)) AS share')} FROM u GROUP BY 1, 2")
def _(spark, d):
    u = masks(spark, d).filter("ret is not null").unpivot(["symbol", "ret"], MASK_NAMES, "mask", "held")
    x = F.when(F.col("held"), F.col("ret"))
    return rounded(u.groupBy("mask", "symbol").agg(F.count_if("held").alias("n"), F.avg(x).alias("mean"), (F.stddev_samp(x) * YEAR**0.5).alias("vol"), (F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * YEAR**0.5).alias("sharpe"), share(F.col("held")).alias("share")))


@register("ag18_compounded", f"WITH {EARN}, {SPLIT} SELECT symbol, split, count(*) AS n, {r('product(1 + net) - 1 AS total', 'stddev_samp(net) * sqrt(52) AS vol', 'avg(net) / nullif(stddev_samp(net), 0) * sqrt(52) AS sharpe', 'sum(turnover) AS turnover')} FROM ern JOIN spl USING (bar_ts) GROUP BY 1, 2")
def _(spark, d):
    x = week_earned(spark, d).join(W.split_of(weekly_panel(spark, d)), "bar_ts")
    return rounded(x.groupBy("symbol", "split").agg(F.count(F.lit(1)).alias("n"), (F.product(1 + F.col("net")) - 1).alias("total"), (F.stddev_samp("net") * YEAR**0.5).alias("vol"), (F.avg("net") / F.nullif(F.stddev_samp("net"), F.lit(0.0)) * YEAR**0.5).alias("sharpe"), F.sum("turnover").alias("turnover")))


CONDITIONS = {"all": "true", "either_down": "ret < 0 OR mkt < 0", "both_down": "ret < 0 AND mkt < 0", "bull": "state = 2", "bear": "state = 0", "drawdown": "dd < -0.1"}


@register("ag19_conditional", f"WITH {WEEK}, {LABELS}, m AS (SELECT symbol, bar_ts, ret, avg(ret) OVER (PARTITION BY bar_ts) AS mkt, close / max(close) OVER ({BY} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM rets), x AS (SELECT m.*, state FROM m JOIN lab USING (symbol, bar_ts) WHERE ret IS NOT NULL), g AS ({' UNION ALL '.join(f'''SELECT '{k}' AS condition, symbol, count(*) AS n, CASE WHEN count(*) >= 10 THEN corr(ret, mkt) END AS corr, covar_samp(ret, mkt) AS cov FROM x WHERE {c} GROUP BY 2''' for k, c in CONDITIONS.items())}) SELECT condition, symbol, n, {r('corr', 'cov')} FROM g")
def _(spark, d):
    x = week_returns(spark, d).withColumn("mkt", F.avg("ret").over(W.cross())).withColumn("dd", F.col("close") / F.max("close").over(W.so_far()) - 1).select("symbol", "bar_ts", "ret", "mkt", "dd")
    x = x.join(week_labels(spark, d).select("symbol", "bar_ts", "state"), ["symbol", "bar_ts"]).filter("ret is not null")
    # Each row once per condition that it meets, then one grouping.
    tags = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in CONDITIONS.items()]))
    g = x.withColumn("condition", F.explode(tags)).groupBy("condition", "symbol").agg(F.count(F.lit(1)).alias("n"), F.corr("ret", "mkt").alias("corr"), F.covar_samp("ret", "mkt").alias("cov"))
    return rounded(g.withColumn("corr", F.when(F.col("n") >= 10, F.col("corr"))))


PAIRED = "pv AS (SELECT a.bar_ts, a.net AS x, b.net AS y FROM pf a JOIN pf b ON a.bar_ts = b.bar_ts AND a.config = 'mom' AND b.config = 'val')"


def paired(spark, d):
    return week_portfolio(spark, d).groupBy("bar_ts").pivot("config", ["mom", "val"]).agg(F.first("net")).select("bar_ts", F.col("mom").alias("x"), F.col("val").alias("y"))


@register("ag21_variance_identity", f"WITH {MOVED}, {PAIRED}, g AS (SELECT var_samp(0.6 * x + 0.4 * y) AS whole, 0.36 * var_samp(x) + 0.16 * var_samp(y) + 0.48 * covar_samp(x, y) AS parts FROM pv) SELECT {r('whole', 'parts')}, abs(whole - parts) <= 1e-9 * greatest(1, whole) AS holds FROM g")
def _(spark, d):
    g = paired(spark, d).agg(F.var_samp(0.6 * F.col("x") + 0.4 * F.col("y")).alias("whole"), (0.36 * F.var_samp("x") + 0.16 * F.var_samp("y") + 0.48 * F.covar_samp("x", "y")).alias("parts"))
    return rounded(g.withColumn("holds", F.abs(F.col("whole") - F.col("parts")) <= 1e-9 * F.greatest(F.lit(1.0), F.col("whole"))))


NAVS = f"""
nv0 AS (SELECT account, filled_at, arg_max(cash, (filled_at, symbol, side)) AS cash, sum(change) AS change FROM (SELECT account, filled_at, symbol, side, sum(-sgn * value - commission) OVER (PARTITION BY account ORDER BY filled_at, symbol, side ROWS UNBOUNDED PRECEDING) AS cash, sgn * quantity * round(px.price, 2) AS change FROM sg JOIN px USING (symbol)) GROUP BY 1, 2),
nav AS (SELECT account, filled_at, round({OPENING} * 20 + cash + sum(change) OVER (PARTITION BY account ORDER BY filled_at), 2) AS nav FROM nv0)"""


def navs(spark, d):
    """Net asset value after each day with fills, positions valued at the last price of their symbol."""
    mark = marked(spark, d).select("symbol", F.round("price", 2).alias("mark")).distinct()
    x = B.running_ledger(trades(spark, d), "account", ["filled_at", "symbol", "side"]).join(mark, "symbol")
    day = x.groupBy("account", "filled_at").agg(F.max_by("cash", F.struct("filled_at", "symbol", "side")).alias("cash"), F.sum(F.col("signed") * F.col("mark")).alias("change"))
    return day.select("account", "filled_at", F.round(OPENING * 20 + F.col("cash") + F.sum("change").over(Window.partitionBy("account").orderBy("filled_at")), 2).alias("nav"))


@register("ag23_ledger_summary", f"WITH {TRADES}, {MARKED}, {NAVS}, {BROKER}, {ISSUES}, p AS (SELECT account, filled_at, nav, nav / max(nav) OVER (PARTITION BY account ORDER BY filled_at) - 1 AS dd FROM nav), n AS (SELECT account, count(*) AS days, arg_min(nav, filled_at) AS first_nav, arg_max(nav, filled_at) AS last_nav, max(abs(dd)) AS worst FROM p GROUP BY 1), c AS (SELECT account, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells, sum(commission) AS commission FROM tr GROUP BY 1), i AS (SELECT account, count(*) AS failures FROM iss GROUP BY 1) SELECT account, days, buys, sells, coalesce(failures, 0) AS failures, round(commission, 4) AS commission, first_nav, last_nav, {r('worst')} FROM n JOIN c USING (account) LEFT JOIN i USING (account)")
def _(spark, d):
    p = navs(spark, d).withColumn("dd", F.col("nav") / F.max("nav").over(Window.partitionBy("account").orderBy("filled_at")) - 1)
    n = p.groupBy("account").agg(F.count(F.lit(1)).alias("days"), F.min_by("nav", "filled_at").alias("first_nav"), F.max_by("nav", "filled_at").alias("last_nav"), F.max(F.abs("dd")).alias("worst"))
    c = trades(spark, d).groupBy("account").agg(F.count_if(F.col("side") == "BUY").alias("buys"), F.count_if(F.col("side") == "SELL").alias("sells"), F.round(F.sum("commission"), 4).alias("commission"))
    i = B.reconcile(books(spark, d), broker(spark, d), KEYS, "quantity", 1e-6).groupBy("account").agg(F.count(F.lit(1)).alias("failures"))
    return n.join(c, "account").join(i, "account", "left").withColumn("failures", F.coalesce("failures", F.lit(0))).withColumn("worst", F.round("worst", 6))


@register("ag24_nav_path", f"WITH {TRADES}, {MARKED}, {NAVS} SELECT account, count(*) AS n, md5(string_agg(filled_at || '=' || CAST(round(nav * 100) AS BIGINT), ';' ORDER BY filled_at)) AS path_md5 FROM nav GROUP BY 1")
def _(spark, d):
    # The path itself is an array of (day, value) by account; its digest stands for it here.
    path = navs(spark, d).groupBy("account").agg(F.sort_array(F.collect_list(F.struct("filled_at", "nav"))).alias("path"))
    text = F.array_join(F.transform("path", lambda x: F.concat_ws("=", x["filled_at"].cast("string"), F.round(x["nav"] * 100).cast("long").cast("string"))), ";")
    return path.select("account", F.size("path").cast("long").alias("n"), F.md5(text).alias("path_md5"))


@register("ag25_burn_in", "WITH l AS (SELECT l_orderkey, sum(l_tax) AS commission, count(*) AS fills FROM lineitem GROUP BY 1) SELECT o_orderpriority AS strategy, count(*) AS attempts, count(*) FILTER (o_orderstatus = 'F') AS successes, round(avg(CAST(fills IS NOT NULL AS INT)), 6) AS match_rate, round(sum(coalesce(commission, 0)), 4) AS commission, count(*) FILTER (o_orderstatus = 'F') >= 30 AND count(*) = count(fills) AS complete FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1")
def _(spark, d):
    fills = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_tax").alias("commission"), F.count(F.lit(1)).alias("fills"))
    x = table(spark, d, "orders").join(fills, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    good = F.count_if(F.col("o_orderstatus") == "F")
    return x.groupBy(F.col("o_orderpriority").alias("strategy")).agg(F.count(F.lit(1)).alias("attempts"), good.alias("successes"), F.round(share(F.col("fills").isNotNull()), 6).alias("match_rate"), F.round(F.sum(F.coalesce("commission", F.lit(0.0))), 4).alias("commission"), ((good >= 30) & (F.count(F.lit(1)) == F.count("fills"))).alias("complete"))


@register("ag26_canary", "SELECT l_shipdate AS day, count(*) AS fills, count(*) - count(DISTINCT l_orderkey || '-' || l_linenumber) AS duplicates, count(DISTINCT l_suppkey) AS accounts, round(sum(l_extendedprice), 2) AS notional FROM lineitem GROUP BY 1")
def _(spark, d):
    execution = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").groupBy(F.col("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("fills"), (F.count(F.lit(1)) - F.count_distinct(execution)).alias("duplicates"), F.count_distinct("l_suppkey").alias("accounts"), F.round(F.sum("l_extendedprice"), 2).alias("notional"))


@register("ag27_executed_batches", "SELECT o_orderdate AS day, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "P")).groupBy(F.col("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@register("ag28_peak_nav", f"WITH {TRADES}, {MARKED}, {NAVS} SELECT account, max(nav) AS peak FROM nav GROUP BY ROLLUP (account)")
def _(spark, d):
    return navs(spark, d).rollup("account").agg(F.max("nav").alias("peak"))


HOURLY = f"""
hf AS (SELECT symbol, bar_ts, close, volume, close / lag(close, 20) OVER w - 1 AS wret, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS ({BY})),
hg AS (SELECT symbol, bar_ts, wret, CASE WHEN count(tr) OVER v = 14 THEN avg(tr) OVER v END / close AS atr, CASE WHEN count(volume) OVER u = 20 THEN volume / avg(volume) OVER u END AS rel FROM hf WINDOW v AS ({BY} ROWS 13 PRECEDING), u AS ({BY} ROWS 19 PRECEDING))"""


def hour_features(spark, d):
    b = hourly_bars(spark, d).withColumn("tr", W.true_range()).withColumn("wret", W.trailing_return(20))
    return b.select("symbol", "bar_ts", "wret", (W.rolling_mean("tr", 14) / F.col("close")).alias("atr"), (F.col("volume") / W.rolling_mean("volume", 20)).alias("rel"))


@register("ag30_state_features", f"WITH {HOUR}, {HOURLY}, s AS (SELECT *, CASE WHEN wret >= 0.05 THEN 2 WHEN wret <= -0.05 THEN 0 ELSE 1 END AS state FROM hg WHERE wret IS NOT NULL) SELECT symbol, state, count(*) AS n, {r('avg(wret) AS wret', 'avg(atr) AS atr', 'avg(rel) AS rel', 'stddev_samp(rel) AS rel_sd')} FROM s GROUP BY 1, 2")
def _(spark, d):
    s = hour_features(spark, d).filter("wret is not null").withColumn("state", F.when(F.col("wret") >= 0.05, 2).when(F.col("wret") <= -0.05, 0).otherwise(1))
    return rounded(s.groupBy("symbol", "state").agg(F.count(F.lit(1)).alias("n"), F.avg("wret").alias("wret"), F.avg("atr").alias("atr"), F.avg("rel").alias("rel"), F.stddev_samp("rel").alias("rel_sd")))


@register("ag32_streams", f"WITH {MOVED}, {PAIRED}, c AS (SELECT bar_ts, x, y, abs(sum(x - y) OVER (ORDER BY bar_ts)) AS cum FROM pv) SELECT count(*) AS n, {r('avg(abs(x - y)) AS mean', 'stddev_samp(x - y) AS sd', 'max(abs(x - y)) AS most', 'corr(x, y) AS corr', 'max(cum) AS cumulative')} FROM c")
def _(spark, d):
    x = paired(spark, d).withColumn("diff", F.col("x") - F.col("y"))
    x = x.withColumn("cum", F.abs(F.sum("diff").over(Window.orderBy("bar_ts"))))  # one row per date
    return rounded(x.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("diff")).alias("mean"), F.stddev_samp("diff").alias("sd"), F.max(F.abs("diff")).alias("most"), F.corr("x", "y").alias("corr"), F.max("cum").alias("cumulative")))


@register("ag33_leaderboard", f"WITH {EARN}, {SPLIT}, g AS (SELECT symbol, split, avg(net) / nullif(stddev_samp(net), 0) * sqrt(52) AS s FROM ern JOIN spl USING (bar_ts) GROUP BY 1, 2), p AS (SELECT symbol, max(s) FILTER (split = 'VALIDATION') AS val, max(s) FILTER (split = 'TRUE_OOS') AS oos FROM g GROUP BY 1) SELECT symbol, {r('val', 'oos', 'val - oos AS degradation')}, coalesce(oos > 0, false) AS survives, row_number() OVER (ORDER BY val DESC NULLS LAST, symbol) AS place, count(*) FILTER (oos > 0) OVER () AS survivors FROM p")
def _(spark, d):
    x = week_earned(spark, d).join(W.split_of(weekly_panel(spark, d)), "bar_ts")
    g = x.groupBy("symbol", "split").agg((F.avg("net") / F.nullif(F.stddev_samp("net"), F.lit(0.0)) * YEAR**0.5).alias("s"))
    p = g.groupBy("symbol").agg(F.max(F.when(F.col("split") == "VALIDATION", F.col("s"))).alias("val"), F.max(F.when(F.col("split") == "TRUE_OOS", F.col("s"))).alias("oos"))
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("val"), "symbol"))  # one row per configuration
    return rounded(p.select("symbol", "val", "oos", (F.col("val") - F.col("oos")).alias("degradation"), F.coalesce(F.col("oos") > 0, F.lit(False)).alias("survives"), place.alias("place"), F.count_if(F.col("oos") > 0).over(Window.partitionBy(F.lit(1))).alias("survivors")))


@register("wn13_both_ends", f"WITH {WEEK}, {SCORES} SELECT config, symbol, bar_ts, side, {r('score')} FROM sel")
def _(spark, d):
    s = week_factors(spark, d).select("symbol", "bar_ts", "vol", configs()).filter("vol is not null")
    return rounded(A.both_ends(s, "score", 2, ["config"]).select("config", "symbol", "bar_ts", "side", "score"))


@register("wn14_sector_ends", f"WITH {WEEK}, {SCORES}, k AS (SELECT sector, symbol, bar_ts, zm, row_number() OVER (PARTITION BY bar_ts, sector ORDER BY zm DESC, symbol) AS up, row_number() OVER (PARTITION BY bar_ts, sector ORDER BY zm, symbol) AS down, count(*) OVER (PARTITION BY bar_ts, sector) AS n FROM fs WHERE zm IS NOT NULL) SELECT sector, bar_ts, symbol, CASE WHEN up = 1 THEN 1 ELSE -1 END AS side FROM k WHERE n >= 2 AND (up = 1 OR down = 1)")
def _(spark, d):
    w = Window.partitionBy("bar_ts", "sector")
    k = week_factors(spark, d).filter("zm is not null").withColumn("up", F.row_number().over(w.orderBy(F.desc("zm"), "symbol"))).withColumn("down", F.row_number().over(w.orderBy("zm", "symbol"))).withColumn("n", F.count(F.lit(1)).over(w))
    return k.filter("n >= 2 and (up = 1 or down = 1)").select("sector", "bar_ts", "symbol", F.when(F.col("up") == 1, 1).otherwise(-1).alias("side"))


@register("wn22_spread_z", f"WITH {WEEK}, s AS (SELECT a.symbol AS i, b.symbol AS j, a.bar_ts, a.close - b.close AS spread FROM panel a JOIN panel b ON a.sector = b.sector AND a.bar_ts = b.bar_ts AND a.symbol < b.symbol) SELECT i, j, bar_ts, {r('spread')}, round((spread - CASE WHEN count(*) OVER w = 60 THEN avg(spread) OVER w ELSE 0 END) / (CASE WHEN count(*) OVER w = 60 THEN stddev_samp(spread) OVER w ELSE 1 END + 1e-8), 6) AS z FROM s WINDOW w AS (PARTITION BY i, j ORDER BY bar_ts ROWS 59 PRECEDING)")
def _(spark, d):
    from ..operators.pairs import sides, spread_z

    s = sides(weekly_panel(spark, d), ["close"], ["sector", "bar_ts"]).select("i", "j", "bar_ts", (F.col("close_i") - F.col("close_j")).alias("spread"))
    return rounded(spread_z(s, ["i", "j"], 60))


HISTORY = f"eh AS (SELECT symbol, bar_ts, list(ret) OVER ({BY} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS h, list(ret) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS whole FROM rets WHERE ret IS NOT NULL)"


@register("wn27_ewma_forms", f"WITH {WEEK}, {HISTORY} SELECT symbol, bar_ts, round(CASE WHEN len(h) > 0 THEN sqrt(list_reduce(list_transform(h, lambda x: x * x), lambda a, x: a * (31.0 / 33) + x * (2.0 / 33)) * 52) END, 6) AS ewma, round(CASE WHEN len(h) > 0 THEN sqrt(list_sum(list_transform(h, lambda x: CASE WHEN x < 0 THEN x * x ELSE 0 END)) / len(h) * 52) END, 6) AS semi, round(sqrt(list_reduce(list_transform(whole, lambda x: x * x), lambda a, x: a * (31.0 / 33) + x * (2.0 / 33)) * 52), 6) AS unbounded FROM eh")
def _(spark, d):
    # The bars before the decision, at most 60 of them, and the unbounded form, which carries its state over pieces of the series.
    x = week_returns(spark, d).filter("ret is not null")
    bounded = x.withColumn("ewma", W.ewma_vol("ret", 60, 32, YEAR)).withColumn("semi", W.downside_vol("ret", 60, YEAR))
    return rounded(W.ewma_unbounded(bounded, "ret", 32, YEAR, "unbounded").select("symbol", "bar_ts", "ewma", "semi", "unbounded"))


@register("so4_rankings", f"WITH {EARN}, m AS (SELECT symbol, avg(net) / nullif(stddev_samp(net), 0) * sqrt(52) AS sharpe, sum(net) AS total FROM ern GROUP BY 1) SELECT symbol, {r('sharpe', 'total')}, row_number() OVER (ORDER BY sharpe DESC NULLS LAST, symbol) AS place FROM m")
def _(spark, d):
    m = week_earned(spark, d).groupBy("symbol").agg((F.avg("net") / F.nullif(F.stddev_samp("net"), F.lit(0.0)) * YEAR**0.5).alias("sharpe"), F.sum("net").alias("total"))
    return rounded(m.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("sharpe"), "symbol"))))  # one row per symbol


@register("so5_best_candidate", f"WITH {EARN}, m AS (SELECT symbol, avg(net) / nullif(stddev_samp(net), 0) * sqrt(52) AS sharpe, sum(net) AS total, count(*) FILTER (net <> 0) AS active FROM ern GROUP BY 1) SELECT symbol, {r('sharpe', 'total')}, active >= 150 AND sharpe > 0.2 AS passed FROM m ORDER BY (active >= 150 AND sharpe > 0.2) DESC, CASE WHEN active >= 150 AND sharpe > 0.2 THEN sharpe END DESC NULLS LAST, CASE WHEN active >= 150 AND sharpe > 0.2 THEN total END DESC NULLS LAST, symbol LIMIT 1")
def _(spark, d):
    m = week_earned(spark, d).groupBy("symbol").agg((F.avg("net") / F.nullif(F.stddev_samp("net"), F.lit(0.0)) * YEAR**0.5).alias("sharpe"), F.sum("net").alias("total"), F.count_if(F.col("net") != 0).alias("active"))
    m = m.withColumn("passed", (F.col("active") >= 150) & (F.col("sharpe") > 0.2))
    # Those that pass by both keys, else the first by name.
    own = lambda c: F.when(F.col("passed"), F.col(c))
    return rounded(m.orderBy(F.desc("passed"), own("sharpe").desc_nulls_last(), own("total").desc_nulls_last(), "symbol").limit(1).drop("active"))


@register("so6_in_time_order", "SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O'")
def _(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", "o_orderdate")
    return o.withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))


@register("se1_union_of_keys", f"WITH {TRADES}, {BROKER} SELECT account, symbol FROM bk UNION SELECT account, symbol FROM br")
def _(spark, d):
    return books(spark, d).select("account", "symbol").union(broker(spark, d).select("account", "symbol")).distinct()


@register("se2_common_dates", f"WITH {WEEK}, s AS (SELECT count(DISTINCT symbol) AS n FROM panel) SELECT bar_ts FROM panel, s GROUP BY bar_ts, n HAVING count(*) = n")
def _(spark, d):
    # The intersection of all symbols' calendars: dates that every symbol has.
    p = weekly_panel(spark, d)
    n = p.agg(F.count_distinct("symbol").alias("n"))
    return p.groupBy("bar_ts").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("bar_ts")


@register("jn1_inner_align", f"WITH {WEEK}, {LABELS}, {SIGNALS} SELECT symbol, bar_ts, {r('ret', 'signal')}, state FROM rets JOIN sig USING (symbol, bar_ts)")
def _(spark, d):
    s = R.walk_forward(week_labels(spark, d), WIN, MIN_TRAIN).select("symbol", "bar_ts", "signal", "state")
    return rounded(week_returns(spark, d).select("symbol", "bar_ts", "ret").join(s, ["symbol", "bar_ts"]))


@register("jn3_reindex_with_default", f"WITH {WEEK}, {LABELS} SELECT panel.symbol, panel.bar_ts, coalesce(state, 1) AS state, coalesce(wret, 0) AS baseline FROM panel LEFT JOIN lab USING (symbol, bar_ts)".replace("coalesce(wret, 0)", "round(coalesce(wret, 0), 6)"))
def _(spark, d):
    lab = week_labels(spark, d).select("symbol", "bar_ts", "state", "wret")
    return rounded(W.reindexed(weekly_panel(spark, d).select("symbol", "bar_ts"), lab, ["symbol", "bar_ts"], {"state": 1, "wret": 0.0}).withColumnRenamed("wret", "baseline"))


@register("jn6_all_pairs", f"WITH {WEEK}, s AS (SELECT DISTINCT symbol FROM panel) SELECT a.symbol AS i, b.symbol AS j FROM s a JOIN s b ON a.symbol < b.symbol")
def _(spark, d):
    from ..operators.pairs import all_pairs

    return all_pairs(weekly_panel(spark, d).select("symbol").distinct())


GRID = [(w, thr) for w in (2, 4, 8) for thr in (0.03, 0.05, 0.1)]


@register("jn11_parameter_grid", f"WITH {WEEK}, g AS (SELECT * FROM (VALUES {', '.join(f'({w}, {t}::DOUBLE)' for w, t in GRID)}) AS v(win, threshold)), b AS ({' UNION ALL '.join(f'SELECT symbol, {w} AS win, close / lag(close, {w}) OVER ({BY}) - 1 AS wret FROM panel' for w in (2, 4, 8))}), s AS (SELECT win, threshold, symbol, CASE WHEN wret >= threshold THEN 2 WHEN wret <= -threshold THEN 0 ELSE 1 END AS state FROM b JOIN g USING (win) WHERE wret IS NOT NULL) SELECT win, threshold, symbol, count(*) AS n, {r('avg(CAST(state = 2 AS INT)) AS bull', 'avg(CAST(state = 0 AS INT)) AS bear')} FROM s GROUP BY 1, 2, 3")
def _(spark, d):
    # One window column per distinct span; thresholds only widen the rows.
    p = weekly_panel(spark, d)
    wide = p.select("symbol", *[W.trailing_return(w).alias(f"r{w}") for w in (2, 4, 8)])
    rows = F.inline(F.array(*[F.struct(F.lit(w).alias("win"), F.lit(t).alias("threshold"), F.col(f"r{w}").alias("wret")) for w, t in GRID]))
    s = wide.select("symbol", rows).filter("wret is not null")
    return rounded(s.groupBy("win", "threshold", "symbol").agg(F.count(F.lit(1)).alias("n"), share(F.col("wret") >= F.col("threshold")).alias("bull"), share((F.col("wret") <= -F.col("threshold")) & (F.col("wret") < F.col("threshold"))).alias("bear")))


@register("src1_bars_csv", f"WITH {HOUR}, d AS (SELECT symbol, CAST(bar_ts AS DATE) AS bar_ts, arg_min(open, bars.bar_ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, bars.bar_ts) AS close, CAST(sum(volume) AS DOUBLE) AS volume FROM bars GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS idx FROM d")
def _(spark, d):
    # Daily bars are written as CSV files by symbol first.
    day = hourly_bars(spark, d).groupBy("symbol", F.to_date("bar_ts").alias("day")).agg(F.min_by("open", "bar_ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_ts").alias("close"), F.sum("volume").cast("double").alias("volume"))
    path = shared_folder(spark, "bars")
    day.withColumnRenamed("day", "bar_ts").select("symbol", "bar_ts", "open", "high", "low", "close", "volume").write.partitionBy("symbol").csv(path, header=True)
    return read_bars_csv(spark, f"{path}/*", r"symbol=([^/]+)/")


@register("src2_wide_csv", f"WITH {WEEK} SELECT symbol, bar_ts, close FROM panel")
def _(spark, d):
    panel = weekly_panel(spark, d)
    names = [r.symbol for r in panel.select("symbol").distinct().orderBy("symbol").collect()]  # the matrix' columns; a header holds them all anyway
    path = shared_folder(spark, "wide")
    panel.groupBy("bar_ts").pivot("symbol", names).agg(F.first("close")).write.csv(path, header=True)
    return read_wide_csv(spark, path)


@register("src5_vendor_bars", f"WITH {HOUR} SELECT symbol, CAST(bar_ts AS DATE) AS bar_ts, arg_max(close, (hour(bars.bar_ts) % 7, bars.bar_ts)) AS close, arg_max(volume, (hour(bars.bar_ts) % 7, bars.bar_ts)) AS volume FROM bars GROUP BY 1, 2")
def _(spark, d):
    raw = hourly_bars(spark, d).select("symbol", (F.unix_timestamp(F.col("bar_ts").cast("timestamp")) * 1000).alias("timestamp_ms"), (F.hour("bar_ts") % 7).alias("seq"), "close", "volume")
    return vendor_bars(raw)


@register("ux6_baseline", f"WITH {WEEK}, {LABELS}, {SIGNALS} SELECT symbol, bar_ts, CASE WHEN signal > 0.05 THEN b WHEN signal < -0.05 THEN -b ELSE 0::DOUBLE END AS pos FROM (SELECT *, CASE WHEN wret <= -0.05 THEN 0::DOUBLE ELSE 0.5::DOUBLE END AS b FROM sig) WHERE signal IS NOT NULL")
def _(spark, d):
    # The size of a position is another series, here half or nothing by the trailing return.
    s = R.walk_forward(week_labels(spark, d), WIN, MIN_TRAIN).filter("signal is not null")
    base = 0.5 * R.control_position(F.col("wret"), 0.05)
    return s.select("symbol", "bar_ts", (R.filter_position(F.col("signal"), 0.05, base) + 0.0).alias("pos"))


@register("jn12_leave_class_out", f"WITH {WEEK}, s AS (SELECT DISTINCT sector AS dropped FROM panel) SELECT dropped, bar_ts, {r('avg(ret) AS ret')}, count(ret) AS n FROM rets JOIN s ON sector <> dropped WHERE ret IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    # A date's totals without one class, from one row per date and class.
    x = week_returns(spark, d).filter("ret is not null").groupBy("bar_ts", "sector").agg(F.sum("ret").alias("s"), F.count("ret").alias("k"))
    names = F.array_sort(F.collect_set("sector"))
    classes = weekly_panel(spark, d).agg(names.alias("all"))
    day = x.groupBy("bar_ts").agg(F.sum("s").alias("total"), F.sum("k").alias("n"), F.map_from_entries(F.collect_list(F.struct("sector", F.struct("s", "k")))).alias("m"))
    rows = day.crossJoin(F.broadcast(classes)).select("bar_ts", "total", "n", "m", F.explode("all").alias("dropped"))  # one row of class names
    own = lambda c: F.coalesce(F.try_element_at("m", F.col("dropped"))[c], F.lit(0))
    left = F.col("n") - own("k")
    return rounded(rows.filter(left > 0).select("dropped", "bar_ts", ((F.col("total") - own("s")) / left).alias("ret"), left.alias("n")))
