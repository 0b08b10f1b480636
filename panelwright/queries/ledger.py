"""Registered queries over the ledger, regimes against their control, and the audits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.maths import sharpe_ratio
from ..operators import backoffice as B
from ..operators import performance as P
from ..operators import quality as Q
from ..operators import regime as R
from ..operators import windows as W
from ..sources.panels import hourly_bars, table, trades, weekly_panel
from ..sources.shared import staged
from .panel import EARNED, HOUR, LABELS, SIGNALS, WEEK, WIN, YEAR, r, register, rounded, week_earned, week_labels, week_returns

KEYS = ["account", "symbol", "filled_at", "side"]
#: Opening cash of every account.
OPENING = 2e6
TRADES = """
tr AS (SELECT l_suppkey AS account, 'S' || (l_partkey % 20) AS symbol, CAST(l_shipdate AS DATE) AS filled_at, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, sum(l_quantity) AS quantity, sum(l_extendedprice) AS value, sum(l_tax) AS commission, sum(l_extendedprice) / sum(l_quantity) AS price
  FROM lineitem GROUP BY 1, 2, 3, 4)"""
MARKED = f"""
sg AS (SELECT *, CASE side WHEN 'BUY' THEN 1 ELSE -1 END AS sgn FROM tr),
px0 AS (SELECT symbol, filled_at, sum(value) / sum(quantity) AS price FROM tr GROUP BY 1, 2),
px AS (SELECT symbol, arg_max(price, filled_at) AS price FROM px0 GROUP BY 1),
cs AS (SELECT account, {OPENING} + sum(-sgn * value - commission) AS cash FROM sg GROUP BY 1),
ps AS (SELECT account, symbol, sum(sgn * quantity) AS shares FROM sg GROUP BY 1, 2),
mk0 AS (SELECT account, symbol, shares, price, cash, shares * price AS market_value, sum(shares * price) OVER (PARTITION BY account) + cash AS nav FROM ps JOIN px USING (symbol) JOIN cs USING (account)),
mk AS (SELECT *, CASE WHEN abs(nav) < 1e-8 THEN 0 ELSE market_value / nav END AS weight FROM mk0)"""


def marked(spark, d):
    t = trades(spark, d).withColumn("sgn", F.when(F.col("side") == "BUY", 1).otherwise(-1))
    daily = t.groupBy("symbol", "filled_at").agg((F.sum("value") / F.sum("quantity")).alias("price"))
    prices = daily.groupBy("symbol").agg(F.max_by("price", "filled_at").alias("price"))
    cash = t.groupBy("account").agg((OPENING + F.sum(-F.col("sgn") * F.col("value") - F.col("commission"))).alias("cash"))
    held = t.groupBy("account", "symbol").agg(F.sum(F.col("sgn") * F.col("quantity")).alias("shares"))
    return B.marked(held.join(prices, "symbol").join(cash, "account"), "account")


def _day_key():
    return F.dayofyear("filled_at") + F.col("account")


def books(spark, d):
    """One side of a reconciliation: some trades absent."""
    return trades(spark, d).filter(_day_key() % 43 != 0)


def broker(spark, d):
    """The other side: other trades absent, some quantities one off, some prices two cents."""
    k = _day_key()
    return trades(spark, d).filter(k % 37 != 0).withColumn("quantity", F.col("quantity") + F.when(k % 41 == 0, 1.0).otherwise(0.0)).withColumn("price", F.col("price") + F.when(k % 47 == 0, 0.02).otherwise(0.0))


BROKER = """
kk AS (SELECT *, dayofyear(filled_at) + account AS k FROM tr),
bk AS (SELECT * FROM kk WHERE k % 43 <> 0),
br AS (SELECT account, symbol, filled_at, side, quantity + CASE WHEN k % 41 = 0 THEN 1 ELSE 0 END AS quantity, price + CASE WHEN k % 47 = 0 THEN 0.02 ELSE 0 END AS price, commission FROM kk WHERE k % 37 <> 0)"""
ISSUES = "iss AS (SELECT account, symbol, filled_at, side, CASE WHEN bk.quantity IS NULL THEN 'MISSING_INTERNAL' WHEN br.quantity IS NULL THEN 'MISSING_BROKER' ELSE 'MISMATCH' END AS issue, bk.quantity AS internal_value, br.quantity AS broker_value, bk.quantity - br.quantity AS discrepancy FROM bk FULL JOIN br USING (account, symbol, filled_at, side) WHERE bk.quantity IS NULL OR br.quantity IS NULL OR abs(bk.quantity - br.quantity) > 1e-6)"


@register("pf1_marked", f"WITH {TRADES}, {MARKED} SELECT account, symbol, {r('shares', 'market_value', 'nav', 'weight')} FROM mk")
def _(spark, d):
    return rounded(marked(spark, d).select("account", "symbol", "shares", "market_value", "nav", "weight"))


@register("pf3_rebalance_orders", f"WITH {TRADES}, {MARKED}, tg AS (SELECT account, symbol, shares, CASE WHEN price <= 0 OR abs(0.04 * nav) < 100 THEN 0 ELSE trunc(0.04 * nav / price) END AS target FROM mk) SELECT account, symbol, CASE WHEN target > shares THEN 'BUY' ELSE 'SELL' END AS side, round(abs(target - shares), 6) AS quantity FROM tg WHERE abs(target - shares) >= 1e-6")
def _(spark, d):
    m = marked(spark, d)
    target = m.select("account", "symbol", B.target_shares(F.lit(0.04), F.col("nav"), F.col("price"), 100.0).alias("target"))
    return rounded(B.rebalance_orders(target, m.select("account", "symbol", "shares"), ["account", "symbol"]))


@register("pf4_trade_costs", f"WITH {TRADES} SELECT account, symbol, filled_at, side, {r('value * 5 / 1e4 AS fee', 'quantity * 0.005 AS share_cost', 'value * 2 / 1e4 AS slippage', 'value * 7 / 1e4 + quantity * 0.005 AS total_cost')} FROM tr")
def _(spark, d):
    return rounded(B.trade_costs(trades(spark, d)).select(*KEYS, "fee", "share_cost", "slippage", "total_cost"))


@register("pf5_running_ledger", f"WITH {TRADES}, sg AS (SELECT *, CASE side WHEN 'BUY' THEN 1 ELSE -1 END AS sgn FROM tr) SELECT account, symbol, filled_at, side, round(sum(sgn * quantity) OVER (PARTITION BY account, symbol ORDER BY filled_at, symbol, side ROWS UNBOUNDED PRECEDING), 4) AS shares, round(sum(-sgn * value - commission) OVER (PARTITION BY account ORDER BY filled_at, symbol, side ROWS UNBOUNDED PRECEDING), 4) AS cash FROM sg")
def _(spark, d):
    return rounded(B.running_ledger(trades(spark, d), "account", ["filled_at", "symbol", "side"]).select(*KEYS, "shares", "cash"), 4)


@register("pf7_exposure", f"WITH {TRADES}, {MARKED} SELECT account, {r('sum(abs(weight)) AS gross', 'sum(weight) AS net', 'sum(greatest(weight, 0)) AS long', 'sum(least(weight, 0)) AS short', 'max(abs(weight)) AS largest')} FROM mk GROUP BY 1")
def _(spark, d):
    return rounded(B.exposure(marked(spark, d), "account"))


@register("rk7_decisions", f"""WITH {TRADES}, {MARKED}, g AS (SELECT account, sum(abs(weight)) AS gross, sum(weight) AS net, max(abs(weight)) AS largest, max(nav) AS nav, max(cash) AS cash FROM mk GROUP BY 1),
v AS (SELECT *, CASE WHEN nav > 0 THEN concat_ws(';', CASE WHEN cash < 0.05 * nav THEN 'CASH' END, CASE WHEN gross > 1.5 + 1e-6 THEN 'GROSS' END, CASE WHEN abs(net) > 1 + 1e-6 THEN 'NET' END, CASE WHEN largest > 0.25 + 1e-6 THEN 'SINGLE' END) ELSE 'NAV' END AS violations FROM g)
SELECT account, {r('gross', 'net', 'largest')}, violations, violations = '' AS approved, round(CASE WHEN nav > 0 THEN CASE WHEN gross > 1.5 THEN 1.5 / gross ELSE 1 END ELSE 0 END, 6) AS scale FROM v""")
def _(spark, d):
    return rounded(B.risk_decisions(marked(spark, d), "account").select("account", "gross", "net", "largest", "violations", "approved", "scale"))


@register("rc1_positions", f"WITH {TRADES}, {BROKER}, {ISSUES} SELECT * FROM iss")
def _(spark, d):
    return B.reconcile(books(spark, d), broker(spark, d), KEYS, "quantity", 1e-6)


@register("rc4_overfills", "WITH f AS (SELECT l_orderkey AS order_id, sum(l_quantity) AS filled FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS order_id, floor(o_totalprice / 2000) AS quantity FROM orders) SELECT order_id, CAST(quantity AS BIGINT) AS quantity, filled FROM o JOIN f USING (order_id) WHERE filled > quantity + 1e-6")
def _(spark, d):
    fills = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("quantity"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.floor(F.col("o_totalprice") / 2000).alias("quantity"))
    return B.overfills(orders, fills)


@register("rc6_verdict", f"WITH {TRADES}, {BROKER}, {ISSUES}, n AS (SELECT account, count(*) AS k FROM iss GROUP BY 1) SELECT account, coalesce(k, 0) AS n_issues, CASE WHEN k IS NULL THEN 'MATCHED' ELSE 'MISMATCHED' END AS status FROM (SELECT DISTINCT account FROM tr) LEFT JOIN n USING (account)")
def _(spark, d):
    return B.verdict(B.reconcile(books(spark, d), broker(spark, d), KEYS, "quantity", 1e-6), trades(spark, d).select("account").distinct(), "account")


@register("rc7_missing_fills", f"WITH {TRADES}, {BROKER} SELECT account, symbol, filled_at, side, quantity FROM br ANTI JOIN bk USING (account, symbol, filled_at, side)")
def _(spark, d):
    return B.missing_fills(broker(spark, d), books(spark, d), KEYS).select(*KEYS, "quantity")


@register("snk4_upsert", f"WITH {HOUR}, b AS (SELECT symbol, arg_max(close, bar_ts) AS close, max(bar_ts) AS bar_ts FROM bars GROUP BY 1) SELECT * FROM b")
def _(spark, d):
    bars = hourly_bars(spark, d).select("symbol", "bar_ts", "close")
    cut = F.hour("bar_ts") < 12
    return B.latest_state(bars.filter(cut), bars.filter(~cut), ["symbol"], "bar_ts")


@register("wn29_latest", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return W.latest(o, "o_custkey", "at").drop("at")


@register("dq9_back_fill", f"WITH {WEEK}, g AS (SELECT * FROM (SELECT DISTINCT bar_ts FROM panel), (SELECT DISTINCT symbol FROM panel)), j AS (SELECT symbol, bar_ts, close FROM g LEFT JOIN panel USING (symbol, bar_ts)), f AS (SELECT symbol, bar_ts, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS close FROM j) SELECT symbol, bar_ts, first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS close FROM f")
def _(spark, d):
    return Q.back_filled(Q.aligned(staged(weekly_panel(spark, d), "panel")).drop("filled"), "close")


@register("dq7_constraints", "SELECT 'duplicate_line' AS \"check\", l_orderkey || '-' || l_linenumber AS key FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT 'orphan_line', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'status', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'not_positive', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_quantity <= 0")
def _(spark, d):
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return Q.violations({
        "duplicate_line": items.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key")),
        "orphan_line": items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.col("l_orderkey").alias("key")),
        "status": orders.filter(~F.col("o_orderstatus").isin("F", "O")).select(F.col("o_orderkey").alias("key")),
        "not_positive": items.filter("l_quantity <= 0").select(F.col("l_orderkey").alias("key")),
    })


@register("dq13_redacted", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"auth_token": "***"}' WHEN 1 THEN '{"a": {"Password": "***", "n": ' || event_id || '}, "k": 1}' WHEN 2 THEN '{"credentials": "***", "user": ' || user_id || '}'
  WHEN 3 THEN '{"note": "***", "user": "u' || user_id || '"}' ELSE '{"api_key":"***"' END AS props FROM events WHERE user_id IS NOT NULL""")
def _(spark, d):
    # Secrets of five kinds made of the events' own numbers: a number under a longer key, a nested string with an escaped quote, an object, a bearer value, JSON that is cut off.
    number = F.regexp_extract("props", r"\d+", 0)
    forms = [
        F.concat(F.lit('{"auth_token": '), number, F.lit("}")),
        F.concat(F.lit('{"a": {"Password": "x\\"y'), number, F.lit('", "n": '), F.col("event_id").cast("string"), F.lit('}, "k": 1}')),
        F.concat(F.lit('{"credentials": {"id": ['), number, F.lit(', "s"], "more": {"t": 1}}, "user": '), F.col("user_id").cast("string"), F.lit("}")),
        F.concat(F.lit('{"note": "Bearer abc.'), number, F.lit('", "user": "u'), F.col("user_id").cast("string"), F.lit('"}')),
        F.concat(F.lit('{"api_key":"never closed '), number),
    ]
    text = forms[4]
    for i in range(4):
        text = F.when(F.col("event_id") % 5 == i, forms[i]).otherwise(text)
    return table(spark, d, "events").filter("user_id is not null").select("event_id", Q.redacted(text).alias("props"))


CONTROL = """
ctl AS (SELECT lab.symbol, lab.bar_ts, CASE WHEN wret <= -0.05 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS pos, ret FROM lab JOIN rets USING (symbol, bar_ts)),
cheld AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY bar_ts), 0) AS was FROM ctl),
cern AS (SELECT symbol, bar_ts, pos, was * coalesce(ret, 0) - abs(pos - was) * 10 / 1e4 AS net FROM cheld)"""


def week_control(spark, d):
    held = week_labels(spark, d).join(week_returns(spark, d).select("symbol", "bar_ts", "ret"), ["symbol", "bar_ts"]).withColumn("pos", R.control_position(F.col("wret"), 0.05))
    return P.earned(held.select("symbol", "bar_ts", "pos", "ret"), ["symbol"])


@register("rg5_standalone", f"WITH {WEEK}, {LABELS}, {SIGNALS} SELECT symbol, bar_ts, round(greatest(-1.0, least(1.0, signal / 0.5)), 6) AS pos FROM sig WHERE signal IS NOT NULL")
def _(spark, d):
    s = R.walk_forward(week_labels(spark, d), WIN, 52).filter("signal is not null")
    return rounded(s.select("symbol", "bar_ts", R.standalone_position(F.col("signal"), 0.5).alias("pos")))


@register("rg7_value_added", f"WITH {WEEK}, {LABELS}, {SIGNALS}, {EARNED}, {CONTROL}, a AS (SELECT symbol, avg(net) / stddev_samp(net) * sqrt({YEAR}) AS s FROM ern GROUP BY 1), b AS (SELECT symbol, avg(net) / stddev_samp(net) * sqrt({YEAR}) AS s FROM cern GROUP BY 1) SELECT symbol, {r('a.s AS regime', 'b.s AS control', 'a.s - b.s AS delta')}, a.s - b.s > 0.1 AS beats FROM a JOIN b USING (symbol)")
def _(spark, d):
    sharpe = lambda df, name: df.groupBy("symbol").agg(sharpe_ratio("net", YEAR).alias(name))
    both = sharpe(week_earned(spark, d), "regime").join(sharpe(week_control(spark, d), "control"), "symbol").withColumn("delta", F.col("regime") - F.col("control"))
    return rounded(both.withColumn("beats", F.col("delta") > 0.1))


@register("rg16_label_invariant", f"WITH {WEEK}, {LABELS}, m AS (SELECT symbol, avg(wret) FILTER (state = 0) AS bear, avg(wret) FILTER (state = 1) AS flat, avg(wret) FILTER (state = 2) AS bull FROM lab GROUP BY 1) SELECT symbol, {r('bear', 'flat', 'bull')}, coalesce(bear < flat AND flat < bull, false) AS holds FROM m")
def _(spark, d):
    m = week_labels(spark, d).groupBy("symbol").agg(*[F.avg(F.when(F.col("state") == i, F.col("wret"))).alias(n) for i, n in enumerate(["bear", "flat", "bull"])])
    return rounded(m.withColumn("holds", F.coalesce((F.col("bear") < F.col("flat")) & (F.col("flat") < F.col("bull")), F.lit(False))))


@register("rk5_breaker", f"WITH {WEEK}, c AS (SELECT symbol, bar_ts, product(1 + coalesce(ret, 0)) OVER w AS nav FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, max(nav) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS peak FROM c) SELECT symbol, bar_ts, {r('peak', 'nav / peak - 1 AS dd')}, nav / peak - 1 <= -0.2 AS tripped FROM p")
def _(spark, d):
    x = week_returns(spark, d).withColumn("ret", F.coalesce("ret", F.lit(0.0))).withColumn("nav", W.equity("ret")).withColumn("dd", W.drawdown("nav"))
    return rounded(x.select("symbol", "bar_ts", F.max("nav").over(W.so_far()).alias("peak"), "dd", (F.col("dd") <= -0.2).alias("tripped")))


@register("dq15_lifecycle", "WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events), n AS (SELECT was, event_type FROM e WHERE was IS NOT NULL AND was = 'error' AND event_type <> 'error') SELECT e.user_id, e.event_id, e.was, e.event_type FROM e WHERE e.was IS NOT NULL AND (e.was, e.event_type) NOT IN (SELECT (was, event_type) FROM n)")
def _(spark, d):
    ev = table(spark, d, "events").withColumn("was", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("was is not null")
    allowed = ev.filter("was = 'error' and event_type <> 'error'").select("was", "event_type").distinct()
    return ev.join(allowed, ["was", "event_type"], "left_anti").select("user_id", "event_id", "was", "event_type")


@register("dq12_fingerprint", f"WITH {WEEK} SELECT symbol, count(*) AS n_rows, count(*) FILTER (close IS NULL) AS n_null, min(bar_ts) AS first_ts, max(bar_ts) AS last_ts, CAST(bit_xor(('0x' || substr(md5(symbol || '|' || bar_ts || '|' || CAST(round(close * 100) AS BIGINT)), 1, 15))::BIGINT) AS BIGINT) AS print FROM panel GROUP BY 1")
def _(spark, d):
    row = F.md5(F.concat_ws("|", "symbol", F.col("bar_ts").cast("string"), F.round(F.col("close") * 100).cast("long").cast("string")))
    return weekly_panel(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("close").isNull()).alias("n_null"), F.min("bar_ts").alias("first_ts"), F.max("bar_ts").alias("last_ts"), F.bit_xor(F.conv(F.substring(row, 1, 15), 16, 10).cast("long")).alias("print"))
