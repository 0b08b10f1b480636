"""Registered queries of controls: reconciliation, risk limits, checks before trading, financing, quality gates, sources and sinks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backoffice as B
from ..operators import quality as Q
from ..sources import shared as S
from ..sources import versioned as V
from ..sources.panels import table, trades, weekly_panel
from .ledger import BROKER, KEYS, MARKED, OPENING, TRADES, books, broker, marked
from .panel import WEEK, r, register, rounded, week_returns


def signed():
    return F.when(F.col("side") == "BUY", 1).otherwise(-1)


def positions(fills):
    return fills.groupBy("account", "symbol").agg(F.sum(signed() * F.col("quantity")).alias("shares"), F.max("price").alias("price"))


def cash_of(fills):
    return fills.groupBy("account").agg((OPENING + F.sum(-signed() * F.col("quantity") * F.col("price") - F.col("commission"))).alias("cash"))


def broker_accounts(spark, d):
    """Cash and net asset value as the broker reports them: some values are five off."""
    b = broker(spark, d)
    worth = positions(b).groupBy("account").agg(F.sum(F.col("shares") * F.col("price")).alias("worth"))
    return cash_of(b).join(worth, "account").select("account", "cash", (F.col("cash") + F.col("worth") + F.when(F.col("account") % 7 == 0, 5.0).otherwise(0.0)).alias("nav"))


SIDES = f"""
bp AS (SELECT account, symbol, sum(CASE side WHEN 'BUY' THEN 1 ELSE -1 END * quantity) AS shares, max(price) AS price FROM br GROUP BY 1, 2),
ip AS (SELECT account, symbol, sum(CASE side WHEN 'BUY' THEN 1 ELSE -1 END * quantity) AS shares, max(price) AS price FROM bk GROUP BY 1, 2),
bc AS (SELECT account, {OPENING} + sum(CASE side WHEN 'BUY' THEN -1 ELSE 1 END * quantity * price - commission) AS cash FROM br GROUP BY 1),
ic AS (SELECT account, {OPENING} + sum(CASE side WHEN 'BUY' THEN -1 ELSE 1 END * quantity * price - commission) AS cash FROM bk GROUP BY 1),
bw AS (SELECT account, sum(shares * price) AS worth FROM bp GROUP BY 1),
iw AS (SELECT ip.account, sum(ip.shares * coalesce(bp.price, ip.price)) AS worth FROM ip LEFT JOIN bp USING (account, symbol) GROUP BY 1),
ba AS (SELECT account, cash, cash + worth + CASE WHEN account % 7 = 0 THEN 5 ELSE 0 END AS nav, cash + worth AS sound FROM bc JOIN bw USING (account))"""


@register("rc2_cash_and_nav", f"""WITH {TRADES}, {BROKER}, {SIDES}, x AS (SELECT ba.account, ba.cash AS tc, nav, sound, coalesce(ic.cash, 0) AS oc, coalesce(ic.cash, 0) + coalesce(iw.worth, 0) AS own FROM ba LEFT JOIN ic USING (account) LEFT JOIN iw USING (account)),
u AS (SELECT account, 'CASH_MISMATCH' AS issue, oc AS internal_value, tc AS broker_value, oc - tc AS discrepancy, 0.01 AS tol FROM x UNION ALL SELECT account, 'NAV_MISMATCH', own, nav, own - nav, 0.05 FROM x UNION ALL SELECT account, 'NAV_CONSERVATION_VIOLATION', sound, nav, nav - sound, 0.05 FROM x)
SELECT account, issue, {', '.join(f'round({c}, 4) AS {c}' for c in ('internal_value', 'broker_value', 'discrepancy'))} FROM u WHERE abs(discrepancy) > tol""")
def _(spark, d):
    own = books(spark, d)
    return rounded(B.reconcile_cash(cash_of(own), positions(own), broker_accounts(spark, d), positions(broker(spark, d)), "account"), 4)


STATES = ("FILLED", "SUBMITTED", "CANCELLED", "PARTIALLY_FILLED")


@register("rc3_orders", f"""WITH o AS (SELECT o_orderkey AS order_id, CASE o_orderstatus WHEN 'F' THEN 'FILLED' ELSE 'SUBMITTED' END AS status, CAST(floor(o_totalprice / 2000) AS DOUBLE) AS quantity FROM orders),
a AS (SELECT * FROM o WHERE order_id % 53 <> 0), b AS (SELECT order_id, CASE WHEN order_id % 61 = 0 THEN 'LOST' WHEN order_id % 67 = 0 THEN 'CANCELLED' ELSE status END AS status, quantity + CASE WHEN order_id % 71 = 0 THEN 1 ELSE 0 END AS quantity FROM o WHERE order_id % 59 <> 0),
j AS (SELECT order_id, a.status AS s1, b.status AS s2, a.quantity AS q1, b.quantity AS q2 FROM a FULL JOIN b USING (order_id))
SELECT order_id, 'ORDER_MISSING_BROKER' AS issue, s1 AS internal_value, s2 AS broker_value, CAST(NULL AS DOUBLE) AS discrepancy FROM j WHERE s2 IS NULL
UNION ALL SELECT order_id, 'ORDER_MISSING_INTERNAL', s1, s2, NULL FROM j WHERE s1 IS NULL
UNION ALL SELECT order_id, 'ORDER_UNKNOWN_STATE', s1, s2, NULL FROM j WHERE s1 IS NOT NULL AND s2 NOT IN {STATES}
UNION ALL SELECT order_id, 'ORDER_STATUS_MISMATCH', s1, s2, NULL FROM j WHERE s1 <> s2 AND s2 IN {STATES}
UNION ALL SELECT order_id, 'ORDER_QUANTITY_MISMATCH', CAST(q1 AS VARCHAR), CAST(q2 AS VARCHAR), q1 - q2 FROM j WHERE abs(q1 - q2) > 1e-6""")
def _(spark, d):
    k = F.col("order_id")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderstatus") == "F", "FILLED").otherwise("SUBMITTED").alias("status"), F.floor(F.col("o_totalprice") / 2000).cast("double").alias("quantity"))
    theirs = o.filter(k % 59 != 0).withColumn("status", F.when(k % 61 == 0, "LOST").when(k % 67 == 0, "CANCELLED").otherwise(F.col("status"))).withColumn("quantity", F.col("quantity") + F.when(k % 71 == 0, 1.0).otherwise(0.0))
    return B.reconcile_orders(o.filter(k % 53 != 0), theirs, STATES)


def fill_id():
    return F.concat_ws("|", F.col("account").cast("string"), "symbol", F.col("filled_at").cast("string"), "side")


def broker_fills(spark, d):
    return broker(spark, d).select(fill_id().alias("fill_id"), "quantity", "price")


def own_fills(spark, d):
    """Every fifth account's fills carry ids of their own and the broker's beside them."""
    other = F.col("account") % 5 == 0
    return books(spark, d).select(F.when(other, F.concat(F.lit("I"), fill_id())).otherwise(fill_id()).alias("fill_id"), F.when(other, fill_id()).alias("broker_execution_id"), "quantity", "price")


@register("rc5_fills", f"""WITH {TRADES}, {BROKER}, j AS (SELECT br.account || '|' || br.symbol || '|' || br.filled_at || '|' || br.side AS fill_id, bk.quantity AS oq, bk.price AS op, br.quantity AS q, br.price AS p FROM br LEFT JOIN bk USING (account, symbol, filled_at, side)),
u AS (SELECT fill_id, 'FILL_MISSING_INTERNAL' AS issue, CAST(NULL AS DOUBLE) AS internal_value, q AS broker_value, CAST(NULL AS DOUBLE) AS discrepancy FROM j WHERE oq IS NULL
UNION ALL SELECT fill_id, 'FILL_QUANTITY_MISMATCH', oq, q, oq - q FROM j WHERE abs(oq - q) > 1e-6 UNION ALL SELECT fill_id, 'FILL_PRICE_MISMATCH', op, p, op - p FROM j WHERE abs(op - p) > 1e-4)
SELECT fill_id, issue, round(internal_value, 10) AS internal_value, round(broker_value, 10) AS broker_value, round(discrepancy, 6) AS discrepancy FROM u""")
def _(spark, d):
    return rounded(rounded(B.reconcile_fills(broker_fills(spark, d), own_fills(spark, d)), 10).withColumn("discrepancy", F.round("discrepancy", 6)), 10)


#: Target weights by the number in a symbol's name: odd ones short; the locate table lends all but multiples of three.
NUMBER = "CAST(substr(symbol, 2) AS INT)"
TARGET = f"CAST(CASE WHEN {NUMBER} % 2 = 1 THEN -0.03 ELSE 0.05 END AS DOUBLE)"


def numbers():
    return F.substring("symbol", 2, 9).cast("int")


def targets(spark, d):
    return marked(spark, d).select("account", "symbol", F.when(numbers() % 2 == 1, -0.03).otherwise(0.05).alias("weight"))


def locates(spark, d):
    return trades(spark, d).select("symbol").distinct().withColumn("available", numbers() % 3 != 0)


@register("rk3_projected_cash", f"""WITH {TRADES}, {MARKED}, m AS (SELECT account, cash, nav, {TARGET} * nav - shares * price AS move FROM mk), g AS (SELECT account, any_value(cash) AS cash, any_value(nav) AS nav, sum(move) AS bought, sum(abs(move)) AS moved FROM m GROUP BY 1),
x AS (SELECT account, cash / nav AS now, (cash - bought - moved * 10 / 1e4) / nav AS after FROM g) SELECT account, {r('now', 'after')}, CASE WHEN now < 0.02 - 1e-6 THEN 'CURRENT' WHEN after < 0.02 - 1e-6 THEN 'PROJECTED' END AS violation FROM x""")
def _(spark, d):
    m = marked(spark, d)
    return rounded(B.projected_cash(targets(spark, d), m.select("account", "symbol", "shares", "price"), m.select("account", "cash", "nav").distinct(), "account"))


@register("rk4_short_checks", f"""WITH {TRADES}, {MARKED}, t AS (SELECT account, symbol, {TARGET} AS weight, {NUMBER} % 3 <> 0 AS available FROM mk)
SELECT account, round(sum(CASE WHEN weight < -1e-6 THEN -weight ELSE 0 END), 6) AS short_exposure, coalesce(string_agg(symbol, ';' ORDER BY symbol) FILTER (weight < -1e-6 AND NOT available), '') AS not_lent,
coalesce(count(*) FILTER (weight < -1e-6 AND NOT available) = 0, true) AND sum(CASE WHEN weight < -1e-6 THEN -weight ELSE 0 END) <= 0.2 + 1e-6 AS passed FROM t GROUP BY 1""")
def _(spark, d):
    return rounded(B.short_checks(targets(spark, d), locates(spark, d), "account", 0.2))


@register("rk6_volatility", f"""WITH {WEEK}, n AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) AS k, count(*) OVER (PARTITION BY symbol) AS bars FROM rets WHERE ret IS NOT NULL),
g AS (SELECT symbol, any_value(bars) AS bars, stddev_samp(ret) * sqrt(52) AS vol FROM n WHERE k <= 60 GROUP BY 1) SELECT symbol, bars, {r('vol')}, CASE WHEN bars < 200 THEN 'HISTORY' WHEN vol > 1.5 + 1e-6 THEN 'VOLATILITY' END AS violation FROM g""")
def _(spark, d):
    return rounded(B.volatility_limit(week_returns(spark, d), "symbol", 52, least=200, most=1.5))


ORDERED = f"""
po AS (SELECT account, symbol, price, shares, CASE WHEN t > shares THEN 'BUY' ELSE 'SELL' END AS side, abs(t - shares) AS quantity, CASE WHEN symbol = 'S3' THEN 'LIMIT' ELSE 'MARKET' END AS kind FROM
  (SELECT *, CASE WHEN price <= 0 OR abs({TARGET} * nav) < 100 THEN 0 ELSE trunc({TARGET} * nav / price) END AS t FROM mk) WHERE abs(t - shares) >= 1e-6)"""


def planned(spark, d):
    m = marked(spark, d)
    want = targets(spark, d).join(m.select("account", "symbol", "nav", "price"), ["account", "symbol"]).select("account", "symbol", B.target_shares(F.col("weight"), F.col("nav"), F.col("price"), 100.0).alias("target"))
    out = B.rebalance_orders(want, m.select("account", "symbol", "shares"), ["account", "symbol"])
    return out.join(m.select("account", "symbol", "price"), ["account", "symbol"]).withColumn("kind", F.when(F.col("symbol") == "S3", "LIMIT").otherwise("MARKET"))


@register("rk8_pre_trade", f"""WITH {TRADES}, {MARKED}, {ORDERED}, b AS (SELECT account, sum(quantity * price) AS notional FROM po GROUP BY 1), c AS (SELECT DISTINCT account, cash FROM mk WHERE account % 9 <> 0)
SELECT account, symbol, 'WHITELIST' AS error FROM po WHERE symbol = 'S7' UNION ALL SELECT account, symbol, 'ORDER_TYPE' FROM po WHERE kind <> 'MARKET'
UNION ALL SELECT account, symbol, 'SHORT_LOCATE' FROM po WHERE side = 'SELL' AND (shares <= 0 OR shares < quantity) AND {NUMBER} % 3 = 0
UNION ALL SELECT account, NULL, 'NOTIONAL_CAP' FROM b WHERE notional > 3e6 UNION ALL SELECT b.account, NULL, CASE WHEN cash IS NULL THEN 'BUYING_POWER_UNKNOWN' ELSE 'BUYING_POWER' END FROM b LEFT JOIN c USING (account) WHERE cash IS NULL OR notional > cash""")
def _(spark, d):
    m = marked(spark, d)
    power = m.filter(F.col("account") % 9 != 0).select("account", F.col("cash").alias("buying_power")).distinct()
    return B.pre_trade_errors(planned(spark, d), power, m, locates(spark, d), "account", [f"S{i}" for i in range(20) if i != 7], notional_cap=3e6)


@register("pf6_financing", f"""WITH {TRADES}, {MARKED}, l AS (SELECT account, filled_at, symbol, side, sgn * quantity AS signed, round(px.price, 2) AS mark, sum(sgn * quantity) OVER (PARTITION BY account, symbol ORDER BY filled_at, symbol, side ROWS UNBOUNDED PRECEDING) AS shares,
sum(-sgn * value - commission) OVER (PARTITION BY account ORDER BY filled_at, symbol, side ROWS UNBOUNDED PRECEDING) AS cash FROM sg JOIN px USING (symbol)),
y AS (SELECT account, filled_at, {OPENING} / 100 + arg_max(cash, (filled_at, symbol, side)) AS cash, sum((greatest(-shares, 0) - greatest(-(shares - signed), 0)) * mark) AS change FROM l GROUP BY 1, 2),
z AS (SELECT account, filled_at, round(cash, 2) AS cash, round(sum(change) OVER (PARTITION BY account ORDER BY filled_at), 2) AS short FROM y)
SELECT account, filled_at, short AS short_notional, {', '.join(f'round({e}, 3) AS {n}' for n, e in (('interest', 'CASE WHEN cash > 0 THEN (greatest(0, cash - short) + 0.5 * least(cash, short)) * 0.0201 / 252 ELSE 0 END'), ('margin', 'CASE WHEN cash < 0 THEN -cash * (0.0201 + 0.01537) / 252 ELSE 0 END'), ('borrow_fee', 'short * 0.00513 / 252')))} FROM z""")
def _(spark, d):
    m = marked(spark, d).select("symbol", F.round("price", 2).alias("price")).distinct()
    x = B.daily_shorts(trades(spark, d), m, "account", ["filled_at", "symbol", "side"])
    f = B.financing(x.select("account", "filled_at", F.round(F.col("cash") + OPENING / 100, 2).alias("cash"), F.round("short_notional", 2).alias("short_notional")), 0.0201, 0.5, 153.7, 51.3)
    return f.select("account", "filled_at", "short_notional", *[F.round(c, 3).alias(c) for c in ("interest", "margin", "borrow_fee")])


@register("pf8_preview", f"""WITH {TRADES}, {MARKED}, {ORDERED}, g AS (SELECT account, count(*) AS n_orders, sum(quantity * price) AS notional, sum(quantity * price) * 0.001 AS commission, sum(CASE side WHEN 'BUY' THEN -1 ELSE 1 END * quantity * price) - sum(quantity * price) * 0.001 AS flow FROM po GROUP BY 1)
SELECT account, coalesce(n_orders, 0) AS n_orders, {', '.join(f'round({e}, 3) AS {n}' for n, e in (('notional', 'coalesce(notional, 0)'), ('commission', 'coalesce(commission, 0)'), ('projected_cash', 'cash + coalesce(flow, 0)')))} FROM (SELECT DISTINCT account, cash FROM mk) LEFT JOIN g USING (account)""")
def _(spark, d):
    return rounded(B.preview(planned(spark, d), marked(spark, d).select("account", "cash").distinct(), "account"), 3)


@register("dq4_matrix", f"""WITH {WEEK}, p AS (SELECT * FROM rets WHERE symbol < 'U'), s AS (SELECT symbol, count(close) AS n FROM p GROUP BY 1)
SELECT 'MISSING' AS "check", n_name AS symbol, CAST(0 AS BIGINT) AS n FROM nation WHERE n_name NOT IN (SELECT symbol FROM p) UNION ALL SELECT 'TOO_FEW', symbol, n FROM s WHERE n < 300
UNION ALL SELECT 'ANOMALY', symbol, count(*) FROM p WHERE abs(ret) >= 0.15 GROUP BY symbol""")
def _(spark, d):
    return Q.matrix_violations(weekly_panel(spark, d).filter("symbol < 'U'"), table(spark, d, "nation").select(F.col("n_name").alias("symbol")), 300)


EVENTS = "ev AS (SELECT n_name AS symbol, CAST(e AS DATE) AS event_date FROM nation, (VALUES ('1996-06-05'), ('1997-01-06'), ('2030-01-01')) AS v(e))"
FOUND = f"{EVENTS}, br0 AS (SELECT symbol, bar_ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_ts) AS ratio FROM panel), fb AS (SELECT ev.symbol, event_date, min(bar_ts) AS bar_ts FROM ev LEFT JOIN panel ON panel.symbol = ev.symbol AND bar_ts >= event_date GROUP BY 1, 2), rp AS (SELECT fb.symbol, event_date, fb.bar_ts, ratio FROM fb LEFT JOIN br0 USING (symbol, bar_ts))"


def splice_events(spark, d):
    dates = F.explode(F.array(*[F.lit(x).cast("date") for x in ("1996-06-05", "1997-01-06", "2030-01-01")]))
    return table(spark, d, "nation").select(F.col("n_name").alias("symbol"), dates.alias("event_date"))


@register("dq6_splice_report", f"WITH {WEEK}, {FOUND} SELECT symbol, event_date, bar_ts, ratio IS NOT NULL AS ok, CASE WHEN bar_ts IS NULL THEN 'no bar on or after the date' WHEN ratio IS NULL THEN 'no bar before it' ELSE 'spliced' END AS why, {r('ratio - 1 AS raw_move')} FROM rp")
def _(spark, d):
    return rounded(Q.spliced(weekly_panel(spark, d), splice_events(spark, d))[0])


@register("dq6_spliced", f"WITH {WEEK}, {FOUND}, f AS (SELECT DISTINCT symbol, bar_ts AS at, ratio FROM rp WHERE ratio IS NOT NULL) SELECT p.symbol, p.bar_ts, round(p.close * coalesce(product(f.ratio), 1), 4) AS close FROM panel p LEFT JOIN f ON f.symbol = p.symbol AND f.at > p.bar_ts GROUP BY p.symbol, p.bar_ts, p.close")
def _(spark, d):
    return rounded(Q.spliced(weekly_panel(spark, d), splice_events(spark, d))[1], 4)


@register("dq16_conservation", f"""WITH {TRADES}, {BROKER}, {SIDES}, q AS (SELECT account, symbol, shares + CASE WHEN (account + {NUMBER}) % 31 = 0 THEN 1 ELSE 0 END AS reported, shares FROM bp)
SELECT account, CAST(NULL AS VARCHAR) AS symbol, 'NAV' AS rule, round(nav, 4) AS reported, round(sound, 4) AS expected FROM ba WHERE abs(nav - sound) > 1e-7 * greatest(1, abs(nav))
UNION ALL SELECT account, symbol, 'SHARES', round(reported, 4), round(shares, 4) FROM q WHERE abs(reported - shares) > 1e-6""")
def _(spark, d):
    own = positions(broker(spark, d))
    said = own.withColumn("shares", F.col("shares") + F.when((F.col("account") + numbers()) % 31 == 0, 1.0).otherwise(0.0))
    return rounded(Q.conservation(broker_accounts(spark, d), own, said, "account", 1e-7), 4)


@register("src3_panel_cache", f"WITH {WEEK} SELECT symbol, bar_ts, close, volume FROM panel")
def _(spark, d):
    panel = weekly_panel(spark, d).select("bar_ts", "close", "volume", "symbol")
    key = S.panel_key(["nations"], "1992-01-01", "1999-01-01", d)
    return S.cached_panel(spark, S.cache_panel(panel, S.shared_folder(spark, "panels"), key), panel.schema)


@register("src4_manifest", "SELECT n_name AS symbol, DATE '1996-06-03' + CAST(n_nationkey AS INT) AS event_date, 'split' AS kind, 1 / (1.0 + n_regionkey) AS factor FROM nation UNION ALL SELECT n_name, DATE '1997-01-06', 'dividend', 0.98 FROM nation WHERE n_regionkey = 1")
def _(spark, d):
    # A manifest of the nations is written first, one JSON map per region.
    n = table(spark, d, "nation")
    event = lambda day, kind, factor: F.struct(day.cast("string").alias("date"), F.lit(kind).alias("type"), factor.alias("adjustment_factor"))
    split = event(F.date_add(F.lit("1996-06-03").cast("date"), F.col("n_nationkey").cast("int")), "split", 1 / (1.0 + F.col("n_regionkey")))
    paid = event(F.lit("1997-01-06"), "dividend", F.lit(0.98))
    events = F.when(F.col("n_regionkey") == 1, F.array(split, paid)).otherwise(F.array(split))
    text = n.groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", events)))).alias("value"))
    path = S.shared_folder(spark, "manifest")
    text.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return S.read_manifest(spark, path)


def _sql_uniform(*parts: str) -> str:
    return f"((('0x' || substr(md5({chr(32) + ' || chr(124) || '.join(parts)}), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)})"


def _sql_normal(*parts: str) -> str:
    return f"(sqrt(-2 * ln({_sql_uniform(*parts, chr(39) + 'a' + chr(39))})) * cos(2 * pi() * {_sql_uniform(*parts, chr(39) + 'b' + chr(39))}))"


@register("src6_random_walk", f"WITH {WEEK} SELECT symbol, bar_ts, round(100 * exp(sum(0.0005 + 0.02 * {_sql_normal('symbol', 'bar_ts')}) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING)), 6) AS close FROM panel")
def _(spark, d):
    return rounded(S.random_walk(weekly_panel(spark, d)))


@register("src7_sector_walk", f"WITH {WEEK}, s AS (SELECT symbol, sector, bar_ts, 0.01 * {_sql_normal(chr(39) + 'market' + chr(39), 'bar_ts')} + 0.008 * {_sql_normal('sector', 'bar_ts')} + 0.015 * {_sql_normal('symbol', 'bar_ts')} AS step FROM panel) SELECT symbol, sector, bar_ts, round(100 * exp(sum(step) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING)), 6) AS close, CAST(floor(1000 + 1000 * {_sql_uniform('symbol', 'bar_ts', chr(39) + 'volume' + chr(39))}) AS BIGINT) AS volume FROM s")
def _(spark, d):
    return rounded(S.sector_walk(weekly_panel(spark, d)))


@register("snk1_csv", f"WITH {WEEK} SELECT sector, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM panel GROUP BY 1")
def _(spark, d):
    out = weekly_panel(spark, d).groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").cast("long").alias("volume"))
    path = S.shared_folder(spark, "report")
    S.write_csv(out, path)
    return spark.read.schema(out.schema).csv(path, header=True)


@register("snk2_nested_json", f"WITH {WEEK} SELECT sector, len(list(bar_ts)) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM panel GROUP BY 1")
def _(spark, d):
    path = S.shared_folder(spark, "nested")
    S.write_nested(weekly_panel(spark, d).select("sector", "symbol", "bar_ts", F.col("volume").cast("long").alias("volume")), ["sector"], path)
    read = spark.read.schema("sector string, rows array<struct<symbol:string,bar_ts:date,volume:long>>").json(path)
    return read.select("sector", F.size("rows").cast("long").alias("n"), F.aggregate("rows", F.lit(0).cast("long"), lambda a, x: a + x["volume"]).alias("volume"))


@register("snk3_append", f"WITH {TRADES} SELECT * FROM tr")
def _(spark, d):
    path, t = S.shared_folder(spark, "ledger"), trades(spark, d)
    S.append(t.filter("filled_at < '1995-01-01'"), path)
    S.append(t.filter("filled_at >= '1995-01-01' or filled_at is null"), path)
    return spark.read.schema(t.schema).parquet(path)


@register("snk5_sync_snapshot", f"WITH {TRADES}, p AS (SELECT account, symbol, sum(CASE side WHEN 'BUY' THEN 1 ELSE -1 END * quantity) AS shares FROM tr GROUP BY 1, 2), o AS (SELECT account, symbol, sum(CASE side WHEN 'BUY' THEN 1 ELSE -1 END * quantity) AS shares FROM tr WHERE filled_at < DATE '1996-01-01' GROUP BY 1, 2) SELECT account, symbol, shares FROM p WHERE account % 2 = 0 AND account % 10 <> 0 AND abs(shares) > 1e-6 UNION ALL SELECT * FROM o WHERE account % 2 <> 0 AND abs(shares) > 1e-6")
def _(spark, d):
    # Yesterday's snapshot of all accounts, then today's of every other one; of these, every fifth has sold all it held.
    t = trades(spark, d)
    held = lambda x: x.groupBy("account", "symbol").agg(F.sum(signed() * F.col("quantity")).alias("shares"))
    today = held(t.filter("account % 2 = 0")).withColumn("shares", F.when(F.col("account") % 10 == 0, 0.0).otherwise(F.col("shares")))
    table_ = V.Versioned(spark, S.shared_folder(spark, "holdings"), today.schema, ["account", "symbol"], ["account"], buckets=16)
    for rows in (held(t.filter("filled_at < '1996-01-01'")), today):
        V.sync_snapshot(table_, rows, rows)
    return table_.read()


@register("snk4_stored_upsert", """WITH l AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS ordered_on, o_totalprice FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ordered_on DESC, o_orderkey DESC) AS k FROM l) SELECT o_custkey, o_orderkey, ordered_on, o_totalprice FROM n WHERE k = 1 AND NOT (o_custkey % 7 = 0 AND ordered_on < DATE '2000-01-01')""")
def _(spark, d):
    # Each customer's newest order: three deliveries, the last of which also closes customers, each at the day given.
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("ordered_on"), "o_totalprice").withColumn("at", F.struct("ordered_on", "o_orderkey"))
    table_ = V.Versioned(spark, S.shared_folder(spark, "newest"), o.schema, ["o_custkey"], buckets=16)
    table_.upsert(o.filter("ordered_on >= '1997-01-01' and o_orderkey % 2 = 0"), newest="at")
    table_.upsert(o.filter("ordered_on < '1997-01-01' or o_orderkey % 2 <> 0"), newest="at")
    last = F.struct(F.lit("2000-01-01").cast("date").alias("ordered_on"), F.lit(-1).cast("long").alias("o_orderkey"))
    closing = table(spark, d, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(None).cast("long").alias("o_orderkey"), F.lit(None).cast("date").alias("ordered_on"), F.lit(None).cast("double").alias("o_totalprice"), last.alias("at"), F.lit(True).alias("gone"))
    table_.upsert(closing, newest="at", deleted="gone")
    return table_.read().drop("at")


@register("snk6_run_with_issues", f"WITH {TRADES}, {BROKER}, i AS (SELECT account, count(*) AS n, min(bk.symbol) AS first_symbol FROM bk ANTI JOIN br USING (account, symbol, filled_at, side) GROUP BY 1) SELECT account, CASE WHEN n IS NULL THEN 'MATCHED' ELSE 'MISMATCHED' END AS status, coalesce(n, 0) AS n_issues, first_symbol FROM (SELECT DISTINCT account FROM tr) LEFT JOIN i USING (account)")
def _(spark, d):
    path = S.shared_folder(spark, "runs")
    issues = B.reconcile(books(spark, d), broker(spark, d), KEYS, "quantity", 1e-6).filter("issue = 'MISSING_BROKER'").select("account", "symbol", "filled_at", "side")
    S.write_run(B.verdict(issues, trades(spark, d).select("account").distinct(), "account").select("account", "status"), issues, path)
    back = S.read_runs(spark, path, "account")
    return back.select("account", "status", F.size("issues").cast("long").alias("n_issues"), F.array_min(F.transform("issues", lambda x: x["symbol"])).alias("first_symbol"))
