"""Portfolio, risk and reconciliation over ledger tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def marked(positions: DataFrame, account: str) -> DataFrame:
    """Adds ``market_value, nav, weight`` from ``shares, price`` (missing: 0) and one ``cash`` per account; no weights where the net asset value vanishes."""
    value = F.coalesce(F.col("shares") * F.col("price"), F.lit(0.0))
    out = positions.withColumn("market_value", value)
    out = out.withColumn("nav", F.sum("market_value").over(Window.partitionBy(account)) + F.coalesce("cash", F.lit(0.0)))
    return out.withColumn("weight", F.when(F.abs("nav") < 1e-8, 0.0).otherwise(F.col("market_value") / F.col("nav")))


def target_shares(weight: Column, nav: Column, price: Column, min_notional: float = 0.0, lot: int = 1) -> Column:
    """Whole lots towards zero; nothing below the least notional or without a price."""
    raw = weight * nav / price / lot
    whole = F.when(raw >= 0, F.floor(raw)).otherwise(F.ceil(raw)) * lot
    return F.when((price <= 0) | price.isNull() | (F.abs(weight * nav) < min_notional), F.lit(0)).otherwise(whole).cast("long")


def rebalance_orders(target: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Side and quantity from target to held shares; symbols on one side only count as 0 on the other."""
    both = target.join(held, keys, "full_outer").withColumn("delta", F.coalesce("target", F.lit(0)) - F.coalesce("shares", F.lit(0)))
    return both.filter(F.abs("delta") >= 1e-6).select(*keys, F.when(F.col("delta") > 0, "BUY").otherwise("SELL").alias("side"), F.abs("delta").alias("quantity"))


def running_ledger(fills: DataFrame, account: str, at: list[str]) -> DataFrame:
    """Signed shares per (account, symbol) and cash per account after each fill; ``side, quantity, price, commission``."""
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    out = fills.withColumn("signed", sign * F.col("quantity")).withColumn("cash_delta", -sign * F.col("quantity") * F.col("price") - F.coalesce("commission", F.lit(0.0)))
    rows = lambda *k: Window.partitionBy(*k).orderBy(*at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("shares", F.sum("signed").over(rows(account, "symbol"))).withColumn("cash", F.sum("cash_delta").over(rows(account)))


def exposure(weights: DataFrame, key: str) -> DataFrame:
    w = F.col("weight")
    return weights.groupBy(key).agg(F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"), F.sum(F.when(w > 0, w).otherwise(0.0)).alias("long"), F.sum(F.when(w < 0, w).otherwise(0.0)).alias("short"), F.max(F.abs(w)).alias("largest"))


def reconcile(internal: DataFrame, broker: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """``keys, issue, internal_value, broker_value, discrepancy`` of rows that are on one side only or differ by more than ``tolerance``."""
    a = internal.select(*keys, F.col(value).alias("internal_value"), F.lit(True).alias("here"))
    b = broker.select(*keys, F.col(value).alias("broker_value"), F.lit(True).alias("there"))
    both = a.join(b, keys, "full_outer")
    diff = F.col("internal_value") - F.col("broker_value")
    issue = F.when(F.col("here").isNull(), "MISSING_INTERNAL").when(F.col("there").isNull(), "MISSING_BROKER").when(F.abs(diff) > tolerance, "MISMATCH")
    return both.withColumn("issue", issue).filter("issue is not null").select(*keys, "issue", "internal_value", "broker_value", diff.alias("discrepancy"))


def overfills(orders: DataFrame, fills: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    filled = fills.groupBy("order_id").agg(F.sum("quantity").alias("filled"))
    return orders.join(filled, "order_id").filter(F.col("filled") > F.col("quantity") + tolerance).select("order_id", "quantity", "filled")


def verdict(issues: DataFrame, runs: DataFrame, run: str) -> DataFrame:
    """One row per run: MATCHED or MISMATCHED, with the number of issues."""
    n = issues.groupBy(run).agg(F.count(F.lit(1)).alias("n_issues"))
    out = runs.join(n, run, "left").withColumn("n_issues", F.coalesce("n_issues", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n_issues") == 0, "MATCHED").otherwise("MISMATCHED"))


def latest_state(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Upsert: of both tables the newest row per key."""
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*both.columns), F.col(at)).alias("r")).select("r.*")


def trade_costs(trades: DataFrame, bps: float = 5.0, per_share: float = 0.005, slip_bps: float = 2.0) -> DataFrame:
    """Adds ``fee, share_cost, slippage, total_cost`` and the price after slippage, against the trader."""
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    value = F.col("quantity") * F.col("price")
    out = trades.withColumn("fee", value * bps / 1e4).withColumn("share_cost", F.col("quantity") * per_share).withColumn("slippage", value * slip_bps / 1e4)
    return out.withColumn("total_cost", F.col("fee") + F.col("share_cost") + F.col("slippage")).withColumn("fill_price", F.col("price") * (1 + sign * slip_bps / 1e4))


def risk_decisions(weights: DataFrame, key: str, max_gross: float = 1.5, max_single: float = 0.25, max_net: float = 1.0, min_cash: float = 0.05) -> DataFrame:
    """One row per account, all accounts at once: ``approved``, the sorted names of the limits it breaks, and the factor that brings gross back to its limit.

    Needs ``symbol, weight, nav, cash``; a net asset value that is missing, not finite or not positive breaks ``NAV`` alone."""
    w = F.col("weight")
    g = weights.groupBy(key).agg(F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"), F.max(F.abs(w)).alias("largest"), F.max("nav").alias("nav"), F.max("cash").alias("cash"))
    sound = F.coalesce((F.col("nav") > 0) & (F.col("nav") < float("inf")), F.lit(False))
    breaks = F.array_compact(F.array(
        F.when(F.col("cash") < min_cash * F.col("nav"), "CASH"), F.when(F.col("gross") > max_gross + 1e-6, "GROSS"), F.when(F.abs("net") > max_net + 1e-6, "NET"), F.when(F.col("largest") > max_single + 1e-6, "SINGLE"),
    ))
    out = g.withColumn("violations", F.when(sound, F.array_join(breaks, ";")).otherwise("NAV"))
    scale = F.when(F.col("gross") > max_gross, max_gross / F.col("gross")).otherwise(F.lit(1.0))
    return out.withColumn("approved", F.col("violations") == "").withColumn("scale", F.when(sound, scale).otherwise(F.lit(0.0)))


def missing_fills(broker: DataFrame, internal: DataFrame, keys: list[str]) -> DataFrame:
    """Broker fills that the books lack."""
    return broker.join(internal.select(*keys), keys, "left_anti")


def reconcile_cash(internal: DataFrame, holdings: DataFrame, accounts: DataFrame, positions: DataFrame, key: str, cash_tol: float = 0.01, nav_tol: float = 0.05) -> DataFrame:
    """``key, issue, internal_value, broker_value, discrepancy`` of cash, net asset value and its conservation, all accounts at once.

    ``internal``: key, cash. ``holdings`` and ``positions``: key, symbol, shares, price, the books' and the broker's. ``accounts``: key, cash, nav as the broker reports them.
    The books' holdings are valued at the broker's price where it has one."""
    theirs = positions.select(key, "symbol", F.col("price").alias("their_price"))
    valued = holdings.join(theirs, [key, "symbol"], "left").groupBy(key).agg(F.sum(F.col("shares") * F.coalesce("their_price", "price")).alias("own_value"))
    worth = positions.groupBy(key).agg(F.sum(F.col("shares") * F.col("price")).alias("their_value"))
    x = accounts.select(key, F.col("cash").alias("their_cash"), F.col("nav").alias("their_nav")).join(internal.select(key, F.col("cash").alias("own_cash")), key, "left").join(valued, key, "left").join(worth, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    checks = [
        ("CASH_MISMATCH", zero("own_cash"), F.col("their_cash"), cash_tol),
        ("NAV_MISMATCH", zero("own_cash") + zero("own_value"), F.col("their_nav"), nav_tol),
        ("NAV_CONSERVATION_VIOLATION", F.col("their_cash") + zero("their_value"), F.col("their_nav"), nav_tol),
    ]
    # Of the last the difference is reported minus expected.
    rows = F.array(*[F.struct(F.lit(n).alias("issue"), a.alias("internal_value"), b.alias("broker_value"), (b - a if n.startswith("NAV_C") else a - b).alias("discrepancy"), F.lit(tol).alias("tol")) for n, a, b, tol in checks])
    return x.select(key, F.inline(rows)).filter(F.abs("discrepancy") > F.col("tol")).drop("tol")


def reconcile_orders(internal: DataFrame, broker: DataFrame, states: tuple[str, ...], tolerance: float = 1e-6) -> DataFrame:
    """Issues of orders (``order_id, status, quantity`` on both sides), several to an order: missing on a side, unknown or other state, other quantity. Values as text."""
    a = internal.select("order_id", F.col("status").alias("s1"), F.col("quantity").alias("q1"), F.lit(True).alias("here"))
    b = broker.select("order_id", F.col("status").alias("s2"), F.col("quantity").alias("q2"), F.lit(True).alias("there"))
    both = F.col("here").isNotNull() & F.col("there").isNotNull()
    off = F.col("q1") - F.col("q2")
    none = F.lit(None).cast("double")
    issue = lambda when, name, x, y, gap: F.when(when, F.struct(F.lit(name).alias("issue"), x.cast("string").alias("internal_value"), y.cast("string").alias("broker_value"), gap.alias("discrepancy")))
    s1, s2 = F.col("s1"), F.col("s2")
    known = s2.isin(*states)
    found = F.array_compact(F.array(
        issue(F.col("there").isNull(), "ORDER_MISSING_BROKER", s1, s2, none), issue(F.col("here").isNull(), "ORDER_MISSING_INTERNAL", s1, s2, none),
        issue(both & ~known, "ORDER_UNKNOWN_STATE", s1, s2, none), issue(both & known & (s1 != s2), "ORDER_STATUS_MISMATCH", s1, s2, none),
        issue(both & (F.abs(off) > tolerance), "ORDER_QUANTITY_MISMATCH", F.col("q1"), F.col("q2"), off),
    ))
    return a.join(b, "order_id", "full_outer").select("order_id", F.inline(found))


def matched_fills(broker: DataFrame, internal: DataFrame) -> DataFrame:
    """Every broker fill with the books' quantity and price, found by its id or, failing that, by the broker's execution id."""
    own = internal.select(F.struct("quantity", "price").alias("own"), "fill_id", "broker_execution_id")
    by_id = own.select("fill_id", F.col("own").alias("o1"))
    by_execution = own.filter("broker_execution_id is not null").groupBy(F.col("broker_execution_id").alias("fill_id")).agg(F.min("own").alias("o2"))
    return broker.join(by_id, "fill_id", "left").join(by_execution, "fill_id", "left").withColumn("own", F.coalesce("o1", "o2")).drop("o1", "o2")


def reconcile_fills(broker: DataFrame, internal: DataFrame, quantity_tol: float = 1e-6, price_tol: float = 1e-4) -> DataFrame:
    """Issues of the broker's fills: missing in the books, other quantity, other price."""
    none = F.lit(None).cast("double")
    issue = lambda when, name, x, y: F.when(when, F.struct(F.lit(name).alias("issue"), x.alias("internal_value"), y.alias("broker_value"), (x - y).alias("discrepancy")))
    q, p, oq, op = F.col("quantity"), F.col("price"), F.col("own.quantity"), F.col("own.price")
    found = F.array_compact(F.array(issue(F.col("own").isNull(), "FILL_MISSING_INTERNAL", none, q), issue(F.abs(oq - q) > quantity_tol, "FILL_QUANTITY_MISMATCH", oq, q), issue(F.abs(op - p) > price_tol, "FILL_PRICE_MISMATCH", op, p)))
    return matched_fills(broker, internal).select("fill_id", F.inline(found))


def projected_cash(targets: DataFrame, held: DataFrame, accounts: DataFrame, key: str, least: float = 0.02, bps: float = 10.0) -> DataFrame:
    """Cash now and after trading to the targets with costs of ``bps`` of turnover, as shares of net asset value, and the check that fails first.

    ``targets``: key, symbol, weight; ``held``: key, symbol, shares, price; ``accounts``: key, cash, nav. A symbol without a price costs 1."""
    both = targets.select(key, "symbol", "weight").join(held.select(key, "symbol", "shares", "price"), [key, "symbol"], "full_outer").join(accounts, key)
    move = F.coalesce("weight", F.lit(0.0)) * F.col("nav") - F.coalesce("shares", F.lit(0.0)) * F.coalesce("price", F.lit(1.0))
    g = both.groupBy(key).agg(F.first("cash").alias("cash"), F.first("nav").alias("nav"), F.sum(move).alias("bought"), F.sum(F.abs(move)).alias("moved"))
    g = g.withColumn("now", F.col("cash") / F.col("nav")).withColumn("after", (F.col("cash") - F.col("bought") - F.col("moved") * bps / 1e4) / F.col("nav"))
    return g.select(key, "now", "after", F.when(F.col("now") < least - 1e-6, "CURRENT").when(F.col("after") < least - 1e-6, "PROJECTED").alias("violation"))


def short_checks(targets: DataFrame, locates: DataFrame, key: str, most: float = 0.5) -> DataFrame:
    """Per portfolio: short exposure, shorts that nobody lends (``locates``: symbol, available), and whether both are in order."""
    shorts = targets.join(locates, "symbol", "left").withColumn("short", F.col("weight") < -1e-6)
    g = shorts.groupBy(key).agg(
        F.sum(F.when(F.col("short"), -F.col("weight")).otherwise(0.0)).alias("short_exposure"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("short") & ~F.coalesce("available", F.lit(False)), F.col("symbol")))), ";").alias("not_lent"),
    )
    return g.withColumn("passed", (F.col("not_lent") == "") & (F.col("short_exposure") <= most + 1e-6))


def volatility_limit(returns: DataFrame, key: str, bars_per_year: int, lookback: int = 60, least: int = 20, most: float = 0.2) -> DataFrame:
    """Annual volatility of the last ``lookback`` returns of each key; too short a history fails closed."""
    newest = Window.partitionBy(key).orderBy(F.desc("bar_ts"))
    x = returns.filter("ret is not null").withColumn("r", F.row_number().over(newest)).withColumn("bars", F.count(F.lit(1)).over(Window.partitionBy(key)))
    g = x.filter(F.col("r") <= lookback).groupBy(key).agg(F.first("bars").alias("bars"), (F.stddev_samp("ret") * bars_per_year**0.5).alias("vol"))
    return g.withColumn("violation", F.when(F.col("bars") < least, "HISTORY").when(F.col("vol") > most + 1e-6, "VOLATILITY"))


def pre_trade_errors(orders: DataFrame, accounts: DataFrame, held: DataFrame, locates: DataFrame, key: str, whitelist: list[str], kinds: tuple[str, ...] = ("MARKET",), notional_cap: float | None = None) -> DataFrame:
    """``key, symbol, error`` before sending: instrument, order type, borrow for what a sale takes below nothing, and (symbol null) the batch's notional against a cap and buying power.

    ``orders``: key, symbol, side, quantity, kind, price; ``accounts``: key, buying_power; ``held``: key, symbol, shares; ``locates``: symbol, available."""
    x = orders.join(held.select(key, "symbol", "shares"), [key, "symbol"], "left").join(locates, "symbol", "left")
    below = (F.col("side") == "SELL") & ((F.coalesce("shares", F.lit(0.0)) <= 0) | (F.col("shares") < F.col("quantity")))
    own = F.array_compact(F.array(F.when(~F.col("symbol").isin(whitelist), "WHITELIST"), F.when(~F.col("kind").isin(*kinds), "ORDER_TYPE"), F.when(below & ~F.coalesce("available", F.lit(False)), "SHORT_LOCATE")))
    batch = orders.groupBy(key).agg(F.sum(F.col("quantity") * F.coalesce("price", F.lit(0.0))).alias("notional")).join(accounts, key, "left")
    cap = F.when(F.col("notional") > notional_cap, "NOTIONAL_CAP") if notional_cap is not None else F.lit(None).cast("string")
    power = F.when(F.col("buying_power").isNull(), "BUYING_POWER_UNKNOWN").when(F.col("notional") > F.col("buying_power"), "BUYING_POWER")
    whole = batch.select(key, F.lit(None).cast("string").alias("symbol"), F.explode(F.array_compact(F.array(cap, power))).alias("error"))
    return x.select(key, "symbol", F.explode(own).alias("error")).unionByName(whole)


def financing(snapshots: DataFrame, rate: float = 0.02, credit: float = 0.5, debit_bps: float = 150.0, borrow_bps: float = 50.0, days: int = 252) -> DataFrame:
    """Adds a day's ``interest`` (on cash beyond short proceeds, and ``credit`` of these), ``margin`` cost of negative cash and ``borrow_fee`` to rows with ``cash, short_notional``."""
    cash, short = F.col("cash"), F.col("short_notional")
    basis = F.greatest(F.lit(0.0), cash - short) + credit * F.least(cash, short)
    out = snapshots.withColumn("interest", F.when(cash > 0, basis * rate / days).otherwise(0.0)).withColumn("margin", F.when(cash < 0, -cash * (rate + debit_bps / 1e4) / days).otherwise(0.0))
    return out.withColumn("borrow_fee", short * borrow_bps / 1e4 / days)


def daily_shorts(fills: DataFrame, prices: DataFrame, account: str, at: list[str]) -> DataFrame:
    """``account, filled_at, cash, short_notional`` after each day with fills: a fill changes its symbol's short shares, the changes' values add up by account.

    ``prices``: symbol, price, at which short shares are valued."""
    x = running_ledger(fills, account, at).join(prices.select("symbol", F.col("price").alias("mark")), "symbol")
    before = F.col("shares") - F.col("signed")
    x = x.withColumn("change", (F.greatest(-F.col("shares"), F.lit(0.0)) - F.greatest(-before, F.lit(0.0))) * F.col("mark"))
    day = x.groupBy(account, "filled_at").agg(F.max_by("cash", F.struct(*at)).alias("cash"), F.sum("change").alias("change"))
    return day.select(account, "filled_at", "cash", F.sum("change").over(Window.partitionBy(account).orderBy("filled_at")).alias("short_notional"))


def preview(orders: DataFrame, accounts: DataFrame, key: str, rate: float = 0.001) -> DataFrame:
    """Totals of a batch before it is sent: orders, notional, commission, cash after it. ``orders``: key, side, quantity, price; ``accounts``: key, cash."""
    value = F.col("quantity") * F.coalesce("price", F.lit(0.0))
    flow = F.when(F.col("side") == "BUY", -value).otherwise(value) - value * rate
    g = orders.groupBy(key).agg(F.count(F.lit(1)).alias("n_orders"), F.sum(value).alias("notional"), F.sum(value * rate).alias("commission"), F.sum(flow).alias("flow"))
    return accounts.join(g, key, "left").select(key, F.coalesce("n_orders", F.lit(0)).alias("n_orders"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("notional", "commission")], (F.col("cash") + F.coalesce("flow", F.lit(0.0))).alias("projected_cash"))
