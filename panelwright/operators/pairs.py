"""Pair formation, pair trading and cointegration on long panels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cohorts(panel: DataFrame, form: int, trade: int, step: int) -> DataFrame:
    """Each bar once per cohort that covers it: ``c``, ``u`` (bars since the cohort's start; trading from ``form`` on) and ``p``, the price over the cohort's first.

    Cohort numbers follow from the bar's place in the calendar, so no range join is needed; cohorts whose formation the calendar cuts off are left out."""
    days = panel.select("bar_ts").distinct().withColumn("t", F.row_number().over(Window.orderBy("bar_ts")) - 1)  # one row per date
    days = days.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    low = F.greatest(F.lit(0), (F.floor((F.col("t") - (form + trade)) / step) + 1).cast("int"))
    spans = days.select("bar_ts", "t", "total", F.explode(F.sequence(low, F.floor(F.col("t") / step).cast("int"))).alias("c")).filter(F.col("c") * step + form <= F.col("total"))
    out = panel.hint("merge").join(spans.hint("merge"), "bar_ts").withColumn("u", F.col("t") - F.col("c") * step)
    first = F.first("close", ignorenulls=True).over(Window.partitionBy("c", "symbol").orderBy("bar_ts").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn("p", F.col("close") / first).drop("t", "total")


def sides(rows: DataFrame, columns: list[str], on: list[str]) -> DataFrame:
    """Rows of ``rows`` with those of every later symbol under the same ``on`` keys: ``i, j`` and each column as ``x_i, x_j``."""
    a = rows.select(*on, F.col("symbol").alias("i"), *[F.col(x).alias(f"{x}_i") for x in columns])
    b = rows.select(*on, F.col("symbol").alias("j"), *[F.col(x).alias(f"{x}_j") for x in columns])
    return a.hint("merge").join(b.hint("merge"), on).filter("i < j")


def all_pairs(symbols: DataFrame, on: list[str] = [], blocks: int = 16) -> DataFrame:  # noqa: B006
    """``i, j`` of every unordered pair of the rows of ``symbols`` (``symbol`` and the ``on`` keys), a dimension: one row per symbol, not per bar. Without keys, symbols are dealt to ``blocks`` by hash and each pair of blocks is a join key."""
    a, b = symbols.withColumnRenamed("symbol", "i"), symbols.withColumnRenamed("symbol", "j")
    if on:
        return a.join(b, on).filter("i < j")
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    a = a.withColumn("bi", block("i")).withColumn("bj", F.explode(F.sequence("bi", F.lit(blocks - 1))))
    b = b.withColumn("bj", block("j")).withColumn("bi", F.explode(F.sequence(F.lit(0), "bj")))
    both = a.hint("merge").join(b.hint("merge"), ["bi", "bj"]).filter("bi < bj or i < j")
    return both.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))


def spread_z(spreads: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Adds ``z``: the spread against mean and deviation of its last ``n`` bars, 0 and 1 before the window is full."""
    w = Window.partitionBy(*keys).orderBy("bar_ts").rowsBetween(-(n - 1), Window.currentRow)
    whole = F.count("spread").over(w) == n
    mean, sd = F.when(whole, F.avg("spread").over(w)).otherwise(0.0), F.when(whole, F.stddev_samp("spread").over(w)).otherwise(1.0)
    return spreads.withColumn("z", (F.col("spread") - mean) / (sd + 1e-8))


def form_pairs(rows: DataFrame, form: int, top: int, share: float = 0.8, salts: int = 16, same: str | None = None) -> DataFrame:
    """The ``top`` pairs of each cohort by mean squared distance of normalised prices, with the mean and deviation (floor 1e-4) of their spread.

    A pair needs ``share`` of the formation's bars in common (10 at least). Ties go by name. Each symbol of a cohort is one array of ``form`` prices, so
    what is joined are pairs of symbols, not of bars; a cohort's pairs are split over ``salts`` tasks. ``same`` names a column that both symbols must share."""
    early = rows.filter(F.col("u") < form).groupBy("c", "symbol", *([same] if same else [])).agg(F.map_from_entries(F.collect_list(F.struct("u", "p"))).alias("m"))
    line = F.transform(F.sequence(F.lit(0), F.lit(form - 1)), lambda k: F.try_element_at("m", k.cast(rows.schema["u"].dataType)))
    on = ["c", "salt", *([same] if same else [])]
    arrays = early.select("c", "symbol", *([same] if same else []), line.alias("x"))
    extra = on[2:]
    a = arrays.select("c", *extra, F.col("symbol").alias("i"), F.col("x").alias("x_i"), F.pmod(F.xxhash64("symbol"), F.lit(salts)).cast("int").alias("salt"))
    b = arrays.select("c", *extra, F.col("symbol").alias("j"), F.col("x").alias("x_j"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    both = a.hint("merge").join(b.hint("merge"), on).filter("i < j")
    both = both.select("c", "i", "j", F.filter(F.zip_with("x_i", "x_j", lambda p, q: p - q), lambda s: s.isNotNull()).alias("s")).withColumn("n", F.size("s"))
    both = both.filter(F.col("n") >= max(10, math.floor(share * form)))
    total = lambda f: F.aggregate("s", F.lit(0.0), lambda acc, v: acc + f(v))
    g = both.withColumn("mean", total(lambda v: v) / F.col("n")).withColumn("dist", total(lambda v: v * v) / F.col("n"))
    var = F.aggregate("s", F.lit(0.0), lambda acc, v: acc + (v - F.col("mean")) * (v - F.col("mean"))) / (F.col("n") - 1)
    g = g.select("c", "i", "j", "dist", "mean", F.sqrt(F.greatest(var, F.lit(1e-8))).alias("sd"), F.col("n").cast("long").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("c").orderBy("dist", "i", "j"))).filter(F.col("place") <= top)


def trade_pairs(rows: DataFrame, pairs: DataFrame, form: int, enter: float = 2.0, leave: float = 0.5) -> DataFrame:
    """Per (cohort, pair, bar): ``held`` (-1, 0, 1: side of the spread sold at the bar before), the pair's return and the decision taken here.

    Flat and the spread beyond ``enter`` deviations of its mean: enter on its side. Held and the spread back across the mean or within ``leave`` deviations: exit.
    The last bar always exits. A decision takes effect on the next bar. One fold per pair over at most the trading window's bars."""
    later = rows.filter(F.col("u") >= form).select("c", "bar_ts", "symbol", "p", "ret")
    # Cohort rows are exploded: no automatic broadcast.
    x = pairs.select("c", "i", "j", "mean", "sd").hint("merge").join(later.select("c", "bar_ts", F.col("symbol").alias("i"), F.col("p").alias("p_i"), F.col("ret").alias("r_i")).hint("merge"), ["c", "i"])
    x = x.join(later.select("c", "bar_ts", F.col("symbol").alias("j"), F.col("p").alias("p_j"), F.col("ret").alias("r_j")).hint("merge"), ["c", "bar_ts", "j"])
    z = (F.col("p_i") - F.col("p_j") - F.col("mean")) / F.col("sd")
    bar = F.struct("bar_ts", z.alias("z"), (F.coalesce("r_i", F.lit(0.0)) - F.coalesce("r_j", F.lit(0.0))).alias("d"))
    days = x.groupBy("c", "i", "j").agg(F.sort_array(F.collect_list(bar)).alias("days")).withColumn("final", F.element_at("days", -1)["bar_ts"])
    kind = "array<struct<bar_ts:date,z:double,held:int,ret:double,action:string>>"
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out"))

    def step(acc, d):
        pos, z = acc["pos"], d["z"]
        side = F.signum(z).cast("int")
        end = d["bar_ts"] == F.col("final")
        enters = (pos == 0) & (F.abs(z) > enter) & ~end
        leaves = (pos != 0) & ((side != pos) | (F.abs(z) <= leave) | end)
        after = F.when(enters, side).when(leaves, F.lit(0)).otherwise(pos)
        action = F.when(enters, "ENTER").when((pos != 0) & end, "HORIZON").when(leaves, "EXIT").otherwise("HOLD")
        row = F.struct(d["bar_ts"].alias("bar_ts"), z.alias("z"), pos.alias("held"), (-pos * d["d"]).alias("ret"), action.alias("action"))
        return F.struct(after.alias("pos"), F.concat(acc["out"], F.array(row)).alias("out"))

    return days.select("c", "i", "j", F.inline(F.aggregate("days", start, step, lambda acc: acc["out"])))


def cohort_returns(traded: DataFrame, bps: float = 10.0) -> DataFrame:
    """``c, bar_ts, gross, cost, net`` of cohorts that hold their pairs: a pair's weight is 1 when it begins to earn and compounds with its own returns while it does; a bar without a return ends the run and resets it.

    An entry or exit costs two legs of ``bps`` over the cohort's number of pairs, on the bar when it is carried out: the next one, but the last bar for a horizon."""
    w = Window.partitionBy("c", "i", "j").orderBy("bar_ts")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = traded.withColumn("on", F.abs("ret") > 1e-12).withColumn("run", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(so_far))
    earlier = Window.partitionBy("c", "i", "j", "run", "on").orderBy("bar_ts").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("w", F.when(F.col("on"), F.coalesce(F.product(1 + F.col("ret")).over(earlier), F.lit(1.0))).otherwise(1.0))
    done = F.when(F.col("action") == "HORIZON", F.col("bar_ts")).when(F.col("action").isin("ENTER", "EXIT"), F.lead("bar_ts").over(w))
    x = x.withColumn("done", done)
    size = x.groupBy("c").agg(F.count_distinct("i", "j").alias("m"))
    gross = x.groupBy("c", "bar_ts").agg((F.sum(F.col("w") * F.col("ret")) / F.greatest(F.lit(1e-8), F.sum("w"))).alias("gross"))
    acts = x.filter("done is not null").groupBy("c", F.col("done").alias("bar_ts")).agg(F.count(F.lit(1)).alias("acts"))
    out = gross.join(acts.hint("merge"), ["c", "bar_ts"], "left").join(size.hint("merge"), "c").withColumn("cost", F.coalesce(F.col("acts") * 2 * bps / 1e4 / F.col("m"), F.lit(0.0)))
    return out.select("c", "bar_ts", "gross", "cost", (F.col("gross") - F.col("cost")).alias("net"))


def strategy_returns(traded: DataFrame, bps: float = 10.0) -> DataFrame:
    """Mean over the cohorts active on a date."""
    return cohort_returns(traded, bps).groupBy("bar_ts").agg(F.avg("gross").alias("gross"), F.avg("net").alias("net"), F.count(F.lit(1)).alias("cohorts"))


def completed_trades(traded: DataFrame) -> DataFrame:
    """``c, i, j, entered, left, spread_return, days, reason`` of trades that were closed: dates of execution, and the spread gained on the entry's side, in deviations."""
    w = Window.partitionBy("c", "i", "j").orderBy("bar_ts")
    x = traded.withColumn("next", F.lead("bar_ts").over(w)).withColumn("next_z", F.lead("z").over(w))
    x = x.withColumn("trade", F.sum(F.when(F.col("action") == "ENTER", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("action <> 'HOLD'")
    enter, leave = F.col("action") == "ENTER", F.col("action").isin("EXIT", "HORIZON")
    at = F.when(F.col("action") == "HORIZON", F.col("bar_ts")).otherwise(F.col("next"))
    z = F.when(F.col("action") == "HORIZON", F.col("z")).otherwise(F.col("next_z"))
    # A trade's entry stands at its signal's spread, its exit at that of the bar when it is carried out.
    g = x.groupBy("c", "i", "j", "trade").agg(
        F.max(F.when(enter, at)).alias("entered"), F.max(F.when(enter, F.col("z"))).alias("z0"), F.max(F.when(leave, at)).alias("left"), F.max(F.when(leave, z)).alias("z1"), F.max(F.when(leave, F.when(F.col("action") == "HORIZON", "HORIZON_END").otherwise("CONVERGENCE"))).alias("reason")
    )
    g = g.filter("entered is not null and left is not null and entered <= left")
    return g.select("c", "i", "j", "entered", "left", (-F.signum("z0") * (F.col("z1") - F.col("z0"))).alias("spread_return"), F.date_diff("left", "entered").alias("days"), "reason")


def trade_report(trades: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Number of trades, rates of winning, converging and forced closing, mean, median, best and worst return, mean days held."""
    x = F.col("spread_return")
    share = lambda c: F.avg(c.cast("int"))
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), share(x > 0).alias("win_rate"), share(F.col("reason") == "CONVERGENCE").alias("convergence_rate"), share(F.col("reason") == "HORIZON_END").alias("forced_rate"),
        F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"), F.max(x).alias("best"), F.min(x).alias("worst"), F.avg("days").alias("days"),
    )


#: Critical values of the residual test by number of regressors, at 1, 5 and 10 %; beyond four they go on linearly.
CRITICAL = {1: (-3.896, -3.336, -3.046), 2: (-4.292, -3.743, -3.452), 3: (-4.649, -4.100, -3.811), 4: (-4.969, -4.425, -4.135)}
BEYOND = (0.35, 0.38, 0.36)


def critical_value(regressors: int, level: int = 1) -> float:
    """``level``: 0, 1 or 2 for 1, 5 or 10 %."""
    return CRITICAL[regressors][level] if regressors in CRITICAL else CRITICAL[1][level] - BEYOND[level] * (regressors - 1)


def approximate_p(stat, regressors: int = 1):
    """Of the residual test: 0.05 at the 5 % value, falling exponentially below and rising linearly above, between 1e-6 and 1."""
    gap = stat - critical_value(regressors)
    p = F.when(gap < 0, 0.05 * F.exp(1.2 * gap)).otherwise(F.least(F.lit(1.0), 0.05 + 0.15 * gap))
    return F.greatest(F.lit(1e-6), F.least(F.lit(1.0), p))


def residual_test(residuals: DataFrame, keys: list[str], max_lags: int = 5, least: int = 20) -> DataFrame:
    """``keys, stat, lag, p, m``: unit-root t of residuals ``u`` ordered by ``bar_ts``, without constant, its lag from 1 to ``max_lags`` chosen by Akaike's criterion.

    Lag L regresses the change on the level before and L - 1 changes before, and drops the first L rows. Spark adds up the products of each key and lag; tasks solve
    their systems of at most ``max_lags`` unknowns, many keys to a batch."""
    w = Window.partitionBy(*keys).orderBy("bar_ts")
    x = residuals.select(*keys, "bar_ts", "u").withColumn("u1", F.lag("u").over(w)).withColumn("k", F.row_number().over(w) - 1).withColumn("d0", F.col("u") - F.col("u1"))
    x = x.withColumns({f"d{i}": F.lag("d0", i).over(w) for i in range(1, max_lags)})
    names = ["u1", *[f"d{i}" for i in range(1, max_lags)]]
    pairs = [(i, j) for i in range(max_lags) for j in range(i, max_lags)]
    lags = range(1, max_lags + 1)
    rows = x.filter("u1 is not null")

    def total(lag, value):
        return F.sum(F.when(F.col("k") > lag, value))  # the first change belongs to row 1; lag L uses changes L, L + 1, ...

    sums = []
    for lag in lags:
        xx = F.array(*[total(lag, F.col(names[i]) * F.col(names[j])) if j < lag else F.lit(0.0) for i, j in pairs])
        xy = F.array(*[total(lag, F.col(names[i]) * F.col("d0")) if i < lag else F.lit(0.0) for i in range(max_lags)])
        sums.append(F.struct(F.lit(lag).alias("lag"), xx.alias("xx"), xy.alias("xy"), total(lag, F.col("d0") * F.col("d0")).alias("yy"), F.count_if(F.col("k") > lag).alias("m")))
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("s")).filter(F.col("n") + 1 >= least)
    flat = g.select(*keys, "n", F.inline("s")).filter(F.col("lag") < F.floor((F.col("n") + 1 - 5) / 2))
    schema = ", ".join(f"`{k}` {residuals.schema[k].dataType.simpleString()}" for k in keys)

    def solve(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            out = []
            for lag, part in b.groupby("lag"):
                m, n = int(lag), part["m"].to_numpy().astype(float)
                a, full = np.zeros((len(part), m, m)), np.stack(part["xx"])
                for k, (i, j) in enumerate(pairs):
                    if j < m:
                        a[:, i, j] = a[:, j, i] = full[:, k]
                xy = np.stack(part["xy"])[:, :m]
                inv = np.linalg.pinv(a)
                beta = np.einsum("kij,kj->ki", inv, xy)
                rss = part["yy"].to_numpy() - (beta * xy).sum(1)
                good = (n - m > 0) & (rss > 0)
                with np.errstate(invalid="ignore", divide="ignore"):
                    se = np.sqrt(rss / (n - m) * inv[:, 0, 0])
                    r = pd.DataFrame({**{k: part[k].to_numpy() for k in keys}, "stat": beta[:, 0] / se, "lag": m, "aic": n * np.log(rss / n) + 2 * m, "m": part["m"].to_numpy()})
                out.append(r[good & (se > 0)])
            if out:
                yield pd.concat(out)

    tried = flat.mapInPandas(solve, f"{schema}, stat double, lag int, aic double, m long")
    best = tried.groupBy(*keys).agg(F.min_by(F.struct("stat", "lag", "m"), F.struct("aic", "lag")).alias("b")).select(*keys, "b.stat", "b.lag", "b.m")
    return best.withColumn("p", approximate_p(F.col("stat")))


def scan_pairs(rows: DataFrame, on: list[str], pairs: DataFrame | None = None, kappa: float = 0.0, max_lags: int = 5) -> DataFrame:
    """``on, i, j, n, slope, intercept, r2, kappa, stat, lag, p, half_life, cointegrated`` of pairs of symbols under the same ``on`` keys (``rows``: on, bar_ts, symbol, close).

    Pairs whose condition number is under ``kappa`` go no further. ``pairs`` (on, i, j) restricts what is tested: a screen by distance acts as a join that prunes the expensive test."""
    a = rows.select(*on, "bar_ts", F.col("symbol").alias("i"), F.col("close").alias("y"))
    b = rows.select(*on, "bar_ts", F.col("symbol").alias("j"), F.col("close").alias("x"))
    both = a.join(pairs.hint("merge"), [*on, "i"]).join(b.hint("merge"), [*on, "j", "bar_ts"]) if pairs is not None else a.hint("merge").join(b.hint("merge"), [*on, "bar_ts"]).filter("i < j")
    both = both.filter("y is not null and x is not null")
    key = [*on, "i", "j"]
    fit = both.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), gram_condition("y", "x").alias("kappa"))
    fit = fit.filter(F.col("kappa") >= kappa)
    e = both.hint("merge").join(fit.select(*key, "slope", "intercept").hint("merge"), key).withColumn("u", F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")).select(*key, "bar_ts", "u")
    w = Window.partitionBy(*key).orderBy("bar_ts")
    back = e.withColumn("u1", F.lag("u").over(w)).groupBy(*key).agg(F.regr_slope(F.col("u") - F.col("u1"), F.col("u1")).alias("lam"))
    out = fit.hint("merge").join(residual_test(e, key, max_lags).hint("merge"), key).join(back.hint("merge"), key)
    life = F.when(F.col("lam") < -1e-6, F.when(F.col("lam") <= -1, 1.0).otherwise(F.greatest(F.lit(1.0), -math.log(2) / F.ln(1 + F.col("lam")))))
    verdict = (F.col("p") <= 0.05) | (F.col("stat") < critical_value(1))
    return out.select(*key, "n", "slope", "intercept", "r2", "kappa", "stat", "lag", "p", life.alias("half_life"), verdict.alias("cointegrated"))


def walk_forward_pairs(panel: DataFrame, train: int, every: int, kappa: float, max_lags: int = 5) -> tuple[DataFrame, DataFrame]:
    """(choices, spreads): every ``every`` bars the pair with the smallest statistic on the ``train`` bars before, and its spread on the bars until the next choice, with that choice's coefficients.

    ``choices``: c, i, j, slope, intercept, stat. ``spreads``: c, t, bar_ts, spread, active; bars without a cointegrated pair have spread 0. Nothing at or after a bar enters its choice."""
    days = panel.select("bar_ts").distinct().withColumn("t", F.row_number().over(Window.orderBy("bar_ts")) - 1).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))  # one row per date
    # Window c covers bars c * every ... c * every + train - 1 and is traded on the ``every`` bars after.
    low = F.greatest(F.lit(0), (F.floor((F.col("t") - train) / every) + 1).cast("int"))
    spans = days.select("bar_ts", "t", "total", F.explode(F.sequence(low, F.floor(F.col("t") / every).cast("int"))).alias("c")).filter(F.col("c") * every + train < F.col("total"))
    rows = panel.select("symbol", "bar_ts", "close").hint("merge").join(spans.hint("merge"), "bar_ts")
    found = scan_pairs(rows.select("c", "bar_ts", "symbol", "close"), ["c"], None, kappa, max_lags).filter("cointegrated")
    choice = found.groupBy("c").agg(F.min_by(F.struct("i", "j", "slope", "intercept", "stat"), F.struct("stat", "i", "j")).alias("b")).select("c", "b.*")
    live = days.filter(F.col("t") >= train).withColumn("c", F.floor((F.col("t") - train) / every).cast("int")).drop("total")
    at = live.join(choice.hint("merge"), "c", "left")
    price = lambda name, side: panel.select(F.col("symbol").alias(side), "bar_ts", F.col("close").alias(name))
    x = at.join(price("y", "i").hint("merge"), ["i", "bar_ts"], "left").join(price("x", "j").hint("merge"), ["j", "bar_ts"], "left")
    there = F.col("y").isNotNull() & F.col("x").isNotNull()
    spread = F.when(there, F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")).otherwise(0.0)
    return choice, x.select("c", "t", "bar_ts", spread.alias("spread"), there.alias("active"))


def gram_condition(a: str, b: str):
    """Condition number of the two columns (an aggregate), from the eigenvalues of their 2 x 2 Gram matrix."""
    aa, bb, ab = F.sum(F.col(a) * F.col(a)), F.sum(F.col(b) * F.col(b)), F.sum(F.col(a) * F.col(b))
    root = F.sqrt((aa - bb) * (aa - bb) + 4 * ab * ab)
    # The small eigenvalue from the determinant: the plain difference cancels.
    big = (aa + bb + root) / 2
    det = aa * bb - ab * ab
    return F.when(det > 0, big / F.sqrt(det)).otherwise(F.lit(math.inf))


def engle_granger(panel: DataFrame, on: list[str], critical: float = -3.3377) -> DataFrame:
    """Per pair under the same ``on`` keys: slope, intercept, R2, condition number, the unit-root t of the residuals (no constant, one lag), half-life, verdict.

    Two regressors per pair, so both regressions are closed forms over sums. ``critical``: the 5 % point for two variables."""
    both = sides(panel, ["close"], on).filter("close_i is not null and close_j is not null")
    w = Window.partitionBy("i", "j")
    fit = both.withColumn("slope", F.regr_slope("close_i", "close_j").over(w)).withColumn("icpt", F.regr_intercept("close_i", "close_j").over(w))
    t = w.orderBy("bar_ts")
    e = fit.withColumn("s", F.col("close_i") - F.col("icpt") - F.col("slope") * F.col("close_j"))
    e = e.withColumn("s1", F.lag("s").over(t)).withColumn("ds", F.col("s") - F.col("s1")).withColumn("d1", F.lag("ds").over(t))
    there = F.col("d1").isNotNull()
    total = lambda a, b: F.sum(F.when(there, F.col(a) * F.col(b)))
    g = e.groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("n"), F.first("slope").alias("slope"), F.first("icpt").alias("intercept"), F.regr_r2("close_i", "close_j").alias("r2"), gram_condition("close_i", "close_j").alias("kappa"),
        F.count_if(there).alias("m"), total("s1", "s1").alias("a11"), total("s1", "d1").alias("a12"), total("d1", "d1").alias("a22"), total("s1", "ds").alias("y1"), total("d1", "ds").alias("y2"), total("ds", "ds").alias("yy"),
        F.regr_slope("ds", "s1").alias("lam"),
    )
    det = F.col("a11") * F.col("a22") - F.col("a12") * F.col("a12")
    b1, b2 = (F.col("a22") * F.col("y1") - F.col("a12") * F.col("y2")) / det, (F.col("a11") * F.col("y2") - F.col("a12") * F.col("y1")) / det
    var = (F.col("yy") - b1 * F.col("y1") - b2 * F.col("y2")) / (F.col("m") - 2)
    solved = g.filter((F.col("m") > 2) & (det > 0)).withColumn("adf_t", b1 / F.sqrt(var * F.col("a22") / det))
    life = F.when(F.col("lam") >= 0, None).when(F.col("lam") <= -1, 1.0).otherwise(F.greatest(F.lit(1.0), -math.log(2) / F.ln(1 + F.col("lam"))))
    return solved.select("i", "j", "n", "slope", "intercept", "r2", "kappa", "adf_t", life.alias("half_life"), (F.col("adf_t") < critical).alias("cointegrated"))
