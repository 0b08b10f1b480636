"""Cross-sectional factors, weights and portfolios. A score or weight is one row per (date, symbol); ``keys`` beside the date separate configurations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import by_time, last


def skip_momentum(n: int, skip: int) -> Column:
    """Return from ``n`` bars ago to ``skip`` bars ago."""
    return F.lag("close", skip).over(by_time()) / F.lag("close", n).over(by_time()) - 1


def value_score(n: int) -> Column:
    """Cheapness against the own mean of ``n`` bars, in deviations; null before the frame is full or without movement."""
    w = last(n)
    sd = F.stddev_samp("close").over(w)
    return F.when((F.count("close").over(w) == n) & (sd > 1e-12), -(F.col("close") - F.avg("close").over(w)) / sd)


def composite(*scores: str) -> Column:
    """Mean of the scores that are there."""
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in scores), F.lit(0.0))
    there = sum((F.col(s).isNotNull().cast("int") for s in scores), F.lit(0))
    return F.when(there > 0, total / there)


def both_ends(scores: DataFrame, score: str, k: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The ``k`` best (``side`` 1) and ``k`` worst (-1) of each date that has at least ``2 k`` scores; ties by symbol."""
    w = Window.partitionBy(*keys, "bar_ts")
    ranked = scores.filter(F.col(score).isNotNull()).withColumn("up", F.row_number().over(w.orderBy(F.desc(score), "symbol"))).withColumn("n", F.count(F.lit(1)).over(w))
    side = F.when(F.col("up") <= k, 1).when(F.col("up") > F.col("n") - k, -1)
    return ranked.filter(F.col("n") >= 2 * k).withColumn("side", side).filter("side is not null").drop("up", "n")


def inverse_vol(selected: DataFrame, vol: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds ``weight``: each side of a date sums to 0.5, shared by the inverse of ``vol``."""
    inv = 1 / (F.col(vol) + 1e-8)
    total = F.sum(inv).over(Window.partitionBy(*keys, "bar_ts", "side"))
    return selected.withColumn("weight", F.col("side") * 0.5 * inv / total)


def capped(weights: DataFrame, cap: float, passes: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Water-filling: what exceeds ``cap`` goes to the uncapped names of its side, in proportion; ``passes`` is at least the number of names of a side.

    A side whose names times ``cap`` hold less than its total ends with every name at the cap."""
    w = Window.partitionBy(*keys, "bar_ts", "side")
    out = weights.withColumn("a", F.abs("weight")).withColumn("whole", F.sum(F.abs("weight")).over(w))
    for _ in range(passes):
        free = F.when(F.col("a") < cap, F.col("a")).otherwise(0.0)
        out = out.withColumn("held", F.sum(F.when(F.col("a") >= cap, F.lit(cap)).otherwise(0.0)).over(w)).withColumn("free", F.sum(free).over(w))
        grown = F.col("a") * F.greatest(F.lit(0.0), F.col("whole") - F.col("held")) / F.col("free")
        out = out.withColumn("a", F.when(F.col("a") >= cap, F.lit(cap)).otherwise(grown))
    return out.withColumn("weight", F.col("side") * F.least(F.col("a"), F.lit(cap))).drop("a", "whole", "held", "free")


def held_between(grid: DataFrame, weights: DataFrame, every: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``weight`` on every bar of ``grid`` (keys, bar_ts, symbol, t): set on the bars where ``t % every = 0`` (unselected: 0) and carried to the next."""
    # The grid is exploded and the weights come from a generator: their sizes are not known, so no automatic broadcast.
    chosen = grid.hint("merge").join(weights.select(*keys, "bar_ts", "symbol", "weight").hint("merge"), [*keys, "bar_ts", "symbol"], "left")
    set_here = F.when(F.col("t") % every == 0, F.coalesce("weight", F.lit(0.0)))
    w = Window.partitionBy(*keys, "symbol").orderBy("bar_ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chosen.withColumn("weight", F.coalesce(F.last(set_here, ignorenulls=True).over(w), F.lit(0.0)))


def portfolio(held: DataFrame, bps: float, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``gross, turnover, net`` per date from ``weight, ret``: yesterday's weights earn today's returns."""
    was = F.coalesce(F.lag("weight").over(Window.partitionBy(*keys, "symbol").orderBy("bar_ts")), F.lit(0.0))
    x = held.withColumn("pnl", was * F.coalesce("ret", F.lit(0.0))).withColumn("moved", F.abs(F.col("weight") - was))
    day = x.groupBy(*keys, "bar_ts").agg(F.sum("pnl").alias("gross"), F.sum("moved").alias("turnover"))
    return day.withColumn("net", F.col("gross") - F.col("turnover") * bps / 1e4)


def hysteresis(ranks: DataFrame, n: int, keep_long: int, keep_short: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Longs stay while their rank is at most ``keep_long``, shorts while theirs is at least ``keep_short``; free places go to the best and the worst.

    ``ranks``: keys, bar_ts, symbol, rnk (1 is best), of rebalancing dates only. One fold over the dates of each configuration, whose only state is two lists of ``n`` names; of
    a date it holds only the ranks that can matter, the best ``max(keep_long, 2 n)`` and those from ``keep_short`` or the worst ``3 n`` on.
    Returns keys, bar_ts, longs, shorts (arrays, best and worst rank first). A name never stands on both sides: longs are chosen first."""
    most = F.max("rnk").over(Window.partitionBy(*keys, "bar_ts"))
    ranks = ranks.withColumn("__n", most).filter((F.col("rnk") <= max(keep_long, 2 * n)) | (F.col("rnk") >= F.least(F.lit(keep_short), F.col("__n") - 3 * n + 1)))
    day = ranks.groupBy(*keys, "bar_ts").agg(F.sort_array(F.collect_list(F.struct("rnk", "symbol"))).alias("r"))
    days = day.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bar_ts", "r"))).alias("days"))
    out_type = "array<struct<bar_ts:date,longs:array<string>,shorts:array<string>>>"
    start = F.struct(F.array().cast("array<string>").alias("l"), F.array().cast("array<string>").alias("s"), F.array().cast(out_type).alias("out"))

    def names(x):
        return F.transform(x, lambda e: e["symbol"])

    def step(acc, d):
        r = d["r"]
        kept_l = names(F.filter(r, lambda e: F.array_contains(acc["l"], e["symbol"]) & (e["rnk"] <= keep_long)))
        fill_l = F.filter(names(r), lambda s: ~F.array_contains(kept_l, s))
        longs = F.slice(F.concat(kept_l, fill_l), 1, n)
        back = F.reverse(r)
        kept_s = names(F.filter(back, lambda e: F.array_contains(acc["s"], e["symbol"]) & (e["rnk"] >= keep_short) & ~F.array_contains(longs, e["symbol"])))
        fill_s = F.filter(names(back), lambda s: ~F.array_contains(kept_s, s) & ~F.array_contains(longs, s))
        shorts = F.slice(F.concat(kept_s, fill_s), 1, n)
        row = F.array(F.struct(d["bar_ts"].alias("bar_ts"), longs.alias("longs"), shorts.alias("shorts")))
        return F.struct(longs.alias("l"), shorts.alias("s"), F.concat(acc["out"], row).alias("out"))

    return days.select(*keys, F.inline(F.aggregate("days", start, step, lambda acc: acc["out"])))


def max_drawdown_hedge(a_dd: Column, b_ret: Column, threshold: float) -> tuple[Column, Column]:
    """Mean return of B while A is under ``-threshold``, and the number of such bars (aggregates)."""
    under = a_dd < -threshold
    return F.avg(F.when(under, b_ret)), F.count_if(under)


def annual(mean: Column, sd: Column, bars: int) -> Column:
    return F.when(sd > 0, mean / sd * math.sqrt(bars))


def guarded_zscore(x: str, least: float = 1e-8) -> Column:
    """Over the symbols of one date; 0 where they do not differ."""
    w = Window.partitionBy("bar_ts")
    sd = F.stddev_samp(x).over(w)
    return F.when(F.coalesce(sd, F.lit(0.0)) < least, 0.0).otherwise((F.col(x) - F.avg(x).over(w)) / sd)


def weighted(scores: dict[str, float], veto: tuple[str, float] | None = None) -> Column:
    """Sum of weights times scores; -999 where the veto's score lies below its bound."""
    total = sum((w * F.col(s) for s, w in scores.items()), F.lit(0.0))
    return total if veto is None else F.when(F.col(veto[0]) < veto[1], -999.0).otherwise(total)


def dynamic_carry(panel: DataFrame, legs: DataFrame, n: int, vol_bars: int, bars_per_year: int) -> DataFrame:
    """``symbol, bar_ts, carry`` from prices alone, lagged one bar.

    ``legs``: symbol, leg (two bond legs ``long`` and ``short``, currencies ``base``, ``x`` and ``y``, else null), base (its own level), slope. The change over ``n`` bars of the bond legs' ratio and of the
    base currency against each other one are one row per date; a symbol without a leg has its level over its volatility."""
    named = panel.select("symbol", "bar_ts", "close").join(legs.hint("merge"), "symbol", "left")
    day = named.groupBy("bar_ts").pivot("leg", ["long", "short", "base", "x", "y"]).agg(F.first("close"))
    t = Window.orderBy("bar_ts")  # one row per date
    ffill = lambda c: F.last(c, ignorenulls=True).over(t.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    day = day.select("bar_ts", *[ffill(c).alias(c) for c in ("long", "short", "base", "x", "y")])
    change = lambda a, b: F.coalesce((F.col(a) / F.col(b)) / F.lag(F.col(a) / F.col(b), n).over(t) - 1, F.lit(0.0))
    day = day.select("bar_ts", change("long", "short").alias("term"), change("base", "x").alias("fx"), change("base", "y").alias("fy"))
    w = by_time()
    ret = F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0))
    x = named.withColumn("ret", ret).join(day, "bar_ts")
    sd = F.when(F.count("ret").over(last(vol_bars)) == vol_bars, F.nullif(F.stddev_samp("ret").over(last(vol_bars)) * math.sqrt(bars_per_year), F.lit(0.0)))
    x = x.withColumn("sd", sd).withColumn("vol", F.coalesce(F.last("sd", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0.15)))
    leg = F.col("leg")
    move = F.when(leg.isin("long", "short"), F.col("term")).when(leg == "base", F.col("fx") + F.col("fy")).when(leg == "x", F.col("fx")).when(leg == "y", F.col("fy"))
    raw = F.when(leg.isNull(), F.col("level") / F.col("vol")).otherwise(F.col("level") + F.col("slope") * move)
    return x.withColumn("raw", raw).select("symbol", "bar_ts", F.coalesce(F.lag("raw").over(w), F.lit(0.0)).alias("carry"))


def with_trend(selected: DataFrame, trend: DataFrame) -> DataFrame:
    """Longs above their moving average and shorts below it; ``trend``: symbol, bar_ts, close, sma. Those without an average go."""
    x = selected.join(trend.hint("merge"), ["symbol", "bar_ts"])
    return x.filter((F.col("side") > 0) & (F.col("close") > F.col("sma")) | (F.col("side") < 0) & (F.col("close") < F.col("sma"))).drop("close", "sma")


def score_weights(selected: DataFrame, score: str, vol: str, floor: float = 0.1, short_scale: float = 1.0, gate: float | None = None, mode: str = "LONG_SHORT", keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds ``weight``: each side of a date sums to 1 (shorts to -``short_scale``), shared by the score's size, ``floor`` at least, over volatility.

    ``gate`` scales all weights of a date by gate / median volatility where that is above it, to 0.2 at least (needs ``med_vol``). ``mode``: LONG_SHORT, LONG_ONLY or SHORT_ONLY."""
    keep = {"LONG_SHORT": F.lit(True), "LONG_ONLY": F.col("side") > 0, "SHORT_ONLY": F.col("side") < 0}[mode]
    size = F.greatest(F.lit(floor), F.col("side") * F.col(score)) / (F.col(vol) + 1e-8)
    w = size / F.sum(size).over(Window.partitionBy(*keys, "bar_ts", "side")) * F.when(F.col("side") < 0, -short_scale).otherwise(1.0)
    out = selected.filter(keep).withColumn("weight", w)
    if gate is not None:
        out = out.withColumn("weight", F.col("weight") * F.when(F.col("med_vol") > gate, F.greatest(F.lit(0.2), gate / F.col("med_vol"))).otherwise(1.0))
    return out


def blended(pair: DataFrame, vol: int, cov: int, limit: float = 0.08) -> DataFrame:
    """Of two return streams ``x, y`` by ``bar_ts`` (one row per date): equal, 70/30, inverse-volatility, least-variance (weight kept in 0.1 to 0.9) and drawdown-gated blends.

    Windows end one bar earlier; before they are full the blend is null, nothing is filled from the future."""
    t = Window.orderBy("bar_ts")
    past = lambda n: t.rowsBetween(-n, -1)
    full = lambda n, f: F.when(F.count("x").over(past(n)) == n, f.over(past(n)))
    z = pair.withColumn("sx", full(vol, F.stddev_samp("x"))).withColumn("sy", full(vol, F.stddev_samp("y"))).withColumn("c", full(cov, F.covar_samp("x", "y")))
    z = z.withColumn("eq", F.product(1 + F.col("x")).over(t.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    z = z.withColumn("dd", F.col("eq") / F.max("eq").over(t.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).withColumn("was", F.coalesce(F.lag("dd").over(t), F.lit(0.0)))
    a, b = F.coalesce(F.nullif("sx", F.lit(0.0)), F.when(F.col("sx") == 0, 0.01)), F.coalesce(F.nullif("sy", F.lit(0.0)), F.when(F.col("sy") == 0, 0.01))
    wv = (1 / a) / (1 / a + 1 / b)
    wm = F.greatest(F.lit(0.1), F.least(F.lit(0.9), (b * b - F.col("c")) / (a * a + b * b - 2 * F.col("c") + 1e-8)))
    wm = F.when(F.col("c").isNotNull(), wm)
    wd = F.when(F.col("was") < -limit, 0.3).otherwise(0.7)
    mix = lambda w: w * F.col("x") + (1 - w) * F.col("y")
    return z.select("bar_ts", mix(F.lit(0.5)).alias("equal"), mix(F.lit(0.7)).alias("tilted"), mix(wv).alias("inverse_vol"), mix(wm).alias("least_variance"), mix(wd).alias("gated"))
