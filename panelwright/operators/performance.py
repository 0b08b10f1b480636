"""Returns of positions, and what they amount to."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.maths import adjusted_kurtosis, adjusted_skew


def earned(positions: DataFrame, keys: list[str], bps: float = 10.0) -> DataFrame:
    """``gross, turnover, net`` per bar: the position set at the bar before earns this bar's return; changes cost ``bps``. Needs ``pos, ret, bar_ts``."""
    w = Window.partitionBy(*keys).orderBy("bar_ts")
    held = F.coalesce(F.lag("pos").over(w), F.lit(0.0))
    out = positions.withColumn("gross", held * F.coalesce("ret", F.lit(0.0))).withColumn("turnover", F.abs(F.coalesce("pos", F.lit(0.0)) - held))
    return out.withColumn("net", F.col("gross") - F.col("turnover") * bps / 1e4)


def metrics(returns: DataFrame, keys: list[str], value: str, bars_per_year: int) -> DataFrame:
    """Win rate, profit factor, Sharpe, Sortino, Calmar, CAGR, volatility, drawdown, exposure and bars, in one pass after the equity window."""
    w = Window.partitionBy(*keys).orderBy("bar_ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = F.col(value)
    curve = returns.withColumn("eq", F.product(1 + r).over(w)).withColumn("dd", F.col("eq") / F.greatest(F.lit(1.0), F.max("eq").over(w)) - 1)
    agg = curve.groupBy(*keys).agg(
        F.count(r).alias("n_bars"), F.count_if(r > 0).alias("wins"), F.count_if(r != 0).alias("active"), F.sum(F.when(r > 0, r).otherwise(0.0)).alias("up"), F.sum(F.when(r < 0, -r).otherwise(0.0)).alias("down"),
        F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.stddev_samp(F.when(r < 0, r)).alias("sd_down"), F.product(1 + r).alias("growth"), F.min("dd").alias("max_drawdown"),
    )
    k = float(bars_per_year)
    cagr = F.when(F.col("growth") > 0, F.pow("growth", k / F.col("n_bars")) - 1).otherwise(F.lit(-1.0))
    return agg.select(
        *keys, "n_bars", (F.col("wins") / F.nullif("active", F.lit(0))).alias("win_rate"), F.when(F.col("down") > 0, F.col("up") / F.col("down")).otherwise(F.when(F.col("up") > 0, F.lit(math.inf)).otherwise(0.0)).alias("profit_factor"),
        F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * math.sqrt(k)).otherwise(0.0).alias("sharpe"), (F.col("sd") * math.sqrt(k)).alias("volatility"), cagr.alias("cagr"), "max_drawdown", (F.col("active") / F.col("n_bars")).alias("exposure"),
        F.when(F.col("sd_down") > 0, cagr / (F.col("sd_down") * math.sqrt(k))).alias("sortino"), F.when(F.col("max_drawdown") < 0, cagr / -F.col("max_drawdown")).alias("calmar"),
    )


def sharpe_stats(returns: DataFrame, keys: list[str], value: str, bars_per_year: int) -> DataFrame:
    """Sharpe ratio with a standard error for skewed, fat-tailed returns (excess kurtosis g: 1 - skew s + (g + 2) / 4 s^2), t and a 95 % interval, all annual."""
    r = F.col(value)
    m = returns.groupBy(*keys).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"))
    n = F.col("n").cast("double")
    k = math.sqrt(bars_per_year)
    out = m.withColumn("skew", adjusted_skew(F.col("g1"), n)).withColumn("kurt", adjusted_kurtosis(F.col("g2"), n)).withColumn("s", F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")))
    out = out.withColumn("se", F.sqrt((1 - F.col("skew") * F.col("s") + (F.col("kurt") + 2) / 4 * F.col("s") * F.col("s")) / (n - 1)) * k).withColumn("sharpe", F.col("s") * k)
    return out.select(*keys, "n", "sharpe", "se", (F.col("sharpe") / F.col("se")).alias("t"), (F.col("sharpe") - 1.96 * F.col("se")).alias("lo"), (F.col("sharpe") + 1.96 * F.col("se")).alias("hi"), "skew", "kurt")


def summary(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Mean, median, deviation, extremes, quartiles and share of positive values."""
    c = F.col(x)
    return df.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.percentile(c, 0.5).alias("median"), F.stddev_samp(c).alias("sd"), F.min(c).alias("least"), F.max(c).alias("most"), F.percentile(c, 0.25).alias("q25"), F.percentile(c, 0.75).alias("q75"), F.avg((c > 0).cast("int")).alias("positive"))


def deflated(stats: DataFrame, quantile, cdf) -> DataFrame:
    """Probability that a ratio (``symbol, n, sharpe, skew, kurt`` a bar) beats the best of as many unskilled trials as there are rows.

    The two totals, trials and spread of ratios, are one row and join as such."""
    g = 0.5772156649015329
    m = stats.agg(F.count(F.lit(1)).alias("trials"), F.stddev_samp("sharpe").alias("spread"))
    m = m.select((F.col("spread") * ((1 - g) * quantile(1 - 1 / F.col("trials")) + g * quantile(1 - 1 / (F.col("trials") * math.e)))).alias("bench"))
    s = F.col("sharpe")
    z = (s - F.col("bench")) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("skew") * s + (F.col("kurt") + 2) / 4 * s * s)
    return stats.crossJoin(F.broadcast(m)).select("symbol", "n", s.alias("s"), "bench", cdf(z).alias("dsr"))


def verdicts(stats: DataFrame) -> DataFrame:
    """``symbol, verdict, reasons, saturated`` from ``symbol, lo, hi, t, dsr``: rejected if the interval spans 0, the deflated ratio is under 0.95 or t under 2. A ratio of exactly 0 or 1 is a fault of its computation."""
    reasons = F.array_compact(F.array(F.when((F.col("lo") < 0) & (F.col("hi") > 0), "CI_SPANS_ZERO"), F.when(F.col("dsr") < 0.95, "DSR"), F.when(F.col("t") < 2, "T")))
    return stats.select("symbol", F.when(F.size(reasons) > 0, "REJECTED").otherwise("CONFIRMED").alias("verdict"), F.array_join(reasons, ";").alias("reasons"), F.col("dsr").isin(0.0, 1.0).alias("saturated"))


def scorecard(criteria: DataFrame, names: list[str], minimum: str) -> DataFrame:
    """Adds ``passed`` (how many of the named booleans hold) and a verdict: PROMOTE if all do, RETAIN if the ``minimum`` does, else REJECT. A null does not hold."""
    flags = F.array(*[F.coalesce(F.col(n), F.lit(False)) for n in names])
    verdict = F.when(F.forall(flags, lambda x: x), "PROMOTE").when(F.coalesce(F.col(minimum), F.lit(False)), "RETAIN").otherwise("REJECT")
    return criteria.withColumn("passed", F.size(F.filter(flags, lambda x: x)).cast("long")).withColumn("verdict", verdict)
