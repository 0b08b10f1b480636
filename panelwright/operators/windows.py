"""Rolling, cumulative and cross-sectional window analytics over long panels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import exponential


def by_time():
    return Window.partitionBy("symbol").orderBy("bar_ts")


def so_far():
    return by_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def cross():
    return Window.partitionBy("bar_ts")


def last(n: int):
    return by_time().rowsBetween(-(n - 1), Window.currentRow)


def full(value: Column, counted: str, n: int) -> Column:
    """``value`` where the frame of ``n`` rows is complete."""
    return F.when(F.count(counted).over(last(n)) == n, value)


def trailing_return(n: int, price: str = "close") -> Column:
    return F.col(price) / F.lag(price, n).over(by_time()) - 1


def rolling_mean(x: str, n: int) -> Column:
    return full(F.avg(x).over(last(n)), x, n)


def rolling_std(x: str, n: int) -> Column:
    return full(F.stddev_samp(x).over(last(n)), x, n)


def rolling_median(x: str, n: int) -> Column:
    return full(F.percentile(x, 0.5).over(last(n)), x, n)


def true_range() -> Column:
    before = F.lag("close").over(by_time())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def trailing_vol(ret: str, n: int, bars_per_year: int) -> Column:
    """Of the ``n`` bars before this one."""
    w = by_time().rowsBetween(-n, -1)
    return F.when(F.count(ret).over(w) == n, F.stddev_samp(ret).over(w) * math.sqrt(bars_per_year))


def equity(ret: str) -> Column:
    return F.product(1 + F.col(ret)).over(so_far())


def drawdown(eq: str) -> Column:
    return F.col(eq) / F.max(eq).over(so_far()) - 1


def zscore(x: str, least: int = 6, eps: float = 1e-8) -> Column:
    """Over the symbols of one date, where at least ``least`` have a value."""
    return F.when(F.count(x).over(cross()) >= least, (F.col(x) - F.avg(x).over(cross())) / (F.stddev_samp(x).over(cross()) + eps))


def rank(x: str) -> Column:
    """1 is the greatest; ties by symbol; rows without a value come last."""
    return F.row_number().over(cross().orderBy(F.col(x).desc_nulls_last(), "symbol"))


def average_rank(x: str, by: str) -> Column:
    """Ascending within ``by``; ties share the mean of their places."""
    return F.rank().over(Window.partitionBy(by).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(by, x)) - 1) / 2


def normalised(price: str = "close") -> Column:
    return F.col(price) / F.first(price, ignorenulls=True).over(so_far())


def split_of(panel: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """``bar_ts, split`` by position in the calendar, cut at truncated shares."""
    days = panel.select("bar_ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("bar_ts")) - 1)  # one row per date
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    a, b = F.floor(n * train), F.floor(n * (train + validation))
    return days.select("bar_ts", F.when(F.col("i") < a, "TRAIN").when(F.col("i") < b, "VALIDATION").otherwise("TRUE_OOS").alias("split"))


def drawdown_events(curve: DataFrame, enter: float = -0.02, leave: float = -0.005) -> DataFrame:
    """Recovered spells below ``enter`` until back above ``leave``: start, trough, end, bars and depth, from ``symbol, bar_ts, dd``."""
    mark = F.when(F.col("dd") < enter, 1).when(F.col("dd") >= leave, 0)
    latched = curve.withColumn("in_dd", F.coalesce(F.last(mark, ignorenulls=True).over(so_far()), F.lit(0)))
    island = F.sum(F.when(F.col("in_dd") != F.coalesce(F.lag("in_dd").over(by_time()), F.lit(0)), 1).otherwise(0)).over(so_far())
    spells = latched.withColumn("spell", island)
    ends = spells.groupBy("symbol").agg(F.max("spell").alias("final"))
    found = spells.filter("in_dd = 1").groupBy("symbol", "spell").agg(F.min("bar_ts").alias("start_ts"), F.min_by("bar_ts", F.struct("dd", "bar_ts")).alias("trough_ts"), F.max("bar_ts").alias("end_ts"), F.count(F.lit(1)).alias("bars"), F.min("dd").alias("depth"))
    return found.join(ends, "symbol").filter("spell < final").drop("final")


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row per key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(at)).alias("r")).select("r.*")


def reindexed(index: DataFrame, values: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """``values`` on the rows of ``index``; where it has none, each column's default."""
    out = index.join(values, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def before(n: int):
    """The ``n`` bars before this one."""
    return by_time().rowsBetween(-n, -1)


def _folded(history: Column, span: int) -> Column:
    a = 2.0 / (span + 1)
    squares = F.transform(history, lambda x: x * x)
    return F.aggregate(F.slice(squares, 2, 1 << 30), F.get(squares, F.lit(0)), lambda acc, v: acc * (1 - a) + v * a)


def ewma_vol(ret: str, bars: int, span: int, bars_per_year: int) -> Column:
    """Exponentially weighted volatility over at most ``bars`` bars before this one, seeded by the first of them; null without any."""
    return F.sqrt(_folded(F.collect_list(ret).over(before(bars)), span) * bars_per_year)


def downside_vol(ret: str, bars: int, bars_per_year: int) -> Column:
    """Root mean square of the negative returns among at most ``bars`` bars before this one, positive ones counting as 0."""
    x = F.least(F.col(ret), F.lit(0.0))
    return F.sqrt(F.avg(x * x).over(before(bars)) * bars_per_year)


def ewma_unbounded(rows: DataFrame, ret: str, span: int, bars_per_year: int, out: str, per_block: int = 50_000) -> DataFrame:
    """``out``: the exponentially weighted volatility of all bars up to this one, seeded by the symbol's first, for any span and any length of series."""
    squared = rows.withColumn("__sq", F.col(ret) * F.col(ret))
    averaged = exponential(squared, "__sq", 2.0 / (span + 1), ["symbol"], ["bar_ts"], "__ew", per_block)
    return averaged.withColumn(out, F.sqrt(F.col("__ew") * bars_per_year)).drop("__sq", "__ew")
