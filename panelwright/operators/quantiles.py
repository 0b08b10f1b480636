"""Quantiles from sketches that are stored and merged: a group's values are never held together, and yesterday's sketches need not be made again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a sketch: a few KB, however many values.
K = 400


def rank_error(k: int = K) -> float:
    """By how much the share of values below an estimated quantile is off, at most, in 99 of 100 cases: the published figure for these sketches, merged ones included."""
    return 2.296 / k**0.9021


def sketched(rows: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """``keys, n, sketch`` of the values that are not null or NaN; partial sketches are merged in the shuffle, so no task sees a whole group."""
    x = F.col(value).cast("double")
    return rows.filter(x.isNotNull() & ~F.isnan(x)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer groups (days, tasks, earlier runs) as those of ``keys``."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def points(sketches: DataFrame, shares: list[float]) -> DataFrame:
    """The other columns with ``share, value``: the estimated quantile at each of ``shares``."""
    at = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias("value")) for s in shares]))
    return sketches.withColumn("__p", at).select(*[c for c in sketches.columns if c != "sketch"], "__p.share", "__p.value")
