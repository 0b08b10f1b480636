"""Panels (long tables symbol, sector, bar_ts, idx, close, volume ...) from the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def indexed(panel: DataFrame) -> DataFrame:
    """Adds ``idx``, the bar's number from 0 within its symbol."""
    return panel.withColumn("idx", F.row_number().over(Window.partitionBy("symbol").orderBy("bar_ts")) - 1)


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as symbols, regions as sectors, weeks as bars; close is the volume-weighted price in whole cents, rounded down."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    # Summed per supplier and week before the dimensions join.
    weekly = items.groupBy("l_suppkey", F.to_date(F.date_trunc("week", "l_shipdate")).alias("bar_ts")).agg(F.sum("l_extendedprice").alias("v"), F.sum("l_quantity").alias("q"))
    joined = weekly.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    joined = joined.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    joined = joined.join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    bars = joined.groupBy(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"), "bar_ts").agg((F.floor(F.round(F.sum("v") * 100) / F.sum("q")) / 100).alias("close"), F.sum("q").alias("volume"))
    return indexed(bars)


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OHLCV by event type and hour; ties in time go by event_id."""
    ev = table(spark, sf_dir, "events").filter("value is not null")
    at = F.struct("ts", "event_id")
    bars = ev.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("bar_ts")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume")
    )
    return indexed(bars)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger: line items as fills, summed by account (supplier), symbol (part number mod 20), day and side (returns sell)."""
    items = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_suppkey").alias("account"), F.concat(F.lit("S"), (F.col("l_partkey") % 20).cast("string")).alias("symbol"), F.col("l_shipdate").cast("date").alias("filled_at"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side")]
    out = items.groupBy(*keys).agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("value"), F.sum("l_tax").alias("commission"))
    return out.withColumn("price", F.col("value") / F.col("quantity"))


def read_bars_csv(spark: SparkSession, folder: str, name: str = r"([^/]+)\.csv$") -> DataFrame:
    """CSV files by symbol (date, Open, High, Low, Close, Volume); ``name`` finds the symbol in a file's path, by default its name. Rows without a close are left out."""
    schema = "bar_ts date, open double, high double, low double, close double, volume double"
    raw = spark.read.schema(schema).csv(folder, header=True, enforceSchema=True).withColumn("symbol", F.regexp_extract(F.input_file_name(), name, 1))
    return indexed(raw.filter("close is not null"))


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """A matrix of dates by tickers as ``symbol, bar_ts, close``; empty cells are left out."""
    raw = spark.read.csv(path, header=True, inferSchema=True)
    date, *names = raw.columns
    return raw.select(F.col(date).cast("date").alias("bar_ts"), *[F.col(f"`{n}`").cast("double").alias(n) for n in names]).unpivot("bar_ts", [F.col(f"`{n}`") for n in names], "symbol", "close").filter("close is not null")


def vendor_bars(raw: DataFrame) -> DataFrame:
    """Bars stamped in UTC milliseconds (symbol, timestamp_ms, seq, open ...) by date; of several on one date the last by ``seq`` stays."""
    day = F.to_date(F.timestamp_millis("timestamp_ms"))
    last = raw.withColumn("bar_ts", day).groupBy("symbol", "bar_ts").agg(F.max_by(F.struct(*[c for c in raw.columns if c != "symbol"]), F.struct("seq", "timestamp_ms")).alias("r"))
    return last.select("symbol", "bar_ts", "r.*").drop("timestamp_ms", "seq")
