"""Folders that driver and executors share, and what is kept there: panels by key, ledgers, snapshots, result files."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Only a local master may leave that unset; a temporary one is made then."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="panelwright-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new shared folder and read back: computed once however often it is used, and of known size."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def panel_key(universe: list[str], start: str, end: str, provider: str) -> str:
    """The key of a cached panel: universe in order of name, range and provider."""
    return hashlib.sha256("|".join([*sorted(universe), start, end, provider]).encode()).hexdigest()


def cache_panel(panel: DataFrame, folder: str, key: str, form: str = "parquet") -> str:
    """Writes ``panel`` below ``folder`` by symbol, unless that key is there already; its path."""
    path = f"{folder}/{key}.{form}"
    panel.write.mode("ignore").partitionBy("symbol").options(**({"header": "true"} if form == "csv" else {})).format(form).save(path)
    return path


def cached_panel(spark: SparkSession, path: str, schema) -> DataFrame:
    form = path.rsplit(".", 1)[-1]
    reader = spark.read.schema(schema).format(form)
    return (reader.option("header", "true") if form == "csv" else reader).load(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``symbol, event_date, kind, factor`` from JSON files that map a symbol to a list of its corporate actions."""
    text = spark.read.text(path, wholetext=True)
    actions = F.from_json("value", "map<string,array<struct<date:string,type:string,adjustment_factor:double>>>")
    one = text.select(F.explode(actions).alias("symbol", "events")).select("symbol", F.explode("events").alias("e"))
    return one.select("symbol", F.to_date("e.date").alias("event_date"), F.col("e.type").alias("kind"), F.col("e.adjustment_factor").alias("factor"))


def append(rows: DataFrame, path: str) -> None:
    """A ledger only grows."""
    rows.write.mode("append").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def write_nested(rows: DataFrame, keys: list[str], path: str, name: str = "rows") -> None:
    """One JSON object per key, the other columns as an array of objects below ``name``."""
    own = F.struct(*[c for c in rows.columns if c not in keys])
    rows.groupBy(*keys).agg(F.sort_array(F.collect_list(own)).alias(name)).write.mode("overwrite").json(path)


def write_run(runs: DataFrame, issues: DataFrame, path: str) -> None:
    append(runs, f"{path}/runs"), append(issues, f"{path}/issues")


def read_runs(spark: SparkSession, path: str, run: str) -> DataFrame:
    """Every run with its issues as one nested, sorted array, empty where it has none."""
    issues = spark.read.parquet(f"{path}/issues")
    own = F.struct(*[c for c in issues.columns if c != run])
    nested = issues.groupBy(run).agg(F.sort_array(F.collect_list(own)).alias("issues"))
    return spark.read.parquet(f"{path}/runs").join(nested, run, "left").withColumn("issues", F.coalesce("issues", F.array().cast(nested.schema["issues"].dataType)))


def uniform(*parts) -> F.Column:
    """A number in (0, 1) that is a function of ``parts`` alone, the same in every engine that has MD5."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, F.Column) else F.lit(p) for p in parts]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def normal(*parts) -> F.Column:
    """Standard normal by Box and Muller from two such numbers."""
    return F.sqrt(-2 * F.ln(uniform(*parts, "a"))) * F.cos(2 * F.pi() * uniform(*parts, "b"))


def random_walk(grid: DataFrame, mean: float = 0.0005, sd: float = 0.02) -> DataFrame:
    """``symbol, bar_ts, close``: 100 exp of the running sum of normal steps, seeded by the symbol's name, on the bars of ``grid``."""
    from ..operators.windows import so_far

    step = mean + sd * normal(F.col("symbol"), F.col("bar_ts"))
    return grid.withColumn("step", step).select("symbol", "bar_ts", (100 * F.exp(F.sum("step").over(so_far()))).alias("close"))


def sector_walk(grid: DataFrame, market: float = 0.01, sector: float = 0.008, own: float = 0.015) -> DataFrame:
    """``symbol, sector, bar_ts, close, volume``: a step is a market, a sector and an own factor; volume is 1000 to 2000."""
    from ..operators.windows import so_far

    step = market * normal(F.lit("market"), F.col("bar_ts")) + sector * normal(F.col("sector"), F.col("bar_ts")) + own * normal(F.col("symbol"), F.col("bar_ts"))
    volume = F.floor(1000 + 1000 * uniform(F.col("symbol"), F.col("bar_ts"), "volume"))
    return grid.withColumn("step", step).select("symbol", "sector", "bar_ts", (100 * F.exp(F.sum("step").over(so_far()))).alias("close"), volume.alias("volume"))
