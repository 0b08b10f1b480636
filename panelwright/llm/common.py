"""What the operators of this subpackage share: table access, the shared folder, distributed numbering."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space separates words; everything else belongs to one.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the given folder. Python workers started from now on find this package where the driver has it (a cluster may ship it with --py-files)."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Only a local master may leave that unset; a temporary one is made then."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark, "_llm_shared_dir", None)
        if base is None:
            base = spark._llm_shared_dir = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """What runs inside lets go of its shuffle files when it ends, not when the driver's memory is next collected; for jobs whose result is written or returned, so that none is read twice."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def stage(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors, and gives the planner true sizes."""
    path = shared_dir(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` computed once: a projection would be merged back into each use."""
    return F.transform(F.array(value), body)[0]


SALTS = 64
#: Rows of a narrow table that may be broadcast; its size is counted first, and a larger one is joined otherwise.
SMALL = 200_000


def looked_up(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``rows`` (with a column ``salt`` below ``SALTS``) joined with the one row of ``table`` for their ``key``, however many share it: the table's rows
    first go to the distinct (key, salt), then to the rows."""
    spread = rows.select(key, "salt").distinct().join(table.hint("merge"), key)
    return rows.join(spread.hint("merge"), [key, "salt"])


def hash_bucket(hashed: Column, buckets: int) -> Column:
    """The range of the unsigned order of ``hashed`` (long) that it lies in, 0 to ``buckets`` - 1."""
    return F.shiftright(F.shiftrightunsigned(hashed, 33) * F.lit(int(buckets)), 31)


def unsigned_order(hashed: Column) -> Column:
    """A long that sorts as ``hashed`` does when read without sign."""
    return hashed.bitwiseXOR(F.lit(-(1 << 63)))


def running_before(df: DataFrame, group: str, hashed: str, ties: list[Column], value: Column, out: str, rows_per_bucket: int = 20_000) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of ``group`` that come earlier in hash order.

    A distributed prefix sum. Each group is cut into ranges of the hash, as many as the row count asks for, so a group with a third
    of all rows is spread like any other. Range totals are summed by a window over ranges (one row each), the rest inside a range.
    ``group`` must not be null. ``df`` is used twice; it should be cheap to read again.
    """
    total = df.count()
    buckets = min(1 << 24, max(8, -(-total // rows_per_bucket)))
    df = df.withColumn("__b", hash_bucket(F.col(hashed), buckets)).withColumn("__v", value)
    earlier = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(group, "__b").orderBy(unsigned_order(F.col(hashed)), *ties).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(group, "__b").agg(F.sum("__v").alias("__t")).withColumn("__s", F.coalesce(F.sum("__t").over(earlier), F.lit(0))).drop("__t")
    return (
        df.withColumn(out, F.coalesce(F.sum("__v").over(inside), F.lit(0)))
        .join(starts.hint("merge"), [group, "__b"])
        .withColumn(out, F.col(out) + F.col("__s"))
        .drop("__b", "__v", "__s")
    )
