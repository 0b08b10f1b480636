"""Tables with stored upserts and deletes: keys lie in hash buckets, a change rewrites the buckets it touches into a new folder, and a manifest published last says which folder each bucket is read from.

A reader sees the version before or the one after, never a mixture, and a failure before the manifest leaves the table as it was. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "bucket int, folder string, version long"


class Versioned:
    """A table below ``path`` with one row for each value of ``keys``; ``bucket_by`` (default: the keys) decides a row's bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], bucket_by: list[str] | None = None, buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.bucket_by, self.buckets = spark, path, schema, keys, bucket_by or keys, buckets
        self._rows([(-1, "", 0)]).write.mode("ignore").partitionBy("version").parquet(f"{path}/manifest")

    def _rows(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, MANIFEST).coalesce(1)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").agg(F.max("version")).first()[0]

    def _folders(self, version: int | None) -> dict[int, str]:
        """Of each bucket that has rows, its folder: at most ``buckets`` of them."""
        at = self.version() if version is None else version
        found = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").filter((F.col("version") == at) & (F.col("bucket") >= 0))
        return {r.bucket: r.folder for r in found.collect()}

    def _read(self, folders: dict[int, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(folders.items())])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the latest version, or of an earlier one."""
        return self._read(self._folders(version))

    def _publish(self, folders: dict[int, str], version: int) -> None:
        """One file in a new folder: it is there or it isn't."""
        self._rows([(-1, "", version), *[(b, f, version) for b, f in folders.items()]]).write.mode("append").partitionBy("version").parquet(f"{self.path}/manifest")

    def _rewrite(self, touched: DataFrame, made) -> None:
        """The buckets of ``touched`` become ``made(their rows now)``; others are not read."""
        version, folders = self.version(), self._folders(None)
        hit = [r[0] for r in touched.select(self._bucket().alias("b")).distinct().collect()]
        if not hit:
            return
        rows, new = made(self._read({b: folders[b] for b in hit if b in folders})), uuid.uuid4().hex
        rows.select(*self.schema.names).withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{new}")
        # A bucket whose rows are all gone has no folder.
        filled = {r[0] for r in self.spark.read.schema("bucket int").option("basePath", f"{self.path}/data/{new}").parquet(f"{self.path}/data/{new}").distinct().collect()}
        self._publish({b: f for b, f in folders.items() if b not in hit} | dict.fromkeys(filled, new), version + 1)

    def upsert(self, changes: DataFrame, newest: str | None = None, deleted: str | None = None) -> None:
        """Rows of ``changes`` are inserted or replace those of their keys. With ``newest`` the greater value of that column wins, a stored row included (ties: the change); ``deleted`` names a boolean column of ``changes`` whose true rows remove their key."""
        flag = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        new = changes.select(*self.schema.names, flag.alias("__gone"), F.lit(1).alias("__new"))
        order = F.struct(*([newest] if newest else []), "__new", "__all")

        def made(old):
            both = old.withColumns({"__gone": F.lit(False), "__new": F.lit(0)}).unionByName(new).withColumn("__all", F.struct(*self.schema.names))
            kept = both.groupBy(*self.keys).agg(F.max_by(F.struct("__all", "__gone"), order).alias("r"))
            return kept.filter("not r.__gone").select("r.__all.*")

        self._rewrite(changes, made)

    def replace(self, rows: DataFrame, groups: DataFrame) -> None:
        """Of each value of ``bucket_by`` in ``groups`` the table holds exactly the given rows afterwards, none if there are none; others stay as they are. ``rows`` of no such group are not taken."""
        scope = groups.select(*self.bucket_by).distinct()
        made = lambda old: old.join(scope.hint("merge"), self.bucket_by, "left_anti").unionByName(rows.select(*self.schema.names).join(scope.hint("merge"), self.bucket_by, "left_semi"))
        self._rewrite(scope, made)


def sync_snapshot(table: Versioned, rows: DataFrame, reported: DataFrame, held: str = "shares", closed: float = 1e-6) -> None:
    """Of every group (account) in ``reported`` the snapshot becomes ``rows``, positions within ``closed`` of none left out: what is not among them is deleted, all of a group that has closed."""
    table.replace(rows.filter(F.abs(held) > closed), reported)
