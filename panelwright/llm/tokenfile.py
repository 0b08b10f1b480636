"""Token ids as Parquet list columns.

Rows lie in ascending doc_id order over files and row groups. Ids are dictionary-encoded (a vocabulary fits one dictionary page) or, beyond that,
delta-encoded by the version 2 writer; row groups and pages are small enough for the column and offset indexes to skip most of a file when
few documents are asked for, and the narrow columns can be read without the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, shuffles_freed, stage

LAYOUT = {
    "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20), "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000", "compression": "zstd",
}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """``doc_id, part, pos, n_tokens, ids`` below ``path``: in each part rows ascend by doc_id (nulls first, ties by text), parts ascend too.

    Null and empty texts are the end id alone. Every row is written, repeated ones too. Equal doc_ids are split over parts by their texts' hashes. A very long text is one list.
    An empty table gives files without rows; other columns are not read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import encoded

        part, pos = TaskContext.get().partitionId(), 0
        for batch, ids in encoded(batches, tokenizer, end_id):
            n = np.fromiter((len(b) // 4 for b in ids), dtype=np.int64, count=len(ids))
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            own = batch.column(batch.schema.get_field_index("doc_id"))
            places = pa.array(np.arange(pos, pos + len(ids), dtype=np.int64))
            pos += len(ids)
            yield pa.RecordBatch.from_arrays([own, pa.array([part] * len(ids), pa.int32()), places, pa.array(n), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "part", "pos", "n_tokens", "ids"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ordered = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("__h")).repartitionByRange("doc_id", "__h").sortWithinPartitions("doc_id", "__h")
    ordered.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, part int, pos long, n_tokens long, ids array<int>").write.options(**LAYOUT).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, part, pos, n_tokens, start`` from the narrow columns alone; ``start`` is the number of ids of all documents before."""
    narrow = spark.read.parquet(path).select("doc_id", "part", "pos", "n_tokens")
    return with_starts(narrow)


def with_starts(rows: DataFrame) -> DataFrame:
    """Parts' totals are summed over parts (one row each), the rest inside a part."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("__t")).select("part", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__s"))
    own = rows.withColumn("__b", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return own.join(parts.hint("merge"), "part").withColumn("start", F.col("__s") + F.col("__b")).drop("__s", "__b")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document, from its ids as read back."""
    stored = spark.read.parquet(path).select("doc_id", "part", "pos", "ids")
    id_type = stored.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(3)
            values, offsets = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "pos", "n_tokens", "ids_crc32"])

    narrow = stage(stored.mapInArrow(run, f"doc_id {id_type}, part int, pos long, n_tokens long, ids_crc32 long"), "token-digests")
    return with_starts(narrow).select("doc_id", "start", "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to a new folder of the shared one and return what ``digests`` reads back. An empty table gives an empty one."""
    spark = docs.sparkSession
    path = shared_dir(spark, "tokens")
    with shuffles_freed(spark):
        write_tokens(docs, path, tokenizer, end_id)
    return digests(spark, path)
