"""Rendezvous hashing over weighted shards, in DataFrame expressions only.

Each key gives every shard a score from a hash of key and shard; the highest score has the key. With u uniform on (0, 1) from the hash, the score
-weight / ln(u) makes a shard's share proportional to its weight, and a new shard can only take keys for itself.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_before, stage


def shard_of(key: Column, weights: Mapping[int, float], seed: int = 11) -> Column:
    """The shard (int) of ``key`` (long, not null). Ties, which need equal hashes, go to the greater shard number."""

    def score(shard: int, weight: float) -> Column:
        h = F.xxhash64(F.lit(seed), F.lit(int(shard)), key)
        u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * (1.0 / (1 << 53))
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("s"), F.lit(int(shard)).alias("shard"))

    scores = [score(s, w) for s, w in weights.items() if w > 0]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def assign(docs: DataFrame, shards: int | Mapping[int, float] = 16, seed: int = 11) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size``: UTF-8 bytes of the text (null: none) plus 1. ``law`` is ``key``: doc_id and the shards alone decide, so equal doc_ids share
    a shard; null doc_ids count as one key. ``slot`` numbers a shard's rows without gaps from 0, by a distributed prefix count.
    ``grown_shard`` is the shard with one more of the mean weight. Ties and repeated rows get different slots. Empty texts have size 1, very long ones are read whole;
    other columns are not read. An empty table gives an empty one.
    """
    weights = dict(shards) if isinstance(shards, Mapping) else {i: 1.0 for i in range(shards)}
    grown = weights | {max(weights) + 1: sum(weights.values()) / len(weights)}
    text = F.col("text").cast("string")
    key = F.coalesce(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(0))
    raw = F.coalesce(text, F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), key.alias("__key"))
    slim = slim.withColumn("shard", shard_of(F.col("__key"), weights, seed)).withColumn("grown_shard", shard_of(F.col("__key"), grown, seed))
    # Rows of one doc_id share the shard but not the place: the text's digest and size order them, rows that agree in both are alike.
    slim = slim.withColumn("__order", F.xxhash64(F.lit(seed + 1), "__key", "text_crc32", "size"))
    placed = running_before(stage(slim, "shards"), "shard", "__order", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.lit(1).cast("long"), "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
