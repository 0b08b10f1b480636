"""Quality rules, near-duplicates, source mixing and packing, one after the other over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import mixing, neardup, packing, quality
from panelwright.llm.common import read, stage
from panelwright.llm.tokens import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, unchanged. Null and empty texts have no words and go as too short; repeated rows are judged each; texts are read
    whole, however long; an empty table gives an empty one; other columns are carried along whatever their names."""
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five-word shingles, similarity of 0.8 or more), that with the smallest doc_id, null ids last. Null and
    empty texts are one text; rows equal in every column are one document; texts are read whole; an empty table gives an empty one; other columns are
    carried along."""
    return neardup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: each document once per epoch that takes it whole, and one per source cut where its budget ends. Null sources are
    one source; documents without words (null or empty) are never taken; repeated rows and null ids are fine; an empty table gives an empty one; other
    columns are carried along."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences. Null and empty texts are the end id alone; longer texts than a sequence are cut;
    repeated rows and null ids are packed each; an empty table gives an empty one; other columns are not read."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]
#: Signatures and byte-pair ids can't be said in SQL; ``tests/llm/test_pipeline.py`` holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of ``documents``, each stage written and read again. Nulls, empty and very long texts, ties and repeated rows as in the stages; an empty table gives an empty result."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
