"""Mixing sources to target weights, in DataFrame expressions only.

Documents get hash-random keys; within a source they lie in ranges of the key; a distributed prefix sum over the ranges says how many
words come before each; the mix takes a source's words up to its exact budget, whole passes (epochs) first, then the start of one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SALTS, SMALL, WORD, looked_up, running_before, stage

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null, so that it can be joined on, and in code point order with null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """``__src, source_size, target`` from ``__src, source_size``: all sizes' sum is shared by weight; where a share is above
    ``max_epochs`` times the source's size it stops there and the excess is shared again among the others, until none is above.

    In closed form: by ascending cap per weight, a source is capped while its cap is below the level that those left would get.
    One row per source; its windows span all sources, never documents.
    """
    rank = Window.orderBy("__src")
    by_cap = Window.orderBy("__ratio", "__src")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(rank) - 1) % len(weights)).cast("int") + 1)
    capped = sizes.withColumn("__w", weight).withColumn("__cap", F.lit(max_epochs) * F.col("source_size")).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0))) / F.sum("__w").over(after)
    stopped = capped.withColumn("__level", level).withColumn("__stop", F.col("__ratio") <= F.col("__level"))
    # Those that stop come first in this order; the first that doesn't sets the level of all the rest.
    open_level = F.min(F.when(~F.col("__stop"), F.struct("__ratio", "__src", "__level"))).over(everything)["__level"]
    target = F.when(F.col("__stop"), F.col("__cap").cast("double")).otherwise(F.col("__w") * open_level)
    return stopped.select("__src", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``.

    ``size`` counts the words of the whole text (null: 0); ``taken`` is how many words of the document the mix takes, repeats counted: each
    full epoch takes it whole, the last one up to the source's budget (its target, rounded), which may cut one document per source.
    Null sources are one source, the last. Null or repeated doc_ids are fine: keys come from the doc_id and the text, and rows that agree
    in both are interchangeable. Empty texts take nothing. An empty table gives an empty one. Other columns are not read.
    """
    sized = docs.select(
        F.col("doc_id"), source_key(F.col("source")).alias("__src"), n_words(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text").cast("string")).alias("__key"),
    )
    sized = stage(sized, "mix-sizes")
    goal = targets(sized.groupBy("__src").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    goal = stage(goal, "mix-targets").withColumn("__budget", F.round("target").cast("long"))
    goal = goal.withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(F.col("__budget") / F.col("source_size"))).otherwise(F.lit(0)))
    goal = goal.withColumn("__rest", F.col("__budget") - F.col("__epochs") * F.col("source_size"))
    placed = running_before(sized, "__src", "__key", [F.col("doc_id"), F.col("size")], F.col("size"), "__before")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - F.col("__before")))
    if goal.count() <= SMALL:  # one row per source, each of some 60 bytes
        joined = placed.join(F.broadcast(goal), "__src")
    else:
        joined = looked_up(placed.withColumn("salt", F.pmod("__key", F.lit(SALTS)).cast("int")), "__src", goal)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("__epochs") * F.col("size") + part).cast("long").alias("taken"), F.col("__key").alias("mix_key"), F.col("__src").alias("mix_source"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document once per epoch that takes it whole; where the budget ends inside one, it comes
    cut after the words taken, its line breaks kept (``n_chars``, where there is such a column, follows the text). Documents that the mix does not take go.

    Null and empty texts have no words and are never taken. Null sources are one source; null or repeated doc_ids are fine, and of rows equal in doc_id, text and
    source as many come back as the mix takes of them together. Very long texts are cut by an array of their words. An empty table gives an empty one.
    """
    taken = mix(docs, weights, max_epochs, seed).select(F.col("mix_key").alias("__key"), F.col("mix_source").alias("__src"), F.col("doc_id").alias("__id"), "size", "taken")
    # Rows of one key are copies of one document in one source; the n-th of them meets the n-th result.
    nth = Window.partitionBy("__key", "__src", "__id")
    taken = taken.withColumn("__n", F.row_number().over(nth.orderBy(F.desc("taken"))))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = own.withColumn("__key", F.xxhash64(F.lit(seed), F.col("row.doc_id"), F.col("row.text").cast("string"))).withColumn("__id", F.col("row.doc_id")).withColumn("__src", source_key(F.col("row.source")))
    own = own.withColumn("__n", F.row_number().over(nth.orderBy(F.xxhash64("row"))))
    same = (own["__key"] == taken["__key"]) & (own["__src"] == taken["__src"]) & own["__id"].eqNullSafe(taken["__id"]) & (own["__n"] == taken["__n"])
    joined = own.join(taken.filter("taken > 0").hint("merge"), same)
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    out = joined.select("row", F.explode(copies).alias("__cut"))
    # Each word with the white space before it: the first of them are the text's own beginning.
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("__cut") > 0, F.array_join(F.slice(words, 1, F.col("__cut")), "")).otherwise(F.col("row.text"))
    fields = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == "text":
            value = text
        elif c == "n_chars":
            value = F.when(F.col("__cut") > 0, F.length(text).cast(docs.schema[c].dataType)).otherwise(value)
        fields.append(value.alias(c))
    return out.select(*fields)
