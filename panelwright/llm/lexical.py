"""Ranked lexical search by pipelined term partitioning.

Terms have owners, by how many documents hold them: the rarest terms' owner comes first. Items travel in bundles. A bundle meets each block of documents at every owner in
turn (a cogroup): it brings its sparse accumulators (document, item, score so far), the owner brings its postings of that block, and the owner's integer contributions are added.
What no longer can reach an item's best is left behind: between owners, each item's ``top``-th score so far (over all blocks) is a lower bound of its final one, and what the
remaining owners can add at most is known; an accumulator that falls short even so is dropped, which loses nothing. Ties stay. Bundles and blocks are of bounded size, so is a task.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SALTS, SMALL, looked_up, stage
from .words import slices_of

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
OWNERS = 4
#: Items of a bundle and documents of a block, on average; a task holds one of each.
BUNDLE, BLOCK = 128, 1024
#: Bits of the filter that a term's CRC-32 must pass before its posting leaves a task: a fixed 2 MB, whatever the number of items. Those that pass by chance are dropped by the join.
FILTER = 24
#: Bytes of a text that are counted at a time.
CUT = 1 << 20
NONE = (1 << 63) - 1


def term_counts(text: str) -> Counter:
    """How often each term (UTF-8, A-Z lower-cased) occurs in the text."""
    raw = text.encode("utf-8", "replace").lower()
    counts, at = Counter(), 0
    while at < len(raw):
        gap = GAP.search(raw, at + CUT) if len(raw) - at > CUT else None
        end = gap.start() if gap else len(raw)
        counts.update(TERM.findall(raw, at, end))
        at = end
    return counts


def _counted(only):
    """The texts' terms and their counts, ``n`` over all terms; only terms whose bit is set in ``only``, if given."""

    def run(batches):
        import zlib

        import pyarrow as pa

        crc = zlib.crc32
        for batch in slices_of(batches, "text"):
            n, terms, tfs = [], [], []
            for text in batch.column("text").to_pylist():
                counts = term_counts(text)
                n.append(sum(counts.values()))
                if only is not None:
                    counts = {t: c for t, c in counts.items() if only[(h := crc(t) & ((1 << FILTER) - 1)) >> 3] >> (h & 7) & 1}
                terms.append([t.decode("utf-8", "replace") for t in counts])
                tfs.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int64()))], names=["id", "n", "terms", "tfs"])

    return run


def _texts(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


_COUNTED = "id long, n long, terms array<string>, tfs array<long>"


def item_terms(items: DataFrame) -> DataFrame:
    """``item, item_id, bundle, term, q``: items are numbered as rows, so repeated ids are searched one by one."""
    rows = _texts(items, "item_id").mapInArrow(_counted(None), _COUNTED)
    rows = stage(rows.withColumn("item", F.monotonically_increasing_id()), "items")
    bundles = max(1, -(-rows.count() // BUNDLE))
    rows = rows.withColumn("bundle", F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int"))
    rows = rows.select("item", F.col("id").alias("item_id"), "bundle", F.explode(F.arrays_zip("terms", "tfs")).alias("z"))
    return stage(rows.select("item", "item_id", "bundle", F.col("z.terms").alias("term"), F.col("z.tfs").alias("q")), "item-terms")


def _term_filter(terms: DataFrame) -> bytes:
    """The set bits of the terms' CRC-32 modulo 2^``FILTER``, built in 4 KB pieces by the executors."""
    bit = F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit((1 << FILTER) - 1))
    pieces = terms.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("piece")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("bits"))
    out = bytearray(1 << (FILTER - 3))
    for piece, bits in pieces.collect():
        out[piece << 12 : (piece << 12) + len(bits)] = bits
    return bytes(out)


def weight(n_docs: int, df) -> F.Column:
    return F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * df + 1).cast("double"))).cast("long")


def _owner(top: int, last: bool):
    """What an owner does with one bundle at one block."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("bundle", pa.int32()), ("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("slots", pa.list_(pa.int32())), ("scores", pa.list_(pa.int64())), ("best", pa.list_(pa.struct([("slot", pa.int32()), ("score", pa.int64())])))])
        if not left.num_rows:
            return schema.empty_table()
        flat = lambda name: left.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        docs, ids, slots, scores = (flat(c) for c in ("docs", "ids", "slots", "scores"))
        terms, q_slots, q_weights, floor, rest = (flat(c) for c in ("terms", "q_slots", "q_weights", "floor", "rest"))
        p_doc, p_id, p_term, p_impact = (right.column(c).to_numpy() for c in ("doc", "doc_id", "term", "impact"))
        every, at = np.unique(np.concatenate([docs, p_doc]), return_inverse=True)
        doc_ids = np.zeros(len(every), dtype=np.int64)
        doc_ids[at] = np.concatenate([ids, p_id])
        acc = np.zeros((len(every), len(rest)), dtype=np.int64)
        acc[at[: len(docs)], slots] = scores
        by_term = np.argsort(p_term, kind="stable")
        p_at, p_term, p_impact = at[len(docs) :][by_term], p_term[by_term], p_impact[by_term]
        # A term is once in a document and once in an item, so no cell is met twice.
        order = np.argsort(terms, kind="stable")
        for t, of in zip(*_groups(terms[order], order)):
            a, b = np.searchsorted(p_term, t), np.searchsorted(p_term, t, side="right")
            if a < b:
                acc[np.ix_(p_at[a:b], q_slots[of])] += p_impact[a:b, None] * q_weights[of][None, :]
        alive = (acc > 0) & (acc + rest >= floor)
        d, s = np.nonzero(alive)
        value = acc[d, s]
        # Best first: by item, falling score, doc_id, row. The first ``top`` of each item.
        ranked = np.lexsort((every[d], doc_ids[d], -value, s))
        starts = np.searchsorted(s[ranked], np.arange(len(rest)))
        first = ranked[np.arange(len(ranked)) - starts[s[ranked]] < top]
        if last:
            d, s, value = d[first], s[first], value[first]
            first = np.arange(len(d))
        best = pa.StructArray.from_arrays([pa.array(s[first], pa.int32()), pa.array(value[first])], names=["slot", "score"])
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind) if kind else x)
        return pa.Table.from_arrays([left.column("bundle").slice(0, 1), left.column("block").slice(0, 1), one(every[d], pa.int64()), one(doc_ids[d], pa.int64()), one(s, pa.int32()), one(value, pa.int64()), one(best, None)], schema=schema)

    return run


def _groups(keys, values):
    import numpy as np

    cuts = np.flatnonzero(np.diff(keys)) + 1
    return keys[np.concatenate([[0], cuts]).astype(int)] if len(keys) else keys, np.split(values, cuts) if len(keys) else []


_ACCUMULATORS = "bundle int, block long, docs array<long>, ids array<long>, slots array<int>, scores array<long>, best array<struct<slot:int,score:long>>"


def search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: of each item the ``top`` documents with the highest scores above 0, ties to the smaller doc_id.

    Terms, weights and scores are as the query states them (integers but for the logarithm of a weight). Null and empty texts have no terms; a document without terms does not count. Null doc_ids
    come after all others at equal scores; rows that share a doc_id are documents of their own, as are items that share an id. Very long texts are counted in pieces. Empty tables give an empty one; other columns are not read.
    """
    asked = item_terms(items)
    only = _term_filter(asked.select("term").distinct())
    counted = stage(_texts(docs, "doc_id").mapInArrow(_counted(only), _COUNTED).filter("n > 0").withColumn("doc", F.monotonically_increasing_id()), "terms")
    n_docs, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = (100 - 75) + F.expr(f"(75 * n * {n_docs}L) div {max(total, 1)}L")
    blocks = max(1, -(-n_docs // BLOCK))
    met = counted.filter("size(terms) > 0").withColumn("m", m).select(F.coalesce("id", F.lit(NONE)).alias("doc_id"), "doc", "m", F.explode(F.arrays_zip("terms", "tfs")).alias("z"))
    met = met.select("doc", "doc_id", F.col("z.terms").alias("word"), F.expr("(1000000000L * z.tfs) div (1000L * z.tfs + 8L * m)").alias("impact"))
    # The vocabulary of the items with document counts and the largest impact: one row a term.
    held = met.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("most"))
    bundles = asked.groupBy("term").agg(F.collect_set("bundle").alias("bundles"))
    known = bundles.join(held.withColumnRenamed("word", "term").hint("merge"), "term")
    owner = F.when(256 * F.col("df") <= n_docs, 0).when(16 * F.col("df") <= n_docs, 1).when(4 * F.col("df") <= n_docs, 2).otherwise(OWNERS - 1)
    vocabulary = stage(known.select(F.col("term").alias("word"), F.monotonically_increasing_id().alias("term"), owner.alias("owner"), weight(n_docs, F.col("df")).alias("w"), "most", "bundles"), "vocabulary")
    # Items' terms with weights; what each owner can add to an item at most.
    queries = asked.withColumnRenamed("term", "word").join(vocabulary.drop("bundles").hint("merge"), "word").withColumn("qw", F.col("q") * F.col("w"))
    # Slots number the items of a bundle without gaps; those without a known term have none.
    queries = queries.withColumn("slot", F.dense_rank().over(Window.partitionBy("bundle").orderBy("item")) - 1)
    queries = stage(queries.select("item_id", "bundle", "slot", "term", "owner", "qw", (F.col("qw") * F.col("most")).alias("most")), "queries")
    # Postings in order of owner, written once.
    words = vocabulary.select("word", "term", "owner", "bundles")
    if (vocabulary.agg(F.sum(F.size("bundles"))).first()[0] or 0) <= SMALL:
        found = met.join(F.broadcast(words), "word")
    else:
        found = looked_up(met.withColumn("salt", F.pmod("doc", F.lit(SALTS))), "word", words.hint("merge"))
    postings = stage(found.select("owner", "term", F.explode("bundles").alias("bundle"), F.pmod(F.xxhash64("doc"), F.lit(blocks)).alias("block"), "doc", "doc_id", "impact"), "postings")
    sizes = queries.groupBy("bundle").agg(F.max("slot").alias("slots"))
    state = None
    for k in range(OWNERS):
        floors = _floors(state, queries, top)
        # A bundle's own list for this owner, and per slot what later owners can add and the score to reach.
        own = queries.filter(F.col("owner") == k).groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("term", "slot", "qw"))).alias("own"))
        later = queries.groupBy("bundle", "slot").agg(F.sum(F.when(F.col("owner") > k, F.col("most")).otherwise(0)).alias("rest"))
        later = later.join(floors.hint("merge"), ["bundle", "slot"], "left").groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("slot", "rest", F.coalesce("floor", F.lit(0)).alias("floor")))).alias("bounds"))
        lists = stage(sizes.join(later.hint("merge"), "bundle").join(own.hint("merge"), "bundle", "left"), "lists")
        state = stage(_visit(state, lists, postings.filter(F.col("owner") == k), blocks, top, k == OWNERS - 1), "accumulators")
    entries = state.select("bundle", F.explode(F.arrays_zip("docs", "ids", "slots", "scores")).alias("z")).select("bundle", F.col("z.slots").alias("slot"), F.col("z.docs").alias("doc"), F.col("z.ids").alias("doc_id"), F.col("z.scores").alias("score"))
    place = F.row_number().over(Window.partitionBy("bundle", "slot").orderBy(F.desc("score"), "doc_id", "doc"))
    names = queries.select("bundle", "slot", "item_id").distinct()
    ranked = entries.withColumn("rank", place).filter(F.col("rank") <= top).join(names.hint("merge"), ["bundle", "slot"])
    return ranked.select("item_id", "rank", F.nullif("doc_id", F.lit(NONE)).alias("doc_id"), "score")


def _floors(state: DataFrame | None, queries: DataFrame, top: int) -> DataFrame:
    """``bundle, slot, floor``: the ``top``-th best score so far, where there are as many; no final one is lower."""
    if state is None:
        return queries.select("bundle", "slot", F.lit(0).cast("long").alias("floor")).limit(0)
    best = state.select("bundle", F.explode("best").alias("b")).select("bundle", "b.slot", "b.score")
    place = F.row_number().over(Window.partitionBy("bundle", "slot").orderBy(F.desc("score")))
    return best.withColumn("place", place).filter(F.col("place") <= top).filter(F.col("place") == top).select("bundle", "slot", F.col("score").alias("floor"))


def _visit(state: DataFrame | None, lists: DataFrame, postings: DataFrame, blocks: int, top: int, last: bool) -> DataFrame:
    """All bundles at one owner: each block's accumulators and the bundle's list meet the owner's postings of that block."""
    zero = lambda name, kind: F.array().cast(f"array<{kind}>").alias(name)
    carried = [F.col("own.term").alias("terms"), F.col("own.slot").alias("q_slots"), F.col("own.qw").alias("q_weights"), F.col("bounds.floor").alias("floor"), F.col("bounds.rest").alias("rest")]
    plain = lists.withColumn("own", F.coalesce("own", F.array().cast(lists.schema["own"].dataType)))
    every = plain.select("bundle", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), *carried)
    if state is None:
        left = every.select("*", zero("docs", "long"), zero("ids", "long"), zero("slots", "int"), zero("scores", "long"))
    else:
        left = every.join(state.drop("best").hint("merge"), ["bundle", "block"], "left")
        left = left.withColumns({c: F.coalesce(c, F.array().cast(left.schema[c].dataType)) for c in ("docs", "ids", "slots", "scores")})
    met = left.groupBy("bundle", "block").cogroup(postings.select("bundle", "block", "term", "doc", "doc_id", "impact").groupBy("bundle", "block"))
    return met.applyInArrow(_owner(top, last), _ACCUMULATORS)
