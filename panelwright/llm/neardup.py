"""Near-duplicates of whole texts: ProbMinHash signatures, banding, exact verification, classes by connected components.

Equal texts are one text from the start. A text's distinct five-word shingles, weighted by 1 + ln(count), run Poisson processes: every arrival hits one of the
signature's components, which keeps the earliest. Two signatures agree in a component with the probability Jaccard similarity
of the weighted sets, which for equal weights is the Jaccard similarity. A text stops drawing once no arrival to come can be the earliest anywhere.

Texts that agree in a band share a bucket. Instead of all pairs of a bucket, its members are compared with one pivot, the member that shares most buckets, so
that most copies are linked through what they were copied from. The similarity that links is the one that the signatures estimate, the probability Jaccard similarity of the same weights; as
the collision rate of a hash its distance is a metric: two members whose distances from the pivot differ by more than the largest distance of a link cannot be
linked. Pairs of one pivot that this leaves open, at least one of them not linked to the pivot, are first compared by sketch (four bits of each component): pairs whose
estimated similarity lies more than four standard errors below the threshold go no further, which loses one in 30,000 of the links at the very threshold and
fewer above it. The others are verified inside the join where no shingle of either text repeats, and after it where one does. No bucket is capped.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, SMALL, looked_up, stage
from .words import mix, slices, word_hashes

BANDS, ROWS = 24, 5
SHINGLE = 5
#: Members of a pivot, or rows of a text or class, that one task takes at a time: larger groups are split.
PART = 1000
#: Shingles whose arrivals are drawn at a time.
DRAWN = 100_000


def shingle_hashes(texts: list[str], size: int = SHINGLE):
    """(hash, row) arrays of all shingles of all texts, in order; a shorter text's only shingle is the whole of it; a text without words has none."""
    import numpy as np

    h, rows = word_hashes(texts)
    factor = np.uint64(0x9E3779B97F4A7C15)
    n = max(0, len(h) - size + 1)
    acc = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        acc = acc * factor + h[k : k + n]
    inside = rows[:n] == rows[size - 1 :] if n else np.zeros(0, dtype=bool)
    hashes, where = [acc[inside]], [rows[:n][inside]]
    counts = np.bincount(rows, minlength=len(texts))
    first = np.cumsum(counts) - counts
    for r in np.flatnonzero((counts > 0) & (counts < size)):
        whole = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in h[first[r] : first[r] + counts[r]]:
                whole = whole * factor + x
        hashes.append(np.array([whole], dtype=np.uint64)), where.append(np.array([r], dtype=np.int64))
    return mix(np.concatenate(hashes)), np.concatenate(where)


def weighted_sets(hashes, rows):
    """Distinct (hash, row) with the weight 1 + ln(count)."""
    import numpy as np

    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(h)))
    return h[at], r[at], 1.0 + np.log(n)


def prob_minhash(hashes, rows, weights, n_rows: int, size: int):
    """(n_rows, size) signatures of the weighted sets; 0 throughout for an empty set. Elements are drawn some at a time, so a long text's later ones mostly end with their first arrival."""
    import numpy as np

    earliest = np.full((n_rows, size), np.inf)
    winner = np.zeros((n_rows, size), dtype=np.uint64)
    flat_t, flat_w = earliest.reshape(-1), winner.reshape(-1)
    for at in range(0, len(hashes), DRAWN):
        h, r, w = hashes[at : at + DRAWN], rows[at : at + DRAWN], weights[at : at + DRAWN]
        t, k = np.zeros(len(h)), 0
        while len(h):
            k += 1
            draw = mix(h + np.uint64((k * 0x632BE59BD9B4E019) % (1 << 64)))
            t = t - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
            cell = r * size + (mix(draw ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(size)).astype(np.int64)
            np.minimum.at(flat_t, cell, t)
            won = flat_t[cell] == t
            flat_w[cell[won]] = h[won]
            alive = t < earliest.max(axis=1)[r]  # else every later arrival is too late for any component
            h, r, w, t = h[alive], r[alive], w[alive], t[alive]
    return winner


def signatures(texts: list[str], size: int = BANDS * ROWS):
    h, r, w = weighted_sets(*shingle_hashes(texts))
    return prob_minhash(h, r, w, len(texts), size)


def band_keys(signature, bands: int = BANDS):
    """(n, bands) bucket keys, the band's number hashed in."""
    import numpy as np

    n, size = signature.shape
    s = signature.reshape(n, bands, size // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, bands)).copy()
    for k in range(s.shape[2]):
        key = mix(key ^ s[:, :, k]) + np.uint64(k)
    return mix(key).view(np.int64)


def weighted_set(text: str):
    h, _, w = weighted_sets(*shingle_hashes([text]))
    return h, w


def similarity(a, b) -> float:
    """Probability Jaccard of two weighted sets (sorted hashes, weights): over the common elements i, the sum of 1 / sum over all j of max(x_j / x_i, y_j / y_i).

    Sorted by x / y, each inner sum is a tail of x and a head of y. Where all weights are equal it is the Jaccard similarity.
    """
    import numpy as np

    (x, wx), (y, wy) = a, b
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if wx.max() == wx.min() and wy.max() == wy.min():
        return len(both) / (len(x) + len(y) - len(both))
    order = np.argsort(wx[i] / wy[j], kind="stable")
    p, q = wx[i][order], wy[j][order]
    tail = np.cumsum(p[::-1])[::-1] + (wx.sum() - p.sum())
    head = np.cumsum(q) - q + (wy.sum() - q.sum())
    return float((1.0 / (tail / p + head / q)).sum())


def jaccard(a: str, b: str) -> float:
    """Probability Jaccard similarity of two texts' weighted five-word shingles."""
    return similarity(weighted_set(a), weighted_set(b))


def sketches(signature):
    """(n, words) 64-bit words of four bits of each component; the last word is filled up with zeros."""
    import numpy as np

    n, size = signature.shape
    nibbles = np.zeros((n, -(-size // 16) * 16), dtype=np.uint64)
    nibbles[:, :size] = mix(signature) & np.uint64(15)
    return np.bitwise_or.reduce(nibbles.reshape(n, -1, 16) << np.arange(0, 64, 4, dtype=np.uint64), axis=2).view(np.int64)


def mismatches(x, y, words: int):
    """In how many components two sketches (array<long> columns) differ."""
    total = None
    for i in range(words):
        z = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = F.bit_count(z) if total is None else total + F.bit_count(z)
    return total


def most_mismatches(threshold: float, size: int, errors: float = 4.0) -> int:
    """Of two texts of similarity ``threshold``, but for ``errors`` standard errors. Differing components agree in four bits once in 16 times."""
    least = threshold - errors * math.sqrt(threshold * (1 - threshold) / size)
    return math.ceil((1 - least) * size * 15 / 16)


def banded(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``tkey, keys, sketch`` of each row's text: keys is empty for a text without words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, n in slices(batch.column(1)):
                part = batch.slice(at, n)
                texts = part.column(1).to_pylist()
                signed = signatures(texts, bands * rows)
                keys, sketch = band_keys(signed, bands), list(sketches(signed))
                lists = [k if t.split() or t.encode("utf-8", "replace").split() else [] for k, t in zip(keys, texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], names=["tkey", "keys", "sketch"])

    return docs.select("tkey", "text").mapInArrow(run, "tkey binary, keys array<long>, sketch array<long>")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, sim`` of the distinct pairs ``a, b`` of text keys, from whole texts (``tkey, text``, one row per key). An ``a`` with many partners is split; its text is repeated for each part."""

    def run(batches):
        import pyarrow as pa

        last, seen = None, None
        for batch in batches:
            sims = []
            for a, x, y in zip(batch.column(0), batch.column(2), batch.column(3)):
                if a != last:  # sorted by a: a pivot's partners follow each other
                    last, seen = a, weighted_set(x.as_py())
                sims.append(similarity(seen, weighted_set(y.as_py())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    left = texts.select(F.col("tkey").alias("a"), F.col("text").alias("ta")).join(parts.hint("merge"), "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = pairs.join(parts.hint("merge"), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    right = texts.select(F.col("tkey").alias("b"), F.col("text").alias("tb"))
    with_b = split.select("a", "b", "part").join(right.hint("merge"), "b")
    joined = with_b.join(left.select("a", "part", "ta").hint("merge"), ["a", "part"]).select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, "a binary, b binary, sim double")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the smallest node reachable over ``links``, for every node that has one. Labels spread to neighbours and jump to their own
    label's label each round, so rounds grow with the logarithm of a chain's length; only row counts reach the driver.

    A hub's label goes to its neighbours by salt, and the labels that have moved themselves are broadcast up to a counted size, so neither a hub nor a large class meets in one task."""
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct()
    edges = stage(both.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")), "edges")
    hubs = stage(edges.select("y", "salt").distinct(), "hubs")
    labels = stage(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")).withColumnRenamed("x", "node"), "labels")
    while True:
        far = hubs.join(labels.select(F.col("node").alias("y"), "root").hint("merge"), "y")
        seen = edges.join(far.hint("merge"), ["y", "salt"]).select(F.col("x").alias("node"), "root")
        best = labels.unionByName(seen).groupBy("node").agg(F.min("root").alias("root"))
        jump = labels.filter("node != root").select(F.col("node").alias("root"), F.col("root").alias("further"))
        # Only labels that are some node's root can be asked for; most of those are their own.
        jump = stage(jump.join(labels.select("root").distinct().hint("merge"), "root", "left_semi"), "jumps")
        jump = F.broadcast(jump) if jump.count() <= SMALL else jump.hint("merge")
        after = best.join(jump, "root", "left").select("node", F.least("root", F.coalesce("further", "root")).alias("root"))
        new = stage(after.join(labels.withColumnRenamed("root", "was").hint("merge"), "node").select("node", "root", (F.col("root") != F.col("was")).alias("moved")), "labels")
        labels = new.select("node", "root")
        if new.filter("moved").limit(1).count() == 0:
            return labels


def links(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``a, b, sim``: pairs of different texts (``tkey, text`` of ``docs``; repeated keys are one text) with a similarity of ``threshold`` or more, enough of
    them to connect the classes: two texts that are both linked to their pivot are not compared."""
    keyed = stage(banded(docs, bands, rows).dropDuplicates(["tkey"]), "bands")
    flat = keyed.select("tkey", F.explode("keys").alias("key"))
    shared = flat.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stage(flat.join(shared.hint("merge"), "key"), "buckets")
    degree = members.groupBy("tkey").agg(F.sum(F.col("n") - 1).alias("degree"))
    ranked = members.join(degree.hint("merge"), "tkey")
    pivot = ranked.groupBy("key").agg(F.max(F.struct("degree", "tkey")).alias("p")).select("key", F.col("p.tkey").alias("pivot"))
    members = stage(members.join(pivot.hint("merge"), "key").select("key", "tkey", "pivot"), "pivots")
    wanted = members.select("tkey").distinct()
    # Copies are merged before the shuffle, which the join then shares.
    texts = docs.select("tkey", "text").dropDuplicates(["tkey"]).join(wanted.hint("merge"), "tkey", "left_semi")
    texts = stage(texts, "candidate-texts")
    first = members.filter("tkey != pivot").select(F.col("pivot").alias("a"), F.col("tkey").alias("b")).distinct()
    first = stage(verify(first, texts), "pivot-sims")
    # What the pivots leave open, by pivot.
    most = 1.0 - threshold + 1e-9
    placed = first.select(F.col("a").alias("p"), F.col("b").alias("tkey"), (1 - F.col("sim")).alias("d"))
    left_over = placed.filter(F.col("d") > most).select("p").distinct()
    placed = stage(placed.join(left_over.hint("merge"), "p", "left_semi"), "placed")
    asked = placed.select(F.col("tkey").alias("k")).distinct()
    sets = stage(shingle_sets(texts.join(asked.hint("merge"), texts["tkey"] == asked["k"], "left_semi")), "sets")
    placed = placed.join(keyed.select("tkey", "sketch").hint("merge"), "tkey").join(sets.hint("merge"), "tkey")
    side = lambda x: [F.col("tkey").alias(x), F.col("d").alias(f"d{x}"), F.col("sketch").alias(f"s{x}"), F.col("set").alias(f"x{x}"), F.col("plain").alias(f"p{x}")]
    alone = placed.filter(F.col("d") > most).select("p", *side("a"))
    other = placed.select(F.col("p").alias("p2"), *side("b"))
    # A pivot with many open members is split; its members are repeated for each part.
    parts = alone.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / 128).cast("int").alias("parts"))
    alone = alone.join(parts.hint("merge"), "p").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    other = other.join(parts.withColumnRenamed("p", "p2").hint("merge"), "p2").withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    near = (F.abs(F.col("da") - F.col("db")) <= most) & (F.col("a") != F.col("b")) & ((F.col("db") <= most) | (F.col("a") < F.col("b")))
    alike = mismatches(F.col("sa"), F.col("sb"), -(-bands * rows // 16)) <= most_mismatches(threshold, bands * rows)
    both = F.size(F.array_intersect("xa", "xb"))
    sizes = F.size("xa") + F.size("xb")
    plain = F.col("pa") & F.col("pb")  # no weights but 1: the similarity is that of the sets
    linked = ~plain | (both * (1 + threshold) >= threshold * sizes - 1e-9)
    second = alone.join(other.hint("merge"), (F.col("p") == F.col("p2")) & (F.col("part") == F.col("part2")) & near & alike & linked)
    second = stage(second.select("a", "b", plain.alias("plain"), F.when(plain, both / (sizes - both)).alias("sim")), "open-pairs")
    weighed = verify(second.filter("not plain").select("a", "b").distinct(), texts)
    found = first.unionByName(second.filter("plain").select("a", "b", "sim")).unionByName(weighed).filter(F.col("sim") >= threshold - 1e-12)
    return stage(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").dropDuplicates(["a", "b"]), "links")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``tkey, set, plain``: the distinct shingles' hashes of each text, and whether none of them repeats."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sets, plain = [], []
            for t in batch.column(1):
                h = shingle_hashes([t.as_py()])[0]
                sets.append(np.unique(h).view(np.int64))
                plain.append(len(sets[-1]) == len(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array(plain, pa.bool_())], names=["tkey", "set", "plain"])

    return texts.select("tkey", "text").mapInArrow(run, "tkey binary, set array<long>, plain boolean")


def text_key(text) -> F.Column:
    """Texts of one SHA-256 are one text."""
    return F.unhex(F.sha2(text, 256))


def classes(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id`` (the smallest doc_id of the class), ``n_copies`` (rows with this very text), ``tkey``, ``root``.

    Equal texts share a class, also empty or null ones (null counts as empty); texts without words are linked to no other text. Null doc_ids are
    classed by their texts; a class of null doc_ids alone has a null class_id. Repeated rows come back each. A very long text takes memory of about 30 bytes a word
    (its distinct shingles) in one task. Other columns are not read. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("doc_id", text_key(text).alias("tkey"), text.alias("text"))
    roots = components(links(keyed.select("tkey", "text"), threshold, bands, rows))
    narrow = stage(keyed.select("doc_id", "tkey", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")), "keys")
    per_text = narrow.groupBy("tkey").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"))
    per_text = per_text.join(roots.withColumnRenamed("node", "tkey").hint("merge"), "tkey", "left").withColumn("root", F.coalesce("root", "tkey"))
    per_text = stage(per_text.withColumn("salt", F.pmod(F.xxhash64("tkey"), F.lit(SALTS)).cast("int")), "texts")
    per_text = looked_up(per_text, "root", per_text.groupBy("root").agg(F.min("least").alias("class_id"))).drop("salt", "least")
    return looked_up(narrow, "tkey", per_text).select("doc_id", "class_id", "n_copies", "tkey", "root")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``doc_id, class_id, n_copies`` of every row; nulls, empty and very long texts, repeated rows and empty tables as in ``classes``."""
    return classes(docs, threshold).select("doc_id", "class_id", "n_copies")


def deduplicate(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One document of each class stays, that with the smallest doc_id (nulls last; of rows that agree in it, the first by hash), with its own columns, whatever their names.

    Null and empty texts are one text; texts without words are linked to no other. Rows equal in every column are one document. Very long texts are read whole. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    roots = components(links(docs.select(text_key(text).alias("tkey"), text.alias("text")), threshold)).withColumnRenamed("node", "__t")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("__id"), text_key(text).alias("__t"))
    # First one row per text (combined before the shuffle), then one text per class, on narrow rows.
    order = F.struct(F.col("__id").isNull().alias("n"), F.coalesce(F.col("__id"), F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("i"), F.xxhash64("row").alias("h"))
    narrow = stage(rows.groupBy("__t").agg(F.min(order).alias("o")), "text-firsts")
    rooted = narrow.join(roots.hint("merge"), "__t", "left").withColumn("root", F.coalesce("root", "__t"))
    kept = rooted.groupBy("root").agg(F.min(F.struct("o", "__t")).alias("k")).select(F.col("k.__t").alias("__t"), F.col("k.o").alias("o"))
    # Joined by text and row, so copies of one text lie apart.
    return rows.withColumn("o", order).join(kept.hint("merge"), ["__t", "o"]).dropDuplicates(["__t"]).select("row.*")


def estimate(a, b) -> float:
    """Share of equal components of two signatures: the probability Jaccard similarity, with an error of about 1 / (2 sqrt(size))."""
    return float((a == b).mean()) if len(a) else math.nan


