"""Approximate nearest neighbours by cross-polytope hashing.

A vector is rotated pseudo-randomly (three rounds of random signs and a fast Hadamard transform, padded to a power of two) and hashed to the signed axis
nearest to it. Each of several tables uses ``axes`` such rotations. Rows lie in one bucket per table; a query probes several buckets
per table, best first by the size of its coordinates. Buckets are searched in blocks: data and probes of a bucket meet in one group, which
returns each query's best few by exact cosine; where a bucket has many rows or many probes both sides are split, and each part of one meets each part of the other.
Queries whose buckets hold too few rows are compared with all rows, in blocks. Tables, probes and axes do not depend on the row count, so neither does the share
of the table that a query sees.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SMALL, stage

#: Tables, and buckets probed in each: 0.96 of the five nearest of real vectors (64 dimensions) with one axis. Fewer tables ship the vectors fewer times, more probes make up for it.
TABLES, PROBES = 3, 32
#: Rows and probes of a bucket that meet in one group.
BLOCK, ASKED = 16_000, 32_000


def hadamard(x):
    """Along the last axis, whose length is a power of two; orthonormal."""
    import numpy as np

    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.concatenate([y[..., :1, :] + y[..., 1:, :], y[..., :1, :] - y[..., 1:, :]], axis=-2).reshape(*x.shape)
        h *= 2
    return x / math.sqrt(n)


def rotate(x, seed: int):
    """The pseudo-rotation number ``seed`` of the rows of x, padded with zeros."""
    import numpy as np

    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    signs = np.random.Generator(np.random.Philox(key=seed)).integers(0, 2, (3, n)) * 2.0 - 1.0
    for k in range(3):
        y = hadamard(y * signs[k])
    return y


def ranked_axes(y, most: int):
    """Signed axes (2 i for +, 2 i + 1 for -) by nearness and their coordinates' absolute values, the ``most`` nearest of each row."""
    import numpy as np

    a = np.abs(y)
    order = np.argsort(-a, axis=1, kind="stable")[:, :most]
    return 2 * order + (np.take_along_axis(y, order, 1) < 0), np.take_along_axis(a, order, 1)


def buckets(x, table: int, axes: int, probes: int):
    """(n, probes) bucket numbers of table ``table``, nearest first. With several axes the best combinations by sum of coordinates."""
    import numpy as np

    out, score = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
    width = 2 << max(1, (x.shape[1] - 1).bit_length())
    for k in range(axes):
        axis, value = ranked_axes(rotate(x, 1000 * table + k + 1), probes)
        sums = (score[:, :, None] + value[:, None, :]).reshape(len(x), -1)
        both = (out[:, :, None] * width + axis[:, None, :]).reshape(len(x), -1)
        best = np.argsort(-sums, axis=1, kind="stable")[:, :probes]
        out, score = np.take_along_axis(both, best, 1), np.take_along_axis(sums, best, 1)
    return out


def top_matches(query_rids, q, rids, ids, x, k: int):
    """(query index, data index, cosine) of each query's ``k`` best, its own row (same rid) left out, exact in double precision, ties to smaller ids."""
    import numpy as np

    out_q, out_x, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    qn, xn = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    for at in range(0, len(q), 256):
        block = (q[at : at + 256] @ x.T) / qn[at : at + 256, None] / xn[None, :]
        take = min(len(x), k + 1)
        floor = -np.partition(-block, take - 1, axis=1)[:, take - 1]
        qi, xi = np.nonzero(block >= floor[:, None] - 1e-9)
        # The block's sums depend on its shape in the last digit; these do not.
        s = (q[at + qi] * x[xi]).sum(1) / (qn[at + qi] * xn[xi])
        keep = rids[xi] != query_rids[at + qi]
        qi, xi, s = qi[keep], xi[keep], s[keep]
        order = np.lexsort((rids[xi], ids[xi], -s, qi))
        qi, xi, s = qi[order], xi[order], s[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        keep = place < k
        out_q.append(at + qi[keep]), out_x.append(xi[keep]), out_s.append(s[keep])
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_s)


def _flat(lists):
    """The values of an Arrow list array as (rows, length) doubles; all lists are of one length."""
    import numpy as np

    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _hashed(tables: int, axes: int, most: int, digest: bool = False):
    """Adds ``bs``, the buckets of each row: ``most`` of each table, one table after the other (table * 2^48 + bucket); with ``digest`` also ``h``, 256 bits that stand for the vector."""

    def run(batches):
        from hashlib import blake2b

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("v"))
            size = np.diff(lists.offsets.to_numpy())
            for d in np.unique(size):
                part = batch.filter(pa.array(size == d))
                x = _flat(part.column(part.schema.get_field_index("v")))
                own = [pa.array([blake2b(row.data, digest_size=32).digest() for row in x], pa.binary())] if digest else []
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                b = np.concatenate([buckets(x, t, axes, most) + (t << 48) for t in range(tables)], axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(b), pa.list_(pa.int64())), *own], names=[*part.schema.names, "bs", *["h"] * digest])

    return run


def _searched(k: int):
    """Two tables of rows (rid, vec_id, v) and queries (rid, vec_id, v) to the best ``k`` of each query."""

    def search(x, q):
        import pyarrow as pa

        names = ["query_rid", "query_id", "rid", "vec_id", "score"]
        if not len(x) or not len(q):
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names})
        rids, ids, qrids, qids = (t.column(c).to_numpy() for t in (x, q) for c in ("rid", "vec_id"))
        qi, xi, s = top_matches(qrids, _flat(q.column("v").combine_chunks()), rids, ids, _flat(x.column("v").combine_chunks()), k)
        return pa.table(dict(zip(names, (pa.array(c) for c in (qrids[qi], qids[qi], rids[xi], ids[xi], s)))))

    return search


FOUND = "query_rid long, query_id long, rid long, vec_id long, score double"


def _met(data: DataFrame, queries: DataFrame, on: list[str], k: int, block: int) -> DataFrame:
    """The best ``k`` of each query among the rows of each key, both sides split where they are many."""
    n = data.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    m = queries.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("slices"))
    both = stage(n.join(m.hint("merge"), on), "bucket-parts")
    both = F.broadcast(both) if both.count() <= SMALL else both.hint("merge")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("rid"), F.col(c)).cast("int")
    left = data.join(both, on).withColumn("part", own("parts")).withColumn("slice", each("slices")).select(*on, "part", "slice", "rid", "vec_id", "v")
    right = queries.join(both, on).withColumn("slice", own("slices")).withColumn("part", each("parts")).select(*on, "part", "slice", "rid", "vec_id", "v")
    key = [*on, "part", "slice"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_searched(k), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query; a row met in several buckets counts once."""
    place = Window.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id", "rid")
    return found.dropDuplicates(["query_rid", "rid"]).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, tables: int = TABLES, probes: int | None = None, axes: int = 1, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found. Queries are the rows of ``vectors`` (``vec_id``, ``embedding``) whose id is divisible by ``every``; candidates all rows but the query's own.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, take no part. Vectors of different lengths are not compared. Rows
    equal in id and vector are rows each, as queries and as candidates. Of rows with one vector only the k + 1 smallest ids are kept as candidates: no answer can hold more
    of them. A query whose buckets hold fewer than ``k`` rows is compared with all rows, so only a table with fewer candidates gives fewer. An empty table gives
    an empty one; other columns are not read. More ``axes`` make smaller buckets, of which more must be probed for the same recall: give ``probes`` then. ``block``
    bounds the rows of a bucket searched at once.
    """
    if probes is None and axes != 1:
        raise ValueError(f"no measured number of probes for {axes} axes: give probes")
    kept = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kept).alias("v")).filter("vec_id is not null").filter(ok)
    rows = rows.mapInArrow(_hashed(tables, axes, 1, True), f"vec_id long, v {kept}, bs array<long>, h binary")
    rows = stage(rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("d", F.size("v")), "vectors")
    # Of vectors that k + 1 rows or more share, the last row to keep. Every map task passes on at most k + 1 rows of a vector (a limit of the window's groups), so many copies meet nowhere.
    place = F.row_number().over(Window.partitionBy("h").orderBy("vec_id", "rid"))
    first = rows.select("h", "vec_id", "rid").withColumn("n", place).filter(F.col("n") <= k + 1)
    last = stage(first.groupBy("h").agg(F.max("n").alias("n"), F.max(F.struct("vec_id", "rid")).alias("last")).filter(F.col("n") == k + 1).drop("n"), "repeated")
    last = F.broadcast(last) if last.count() <= SMALL else last.hint("merge")
    data = rows.join(last, "h", "left").filter(F.col("last").isNull() | (F.struct("vec_id", "rid") <= F.col("last")))
    queries = rows.filter(F.col("vec_id") % every == 0).select("rid", "vec_id", "d", "v")
    placed = data.select("d", F.explode("bs").alias("b"), "rid", "vec_id", "v")
    probed = queries.mapInArrow(_hashed(tables, axes, probes or PROBES), f"rid long, vec_id long, d int, v {kept}, bs array<long>").select("d", F.explode("bs").alias("b"), "rid", "vec_id", "v")
    found = stage(_best(_met(placed, probed, ["d", "b"], k, block), k), "found")
    held = found.groupBy(F.col("query_rid").alias("rid")).agg(F.count(F.lit(1)).alias("held"))
    short = stage(queries.join(held.hint("merge"), "rid", "left").filter(F.coalesce("held", F.lit(0)) < k).drop("held"), "short")
    if short.limit(1).count():
        again = _best(_met(data.select("d", "rid", "vec_id", "v"), short, ["d"], k, block), k)
        found = found.join(short.select(F.col("rid").alias("query_rid")).hint("merge"), "query_rid", "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")
