"""Lines that earlier documents have are dropped: ranges of hashes, sorted by document, streamed once.

A line's key is hashed to 128 bits. (hash, document) is dealt out by ranges and sorted inside each, so a task meets the documents of a key in order and the first
one is the smallest. Ranges may cut through a key, however many rows it has: only the key that a range begins with can have begun before, and two rows a range
(its first and last key, with the smallest document seen) settle that. What comes back is one compressed bitmap of kept lines a document; texts meet it once, at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .words import slices_of

TRIMMED = " \t\n\x0b\x0c\r"
#: Stands for a null doc_id, which comes after all others.
LAST = (1 << 63) - 1


def _texts(docs: DataFrame) -> DataFrame:
    """A text is known by its document and 128 bits of hash; rows alike in both are alike in all that follows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def _keys(least: int):
    def run(batches):
        """A row for each text (its number of lines) and each of its keys of ``least`` code points or more (the places of its lines)."""
        import hashlib

        import numpy as np
        import pyarrow as pa

        seen = 0
        for batch in slices_of(batches, "text"):
            own, n_lines, digests, places = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                lines, at = text.split("\n"), {}
                for p, line in enumerate(lines):
                    key = line.strip(TRIMMED)
                    if len(key) >= least:
                        at.setdefault(key.encode("utf-8", "replace").lower(), []).append(p)
                own += [i] * (1 + len(at))
                n_lines += [len(lines), *[None] * len(at)]
                digests += [hashlib.blake2b(k, digest_size=16).digest() for k in at]
                places += [None, *at.values()]
            rows = pa.array(own, pa.int64())
            heads = np.array([x is None for x in places])
            h = np.zeros((len(own), 2), dtype=np.int64)
            h[~heads] = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            salt = (np.array(own) + seen) % 64
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(rows) for c in ("doc", "t1", "t2")), pa.array(n_lines, pa.int32()), pa.array(h[:, 0], mask=heads), pa.array(h[:, 1], mask=heads), pa.array(places, pa.list_(pa.int32())), pa.array(salt, pa.int32())],
                names=["doc", "t1", "t2", "n_lines", "h1", "h2", "places", "salt"],
            )

    return run


def _stream(batches):
    """One range, sorted: ``kind`` 0 are keys that an earlier document has for certain, 1 those of the range's first key that an earlier range may have, 2 the range's first and last key with the smallest document seen here."""
    import numpy as np
    import pyarrow as pa

    opening = key = least = None
    first_doc = 0
    names = ["kind", "doc", "t1", "t2", "h1", "h2", "places"]
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc"))
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = key != (h1[0], h2[0])
        if opening is None:
            opening, first_doc = (h1[0], h2[0]), doc[0]
        of = np.concatenate([[0 if least is None else least], doc[new]])[np.cumsum(new)]
        key, least = (h1[-1], h2[-1]), of[-1]
        later = doc > of
        some = np.flatnonzero(later | ((h1 == opening[0]) & (h2 == opening[1])))
        if len(some):
            part = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([pa.array(np.where(later[some], 0, 1), pa.int32()), *(part.column(c) for c in names[1:])], names=names)
    if opening is not None:
        ends = [(opening, first_doc), (key, least)]
        none = pa.array([None] * 2, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([2, 2], pa.int32()), pa.array([d for _, d in ends], pa.int64()), none, none, pa.array([k[0] for k, _ in ends], pa.int64()), pa.array([k[1] for k, _ in ends], pa.int64()), pa.array([None] * 2, pa.list_(pa.int32()))], names=names
        )


def _bitmaps(batches):
    import zlib

    import numpy as np
    import pyarrow as pa

    for batch in batches:
        keep, dropped = [], []
        for n, places in zip(batch.column("n_lines").to_pylist(), batch.column("places").to_pylist()):
            bits = np.ones(n, dtype=bool)
            if places:
                bits[np.concatenate([np.asarray(p, dtype=np.int64) for p in places])] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes()))
            dropped.append(n - int(bits.sum()))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc", "t1", "t2")), batch.column("n_lines").cast(pa.int64()), pa.array(dropped, pa.int64()), pa.array(keep, pa.binary())], names=["doc", "t1", "t2", "n_lines", "n_dropped", "keep"]
        )


def keep_bitmaps(docs: DataFrame, least: int = 10) -> DataFrame:
    """``doc, t1, t2, n_lines, n_dropped, keep``, one row for each different text of a document: ``keep`` is a zlib-compressed bitmap (bit 0 the first line) of its lines.

    Lines are split at \\n. A key is the line without ASCII white space at both ends, A-Z lower-cased; keys of ``least`` code points or more that two documents hold lose
    their lines in all but the smallest doc_id. Null and empty texts are one empty line. Documents are told apart by doc_id: rows that share one are one document; null doc_ids
    are one, after all others (``doc`` is the greatest long there). Repeated rows give one row. A very long text is one row of its places. An empty table gives an empty one; other columns are not read.
    """
    lines = stage(_texts(docs).mapInArrow(_keys(least), "doc long, t1 long, t2 long, n_lines int, h1 long, h2 long, places array<int>, salt int"), "lines")
    rows = lines.filter("h1 is not null").select("h1", "h2", "doc", "salt", "t1", "t2", "places")
    # The salt lets ranges cut through rows that repeat one document.
    ranged = rows.repartitionByRange("h1", "h2", "doc", "salt").sortWithinPartitions("h1", "h2", "doc", "salt")
    found = stage(ranged.mapInArrow(_stream, "kind int, doc long, t1 long, t2 long, h1 long, h2 long, places array<int>"), "lines-found")
    firsts = found.filter("kind = 2").groupBy("h1", "h2").agg(F.min("doc").alias("least"))
    # At most two rows for each range.
    opened = found.filter("kind = 1").join(F.broadcast(firsts), ["h1", "h2"]).filter("doc > least")
    gone = found.filter("kind = 0").select("doc", "t1", "t2", "places").unionByName(opened.select("doc", "t1", "t2", "places"))
    texts = lines.filter("h1 is null").select("doc", "t1", "t2", "n_lines")
    both = texts.unionByName(gone, allowMissingColumns=True).groupBy("doc", "t1", "t2").agg(F.max("n_lines").alias("n_lines"), F.collect_set("places").alias("places"))
    return both.mapInArrow(_bitmaps, "doc long, t1 long, t2 long, n_lines long, n_dropped long, keep binary")


def _kept(batches):
    import zlib

    import numpy as np
    import pyarrow as pa

    for batch in slices_of(batches, "text"):
        out = []
        for text, n, gone, keep in zip(*(batch.column(c).to_pylist() for c in ("text", "n_lines", "n_dropped", "keep"))):
            if gone:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=n).tolist()
                text = "\n".join([line for line, bit in zip(text.split("\n"), bits) if bit])
            out.append(text)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "n_lines", "n_dropped")), pa.array(out, pa.string())], names=["doc", "n_lines", "n_dropped", "text"])


def deduplicated(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text``, one row a document, ``text`` its kept lines joined by \\n (empty where none is kept). ``bitmaps`` are those of the same documents."""
    # Bitmaps are the small side of every partition; texts are not sorted.
    met = _texts(docs).join(stage(bitmaps, "bitmaps").hint("shuffle_hash"), ["doc", "t1", "t2"])
    kept = met.select("doc", "text", "n_lines", "n_dropped", "keep").mapInArrow(_kept, "doc long, n_lines long, n_dropped long, text string")
    return kept.select(F.nullif("doc", F.lit(LAST)).alias("doc_id"), "n_lines", "n_dropped", "text")
