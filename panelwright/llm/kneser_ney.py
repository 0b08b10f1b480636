"""An interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark and memory-mapped by the workers.

Training is a job for each order, and one for the words, over the texts' token hashes. Each task counts what it reads in runs of a few million tokens and sends sorted blocks of
(key, count), packed, cut by the key's leading bits; a segment's blocks meet in one group, which merges them and writes a sorted array to the shared
folder. Keys are scrambled, so segments are even however frequent a word is. The arrays:

- ``words``: sorted 64-bit hashes of the vocabulary, and counts; a word's id is its place over all segments;
- ``pairs``: sorted scrambled (context id, word id), and counts; with order 3 not of tokens but of the different words seen before the pair;
- ``triples``: in the context pair's segment, sorted (place of that pair there, word id), and counts, so that a context's triples lie together;
- ``wide``: the sums of contexts with more than ``NARROW`` triples; those of others are taken from their triples;
- ``dense``: per id what smoothing needs: the context's total and left-over mass, the word's lower-order probability.

Workers map the files, so a model larger than their memory costs page reads, not heap. The folder must be one that every worker can open as a path
(spark.checkpoint.dir on a shared file system); other stores raise an error that says so.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, shuffles_freed
from .words import mix, slices, unmix, word_hashes

END_HASH = 0x5851F42D4C957F2D  # of the end token; words' hashes are scrambled, so none is equal but by chance
RUN = 3_000_000  # tokens counted at a time
SLICE = 3_000_000  # characters looked up at a time: fewer would ask each segment for too few keys
START = 0xFFFFFFFF  # the context id of a text's first token; with order 3 two of them precede a text, and it is their place too, which no pair of segment 0 has
LOW = 32  # bits of a word's id and of a pair's place in its segment; the segment stands above them in a pair's place
NARROW = 8
#: Characters of training text to a segment of words, and of pairs and triples.
WORD_CHARS, PAIR_CHARS = 600_000_000, 10_000_000
#: Segments of one kind that a worker keeps mapped.
MAPPED = 4096


def local_path(uri: str) -> str:
    scheme, sep, rest = uri.partition(":")
    if uri.startswith("/"):
        return uri
    if sep and scheme == "file":
        return "/" + rest.lstrip("/")
    raise ValueError(f"the model's files must lie on a mounted file system for workers to map them, not {uri}")


def token_rows(texts: list[str]):
    """(hash, row) of all tokens, each text's end token last."""
    import numpy as np

    h, r = word_hashes(texts, lower=True)
    n = np.bincount(r, minlength=len(texts))
    at = np.cumsum(n)
    return np.insert(h, at, np.uint64(END_HASH)), np.insert(r, at, np.arange(len(texts)))


def previous(ids, rows):
    """The context of each token: the id (or place) before it in the same text, START at the first."""
    import numpy as np

    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = rows[1:] != rows[:-1]
    before[first] = START
    return before


def _save(path: str, array) -> None:
    """Whole or not at all, so that a repeated task may write again."""
    import uuid

    import numpy as np

    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.ascontiguousarray(array).tofile(f)
    os.replace(part, path)


def _map(path: str, dtype: str):
    import numpy as np

    return np.memmap(path, dtype=dtype, mode="r").view(np.ndarray) if os.path.getsize(path) else np.zeros(0, dtype)


def _narrow(counts):
    """In the smallest unsigned type that holds them all."""
    import numpy as np

    return counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))


def _counts(path: str, n: int):
    """What was saved of ``n`` counts by ``_narrow``; the file's size tells the type."""
    return _map(path, f"<u{os.path.getsize(path) // n}" if n else "<u1")


def _pack(x, rising: bool = False) -> bytes:
    """64-bit integers, as differences if they rise, byte planes apart so that zeros and small numbers shrink."""
    import zlib

    import numpy as np

    x = x.astype("<u8")
    if rising:
        x = np.diff(x, prepend=np.uint64(0))
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(packed: bytes, rising: bool = False):
    import zlib

    import numpy as np

    x = np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)
    return np.cumsum(x, dtype=np.uint64) if rising else x.astype(np.int64)


def _sum_by(keys, values):
    import numpy as np

    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return k[at], (np.add.reduceat(values[order], at, axis=0) if len(at) else values[:0])


@dataclass(frozen=True)
class Model:
    folder: str
    word_bits: int
    pair_bits: int
    bases: tuple[int, ...]  # first id of each segment of words
    n_tokens: int
    n_words: int
    discounts: tuple[float, float, float]
    unknown: float  # lower-order probability of a word never seen
    start: tuple[float, float]  # total and left-over mass of the context START
    order: int = 2
    top: tuple[float, float, float] = (0.0, 0.0, 0.0)  # discounts of triples

    def open(self) -> Tables:
        if self not in _OPEN:
            _OPEN.clear()
            _OPEN[self] = Tables(self)
        return _OPEN[self]


class Segments(dict):
    """Segment -> what is mapped of it, opened when asked for; the one opened longest ago makes room."""

    def __init__(self, open_one):
        super().__init__()
        self.open_one = open_one

    def __missing__(self, s):
        if len(self) >= MAPPED:
            self.pop(next(iter(self)))
        self[s] = out = self.open_one(s)
        return out


class Tables:
    """The mapped arrays of one model."""

    def __init__(self, model: Model):
        d = model.folder
        self.model = model
        self.words = Segments(lambda s: _map(f"{d}/words-{s}.key", "<u8"))
        self.pairs = Segments(lambda s: self._counted("pairs", s))
        self.triples = Segments(lambda s: self._counted("triples", s))
        self.wide = Segments(lambda s: _map(f"{d}/wide-{s}", "<i8").reshape(-1, 5))
        self.dense = Segments(lambda s: _map(f"{d}/dense-{s}", DENSE)) if model.unknown >= 0 else None

    def _counted(self, name: str, s: int):
        keys = _map(f"{self.model.folder}/{name}-{s}.key", "<u8")
        return keys, _counts(f"{self.model.folder}/{name}-{s}.n", len(keys))

    def ids(self, hashes):
        """(id of each word as int64, -1 if unknown; dense rows of the ids if ``dense`` is open)."""
        import numpy as np

        unique, back = np.unique(hashes, return_inverse=True)
        out = np.full(len(unique), -1, dtype=np.int64)
        rows = np.zeros(len(unique), dtype=DENSE)
        rows["p"] = self.model.unknown
        for s, where in _runs(_leading(unique, self.model.word_bits)):
            at, hit = _places(self.words[s], unique[where])
            out[where] = np.where(hit, at + self.model.bases[s], -1)
            if self.dense is not None and hit.any():
                rows[where][hit] = self.dense[s][at[hit]]
        return out[back], rows[back]

    def pair_counts(self, keys):
        """(count, place of each pair, -1 where it is none). A place is the segment, then the place in it."""
        import numpy as np

        unique, back = np.unique(keys, return_inverse=True)
        out, places = np.zeros(len(unique), dtype=np.int64), np.full(len(unique), -1, dtype=np.int64)
        for s, where in _runs(_leading(unique, self.model.pair_bits)):
            table, n = self.pairs[s]
            at, hit = _places(table, unique[where])
            out[where][hit], places[where][hit] = n[at[hit]], at[hit] + (s << LOW)
        return out[back], places[back]

    def triple_stats(self, places, words):
        """Of triples (place of the context, -1 if it is no pair; word id or -1): count, the context's total and left-over mass, 0 and 1 if no triple has it."""
        import numpy as np

        unique, number = np.unique(places, return_inverse=True)
        out = np.zeros(len(words), dtype=np.int64)
        known = (places >= 0) & (words >= 0)
        segs, keys, back = _numbered_triples(unique, number[known], words[known], return_inverse=True)
        n = np.zeros(len(keys), dtype=np.int64)
        for s, where in _runs(segs):
            table, counts = self.triples[s]
            at, hit = _places(table, keys[where])
            n[where][hit] = counts[at[hit]]
        out[known] = n[back]
        total, mass = self._contexts(unique)
        return out, total[number], mass[number]

    def _contexts(self, places):
        """(total, left-over mass) of sorted distinct context pairs."""
        import numpy as np

        sums = np.zeros((len(places), 4), dtype=np.int64)  # of counts, of counts 1, 2, 3 and more
        first = np.searchsorted(places, 0)
        real, own = places[first:], sums[first:]
        local = real & START
        for s, where in _runs(real >> LOW):
            table, counts = self.triples[s]
            keys = local[where].astype(np.uint64) << np.uint64(LOW)
            low, high = np.searchsorted(table, keys), np.searchsorted(table, keys | np.uint64(START), side="right")
            mine, size = own[where], high - low
            few = np.where(size <= NARROW, size, 0)
            ends = np.cumsum(few)
            owner = np.repeat(np.arange(len(few)), few)
            n = counts[np.arange(ends[-1]) + np.repeat(low - ends + few, few)].astype(np.int64)
            mine[:, 0] = np.bincount(owner, n, len(few))
            for k, kind in enumerate((n == 1, n == 2, n >= 3), 1):
                mine[:, k] = np.bincount(owner[kind], minlength=len(few))
            many = np.flatnonzero(size > NARROW)
            if len(many):
                mine[many] = self.wide[s][np.searchsorted(self.wide[s][:, 0], local[where][many]), 1:]
        return sums[:, 0], _mass(sums, self.model.top)


def _mass(sums, d):
    """Left-over mass of contexts from their (total, numbers of counts 1, 2, 3 and more); a matrix product would start threads of its own."""
    import numpy as np

    return np.where(sums[:, 0] > 0, (sums[:, 1] * d[0] + sums[:, 2] * d[1] + sums[:, 3] * d[2]) / np.maximum(1, sums[:, 0]), 1.0)


DENSE = [("c", "<i8"), ("total", "<i8"), ("mass", "<f8"), ("p", "<f8")]
_OPEN: dict[Model, Tables] = {}


def pair_keys(context, word):
    import numpy as np

    return mix((context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64))


def distinct_triples(place, word, **more):
    """(segments, keys in them, what ``np.unique`` gives besides) of the distinct triples, in order. A key is the context's place in its segment, then the word.

    Contexts are numbered first, so that number and word fit one integer to sort by, however many segments there are."""
    import numpy as np

    return _numbered_triples(*np.unique(place, return_inverse=True), word, **more)


def _numbered_triples(places, number, word, **more):
    import numpy as np

    low, mask = np.uint64(LOW), np.uint64(START)
    keys, *rest = np.unique((number.astype(np.uint64) << low) | word.astype(np.uint64), **more)
    places = places[(keys >> low).astype(np.int64)]
    return places >> LOW, ((places & START).astype(np.uint64) << low) | (keys & mask), *rest


def distinct_keys(bits: int):
    """The same of keys whose segment is their ``bits`` leading bits."""

    def distinct(keys, **more):
        import numpy as np

        keys, *rest = np.unique(keys, **more)
        return _leading(keys, bits), keys, *rest

    return distinct


def _leading(keys, bits: int):
    import numpy as np

    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _runs(segments):
    """(segment, slice) of each that occurs in the sorted ``segments``."""
    import numpy as np

    first = np.flatnonzero(np.diff(segments, prepend=-1))
    ends = np.append(first[1:], len(segments))
    return [(s, slice(a, b)) for s, a, b in zip(segments[first].tolist(), first.tolist(), ends.tolist())]


def _places(table, keys):
    """(place, found) of sorted keys in a sorted table; places of keys not found mean nothing."""
    import numpy as np

    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _blocks(segments, keys, counts):
    """Rows (seg, keys, counts) of sorted unique keys, cut where the segment changes."""
    runs = _runs(segments)
    return [s for s, _ in runs], [_pack(keys[w], True) for _, w in runs], [_pack(counts[w]) for _, w in runs]


def _counted(texts: DataFrame, keys_of, distinct) -> DataFrame:
    """(seg, keys, counts) blocks of what ``keys_of(list of texts)`` gives (arrays of one length, which ``distinct`` makes keys of), over all rows of ``text``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def flush(held):
            # Runs of one task may repeat a key; the segments' merge adds them up.
            full, keys, counts = _blocks(*distinct(*map(np.concatenate, zip(*held)), return_counts=True))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["seg", "keys", "counts"])

        held, n = [], 0
        for batch in batches:
            for at, k in slices(batch.column(0), SLICE):
                held.append(keys_of(batch.column(0).slice(at, k).to_pylist()))
                n += len(held[-1][0])
                if n >= RUN:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return texts.select("text").mapInArrow(run, "seg int, keys binary, counts binary")


def _segments(spark, bits: int) -> DataFrame:
    """One row ``s`` a segment, in at most 20,000 tasks."""
    return spark.range(0, 1 << bits, 1, min(1 << bits, 20_000)).select(F.col("id").cast("int").alias("s"))


def _merged(blocks: DataFrame, folder: str, name: str, bits: int) -> DataFrame:
    """Writes each segment's sorted array, also of those without keys, when it is run; ``seg, n`` (keys), ``c`` (sum of counts)."""

    def merge(table):
        import numpy as np
        import pyarrow as pa

        seg = table.column("seg")[0].as_py()
        keys = np.concatenate([_unpack(x.as_py(), True) for x in table.column("keys")])
        keys, counts = _sum_by(keys, np.concatenate([_unpack(x.as_py()) for x in table.column("counts")]))
        _save(f"{folder}/{name}-{seg}.key", keys)
        _save(f"{folder}/{name}-{seg}.n", _narrow(counts))
        return pa.table({"seg": pa.array([seg], pa.int32()), "n": pa.array([len(keys)]), "c": pa.array([int(counts.sum())])})

    os.makedirs(folder, exist_ok=True)
    none = F.unhex(F.lit(_nothing().hex()))
    every = blocks.unionByName(_segments(blocks.sparkSession, bits).select(F.col("s").alias("seg"), none.alias("keys"), none.alias("counts")))
    return every.groupBy("seg").applyInArrow(merge, "seg int, n long, c long")


def _nothing() -> bytes:
    import numpy as np

    return _pack(np.zeros(0, np.uint64))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from how many keys occur 1, 2, 3 and 4 times; plain halves where the data are too few."""
    if min(n1, n2, n3) == 0:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def _triples(texts: DataFrame, model: Model) -> tuple[float, float, float]:
    """Writes triples and wide, and puts into the counts of pairs how many different words come before each. Their discounts."""
    spark, folder, bits = texts.sparkSession, model.folder, model.pair_bits

    def keys_of(batch: list[str]):
        h, rows = token_rows(batch)
        tables = model.open()
        ids, _ = tables.ids(h)
        _, places = tables.pair_counts(pair_keys(previous(ids, rows), ids))
        return previous(places, rows), ids

    with shuffles_freed(spark):
        _merged(_counted(texts, keys_of, distinct_triples), folder, "triples", bits).agg(F.sum("n")).collect()

    def summed(batches):
        import numpy as np
        import pyarrow as pa

        whole, names = np.zeros(6, dtype=np.int64), ["seg", "keys", "counts"]
        for batch in batches:
            for s in batch.column(0).to_pylist():
                key = np.array(_map(f"{folder}/triples-{s}.key", "<u8"))
                n = np.array(_counts(f"{folder}/triples-{s}.n", len(key))).astype(np.int64)
                pairs = _map(f"{folder}/pairs-{s}.key", "<u8")
                place = (key >> np.uint64(LOW)).astype(np.int64)
                kinds = np.stack([n, n == 1, n == 2, n >= 3, n == 3, n == 4], axis=1).astype(np.int64)
                at, sums = _sum_by(place, kinds[:, :4])
                many = sums[:, 1:].sum(1) > NARROW
                _save(f"{folder}/wide-{s}", np.column_stack([at[many], sums[many]]).astype("<i8"))
                middle = np.full(len(key), START, dtype=np.uint64)  # the one context that is no pair
                real = place < len(pairs)
                middle[real] = unmix(pairs[place[real]]) & np.uint64(0xFFFFFFFF)
                full, keys, counts = _blocks(*distinct_keys(bits)(pair_keys(middle, key & np.uint64(START)), return_counts=True))
                whole += kinds.sum(0)
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([_pack(whole)], pa.binary())], names=names)

    def gathered(table):
        import numpy as np
        import pyarrow as pa

        seg = table.column("seg")[0].as_py()
        if seg < 0:
            total = sum(_unpack(x.as_py()) for x in table.column("counts")).tolist()
        else:
            pairs, total = _map(f"{folder}/pairs-{seg}.key", "<u8"), []
            before = np.zeros(len(pairs), dtype=np.int64)
            for keys, counts in zip(table.column("keys"), table.column("counts")):
                before[np.searchsorted(pairs, _unpack(keys.as_py(), True))] += _unpack(counts.as_py())
            _save(f"{folder}/pairs-{seg}.n", _narrow(before))
        return pa.table({"seg": pa.array([seg], pa.int32()), "total": pa.array([total], pa.list_(pa.int64()))})

    blocks = _segments(spark, bits).mapInArrow(summed, "seg int, keys binary, counts binary")
    with shuffles_freed(spark):
        (done,) = blocks.groupBy("seg").applyInArrow(gathered, "seg int, total array<long>").filter("seg = -1").collect()  # every segment is run
    kinds = done.total
    return discounts(kinds[1], kinds[2], kinds[4], kinds[5])


def train(texts: DataFrame, chars: int, order: int = 2) -> Model:
    """The model of the column ``text`` (no nulls). ``chars``: about how many characters there are; it sets the number of segments. ``order``: 2 or 3 words.

    Empty texts are an end token each; repeated rows count each time; a very long text is counted in one run; without any text the model knows no word. Other columns are not read."""
    if order not in (2, 3):
        raise ValueError(f"the order must be 2 or 3, not {order}")
    spark = texts.sparkSession
    folder = local_path(shared_dir(spark, "kneser-ney"))
    # A segment's blocks meet in one task: their number follows the text's size, for words (few are new after a while) and for pairs and triples.
    word_bits = max(2, (chars // WORD_CHARS + 1).bit_length())
    pair_bits = max(3, (chars // PAIR_CHARS + 1).bit_length())
    with shuffles_freed(spark):
        merged = _merged(_counted(texts, lambda t: token_rows(t)[:1], distinct_keys(word_bits)), folder, "words", word_bits)
        words = {r.seg: (r.n, r.c) for r in merged.collect()}
    bases, n_words = [], 0
    for s in range(1 << word_bits):
        bases.append(n_words)
        n_words += words[s][0]
    n_tokens = sum(c for _, c in words.values())
    if n_words >= START:
        raise ValueError("more than 2^32 - 1 different words")
    model = Model(folder, word_bits, -1, tuple(bases), n_tokens, n_words, (0.0, 0.0, 0.0), -1.0, (0.0, 1.0))

    def keys_of(batch: list[str]):
        h, rows = token_rows(batch)
        ids, _ = model.open().ids(h)
        return (pair_keys(previous(ids, rows), ids),)

    with shuffles_freed(spark):
        _merged(_counted(texts, keys_of, distinct_keys(pair_bits)), folder, "pairs", pair_bits).agg(F.sum("n")).collect()
    longer: dict = {}
    if order == 3:
        longer = {"order": 3, "top": _triples(texts, Model(folder, word_bits, pair_bits, tuple(bases), n_tokens, n_words, (0.0, 0.0, 0.0), -1.0, (0.0, 1.0), 3))}

    # Counts of counts of pairs, and per segment of word ids: contexts' totals and numbers of continuations, words' numbers of contexts.
    def summed(batches):
        import numpy as np
        import pyarrow as pa

        def rows(out):
            types = {"seg": pa.int32(), "ids": pa.binary(), "stats": pa.binary(), "what": pa.int32()}
            return pa.RecordBatch.from_pydict({name: pa.array(out[name], t) for name, t in types.items()})

        whole, start = np.zeros(6, dtype=np.int64), np.zeros(4, dtype=np.int64)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                key = unmix(np.array(_map(f"{folder}/pairs-{s}.key", "<u8")))
                n = np.array(_counts(f"{folder}/pairs-{s}.n", len(key))).astype(np.int64)
                context, word = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
                kinds = np.stack([n, n == 1, n == 2, n >= 3, n == 3, n == 4], axis=1).astype(np.int64)
                whole += kinds.sum(0)
                v, stats = _sum_by(context, kinds[:, :4])
                w, left = _sum_by(word, np.ones(len(word), np.int64))
                if len(v) and v[-1] == START:
                    start += stats[-1]
                    v, stats = v[:-1], stats[:-1]
                out = {"seg": [], "ids": [], "stats": [], "what": []}
                for what, ids, values in ((1, v, stats), (2, w, left)):
                    # Segments without words share their base with the next; the search gives the last of them, which has the words.
                    for t, part in _runs(np.searchsorted(np.array(bases), ids, side="right") - 1):
                        for name, x in (("seg", t), ("ids", _pack(ids[part], True)), ("stats", _pack(values[part].reshape(-1))), ("what", what)):
                            out[name].append(x)
                yield rows(out)
        yield rows({"seg": [-1, -2], "ids": [b"", b""], "stats": [_pack(whole), _pack(start)], "what": [0, 0]})

    blocks = _segments(spark, pair_bits).mapInArrow(summed, "seg int, ids binary, stats binary, what int")

    def gathered(table):
        """One segment of ids: dense sums to a file, and the counts of counts of what the words have seen."""
        import numpy as np
        import pyarrow as pa

        seg = table.column("seg")[0].as_py()
        parts = list(zip(table.column("what").to_pylist(), table.column("ids"), table.column("stats")))
        if seg < 0:
            total = sum(_unpack(x.as_py()) for _, _, x in parts)
        else:
            n = words[seg][0]
            sums = np.zeros((n, 5), dtype=np.int64)
            for what, ids, stats in parts:
                at = _unpack(ids.as_py(), True).astype(np.int64) - bases[seg]
                if what == 1:
                    sums[at, :4] += _unpack(stats.as_py()).reshape(-1, 4)
                else:
                    sums[at, 4] += _unpack(stats.as_py())
            _save(f"{folder}/sums-{seg}", sums)
            left = sums[:, 4]
            total = np.array([left.sum(), *((left == k).sum() for k in (1, 2)), (left >= 3).sum(), (left == 3).sum(), (left == 4).sum()])
        return pa.table({"seg": pa.array([seg], pa.int32()), "total": pa.array([[int(x) for x in total]], pa.list_(pa.int64()))})

    with shuffles_freed(spark):
        found = {r.seg: list(r.total) for r in blocks.groupBy("seg").applyInArrow(gathered, "seg int, total array<long>").collect()}
    pair_kinds, start = found.get(-1, [0] * 6), found.get(-2, [0] * 4)
    lower = [sum(t[k] for s, t in found.items() if s >= 0) for k in range(6)]
    d2 = discounts(pair_kinds[1], pair_kinds[2], pair_kinds[4], pair_kinds[5])
    d1 = discounts(lower[1], lower[2], lower[4], lower[5])
    seen = max(1, lower[0])
    spread = (d1[0] * lower[1] + d1[1] * lower[2] + d1[2] * lower[3]) / seen if lower[0] else 1.0

    def finish(batches):
        import numpy as np

        for batch in batches:
            for s in batch.column(0).to_pylist():
                n = words[s][0]
                out = np.zeros(n, dtype=DENSE)
                if n:
                    sums = np.array(_map(f"{folder}/sums-{s}", "<i8")).reshape(-1, 5)
                    out["c"], out["total"] = _counts(f"{folder}/words-{s}.n", n), sums[:, 0]
                    out["mass"] = _mass(sums, d2)
                    left = sums[:, 4]
                    out["p"] = (left - np.array([0.0, *d1])[np.minimum(left, 3)]) / seen + spread / (n_words + 1)
                _save(f"{folder}/dense-{s}", out)
            yield batch

    spark.range(0, 1 << word_bits).select(F.col("id").cast("int").alias("s")).mapInArrow(finish, "s int").count()
    mass = (start[1] * d2[0] + start[2] * d2[1] + start[3] * d2[2]) / start[0] if start[0] else 1.0
    return Model(folder, word_bits, pair_bits, tuple(bases), n_tokens, n_words, d2, spread / (n_words + 1), (float(start[0]), mass), **longer)


def probabilities(model: Model, hashes, rows):
    """(probability, training count) of every token, given the one or two before."""
    import numpy as np

    tables = model.open()
    ids, dense = tables.ids(hashes)
    context = previous(ids, rows)
    known = (ids >= 0) & (context >= 0)
    n = np.zeros(len(ids), dtype=np.int64)
    places = np.full(len(ids), -1, dtype=np.int64)
    n[known], places[known] = tables.pair_counts(pair_keys(context[known], ids[known]))
    total, mass = np.zeros(len(ids)), np.ones(len(ids))
    total[1:], mass[1:] = dense["total"][:-1], np.where(ids[:-1] >= 0, dense["mass"][:-1], 1.0)
    first = context == START
    total[first], mass[first] = model.start
    higher = np.where(n > 0, (n - np.array([0.0, *model.discounts])[np.minimum(n, 3)]) / np.maximum(1.0, total), 0.0)
    p = higher + mass * dense["p"]
    if model.order == 3:
        context = previous(places, rows)
        n, total, mass = tables.triple_stats(context, ids)
        p = np.where(n > 0, (n - np.array([0.0, *model.top])[np.minimum(n, 3)]) / np.maximum(1, total), 0.0) + mass * p
    return p, dense["c"]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (any columns, ``text`` among them) with ``n_tokens, n_known, base_score, score`` instead of ``text``."""
    other = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in other)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        floor = np.log10(model.n_tokens + model.n_words + 1)
        for batch in batches:
            at_text = batch.schema.get_field_index("text")
            for at, k in slices(batch.column(at_text), SLICE):
                part = batch.slice(at, k)
                h, rows = token_rows(part.column(at_text).to_pylist())
                p, c = probabilities(model, h, rows)
                n = np.bincount(rows, minlength=k)
                base = np.bincount(rows, np.log10(c + 1.0), k) - n * floor
                columns = [part.column(part.schema.get_field_index(x)) for x in other]
                columns += [pa.array(n.astype(np.int64)), pa.array(np.bincount(rows, c > 0, k).astype(np.int64)), pa.array(base), pa.array(np.bincount(rows, np.log10(p), k))]
                yield pa.RecordBatch.from_arrays(columns, names=[*other, "n_tokens", "n_known", "base_score", "score"])

    return docs.mapInArrow(run, f"{schema}, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: Column, fold: int = 2, folds: int = 7) -> Column:
    """True for the documents that are scored but not learnt from: crc32 of the id as text. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def score_documents(docs: DataFrame, order: int = 2) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Null and empty texts are an end token alone. Repeated rows count and are scored each time. Other columns are not read. A very long text is scored in one piece, in memory of some 200 bytes a word. With no training
    document the model spreads all mass evenly over the unknown word. An empty table gives an empty one.
    """
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    training = own.filter(~F.col("held_out")).select("text")
    chars = training.agg(F.sum(F.length("text"))).first()[0] or 0
    model = train(training, chars, order)
    scored = score(own, model).withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
