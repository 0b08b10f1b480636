"""Collocations by best-first branch and bound over phrase prefixes.

A phrase's score is the least of 1000 a n / (l r) over its cuts. Its first part begins with its first word and its second part is found at least a times, so no phrase that
begins with w scores above 1000 n / f(w): a first word's count bounds everything below it. First words are therefore expanded in order of rising count, in batches. A batch
grows word by word: one pass over the texts counts the extensions of the prefixes that are frequent so far, so what is counted follows the frontier, not the
texts. Once the ``top``-th surviving score of a language is above the bound of the next first word (strictly, so ties are met), that language is settled; the search ends when all are.

Words and phrases travel as 64-bit hashes; tasks learn what the frontier is from bitmaps of bounded size, which let some others through that the exact join then drops.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage
from .words import _LOWER_BYTE, _TABLE, _powers, mix, slices_of

TOKEN = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+")
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAPS = BREAKS.copy()
GAPS[[0x20, 0x09]] = True
#: Bytes hashed at a time, rows held in a task before they are merged, characters of a slice.
BLOCK, HELD, SLICE = 1 << 18, 1_000_000, 2_000_000
#: A bitmap has 64 bits or more for each member, 2 MB at least and 32 MB at most; with more members more others pass.
SMALLEST, LARGEST = 24, 28
LONGEST = 5
_M = np.uint64(0xD6E8FEB86659FD93)


def _blocks(texts: list[str]):
    """(pieces, row of each) of at most about ``BLOCK`` bytes together; a longer text is cut at gaps."""
    pieces, rows, held = [], [], 0
    for r, text in enumerate(texts):
        raw, at = text.encode("utf-8", "replace"), 0
        while at < len(raw):
            end = len(raw)
            if end - at > BLOCK:
                near = np.flatnonzero(GAPS[np.frombuffer(raw, np.uint8, BLOCK, at)])
                end = at + int(near[-1]) + 1 if len(near) else at + BLOCK
                while not len(near) and end < len(raw) and not GAPS[raw[end]]:
                    end += 1
            if held and held + end - at > BLOCK:
                yield pieces, rows
                pieces, rows, held = [], [], 0
            pieces.append(raw[at:end]), rows.append(r)
            held += end - at + 1
            at = end
    yield pieces, rows


def words_of(texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, piece) of every word in order; words next to each other lie in a phrase together if their piece numbers agree. ``seeds``: mixed into the hashes of each row."""
    out, base = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for pieces, row in _blocks(texts):
        if not pieces:
            continue
        buffer = np.frombuffer(b" ".join(pieces), dtype=np.uint8)
        n = len(buffer)
        inside = np.zeros(n + 2, dtype=np.int8)
        inside[1:-1] = ~GAPS[buffer]
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        up, down = _TABLE if n <= len(_TABLE[0]) else _powers(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_LOWER_BYTE[buffer] * up[:n], out=sums[1:])
        stops = np.cumsum(np.fromiter((len(p) + 1 for p in pieces), dtype=np.int64, count=len(pieces)))
        own = np.array(row, dtype=np.int64)[np.searchsorted(stops, starts, side="right")]
        breaks = np.cumsum(BREAKS[buffer])
        out.append((mix(mix((sums[ends] - sums[starts]) * down[starts]) ^ seeds[own]), own, base + breaks[starts]))
        base += int(breaks[-1])
    h, row, piece = (np.concatenate(x) for x in zip(*out))
    return h, row, piece + row  # rows ascend, so another row is another piece


def longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word."""
    return mix(prefix * _M + word)


class Bitmap:
    """Which hashes may be members; others pass by chance."""

    def __init__(self, bits: bytes, size: int):
        self.bits, self.shift = np.frombuffer(bits, dtype=np.uint8), np.uint64(64 - size)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def bitmap(hashes: DataFrame) -> Bitmap:
    """Of the column ``h``; built by the executors in pieces of 4 KB."""
    size = min(LARGEST, max(SMALLEST, math.ceil(math.log2(64 * max(1, hashes.count())))))
    at = F.shiftrightunsigned("h", 64 - size)
    pieces = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("piece")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits"))
    out = bytearray(1 << (size - 3))
    for piece, bits in pieces.collect():
        out[piece << 12 : (piece << 12) + len(bits)] = bits
    return Bitmap(bytes(out), size)


class _Held:
    """Rows of a task, merged by their first column (a hash) before they leave it: counts are added, the columns in ``least`` and ``most`` keep the least and the greatest."""

    def __init__(self, names: list[str], least: tuple[str, ...] = (), most: tuple[str, ...] = ()):
        self.names, self.least, self.most, self.parts, self.n = names, least, most, [], 0

    def add(self, **columns) -> None:
        self.parts.append(self._merged(columns))
        self.n += len(self.parts[-1]["h"])
        if self.n > HELD:
            self._merge()

    def _merge(self) -> None:
        self.parts = [self._merged({c: np.concatenate([p[c] for p in self.parts]) for c in self.names})]
        self.n = len(self.parts[0]["h"])

    def _merged(self, columns: dict) -> dict:
        order = np.argsort(columns["h"], kind="stable")
        h = columns["h"][order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
        how = {"c": np.add} | dict.fromkeys(self.least, np.minimum) | dict.fromkeys(self.most, np.maximum)
        return {c: (how[c].reduceat(v[order], first) if len(h) else v) if c in how else v[order][first] for c, v in columns.items()}

    def out(self, last: bool = False):
        """What must leave now: all at the end, and whatever doesn't merge into half the limit."""
        import pyarrow as pa

        if last and self.parts:
            self._merge()
        if self.parts and (last or self.n > HELD // 2 and len(self.parts) == 1):
            part, self.parts, self.n = self.parts[0], [], 0
            for at in range(0, len(part["h"]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[c][at : at + 100_000]).view(np.int64)) for c in self.names], names=self.names)


def _each(batches, open_=None):
    """(g as signed, words, rows, pieces, texts) of slices; of languages that are still ``open_``, if given."""
    import pyarrow as pa

    for batch in slices_of(batches, "text", SLICE):
        if open_ is not None:
            batch = batch.filter(pa.array(open_(batch.column("g").to_numpy().view(np.uint64))))
        g, texts = batch.column("g").to_numpy(), batch.column("text").to_pylist()
        yield g, *words_of(texts, g.view(np.uint64)), texts


def _count_words(batches):
    held = _Held(["h", "g", "c"])
    for g, w, row, _, _ in _each(batches):
        of = np.bincount(row, minlength=len(g))
        # A language's own hash stands for all its words.
        held.add(h=np.concatenate([w, g.view(np.uint64)]), g=np.concatenate([g[row], g]), c=np.concatenate([np.ones(len(w), dtype=np.int64), of]))
        yield from held.out()
    yield from held.out(last=True)


def _positions(w, piece, known: Bitmap, k: int):
    """Places where ``k`` words that may be frequent lie in one piece."""
    good = known(w)
    at = np.flatnonzero(good[: max(0, len(w) - k + 1)])
    at = at[piece[at] == piece[at + k - 1]]
    for j in range(1, k):
        at = at[good[at + j]]
    return at


def _hash(w, at, k: int):
    h = w[at]
    for j in range(1, k):
        h = longer(h, w[at + j])
    return h


def _count_extensions(known: Bitmap, frontier: Bitmap, open_: Bitmap, k: int):
    """Of the phrases of ``k`` words whose first ``k`` - 1 are of the frontier: ``h, p`` (those ``k`` - 1), ``w`` (the last), ``g, c``."""

    def run(batches):
        held = _Held(["h", "p", "w", "g", "c"])
        for g, w, row, piece, _ in _each(batches, open_):
            at = _positions(w, piece, known, k)
            p = _hash(w, at, k - 1)
            some = frontier(p)
            at, p = at[some], p[some]
            held.add(h=longer(p, w[at + k - 1]), p=p, w=w[at + k - 1], g=g[row[at]], c=np.ones(len(at), dtype=np.int64))
            yield from held.out()
        yield from held.out(last=True)

    return run


def _count_asked(known: Bitmap, asked: Bitmap, open_: Bitmap):
    """Of the phrases asked for (2 to 4 words): counts, and the least and greatest hash of the words before and after, 0 where there is none in the piece."""

    def run(batches):
        held = _Held(["h", "c", "l0", "l1", "r0", "r1"], ("l0", "r0"), ("l1", "r1"))
        for _, w, _, piece, _ in _each(batches, open_):
            for k in range(2, LONGEST):
                at = _positions(w, piece, known, k)
                h = _hash(w, at, k)
                some = asked(h)
                at, h = at[some], h[some]
                before = np.where((at > 0) & (piece[at - 1] == piece[at]), w[at - 1], 0).view(np.int64)
                next_ = np.minimum(at + k, len(w) - 1)
                after = np.where((at + k < len(w)) & (piece[next_] == piece[at]), w[next_], 0).view(np.int64)
                held.add(h=h, c=np.ones(len(at), dtype=np.int64), l0=before, l1=before, r0=after, r1=after)
            yield from held.out()
        yield from held.out(last=True)

    return run


def _spell(known: Bitmap, asked: Bitmap):
    """``h, phrase`` of the phrases asked for, once a task each."""

    def run(batches):
        import pyarrow as pa

        seen = np.zeros(0, dtype=np.uint64)
        for _, w, row, piece, texts in _each(batches):
            found = {}
            for k in range(2, LONGEST + 1):
                at = _positions(w, piece, known, k)
                h = _hash(w, at, k)
                some = asked(h)
                h, first = np.unique(h[some], return_index=True)
                new = ~np.isin(h, seen)
                seen = np.union1d(seen, h[new])
                for x, i in zip(h[new].tolist(), at[some][first][new].tolist()):
                    found.setdefault(int(row[i]), []).append((x, i, k))
            hashes, phrases = [], []
            for r, places in found.items():
                tokens, start = TOKEN.findall(texts[r].encode("utf-8", "replace").lower()), int(np.searchsorted(row, r))
                for x, i, k in places:
                    hashes.append(x)
                    phrases.append(b" ".join(tokens[i - start : i - start + k]).decode("utf-8", "replace"))
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)), pa.array(phrases, pa.string())], names=["h", "phrase"])

    return run


def _tails(batches):
    """Of each phrase, a row for each cut: the hash of what follows the first ``k`` words."""
    import pyarrow as pa

    for batch in batches:
        words = batch.column("words").to_pylist()
        own, cut, tail = [], [], []
        by_length: dict[int, list[int]] = {}
        for i, x in enumerate(words):
            by_length.setdefault(len(x), []).append(i)
        for m, rows in by_length.items():
            w = np.array([words[i] for i in rows], dtype=np.int64).view(np.uint64)
            for k in range(1, m):
                h = w[:, k]
                for j in range(k + 1, m):
                    h = longer(h, w[:, j])
                own.append(np.array(rows)), cut.append(np.full(len(rows), k)), tail.append(h)
        if own:
            rows = pa.array(np.concatenate(own))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("h", "g", "a", "heads")), pa.array(np.concatenate(cut).astype(np.int32)), pa.array(np.ascontiguousarray(np.concatenate(tail)).view(np.int64))], names=["h", "g", "a", "heads", "k", "tail"])


def _grow(texts: DataFrame, known: Bitmap, open_: Bitmap, firsts: DataFrame, least: int) -> DataFrame:
    """``h, g, m, words, heads, a``: the frequent phrases of 2 to 5 words that begin with one of ``firsts`` (``h, g, c``); ``heads`` are the counts of their own first 1, 2, ... words."""
    level = firsts.select("h", "g", F.lit(1).alias("m"), F.array("h").alias("words"), F.array().cast("array<long>").alias("heads"), F.col("c").alias("a"))
    grown = []
    for k in range(2, LONGEST + 1):
        counted = texts.mapInArrow(_count_extensions(known, bitmap(level), open_, k), "h long, p long, w long, g long, c long")
        counted = counted.groupBy("h", "p", "w", "g").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
        above = level.select(F.col("h").alias("p"), "words", "heads", F.col("a").alias("above"))
        level = stage(counted.join(above.hint("merge"), "p").select("h", "g", F.lit(k).alias("m"), F.concat("words", F.array("w")).alias("words"), F.concat("heads", F.array("above")).alias("heads"), F.col("c").alias("a")), "phrases")
        grown.append(level)
        if level.isEmpty():
            break
    out = grown[0]
    for x in grown[1:]:
        out = out.unionByName(x)
    return out


def _scored(texts: DataFrame, known: Bitmap, open_: Bitmap, words: DataFrame, totals: DataFrame, phrases: DataFrame) -> DataFrame:
    """``h, g, a, l, r, n, score`` of those of ``phrases`` that no longer candidate of the same count holds."""
    cuts = stage(phrases.select("h", "g", "a", "words", "heads").mapInArrow(_tails, "h long, g long, a long, heads array<long>, k int, tail long"), "cuts")
    asked = cuts.filter("k < size(heads)").select(F.col("tail").alias("h")).unionByName(phrases.filter(F.col("m") < LONGEST).select("h")).distinct()
    met = texts.mapInArrow(_count_asked(known, bitmap(asked), open_), "h long, c long, l0 long, l1 long, r0 long, r1 long")
    met = stage(met.groupBy("h").agg(F.sum("c").alias("c"), F.min("l0").alias("l0"), F.max("l1").alias("l1"), F.min("r0").alias("r0"), F.max("r1").alias("r1")), "asked")
    # One word that always stands before or after makes a longer candidate of the same count.
    inner = met.filter("l0 = l1 and l0 != 0 or r0 = r1 and r0 != 0").select("h")
    tails = met.select(F.col("h").alias("tail"), F.col("c").alias("r")).unionByName(words.select(F.col("h").alias("tail"), F.col("c").alias("r")))
    left = cuts.join(inner.hint("merge"), "h", "left_anti")
    both = left.withColumn("l", F.element_at("heads", F.col("k"))).join(tails.hint("merge"), "tail").join(totals.hint("merge"), "g")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    both = both.select("h", "g", "a", "n", "k", "l", "r").withColumns({"top": F.lit(1000).cast("decimal(38,0)") * wide("a") * wide("n"), "below": wide("l") * wide("r")})
    score = F.expr("top div below")
    best = both.groupBy("h", "g", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("h", "g", "a", "cut.l", "cut.r", "n", "cut.score")


def _settled(found: DataFrame, top: int) -> DataFrame:
    """``g, floor``: the ``top``-th score, in languages that have as many."""
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score")))
    return found.select("g", "score", place.alias("place")).filter(F.col("place") <= top).filter(F.col("place") == top).select("g", F.col("score").alias("floor"))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, batch: float = 0.25, growth: float = 4) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: of each language (null: ``und``) the first ``top`` candidates by score, count and phrase.

    A-Z are lower-cased; texts (null: empty) are split at ``. , ; : ! ?`` and line ends into pieces, those at blanks and tabs into words. A candidate has 2 to 5 words of one piece and is found
    ``least`` times or more, overlaps included. Its score is that of its lowest cut (ties: the shortest first part), in exact integers. One that lies in a longer candidate of the same count is dropped.
    First words that make up the rarest ``batch`` of a language's word occurrences are expanded first, then those up to ``growth`` times that, and so on; neither changes a result. Repeated rows count each time, very long texts whole; doc_id and other columns are
    not read. An empty table gives an empty one. Words are told apart by 64-bit hashes.
    """
    spark: SparkSession = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = docs.select(F.xxhash64(lang).alias("g"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_count_words, "h long, g long, c long").groupBy("h", "g").agg(F.sum("c").alias("c"))
    counted = stage(counted.filter((F.col("c") >= least) | (F.col("h") == F.col("g"))), "words")
    totals, words = counted.filter("h = g").select("g", F.col("c").alias("n")), counted.filter("h != g")
    known = bitmap(words)
    # The rarest first words have the highest bounds. ``below``: the share of all word occurrences that begin with a rarer one, which is what counting them costs.
    below = F.sum(F.col("m") * F.col("c")).over(Window.partitionBy("g").orderBy("c").rowsBetween(Window.unboundedPreceding, -1))
    steps = words.groupBy("g", "c").agg(F.count(F.lit(1)).alias("m")).withColumn("before", F.coalesce(below, F.lit(0))).join(totals.hint("merge"), "g")
    steps = stage(steps.select("g", "c", (F.col("before") / F.col("n")).alias("below"), F.expr(f"{1000}L * n div c").alias("bound")), "steps")
    waiting = words.join(steps.hint("merge"), ["g", "c"])
    found, floors, done = None, spark.createDataFrame([], "g long, floor long"), -1.0
    while done < 1:
        open_ = F.col("bound") >= F.coalesce("floor", F.lit(0))
        firsts = stage(waiting.filter((F.col("below") >= done) & (F.col("below") < batch)).join(floors.hint("merge"), "g", "left").filter(open_).select("h", "g", "c"), "frontier")
        done, batch = batch, batch * growth
        if firsts.isEmpty():
            continue
        open_ = bitmap(firsts.select(F.col("g").alias("h")).distinct())
        now = stage(_scored(texts, known, open_, words, totals, _grow(texts, known, open_, firsts, least)), "scored")
        found = now if found is None else found.unionByName(now)
        floors = stage(_settled(found, top), "floors")
    if found is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    ahead = F.rank().over(Window.partitionBy("g").orderBy(F.desc("score"), F.desc("a")))
    first = stage(found.withColumn("ahead", ahead).filter(F.col("ahead") <= top).drop("ahead"), "first")
    spelled = texts.mapInArrow(_spell(known, bitmap(first.select("h"))), "h long, phrase string").groupBy("h").agg(F.min("phrase").alias("phrase"))
    names = docs.select(lang.alias("lang")).distinct().withColumn("g", F.xxhash64("lang"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    out = first.join(spelled.hint("merge"), "h").join(names.hint("merge"), "g").withColumn("rank", rank).filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
