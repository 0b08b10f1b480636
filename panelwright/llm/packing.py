"""Best-fit packing of tokenised documents into fixed-length sequences.

The instance is a histogram: how many pieces have each length, at most ``capacity`` numbers however many documents there are. Dominance
reduction in the manner of Martello and Toth fixes small sets of lengths that can replace any other set with the same item, best fit by
decreasing length places the rest, both on run lengths. The plan (sets of lengths and how often each occurs) goes back to Spark, where
every piece finds its place by its rank among the pieces of its length, a distributed prefix count.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL, running_before, stage

Groups = list[tuple[tuple[tuple[int, int], ...], int]]  # (((length, times), ...), how many sequences)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[Groups, dict[int, int]]:
    """Sets that are fixed for good, and the counts that remain. A set with item j is fixed if it dominates every feasible set with j:

    - j alone, if nothing fits beside it;
    - j and k, if they fill the sequence: whatever else could lie beside j fits into k's place;
    - j and k, k the longest that fits, if no two others fit beside j, or if any two that do are together no longer than k.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    fixed: Groups = []

    def fix(items: tuple[int, ...], times: int) -> None:
        fixed.append((tuple((s, 1) for s in items), times))
        for s in items:
            left[s] -= times
            if not left[s]:
                del left[s]

    def partner(j: int) -> int | None:
        """The k that {j, k} is fixed with; 0: j alone; None: nothing is proved."""
        room = capacity - j
        others = sorted(s for s in left if s <= room and (s != j or left[j] > 1))
        if not others:
            return 0
        k = others[-1]
        if k == room:
            return k
        spare = lambda s: left[s] - (s == j)
        smallest = [others[0], others[0] if spare(others[0]) > 1 else (others[1] if len(others) > 1 else capacity)]
        if sum(smallest) > room:
            return k
        triple = sorted(s for x in others[:3] for s in [x] * min(3, spare(x)))[:3]
        if len(triple) == 3 and sum(triple) <= room:
            return None
        best = 0
        for a in others:
            at = bisect_left(others, room - a + 1) - 1
            while at >= 0 and others[at] == a and spare(a) < 2:
                at -= 1
            if at >= 0:
                best = max(best, a + others[at])
        return k if best <= k else None

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while j in left and (k := partner(j)) is not None:
                changed = True
                if k == 0:
                    fix((j,), left[j])
                elif k == j:
                    fix((j, j), left[j] // 2)
                else:
                    fix((j, k), min(left[j], left[k]))
    return fixed, left


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Groups:
    """Longest first, each into the open sequence with the least room that takes it; equal sequences are handled together."""
    by_room: dict[int, Groups] = {}
    rooms: list[int] = []

    def put(items: tuple, times: int, room: int) -> None:
        if times:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append((items, times))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                items, times, room = (), n, capacity  # as many new ones as needed
            else:
                room = rooms[at]
                items, times = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            each = min(room // s, n)
            take = min(times, n // each)
            put((*items, (s, each)), take, room - each * s)
            if items:
                put(items, times - take, room)
            n -= take * each
    return [g for groups in by_room.values() for g in groups]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first_rank, n, first_sequence, offset): the pieces of this length with ranks first_rank ... + n - 1 lie at ``offset`` of the sequences from first_sequence on."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    slots, used, sequence = [], dict.fromkeys(counts, 0), 0
    for items, times in [*fixed, *best_fit_decreasing(rest, capacity)]:
        offset = 0
        for s, each in items:
            for _ in range(each):
                slots.append((s, used[s], times, sequence, offset))
                used[s] += times
                offset += s
        sequence += times
    assert used == counts
    return slots


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``): each text's ids and the end id, cut from the end into pieces of ``capacity``, so that only the first may be shorter."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        from .tokens import encoded

        for batch, ids in encoded(batches, tokenizer, end_id):
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for r, b in enumerate(ids):
                n, at, k = len(b) // 4, 0, 0
                while at < n:
                    step = (n % capacity if k == 0 else 0) or min(capacity, n)
                    part = b[4 * at : 4 * (at + step)]
                    rows.append(r), piece.append(k), start.append(at), length.append(step), crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(np.frombuffer(part, dtype="<i4"))
                    at, k = at + step, k + 1
            own = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(rows, pa.int64()))
            arrays = [own, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``, gapless from 0 in each sequence.

    Null and empty texts are the end id alone. Null or repeated doc_ids and equal texts are packed like all others, every row once; other
    columns are not read. An empty table gives an empty one. Reruns give each piece of equal doc_id and content an equal or interchangeable place.
    """
    pieces = stage(tokenized_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    planned = plan(counts, capacity)
    slots = pieces.sparkSession.createDataFrame(planned, "length long, __lo long, __n long, __seq long, offset long")
    keyed = pieces.withColumn("__key", F.xxhash64("doc_id", "piece", "ids_crc32"))
    ranked = running_before(keyed, "length", "__key", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], F.lit(1).cast("long"), "__rank")
    # The plan's size follows from the capacity, not from the documents: some 10,000 slots for 2048. A larger one (of a large capacity) is not broadcast.
    here = F.broadcast(slots) if len(planned) <= SMALL else slots.hint("shuffle_hash")
    placed = ranked.join(here, (ranked["length"] == slots["length"]) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__lo") + F.col("__n")))
    out = placed.withColumn("sequence_id", F.col("__seq") + F.col("__rank") - F.col("__lo")).drop(slots["length"])
    return out.select(*pieces.columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids`` from ``pack(..., with_ids=True)``: the training rows themselves."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
