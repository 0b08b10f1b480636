"""Streaming forms of the panel operators: bars with a watermark, ingest once per id, and folds over each key's events in order of time."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Groups of keys whose state is one: enough for every core, few enough that a call handles many keys.
BUCKETS = 1024


def source(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The events at ``path`` as a stream, ``files`` of them in a micro-batch (all, if not given); ``ts`` becomes a timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    # As a pattern, since a stream's plain path must be a folder and a table may be one file.
    reader = spark.readStream.schema(schema) if files is None else spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.parquet(f"{folder}/{{{name}}}").withColumn("ts", F.col("ts").cast("timestamp"))


def bars(events: DataFrame, width: str, late: str) -> DataFrame:
    """Open, high, low, close and count by event type and window. A window comes out once the watermark has passed its end; rows after that are dropped."""
    at = F.struct("ts", "event_id")
    g = events.filter("value is not null").withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("symbol"))
    out = g.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume"))
    return out.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("bar_ts"), "open", "high", "low", "close", "volume")


def once(events: DataFrame, key: str, late: str) -> DataFrame:
    """The first row of each key; state of keys older than the watermark is let go."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def in_order(events: DataFrame, key: str, columns: list[str], late: str, fold: Callable, out: str, idle: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``fold(key, own, rows) -> (own, results)`` over each key's events in order of (``ts``, ``event_id``), whatever batches they came in; ``rows`` are tuples of ``columns``, ``results`` tuples of the schema ``out``.

    Keys are dealt to ``buckets``, whose state is kept and called for as one, since a call costs more than most keys' events. State of a bucket: its keys' events at or after the watermark, which runs ``late`` behind the
    newest event, and each key's ``own``, anything that JSON holds (None at first). An event is folded once the watermark has
    passed it: by then nothing earlier can come, since events behind the watermark are dropped. A timer at the bucket's first waiting event releases it without new data. Results are thus a function of the events alone, but for dropped ones.
    With ``idle`` (milliseconds), a key that is silent for longer starts anew, and its state goes when the watermark shows it. Rows without key or time take no part. A task holds a bucket's events of one
    micro-batch and of the last ``late``; the source's files a batch bound that.
    """
    names = [c.split()[0] for c in out.split(", ")]
    place = columns.index("event_id") + 2

    def step(_, chunks, state):
        watermark, waiting, owns = state.getCurrentWatermarkMs(), [], {}
        if state.exists:
            buffer, text = state.get
            waiting = json.loads(buffer)
            owns = {k: (own, last) for k, own, last in json.loads(text)}
        if not state.hasTimedOut:
            for chunk in chunks:
                waiting.extend(zip(*[chunk[c].tolist() for c in ("__key", "__at", *columns)]))
        ready, rest = {}, []
        for e in waiting:
            if e[1] // 1000 < watermark:
                ready.setdefault(e[0], []).append(e)
            else:
                rest.append(e)
        results = []
        for k, mine in ready.items():
            mine.sort(key=lambda e: (e[1], e[place]))
            own, last = owns.get(k, (None, None))
            part = []
            for e in mine:
                if idle is not None and last is not None and e[1] - last > idle * 1000:
                    if part:
                        results.extend(fold(k, own, part)[1])
                    own, part = None, []
                part.append(e[2:])
                last = e[1]
            own, found = fold(k, own, part)
            results.extend(found)
            owns[k] = (own, last)
            if len(results) > 50_000:
                yield pd.DataFrame(results, columns=names)
                results = []
        if results:
            yield pd.DataFrame(results, columns=names)
        if idle is not None:
            held = {e[0] for e in rest}
            owns = {k: v for k, v in owns.items() if k in held or v[1] // 1000 + idle >= watermark}
        if not rest and not owns:
            state.remove()
            return
        state.update((json.dumps(rest), json.dumps([(k, *v) for k, v in owns.items()])))
        timers = [min(e[1] for e in rest) // 1000] if rest else []
        if idle is not None:
            timers += [last // 1000 + idle + 1 for _, last in owns.values()]
        if timers:
            state.setTimeoutTimestamp(max(min(timers), watermark, 1))

    known = events.filter(f"{key} is not null and ts is not null").withWatermark("ts", late)
    narrow = known.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("__bucket"), F.col(key).alias("__key"), "ts", F.unix_micros("ts").alias("__at"), *columns)
    return narrow.groupBy("__bucket").applyInPandasWithState(step, out, "buffer string, owns string", "append", "EventTimeTimeout")


def jumps(events: DataFrame, share: float, late: str, idle: int | None = None) -> DataFrame:
    """Values that differ from their user's last one by at least ``share`` of it. State per user: that last value."""

    def fold(key, own, rows):
        out = []
        for event, value in rows:
            if own is not None and abs(value - own) >= share * abs(own):
                out.append((key, event, value, own))
            own = value
        return own, out

    return in_order(events.filter("value is not null"), "user_id", ["event_id", "value"], late, fold, "user_id long, event_id long, value double, was double", idle)


def transition_signals(events: DataFrame, low: float, high: float, stride: int, late: str, key: str = "event_type") -> DataFrame:
    """``symbol, event_id, state, signal`` of every event: its label by value (0 under ``low``, 2 from ``high`` on, else 1), and (to 2 minus to 0) over all transitions ``stride`` events apart that have left this label so far; 0 before any.

    State per ``key``: the last ``stride`` labels and nine counters, however long the stream."""

    def fold(symbol, own, rows):
        ring, counts = own or ([], [0] * 9)
        out = []
        for event, v in rows:
            s = 0 if v < low else 2 if v >= high else 1
            if len(ring) == stride:
                counts[3 * ring.pop(0) + s] += 1
            ring.append(s)
            row = counts[3 * s : 3 * s + 3]
            out.append((symbol, event, s, (row[2] - row[0]) / sum(row) if sum(row) else 0.0))
        return (ring, counts), out

    kind = events.schema[key].dataType.simpleString()
    return in_order(events.filter("value is not null"), key, ["event_id", "value"], late, fold, f"symbol {kind}, event_id long, state int, signal double")


def lifecycle_violations(events: DataFrame, allowed: dict[str, tuple[str, ...]], late: str, idle: int | None = None) -> DataFrame:
    """``user_id, event_id, was, event_type`` of events that may not follow their user's last one. State per user: that last status."""

    def fold(key, own, rows):
        out = []
        for event, kind in rows:
            if own is not None and kind not in allowed.get(own, ()):
                out.append((key, event, own, kind))
            own = kind
        return own, out

    return in_order(events.filter("event_type is not null"), "user_id", ["event_id", "event_type"], late, fold, "user_id long, event_id long, was string, event_type string", idle)


def drawdown_breaker(events: DataFrame, start: float, cost: float, limit: float, late: str) -> DataFrame:
    """``user_id, event_id, nav, peak, tripped``: net asset value from ``start``, moved by value minus ``cost`` at every event, against its peak. State per user: value and peak.

    Tripped is told in whole numbers, from value and peak in millionths: a value at exactly the limit has not passed it, whatever the last digits of sums in doubles are."""
    kept = 1 - Fraction(limit).limit_denominator(10_000)
    up, down = kept.numerator, kept.denominator

    def fold(key, own, rows):
        nav, peak = own or (start, start)
        out = []
        # Added one by one from the state, so that batches don't change the last digit.
        for event, value in rows:
            nav += value - cost
            peak = max(peak, nav)
            whole = math.isfinite(nav) and math.isfinite(peak)
            out.append((key, event, nav, peak, round(nav * 1e6) * down < round(peak * 1e6) * up if whole else nav < peak))
        return (nav, peak), out

    return in_order(events.filter("value is not null"), "user_id", ["event_id", "value"], late, fold, "user_id long, event_id long, nav double, peak double, tripped boolean")


def pair_signals(events: DataFrame, i: str, j: str, mean: float, sd: float, enter: float, leave: float, late: str) -> DataFrame:
    """``user_id, event_id, z, held, action`` of every event of the types ``i`` and ``j`` once both have been seen: the spread of their last values, and the pair's state before the event.

    Enter beyond ``enter`` deviations on that side, exit across the mean or within ``leave``; the rule of the batch fold, without a horizon. State per user: two values and a side."""

    def fold(key, own, rows):
        x, y, pos = own or (None, None, 0)
        out = []
        for event, kind, value in rows:
            x, y = (value, y) if kind == i else (x, value)
            if x is None or y is None:
                continue
            z = (x - y - mean) / sd
            side, was = (z > 0) - (z < 0), pos
            if pos == 0:
                pos = side if abs(z) > enter else 0
                action = "ENTER" if pos else "HOLD"
            else:
                pos = 0 if side != pos or abs(z) <= leave else pos
                action = "HOLD" if pos else "EXIT"
            out.append((key, event, z, was, action))
        return (x, y, pos), out

    known = events.filter("value is not null").filter(F.col("event_type").isin(i, j))
    return in_order(known, "user_id", ["event_id", "event_type", "value"], late, fold, "user_id long, event_id long, z double, held int, action string")


def ingest_once(stream: DataFrame, key: str, ledger: str, state: str) -> DataFrame:
    """Appends what ``stream`` has to the ``ledger`` (parquet), each value of ``key`` once for good: a batch meets the keys stored in its own range, so copies that come in any later batch, a batch
    repeated after a failure, or a replay of everything with a new ``state`` (checkpoint) add nothing. Of copies within a batch the least row counts; rows without a key are not taken. The ledger as it is then.

    Files of the ledger hold ranges of keys in order, so the lookup reads row groups of the batch's range alone."""
    spark, schema = stream.sparkSession, stream.schema
    spark.createDataFrame([], schema).write.mode("ignore").parquet(ledger)

    def take(batch: DataFrame, number: int) -> None:
        one = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*schema.names)).alias("r")).select("r.*").persist()
        try:
            lo, hi = one.agg(F.min(key), F.max(key)).first()
            if lo is not None:
                known = batch.sparkSession.read.schema(schema).parquet(ledger).filter(F.col(key).between(lo, hi)).select(key)
                one.join(known.hint("merge"), key, "left_anti").select(*schema.names).repartitionByRange(key).sortWithinPartitions(key).write.mode("append").parquet(ledger)
        finally:
            one.unpersist()

    stream.writeStream.foreachBatch(take).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(ledger)


def settled(stream: DataFrame, name: str) -> DataFrame:
    """Runs ``stream`` over all that is there (checkpointed, restartable), then reads what it wrote."""
    spark = stream.sparkSession
    at = shared_folder(spark, f"live-{name}")
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
