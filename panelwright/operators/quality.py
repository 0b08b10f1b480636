"""Data quality: artifacts, anomalies, gates, filling, filters, fingerprints."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import asof
from .windows import by_time


def split_artifacts(bars: DataFrame) -> DataFrame:
    """Adds ``artifact``: no volume and one price all day. A missing volume is not zero."""
    flat = F.greatest("open", "high", "low", "close") == F.least("open", "high", "low", "close")
    return bars.withColumn("artifact", F.coalesce((F.col("volume") == 0) & flat, F.lit(False)))


def anomalies(panel: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Single-bar moves of at least ``threshold``, with their direction."""
    moved = panel.withColumn("ret", F.col("close") / F.lag("close").over(by_time()) - 1)
    return moved.filter(F.abs("ret") >= threshold).select("symbol", "bar_ts", "ret", F.when(F.col("ret") < 0, "drop").otherwise("jump").alias("kind"))


def integrity_gate(panel: DataFrame, threshold: float = 0.15, min_bars: int = 10) -> DataFrame:
    """One row per symbol: bars, anomalies, nulls, and whether it passes."""
    found = anomalies(panel, threshold).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_anomalies"))
    stats = panel.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.count_if(F.col("close").isNull()).alias("n_null"))
    out = stats.join(found, "symbol", "left").withColumn("n_anomalies", F.coalesce("n_anomalies", F.lit(0)))
    return out.withColumn("passed", (F.col("n_anomalies") == 0) & (F.col("n_null") == 0) & (F.col("n_bars") >= min_bars))


def aligned(panel: DataFrame) -> DataFrame:
    """Every symbol on every date of the union calendar, closes carried forward; dates before a symbol's first bar stay null.

    ``panel`` is used three times and should be cheap to read again (written to a table first)."""
    days, symbols = panel.select("bar_ts").distinct(), panel.select("symbol").distinct()
    # The grid is the result itself. Rows of it are generated, so the join with the bars is not left to an automatic broadcast.
    grid = days.crossJoin(symbols)
    joined = grid.hint("merge").join(panel.select("symbol", "bar_ts", "close").hint("merge"), ["symbol", "bar_ts"], "left")
    w = by_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select("symbol", "bar_ts", F.last("close", ignorenulls=True).over(w).alias("close"), F.col("close").isNull().alias("filled"))


def back_filled(panel: DataFrame, column: str) -> DataFrame:
    w = by_time().rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return panel.withColumn(column, F.first(column, ignorenulls=True).over(w))


def coverage(panel: DataFrame, share: float = 0.8) -> DataFrame:
    """Symbols with at least ``share`` of all dates and only positive prices."""
    total = panel.agg(F.count_distinct("bar_ts").alias("total"))
    stats = panel.groupBy("symbol").agg(F.count("close").alias("n_bars"), F.min("close").alias("least"))
    return stats.crossJoin(F.broadcast(total)).select("symbol", "n_bars", ((F.col("n_bars") >= share * F.col("total")) & (F.col("least") > 0)).alias("kept"))


def liquidity(panel: DataFrame, bars: int = 5, percentile: float = 0.5) -> DataFrame:
    """Mean volume of each symbol's last ``bars`` bars against the interpolated percentile over symbols."""
    last = panel.withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_ts")))).filter(F.col("r") <= bars)
    means = last.groupBy("symbol").agg(F.avg("volume").alias("avg_volume"))
    cut = means.agg(F.percentile("avg_volume", percentile).alias("cutoff"))
    return means.crossJoin(F.broadcast(cut)).withColumn("liquid", F.col("avg_volume") >= F.col("cutoff"))


def backward_adjusted(panel: DataFrame, actions: DataFrame) -> DataFrame:
    """``close`` times, ``volume`` by, the product of the factors of all events that come after a bar (``actions``: symbol, event_date, factor)."""
    marked = panel.select("symbol", "bar_ts", "close", "volume").unionByName(actions.select("symbol", F.col("event_date").alias("bar_ts"), "factor"), allowMissingColumns=True)
    after = Window.partitionBy("symbol").orderBy(F.desc("bar_ts")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = F.exp(F.sum(F.ln("factor")).over(after))
    own = F.exp(F.coalesce(F.sum(F.ln("factor")).over(Window.partitionBy("symbol", "bar_ts")), F.lit(0.0)))
    return marked.withColumn("f", F.coalesce(later, F.lit(1.0)) / own).filter("close is not null").select("symbol", "bar_ts", (F.col("close") * F.col("f")).alias("close"), (F.col("volume") / F.col("f")).alias("volume"))


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """``check, key`` rows of each named frame of offending keys (column ``key``), one after the other."""
    out = None
    for name, rows in checks.items():
        part = rows.select(F.lit(name).alias("check"), F.col("key").cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def feed_health(events: DataFrame, as_of: DataFrame, fresh_hours: int = 1, stale_hours: int = 24) -> DataFrame:
    """Per feed: its last event and healthy, stale or unavailable by its age at the one row of ``as_of`` (column ``now``)."""
    last = events.groupBy(F.col("event_type").alias("feed")).agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
    age = F.timestamp_diff("SECOND", F.col("last_ts"), F.col("now"))
    state = F.when(F.col("age_s") <= 3600 * fresh_hours, "healthy").when(F.col("age_s") <= 3600 * stale_hours, "stale").otherwise("unavailable")
    return last.crossJoin(F.broadcast(as_of)).withColumn("age_s", age).withColumn("state", state).drop("now")


#: Keys and token shapes that must not be shown.
SECRET_KEYS = ("authorization", "api_?key", "secret", "password", "passwd", "credential", "private_?key", "token")
SECRET_VALUES = (r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*", r"\bsk[-_][A-Za-z0-9_-]{8,}")


#: Strings (a cut-off one runs to the end), brackets and separators, scalars, white space: every character is in one of them.
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)|[{}\[\]:,]|[^\s"{}\[\]:,]+|\s+', re.S)


def _without_secrets(text: str, key: re.Pattern, mark: str) -> str:
    """The text with what follows each sensitive key and its colon replaced: one token, or all up to the bracket that closes it or the text's end."""
    if not key.search(text):
        return text
    tokens, out, i = _TOKEN.findall(text), [], 0
    blank = lambda at: at < len(tokens) and tokens[at].isspace()
    while i < len(tokens):
        token = tokens[i]
        out.append(token)
        i += 1
        if token[0] != '"' or not key.search(token):
            continue
        colon = i + blank(i)
        value = colon + 1 + blank(colon + 1)
        if colon >= len(tokens) or tokens[colon] != ":" or value >= len(tokens) or tokens[value] in ",:}]":
            continue
        out += [*tokens[i:value], f'"{mark}"']
        i, depth = value, 0
        while i < len(tokens):
            depth += (tokens[i] in "{[") - (tokens[i] in "}]")
            i += 1
            if depth == 0:
                break
    return "".join(out)


def redacted(text, keys: tuple[str, ...] = SECRET_KEYS, values: tuple[str, ...] = SECRET_VALUES, mark: str = "***"):
    """JSON text with every value below a sensitive key replaced by ``mark``: strings with escapes, numbers, whole objects and arrays, at any depth.

    A key is sensitive if one of ``keys`` (patterns, any case) is found in it. Then whatever matches one of ``values`` is replaced wherever it stands, keyed or not. Other text stays to the character; invalid JSON is
    treated alike, a value that is cut off going to the end. Null stays null. Built-in functions can't follow brackets, so a vectorised Python function walks the tokens of those texts that name a key at all."""
    key = re.compile("|".join(keys), re.I)

    @F.pandas_udf("string")
    def walk(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: _without_secrets(x, key, mark), na_action="ignore")

    out = walk(text)
    for value in values:
        out = F.regexp_replace(out, F.lit(value), F.lit(mark))
    return out


def matrix_violations(panel: DataFrame, universe: DataFrame, min_bars: int = 10, strict: float | None = 0.15) -> DataFrame:
    """``check, symbol, n`` of what keeps a panel from use: an empty one, symbols of ``universe`` without bars, too few bars after infinite prices are dropped, and, if ``strict`` is given, moves of that size."""
    price = F.when(F.isnan("close") | (F.abs("close") == float("inf")), None).otherwise(F.col("close"))
    stats = panel.withColumn("close", price).groupBy("symbol").agg(F.count("close").alias("n"))
    row = lambda df, name: df.select(F.lit(name).alias("check"), "symbol", F.col("n").cast("long").alias("n"))
    found = row(universe.join(stats, "symbol", "left_anti").withColumn("n", F.lit(0)), "MISSING").unionByName(row(stats.filter(F.col("n") < min_bars), "TOO_FEW"))
    found = found.unionByName(row(stats.agg(F.sum("n").alias("n")).filter("coalesce(n, 0) = 0").withColumn("symbol", F.lit(None).cast("string")), "EMPTY"))
    if strict is not None:
        found = found.unionByName(row(anomalies(panel, strict).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), "ANOMALY"))
    return found


def spliced(panel: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, panel): gaps at the first bar on or after each event (``symbol, event_date``) closed by scaling all earlier closes.

    The report has ``symbol, event_date, bar_ts, ok, why, raw_move``; an event without a bar after it or before it changes nothing. Several events multiply."""
    w = by_time()
    bars = panel.select("symbol", "bar_ts", "close").withColumn("ratio", F.col("close") / F.lag("close").over(w))
    # An event takes the first bar at or after it: an as-of join, no pair of event and bar is formed.
    report = asof(events, bars, ["symbol"], "event_date", "bar_ts", ["bar_ts", "ratio"], forward=True).select(
        "symbol", "event_date", "bar_ts", F.col("ratio").isNotNull().alias("ok"),
        F.when(F.col("bar_ts").isNull(), "no bar on or after the date").when(F.col("ratio").isNull(), "no bar before it").otherwise("spliced").alias("why"), (F.col("ratio") - 1).alias("raw_move"),
    )
    factors = report.filter("ok").select("symbol", "bar_ts", (F.col("raw_move") + 1).alias("factor")).dropDuplicates(["symbol", "bar_ts"])
    later = Window.partitionBy("symbol").orderBy(F.desc("bar_ts")).rowsBetween(Window.unboundedPreceding, -1)
    own = panel.join(factors.hint("merge"), ["symbol", "bar_ts"], "left").withColumn("f", F.coalesce(F.product(F.coalesce("factor", F.lit(1.0))).over(later), F.lit(1.0)))
    return report, own.select("symbol", "bar_ts", (F.col("close") * F.col("f")).alias("close"))


def conservation(accounts: DataFrame, positions: DataFrame, reported: DataFrame, key: str, tolerance: float = 1e-4) -> DataFrame:
    """``key, symbol, rule, reported, expected`` where a reported net asset value is not cash plus positions (relative to it), or reported shares are not those of the fills."""
    worth = positions.groupBy(key).agg(F.sum(F.col("shares") * F.col("price")).alias("worth"))
    nav = accounts.join(worth, key, "left").withColumn("expected", F.col("cash") + F.coalesce("worth", F.lit(0.0)))
    nav = nav.filter(F.abs(F.col("nav") - F.col("expected")) > tolerance * F.greatest(F.lit(1.0), F.abs("nav"))).select(key, F.lit(None).cast("string").alias("symbol"), F.lit("NAV").alias("rule"), F.col("nav").alias("reported"), "expected")
    both = reported.select(key, "symbol", F.col("shares").alias("reported")).join(positions.select(key, "symbol", F.col("shares").alias("expected")), [key, "symbol"], "full_outer")
    off = F.coalesce("reported", F.lit(0.0)) - F.coalesce("expected", F.lit(0.0))
    return nav.unionByName(both.filter(F.abs(off) > 1e-6).select(key, "symbol", F.lit("SHARES").alias("rule"), "reported", "expected"))
