"""Series of any length: running values, exponential averages and as-of joins whose work is cut into blocks of time.

A window over a whole series is one task. Here every (key, block of time) is a group of its own: each folds its rows, its total is one row, totals are carried over the blocks of a key
(few rows: the series' length by ``per_block``), and every block adds what came before it. One key with most rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import staged

PER_BLOCK = 50_000


def number(rows: DataFrame, at: str) -> Column:
    """A long that orders as the column ``at`` does: microseconds of timestamps, days of dates, integers as they are."""
    kind = rows.schema[at].dataType.simpleString()
    if kind == "timestamp":
        return F.unix_micros(at)
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{at}`)")
    return F.unix_date(at).cast("long") if kind == "date" else F.col(at).cast("long")


def blocked(rows: DataFrame, by: list[str], at: str, per_block: int = PER_BLOCK) -> DataFrame:
    """``rows``, written once, with ``__b``: a block of time (by ``at``) so wide that the longest series has about ``per_block`` rows in each. Rows of one time share a block."""
    t = number(rows, at)
    rows = staged(rows.withColumn("__t", t), "series")
    most, lo, hi = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("__t").alias("lo"), F.max("__t").alias("hi")).agg(F.max("n"), F.min("lo"), F.max("hi")).first()
    width = 1 if lo is None else max(1, -(-(hi - lo + 1) // max(1, -(-most // per_block))))
    return rows.withColumn("__b", F.floor((F.col("__t") - F.lit(lo or 0)) / F.lit(width)).cast("long")).drop("__t")


def _met(rows: DataFrame, per_block: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the one row of their block; null keys are a key."""
    names = {c: f"__k_{c}" for c in [*by, "__b"]}
    other = per_block.withColumnsRenamed(names)
    same = None
    for c, o in names.items():
        one = rows[c].eqNullSafe(other[o])
        same = one if same is None else same & one
    return rows.join(other.hint("merge"), same, "left").drop(*names.values())


def running(rows: DataFrame, by: list[str], order: list[str], columns: dict[str, tuple[str, Column]], per_block: int = PER_BLOCK) -> DataFrame:
    """Adds to each row, for ``name: (kind, value)``, the value over all rows of its key up to it in ``order`` (blocks go by its first column): ``sum``, ``product``, ``max``, ``min``, ``last`` (not null), or ``lag``, the value of the row before."""
    rows = blocked(rows.withColumns({f"__v_{n}": v for n, (_, v) in columns.items()}), by, order[0], per_block)
    place = F.struct(*order)
    inside = Window.partitionBy(*by, "__b").orderBy(*order)
    here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    folds = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min}
    joins = {"sum": lambda a, b: F.coalesce(a + b, a, b), "product": lambda a, b: F.coalesce(a * b, a, b), "max": F.greatest, "min": F.least, "last": F.coalesce}
    own, totals, carried, out = {}, [], [], {}
    for n, (kind, _) in columns.items():
        v, t = F.col(f"__v_{n}"), f"__t_{n}"
        if kind == "lag":
            own[f"__o_{n}"] = F.struct(F.lag(v).over(inside).alias("v"), F.row_number().over(inside).alias("k"))
            totals.append(F.max_by(F.struct(v.alias("v")), place).alias(t))
            carried.append(F.last(t, ignorenulls=True).over(earlier).alias(f"__c_{n}"))
            out[n] = F.when(F.col(f"__o_{n}.k") > 1, F.col(f"__o_{n}.v")).otherwise(F.col(f"__c_{n}.v"))
            continue
        last = kind == "last"
        own[f"__o_{n}"] = F.last(v, ignorenulls=True).over(here) if last else folds[kind](v).over(here)
        totals.append((F.max_by(v, F.when(v.isNotNull(), place)) if last else folds[kind](v)).alias(t))
        carried.append((F.last(t, ignorenulls=True) if last else folds[kind](t)).over(earlier).alias(f"__c_{n}"))
        out[n] = joins[kind](F.col(f"__o_{n}"), F.col(f"__c_{n}"))
    carry = rows.groupBy(*by, "__b").agg(*totals).select(*by, "__b", *carried)
    return _met(rows.withColumns(own), carry, by).withColumns(out).drop("__b", *own, *[f"__v_{n}" for n in columns], *[f"__c_{n}" for n in columns])


def drawdowns(rows: DataFrame, ret: str, by: list[str], order: list[str], per_block: int = PER_BLOCK) -> DataFrame:
    """Adds ``growth`` (the running product of 1 + ``ret``), its running ``peak`` and ``dd``, growth over peak minus 1."""
    grown = running(rows, by, order, {"growth": ("product", 1 + F.col(ret))}, per_block)
    return running(grown, by, order, {"peak": ("max", F.col("growth"))}, per_block).withColumn("dd", F.col("growth") / F.col("peak") - 1)


def exponential(rows: DataFrame, value: str, weight: float, by: list[str], order: list[str], out: str, per_block: int = PER_BLOCK) -> DataFrame:
    """Adds ``out``: the exponential average s = (1 - weight) s + weight value over all rows of the key so far, seeded by its first value, however far back; a null leaves it as it is (null before any).

    A block is folded from 0 by its own task, with the number of values so far. What came before it weighs (1 - weight)^number, so blocks are joined by one number each."""
    rows = blocked(rows, by, order[0], per_block)
    keep = 1.0 - weight
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def fold(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by([(c, "ascending") for c in order])
        x = table.column(value).to_pandas().astype(float)
        zero = np.concatenate([[0.0], x.to_numpy()])
        from pandas import Series

        own = Series(zero).ewm(alpha=weight, adjust=False, ignore_na=True).mean().to_numpy()[1:]
        seen = np.cumsum(~np.isnan(x.to_numpy()))
        return table.append_column("__own", pa.array(own)).append_column("__n", pa.array(seen.astype(np.int64)))

    def carried(frame):
        """The state before each block of one key: of the earlier blocks, or, before any value, this block's first."""
        frame, state, states, known = frame.sort_values("__b"), None, [], []
        for end, n, first in zip(frame["__own"], frame["__n"], frame["__first"]):
            before = state if state is not None else first
            states.append(before), known.append(state is not None)
            state = end + keep**n * before if n else state
        frame["__s"], frame["__known"] = states, known
        return frame[[*by, "__b", "__s", "__known"]]

    inside = staged(rows.groupBy(*by, "__b").applyInArrow(fold, f"{fields}, __own double, __n long"), "folds")
    place = F.struct(*order)
    ends = inside.groupBy(*by, "__b").agg(F.max_by("__own", place).alias("__own"), F.max("__n").alias("__n"), F.min_by(value, F.when(F.col(value).isNotNull(), place)).cast("double").alias("__first"))
    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    starts = ends.groupBy(*by).applyInPandas(carried, f"{keys}, __b long, __s double, __known boolean")
    joined = F.col("__own") + F.pow(F.lit(keep), F.col("__n")) * F.col("__s")
    return _met(inside, starts, by).withColumn(out, F.when(F.col("__known") | (F.col("__n") > 0), joined)).drop("__b", "__own", "__n", "__s", "__known")


def asof(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, take: list[str], forward: bool = False, strict: bool = False, tolerance: int | None = None, per_block: int = PER_BLOCK) -> DataFrame:
    """``left`` with the columns ``take`` of the row of ``right`` of the same ``by`` that is the last at or before it (``forward``: the first at or after; ``strict``: not at the same time), within ``tolerance`` (in the unit of ``number``) if given.

    Both sides are one series per key, and the last value of ``right`` is carried over its blocks; no pair of rows is formed. Of several ``right`` rows of one time, the greatest (``forward``: the smallest)
    in the order of ``take`` counts. Rows of ``left`` without a match, a key or a time have nulls; every one comes out once, repeated ones too. ``take`` must not name a column of ``left``."""
    sign = -1 if forward else 1
    known = lambda c: F.greatest(*[F.col(k).isNull().cast("int") for k in [*by, c]], F.lit(0)) == 0
    keys = [f"__by{i}" for i in range(len(by))]
    place = lambda side: [F.col(c).alias(k) for c, k in zip(by, keys)] + [(number(side, left_at if side is left else right_at) * sign).alias("__at")]
    values = F.struct(*take, (number(right, right_at) * sign).alias("__when"))
    own = F.struct(*left.columns)
    a = left.filter(known(left_at)).select(*place(left), F.lit(0 if strict else 1).alias("__side"), F.lit(0).cast("long").alias("__tie"), own.alias("__l"), F.lit(None).cast(right.select(values.alias("v")).schema["v"].dataType).alias("__r"))
    order = Window.partitionBy(*by, right_at).orderBy(*[F.col(c).desc() if forward else F.col(c) for c in take])
    b = right.filter(known(right_at)).withColumn("__tie", F.row_number().over(order).cast("long"))
    b = b.select(*place(right), F.lit(1 if strict else 0).alias("__side"), "__tie", F.lit(None).cast(left.select(own.alias("l")).schema["l"].dataType).alias("__l"), values.alias("__r"))
    both = running(a.unionByName(b), keys, ["__at", "__side", "__tie"], {"__m": ("last", F.col("__r"))}, per_block).filter(F.col("__side") == (0 if strict else 1))
    near = F.lit(True) if tolerance is None else F.col("__at") - F.col("__m.__when") <= tolerance
    out = both.select("__l.*", *[F.when(near, F.col(f"__m.{c}")).alias(c) for c in take])
    kinds = dict(out.dtypes)
    return out.unionByName(left.filter(~known(left_at)).withColumns({c: F.lit(None).cast(kinds[c]) for c in take}))


def order_statistics(rows: DataFrame, by: list[str], order: list[str], value: str, n: int, median: str, share: str, per_block: int = PER_BLOCK) -> DataFrame:
    """Adds, over the last ``n`` rows of the key in ``order``, the ``median`` of ``value`` and the ``share`` of its values that are at most this row's; null where the window has fewer rows or a null.

    Rows are numbered by a running count and cut into blocks of ``per_block`` places (``n`` at least); a block also gets the ``n`` - 1 rows before it, so each row is shipped twice at most. Inside a block the
    window is a structure sorted as it moves, so a row costs the logarithm of the window, not its length. ``order`` must tell the rows of a key apart."""
    size = max(per_block, n)
    numbered = running(rows, by, order, {"__k": ("sum", F.lit(1).cast("long"))}, per_block)
    block = F.floor((F.col("__k") - 1) / size).cast("long")
    # The last n - 1 rows of a block are also the next one's first.
    tail = (F.col("__k") - 1) % size >= size - (n - 1)
    blocks = F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))
    shipped = numbered.withColumn("__own", block).withColumn("__b", F.explode(blocks))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    names = list(rows.columns)

    def rolled(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.sort_by([("__k", "ascending")])
        window = table.column(value).to_pandas().astype(float).rolling(n, min_periods=n)
        table = table.append_column("__med", pa.array(window.median(), pa.float64(), from_pandas=True)).append_column("__share", pa.array(window.rank(method="max", pct=True), pa.float64(), from_pandas=True))
        return table.filter(pc.equal(table.column("__own"), table.column("__b"))).select([*names, "__med", "__share"])

    out = shipped.groupBy(*by, "__b").applyInArrow(rolled, f"{fields}, __med double, __share double")
    return out.withColumnsRenamed({"__med": median, "__share": share})
