"""Regime labels, transition statistics and walk-forward signals. States: 0 bear, 1 sideways, 2 bull."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.maths import clip, wilson
from .windows import by_time, so_far, trailing_return


def labels(panel: DataFrame, window: int, threshold: float) -> DataFrame:
    """``symbol, bar_ts, idx, close, wret, state``; bars without a trailing return have no label and are left out."""
    r = panel.withColumn("wret", trailing_return(window)).filter("wret is not null")
    return r.select("symbol", "bar_ts", "idx", "close", "wret", F.when(F.col("wret") >= threshold, 2).when(F.col("wret") <= -threshold, 0).otherwise(1).alias("state"))


def transitions(labelled: DataFrame, stride: int = 1, mode: str = "phase") -> DataFrame:
    """``symbol, from_state, to_state, n``: pairs (t, t + stride); ``single`` keeps every stride-th bar and chains those."""
    if mode == "single":
        first = F.min("idx").over(Window.partitionBy("symbol"))
        labelled, stride = labelled.withColumn("k", F.col("idx") - first).filter(F.col("k") % stride == 0), 1
    pairs = labelled.withColumn("to_state", F.lead("state", stride).over(by_time())).filter("to_state is not null")
    return pairs.groupBy("symbol", F.col("state").alias("from_state"), "to_state").agg(F.count(F.lit(1)).alias("n"))


def matrix(counts: DataFrame) -> DataFrame:
    """All nine cells per symbol with ``n, row_total, p, unobserved``; a row never left is uniform and marked."""
    spark = counts.sparkSession
    cells = spark.range(9).select((F.col("id") / 3).cast("int").alias("from_state"), (F.col("id") % 3).cast("int").alias("to_state"))
    grid = counts.select("symbol").distinct().crossJoin(F.broadcast(cells))  # nine rows
    joined = grid.join(counts, ["symbol", "from_state", "to_state"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("symbol", "from_state"))
    return joined.withColumn("row_total", total).select("symbol", "from_state", "to_state", "n", "row_total", F.when(F.col("row_total") > 0, F.col("n") / F.col("row_total")).otherwise(F.lit(1 / 3)).alias("p"), (F.col("row_total") == 0).alias("unobserved"))


def base_rates(labelled: DataFrame) -> DataFrame:
    n = labelled.groupBy("symbol", "state").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("base", F.col("n") / F.sum("n").over(Window.partitionBy("symbol")))


def cell_stats(labelled: DataFrame, stride: int) -> DataFrame:
    """Does a cell depart from its base rate? Wilson bounds on the effective number of transitions (phase counts overlap ``stride`` times)."""
    m = matrix(transitions(labelled, stride))
    base = base_rates(labelled).select("symbol", F.col("state").alias("to_state"), "base")
    joined = m.join(base, ["symbol", "to_state"], "left").withColumn("base", F.coalesce("base", F.lit(0.0))).withColumn("n_eff", F.col("row_total") / stride)
    low, high = wilson(F.col("p"), F.col("n_eff"))
    out = joined.withColumn("lo", low).withColumn("hi", high)
    inside = (F.col("base") >= F.col("lo")) & (F.col("base") <= F.col("hi"))
    return out.select("symbol", "from_state", "to_state", "n", "row_total", "p", "n_eff", "base", (100 * (F.col("p") - F.col("base"))).alias("lift_pp"), "lo", "hi", F.coalesce(inside, F.lit(True)).alias("contains_base"), (F.col("n_eff") < 30).alias("thin"))


def walk_forward(labelled: DataFrame, stride: int, min_train: int) -> DataFrame:
    """Adds ``signal``: (bull - bear) / row total of the current state over transitions complete by t; 0 for an empty row, null before ``min_train`` labels."""
    pairs = labelled.withColumn("was", F.lag("state", stride).over(by_time())).withColumn("k", F.row_number().over(by_time()) - 1)
    net, total = F.lit(None).cast("double"), F.lit(None).cast("double")
    for s in range(3):
        here = F.sum(F.when(F.col("was") == s, F.col("state") - 1).otherwise(0)).over(so_far())
        row = F.sum(F.when(F.col("was") == s, 1).otherwise(0)).over(so_far())
        net, total = F.when(F.col("state") == s, here).otherwise(net), F.when(F.col("state") == s, row).otherwise(total)
    out = pairs.withColumn("net", net).withColumn("total", total)
    return out.withColumn("signal", F.when(F.col("k") >= min_train, F.when(F.col("total") > 0, F.col("net") / F.col("total")).otherwise(F.lit(0.0)))).drop("was", "net", "total", "k")


def filter_position(signal: Column, threshold: float, base: Column | None = None) -> Column:
    base = F.lit(1.0) if base is None else base
    return F.when(signal > threshold, base).when(signal < -threshold, -base).otherwise(F.lit(0.0))


def standalone_position(signal: Column, scale: float, cap: float = 1.0) -> Column:
    return clip(signal / scale, -cap, cap)


def control_position(wret: Column, threshold: float) -> Column:
    """Out of the market while the trailing return is at or below -threshold."""
    return F.when(wret <= -threshold, F.lit(0.0)).otherwise(F.lit(1.0))


def n_step(m: DataFrame, steps: int) -> DataFrame:
    """``p`` of ``steps`` transitions, by repeated self-joins on the middle state."""
    out = m.select("symbol", "from_state", "to_state", "p")
    for _ in range(steps - 1):
        b = m.select(F.col("symbol"), F.col("from_state").alias("mid"), F.col("to_state"), F.col("p").alias("q"))
        out = out.withColumnRenamed("to_state", "mid").join(b, ["symbol", "mid"]).groupBy("symbol", "from_state", "to_state").agg(F.sum(F.col("p") * F.col("q")).alias("p"))
    return out


def stationary(m: DataFrame) -> DataFrame:
    """Three states in closed form, by cofactors of I - P; null where the chain has no single one."""
    p = m.groupBy("symbol").pivot("from_state", [0, 1, 2]).agg(F.map_from_entries(F.collect_list(F.struct("to_state", "p"))).alias("r"))
    a = {(i, j): F.element_at(F.col(str(i)), F.lit(j)) for i in range(3) for j in range(3)}
    w = [
        a[1, 0] * a[2, 0] + a[1, 0] * a[2, 1] + a[1, 2] * a[2, 0],
        a[0, 1] * a[2, 1] + a[0, 1] * a[2, 0] + a[0, 2] * a[2, 1],
        a[0, 2] * a[1, 2] + a[0, 2] * a[1, 0] + a[0, 1] * a[1, 2],
    ]
    total = w[0] + w[1] + w[2]
    return p.select("symbol", *[F.when(total > 0, w[i] / total).alias(f"pi{i}") for i in range(3)])


def signal_vector(m: DataFrame) -> DataFrame:
    return m.groupBy("symbol", "from_state").agg(F.sum(F.when(F.col("to_state") == 2, F.col("p")).when(F.col("to_state") == 0, -F.col("p")).otherwise(0.0)).alias("signal"))


def persistence(m: DataFrame) -> DataFrame:
    return m.groupBy("symbol").agg(F.avg(F.when(F.col("from_state") == F.col("to_state"), F.col("p"))).alias("persistence"))


def running_counts(labelled: DataFrame, stride: int) -> DataFrame:
    """Adds ``k0, k1, k2``: transitions complete by this bar from its own state to each state, and ``b0, b1, b2``, how often each state occurred so far."""
    x = labelled.withColumn("__was", F.lag("state", stride).over(by_time()))
    for j in range(3):
        row = [F.sum(F.when((F.col("__was") == i) & (F.col("state") == j), 1).otherwise(0)).over(so_far()) for i in range(3)]
        x = x.withColumn(f"k{j}", F.when(F.col("state") == 0, row[0]).when(F.col("state") == 1, row[1]).otherwise(row[2]))
        x = x.withColumn(f"b{j}", F.sum(F.when(F.col("state") == j, 1).otherwise(0)).over(so_far()))
    return x.drop("__was")


def forecast_scores(labelled: DataFrame, stride: int, min_train: int, eps: float = 1e-15) -> DataFrame:
    """Per symbol: log loss and Brier score of the expanding transition matrix's forecasts ``stride`` bars ahead, and of the base rates'. A row never left forecasts evenly."""
    x = running_counts(labelled, stride).withColumn("truth", F.lead("state", stride).over(by_time())).withColumn("k", F.row_number().over(by_time()) - 1)
    x = x.filter((F.col("k") >= min_train) & F.col("truth").isNotNull())
    total, seen = F.col("k0") + F.col("k1") + F.col("k2"), F.col("b0") + F.col("b1") + F.col("b2")
    p = [F.when(total > 0, F.col(f"k{j}") / total).otherwise(F.lit(1 / 3)) for j in range(3)]
    b = [F.col(f"b{j}") / seen for j in range(3)]
    pick = lambda q: F.when(F.col("truth") == 0, q[0]).when(F.col("truth") == 1, q[1]).otherwise(q[2])
    loss = lambda q: F.avg(-F.ln(clip(pick(q), eps, 1 - eps)))
    brier = lambda q: F.avg(sum(((q[j] - (F.col("truth") == j).cast("int")) * (q[j] - (F.col("truth") == j).cast("int")) for j in range(3)), F.lit(0.0)))
    return x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), loss(p).alias("log_loss"), loss(b).alias("base_log_loss"), brier(p).alias("brier"), brier(b).alias("base_brier"))


def convergence(m: DataFrame, doublings: int) -> DataFrame:
    """``symbol, steps, strongest, distance`` for 1, 2, 4 ... steps: the largest absolute signal and the largest total-variation distance of a row from the stationary distribution.

    A symbol's matrix is one array of nine; a fold squares it, so the powers cost one row per symbol and no join."""
    nine = m.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("from_state", "to_state", "p"))).alias("e")).select("symbol", F.transform("e", lambda x: x["p"]).alias("a"))
    cell = lambda x, i, j: F.get(x, (i * 3 + j).cast("int"))

    def square(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: sum((cell(x, F.floor(k / 3), F.lit(s)) * cell(x, F.lit(s), k % 3) for s in range(3)), F.lit(0.0)))

    start = F.struct(F.col("a").alias("x"), F.array("a").alias("out"))
    powers = F.aggregate(F.sequence(F.lit(1), F.lit(doublings)), start, lambda acc, _: F.struct(square(acc["x"]).alias("x"), F.concat(acc["out"], F.array(square(acc["x"]))).alias("out")))["out"]
    rows = nine.join(stationary(m), "symbol").select("symbol", "pi0", "pi1", "pi2", F.posexplode(powers).alias("k", "x"))
    at = lambda i, j: F.get("x", F.lit(3 * i + j))
    strongest = F.greatest(*[F.abs(at(i, 2) - at(i, 0)) for i in range(3)])
    distance = F.greatest(*[sum((F.abs(at(i, j) - F.col(f"pi{j}")) for j in range(3)), F.lit(0.0)) / 2 for i in range(3)])
    return rows.select("symbol", F.pow(F.lit(2), F.col("k")).cast("int").alias("steps"), strongest.alias("strongest"), distance.alias("distance"))


def history_check(labelled: DataFrame, windows: DataFrame, least: int = 5) -> DataFrame:
    """Per symbol and named window (``name, first, last, expected``; a handful of rows): bars, the dominant state (the smaller on a tie), its share, and whether it is the one expected; null with fewer than ``least`` bars."""
    inside = labelled.join(F.broadcast(windows), F.col("bar_ts").between(F.col("first"), F.col("last")))
    n = inside.groupBy("symbol", "name", "expected", "state").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy("symbol", "name", "expected").agg(F.sum("n").alias("bars"), F.max(F.struct("n", (-F.col("state")).alias("s"))).alias("m"))
    dominant = -F.col("m.s")
    return g.select("symbol", "name", "bars", dominant.alias("dominant"), (F.col("m.n") / F.col("bars")).alias("share"), F.when(F.col("bars") >= least, dominant == F.col("expected")).alias("ok"))


def tradeability(symbols: DataFrame, data: DataFrame, signal: DataFrame, null: DataFrame, baseline: DataFrame, least_signal: float = 0.05, percentile: float = 95.0) -> DataFrame:
    """One row per symbol: ``status`` and the gates that fail, joined by ``;``. ``data``: unhandled; ``signal``: strongest; ``null``: percentile; ``baseline``: beats. A gate without a row has not been run and fails."""
    # The null comes from exploded draws: no automatic broadcast.
    x = symbols
    for gate in (data, signal, null, baseline):
        x = x.join(gate.hint("merge"), "symbol", "left")
    failed = F.array_compact(F.array(
        F.when(F.coalesce("unhandled", F.lit(0)) > 0, "CONTAMINATED"), F.when(F.coalesce(F.col("strongest") < least_signal, F.lit(True)), "NO_SIGNAL"),
        F.when(F.col("percentile").isNull(), "NULL_NOT_RUN").when(F.col("percentile") < percentile, "FAILS_NULL"), F.when(~F.coalesce("beats", F.lit(True)), "FAILS_BASELINE"),
    ))
    return x.select("symbol", F.when(F.size(failed) == 0, "VALIDATED").otherwise("NOT_VALIDATED_AS_TRADEABLE").alias("status"), F.array_join(failed, ";").alias("failed"))


def market_multipliers(panel: DataFrame, sma: int, vol: int, rank: int, mom: int, disp: int, start: int, every: int) -> DataFrame:
    """``bar_ts`` and multipliers (1 or 0.5; the composite 1, 0.75 or 0.5) by trend, breadth, volatility and dispersion of the whole panel, from the bar before each rebalancing, held between; 1 before ``start``.

    The market is the equal-weight curve. All windows after the first grouping run over one row per date."""
    x = panel.withColumn("ret", trailing_return(1)).withColumn("m", trailing_return(mom))
    # Symbols without a longer return count as not positive, as in the mean over all of a date.
    day = x.groupBy("bar_ts").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("mkt"), F.avg(F.when(F.col("m") > 0, 1.0).otherwise(0.0)).alias("breadth"), F.stddev_samp("ret").alias("sd"))
    t = Window.orderBy("bar_ts")
    frame = lambda n: t.rowsBetween(-(n - 1), Window.currentRow)
    whole = lambda c, n, f: F.when(F.count(c).over(frame(n)) == n, f.over(frame(n)))
    d = day.withColumn("level", F.product(1 + F.col("mkt")).over(t.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("t", F.row_number().over(t) - 1)
    d = d.withColumn("sma", whole("level", sma, F.avg("level"))).withColumn("vol", whole("mkt", vol, F.stddev_samp("mkt"))).withColumn("disp", whole("sd", disp, F.avg("sd")))
    d = d.withColumn("h", F.collect_list("vol").over(frame(rank))).withColumn("pct", F.when(F.size("h") == rank, F.size(F.filter("h", lambda v: v <= F.col("vol"))) / rank))
    d = d.withColumn("med", whole("disp", rank, F.percentile("disp", 0.5)))
    true = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    flags = [true(F.col("level") > F.col("sma")), true(F.col("breadth") >= 0.5), true(F.col("pct") <= 0.8), true(F.col("disp") >= F.col("med"))]
    d = d.withColumn("f", F.array(*flags)).withColumn("was", F.lag("f").over(t))
    set_here = F.when((F.col("t") >= start) & ((F.col("t") - start) % every == 0), F.col("was"))
    d = d.withColumn("f", F.last(set_here, ignorenulls=True).over(t.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    one = lambda i: F.when(F.get("f", F.lit(i)) == 0, 0.5).otherwise(1.0)
    score = sum((F.get("f", F.lit(i)) for i in range(4)), F.lit(0))
    return d.select("bar_ts", one(0).alias("trend"), one(1).alias("broad"), one(2).alias("calm"), one(3).alias("dispersed"), F.when(F.col("f").isNull() | (score >= 3), 1.0).when(score == 2, 0.75).otherwise(0.5).alias("composite"))


def cluster_labels(features: DataFrame, columns: list[str], k: int = 3, seed: int = 0) -> DataFrame:
    """States by k-means on standardised features of all symbols together, numbered by ascending mean of the first column; rows with a null or infinite feature are left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    good = features
    for c in columns:
        good = good.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = VectorAssembler(inputCols=columns, outputCol="__raw").transform(good)
    x = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True).fit(x).transform(x)
    x = KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="__c").fit(x).transform(x).drop("__raw", "__x")
    order = x.groupBy("__c").agg(F.avg(columns[0]).alias("__m")).withColumn("state", F.row_number().over(Window.orderBy("__m")) - 1).drop("__m")  # k rows
    return x.join(F.broadcast(order), "__c").drop("__c")
