"""Null models, bootstraps and regressions. Draws are rows, so their number only widens the data; every shift or pick is a function of draw and row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.maths import sharpe_ratio


def numbered(df: DataFrame) -> DataFrame:
    """Adds ``k`` (from 0 in time) and ``n`` (bars) per symbol."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("bar_ts")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))


def draws(count: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(count))).alias("draw")


def rephased(labelled: DataFrame, returns: DataFrame, count: int, guard: int, shuffle: bool = False) -> DataFrame:
    """Labels moved against returns: ``symbol`` (name#draw), bar_ts, state, ret.

    Rotation by ``guard`` + draw * 7919 mod (n - 2 guard) bars, around the end; with ``shuffle`` the labels of a draw are put in the order of a hash instead.
    Symbols with at most ``2 guard`` labels are left out."""
    x = numbered(labelled.select("symbol", "bar_ts", "state")).filter(F.col("n") > 2 * guard).select("symbol", "k", "n", "state", draws(count))
    if shuffle:
        order = F.md5(F.concat_ws("|", "symbol", F.col("draw").cast("string"), F.col("k").cast("string")))
        moved = x.withColumn("k", F.row_number().over(Window.partitionBy("symbol", "draw").orderBy(order, "k")) - 1)
    else:
        moved = x.withColumn("k", (F.col("k") + guard + (F.col("draw") * 7919) % (F.col("n") - 2 * guard)) % F.col("n"))
    bars = numbered(returns.join(labelled.select("symbol", "bar_ts"), ["symbol", "bar_ts"])).select("symbol", "k", "bar_ts", "ret")
    # Exploded rows: the size estimate is not to be trusted, so no automatic broadcast.
    out = moved.hint("merge").join(bars.hint("merge"), ["symbol", "k"])
    return out.select(F.concat_ws("#", "symbol", F.col("draw").cast("string")).alias("symbol"), "bar_ts", "state", "ret")


def empirical(real: DataFrame, null: DataFrame, value: str) -> DataFrame:
    """Place of the real value among its draws: one-sided p with the +1 correction, percentile, mean, median and 5 % and 95 % points of the draws."""
    both = null.select("symbol", F.col(value).alias("v")).filter("v is not null and not isnan(v)").join(real.select("symbol", F.col(value).alias("real")).hint("merge"), "symbol")
    above = F.count_if(F.col("v") >= F.col("real"))
    g = both.groupBy("symbol").agg(F.first("real").alias("real"), F.count(F.lit(1)).alias("n_draws"), above.alias("above"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.percentile("v", 0.05).alias("q05"), F.percentile("v", 0.95).alias("q95"))
    return g.withColumn("p", (F.col("above") + 1) / (F.col("n_draws") + 1)).withColumn("percentile", 100 * (F.col("n_draws") - F.col("above")) / F.col("n_draws")).drop("above")


def picked(n: Column, *parts) -> Column:
    """A place from 0 to ``n`` - 1 that is a function of ``parts`` alone, the same in every engine that has MD5."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % n


def block_bootstrap(returns: DataFrame, count: int, block: int) -> DataFrame:
    """``symbol, draw, j, ret``: each draw lays blocks of ``block`` bars, each from a start drawn on its own, around the end of the series."""
    x = numbered(returns.filter("ret is not null").select("symbol", "bar_ts", "ret"))
    places = x.select("symbol", F.col("k").alias("j"), "n", draws(count))
    start = picked(F.col("n"), F.col("symbol"), F.col("draw"), F.floor(F.col("j") / block))
    src = places.withColumn("k", ((start + F.col("j") % block) % F.col("n")).cast("int"))
    return src.hint("merge").join(x.select("symbol", "k", "ret").hint("merge"), ["symbol", "k"]).select("symbol", "draw", "j", "ret")


def path_metrics(drawn: DataFrame, bars_per_year: int) -> DataFrame:
    """``symbol, draw, sharpe, cagr, max_drawdown, growth`` of paths ``symbol, draw, j, ret``."""
    w = Window.partitionBy("symbol", "draw").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = drawn.withColumn("eq", F.product(1 + F.col("ret")).over(w))
    x = x.withColumn("dd", F.col("eq") / F.greatest(F.lit(1.0), F.max("eq").over(w)) - 1)
    g = x.groupBy("symbol", "draw").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.product(1 + F.col("ret")).alias("growth"), F.min("dd").alias("max_drawdown"))
    cagr = F.when(F.col("growth") > 0, F.pow("growth", bars_per_year / F.col("n")) - 1).otherwise(F.lit(-1.0))
    return g.select("symbol", "draw", F.when(F.col("s") > 0, F.col("m") / F.col("s") * bars_per_year**0.5).alias("sharpe"), cagr.alias("cagr"), "max_drawdown", "growth")


def block_permutation(returns: DataFrame, count: int, block: int) -> DataFrame:
    """``symbol, draw, j, ret``: whole blocks in the order of a hash, without replacement; bars after the last whole block are left out. Mean and deviation cannot change, paths do. Draw 0 is the real order."""
    x = numbered(returns.filter("ret is not null").select("symbol", "bar_ts", "ret"))
    x = x.withColumn("b", F.floor(F.col("k") / block)).filter(F.col("k") < F.floor(F.col("n") / block) * block)
    blocks = x.select("symbol", "b").distinct().select("symbol", "b", F.explode(F.sequence(F.lit(0), F.lit(count))).alias("draw"))
    order = F.when(F.col("draw") == 0, F.lpad(F.col("b").cast("string"), 12, "0")).otherwise(F.md5(F.concat_ws("|", "symbol", F.col("draw").cast("string"), F.col("b").cast("string"))))
    placed = blocks.withColumn("place", F.row_number().over(Window.partitionBy("symbol", "draw").orderBy(order, "b")) - 1)
    return placed.hint("merge").join(x.select("symbol", "b", "k", "ret").hint("merge"), ["symbol", "b"]).select("symbol", "draw", (F.col("place") * block + F.col("k") % block).alias("j"), "ret")


def panel_rolls(returns: DataFrame, count: int, guard: int, lookback: int, side: int, bars_per_year: int) -> DataFrame:
    """``draw, sharpe`` of a momentum portfolio on returns of all symbols rolled together by a draw's shift, weights formed anew; draw 0 is unrolled.

    Each bar the ``side`` best and worst by the sum of their last ``lookback`` returns are held, equally; the shift is a function of the draw."""
    days = returns.select("bar_ts").distinct().withColumn("t", F.row_number().over(Window.orderBy("bar_ts")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))  # one row per date
    x = returns.filter("ret is not null").select("symbol", "bar_ts", "ret").hint("merge").join(days.hint("merge"), "bar_ts")
    x = x.select("symbol", "t", "n", "ret", F.explode(F.sequence(F.lit(0), F.lit(count))).alias("draw"))
    shift = F.when(F.col("draw") == 0, 0).otherwise(guard + (F.col("draw") * 7919) % (F.col("n") - 2 * guard))
    x = x.withColumn("t", (F.col("t") + shift) % F.col("n"))
    past = Window.partitionBy("draw", "symbol").orderBy("t").rowsBetween(-lookback, -1)
    x = x.withColumn("mom", F.when(F.count("ret").over(past) == lookback, F.sum("ret").over(past))).filter("mom is not null")
    w = Window.partitionBy("draw", "t")
    x = x.withColumn("up", F.row_number().over(w.orderBy(F.desc("mom"), "symbol"))).withColumn("m", F.count(F.lit(1)).over(w)).filter(F.col("m") >= 2 * side)
    leg = F.when(F.col("up") <= side, F.col("ret") / side).when(F.col("up") > F.col("m") - side, -F.col("ret") / side)
    day = x.groupBy("draw", "t").agg(F.sum(leg).alias("r"))
    return day.groupBy("draw").agg(sharpe_ratio("r", bars_per_year).alias("sharpe"))


def label_shuffles(market: DataFrame, count: int, bars_per_year: int) -> DataFrame:
    """``draw, sharpe`` of ``ret`` times ``mult`` (one row per date) with the multipliers in the order of a hash; draw 0 keeps their own."""
    t = Window.orderBy("bar_ts")
    # Numbered in one task, one row per date; spread again before every row is repeated for each draw.
    x = market.withColumn("k", F.row_number().over(t) - 1).repartition(market.sparkSession.sparkContext.defaultParallelism, "k")
    d = x.select("k", "mult", F.explode(F.sequence(F.lit(0), F.lit(count))).alias("draw"))
    order = F.when(F.col("draw") == 0, F.lpad(F.col("k").cast("string"), 12, "0")).otherwise(F.md5(F.concat_ws("|", F.col("draw").cast("string"), F.col("k").cast("string"))))
    moved = d.withColumn("k", F.row_number().over(Window.partitionBy("draw").orderBy(order, "k")) - 1)
    both = moved.hint("merge").join(x.select("k", "ret").hint("merge"), "k").withColumn("r", F.col("mult") * F.col("ret"))
    return both.groupBy("draw").agg(sharpe_ratio("r", bars_per_year).alias("sharpe"))


def against_draws(values: DataFrame, value: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Draw 0 of ``value`` against the others: one-sided p with the +1 correction, their number, mean and 5 % and 95 % points."""
    real, null = F.when(F.col("draw") == 0, F.col(value)), F.when(F.col("draw") > 0, F.col(value))
    x = values.withColumn("real", F.max(real).over(Window.partitionBy(*(keys or [F.lit(1)])))).withColumn("v", null)
    g = x.groupBy(*keys).agg(F.max("real").alias("real"), F.count("v").alias("n_draws"), F.count_if(F.col("v") >= F.col("real")).alias("above"), F.avg("v").alias("mean"), F.percentile("v", 0.05).alias("q05"), F.percentile("v", 0.95).alias("q95"))
    return g.withColumn("p", (F.col("above") + 1) / (F.col("n_draws") + 1)).drop("above")


def resampled_mean(values: DataFrame, key: str, x: str, count: int) -> DataFrame:
    """One row: mean, one-sample t and the 2.5, 50 and 97.5 % points of ``count`` resampled means of ``x``, a dimension with one row per ``key``; every pick of a draw is made on its own."""
    k = values.withColumn("k", F.row_number().over(Window.orderBy(key)) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))  # one row per key
    k = k.repartition(values.sparkSession.sparkContext.defaultParallelism, "k")
    p = k.select("k", "n", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("draw")).select("draw", picked(F.col("n"), F.col("draw"), F.col("k")).cast("int").alias("k"))
    a = p.hint("merge").join(k.select("k", x).hint("merge"), "k").groupBy("draw").agg(F.avg(x).alias("a"))
    own = values.agg(F.avg(x).alias("mean"), (F.avg(x) / (F.stddev_samp(x) / F.sqrt(F.count(x)))).alias("t"))
    return a.agg(F.percentile("a", 0.025).alias("lo"), F.percentile("a", 0.5).alias("mid"), F.percentile("a", 0.975).alias("hi")).crossJoin(F.broadcast(own))  # one row each


def welch(df: DataFrame, keys: list[str], value: str, first: Column, second: Column) -> DataFrame:
    a, b = F.when(first, F.col(value)), F.when(second, F.col(value))
    g = df.groupBy(*keys).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    se = F.sqrt(F.try_divide(F.col("v1"), F.col("n1")) + F.try_divide(F.col("v2"), F.col("n2")))
    return g.select(*keys, "n1", "n2", "m1", "m2", F.try_divide(F.col("m1") - F.col("m2"), se).alias("t"))


def newey_west(df: DataFrame, key: str, y: str, x: str, lags: int) -> DataFrame:
    """y on a constant and x per key, with Bartlett-weighted errors: two aggregations and one window, all in closed form.

    Rows with a null in y or x are left out before lagging. ``alpha, beta, t_alpha, t_beta, r2, n``."""
    d = df.select(key, "bar_ts", F.col(y).alias("y"), F.col(x).alias("x")).filter("y is not null and x is not null")
    w = Window.partitionBy(key)
    fit = d.withColumn("b", F.regr_slope("y", "x").over(w)).withColumn("a", F.regr_intercept("y", "x").over(w))
    e = fit.withColumn("u", F.col("y") - F.col("a") - F.col("b") * F.col("x")).withColumn("v", F.col("u") * F.col("x"))
    t = Window.partitionBy(key).orderBy("bar_ts")
    s11, s12, s22 = F.col("u") * F.col("u"), F.col("u") * F.col("v"), F.col("v") * F.col("v")
    for lag in range(1, lags + 1):
        weight = 1 - lag / (lags + 1)
        ul, vl = F.coalesce(F.lag("u", lag).over(t), F.lit(0.0)), F.coalesce(F.lag("v", lag).over(t), F.lit(0.0))
        s11, s12, s22 = s11 + 2 * weight * F.col("u") * ul, s12 + weight * (F.col("u") * vl + F.col("v") * ul), s22 + 2 * weight * F.col("v") * vl
    rows = e.select(key, "y", "x", "a", "b", s11.alias("s11"), s12.alias("s12"), s22.alias("s22"))
    g = rows.groupBy(key).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.first("a").alias("alpha"), F.first("b").alias("beta"), F.regr_r2("y", "x").alias("r2"),
        F.sum("s11").alias("s11"), F.sum("s12").alias("s12"), F.sum("s22").alias("s22"),
    )
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    n, sx, sxx = F.col("n"), F.col("sx"), F.col("sxx")
    va = (sxx * sxx * F.col("s11") - 2 * sx * sxx * F.col("s12") + sx * sx * F.col("s22")) / (det * det)
    vb = (sx * sx * F.col("s11") - 2 * n * sx * F.col("s12") + n * n * F.col("s22")) / (det * det)
    return g.select(key, n.cast("long").alias("n"), "alpha", "beta", F.try_divide(F.col("alpha"), F.sqrt(va)).alias("t_alpha"), F.try_divide(F.col("beta"), F.sqrt(vb)).alias("t_beta"), "r2")


def ols_hac(df: DataFrame, key: str, y: str, xs: list[str], lags: int, least: int = 30) -> DataFrame:
    """``key, factor, beta, t, p, r2, n, info_ratio``: y on a constant and several factors per key, with Bartlett-weighted errors.

    Spark adds up the products (of rows, then of lagged residuals), so a key's rows are never in one place; what is solved in numpy are a key's
    matrices of as many rows as there are factors, many keys to a batch. Rows with a null are left out before lagging; keys with fewer than ``least`` rows give none."""
    names = ["const", *xs]
    d = df.select(key, "bar_ts", F.col(y).alias("__y"), *xs).dropna().withColumn("const", F.lit(1.0))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    product = lambda i, j: F.col(names[i]) * F.col(names[j])
    sums = d.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(product(i, j)) for i, j in pairs]).alias("xx"), F.array(*[F.sum(F.col(c) * F.col("__y")) for c in names]).alias("xy"), F.sum("__y").alias("sy"), F.sum(F.col("__y") * F.col("__y")).alias("yy"),
    ).filter(F.col("n") >= least)
    kind = df.schema[key].dataType.simpleString()

    def square(flat):
        import numpy as np

        out = np.zeros((len(flat), len(names), len(names)))
        for k, (i, j) in enumerate(pairs):
            out[:, i, j] = out[:, j, i] = flat[:, k]
        return out

    def solve(batches):
        import numpy as np

        for b in batches:
            xx, xy = square(np.stack(b["xx"])), np.stack(b["xy"])
            b["beta"] = list(np.einsum("kij,kj->ki", np.linalg.pinv(xx), xy))
            yield b[[key, "n", "xx", "beta", "sy", "yy"]]

    fit = sums.mapInPandas(solve, f"`{key}` {kind}, n long, xx array<double>, beta array<double>, sy double, yy double")
    e = d.hint("merge").join(fit.select(key, "beta").hint("merge"), key)
    e = e.withColumn("__u", F.col("__y") - sum((F.get("beta", F.lit(i)) * F.col(c) for i, c in enumerate(names)), F.lit(0.0))).drop("beta")
    t = Window.partitionBy(key).orderBy("bar_ts")
    score = [F.col("__u") * F.col(c) for c in names]
    e = e.withColumns({f"__g{i}": s for i, s in enumerate(score)})
    terms = []
    for i, j in pairs:
        total = F.col(f"__g{i}") * F.col(f"__g{j}")
        for lag in range(1, lags + 1):
            back = lambda k: F.coalesce(F.lag(f"__g{k}", lag).over(t), F.lit(0.0))  # noqa: B023, E731
            total = total + (1 - lag / (lags + 1)) * (F.col(f"__g{i}") * back(j) + F.col(f"__g{j}") * back(i))
        terms.append(total)
    rows = e.select(key, "__u", F.array(*terms).alias("__s"))
    meat = rows.groupBy(key).agg(F.array(*[F.sum(F.get("__s", F.lit(k))) for k in range(len(pairs))]).alias("meat"), F.sum(F.col("__u") * F.col("__u")).alias("rss"), F.stddev_samp("__u").alias("sd"))

    def finish(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            if not len(b):
                continue
            inv, beta = np.linalg.pinv(square(np.stack(b["xx"]))), np.stack(b["beta"])
            var = np.einsum("kij,kjl,klm->kim", inv, square(np.stack(b["meat"])), inv)
            se = np.sqrt(np.maximum(1e-12, np.einsum("kii->ki", var)))
            m, n = len(names), len(b)
            whole = b["yy"] - b["sy"] ** 2 / b["n"]
            yield pd.DataFrame({
                key: np.repeat(b[key].to_numpy(), m), "factor": names * n, "beta": beta.reshape(-1), "t": (beta / se).reshape(-1), "r2": np.repeat((1 - b["rss"] / whole).to_numpy(), m), "n": np.repeat(b["n"].to_numpy(), m),
                "info_ratio": np.repeat(beta[:, 0] / b["sd"].to_numpy(), m),
            })

    solved = fit.hint("merge").join(meat.hint("merge"), key).mapInPandas(finish, f"`{key}` {kind}, factor string, beta double, t double, r2 double, n long, info_ratio double")
    from ..functions.maths import normal_cdf

    return solved.withColumn("p", 2 * (1 - normal_cdf(F.abs("t"))))
