"""Registered queries of regimes, gates and factor designs, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.maths import sharpe_ratio
from ..operators import factors as A
from ..operators import inference as I
from ..operators import performance as P
from ..operators import regime as R
from ..operators import windows as W
from ..sources.panels import table, weekly_panel
from ..sources.shared import staged
from .factors import EVERY, HELD, K, SCORES, VOL, configs, week_factors, week_held, week_portfolio, week_weights
from .inference import DRAWS, NULL, NULLED, ROTATED, SHARPE, SUMMARY, by_name, null_sharpe, sharpe
from .ledger import CONTROL, week_control
from .panel import COUNTS, EARNED, LABELS, MIN_TRAIN, QUERIES, SIGNALS, WEEK, WIN, YEAR, r, register, rounded, week_earned, week_labels, week_matrix, week_returns
from .studies import BY, MOVED, PAIRED, SPLIT, hour_features, paired

PI = "pm AS (SELECT symbol, " + ", ".join(f"max(p) FILTER (from_state = {i} AND to_state = {j}) AS p{i}{j}" for i in range(3) for j in range(3)) + """ FROM mat GROUP BY 1),
pw AS (SELECT symbol, p10*p20 + p10*p21 + p12*p20 AS a, p01*p21 + p01*p20 + p02*p21 AS b, p02*p12 + p02*p10 + p01*p12 AS c FROM pm),
pi AS (SELECT symbol, unnest([0, 1, 2]) AS to_state, unnest([a, b, c]) / (a + b + c) AS pi FROM pw)"""
POWERS = "q1 AS (SELECT symbol, from_state, to_state, p FROM mat), " + ", ".join(f"q{2 * k} AS (SELECT a.symbol, a.from_state, b.to_state, sum(a.p * b.p) AS p FROM q{k} a JOIN q{k} b ON a.symbol = b.symbol AND a.to_state = b.from_state GROUP BY 1, 2, 3)" for k in (1, 2, 4, 8))


@register("rg14_profile", f"WITH {WEEK}, {LABELS}, {COUNTS}, {PI}, {POWERS}, u AS ({' UNION ALL '.join(f'SELECT {k} AS steps, * FROM q{k}' for k in (1, 2, 4, 8, 16))}), s AS (SELECT symbol, steps, from_state, sum(CASE to_state WHEN 2 THEN p WHEN 0 THEN -p ELSE 0 END) AS s, sum(abs(p - pi)) / 2 AS tv FROM u JOIN pi USING (symbol, to_state) GROUP BY 1, 2, 3) SELECT symbol, steps, {r('max(abs(s)) AS strongest', 'max(tv) AS distance')} FROM s GROUP BY 1, 2")
def _(spark, d):
    return rounded(R.convergence(week_matrix(spark, d), 4))


PERIODS = [("rise", "1995-01-01", "1995-06-30", 2), ("fall", "1996-03-01", "1996-05-31", 0), ("calm", "1997-02-01", "1997-12-31", 1), ("beyond", "2030-01-01", "2030-12-31", 2)]


@register("rg17_history", f"WITH {WEEK}, {LABELS}, h AS (SELECT * FROM (VALUES {', '.join(repr(p) for p in PERIODS)}) AS v(name, first, last, expected)), n AS (SELECT symbol, name, expected, state, count(*) AS n FROM lab JOIN h ON bar_ts BETWEEN CAST(first AS DATE) AND CAST(last AS DATE) GROUP BY 1, 2, 3, 4), g AS (SELECT symbol, name, expected, CAST(sum(n) AS BIGINT) AS bars, arg_max(state, (n, -state)) AS dominant, max(n) AS most FROM n GROUP BY 1, 2, 3) SELECT symbol, name, bars, dominant, round(most / bars, 6) AS share, CASE WHEN bars >= 5 THEN dominant = expected END AS ok FROM g")
def _(spark, d):
    windows = spark.createDataFrame(PERIODS, "name string, first string, last string, expected int").select("name", F.to_date("first").alias("first"), F.to_date("last").alias("last"), "expected")
    return rounded(R.history_check(week_labels(spark, d), windows))


@register("rg18_tradeability", f"""WITH {WEEK}, {LABELS}, {COUNTS}, {SIGNALS}, {EARNED}, {CONTROL}, {SHARPE.format(a='rs', b='ern')}, {ROTATED}, {NULL}, {SHARPE.format(a='ns', b='nern')},
g1 AS (SELECT symbol, count(*) FILTER (abs(ret) >= 0.6 AND month(bar_ts) <> 1) AS unhandled FROM rets GROUP BY 1),
g2 AS (SELECT symbol, max(abs(s)) AS strongest FROM (SELECT symbol, from_state, sum(CASE to_state WHEN 2 THEN p WHEN 0 THEN -p ELSE 0 END) AS s FROM mat GROUP BY 1, 2) GROUP BY 1),
g3 AS (SELECT rs.symbol, 100 * (count(*) - count(*) FILTER (ns.sharpe >= rs.sharpe)) / count(*) AS percentile FROM ns JOIN rs ON rs.symbol = split_part(ns.symbol, '#', 1) WHERE ns.sharpe IS NOT NULL AND rs.sharpe IS NOT NULL GROUP BY 1),
g4 AS (SELECT a.symbol, a.s - b.s > 0.1 AS beats FROM (SELECT symbol, avg(net) / stddev_samp(net) * sqrt(52) AS s FROM ern GROUP BY 1) a JOIN (SELECT symbol, avg(net) / stddev_samp(net) * sqrt(52) AS s FROM cern GROUP BY 1) b USING (symbol)),
f AS (SELECT symbol, concat_ws(';', CASE WHEN unhandled > 0 THEN 'CONTAMINATED' END, CASE WHEN coalesce(strongest < 0.3, true) THEN 'NO_SIGNAL' END, CASE WHEN percentile IS NULL THEN 'NULL_NOT_RUN' WHEN percentile < 60 THEN 'FAILS_NULL' END, CASE WHEN NOT coalesce(beats, true) THEN 'FAILS_BASELINE' END) AS failed FROM (SELECT DISTINCT symbol FROM panel) LEFT JOIN g1 USING (symbol) LEFT JOIN g2 USING (symbol) LEFT JOIN g3 USING (symbol) LEFT JOIN g4 USING (symbol))
SELECT symbol, CASE WHEN failed = '' THEN 'VALIDATED' ELSE 'NOT_VALIDATED_AS_TRADEABLE' END AS status, failed FROM f""")
def _(spark, d):
    rets = week_returns(spark, d)
    data = rets.groupBy("symbol").agg(F.count_if((F.abs("ret") >= 0.6) & (F.month("bar_ts") != 1)).alias("unhandled"))
    signal = R.signal_vector(week_matrix(spark, d)).groupBy("symbol").agg(F.max(F.abs("signal")).alias("strongest"))
    own = sharpe(week_earned(spark, d))
    null = I.empirical(own.filter("sharpe is not null"), by_name(null_sharpe(spark, d)), "sharpe").select("symbol", "percentile")
    plain = lambda df, name: df.groupBy("symbol").agg(sharpe_ratio("net", YEAR).alias(name))
    beats = plain(week_earned(spark, d), "a").join(plain(week_control(spark, d), "b"), "symbol").select("symbol", (F.col("a") - F.col("b") > 0.1).alias("beats"))
    return R.tradeability(rets.select("symbol").distinct(), data, signal, null, beats, 0.3, 60.0)


RUNNING = ", ".join(f"sum(CASE WHEN was = {i} AND state = {j} THEN 1 ELSE 0 END) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS n{i}{j}" for i in range(3) for j in range(3)) + ", " + ", ".join(f"sum(CASE WHEN state = {j} THEN 1 ELSE 0 END) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS b{j}" for j in range(3))
ROW = ", ".join(f"CASE state WHEN 0 THEN n0{j} WHEN 1 THEN n1{j} ELSE n2{j} END AS k{j}" for j in range(3))


@register("rg19_scores", f"""WITH {WEEK}, {LABELS}, x AS (SELECT symbol, bar_ts, state, lag(state, {WIN}) OVER w AS was, lead(state, {WIN}) OVER w AS truth, row_number() OVER w - 1 AS k FROM lab WINDOW w AS ({BY})), c AS (SELECT *, {RUNNING} FROM x), q AS (SELECT symbol, truth, {ROW}, b0, b1, b2 FROM c WHERE truth IS NOT NULL AND k >= {MIN_TRAIN}),
p AS (SELECT symbol, truth, {', '.join(f'CASE WHEN k0 + k1 + k2 > 0 THEN k{j} / (k0 + k1 + k2) ELSE 1.0::DOUBLE / 3 END AS p{j}, b{j} / (b0 + b1 + b2) AS q{j}' for j in range(3))} FROM q)
SELECT symbol, count(*) AS n, {r(*[f"avg(-ln(greatest(1e-15, least(1 - 1e-15, CASE truth WHEN 0 THEN {a}0 WHEN 1 THEN {a}1 ELSE {a}2 END)))) AS {n}" for a, n in (('p', 'log_loss'), ('q', 'base_log_loss'))], *[f"avg({' + '.join(f'({a}{j} - CAST(truth = {j} AS INT)) ** 2' for j in range(3))}) AS {n}" for a, n in (('p', 'brier'), ('q', 'base_brier'))])} FROM p GROUP BY 1""")
def _(spark, d):
    return rounded(R.forecast_scores(week_labels(spark, d), WIN, MIN_TRAIN))


def _sweep(w: int) -> str:
    """Labels, signals, positions and earnings of one window for all thresholds."""
    by = "PARTITION BY threshold, symbol ORDER BY bar_ts"
    sums = ", ".join(f"sum(CASE WHEN was = {s} THEN state - 1 ELSE 0 END) OVER u AS net{s}, sum(CASE WHEN was = {s} THEN 1 ELSE 0 END) OVER u AS tot{s}" for s in range(3))
    return f"""a{w} AS (SELECT symbol, bar_ts, ret, close / lag(close, {w}) OVER ({BY}) - 1 AS wret FROM rets),
b{w} AS (SELECT threshold, symbol, bar_ts, ret, CASE WHEN wret >= threshold THEN 2 WHEN wret <= -threshold THEN 0 ELSE 1 END AS state FROM a{w}, (SELECT unnest([0.03::DOUBLE, 0.05, 0.1]) AS threshold) WHERE wret IS NOT NULL),
c{w} AS (SELECT *, lag(state, {w}) OVER v AS was, row_number() OVER v - 1 AS k FROM b{w} WINDOW v AS ({by})), d{w} AS (SELECT *, {sums} FROM c{w} WINDOW u AS ({by} ROWS UNBOUNDED PRECEDING)),
e{w} AS (SELECT *, CASE state WHEN 0 THEN net0 WHEN 1 THEN net1 ELSE net2 END AS net, CASE state WHEN 0 THEN tot0 WHEN 1 THEN tot1 ELSE tot2 END AS total FROM d{w}),
f{w} AS (SELECT threshold, symbol, bar_ts, ret, CASE WHEN k >= {MIN_TRAIN} THEN CASE WHEN total > 0 THEN net / total ELSE 0 END END AS signal FROM e{w}),
h{w} AS (SELECT {w} AS win, *, CASE WHEN signal > 0.05 THEN 0.1::DOUBLE WHEN signal < -0.05 THEN -0.1::DOUBLE ELSE 0::DOUBLE END AS pos FROM f{w}),
i{w} AS (SELECT *, coalesce(lag(pos) OVER ({by}), 0) AS was FROM h{w})"""


@register("rg23_sweep", f"WITH {WEEK}, {', '.join(_sweep(w) for w in (2, 4, 8))}, u AS ({' UNION ALL '.join(f'SELECT * FROM i{w}' for w in (2, 4, 8))}), n AS (SELECT win, threshold, cost, symbol, signal, was * coalesce(ret, 0) - abs(pos - was) * cost / 1e4 AS net FROM u, (SELECT unnest([0, 10, 50]) AS cost)) SELECT win, threshold, cost, symbol, count(*) AS n, coalesce(max(abs(signal)) >= 0.1, false) AS admissible, {r('sum(net) AS total', 'CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(52) END AS sharpe')} FROM n GROUP BY 1, 2, 3, 4")
def _(spark, d):
    # One branch per window, since its lag is the stride; thresholds and costs only widen the rows.
    x, out = week_returns(spark, d), None
    each = lambda name, values: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    for w in (2, 4, 8):
        a = x.withColumn("wret", W.trailing_return(w)).filter("wret is not null").select("symbol", "bar_ts", "idx", "close", "ret", "wret", each("threshold", (0.03, 0.05, 0.1)))
        a = a.withColumn("name", F.col("symbol")).withColumn("symbol", F.concat_ws("#", "symbol", F.col("threshold").cast("string")))
        a = a.withColumn("state", F.when(F.col("wret") >= F.col("threshold"), 2).when(F.col("wret") <= -F.col("threshold"), 0).otherwise(1))
        s = R.walk_forward(a, w, MIN_TRAIN).withColumn("pos", R.filter_position(F.col("signal"), 0.05, F.lit(0.1)))
        e = P.earned(s, ["symbol"]).select(F.lit(w).alias("win"), "threshold", F.col("name").alias("symbol"), "signal", "gross", "turnover", each("cost", (0, 10, 50)))
        out = e if out is None else out.unionByName(e)
    net = F.col("gross") - F.col("turnover") * F.col("cost") / 1e4
    g = out.withColumn("net", net).groupBy("win", "threshold", "cost", "symbol")
    return rounded(g.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.abs("signal")) >= 0.1, F.lit(False)).alias("admissible"), F.sum("net").alias("total"), F.when(F.stddev_samp("net") > 0, F.avg("net") / F.stddev_samp("net") * YEAR**0.5).alias("sharpe")))


def _full(f: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER (ORDER BY bar_ts ROWS {n - 1} PRECEDING) = {n} THEN {f} OVER (ORDER BY bar_ts ROWS {n - 1} PRECEDING) END"


MULTIPLIERS = f"""
mp0 AS (SELECT bar_ts, symbol, ret, close / lag(close, 26) OVER ({BY}) - 1 AS m FROM rets),
mp1 AS (SELECT bar_ts, coalesce(avg(ret), 0) AS mkt, avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END) AS breadth, stddev_samp(ret) AS sd FROM mp0 GROUP BY 1),
mp2 AS (SELECT *, product(1 + mkt) OVER (ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS level, row_number() OVER (ORDER BY bar_ts) - 1 AS t FROM mp1),
mp3 AS (SELECT *, {_full('avg(level)', 'level', 40)} AS sma, {_full('stddev_samp(mkt)', 'mkt', 4)} AS vol, {_full('avg(sd)', 'sd', 4)} AS disp FROM mp2),
mp4 AS (SELECT *, list(vol) FILTER (vol IS NOT NULL) OVER (ORDER BY bar_ts ROWS 51 PRECEDING) AS h, {_full('median(disp)', 'disp', 52)} AS med FROM mp3),
mp5 AS (SELECT bar_ts, t, CAST(coalesce(level > sma, false) AS INT) AS f0, CAST(coalesce(breadth >= 0.5, false) AS INT) AS f1, CAST(coalesce(CASE WHEN len(h) = 52 THEN len(list_filter(h, lambda v: v <= vol)) / 52 END <= 0.8, false) AS INT) AS f2, CAST(coalesce(disp >= med, false) AS INT) AS f3 FROM mp4),
mp6 AS (SELECT bar_ts, {', '.join(f'CASE WHEN t >= 60 AND (t - 60) % 4 = 0 THEN lag(f{i}) OVER (ORDER BY bar_ts) END AS g{i}' for i in range(4))} FROM mp5),
mp7 AS (SELECT bar_ts, {', '.join(f'last_value(g{i} IGNORE NULLS) OVER (ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS g{i}' for i in range(4))} FROM mp6),
mul AS (SELECT bar_ts, {', '.join(f'CASE WHEN g{i} = 0 THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS {n}' for i, n in enumerate(('trend', 'broad', 'calm', 'dispersed')))}, CASE WHEN g0 IS NULL OR g0 + g1 + g2 + g3 >= 3 THEN 1::DOUBLE WHEN g0 + g1 + g2 + g3 = 2 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS composite FROM mp7)"""


def week_multipliers(spark, d):
    return R.market_multipliers(weekly_panel(spark, d), 40, 4, 52, 26, 4, 60, 4)


@register("rg21_multipliers", f"WITH {WEEK}, {MULTIPLIERS} SELECT * FROM mul")
def _(spark, d):
    return week_multipliers(spark, d)


def _clusters(spark, d):
    """RG-2: k-means has no SQL; the tests hold its labels against the invariant."""
    return rounded(R.cluster_labels(hour_features(spark, d), ["wret", "atr", "rel"]))


QUERIES["rg2_cluster_labels"] = _clusters


@register("fa1_forms", f"WITH {WEEK}, {SCORES}, x AS (SELECT symbol, bar_ts, mom, vol, close / lag(close, 4) OVER w - 1 AS r4, close / lag(close, 13) OVER w - 1 AS r13, close / lag(close, 26) OVER w - 1 AS r26 FROM fs0 WINDOW w AS ({BY})), z AS (SELECT *, {', '.join(f'CASE WHEN count({c}) OVER x >= 6 THEN ({c} - avg({c}) OVER x) / (stddev_samp({c}) OVER x + 1e-8) END AS z{c[1:]}' for c in ('r4', 'r13', 'r26'))} FROM x WINDOW x AS (PARTITION BY bar_ts)) SELECT symbol, bar_ts, {r('r26 AS raw', 'mom AS skip', 'r26 / vol AS adjusted', '0.5 * r4 + 0.3 * r13 + 0.2 * r26 AS blend', '0.5 * z4 + 0.3 * z13 + 0.2 * z26 AS z_blend')} FROM z WHERE vol > 0")
def _(spark, d):
    x = week_factors(spark, d).withColumns({f"r{n}": W.trailing_return(n) for n in (4, 13, 26)})
    x = x.withColumns({f"z{n}": W.zscore(f"r{n}") for n in (4, 13, 26)}).filter("vol > 0")
    blend = lambda p: A.weighted({f"{p}4": 0.5, f"{p}13": 0.3, f"{p}26": 0.2})
    return rounded(x.select("symbol", "bar_ts", F.col("r26").alias("raw"), F.col("mom").alias("skip"), (F.col("r26") / F.col("vol")).alias("adjusted"), blend("r").alias("blend"), blend("z").alias("z_blend")))


@register("fa3_static_carry", f"WITH {WEEK} SELECT symbol, bar_ts, round(0.01 + n_nationkey / 1000.0::DOUBLE, 6) AS carry FROM panel JOIN nation ON symbol = n_name")
def _(spark, d):
    yields = table(spark, d, "nation").select(F.col("n_name").alias("symbol"), (0.01 + F.col("n_nationkey") / 1000.0).alias("carry"))
    return rounded(weekly_panel(spark, d).join(yields.hint("merge"), "symbol").select("symbol", "bar_ts", "carry"))


LEGS = [("long", 0.035, 1.0), ("short", 0.028, 0.5), ("base", 0.025, 0.5), ("x", -0.010, -1.0), ("y", 0.005, -1.0)]
CARRY = f"""
lg AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS k FROM (SELECT DISTINCT symbol FROM panel)),
lp AS (SELECT bar_ts, {', '.join(f'max(close) FILTER (k = {i + 1}) AS c{i}' for i in range(5))} FROM panel JOIN lg USING (symbol) GROUP BY 1),
lf AS (SELECT bar_ts, {', '.join(f'last_value(c{i} IGNORE NULLS) OVER (ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS c{i}' for i in range(5))} FROM lp),
lm AS (SELECT bar_ts, {', '.join(f'coalesce((c{a} / c{b}) / lag(c{a} / c{b}, 12) OVER (ORDER BY bar_ts) - 1, 0) AS {n}' for n, a, b in (('term', 0, 1), ('fx', 2, 3), ('fy', 2, 4)))} FROM lf),
lv0 AS (SELECT symbol, bar_ts, coalesce(ret, 0) AS ret FROM rets),
lv1 AS (SELECT symbol, bar_ts, CASE WHEN count(ret) OVER w = 12 THEN nullif(stddev_samp(ret) OVER w * sqrt(52), 0) END AS sd FROM lv0 WINDOW w AS ({BY} ROWS 11 PRECEDING)),
lv AS (SELECT symbol, bar_ts, coalesce(last_value(sd IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING), 0.15) AS vol FROM lv1),
lr AS (SELECT symbol, bar_ts, CASE k WHEN 1 THEN 0.035 + term WHEN 2 THEN 0.028 + 0.5 * term WHEN 3 THEN 0.025 + 0.5 * (fx + fy) WHEN 4 THEN -0.010 - fx WHEN 5 THEN 0.005 - fy ELSE 0.02 / vol END AS raw FROM lv JOIN lg USING (symbol) JOIN lm USING (bar_ts)),
car AS (SELECT symbol, bar_ts, coalesce(lag(raw) OVER ({BY}), 0) AS carry FROM lr),
cz AS (SELECT *, CASE WHEN coalesce(stddev_samp(carry) OVER x, 0) < 1e-8 THEN 0 ELSE (carry - avg(carry) OVER x) / stddev_samp(carry) OVER x END AS zc FROM car WINDOW x AS (PARTITION BY bar_ts))"""


def week_carry(spark, d):
    p = weekly_panel(spark, d)
    k = p.select("symbol").distinct().withColumn("k", F.row_number().over(Window.orderBy("symbol")))  # one row per symbol
    pick = lambda values, other: F.element_at(F.array(*[F.lit(v) for v in values], F.lit(other)), F.least(F.col("k"), F.lit(6)))
    legs = k.select("symbol", pick([x[0] for x in LEGS], None).alias("leg"), pick([x[1] for x in LEGS], 0.02).alias("level"), pick([x[2] for x in LEGS], 0.0).alias("slope"))
    return A.dynamic_carry(p, legs, 12, 12, 52)


@register("fa4_dynamic_carry", f"WITH {WEEK}, {CARRY} SELECT symbol, bar_ts, {r('carry')} FROM car")
def _(spark, d):
    return rounded(week_carry(spark, d))


@register("fa5_carry_z", f"WITH {WEEK}, {CARRY} SELECT symbol, bar_ts, {r('zc')} FROM cz")
def _(spark, d):
    return rounded(week_carry(spark, d).select("symbol", "bar_ts", A.guarded_zscore("carry").alias("zc")))


@register("fa6_blends", f"WITH {WEEK}, {SCORES}, {CARRY} SELECT symbol, bar_ts, {r('0.5 * zm + 0.5 * zc AS even', '0.7 * zm + 0.3 * zc AS tilted', 'CASE WHEN zc < -1 THEN -999 ELSE zm END AS vetoed')} FROM fs JOIN cz USING (symbol, bar_ts) WHERE zm IS NOT NULL")
def _(spark, d):
    z = week_carry(spark, d).select("symbol", "bar_ts", A.guarded_zscore("carry").alias("zc"))
    x = week_factors(spark, d).select("symbol", "bar_ts", "zm").filter("zm is not null").join(z, ["symbol", "bar_ts"])
    return rounded(x.select("symbol", "bar_ts", A.weighted({"zm": 0.5, "zc": 0.5}).alias("even"), A.weighted({"zm": 0.7, "zc": 0.3}).alias("tilted"), A.weighted({"zm": 1.0}, ("zc", -1.0)).alias("vetoed")))


@register("fa7_trend_filter", f"WITH {WEEK}, {SCORES}, t AS (SELECT symbol, bar_ts, close, CASE WHEN count(close) OVER w = 40 THEN avg(close) OVER w END AS sma FROM panel WINDOW w AS ({BY} ROWS 39 PRECEDING)) SELECT config, symbol, bar_ts, side, {r('weight')} FROM wt JOIN t USING (symbol, bar_ts) WHERE (side > 0 AND close > sma) OR (side < 0 AND close < sma)")
def _(spark, d):
    trend = weekly_panel(spark, d).select("symbol", "bar_ts", "close", W.rolling_mean("close", 40).alias("sma"))
    return rounded(A.with_trend(week_weights(spark, d), trend).select("config", "symbol", "bar_ts", "side", "weight"))


ZW = "zw0 AS (SELECT config, symbol, bar_ts, side, vol, greatest(0.1, side * score) / (vol + 1e-8) AS size FROM sel WHERE config = 'mom'), md0 AS (SELECT bar_ts, median(vol) AS med FROM fs GROUP BY 1), zw AS (SELECT symbol, bar_ts, side, size / sum(size) OVER (PARTITION BY bar_ts, side) * CASE WHEN side < 0 THEN -0.5 ELSE 1 END AS w, med FROM zw0 JOIN md0 USING (bar_ts))"


def momentum_ends(spark, d):
    x = week_factors(spark, d).select("symbol", "bar_ts", "ret", "vol", configs())
    med = week_factors(spark, d).groupBy("bar_ts").agg(F.percentile("vol", 0.5).alias("med_vol"))
    return A.both_ends(x.filter("vol is not null and config = 'mom'"), "score", 2).join(med.hint("merge"), "bar_ts")


@register("fa11_score_weights", f"WITH {WEEK}, {SCORES}, {ZW} SELECT symbol, bar_ts, side, round(w * CASE WHEN med > 1.2 THEN greatest(0.2, 1.2 / med) ELSE 1 END, 6) AS weight FROM zw")
def _(spark, d):
    return rounded(A.score_weights(momentum_ends(spark, d), "score", "vol", short_scale=0.5, gate=1.2).select("symbol", "bar_ts", "side", "weight"))


@register("fa12_modes", f"WITH {WEEK}, {SCORES}, {ZW} SELECT 'LONG_SHORT' AS mode, bar_ts, {r('sum(w) AS net', 'sum(abs(w)) AS gross')} FROM zw GROUP BY 2 UNION ALL SELECT 'LONG_ONLY', bar_ts, round(sum(w), 6), round(sum(abs(w)), 6) FROM zw WHERE side > 0 GROUP BY 2 UNION ALL SELECT 'SHORT_ONLY', bar_ts, round(sum(w), 6), round(sum(abs(w)), 6) FROM zw WHERE side < 0 GROUP BY 2")
def _(spark, d):
    x, out = momentum_ends(spark, d), None
    for mode in ("LONG_SHORT", "LONG_ONLY", "SHORT_ONLY"):
        one = A.score_weights(x, "score", "vol", short_scale=0.5, mode=mode).groupBy("bar_ts").agg(F.sum("weight").alias("net"), F.sum(F.abs("weight")).alias("gross")).select(F.lit(mode).alias("mode"), "bar_ts", "net", "gross")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@register("fa13_target_map", f"WITH {WEEK}, {SCORES} SELECT config, bar_ts, string_agg(symbol || '=' || CAST(round(weight * 1e6) AS BIGINT), ',' ORDER BY symbol) AS weights FROM wt GROUP BY 1, 2")
def _(spark, d):
    # The map of a date's target weights, shown in millionths.
    m = week_weights(spark, d).groupBy("config", "bar_ts").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", "weight")))).alias("m"))
    text = F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], F.round(e["value"] * 1e6).cast("long").cast("string")))
    return m.select("config", "bar_ts", F.array_join(text, ",").alias("weights"))


#: name: momentum, value, carry, inverse-volatility weights, held between rebalancings.
ABLATIONS = {"baseline": (1, 1, 1, 1, 1), "no_momentum": (0, 1, 1, 1, 1), "no_value": (1, 0, 1, 1, 1), "no_carry": (1, 1, 0, 1, 1), "not_held": (1, 1, 1, 1, 0), "equal_weight": (1, 1, 1, 0, 1), "momentum": (1, 0, 0, 1, 1), "value": (0, 1, 0, 1, 1), "carry": (0, 0, 1, 1, 1)}


@register("fa14_nine", f"""WITH {WEEK}, {SCORES}, {CARRY}, ac AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {', '.join(map(str, v))})" for k, v in ABLATIONS.items())}) AS v(config, um, uv, uc, rp, hold)),
az AS (SELECT config, rp, hold, fs.symbol, fs.bar_ts, ret, vol, (CASE WHEN um = 1 THEN coalesce(zm, 0) ELSE 0 END + CASE WHEN uv = 1 THEN coalesce(zv, 0) ELSE 0 END + CASE WHEN uc = 1 THEN zc ELSE 0 END) / nullif(CAST(um = 1 AND zm IS NOT NULL AS INT) + CAST(uv = 1 AND zv IS NOT NULL AS INT) + uc, 0) AS score FROM fs JOIN cz USING (symbol, bar_ts), ac),
ak AS (SELECT *, row_number() OVER (PARTITION BY config, bar_ts ORDER BY score DESC, symbol) AS up, count(*) OVER (PARTITION BY config, bar_ts) AS n FROM az WHERE score IS NOT NULL AND vol IS NOT NULL),
asd AS (SELECT *, CASE WHEN up <= 2 THEN 1 ELSE -1 END AS side, CASE WHEN rp = 1 THEN 1 / (vol + 1e-8) ELSE 1 END AS inv FROM ak WHERE n >= 4 AND (up <= 2 OR up > n - 2)),
aw AS (SELECT config, symbol, bar_ts, side * 0.5 * inv / sum(inv) OVER (PARTITION BY config, bar_ts, side) AS weight FROM asd),
acal AS (SELECT bar_ts, row_number() OVER (ORDER BY bar_ts) - 1 AS t FROM (SELECT DISTINCT bar_ts FROM panel)),
ag AS (SELECT config, symbol, bar_ts, ret, CASE WHEN t % CASE WHEN hold = 1 THEN 4 ELSE 1 END = 0 THEN coalesce(weight, 0) END AS s FROM (SELECT config, hold, symbol, bar_ts, ret FROM rets, ac) JOIN acal USING (bar_ts) LEFT JOIN aw USING (config, symbol, bar_ts)),
ah AS (SELECT config, symbol, bar_ts, ret, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY config, symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING), 0) AS weight FROM ag),
al AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY config, symbol ORDER BY bar_ts), 0) AS was FROM ah),
ap AS (SELECT config, bar_ts, sum(was * coalesce(ret, 0)) - sum(abs(weight - was)) * 10 / 1e4 AS net FROM al GROUP BY 1, 2)
SELECT config, count(*) AS n, {r('sum(net) AS total', 'stddev_samp(net) * sqrt(52) AS vol', 'avg(net) / stddev_samp(net) * sqrt(52) AS sharpe')} FROM ap GROUP BY 1""")
def _(spark, d):
    # Scores of all nine configurations widen one pass; weights are set where they rebalance and carried on.
    z = week_carry(spark, d).select("symbol", "bar_ts", A.guarded_zscore("carry").alias("zc"))
    x = week_factors(spark, d).select("symbol", "bar_ts", "ret", "vol", "zm", "zv").join(z, ["symbol", "bar_ts"], "left")
    days = W.split_of(x).select("bar_ts", (F.row_number().over(Window.orderBy("bar_ts")) - 1).alias("t"))  # one row per date
    rows = []
    for name, (m, v, c, rp, hold) in ABLATIONS.items():
        rows.append(F.struct(F.lit(name).alias("config"), F.lit(rp).alias("rp"), F.lit(4 if hold else 1).alias("every"), A.composite(*[s for s, on in (("zm", m), ("zv", v), ("zc", c)) if on]).alias("score")))
    wide = x.join(days.hint("merge"), "bar_ts").select("symbol", "bar_ts", "t", "ret", "vol", F.inline(F.array(*rows)))
    ends = A.both_ends(wide.filter("vol is not null"), "score", 2, ["config"]).withColumn("share", F.when(F.col("rp") == 1, F.col("vol")).otherwise(F.lit(1.0) - 1e-8))
    weights = A.inverse_vol(ends, "share", ["config"]).select("config", "bar_ts", "symbol", "weight")
    grid = wide.select("config", "every", "symbol", "bar_ts", "t", "ret")
    held = A.held_between(grid, weights, F.col("every"), ["config"])
    p = A.portfolio(held, 10.0, ["config"])
    return rounded(p.groupBy("config").agg(F.count("net").alias("n"), F.sum("net").alias("total"), (F.stddev_samp("net") * YEAR**0.5).alias("vol"), sharpe_ratio("net", YEAR).alias("sharpe")))


#: name: momentum, value, carry, hysteresis of ranks, inverse-volatility weights. All are set every EVERY bars and held between.
SWITCHES = {"baseline": (1, 1, 1, 1, 1), "no_momentum": (0, 1, 1, 1, 1), "no_value": (1, 0, 1, 1, 1), "no_carry": (1, 1, 0, 1, 1), "no_hysteresis": (1, 1, 1, 0, 1), "equal_weight": (1, 1, 1, 1, 0), "momentum": (1, 0, 0, 1, 1), "value": (0, 1, 0, 1, 1), "carry": (0, 0, 1, 1, 1)}


@register("fa14_hysteresis", f"""WITH RECURSIVE {WEEK}, {SCORES}, {CARRY}, ac AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {', '.join(map(str, v))})" for k, v in SWITCHES.items())}) AS v(config, um, uv, uc, hy, rp)),
acal AS (SELECT bar_ts, row_number() OVER (ORDER BY bar_ts) - 1 AS t FROM (SELECT DISTINCT bar_ts FROM panel)),
az AS (SELECT config, hy, rp, fs.symbol, fs.bar_ts, vol, (CASE WHEN um = 1 THEN coalesce(zm, 0) ELSE 0 END + CASE WHEN uv = 1 THEN coalesce(zv, 0) ELSE 0 END + CASE WHEN uc = 1 THEN zc ELSE 0 END) / nullif(CAST(um = 1 AND zm IS NOT NULL AS INT) + CAST(uv = 1 AND zv IS NOT NULL AS INT) + uc, 0) AS score FROM fs JOIN cz USING (symbol, bar_ts) JOIN acal USING (bar_ts), ac WHERE t % {EVERY} = 0),
ak AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY config, bar_ts ORDER BY score DESC, symbol) AS up, count(*) OVER (PARTITION BY config, bar_ts) AS n FROM az WHERE score IS NOT NULL AND vol IS NOT NULL),
hl AS MATERIALIZED (SELECT config, hy, bar_ts, list(symbol ORDER BY up) AS names, row_number() OVER (PARTITION BY config ORDER BY bar_ts) AS k FROM ak WHERE n >= {2 * K} GROUP BY 1, 2, 3),
h0 AS (SELECT DISTINCT config, 0::BIGINT AS k, NULL::DATE AS bar_ts, []::VARCHAR[] AS longs, []::VARCHAR[] AS shorts FROM hl
  UNION ALL SELECT q.config, q.k, q.bar_ts, q.longs, list_concat(q.ks, list_filter(list_reverse(q.names), lambda s: NOT list_contains(q.ks, s) AND NOT list_contains(q.longs, s)))[1:{K}] FROM (
    SELECT p.*, list_filter(list_reverse(p.names), lambda s: p.hy = 1 AND list_contains(p.ps, s) AND list_position(p.names, s) >= {K + 2} AND NOT list_contains(p.longs, s)) AS ks FROM (
      SELECT o.*, list_concat(o.kl, list_filter(o.names, lambda s: NOT list_contains(o.kl, s)))[1:{K}] AS longs FROM (
        SELECT hl.config, hl.hy, hl.k, hl.bar_ts, hl.names, h0.shorts AS ps, list_filter(hl.names, lambda s: hl.hy = 1 AND list_contains(h0.longs, s) AND list_position(hl.names, s) <= {K + 2}) AS kl FROM h0 JOIN hl ON hl.config = h0.config AND hl.k = h0.k + 1) o) p) q),
hn AS (SELECT config, bar_ts, unnest(longs) AS symbol, 1 AS side FROM h0 UNION ALL SELECT config, bar_ts, unnest(shorts), -1 FROM h0),
hs AS (SELECT config, bar_ts, symbol, side, CASE WHEN rp = 1 THEN 1 / (vol + 1e-8) ELSE 1 END AS inv FROM hn JOIN ak USING (config, bar_ts, symbol)),
aw AS (SELECT config, symbol, bar_ts, side * 0.5 * inv / sum(inv) OVER (PARTITION BY config, bar_ts, side) AS weight FROM hs),
ag AS (SELECT config, symbol, bar_ts, ret, CASE WHEN t % {EVERY} = 0 THEN coalesce(weight, 0) END AS s FROM (SELECT config, symbol, bar_ts, ret FROM rets, ac) JOIN acal USING (bar_ts) LEFT JOIN aw USING (config, symbol, bar_ts)),
ah AS (SELECT config, symbol, bar_ts, ret, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY config, symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING), 0) AS weight FROM ag),
al AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY config, symbol ORDER BY bar_ts), 0) AS was FROM ah),
ap AS (SELECT config, bar_ts, sum(abs(weight - was)) AS turnover, sum(was * coalesce(ret, 0)) - sum(abs(weight - was)) * 10 / 1e4 AS net FROM al GROUP BY 1, 2)
SELECT config, count(*) AS n, {r('sum(turnover) AS turnover', 'sum(net) AS total', 'stddev_samp(net) * sqrt(52) AS vol', 'avg(net) / stddev_samp(net) * sqrt(52) AS sharpe')} FROM ap GROUP BY 1""")
def _(spark, d):
    # The three scores are written once; the configurations widen them.
    x = week_factors(spark, d).select("symbol", "bar_ts", "ret", "vol", "zm", "zv")
    z = week_carry(spark, d).select("symbol", "bar_ts", A.guarded_zscore("carry").alias("zc"))
    scores = staged(x.join(z, ["symbol", "bar_ts"], "left"), "ablation")
    days = W.split_of(scores).select("bar_ts", (F.row_number().over(Window.orderBy("bar_ts")) - 1).alias("t"))  # one row per date
    rows = [F.struct(F.lit(name).alias("config"), F.lit(hy).alias("hy"), F.lit(rp).alias("rp"), A.composite(*[s for s, on in zip(("zm", "zv", "zc"), used) if on]).alias("score")) for name, (*used, hy, rp) in SWITCHES.items()]
    wide = scores.join(days.hint("merge"), "bar_ts").select("symbol", "bar_ts", "t", "ret", "vol", F.inline(F.array(*rows)))
    due = wide.filter((F.col("t") % EVERY == 0) & F.col("score").isNotNull() & F.col("vol").isNotNull())
    day = Window.partitionBy("config", "bar_ts")
    ranks = due.filter("hy = 1").withColumn("rnk", F.row_number().over(day.orderBy(F.desc("score"), "symbol"))).withColumn("n", F.count(F.lit(1)).over(day)).filter(F.col("n") >= 2 * K)
    kept = A.hysteresis(ranks.select("config", "bar_ts", "symbol", "rnk"), K, K + 2, K + 2, ["config"])
    side = lambda names, s: F.transform(names, lambda x: F.struct(x.alias("symbol"), F.lit(s).alias("side")))
    kept = kept.select("config", "bar_ts", F.inline(F.concat(side("longs", 1), side("shorts", -1))))
    plain = A.both_ends(due.filter("hy = 0"), "score", K, ["config"]).select("config", "bar_ts", "symbol", "side")
    chosen = due.hint("merge").join(kept.unionByName(plain).hint("merge"), ["config", "bar_ts", "symbol"]).withColumn("share", F.when(F.col("rp") == 1, F.col("vol")).otherwise(F.lit(1.0) - 1e-8))
    held = A.held_between(wide.select("config", "symbol", "bar_ts", "t", "ret"), A.inverse_vol(chosen, "share", ["config"]), EVERY, ["config"])
    p = A.portfolio(held, 10.0, ["config"])
    return rounded(p.groupBy("config").agg(F.count("net").alias("n"), F.sum("turnover").alias("turnover"), F.sum("net").alias("total"), (F.stddev_samp("net") * YEAR**0.5).alias("vol"), sharpe_ratio("net", YEAR).alias("sharpe")))


BLENDS = """
bz0 AS (SELECT bar_ts, x, y, CASE WHEN count(x) OVER v = 12 THEN stddev_samp(x) OVER v END AS sx, CASE WHEN count(x) OVER v = 12 THEN stddev_samp(y) OVER v END AS sy, CASE WHEN count(x) OVER c = 26 THEN covar_samp(x, y) OVER c END AS c, product(1 + x) OVER (ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS eq FROM pv WINDOW v AS (ORDER BY bar_ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), c AS (ORDER BY bar_ts ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)),
bz1 AS (SELECT *, eq / max(eq) OVER (ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) - 1 AS dd, CASE WHEN sx = 0 THEN 0.01 ELSE sx END AS a, CASE WHEN sy = 0 THEN 0.01 ELSE sy END AS b FROM bz0),
bz AS (SELECT *, (1 / a) / (1 / a + 1 / b) AS wv, CASE WHEN c IS NOT NULL THEN greatest(0.1, least(0.9, (b * b - c) / (a * a + b * b - 2 * c + 1e-8))) END AS wm, CASE WHEN coalesce(lag(dd) OVER (ORDER BY bar_ts), 0) < -0.08 THEN 0.3 ELSE 0.7 END AS wd FROM bz1)"""


@register("fa15_blends", f"WITH {MOVED}, {PAIRED}, {BLENDS} SELECT bar_ts, {r('0.5 * x + 0.5 * y AS equal', '0.7 * x + (1 - 0.7) * y AS tilted', 'wv * x + (1 - wv) * y AS inverse_vol', 'wm * x + (1 - wm) * y AS least_variance', 'wd * x + (1 - wd) * y AS gated')} FROM bz")
def _(spark, d):
    return rounded(A.blended(paired(spark, d), 12, 26))


@register("fa16_borrow_and_slippage", f"WITH {WEEK}, {SCORES}, {HELD}, s AS (SELECT config, sum(was * coalesce(ret, 0)) AS gross, sum(abs(weight - was)) AS moved, sum(greatest(-was, 0)) AS short, count(DISTINCT bar_ts) AS bars FROM pl GROUP BY 1), b AS (SELECT unnest([0, 25, 100, 300, 1000]) AS borrow_bps), c AS (SELECT unnest([0, 2, 5, 10]) AS slip_bps) SELECT config, borrow_bps, slip_bps, {r('gross - moved * (10 + slip_bps) / 1e4 - short * borrow_bps / 1e4 / 52 AS total', '(gross - moved * (10 + slip_bps) / 1e4 - short * borrow_bps / 1e4 / 52) / bars * 52 AS annual')} FROM s, b, c")
def _(spark, d):
    was = F.coalesce(F.lag("weight").over(Window.partitionBy("config", "symbol").orderBy("bar_ts")), F.lit(0.0))
    x = week_held(spark, d).withColumn("was", was)
    g = x.groupBy("config").agg(F.sum(F.col("was") * F.coalesce("ret", F.lit(0.0))).alias("gross"), F.sum(F.abs(F.col("weight") - F.col("was"))).alias("moved"), F.sum(F.greatest(-F.col("was"), F.lit(0.0))).alias("short"), F.count_distinct("bar_ts").alias("bars"))
    # Costs are linear in turnover and short exposure: the grid never replays the portfolio.
    out = g.withColumn("borrow_bps", F.explode(F.array(*[F.lit(v) for v in (0, 25, 100, 300, 1000)]))).withColumn("slip_bps", F.explode(F.array(*[F.lit(v) for v in (0, 2, 5, 10)])))
    total = F.col("gross") - F.col("moved") * (10 + F.col("slip_bps")) / 1e4 - F.col("short") * F.col("borrow_bps") / 1e4 / YEAR
    return rounded(out.select("config", "borrow_bps", "slip_bps", total.alias("total"), (total / F.col("bars") * YEAR).alias("annual")))


@register("fa17_drawdown_hedge", f"WITH {MOVED}, {PAIRED}, e AS (SELECT bar_ts, x, y, sum(x) OVER (ORDER BY bar_ts) AS cum FROM pv), f AS (SELECT *, cum - max(cum) OVER (ORDER BY bar_ts) AS dd FROM e), t AS (SELECT unnest([0.05::DOUBLE, 0.1, 0.15]) AS threshold) SELECT threshold, count(*) FILTER (dd < -threshold) AS bars, {r('avg(x) FILTER (dd < -threshold) * 52 AS own', 'avg(y) FILTER (dd < -threshold) * 52 AS hedge', 'avg(0.5 * x + 0.5 * y) FILTER (dd < -threshold) * 52 AS both')} FROM f, t GROUP BY 1")
def _(spark, d):
    t = Window.orderBy("bar_ts")  # one row per date
    f = paired(spark, d).withColumn("cum", F.sum("x").over(t)).withColumn("dd", F.col("cum") - F.max("cum").over(t))
    f = f.withColumn("threshold", F.explode(F.array(*[F.lit(v) for v in (0.05, 0.1, 0.15)])))
    hedge = lambda c: A.max_drawdown_hedge(F.col("dd"), c, F.col("threshold"))
    x, y = F.col("x"), F.col("y")
    return rounded(f.groupBy("threshold").agg(hedge(x)[1].alias("bars"), (hedge(x)[0] * YEAR).alias("own"), (hedge(y)[0] * YEAR).alias("hedge"), (hedge(0.5 * x + 0.5 * y)[0] * YEAR).alias("both")))


@register("st11_label_null", f"WITH {WEEK}, {MULTIPLIERS}, mk AS (SELECT bar_ts, coalesce(avg(ret), 0) AS ret FROM rets GROUP BY 1), x AS (SELECT composite AS mult, ret, row_number() OVER (ORDER BY bar_ts) - 1 AS k FROM mul JOIN mk USING (bar_ts)), p AS (SELECT draw, mult, row_number() OVER (PARTITION BY draw ORDER BY CASE WHEN draw = 0 THEN lpad(CAST(k AS VARCHAR), 12, '0') ELSE md5(draw || '|' || k) END, k) - 1 AS k FROM x, (SELECT unnest(range(0, {DRAWS + 1})) AS draw)), s AS (SELECT draw, avg(p.mult * ret) / stddev_samp(p.mult * ret) * sqrt(52) AS sharpe FROM p JOIN (SELECT k, ret FROM x) USING (k) GROUP BY 1), z AS {NULLED.format(t='s', c=SUMMARY)}")
def _(spark, d):
    mkt = week_returns(spark, d).groupBy("bar_ts").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("ret"))
    x = week_multipliers(spark, d).select("bar_ts", F.col("composite").alias("mult")).join(mkt, "bar_ts")
    return rounded(I.against_draws(I.label_shuffles(x, DRAWS, YEAR), "sharpe"))


CURVES = "SELECT symbol, bar_ts, net, sum(net) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS cum FROM"


@register("st18_scorecard", f"""WITH {WEEK}, {LABELS}, {SIGNALS}, {EARNED}, {CONTROL}, {SPLIT}, a0 AS ({CURVES} ern), a1 AS (SELECT *, cum - max(cum) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS dd FROM a0), b0 AS ({CURVES} cern), b1 AS (SELECT *, cum - max(cum) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS dd FROM b0),
a AS (SELECT symbol, avg(net) FILTER (split = 'TRUE_OOS') AS oos, avg(net) / nullif(stddev_samp(net), 0) AS s, min(dd) AS dd, sum(net) AS total FROM a1 JOIN spl USING (bar_ts) GROUP BY 1), b AS (SELECT symbol, avg(net) FILTER (split = 'TRUE_OOS') AS oos, avg(net) / nullif(stddev_samp(net), 0) AS s, min(dd) AS dd FROM b1 JOIN spl USING (bar_ts) GROUP BY 1),
f AS (SELECT symbol, coalesce(a.oos > 0, false) AS oos_positive, coalesce(a.oos >= b.oos, false) AS beats_control, coalesce(a.dd >= b.dd - 0.02, false) AS drawdown_no_worse, coalesce(a.total > 0, false) AS survives_costs, coalesce(a.s > b.s, false) AS not_cash_drag FROM a JOIN b USING (symbol))
SELECT *, CAST(oos_positive AS BIGINT) + CAST(beats_control AS BIGINT) + CAST(drawdown_no_worse AS BIGINT) + CAST(survives_costs AS BIGINT) + CAST(not_cash_drag AS BIGINT) AS passed, CASE WHEN oos_positive AND beats_control AND drawdown_no_worse AND survives_costs AND not_cash_drag THEN 'PROMOTE' WHEN oos_positive THEN 'RETAIN' ELSE 'REJECT' END AS verdict FROM f""")
def _(spark, d):
    split = W.split_of(weekly_panel(spark, d))

    def totals(x, p):
        x = x.withColumn("cum", F.sum("net").over(W.so_far())).withColumn("dd", F.col("cum") - F.max("cum").over(W.so_far())).join(split, "bar_ts")
        return x.groupBy("symbol").agg(F.avg(F.when(F.col("split") == "TRUE_OOS", F.col("net"))).alias(f"{p}oos"), (F.avg("net") / F.nullif(F.stddev_samp("net"), F.lit(0.0))).alias(f"{p}s"), F.min("dd").alias(f"{p}dd"), F.sum("net").alias(f"{p}total"))

    c = F.col
    both = totals(week_earned(spark, d), "a").join(totals(week_control(spark, d), "b"), "symbol")
    tests = {"oos_positive": c("aoos") > 0, "beats_control": c("aoos") >= c("boos"), "drawdown_no_worse": c("add") >= c("bdd") - 0.02, "survives_costs": c("atotal") > 0, "not_cash_drag": c("as") > c("bs")}
    return P.scorecard(both.select("symbol", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in tests.items()]), list(tests), "oos_positive")
