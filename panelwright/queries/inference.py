"""Registered queries of nulls, bootstraps and regressions on the weekly panel, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.maths import ACKLAM, normal_cdf, normal_quantile
from ..operators import inference as I
from ..operators import performance as P
from ..operators import regime as R
from .panel import EARNED, LABELS, MIN_TRAIN, ORACLES, QUERIES, SIGNALS, WEEK, WIN, r, register, rounded, week_earned, week_labels, week_returns

#: Draws, least distance of a rotation from the real phase, bootstrap block.
DRAWS, GUARD, BLOCK, LAGS = 100, 26, 13, 4
PHASED = f"""
nl0 AS (SELECT symbol, bar_ts, state, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM lab),
dr AS (SELECT unnest(range(1, {DRAWS + 1})) AS draw),
nl1 AS (SELECT symbol, draw, {{k}} AS k, state FROM nl0, dr WHERE n > {2 * GUARD}),
nlab AS (SELECT nl1.symbol || '#' || draw AS symbol, bar_ts, k AS idx, NULL AS close, NULL AS wret, nl1.state FROM nl1 JOIN (SELECT symbol, k, bar_ts FROM nl0) USING (symbol, k)),
nrets AS (SELECT nlab.symbol, nlab.bar_ts, ret FROM nlab JOIN rets ON rets.symbol = split_part(nlab.symbol, '#', 1) AND rets.bar_ts = nlab.bar_ts)"""
ROTATED = PHASED.format(k=f"(k + {GUARD} + (draw * 7919) % (n - {2 * GUARD})) % n")
SHUFFLED = PHASED.format(k="row_number() OVER (PARTITION BY symbol, draw ORDER BY md5(symbol || '|' || draw || '|' || k), k) - 1")
NULL = (SIGNALS + ", " + EARNED).replace("FROM lab ", "FROM nlab ").replace("JOIN rets", "JOIN nrets").replace("sig", "nsig").replace("nnsig", "nsig").replace("AS nsignal", "AS signal").replace("nsignal", "signal")
NULL = NULL.replace("pos AS (", "npos AS (").replace("held AS (", "nheld AS (").replace("FROM pos)", "FROM npos)").replace("ern AS (", "nern AS (").replace("FROM held)", "FROM nheld)")
SHARPE = "{a} AS (SELECT symbol, CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(52) END AS sharpe FROM {b} GROUP BY 1)"


def sharpe(df):
    sd = F.stddev_samp("net")
    return df.groupBy("symbol").agg(F.when(sd > 0, F.avg("net") / sd * math.sqrt(52)).alias("sharpe"))


def null_sharpe(spark, d, shuffle: bool = False, count: int = DRAWS):
    x = I.rephased(week_labels(spark, d), week_returns(spark, d), count, GUARD, shuffle)
    signals = R.walk_forward(x, WIN, MIN_TRAIN)
    pos = signals.withColumn("pos", R.filter_position(F.col("signal"), 0.05, F.lit(0.1)))
    return sharpe(P.earned(pos.select("symbol", "bar_ts", "pos", "ret"), ["symbol"]))


def by_name(df):
    return df.withColumn("symbol", F.split_part("symbol", F.lit("#"), F.lit(1)))


@register("st1_rotation_null", f"WITH {WEEK}, {LABELS}, {ROTATED}, {NULL}, {SHARPE.format(a='ns', b='nern')} SELECT symbol, {r('sharpe')} FROM ns")
def _(spark, d):
    return rounded(null_sharpe(spark, d))


@register("st2_shuffle_null", f"WITH {WEEK}, {LABELS}, {SHUFFLED}, {NULL}, {SHARPE.format(a='ns', b='nern')} SELECT symbol, {r('sharpe')} FROM ns")
def _(spark, d):
    return rounded(null_sharpe(spark, d, True))


@register("st3_empirical_p", f"""WITH {WEEK}, {LABELS}, {SIGNALS}, {EARNED}, {SHARPE.format(a='rs', b='ern')}, {ROTATED}, {NULL}, {SHARPE.format(a='ns', b='nern')},
b AS (SELECT rs.symbol, rs.sharpe AS actual, ns.sharpe AS v FROM ns JOIN rs ON rs.symbol = split_part(ns.symbol, '#', 1) WHERE ns.sharpe IS NOT NULL)
SELECT symbol, count(*) AS n_draws, {r('any_value(actual) AS real', 'avg(v) AS mean', 'median(v) AS median', 'quantile_cont(v, 0.05) AS q05', 'quantile_cont(v, 0.95) AS q95', '(count(*) FILTER (v >= actual) + 1) / (count(*) + 1) AS p', '100 * (count(*) - count(*) FILTER (v >= actual)) / count(*) AS percentile')} FROM b GROUP BY 1""")
def _(spark, d):
    return rounded(I.empirical(sharpe(week_earned(spark, d)), by_name(null_sharpe(spark, d)), "sharpe"))


def _pick(n: str, *parts: str) -> str:
    return f"((('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 12))::BIGINT) % {n})"


NUMBERED = "bx AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM rets WHERE ret IS NOT NULL)"
PATHS = """
pe AS (SELECT *, product(1 + ret) OVER (PARTITION BY symbol, draw ORDER BY j ROWS UNBOUNDED PRECEDING) AS eq FROM bd),
pd AS (SELECT *, eq / greatest(1.0, max(eq) OVER (PARTITION BY symbol, draw ORDER BY j ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM pe),
pp AS (SELECT symbol, draw, count(*) AS n, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(52) END AS sharpe, product(1 + ret) AS growth, min(dd) AS max_drawdown FROM pd GROUP BY 1, 2),
pq AS (SELECT *, CASE WHEN growth > 0 THEN growth ** (52.0 / n) - 1 ELSE -1.0 END AS cagr FROM pp)"""
POINTS = (("lo", 0.025), ("mid", 0.5), ("hi", 0.975))


@register("st8_block_bootstrap", f"""WITH {WEEK}, {NUMBERED}, bp AS (SELECT symbol, draw, k AS j, ({_pick('n', 'symbol', 'draw', f'(k // {BLOCK})')} + k % {BLOCK}) % n AS k FROM bx, (SELECT unnest(range(1, {DRAWS + 1})) AS draw)),
bd AS (SELECT bp.symbol, draw, j, ret FROM bp JOIN bx USING (symbol, k)), {PATHS}
SELECT symbol, {r(*[f'quantile_cont({m}, {q}) AS {m}_{n}' for m in ('sharpe', 'cagr', 'max_drawdown') for n, q in POINTS])} FROM pq GROUP BY 1""")
def _(spark, d):
    m = I.path_metrics(I.block_bootstrap(week_returns(spark, d), DRAWS, BLOCK), 52)
    return rounded(m.groupBy("symbol").agg(*[F.percentile(c, q).alias(f"{c}_{n}") for c in ("sharpe", "cagr", "max_drawdown") for n, q in POINTS]))


@register("st9_block_permutation", f"""WITH {WEEK}, {NUMBERED}, bb AS (SELECT *, k // {BLOCK} AS b FROM bx WHERE k < n // {BLOCK} * {BLOCK}), bo AS (SELECT symbol, b, draw, row_number() OVER (PARTITION BY symbol, draw ORDER BY CASE WHEN draw = 0 THEN lpad(CAST(b AS VARCHAR), 12, '0') ELSE md5(symbol || '|' || draw || '|' || b) END, b) - 1 AS place FROM (SELECT DISTINCT symbol, b FROM bb), (SELECT unnest(range(0, {DRAWS + 1})) AS draw)),
bd AS (SELECT bo.symbol, draw, place * {BLOCK} + k % {BLOCK} AS j, ret FROM bo JOIN bb USING (symbol, b)), {PATHS}, pr AS (SELECT symbol, max_drawdown AS real FROM pq WHERE draw = 0)
SELECT symbol, count(*) AS n_draws, {r('any_value(real) AS real', '(count(*) FILTER (max_drawdown >= real) + 1) / (count(*) + 1) AS p', 'avg(max_drawdown) AS mean', 'quantile_cont(max_drawdown, 0.05) AS q05', 'quantile_cont(max_drawdown, 0.95) AS q95')} FROM pq JOIN pr USING (symbol) WHERE draw > 0 GROUP BY 1""")
def _(spark, d):
    m = I.path_metrics(I.block_permutation(week_returns(spark, d), DRAWS, BLOCK), 52)
    return rounded(I.against_draws(m, "max_drawdown", ["symbol"]))


NULLED = "(SELECT sharpe AS real FROM {t} WHERE draw = 0) SELECT count(*) AS n_draws, " + "{c} FROM {t}, z WHERE draw > 0"
SUMMARY = r('any_value(real) AS real', '(count(*) FILTER (sharpe >= real) + 1) / (count(*) + 1) AS p', 'avg(sharpe) AS mean', 'quantile_cont(sharpe, 0.05) AS q05', 'quantile_cont(sharpe, 0.95) AS q95')


@register("st10_panel_roll", f"""WITH {WEEK}, cd AS (SELECT bar_ts, row_number() OVER (ORDER BY bar_ts) - 1 AS t, count(*) OVER () AS n FROM (SELECT DISTINCT bar_ts FROM rets)),
ro AS (SELECT draw, symbol, (t + CASE WHEN draw = 0 THEN 0 ELSE {GUARD} + (draw * 7919) % (n - {2 * GUARD}) END) % n AS t, ret FROM rets JOIN cd USING (bar_ts), (SELECT unnest(range(0, {DRAWS + 1})) AS draw) WHERE ret IS NOT NULL),
rm AS (SELECT *, CASE WHEN count(ret) OVER w = 12 THEN sum(ret) OVER w END AS mom FROM ro WINDOW w AS (PARTITION BY draw, symbol ORDER BY t ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
rk AS (SELECT draw, t, ret, row_number() OVER (PARTITION BY draw, t ORDER BY mom DESC, symbol) AS up, count(*) OVER (PARTITION BY draw, t) AS m FROM rm WHERE mom IS NOT NULL),
rd AS (SELECT draw, t, sum(CASE WHEN up <= 2 THEN ret / 2 WHEN up > m - 2 THEN -ret / 2 END) AS r FROM rk WHERE m >= 4 GROUP BY 1, 2), rs AS (SELECT draw, avg(r) / stddev_samp(r) * sqrt(52) AS sharpe FROM rd GROUP BY 1), z AS {NULLED.format(t='rs', c=SUMMARY)}""")
def _(spark, d):
    return rounded(I.against_draws(I.panel_rolls(week_returns(spark, d), DRAWS, GUARD, 12, 2, 52), "sharpe"))


@register("st12_bootstrap_mean", f"WITH {WEEK}, m AS (SELECT symbol, avg(ret) AS m FROM rets GROUP BY 1), k AS (SELECT m, row_number() OVER (ORDER BY symbol) - 1 AS k, count(*) OVER () AS n FROM m), p AS (SELECT draw, {_pick('n', 'draw', 'k')} AS k FROM k, (SELECT unnest(range(1, 10001)) AS draw)), a AS (SELECT draw, avg(m) AS a FROM p JOIN k USING (k) GROUP BY 1), o AS (SELECT avg(m) AS mean, avg(m) / (stddev_samp(m) / sqrt(count(m))) AS t FROM m) SELECT {r('quantile_cont(a, 0.025) AS lo', 'median(a) AS mid', 'quantile_cont(a, 0.975) AS hi', 'any_value(mean) AS mean', 'any_value(t) AS t')} FROM a, o")
def _(spark, d):
    m = week_returns(spark, d).groupBy("symbol").agg(F.avg("ret").alias("m"))
    return rounded(I.resampled_mean(m, "symbol", "m", 10_000))


@register("st13_welch", f"WITH {WEEK}, {LABELS}, x AS (SELECT lab.symbol, state, ret FROM lab JOIN rets USING (symbol, bar_ts)), g AS (SELECT symbol, count(ret) FILTER (state = 2) AS n1, count(ret) FILTER (state = 0) AS n2, avg(ret) FILTER (state = 2) AS m1, avg(ret) FILTER (state = 0) AS m2, var_samp(ret) FILTER (state = 2) AS v1, var_samp(ret) FILTER (state = 0) AS v2 FROM x GROUP BY 1) SELECT symbol, n1, n2, {r('m1', 'm2', '(m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t')} FROM g")
def _(spark, d):
    x = week_labels(spark, d).join(week_returns(spark, d).select("symbol", "bar_ts", "ret"), ["symbol", "bar_ts"])
    return rounded(I.welch(x, ["symbol"], "ret", F.col("state") == 2, F.col("state") == 0))


def _lagged(a: str, b: str) -> str:
    return " + ".join(f"{1 - k / (LAGS + 1)} * {a} * coalesce(lag({b}, {k}) OVER t, 0)" for k in range(1, LAGS + 1))


NW = f"""
nx AS (SELECT symbol, bar_ts, ret AS y, avg(ret) OVER (PARTITION BY bar_ts) AS x FROM rets WHERE ret IS NOT NULL),
nf AS (SELECT symbol, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, regr_intercept(y, x) AS alpha, regr_slope(y, x) AS beta, regr_r2(y, x) AS r2 FROM nx GROUP BY 1),
ne AS (SELECT nx.*, y - alpha - beta * x AS u, (y - alpha - beta * x) * x AS v FROM nx JOIN nf USING (symbol)),
nr AS (SELECT symbol, u * u + 2 * ({_lagged('u', 'u')}) AS s11, u * v + ({_lagged('u', 'v')}) + ({_lagged('v', 'u')}) AS s12, v * v + 2 * ({_lagged('v', 'v')}) AS s22 FROM ne WINDOW t AS (PARTITION BY symbol ORDER BY bar_ts)),
ng AS (SELECT symbol, sum(s11) AS s11, sum(s12) AS s12, sum(s22) AS s22 FROM nr GROUP BY 1),
nv AS (SELECT *, (sxx * sxx * s11 - 2 * sx * sxx * s12 + sx * sx * s22) / (n * sxx - sx * sx) ** 2 AS va, (sx * sx * s11 - 2 * n * sx * s12 + n * n * s22) / (n * sxx - sx * sx) ** 2 AS vb FROM nf JOIN ng USING (symbol))"""


@register("st14_newey_west", f"WITH {WEEK}, {NW} SELECT symbol, n, {r('alpha', 'beta', 'alpha / sqrt(va) AS t_alpha', 'beta / sqrt(vb) AS t_beta', 'r2')} FROM nv")
def _(spark, d):
    x = week_returns(spark, d).filter("ret is not null").withColumn("mkt", F.avg("ret").over(I.Window.partitionBy("bar_ts")))
    return rounded(I.newey_west(x, "symbol", "ret", "mkt", LAGS))


def _horner(c, x: str) -> str:
    out = "0"
    for k in c:
        out = f"({out} * {x} + ({k}))"
    return out


def _quantile(p: str) -> str:
    a, b, c, d = ACKLAM
    m, low, high = f"(({p}) - 0.5) * (({p}) - 0.5)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))"
    return f"CASE WHEN ({p}) < 0.02425 THEN {_horner(c, low)} / {_horner(d, low)} WHEN ({p}) > 0.97575 THEN -({_horner(c, high)} / {_horner(d, high)}) ELSE {_horner(a, m)} * (({p}) - 0.5) / {_horner(b, m)} END"


def _cdf(x: str) -> str:
    poly = "0"
    for c in reversed((0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)):
        poly = f"(({poly} + {c}) / (1 + 0.2316419 * abs({x})))"
    tail = f"exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {poly}"
    return f"CASE WHEN ({x}) >= 0 THEN 1 - {tail} ELSE {tail} END"


@register("st5_deflated_sharpe", f"""WITH {WEEK}, q AS (SELECT symbol, count(ret) AS n, avg(ret) / stddev_samp(ret) AS s, skewness(ret) AS skew, kurtosis(ret) AS kurt FROM rets GROUP BY 1),
m AS (SELECT count(*) AS trials, stddev_samp(s) AS sd FROM q), e AS (SELECT trials, sd, 1 - 1.0::DOUBLE / trials AS p1, 1 - 1 / (trials * exp(1.0::DOUBLE)) AS p2 FROM m),
b AS (SELECT trials, sd * ((1 - 0.5772156649015329) * ({_quantile('p1')}) + 0.5772156649015329 * ({_quantile('p2')})) AS bench FROM e),
z AS (SELECT symbol, n, s, bench, (s - bench) * sqrt(n - 1) / sqrt(1 - skew * s + (kurt + 2) / 4 * s * s) AS z FROM q, b)
SELECT symbol, n, {r('s', 'bench')}, round({_cdf('z')}, 6) AS dsr FROM z""")
def _(spark, d):
    q = P.sharpe_stats(week_returns(spark, d), ["symbol"], "ret", 1)
    return rounded(P.deflated(q, normal_quantile, normal_cdf))


def week_market_factors(spark, d):
    """Weekly proxies by date: market, small minus big, high minus low, momentum, short- and long-term reversal, and two spreads."""
    x = week_returns(spark, d)
    own = lambda name: F.avg(F.when(F.col("sector") == name, F.col("ret")))
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    day = x.groupBy("bar_ts").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("mkt"), *[F.coalesce(own(n), F.lit(0.0)).alias(f"s{i}") for i, n in enumerate(names)])
    t = I.Window.orderBy("bar_ts")  # one row per date
    total = lambda n: F.coalesce(F.when(F.count("mkt").over(t.rowsBetween(-n, -1)) == n, F.sum("mkt").over(t.rowsBetween(-n, -1))), F.lit(0.0))
    return day.select("bar_ts", "mkt", (F.col("s0") - F.col("mkt")).alias("smb"), (F.col("s1") - F.col("mkt")).alias("hml"), total(26).alias("mom"), (-F.coalesce(F.lag("mkt").over(t), F.lit(0.0))).alias("srv"), (-total(52)).alias("lrv"), (F.col("s2") - F.col("s3")).alias("def"), (F.col("s4") - F.col("s3")).alias("term"))


def _six_factors(spark, d):
    """ST-15: six regressors per symbol; the tests hold it against numpy."""
    x = week_returns(spark, d).select("symbol", "bar_ts", "ret").join(week_market_factors(spark, d), "bar_ts")
    return rounded(I.ols_hac(x, "symbol", "ret", ["mkt", "smb", "hml", "mom", "srv", "lrv"], 6))


def _macro(spark, d):
    """ST-16: default and term spreads and the market; the tests hold it against numpy."""
    x = week_returns(spark, d).select("symbol", "bar_ts", "ret").join(week_market_factors(spark, d), "bar_ts")
    return rounded(I.ols_hac(x, "symbol", "ret", ["def", "term", "mkt"], 6))


QUERIES |= {"st15_six_factors": _six_factors, "st16_macro_risk": _macro}


DEFLATED = ORACLES["st5_deflated_sharpe"]
STATS = ORACLES["st4_sharpe_stats"]


@register("st17_verdicts", f"WITH st AS ({STATS}), df AS ({DEFLATED}) SELECT symbol, CASE WHEN (lo < 0 AND hi > 0) OR dsr < 0.95 OR t < 2 THEN 'REJECTED' ELSE 'CONFIRMED' END AS verdict, concat_ws(';', CASE WHEN lo < 0 AND hi > 0 THEN 'CI_SPANS_ZERO' END, CASE WHEN dsr < 0.95 THEN 'DSR' END, CASE WHEN t < 2 THEN 'T' END) AS reasons, dsr = 0 OR dsr = 1 AS saturated FROM st JOIN df USING (symbol)")
def _(spark, d):
    x = week_returns(spark, d)
    stats = rounded(P.sharpe_stats(x, ["symbol"], "ret", 52)).select("symbol", "lo", "hi", "t")
    dsr = rounded(P.deflated(P.sharpe_stats(x, ["symbol"], "ret", 1), normal_quantile, normal_cdf)).select("symbol", "dsr")
    return P.verdicts(stats.join(dsr, "symbol"))
