"""Registered queries of the residual engine, each with SQL that a plain SQL engine can check where one exists.

Dates are given as text and inexact numbers rounded to six digits, at the very end only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.operators import backtest as bt
from driftwell.operators import evidence as ev
from driftwell.operators import folds, live, ou, passage, pca, quality, stationarity, stopping
from driftwell.operators import residuals as rs
from driftwell.sources import panels as pn
from driftwell.sources.files import SeriesMapping, repeated_pairs_panel
from driftwell.sources.journal import insert_if_absent

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Z_WINDOW, TREND, FACTOR, PAIR, OU_WINDOW = 60, 26, 52, 52, 60
SIGNAL = {"window": 20, "entry": 1.2, "exit": 0.5, "stop": 2.5}
COSTS = stopping.CostModel(fixed_entry_cost=0.001, fixed_exit_cost=0.002, bid_ask_bps=5, slippage_bps=2, commission=0.0005, annual_opportunity_rate=0.05)
WEEK, DAY, HOUR = pn.WEEKLY_SQL, pn.DAILY_SQL, pn.HOURLY_SQL


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def out(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns: dates as text, doubles to six digits."""
    kinds = dict(df.dtypes)
    col = lambda c: F.col(c).cast("string").alias(c) if kinds[c] in ("date", "timestamp", "timestamp_ntz") else F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c)
    return df.select(*(col(c) for c in columns))


def r6(*columns: str) -> str:
    return ", ".join(f"ROUND({c}, 6) AS {c}" for c in columns)


TS = "CAST(ts AS VARCHAR) AS ts"
RET = "SELECT *, CASE WHEN pos > 0 THEN LN(price / LAG(price) OVER (PARTITION BY ticker ORDER BY pos)) END AS ret FROM panel"
weekly, daily, hourly = pn.weekly_lineitem, pn.daily_orders, pn.hourly_events

# ---- panels, transforms, descriptions


@query("log_returns", f"WITH {DAY}, r AS ({RET}) SELECT ticker, {TS}, {r6('ret')} FROM r WHERE pos > 0")
def log_returns(spark, sf):
    return out(rs.returns(daily(spark, sf)).where("pos > 0"), "ticker", "ts", "ret")


@query("simple_returns", f"WITH {DAY}, r AS (SELECT *, price / LAG(price) OVER (PARTITION BY ticker ORDER BY pos) - 1 AS ret FROM panel) SELECT ticker, {TS}, {r6('ret')} FROM r WHERE pos > 0")
def simple_returns(spark, sf):
    return out(rs.returns(daily(spark, sf), log=False).where("pos > 0"), "ticker", "ts", "ret")


@query("log_prices", f"WITH {DAY} SELECT ticker, {TS}, pos, ROUND(LN(price), 6) AS log_price FROM panel")
def log_prices(spark, sf):
    return out(daily(spark, sf).withColumn("log_price", F.ln("price")), "ticker", "ts", "pos", "log_price")


@query("complete_rows", f"WITH {DAY}, c AS (SELECT ts FROM panel GROUP BY ts HAVING COUNT(price) = COUNT(*)) SELECT ticker, {TS}, {r6('price')} FROM panel WHERE ts IN (SELECT ts FROM c)")
def complete_rows(spark, sf):
    return out(rs.complete_rows(daily(spark, sf)), "ticker", "ts", "price")


@query("price_summary", f"""WITH {DAY}, d AS (SELECT ts, COUNT(price) AS have, COUNT(*) AS n FROM panel GROUP BY ts)
SELECT CAST(MIN(ts) AS VARCHAR) AS start_date, CAST(MAX(ts) AS VARCHAR) AS end_date, COUNT(*) AS observation_count, COUNT(*) FILTER (WHERE have = n) AS complete_row_count, (SELECT COUNT(DISTINCT ticker) FROM panel) AS ticker_count FROM d""")
def price_summary(spark, sf):
    return out(quality.price_summary(daily(spark, sf)), "start_date", "end_date", "observation_count", "complete_row_count", "ticker_count")


@query("data_quality", f"""WITH {HOUR}, g AS (SELECT *, COUNT(price) OVER (PARTITION BY ticker ORDER BY pos) AS k FROM panel),
f AS (SELECT *, FIRST_VALUE(price) OVER (PARTITION BY ticker, k ORDER BY pos) AS filled FROM g), m AS (SELECT *, LAG(filled) OVER (PARTITION BY ticker ORDER BY pos) AS prev FROM f)
SELECT ticker, COUNT(*) AS observation_count, COUNT(*) FILTER (WHERE price IS NULL) AS missing, COUNT(*) FILTER (WHERE price <= 0) AS nonpositive, COUNT(*) - COUNT(DISTINCT ts) AS duplicate_dates, FALSE AS unsorted_dates,
MIN(CASE WHEN price IS NOT NULL THEN ts END) AS first_valid, MAX(CASE WHEN price IS NOT NULL THEN ts END) AS last_valid, COUNT(*) FILTER (WHERE (prev <> 0 AND ABS(filled / prev - 1) > 0.25) OR (prev = 0 AND filled <> 0)) AS large_jumps, ROUND(COUNT(*) / 252.0e0, 6) AS approximate_years FROM m GROUP BY ticker""")
def data_quality(spark, sf):
    df = quality.quality_by_ticker(hourly(spark, sf))
    return out(df, *df.columns)


def _readiness_sql() -> str:
    parts = []
    for key, needs in quality.model_needs().items():
        asked = [(n, column, what) for n, column, what in zip(needs, ("n", "t", "k"), ("dates", "tickers", "complete rows"), strict=True) if n]
        reason = "needs " + " and ".join(f"{n} {what}" for n, _, what in asked)
        parts.append(f"SELECT '{quality.MODELS[key].format(pair=252)}' AS model, {' AND '.join(f'{c} >= {n}' for n, c, _ in asked)} AS ok, '{reason}' AS reason FROM c")
    return " UNION ALL ".join(parts)


@query("model_readiness", f"""WITH {DAY}, d AS (SELECT ts, COUNT(price) AS have, COUNT(*) AS a FROM panel GROUP BY ts), c AS (SELECT COUNT(*) AS n, MAX(a) AS t, COUNT(*) FILTER (WHERE have = a) AS k FROM d),
m AS ({_readiness_sql()}) SELECT model, CASE WHEN ok THEN 'sufficient' ELSE 'insufficient' END AS status, reason FROM m""")
def model_readiness(spark, sf):
    return quality.model_readiness(daily(spark, sf))


@query("panel_violations", f"""WITH {HOUR}, d AS (SELECT ts, COUNT(price) AS have, COUNT(*) AS a, MIN(price) AS low, COUNT(*) - COUNT(DISTINCT ticker) AS twice FROM panel GROUP BY ts)
SELECT CAST(COUNT(*) = 0 AS BIGINT) AS empty, CAST(COALESCE(SUM(twice), 0) AS BIGINT) AS duplicate_cells, COUNT(*) FILTER (WHERE ts IS NULL) AS missing_dates, COUNT(*) FILTER (WHERE have = a AND low <= 0) AS nonpositive_complete_rows FROM d""")
def panel_violations(spark, sf):
    return quality.violations(hourly(spark, sf))


@query("rebased_price", f"WITH {WEEK} SELECT p.ticker, CAST(p.ts AS VARCHAR) AS ts, ROUND(p.price / f.price, 6) AS rebased FROM panel p JOIN panel f ON f.ticker = p.ticker AND f.pos = 0")
def rebased_price(spark, sf):
    return out(rs.rebased(weekly(spark, sf)), "ticker", "ts", "rebased")


@query("chronological_split", f"""WITH {DAY}, n AS (SELECT MAX(pos) + 1 AS n FROM panel), s AS (SELECT CASE WHEN pos < FLOOR(n * 0.6e0) THEN 'train' WHEN pos < FLOOR(n * (0.6e0 + 0.2e0)) THEN 'validation' ELSE 'test' END AS split, p.* FROM panel p, n)
SELECT split, COUNT(*) AS n_cells, MIN(pos) AS first_pos, MAX(pos) AS last_pos FROM s GROUP BY split""")
def chronological_split(spark, sf):
    return rs.chronological_split(daily(spark, sf)).groupBy("split").agg(F.count("*").alias("n_cells"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


TICKERS = ("AF", "AO", "NF", "NO", "RF", "RO")  # all that the weekly panel can have


@query("wide_panel", f"WITH {WEEK} SELECT {TS}, " + ", ".join(f"ROUND(MAX(CASE WHEN ticker = '{t}' THEN price END), 6) AS \"{t}\"" for t in TICKERS) + " FROM panel GROUP BY ts")
def wide_panel(spark, sf):
    return out(pn.to_wide(weekly(spark, sf), list(TICKERS)), "ts", *TICKERS)


@query("repeated_pairs", f"WITH {WEEK} SELECT CAST(ts AS VARCHAR) || ' 00:00:00' AS ts, " + ", ".join(f"ROUND(MAX(CASE WHEN ticker = '{t}' THEN price END), 6) AS {t.lower()}" for t in TICKERS) + " FROM cells GROUP BY ts")
def repeated_pairs(spark, sf):
    """Every series with a date column of its own, its rows closed up, so that the dates of a row differ where cells are missing."""
    cells = weekly(spark, sf).where("price is not null").withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy("ts")))
    of = lambda t, c: F.max(F.when(F.col("ticker") == t, F.col(c).cast("string")))
    raw = cells.groupBy("n").agg(*(of(t, c).alias(f"{t} {name}") for t in TICKERS for c, name in (("ts", "Date"), ("price", "PX"))))
    panel = repeated_pairs_panel(raw, [SeriesMapping(t.lower(), f"{t} Date", f"{t} PX") for t in TICKERS])
    return out(pn.to_wide(panel, [t.lower() for t in TICKERS]), "ts", *(t.lower() for t in TICKERS))


# ---- residual models

Z_SQL = """z AS (SELECT *, LN(price) AS lp, AVG(LN(price)) OVER w AS b, STDDEV_SAMP(LN(price)) OVER w AS s, COUNT(price) OVER w AS c FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)),
zs AS (SELECT ticker, ts, pos, price, CASE WHEN c = {n} THEN b END AS baseline, CASE WHEN c = {n} THEN s END AS std, CASE WHEN c = {n} THEN lp - b END AS residual, CASE WHEN c = {n} AND s > 1e-12 THEN (lp - b) / s END AS zscore FROM z)"""


@query("rolling_zscore", f"WITH {WEEK}, {Z_SQL.format(n=Z_WINDOW)} SELECT ticker, {TS}, {r6('baseline', 'std', 'residual', 'zscore')}, zscore IS NOT NULL AS valid FROM zs")
def rolling_zscore(spark, sf):
    return out(rs.zscore_benchmark(weekly(spark, sf), Z_WINDOW), "ticker", "ts", "baseline", "std", "residual", "zscore", "valid")


@query("current_snapshot", f"WITH {WEEK}, {Z_SQL.format(n=Z_WINDOW)} SELECT ticker, {TS}, {r6('baseline', 'std', 'zscore')} FROM zs QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY pos DESC) = 1")
def current_snapshot(spark, sf):
    return out(rs.latest(rs.zscore_benchmark(weekly(spark, sf), Z_WINDOW), ["ticker"]), "ticker", "ts", "baseline", "std", "zscore")


TREND_SQL = f"""t0 AS (SELECT *, LN(price) AS lp, CAST(pos AS DOUBLE) AS x FROM panel),
t1 AS (SELECT *, COUNT(lp) OVER w AS c, REGR_SLOPE(lp, x) OVER w AS slope, REGR_INTERCEPT(lp, x) OVER w AS line, REGR_R2(lp, x) OVER w AS r2 FROM t0 WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN {TREND} PRECEDING AND 1 PRECEDING)),
t2 AS (SELECT ticker, ts, pos, slope, line + slope * (x - {TREND}) AS intercept, r2 AS r_squared, line + slope * x AS expected, lp - line - slope * x AS trend_residual FROM t1 WHERE c = {TREND} AND lp IS NOT NULL),
t3 AS (SELECT p.ticker, p.ts, p.pos, t2.* EXCLUDE (ticker, ts, pos) FROM panel p LEFT JOIN t2 ON t2.ticker = p.ticker AND t2.pos = p.pos),
t4 AS (SELECT *, COUNT(trend_residual) OVER w AS zc, AVG(trend_residual) OVER w AS zb, STDDEV_SAMP(trend_residual) OVER w AS zd FROM t3 WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN {TREND} PRECEDING AND 1 PRECEDING)),
trend AS (SELECT *, CASE WHEN zc = {TREND} AND zd > 1e-12 THEN (trend_residual - zb) / zd END AS zscore FROM t4)"""


@query("trend_residual", f"WITH {WEEK}, {TREND_SQL} SELECT ticker, {TS}, {r6('slope', 'intercept', 'r_squared', 'expected', 'trend_residual', 'zscore')} FROM trend")
def trend_residual(spark, sf):
    return out(rs.trend_residual(weekly(spark, sf), TREND), "ticker", "ts", "slope", "intercept", "r_squared", "expected", "trend_residual", "zscore")


def _factor_sql(two: bool) -> str:
    w = f"WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN {FACTOR} PRECEDING AND 1 PRECEDING)"
    drop = "'AF', 'RF'" if two else "'AF'"
    fit = "REGR_SLOPE(y, x) OVER w AS beta, REGR_INTERCEPT(y, x) OVER w AS alpha, REGR_R2(y, x) OVER w AS r_squared, 0e0 AS beta_sector"
    if two:
        fit = "COVAR_SAMP(x, x) OVER w AS xx, COVAR_SAMP(s, s) OVER w AS ss, COVAR_SAMP(x, s) OVER w AS xs, COVAR_SAMP(x, y) OVER w AS xy, COVAR_SAMP(s, y) OVER w AS sy, COVAR_SAMP(y, y) OVER w AS yy, AVG(x) OVER w AS mx, AVG(s) OVER w AS ms, AVG(y) OVER w AS my"
    solved = "SELECT *, (xy * ss - sy * xs) / (xx * ss - xs * xs) AS beta, (sy * xx - xy * xs) / (xx * ss - xs * xs) AS beta_sector FROM f1 WHERE c = {n} AND ok = 1".format(n=FACTOR) if two else f"SELECT * FROM f1 WHERE c = {FACTOR} AND ok = 1"
    alpha = "my - beta * mx - beta_sector * ms AS alpha, (beta * xy + beta_sector * sy) / yy AS r_squared" if two else "alpha, r_squared"
    return f"""WITH {WEEK}, r AS ({RET}), f0 AS (SELECT a.ticker, a.ts, a.pos, a.ret AS y, m.ret AS x, {'k.ret' if two else '0e0'} AS s, CASE WHEN a.ret IS NOT NULL AND m.ret IS NOT NULL {'AND k.ret IS NOT NULL' if two else ''} THEN 1 END AS ok
FROM r a LEFT JOIN r m ON m.ticker = 'AF' AND m.pos = a.pos {"LEFT JOIN r k ON k.ticker = 'RF' AND k.pos = a.pos" if two else ''} WHERE a.ticker NOT IN ({drop})),
f1 AS (SELECT *, COUNT(ok) OVER w AS c, {fit} FROM f0 {w}), f2 AS ({solved}), f3 AS (SELECT ticker, pos, beta, beta_sector, {alpha}, y, x, s FROM f2), f4 AS (SELECT *, y - alpha - beta * x - beta_sector * s AS factor_residual FROM f3),
f5 AS (SELECT f0.ticker, f0.ts, f0.pos, alpha, beta, beta_sector, r_squared, factor_residual FROM f0 LEFT JOIN f4 ON f4.ticker = f0.ticker AND f4.pos = f0.pos),
f6 AS (SELECT *, COUNT(factor_residual) OVER w AS zc, AVG(factor_residual) OVER w AS zb, STDDEV_SAMP(factor_residual) OVER w AS zd, COUNT(factor_residual) OVER v AS vc, SUM(factor_residual) OVER v AS vs FROM f5 {w}, v AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT ticker, {TS}, {r6('alpha', 'beta')}, {'ROUND(beta_sector, 6) AS beta_sector, ' if two else ''}{r6('r_squared', 'factor_residual')}, ROUND(CASE WHEN zc = {FACTOR} AND zd > 1e-12 THEN (factor_residual - zb) / zd END, 6) AS zscore, ROUND(CASE WHEN vc = 20 THEN vs END, 6) AS state FROM f6"""


@query("factor_residual_1f", _factor_sql(False))
def factor_1f(spark, sf):
    return out(rs.factor_residual(weekly(spark, sf), market="AF", window=FACTOR), "ticker", "ts", "alpha", "beta", "r_squared", "factor_residual", "zscore", "state")


@query("factor_residual_2f", _factor_sql(True))
def factor_2f(spark, sf):
    return out(rs.factor_residual(weekly(spark, sf), market="AF", sector="RF", window=FACTOR), "ticker", "ts", "alpha", "beta", "beta_sector", "r_squared", "factor_residual", "zscore", "state")


PAIR_SQL = f"""r AS ({RET}), q0 AS (SELECT a.ticker AS target, b.ticker AS peer, a.ts, a.pos, LN(a.price) AS t, LN(b.price) AS p, a.ret AS rt, b.ret AS rp FROM r a JOIN r b ON a.pos = b.pos AND a.ticker <> b.ticker),
q1 AS (SELECT *, COUNT(t + p) OVER w AS c, REGR_SLOPE(t, p) OVER w AS beta, REGR_INTERCEPT(t, p) OVER w AS alpha, REGR_R2(t, p) OVER w AS r_squared, REGR_SYY(t, p) OVER w AS syy, CORR(rt, rp) OVER v AS return_correlation
FROM q0 WINDOW w AS (PARTITION BY target, peer ORDER BY pos ROWS BETWEEN {PAIR} PRECEDING AND 1 PRECEDING), v AS (PARTITION BY target, peer ORDER BY pos ROWS BETWEEN {PAIR - 1} PRECEDING AND 1 PRECEDING)),
q2 AS (SELECT *, t - alpha - beta * p AS spread, SQRT(GREATEST(syy * (1 - r_squared), 0) / ({PAIR} - 1)) AS spread_std FROM q1 WHERE pos >= {PAIR} AND c = {PAIR} AND t IS NOT NULL AND p IS NOT NULL),
q3 AS (SELECT q0.target, q0.peer, q0.ts, q0.pos, q0.t, q0.p, alpha, beta, r_squared, return_correlation, spread, spread_std, CASE WHEN spread_std > 1e-12 THEN spread / spread_std END AS zscore FROM q0 LEFT JOIN q2 USING (target, peer, pos)),
pairs AS (SELECT *, zscore IS NOT NULL AS valid, CASE WHEN zscore IS NULL THEN 'INVALID' WHEN zscore >= 2 THEN 'TARGET_RELATIVELY_HIGH' WHEN zscore <= -2 THEN 'TARGET_RELATIVELY_LOW' ELSE 'NEUTRAL' END AS state FROM q3)"""
PAIR_COLUMNS = ("alpha", "beta", "spread", "spread_std", "zscore", "r_squared", "return_correlation")


@query("pair_spread", f"WITH {WEEK}, {PAIR_SQL} SELECT target, peer, {TS}, {r6(*PAIR_COLUMNS)}, valid FROM pairs")
def pair_spread(spark, sf):
    return out(rs.pair_spread(weekly(spark, sf), window=PAIR), "target", "peer", "ts", *PAIR_COLUMNS, "valid")


@query("pair_states", f"WITH {WEEK}, {PAIR_SQL} SELECT target, peer, state, COUNT(*) AS n FROM pairs GROUP BY 1, 2, 3")
def pair_states(spark, sf):
    return rs.pair_spread(weekly(spark, sf), window=PAIR).groupBy("target", "peer", "state").agg(F.count("*").alias("n"))


@query("peer_ranking", f"""WITH {WEEK}, {PAIR_SQL}, k AS (SELECT peer, SUM(CAST(valid AS BIGINT)) AS valid_observation_count FROM pairs WHERE target = 'AF' GROUP BY peer),
l AS (SELECT * FROM pairs WHERE target = 'AF' QUALIFY ROW_NUMBER() OVER (PARTITION BY peer ORDER BY pos DESC) = 1)
SELECT l.peer, valid, ROUND(spread_std, 6) AS spread_volatility, ROUND(zscore, 6) AS spread_zscore, {r6('r_squared', 'return_correlation')}, CAST(valid_observation_count AS BIGINT) AS valid_observation_count, state AS relative_state,
CASE WHEN valid THEN ROW_NUMBER() OVER (ORDER BY valid DESC, l.peer) END AS research_rank FROM l JOIN k ON k.peer = l.peer""")
def peer_ranking(spark, sf):
    df = rs.peer_ranking(weekly(spark, sf), target="AF", window=PAIR, cointegration=False)
    return out(df.withColumn("research_rank", F.col("research_rank").cast("long")), "peer", "valid", "spread_volatility", "spread_zscore", "r_squared", "return_correlation", "valid_observation_count", "relative_state", "research_rank")


@query("peer_ranking_cointegration")
def peer_ranking_cointegration(spark, sf):
    df = rs.peer_ranking(weekly(spark, sf), target="AF", window=PAIR)
    return out(df, *df.columns)


@query("pair_cointegration")
def pair_cointegration(spark, sf):
    df = stationarity.rolling_engle_granger(rs.pair_frame(weekly(spark, sf)).where("target < peer"), PAIR)
    return out(df, "target", "peer", "ts", "cointegration_statistic", "cointegration_pvalue")


@query("stationarity_gate")
def stationarity_gate(spark, sf):
    df = stationarity.stationarity(rs.trend_residual(weekly(spark, sf), TREND), "trend_residual", keys=["ticker"])
    return out(df, *df.columns)


XS_SQL = f"""r AS ({RET}), x0 AS (SELECT *, COUNT(*) OVER (PARTITION BY ts) AS n, AVG(ret) OVER (PARTITION BY ts) AS mean, STDDEV_SAMP(ret) OVER (PARTITION BY ts) AS std,
RANK() OVER (PARTITION BY ts ORDER BY ret) + (COUNT(*) OVER (PARTITION BY ts, ret) - 1) / 2.0e0 AS rank FROM r WHERE ret IS NOT NULL),
xs AS (SELECT *, rank / n AS percentile, CASE WHEN std > 1e-12 THEN (ret - mean) / std END AS zscore FROM x0 WHERE n >= 3)"""


@query("cross_sectional", f"WITH {WEEK}, {XS_SQL} SELECT ticker, {TS}, {r6('ret', 'mean', 'std', 'rank', 'percentile', 'zscore')}, CASE WHEN zscore IS NULL THEN 'INVALID' WHEN zscore >= 1.5 THEN 'RELATIVELY_HIGH' WHEN zscore <= -1.5 THEN 'RELATIVELY_LOW' ELSE 'NEUTRAL' END AS state FROM xs")
def cross_sectional(spark, sf):
    return out(rs.cross_sectional(rs.returns(weekly(spark, sf)), threshold=1.5), "ticker", "ts", "ret", "mean", "std", "rank", "percentile", "zscore", "state")


@query("pca_residuals")
def pca_residuals(spark, sf):
    return out(pca.pca_state(pca.rolling_pca(weekly(spark, sf), window=PAIR, components=2)), "ticker", "ts", "actual", "reconstructed", "residual", "zscore", "n_components", "valid", "state")


@query("pca_loadings")
def pca_loadings(spark, sf):
    return out(pca.latest_loadings(weekly(spark, sf), window=PAIR, components=0.8), "ticker", "component", "loading", "explained", "cumulative")


@query("pca_explained")
def pca_explained(spark, sf):
    return out(pca.explained_variance(weekly(spark, sf), window=PAIR, components=0.8), "ts", "component", "explained", "cumulative")


KALMAN_SQL = """WITH RECURSIVE {WEEK}, k0 AS (SELECT a.ts, a.pos, LN(a.price) AS t, LN(b.price) AS p FROM panel a JOIN panel b ON a.pos = b.pos WHERE a.ticker = 'AF' AND b.ticker = 'RF'),
k(pos, ts, a, b, aa, ab, bb, prior_alpha, prior_beta, innovation, innovation_variance, valid) AS (SELECT CAST(-1 AS BIGINT), CAST(NULL AS DATE), 0e0, 1e0, 1e0, 0e0, 1e0, 0e0, 0e0, 0e0, 0e0, FALSE UNION ALL
SELECT pos, ts, CASE WHEN ok THEN a + ga / v * e ELSE a END, CASE WHEN ok THEN b + gb / v * e ELSE b END, CASE WHEN ok THEN aa + 1e-5 - ga / v * ga ELSE aa END, CASE WHEN ok THEN ab - ga / v * gb ELSE ab END, CASE WHEN ok THEN bb + 1e-5 - gb / v * gb ELSE bb END,
CASE WHEN ok THEN a END, CASE WHEN ok THEN b END, CASE WHEN ok THEN e END, CASE WHEN ok THEN v END, ok FROM (SELECT *, ga + gb * p + 1e-4 AS v, t - a - b * p AS e FROM (SELECT k0.pos, k0.ts, k0.t, k0.p, k0.t IS NOT NULL AND k0.p IS NOT NULL AS ok, k.a, k.b, k.aa, k.ab, k.bb, k.aa + 1e-5 + k.ab * k0.p AS ga, k.ab + (k.bb + 1e-5) * k0.p AS gb FROM k JOIN k0 ON k0.pos = k.pos + 1)))
SELECT {TS}, {cols}, valid FROM k WHERE pos >= 0"""


@query("kalman_pair", KALMAN_SQL.format(WEEK=WEEK, TS=TS, cols=r6("prior_alpha", "prior_beta") + ", CASE WHEN valid THEN ROUND(a, 6) END AS alpha, CASE WHEN valid THEN ROUND(b, 6) END AS beta, " + r6("innovation", "innovation_variance")))
def kalman_pair(spark, sf):
    pairs = rs.pair_frame(weekly(spark, sf), spark.createDataFrame([("AF", "RF")], "target string, peer string"))
    return out(folds.kalman_pairs(pairs), "ts", "prior_alpha", "prior_beta", "alpha", "beta", "innovation", "innovation_variance", "valid")


# ---- Ornstein-Uhlenbeck

OU_OUT = ("theta", "kappa", "sigma", "half_life", "log_likelihood")


def _ou_sql(source: str, keys: str, extra: str, where: str) -> str:
    """source: rows with keys, n, m, b, a, sse, v, bad."""
    return f"""g AS (SELECT *, n >= 20 AND bad = 0 AND v > 1e-12 AND b > 1e-12 AND b < 1 - 1e-12 AND sse / m > 1e-12 AS valid FROM ({source})), h AS (SELECT *, CASE WHEN valid THEN -LN(CASE WHEN b > 0 THEN b ELSE 1 END) END AS kappa, CASE WHEN valid THEN a / (1 - b) END AS theta FROM g),
fits AS (SELECT *, CASE WHEN valid THEN SQRT(sse / m * 2 * kappa / (1 - b * b)) END AS sigma, LN(2e0) / kappa AS half_life, CASE WHEN valid THEN -0.5e0 * (m * LN(2 * PI() * CASE WHEN sse > 0 THEN sse ELSE 1 END / m) + m) END AS log_likelihood FROM h) SELECT {keys}, {r6(*OU_OUT)}, {extra}valid FROM fits {where}"""


STATE_SQL = f"{TREND_SQL}, st AS (SELECT ticker, ts, pos, SUM(trend_residual) OVER (PARTITION BY ticker ORDER BY pos) AS x FROM trend WHERE trend_residual IS NOT NULL), o AS (SELECT *, LEAD(x) OVER (PARTITION BY ticker ORDER BY pos) AS y FROM st)"
FIT_SOURCE = "SELECT ticker, COUNT(*) AS n, COUNT(y) AS m, REGR_SLOPE(y, x) AS b, REGR_INTERCEPT(y, x) AS a, REGR_SYY(y, x) * (1 - REGR_R2(y, x)) AS sse, VAR_POP(x) AS v, 0 AS bad FROM o GROUP BY ticker"


def ou_state(spark, sf):
    """Running sums of trend residuals: a state with memory, on which an autoregression is worth fitting."""
    df = rs.trend_residual(weekly(spark, sf), TREND).where("trend_residual is not null")
    w = Window.partitionBy("ticker").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return df.select("ticker", "ts", "pos", F.sum("trend_residual").over(w).alias("x"))


@query("ou_ar1", f"WITH {WEEK}, {STATE_SQL}, {_ou_sql(FIT_SOURCE, 'ticker, n AS n_observations', '', '')}")
def ou_ar1(spark, sf):
    return out(ou.fit_ou(ou_state(spark, sf), "x", keys=["ticker"]), "ticker", "n_observations", *OU_OUT, "valid")


@query("ou_comparison", f"WITH {WEEK}, {STATE_SQL}, " + _ou_sql(FIT_SOURCE, "ticker, method", "CASE WHEN valid THEN 0e0 END AS kappa_difference, ", ", (SELECT 'AR1' AS method UNION ALL SELECT 'MLE')"))
def ou_comparison(spark, sf):
    state = ou_state(spark, sf)
    return out(ou.compare_estimators(ou.fit_ou(state, "x", keys=["ticker"]), ["ticker"], ou.fit_ou(state, "x", keys=["ticker"], method="MLE")), "ticker", "method", *OU_OUT, "kappa_difference", "valid")


@query("rolling_ou", f"""WITH {WEEK}, lp AS (SELECT ticker, ts, pos, LN(price) AS y, LAG(LN(price)) OVER (PARTITION BY ticker ORDER BY pos) AS l FROM panel), lq AS (SELECT ticker, ts, pos, y, CASE WHEN y IS NOT NULL THEN l END AS x, CASE WHEN l IS NOT NULL THEN y END AS y2 FROM lp),
o AS (SELECT ticker, ts, pos, REGR_SLOPE(y2, x) OVER p AS b, REGR_INTERCEPT(y2, x) OVER p AS a, REGR_SYY(y2, x) OVER p * (1 - REGR_R2(y2, x) OVER p) AS sse, VAR_POP(y) OVER q AS v, COUNT(y) OVER q AS k FROM lq
WINDOW p AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN {OU_WINDOW - 2} PRECEDING AND CURRENT ROW), q AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN {OU_WINDOW - 1} PRECEDING AND CURRENT ROW)),
{_ou_sql(f"SELECT *, {OU_WINDOW} AS n, {OU_WINDOW - 1} AS m, {OU_WINDOW} - k AS bad FROM o WHERE pos >= {OU_WINDOW - 1}", "ticker, " + TS, "", "")}""")
def rolling_ou(spark, sf):
    df = weekly(spark, sf).withColumn("x", F.ln("price"))
    return out(ou.rolling_ou(df, "x", keys=["ticker"], window=OU_WINDOW), "ticker", "ts", *OU_OUT, "valid")


@query("ou_forecast_band", f"WITH {WEEK}, {STATE_SQL}, " + _ou_sql(FIT_SOURCE, "ticker", "", "").rsplit(" SELECT ticker", 1)[0] + """, l AS (SELECT ticker, MAX_BY(x, pos) AS x FROM st GROUP BY ticker), f AS (SELECT f.ticker, h AS horizon, theta + (l.x - theta) * EXP(-kappa * h) AS mean, SQRT(sigma * sigma * (1 - EXP(-2 * kappa * h)) / (2 * kappa)) AS deviation
FROM fits f JOIN l ON l.ticker = f.ticker, (SELECT UNNEST([0e0, 1e0, 5e0, 20e0]) AS h) WHERE valid) SELECT ticker, horizon, """ + r6("mean", "deviation") + ", ROUND(mean - 1.96e0 * deviation, 6) AS lower, ROUND(mean + 1.96e0 * deviation, 6) AS upper FROM f")
def ou_forecast_band(spark, sf):
    state = ou_state(spark, sf)
    fits = ou.fit_ou(state, "x", keys=["ticker"]).join(rs.latest(state, ["ticker"]).select("ticker", "x"), "ticker")
    return out(ou.forecast(fits, "x", [0.0, 1.0, 5.0, 20.0]), "ticker", "horizon", "mean", "deviation", "lower", "upper")


HEDGE_SOURCE = "SELECT target, peer, i, beta, COUNT(*) AS n, COUNT(y) AS m, REGR_SLOPE(y, x) AS b, REGR_INTERCEPT(y, x) AS a, REGR_SYY(y, x) * (1 - REGR_R2(y, x)) AS sse, VAR_POP(x) AS v, 0 AS bad FROM e GROUP BY target, peer, i, beta"
HEDGE_SQL = f"""WITH {WEEK}, d AS (SELECT a.ticker AS target, b.ticker AS peer, a.pos, LN(a.price) AS t, LN(b.price) AS p FROM panel a JOIN panel b ON a.pos = b.pos AND a.ticker <> b.ticker WHERE a.price IS NOT NULL AND b.price IS NOT NULL),
d2 AS (SELECT target, peer, t, p, LEAD(t) OVER w AS t2, LEAD(p) OVER w AS p2 FROM d WINDOW w AS (PARTITION BY target, peer ORDER BY pos)), e AS (SELECT target, peer, i, -3e0 + i * (6e0 / 60) AS beta, t - (-3e0 + i * (6e0 / 60)) * p AS x, t2 - (-3e0 + i * (6e0 / 60)) * p2 AS y FROM d2, RANGE(0, 61) r(i)),
{_ou_sql(HEDGE_SOURCE, "*", "CASE WHEN n >= 40 THEN log_likelihood / (n - 1) END AS objective, ", "").replace(", " + r6(*OU_OUT), "").replace("valid FROM fits", "valid AS ok FROM fits")}""".replace(" SELECT *, CASE WHEN n >= 40", ", grid AS (SELECT *, CASE WHEN n >= 40") + ")"


@query("hedge_grid", f"{HEDGE_SQL} SELECT target, peer, ROUND(beta, 6) AS beta, {r6('objective', 'theta', 'kappa', 'sigma', 'half_life')}, valid FROM grid")
def hedge_grid(spark, sf):
    return out(ou.hedge_ratio_grid(rs.pair_frame(weekly(spark, sf)))[0], "target", "peer", "beta", "objective", "theta", "kappa", "sigma", "half_life", "valid")


@query("hedge_best", f"""{HEDGE_SQL}, o AS (SELECT *, LEAD(objective) OVER w AS second, ROW_NUMBER() OVER w AS place FROM grid WINDOW w AS (PARTITION BY target, peer ORDER BY objective DESC NULLS LAST, beta))
SELECT target, peer, CASE WHEN objective IS NOT NULL THEN ROUND(beta, 6) END AS optimal_beta, {r6('objective', 'theta', 'kappa', 'sigma', 'half_life')}, COALESCE(ABS(objective - second) <= 0.001, FALSE) AS weakly_identified,
CASE WHEN n < 40 THEN 'Insufficient historical observations.' WHEN objective IS NULL THEN 'No valid OU fit in hedge-ratio grid.' END AS invalid_reason FROM o WHERE place = 1""")
def hedge_best(spark, sf):
    df = ou.hedge_ratio_grid(rs.pair_frame(weekly(spark, sf)))[1]
    return out(df, *df.columns)


@query("estimator_agreement", f"WITH {WEEK}, {STATE_SQL}, " + _ou_sql(FIT_SOURCE, "ticker", "", "").rsplit(" SELECT ticker", 1)[0] + " SELECT ticker, valid AS agree, COALESCE(half_life <= 60, FALSE) AS half_life_acceptable FROM fits")
def estimator_agreement(spark, sf):
    return ou.estimators_agree(ou.compare_estimators(ou.fit_ou(ou_state(spark, sf), "x", keys=["ticker"]), ["ticker"]), ["ticker"])


@query("pair_positions", f"WITH {WEEK}, {PAIR_SQL} SELECT target, peer, {TS}, CASE state WHEN 'TARGET_RELATIVELY_LOW' THEN 1e0 WHEN 'TARGET_RELATIVELY_HIGH' THEN -1e0 END AS target_units, ROUND(CASE state WHEN 'TARGET_RELATIVELY_LOW' THEN -beta WHEN 'TARGET_RELATIVELY_HIGH' THEN beta END, 6) AS peer_units FROM pairs WHERE state LIKE 'TARGET%'")
def pair_positions(spark, sf):
    df = rs.pair_spread(weekly(spark, sf), window=PAIR).where("state like 'TARGET%'")
    side = F.when(F.col("state") == "TARGET_RELATIVELY_LOW", "LONG_RESIDUAL").otherwise("SHORT_RESIDUAL")
    return out(df.withColumn("u", rs.pair_position(F.col("beta"), side)).select("target", "peer", "ts", "u.*"), "target", "peer", "ts", "target_units", "peer_units")


@query("tail_state", f"WITH {WEEK}, {TREND_SQL}, k AS (SELECT ticker, ts, trend_residual AS x, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY pos) - 1 AS p, COUNT(*) OVER (PARTITION BY ticker) AS n FROM trend WHERE trend_residual IS NOT NULL) SELECT ticker, {TS}, p AS pos, ROUND(x, 6) AS x FROM k WHERE p >= n - 40")
def tail_state(spark, sf):
    return out(rs.tail_window(rs.state_series(rs.trend_residual(weekly(spark, sf), TREND), "trend", ["ticker"]), 40, ["ticker"]), "ticker", "ts", "pos", "x")


# ---- first passage and policies


@query("boundary_grid", "SELECT 0e0 AS current, e.x AS exit, s.x AS stop, 'LONG_RESIDUAL' AS direction FROM (SELECT UNNEST([0.1e0, 0.2e0, 0.3e0]) AS x) e, (SELECT UNNEST([-0.1e0, -0.4e0]) AS x) s")
def boundary_grid(spark, sf):
    return passage.boundary_candidates(spark, 0.0, "LONG_RESIDUAL", [0.1, 0.2, 0.3], [-0.1, -0.4])


def _candidates(spark):
    df = passage.boundary_candidates(spark, -0.5, "LONG_RESIDUAL", [-0.2, -0.1, 0.0], [-0.8, -1.0])
    return df.withColumn("candidate", F.row_number().over(Window.orderBy("exit", "stop")) - 1)


@query("first_passage")
def first_passage(spark, sf):
    df = passage.first_passage(_candidates(spark), theta=0.0, kappa=0.08, sigma=0.12, paths=10_000)
    return out(df, *df.columns)


@query("first_passage_deterministic", """WITH RECURSIVE c AS (SELECT e.x AS exit, s.x AS stop FROM (SELECT UNNEST([-0.2e0, -0.1e0, 0e0]) AS x) e, (SELECT UNNEST([-0.8e0, -1e0]) AS x) s),
p(exit, stop, step, x, hit) AS (SELECT exit, stop, 0, -0.5e0, CAST(NULL AS DOUBLE) FROM c UNION ALL SELECT exit, stop, step + 1, x * EXP(-0.08e0), CASE WHEN hit IS NULL AND x * EXP(-0.08e0) >= exit THEN step + 1e0 ELSE hit END FROM p WHERE step < 20)
SELECT exit, stop, CASE WHEN MAX(hit) IS NULL THEN 0e0 ELSE 1e0 END AS exit_before_stop, 0e0 AS stop_before_exit, MAX(hit) AS mean_exit_time FROM p GROUP BY exit, stop""")
def first_passage_deterministic(spark, sf):
    df = passage.first_passage(_candidates(spark), theta=0.0, kappa=0.08, sigma=0.0, paths=50)
    return out(df, "exit", "stop", "exit_before_stop", "stop_before_exit", "mean_exit_time")


def _configs(spark, sf):
    """A policy problem for every ticker whose state has a valid fit: the grid spans three stationary deviations, stops lie between its points, unlike on both sides, so that no two actions tie."""
    fits = ou.fit_ou(ou_state(spark, sf), "x", keys=["ticker"]).where("valid")
    sd, c = F.col("sigma") / F.sqrt(2 * F.col("kappa")), F.col("theta")
    df = fits.select(F.col("ticker").alias("config_id"), "theta", "kappa", "sigma", "half_life", (c - 3 * sd).alias("grid_min"), (c + 3 * sd).alias("grid_max"), (c - 2.475 * sd).alias("long_stop"), (c + 2.325 * sd).alias("short_stop"))
    return df.withColumns({k: F.lit(v) for k, v in asdict(COSTS).items()})


def _policy(spark, sf):
    return stopping.policy_frame(_configs(spark, sf))


def _double_factorials(n: int) -> str:
    """2^k / (2k + 1)!!, the coefficients of the error function's series without alternating signs."""
    c, out = 1.0, []
    for k in range(n):
        out.append(f"{c!r}" if "e" in repr(c) else f"{c!r}e0")
        c *= 2 / (2 * k + 3)
    return "[" + ", ".join(out) + "]"


_enter, _leave = (COSTS.trade(1.0, e) for e in (True, False))
_points = "RANGE(0, 121)"
POLICY_SQL = f"""WITH RECURSIVE {WEEK}, {STATE_SQL}, {_ou_sql(FIT_SOURCE, 'ticker', '', '').rsplit(' SELECT ticker', 1)[0]}, cfg AS (SELECT ticker AS config_id, theta, kappa, sigma, half_life, sigma / SQRT(2 * kappa) AS sd, SQRT(sigma * sigma * (1 - EXP(-2 * kappa)) / (2 * kappa)) AS move FROM fits WHERE valid),
cg AS (SELECT *, theta - 3 * sd AS lo, (theta + 3 * sd - (theta - 3 * sd)) / 120e0 AS step, theta - 2.475e0 * sd AS long_stop, theta + 2.325e0 * sd AS short_stop FROM cfg),
xs AS (SELECT cg.*, i, CASE WHEN i = 120 THEN theta + 3 * sd ELSE i * step + lo END AS x FROM cg, (SELECT UNNEST({_points}) AS i)),
z0 AS (SELECT a.config_id, a.i, b.j, (b.edge - (a.theta + (a.x - a.theta) * EXP(-a.kappa))) / a.move / SQRT(2e0) AS z FROM xs a JOIN (SELECT config_id, i AS j, x - step / 2 AS edge FROM xs UNION ALL SELECT config_id, 121, x + step / 2 FROM xs WHERE i = 120) b ON a.config_id = b.config_id),
z1 AS (SELECT config_id, i, j, 0.5e0 * (1 + CASE WHEN z > 6 THEN 1 WHEN z < -6 THEN -1 ELSE 2 / SQRT(PI()) * EXP(-z * z) * LIST_DOT_PRODUCT(LIST_TRANSFORM(RANGE(0, 120), lambda k: POWER(z, 2 * k + 1)), {_double_factorials(120)}) END) AS cdf FROM z0),
z2 AS (SELECT config_id, i, j, LEAD(cdf) OVER (PARTITION BY config_id, i ORDER BY j) - cdf AS mass FROM z1), z3 AS (SELECT config_id, i, j, mass / SUM(mass) OVER (PARTITION BY config_id, i) AS mass FROM z2 WHERE j <= 120),
z4 AS (SELECT z3.config_id, z3.i, LIST(mass ORDER BY j) AS row, SUM(mass * xs.x) AS ahead FROM z3 JOIN xs ON xs.config_id = z3.config_id AND xs.i = z3.j GROUP BY 1, 2),
mm AS (SELECT config_id, LIST(row ORDER BY i) AS m, LIST(ahead - x ORDER BY i) AS drift, LIST(x ORDER BY i) AS x, ANY_VALUE(long_stop) AS long_stop, ANY_VALUE(short_stop) AS short_stop, ANY_VALUE(half_life) AS half_life FROM z4 JOIN xs USING (config_id, i) GROUP BY config_id),
val(config_id, k, up, down) AS (SELECT config_id, 0, LIST_TRANSFORM({_points}, lambda i: -{_leave!r}e0), LIST_TRANSFORM({_points}, lambda i: -{_leave!r}e0) FROM mm UNION ALL
SELECT val.config_id, k + 1, LIST_TRANSFORM({_points}, lambda i: CASE WHEN x[i + 1] <= long_stop THEN -{_leave!r}e0 ELSE GREATEST(-{_leave!r}e0, {COSTS.discount()!r}e0 * (LIST_DOT_PRODUCT(m[i + 1], up) + drift[i + 1])) END),
LIST_TRANSFORM({_points}, lambda i: CASE WHEN x[i + 1] >= short_stop THEN -{_leave!r}e0 ELSE GREATEST(-{_leave!r}e0, {COSTS.discount()!r}e0 * (LIST_DOT_PRODUCT(m[i + 1], down) - drift[i + 1])) END) FROM val JOIN mm ON mm.config_id = val.config_id WHERE k < 30),
sc AS (SELECT mm.config_id, i, mm.x[i + 1] AS x, mm.x[i + 1] <= long_stop AS out_long, mm.x[i + 1] >= short_stop AS out_short, {COSTS.discount()!r}e0 * (LIST_DOT_PRODUCT(m[i + 1], a.up) + drift[i + 1]) AS hold_long, {COSTS.discount()!r}e0 * (LIST_DOT_PRODUCT(m[i + 1], a.down) - drift[i + 1]) AS hold_short,
{COSTS.discount()!r}e0 * LIST_DOT_PRODUCT(m[i + 1], b.up) AS go_long, {COSTS.discount()!r}e0 * LIST_DOT_PRODUCT(m[i + 1], b.down) AS go_short FROM mm JOIN val a ON a.config_id = mm.config_id AND a.k = 29 JOIN val b ON b.config_id = mm.config_id AND b.k = 30, (SELECT UNNEST({_points}) AS i)),
open AS (SELECT config_id, i, x, 'FLAT' AS position, 'WAIT' AS action, 0 AS n, 0e0 AS score FROM sc UNION ALL SELECT config_id, i, x, 'FLAT', 'ENTER_LONG', 1, go_long - {{enter}} FROM sc UNION ALL SELECT config_id, i, x, 'FLAT', 'ENTER_SHORT', 2, go_short - {{enter}} FROM sc
UNION ALL SELECT config_id, i, x, 'LONG_RESIDUAL', 'HOLD_LONG', 0, CASE WHEN NOT out_long THEN hold_long END FROM sc UNION ALL SELECT config_id, i, x, 'LONG_RESIDUAL', 'EXIT_LONG', 1, CASE WHEN NOT out_long THEN -{_leave!r}e0 END FROM sc UNION ALL SELECT config_id, i, x, 'LONG_RESIDUAL', 'STOP_LONG', 2, CASE WHEN out_long THEN -{_leave!r}e0 END FROM sc
UNION ALL SELECT config_id, i, x, 'SHORT_RESIDUAL', 'HOLD_SHORT', 0, CASE WHEN NOT out_short THEN hold_short END FROM sc UNION ALL SELECT config_id, i, x, 'SHORT_RESIDUAL', 'EXIT_SHORT', 1, CASE WHEN NOT out_short THEN -{_leave!r}e0 END FROM sc UNION ALL SELECT config_id, i, x, 'SHORT_RESIDUAL', 'STOP_SHORT', 2, CASE WHEN out_short THEN -{_leave!r}e0 END FROM sc),
policy AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY config_id, i, position{{group}} ORDER BY score DESC NULLS LAST, n) = 1 AS chosen FROM open)"""
ONE_POLICY = POLICY_SQL.replace("{enter}", f"{_enter!r}e0").replace("{group}", "")
ISLANDS = "SELECT *, i - ROW_NUMBER() OVER (PARTITION BY config_id, action{group} ORDER BY i) AS island FROM policy WHERE position = 'FLAT' AND action <> 'WAIT' AND chosen"


@query("stopping_policy", f"{ONE_POLICY} SELECT config_id, CAST(i AS INTEGER) AS idx, ROUND(x, 6) AS x, position, action, ROUND(score, 6) AS score, chosen FROM policy")
def stopping_policy(spark, sf):
    return out(_policy(spark, sf), "config_id", "idx", "x", "position", "action", "score", "chosen")


@query("policy_regions", f"{ONE_POLICY}, isl AS ({ISLANDS.replace('{group}', '')}) SELECT config_id, action, ROUND(MIN(x), 6) AS start, ROUND(MAX(x), 6) AS \"end\" FROM isl GROUP BY config_id, action, island")
def policy_regions(spark, sf):
    policy = _policy(spark, sf)
    parts = [stopping.regions(policy, "FLAT", a).withColumn("action", F.lit(a)) for a in ("ENTER_LONG", "ENTER_SHORT")]
    return out(parts[0].unionByName(parts[1]), "config_id", "action", "start", "end")


ENTRY_COSTS = (0.0, 0.1, 0.3, 0.6)


@query("cost_sensitivity", POLICY_SQL.replace("{enter}", f"({_enter - COSTS.fixed_entry_cost!r}e0 + fec)").replace("{group}", ", fec").replace("sc AS (SELECT mm.config_id", "sc AS (SELECT fec, mm.config_id").replace(f", (SELECT UNNEST({_points}) AS i)),\nopen", f", (SELECT UNNEST({_points}) AS i), (SELECT UNNEST({[float(c) for c in ENTRY_COSTS]}) AS fec)),\nopen").replace("SELECT config_id, i, x, '", "SELECT fec, config_id, i, x, '")
       + f", isl AS ({ISLANDS.replace('{group}', ', fec')}) SELECT config_id, CAST(fec AS DOUBLE) AS fixed_entry_cost, SUBSTR(action, 7) AS side, ROUND(MIN(x), 6) AS start, ROUND(MAX(x), 6) AS \"end\" FROM isl GROUP BY config_id, fec, action, island")
def cost_sensitivity(spark, sf):
    return out(stopping.sensitivity(_configs(spark, sf), COSTS, list(ENTRY_COSTS)), "config_id", "fixed_entry_cost", "side", "start", "end")


@query("policy_actions", f"""{ONE_POLICY}, las AS (SELECT ticker AS config_id, pos, x AS now, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY pos DESC) AS back FROM st), sta AS (SELECT las.config_id, pos, now, back, position, half_life <= 60 AS gates_pass FROM las JOIN mm ON mm.config_id = las.config_id, (SELECT UNNEST(['FLAT', 'LONG_RESIDUAL', 'SHORT_RESIDUAL']) AS position) WHERE back <= 40),
near AS (SELECT s.*, p.i, p.action, p.n, p.score, RANK() OVER (PARTITION BY s.config_id, s.pos, s.position ORDER BY ABS(p.x - s.now), p.i) AS r FROM sta s JOIN policy p ON p.config_id = s.config_id AND p.position = s.position),
ord AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY config_id, pos, position ORDER BY score DESC NULLS LAST, n) AS place FROM near WHERE r = 1)
SELECT config_id, ROUND(now, 6) AS "at", position, CASE WHEN NOT gates_pass THEN 'NO_SIGNAL' ELSE MAX(CASE WHEN place = 1 THEN action END) END AS action, MAX(CASE WHEN place = 1 THEN action END) AS best, ROUND(MAX(CASE WHEN place = 1 THEN score END), 6) AS value,
MAX(CASE WHEN place = 2 THEN action END) AS next_action, ROUND(MAX(CASE WHEN place = 2 THEN score END), 6) AS next_value FROM ord GROUP BY config_id, pos, now, position, gates_pass""")
def policy_actions(spark, sf):
    """The last 40 states of every ticker under its own policy, in each position; the gate is the half-life."""
    last = rs.tail_window(ou_state(spark, sf).withColumnRenamed("ticker", "config_id"), 40, ["config_id"]).join(_configs(spark, sf).select("config_id", (F.col("half_life") <= 60).alias("gates_pass")), "config_id")
    states = last.select("config_id", "x", F.explode(F.array(*map(F.lit, stopping.POSITIONS))).alias("position"), F.lit(True).alias("sufficient_data"), "gates_pass")
    return out(stopping.act(_policy(spark, sf), states), "config_id", "at", "position", "action", "best", "value", "next_action", "next_value")


# ---- backtest

SIGNAL_SQL = f"""{Z_SQL.format(n=SIGNAL['window'])}, s(ticker, pos, position, action) AS (SELECT ticker, pos, 'FLAT', 'INSUFFICIENT_DATA' FROM zs WHERE pos = 0 UNION ALL
SELECT ticker, pos, CASE WHEN a LIKE 'ENTER_%' THEN SUBSTR(a, 7) || '_RESIDUAL' WHEN a LIKE 'EXIT_%' OR a LIKE 'STOP_%' THEN 'FLAT' ELSE position END, a FROM (SELECT zs.ticker, zs.pos, s.position, CASE WHEN zs.zscore IS NULL THEN 'INSUFFICIENT_DATA'
WHEN s.position = 'FLAT' THEN CASE WHEN zs.zscore <= -{SIGNAL['entry']} THEN 'ENTER_LONG' WHEN zs.zscore >= {SIGNAL['entry']} THEN 'ENTER_SHORT' ELSE 'WAIT' END
WHEN s.position = 'LONG_RESIDUAL' THEN CASE WHEN zs.zscore <= -{SIGNAL['stop']} THEN 'STOP_LONG' WHEN ABS(zs.zscore) <= {SIGNAL['exit']} THEN 'EXIT_LONG' ELSE 'HOLD_LONG' END
ELSE CASE WHEN zs.zscore >= {SIGNAL['stop']} THEN 'STOP_SHORT' WHEN ABS(zs.zscore) <= {SIGNAL['exit']} THEN 'EXIT_SHORT' ELSE 'HOLD_SHORT' END END AS a FROM s JOIN zs ON zs.ticker = s.ticker AND zs.pos = s.pos + 1)),
sig AS (SELECT zs.*, s.action, s.position FROM zs JOIN s ON s.ticker = zs.ticker AND s.pos = zs.pos)"""
_cost = COSTS.trade(1.0, True) + COSTS.trade(1.0, False)
TRADE_TAIL = f"""x0 AS (SELECT *, LEAD(price) OVER (PARTITION BY ticker ORDER BY pos) AS fill, MAX(pos) OVER (PARTITION BY ticker) AS last FROM sig),
x1 AS (SELECT *, action LIKE 'ENTER_%' AS opens FROM x0 WHERE (action LIKE 'ENTER_%' OR action LIKE 'EXIT_%' OR action LIKE 'STOP_%') AND pos + 1 <= last),
x2 AS (SELECT *, LEAD(ts) OVER w AS exit_date, LEAD(fill) OVER w AS exit_price, LEAD(pos) OVER w AS exit_pos FROM x1 WINDOW w AS (PARTITION BY ticker ORDER BY pos)),
trades AS (SELECT ticker, ts AS entry_date, exit_date, action AS direction, CASE WHEN action = 'ENTER_LONG' THEN 1 ELSE -1 END * (exit_price / fill - 1) AS gross_pnl, {_cost!r}e0 AS costs, CASE WHEN action = 'ENTER_LONG' THEN 1 ELSE -1 END * (exit_price / fill - 1) - {_cost!r}e0 AS net_pnl, exit_pos - pos AS holding_days, pos AS entry_pos FROM x2 WHERE opens AND exit_date IS NOT NULL),
eq0 AS (SELECT *, SUM(net_pnl) OVER (PARTITION BY ticker ORDER BY entry_pos) AS equity FROM trades), eq AS (SELECT *, equity - MAX(equity) OVER (PARTITION BY ticker ORDER BY entry_pos) AS drawdown FROM eq0)"""
TRADE_SQL = f"{SIGNAL_SQL}, {TRADE_TAIL}"


def _event_sql() -> str:
    parts = []
    for h in bt.HORIZONS:
        w = f"(PARTITION BY ticker ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {1 + h} FOLLOWING)"
        parts.append(f"""SELECT ticker, ts, pos, {h} AS horizon_days, zscore AS z0, action, LEAD(price) OVER o AS entry, LEAD(ts) OVER o AS execution, COALESCE(LEAD(price, {1 + h}) OVER o, LAST_VALUE(price) OVER a) AS ep, COALESCE(LEAD(zscore, {1 + h}) OVER o, LAST_VALUE(zscore) OVER a) AS ez,
MAX(price) OVER {w} AS hi, MIN(price) OVER {w} AS lo, MAX(zscore) OVER {w} AS zhi, MIN(zscore) OVER {w} AS zlo FROM sig WINDOW o AS (PARTITION BY ticker ORDER BY pos), a AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
    return f"""ev0 AS ({" UNION ALL ".join(parts)}), events AS (SELECT ticker, ts AS signal_date, execution AS execution_date, horizon_days, ep / entry - 1 AS raw_target_return, CASE WHEN z0 < 0 THEN 1 ELSE -1 END * (ep / entry - 1) AS direction_adjusted_return, ez - z0 AS residual_change,
ABS(z0) - ABS(ez) AS distance_toward_equilibrium, CASE WHEN ABS(z0) >= 1e-12 THEN (z0 - ez) / z0 END AS fraction_reverted, CASE WHEN z0 < 0 THEN zhi >= 0 ELSE zlo <= 0 END AS exit_reached, CASE WHEN z0 < 0 THEN zlo <= {SIGNAL['stop']} ELSE zhi >= {SIGNAL['stop']} END AS stop_reached,
CASE WHEN z0 < 0 THEN hi / entry - 1 ELSE 1 - lo / entry END AS mfe, CASE WHEN z0 < 0 THEN lo / entry - 1 ELSE 1 - hi / entry END AS mae FROM ev0 WHERE action LIKE 'ENTER_%' AND execution IS NOT NULL)"""


EVENT_SQL = f"{SIGNAL_SQL}, {_event_sql()}"
EVENT_COLUMNS = ("raw_target_return", "direction_adjusted_return", "residual_change", "distance_toward_equilibrium", "fraction_reverted", "mfe", "mae")


def _backtest(spark, sf):
    return bt.run_backtest(weekly(spark, sf), costs=COSTS, **SIGNAL)


@query("benchmark_signals", f"WITH RECURSIVE {WEEK}, {SIGNAL_SQL} SELECT ticker, {TS}, {r6('zscore')}, action, position FROM sig")
def benchmark_signals(spark, sf):
    return out(_backtest(spark, sf)["signals"], "ticker", "ts", "zscore", "action", "position")


@query("trade_records", f"WITH RECURSIVE {WEEK}, {TRADE_SQL} SELECT ticker, CAST(entry_date AS VARCHAR) AS entry_date, CAST(exit_date AS VARCHAR) AS exit_date, direction, {r6('gross_pnl', 'costs', 'net_pnl')}, holding_days FROM trades")
def trade_records(spark, sf):
    return out(_backtest(spark, sf)["trades"], "ticker", "entry_date", "exit_date", "direction", "gross_pnl", "costs", "net_pnl", "holding_days")


@query("equity_drawdown", f"WITH RECURSIVE {WEEK}, {TRADE_SQL} SELECT ticker, entry_pos, {r6('equity', 'drawdown')} FROM eq")
def equity_drawdown(spark, sf):
    return out(_backtest(spark, sf)["equity"], "ticker", "entry_pos", "equity", "drawdown")


@query("event_study", f"WITH RECURSIVE {WEEK}, {EVENT_SQL} SELECT ticker, CAST(signal_date AS VARCHAR) AS signal_date, CAST(execution_date AS VARCHAR) AS execution_date, horizon_days, {r6(*EVENT_COLUMNS)}, exit_reached, stop_reached FROM events")
def event_study(spark, sf):
    return out(_backtest(spark, sf)["events"], "ticker", "signal_date", "execution_date", "horizon_days", *EVENT_COLUMNS, "exit_reached", "stop_reached")


@query("event_buckets", f"WITH RECURSIVE {WEEK}, {EVENT_SQL} SELECT ticker, horizon_days, COUNT(*) AS observations, ROUND(AVG(fraction_reverted), 6) AS average_fraction_reverted, ROUND(AVG(CAST(exit_reached AS DOUBLE)), 6) AS realized_exit_frequency FROM events GROUP BY 1, 2")
def event_buckets(spark, sf):
    return out(_backtest(spark, sf)["buckets"], "ticker", "horizon_days", "observations", "average_fraction_reverted", "realized_exit_frequency")


METRICS_SQL = f"""mt AS (SELECT ticker, COUNT(*) AS trade_count, SUM(gross_pnl) AS gross_pnl, SUM(costs) AS costs, SUM(net_pnl) AS net_pnl, AVG(CAST(net_pnl > 0 AS DOUBLE)) AS win_rate, AVG(net_pnl) FILTER (WHERE net_pnl > 0) AS average_win, AVG(net_pnl) FILTER (WHERE net_pnl < 0) AS average_loss,
MIN(drawdown) AS maximum_drawdown, CAST(COUNT(*) AS DOUBLE) AS turnover, AVG(holding_days) AS average_holding_period, MEDIAN(CAST(holding_days AS DOUBLE)) AS median_holding_period FROM eq GROUP BY ticker),
me AS (SELECT ticker, COUNT(*) AS candidate_count, SUM(CAST(exit_reached AS BIGINT)) AS exit_count, SUM(CAST(stop_reached AS BIGINT)) AS stop_count, AVG(fraction_reverted) AS average_fraction_reverted, MEDIAN(fraction_reverted) AS median_fraction_reverted FROM events GROUP BY ticker)
SELECT k.ticker, COALESCE(trade_count, 0) AS trade_count, ROUND(COALESCE(gross_pnl, 0), 6) AS gross_pnl, ROUND(COALESCE(costs, 0), 6) AS costs, ROUND(COALESCE(net_pnl, 0), 6) AS net_pnl, {r6('win_rate', 'average_win', 'average_loss')}, ROUND(COALESCE(maximum_drawdown, 0), 6) AS maximum_drawdown, ROUND(COALESCE(turnover, 0), 6) AS turnover,
{r6('average_holding_period', 'median_holding_period')}, COALESCE(candidate_count, 0) AS candidate_count, CAST(COALESCE(exit_count, 0) AS BIGINT) AS exit_count, CAST(COALESCE(stop_count, 0) AS BIGINT) AS stop_count, {r6('average_fraction_reverted', 'median_fraction_reverted')}
FROM (SELECT DISTINCT ticker FROM panel) k LEFT JOIN mt ON mt.ticker = k.ticker LEFT JOIN me ON me.ticker = k.ticker"""


@query("backtest_metrics", f"WITH RECURSIVE {WEEK}, {TRADE_SQL}, {_event_sql()}, {METRICS_SQL}")
def backtest_metrics(spark, sf):
    df = _backtest(spark, sf)["metrics"]
    return out(df, *df.columns)


@query("calibration", f"""WITH {WEEK}, {XS_SQL}, c AS (SELECT percentile AS p, zscore > 0 AS hit FROM xs), b AS (SELECT * FROM (VALUES (0.5e0, 0.6e0), (0.6e0, 0.7e0), (0.7e0, 0.8e0), (0.8e0, 0.9e0), (0.9e0, 1.000001e0)) v(low, high))
SELECT low, high, COUNT(p) AS observations, ROUND(AVG(p), 6) AS average_predicted_probability, ROUND(AVG(CAST(hit AS DOUBLE)), 6) AS actual_exit_frequency FROM b LEFT JOIN c ON p >= low AND p < high GROUP BY 1, 2""")
def calibration(spark, sf):
    xs = rs.cross_sectional(rs.returns(weekly(spark, sf)))
    return out(bt.calibration(xs.select(F.col("percentile").alias("predicted"), (F.col("zscore") > 0).alias("realized"))), "low", "high", "observations", "average_predicted_probability", "actual_exit_frequency")


MOMENTUM_SQL = f"""{Z_SQL.format(n=SIGNAL['window'])}, h0 AS (SELECT ticker, pos, CASE WHEN COUNT(price) OVER w = 5 THEN price > AVG(price) OVER w END AS rising FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
s(ticker, pos, position, action) AS (SELECT ticker, pos, 'FLAT', 'INSUFFICIENT_DATA' FROM h0 WHERE pos = 0 UNION ALL SELECT ticker, pos, CASE a WHEN 'ENTER_LONG' THEN 'LONG_RESIDUAL' WHEN 'EXIT_LONG' THEN 'FLAT' ELSE position END, a
FROM (SELECT h0.ticker, h0.pos, s.position, CASE WHEN rising IS NULL THEN 'INSUFFICIENT_DATA' WHEN s.position = 'FLAT' THEN CASE WHEN rising THEN 'ENTER_LONG' ELSE 'WAIT' END WHEN rising THEN 'HOLD_LONG' ELSE 'EXIT_LONG' END AS a FROM s JOIN h0 ON h0.ticker = s.ticker AND h0.pos = s.pos + 1)),
sig AS (SELECT zs.*, s.action, s.position FROM zs JOIN s ON s.ticker = zs.ticker AND s.pos = zs.pos)"""


@query("full_signal_backtest", f"WITH RECURSIVE {WEEK}, {MOMENTUM_SQL}, {TRADE_TAIL}, {_event_sql()}, {METRICS_SQL}")
def full_signal_backtest(spark, sf):
    def momentum(history, position):
        if len(history) < 5 or history.isna().any():
            return "INSUFFICIENT_DATA"
        rising = history.iloc[-1] > history.mean()
        return ("ENTER_LONG" if rising else "WAIT") if position == "FLAT" else ("HOLD_LONG" if rising else "EXIT_LONG")

    df = bt.run_backtest(weekly(spark, sf), costs=COSTS, hook=momentum, history=5, **SIGNAL)["full_metrics"]
    return out(df, *df.columns)


@query("pair_trades", f"""WITH {WEEK}, j AS (SELECT a.ticker AS target, b.ticker AS peer, a.ts, a.pos, a.price AS tp, b.price AS pp, LEAD(a.price) OVER w AS t2, LEAD(b.price) OVER w AS p2 FROM panel a JOIN panel b ON a.pos = b.pos AND a.ticker <> b.ticker WINDOW w AS (PARTITION BY a.ticker, b.ticker ORDER BY a.pos)),
u AS (SELECT *, 1000e0 / (tp + 0.8e0 * pp) AS s FROM j WHERE t2 IS NOT NULL AND p2 IS NOT NULL AND tp IS NOT NULL AND pp IS NOT NULL), v AS (SELECT *, s * tp + 0.8e0 * s * pp AS gross_notional, s * (t2 - tp) - 0.8e0 * s * (p2 - pp) AS gross_pnl FROM u)
SELECT target, peer, {TS}, {r6('gross_notional', 'gross_pnl')}, ROUND(gross_notional * 0.0014e0 + 0.004e0, 6) AS costs, ROUND(gross_pnl - gross_notional * 0.0014e0 - 0.004e0, 6) AS net_pnl FROM v""")
def pair_trades(spark, sf):
    """A position of every ordered pair at every date, held to the next."""
    panel = weekly(spark, sf)
    now = pn.halo(panel, 0, ["ticker"], ahead=1)
    now = now.withColumn("later", F.lead("price").over(Window.partitionBy("ticker", "part").orderBy("pos"))).where("own").select("ticker", "ts", "pos", "price", "later")
    a = now.select(F.col("ticker").alias("target"), "ts", "pos", F.col("price").alias("target_price"), F.col("later").alias("exit_target_price"))
    b = now.select(F.col("ticker").alias("peer"), "pos", F.col("price").alias("peer_price"), F.col("later").alias("exit_peer_price"))
    df = a.join(b, "pos").where("target <> peer").dropna().withColumn("beta", F.lit(0.8)).withColumn("notional", F.lit(1000.0)).withColumn("multiplier", F.lit(1.0))
    return out(bt.pair_trades(df, COSTS), "target", "peer", "ts", "gross_notional", "gross_pnl", "costs", "net_pnl")


# ---- evidence and decisions

VOTE_SQL = f"""{XS_SQL}, votes AS (SELECT ts AS entity, ticker AS model_name, CASE WHEN zscore <= -0.8 THEN 'LONG_RESIDUAL' WHEN zscore >= 0.8 THEN 'SHORT_RESIDUAL' WHEN zscore IS NULL THEN 'INVALID' ELSE 'NEUTRAL' END AS direction, 1.0e0 + ABS(zscore) AS weight, percentile AS reliability, SUBSTR(ticker, 1, 1) AS dependency_group, ABS(zscore) <= 1.8e0 AS gate FROM xs),
v0 AS (SELECT *, weight * reliability AS raw FROM votes WHERE direction <> 'INVALID' AND gate), v1 AS (SELECT *, CASE WHEN SUM(raw) OVER g > 0 THEN AVG(weight) OVER g * raw / SUM(raw) OVER g ELSE 0 END AS support FROM v0 WINDOW g AS (PARTITION BY entity, dependency_group)),
v2 AS (SELECT entity, COUNT(*) AS valid_model_count, COUNT(*) FILTER (WHERE direction = 'LONG_RESIDUAL') AS long_count, COUNT(*) FILTER (WHERE direction = 'SHORT_RESIDUAL') AS short_count, COUNT(*) FILTER (WHERE direction = 'NEUTRAL') AS neutral_count,
COALESCE(SUM(support) FILTER (WHERE direction = 'LONG_RESIDUAL'), 0) AS l, COALESCE(SUM(support) FILTER (WHERE direction = 'SHORT_RESIDUAL'), 0) AS s, COALESCE(SUM(support) FILTER (WHERE direction = 'NEUTRAL'), 0) AS n FROM v1 GROUP BY entity),
con AS (SELECT e.entity, COALESCE(valid_model_count, 0) AS valid_model_count, COALESCE(long_count, 0) AS long_count, COALESCE(short_count, 0) AS short_count, COALESCE(neutral_count, 0) AS neutral_count, COALESCE(l, 0) AS long_support, COALESCE(s, 0) AS short_support, COALESCE(n, 0) AS neutral_support,
CASE WHEN COALESCE(l + s + n, 0) <= 0 THEN 'INSUFFICIENT_DATA' WHEN l / (l + s + n) >= 0.35e0 AND s / (l + s + n) >= 0.35e0 THEN 'CONFLICTED' WHEN l >= s AND l >= n THEN 'LONG' WHEN s >= n THEN 'SHORT' ELSE 'NEUTRAL' END AS state,
CASE WHEN COALESCE(l + s + n, 0) <= 0 THEN 0 WHEN l / (l + s + n) >= 0.35e0 AND s / (l + s + n) >= 0.35e0 THEN GREATEST(l, s) / (l + s + n) * 100 ELSE GREATEST(l, s, n) / (l + s + n) * 100 END AS agreement_percentage FROM (SELECT DISTINCT entity FROM votes) e LEFT JOIN v2 ON v2.entity = e.entity)"""


def _consensus(spark, sf):
    xs = rs.cross_sectional(rs.returns(weekly(spark, sf)))
    votes = xs.select(
        F.col("ts").alias("entity"), F.col("ticker").alias("model_name"), ev.direction_of(F.col("zscore"), 0.8).alias("direction"), F.lit(True).alias("valid"), (F.abs("zscore") <= 1.8).alias("gate_passed"),
        (1.0 + F.abs("zscore")).alias("weight"), F.col("percentile").alias("reliability"), F.substring("ticker", 1, 1).alias("dependency_group"),
    )
    return ev.consensus(votes)


CONSENSUS_COLUMNS = ("valid_model_count", "long_count", "short_count", "neutral_count", "agreement_percentage", "long_support", "short_support", "neutral_support")


@query("consensus", f"WITH {WEEK}, {VOTE_SQL} SELECT CAST(entity AS VARCHAR) AS entity, state, valid_model_count, long_count, short_count, neutral_count, {r6('agreement_percentage', 'long_support', 'short_support', 'neutral_support')} FROM con")
def consensus(spark, sf):
    return out(_consensus(spark, sf), "entity", "state", *CONSENSUS_COLUMNS)


@query("confidence", f"WITH {WEEK}, {Z_SQL.format(n=Z_WINDOW)} SELECT ticker, {TS}, CASE WHEN zscore IS NOT NULL THEN ROUND(12 * LEAST(ABS(zscore) / 2.5e0, 1) + 15 * LEAST(1, GREATEST(0, std)) + 12 * 0.5e0, 6) END AS confidence FROM zs")
def confidence(spark, sf):
    df = rs.zscore_benchmark(weekly(spark, sf), Z_WINDOW)
    return out(df.withColumn("confidence", ev.confidence(F.col("valid"), F.col("zscore"), ou_agreement=F.col("std"), half_life_quality=F.lit(0.5))), "ticker", "ts", "confidence")


@query("final_decision", f"""WITH {WEEK}, {VOTE_SQL}, d1 AS (SELECT *, valid_model_count >= 5 AS g1, agreement_percentage >= 40 AS g2, neutral_count <= 4 AS g3, CASE WHEN long_count + short_count >= 5 THEN 'SEVERE_BREAK' ELSE 'NORMAL' END AS regime, long_support - short_support AS z FROM con),
d2 AS (SELECT *, CONCAT_WS('; ', CASE WHEN NOT g1 THEN 'Insufficient data' END, CASE WHEN NOT g2 THEN 'Stationarity gate' END, CASE WHEN NOT g3 THEN 'Half-life' END, CASE WHEN regime = 'SEVERE_BREAK' THEN 'SEVERE_BREAK regime' END) AS failed FROM d1)
SELECT CAST(entity AS VARCHAR) AS entity, CASE WHEN NOT g1 THEN 'INSUFFICIENT_DATA' WHEN failed <> '' THEN 'NO_SIGNAL' WHEN state IN ('INSUFFICIENT_DATA', 'CONFLICTED') THEN state ELSE 'WAIT' END AS action,
CASE WHEN NOT g1 THEN 'Insufficient data' WHEN failed <> '' THEN failed WHEN state = 'INSUFFICIENT_DATA' THEN 'No valid residual models' WHEN state = 'CONFLICTED' THEN 'Valid models have strong long/short disagreement' END AS invalid_reason,
CASE WHEN failed = '' THEN ROUND(12 * LEAST(ABS(z) / 2.5e0, 1) + 13 * LEAST(1, GREATEST(0, agreement_percentage / 100)), 6) END AS confidence FROM d2""")
def final_decision(spark, sf):
    """Every week's consensus under gates made of its own counts and shares."""
    df, yes, c = _consensus(spark, sf), F.lit(True), F.col
    df = df.withColumns({"sufficient_data": c("valid_model_count") >= 5, "residual_valid": yes, "stationarity_valid": c("agreement_percentage") >= 40, "ou_valid": yes, "half_life_acceptable": c("neutral_count") <= 4, "parameter_stable": yes})
    df = df.withColumns({"regime_status": F.when(c("long_count") + c("short_count") >= 5, "SEVERE_BREAK").otherwise("NORMAL"), "zscore": c("long_support") - c("short_support"), "consensus_state": c("state"), "policy_action": F.lit("WAIT")})
    return out(ev.final_decision(df), "entity", "action", "invalid_reason", "confidence")


FROZEN_POS = 104  # models are frozen from the panel's first two years and judged on what follows


@query("live_classification", f"""WITH {WEEK}, q AS (SELECT a.ticker AS target, b.ticker AS peer, a.ts, a.pos, a.price AS tp, b.price AS pp, LN(a.price) AS t, LN(b.price) AS p FROM panel a JOIN panel b ON a.pos = b.pos AND a.ticker <> b.ticker WHERE a.price IS NOT NULL AND b.price IS NOT NULL),
m AS (SELECT target, peer, REGR_SLOPE(t, p) AS beta, REGR_INTERCEPT(t, p) AS alpha, SQRT(REGR_SYY(t, p) * (1 - REGR_R2(t, p)) / (COUNT(*) - 1)) AS sd FROM q WHERE pos < {FROZEN_POS} GROUP BY target, peer),
f AS (SELECT m.*, target || '-' || peer || '-' || position AS prediction_id, position FROM m, (SELECT UNNEST(['FLAT', 'LONG_RESIDUAL', 'SHORT_RESIDUAL']) AS position)),
x AS (SELECT f.*, q.ts, q.tp, q.pp, q.t - alpha - beta * q.p AS r FROM q JOIN f ON f.target = q.target AND f.peer = q.peer WHERE q.pos >= {FROZEN_POS}),
y AS (SELECT *, CASE WHEN r >= -2 * sd AND r <= -sd THEN 0 ELSE LEAST(ABS(r + 2 * sd), ABS(r + sd)) END AS le, CASE WHEN r >= sd AND r <= 2 * sd THEN 0 ELSE LEAST(ABS(r - sd), ABS(r - 2 * sd)) END AS se FROM x)
SELECT prediction_id, {TS}, ROUND(r, 6) AS residual, CASE WHEN position = 'LONG_RESIDUAL' THEN CASE WHEN r <= -3 * sd THEN 'STOP_REGION' WHEN r >= 0 THEN 'EXIT_REGION' ELSE 'HOLD' END WHEN position = 'SHORT_RESIDUAL' THEN CASE WHEN r >= 3 * sd THEN 'STOP_REGION' WHEN r <= 0 THEN 'EXIT_REGION' ELSE 'HOLD' END WHEN le = 0 OR se = 0 THEN 'ENTRY_REGION' ELSE 'WAIT' END AS state,
ROUND(LEAST(le, se), 6) AS distance_to_entry, ROUND(ABS(r), 6) AS distance_to_exit, ROUND(CASE position WHEN 'LONG_RESIDUAL' THEN ABS(r + 3 * sd) WHEN 'SHORT_RESIDUAL' THEN ABS(r - 3 * sd) END, 6) AS distance_to_stop, ROUND((-1.5e0 * sd - r) / (-1.5e0 * sd), 6) AS fraction_reverted, ROUND(EXP(alpha + beta * LN(pp)) / tp, 6) AS implied_exit_share FROM y""")
def live_classification(spark, sf):
    """Every ordered pair's later prices against a model frozen from its first two years, in each position."""
    panel = weekly(spark, sf).where("price is not null")
    of = lambda side: panel.select("ts", "pos", F.col("ticker").alias(side), F.col("price").alias(f"{side}_price"))
    quotes = of("target").join(of("peer").drop("ts"), "pos").where("target <> peer")
    t, p = F.ln("target_price"), F.ln("peer_price")
    fits = quotes.where(F.col("pos") < FROZEN_POS).groupBy("target", "peer").agg(F.regr_intercept(t, p).alias("alpha"), F.regr_slope(t, p).alias("beta"), F.sqrt(F.regr_syy(t, p) * (1 - F.regr_r2(t, p)) / (F.count("*") - 1)).alias("sd"))
    sd, span = F.col("sd"), lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    frozen = fits.withColumn("position", F.explode(F.array(*map(F.lit, stopping.POSITIONS)))).select(
        F.concat_ws("-", "target", "peer", "position").alias("prediction_id"), "target", "peer", "alpha", "beta", (-1.5 * sd).alias("initial_residual"), span(-2 * sd, -sd).alias("long_entry"), span(sd, 2 * sd).alias("short_entry"), F.lit(0.0).alias("exit"), (-3 * sd).alias("long_stop"), (3 * sd).alias("short_stop"), "position",
    )
    df = live.classify_live(quotes.where(F.col("pos") >= FROZEN_POS), frozen)
    df = df.withColumn("implied_exit_share", F.col("implied_exit") / F.col("target_price"))
    return out(df, "prediction_id", "ts", "residual", "state", "distance_to_entry", "distance_to_exit", "distance_to_stop", "fraction_reverted", "implied_exit_share")


@query("journal_insert_if_absent", "SELECT o_orderkey AS prediction_id, o_orderstatus AS source FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def journal_insert(spark, sf):
    """All orders against those that have a returned line."""
    there = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("prediction_id"))
    new = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("prediction_id"), F.col("o_orderstatus").alias("source"))
    return insert_if_absent(there, new, ["prediction_id"])


@query("decision_monitor")
def decision_monitor(spark, sf):
    from driftwell.plans.monitor import decision_monitor as monitor

    df = monitor(weekly(spark, sf), window=OU_WINDOW, paths=2000)
    return out(df, "ticker", "ts", "zscore", "kappa", "half_life", "adf_pvalue", "kpss_pvalue", "consensus_state", "policy_action", "action", "invalid_reason", "confidence", "p_exit_before_stop", "p_stop_before_exit")


__all__ = ["ORACLES", "QUERIES"]
