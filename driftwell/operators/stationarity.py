"""Unit-root and stationarity tests in numpy, applied by series: ADF, KPSS and Engle-Granger.

p-values of ADF and Engle-Granger come from published response surfaces, those of KPSS from its published table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Response surface coefficients (constant case) for one and two series: switch point, small and large p.
SURFACE = {1: (-1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)), 2: (-2.62, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377))}
SURFACE_RANGE = {1: (-18.83, 2.74), 2: (-18.86, 0.92)}
# Critical values and p-values of the KPSS level test.
KPSS_TABLE = ((0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def surface_p(stat: float, series: int) -> float:
    low, high = SURFACE_RANGE[series]
    if not math.isfinite(stat):
        return 0.0 if stat < 0 else math.nan
    if stat >= high:
        return 1.0
    if stat <= low:
        return 0.0
    switch, small, large = SURFACE[series]
    return normal_cdf(sum(c * stat**i for i, c in enumerate(small if stat <= switch else large)))


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    return beta, e, float(e @ e)


def _adf_frame(x: np.ndarray, lags: int, constant: bool, skip: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(x)
    n = len(d)
    columns = [x[skip:n], *(d[skip - j : n - j] for j in range(1, lags + 1))]
    if constant:
        columns.append(np.ones(n - skip))
    return d[skip:], np.column_stack(columns)


def adf(x: np.ndarray, constant: bool = True, series: int = 1) -> tuple[float, float]:
    """Statistic and p-value; lags by the Akaike criterion on one common sample, then refitted on all rows."""
    n = len(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 1 - int(constant))
    if most < 0:
        return math.nan, math.nan
    best = (math.inf, 0)
    for lags in range(most + 1):
        y, z = _adf_frame(x, lags, constant, most)
        _, _, sse = _ols(y, z)
        if sse <= 0:
            return -math.inf, 0.0
        best = min(best, (len(y) * (math.log(2 * math.pi * sse / len(y)) + 1) + 2 * z.shape[1], lags))
    y, z = _adf_frame(x, best[1], constant, best[1])
    beta, _, sse = _ols(y, z)
    scale = sse / max(1, len(y) - z.shape[1])
    se = math.sqrt(max(0.0, scale * float(np.linalg.pinv(z.T @ z)[0, 0])))
    stat = float(beta[0]) / se if se > 0 else -math.inf
    return stat, surface_p(stat, series)


def kpss(x: np.ndarray) -> tuple[float, float]:
    """Level statistic and p-value (held within the table), with the automatic lag of Hobijn and others."""
    n = len(x)
    e = x - x.mean()
    covariances, s0, s1 = int(n ** (2 / 9)), float(e @ e) / n, 0.0
    for i in range(1, covariances + 1):
        c = 2 * float(e[i:] @ e[:-i]) / n
        s0 += c
        s1 += i * c
    lags = int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)) if s0 else 0
    lags = min(lags, n - 1)
    long_run = float(e @ e) / n + 2 * sum((1 - i / (lags + 1)) * float(e[i:] @ e[:-i]) / n for i in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum()) / n**2 / long_run if long_run else math.nan
    return stat, float(np.interp(stat, *KPSS_TABLE))


def engle_granger(y: np.ndarray, x: np.ndarray) -> tuple[float, float]:
    z = np.column_stack([np.ones(len(x)), x])
    _, e, sse = _ols(y, z)
    total = float(((y - y.mean()) ** 2).sum())
    if total <= 0 or sse / total < 100 * np.sqrt(np.finfo(float).eps) * 1e-8:
        return -math.inf, math.nan
    return adf(e, constant=False, series=2)


def _finite(v: float) -> float | None:
    return v if math.isfinite(v) else None


def stationarity(df: DataFrame, value: str, *, keys: list[str]) -> DataFrame:
    """ADF and KPSS of each series' values in order of pos, and the gate that asks both to agree on stationarity."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", adf_statistic double, adf_pvalue double, kpss_statistic double, kpss_pvalue double, stationary boolean"

    def test(key, g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("pos")[value].dropna().to_numpy(float)
        if len(x) < 20 or np.ptp(x) < 1e-12:
            return pd.DataFrame([[*key, None, None, None, None, False]], columns=names)
        (a, pa), (k, pk) = adf(x), kpss(x)
        return pd.DataFrame([[*key, _finite(a), _finite(pa), _finite(k), _finite(pk), bool(pa < 0.05 < pk)]], columns=names)

    names = [*keys, "adf_statistic", "adf_pvalue", "kpss_statistic", "kpss_pvalue", "stationary"]
    return df.select(*keys, "pos", value).groupBy(*keys).applyInPandas(test, schema)


def engle_granger_last(pairs: DataFrame, window: int) -> DataFrame:
    """Cointegration of each pair's last date, from the ``window`` rows before it; pairs: target, peer, pos, t, p.

    Only the rows of that window are sent to the test.
    """
    last = pairs.groupBy("target", "peer").agg(F.max("pos").alias("end"))
    df = pairs.join(last, ["target", "peer"]).where("pos < end and pos >= end - %d" % window).select("target", "peer", "pos", "t", "p")

    def test(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        s, p = engle_granger(g.t.to_numpy(float), g.p.to_numpy(float)) if len(g) == window and g[["t", "p"]].notna().all().all() else (math.nan, math.nan)
        return pd.DataFrame([[*key, _finite(s), _finite(p) if math.isfinite(s) else None]], columns=["target", "peer", "cointegration_statistic", "cointegration_pvalue"])

    return df.groupBy("target", "peer").applyInPandas(test, "target string, peer string, cointegration_statistic double, cointegration_pvalue double")


def rolling_engle_granger(pairs: DataFrame, window: int = 252, *, block: int = 256) -> DataFrame:
    """Cointegration of every date from the ``window`` rows before it; a pair's dates are spread over blocks."""
    from driftwell.sources.panels import halo

    df = halo(pairs.select("target", "peer", "ts", "pos", "t", "p"), window, ["target", "peer"], block)

    def test(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos").reset_index(drop=True)
        y, x = g.t.to_numpy(float), g.p.to_numpy(float)
        rows = []
        for i in np.flatnonzero(g.own.to_numpy()):
            s = p = math.nan
            if i >= window and np.isfinite(y[i - window : i + 1]).all() and np.isfinite(x[i - window : i + 1]).all():
                s, p = engle_granger(y[i - window : i], x[i - window : i])
            rows.append((_finite(s), _finite(p) if math.isfinite(s) else None))
        out = g.loc[g.own, ["target", "peer", "ts", "pos"]].copy()
        out["cointegration_statistic"], out["cointegration_pvalue"] = [r[0] for r in rows], [r[1] for r in rows]
        return out

    kind = pairs.schema["ts"].dataType.simpleString()
    return df.groupBy("target", "peer", "part").applyInPandas(test, f"target string, peer string, ts {kind}, pos long, cointegration_statistic double, cointegration_pvalue double")
