"""First passage of an Ornstein-Uhlenbeck state between an exit and a stop boundary, by seeded exact simulation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARY = "candidate int, exit double, stop double, exit_before_stop double, stop_before_exit double, neither double, exit_within_5 double, exit_within_10 double, exit_within_20 double, se_exit double, median_exit_time double, mean_exit_time double, mean_favorable double, mean_adverse double"


def boundary_candidates(spark: SparkSession, current: float, direction: str, exits: list[float], stops: list[float]) -> DataFrame:
    """All pairs of boundaries; one on the wrong side of the state raises."""
    df = spark.createDataFrame([(float(x),) for x in exits], "exit double").withColumn("stop", F.explode(F.array(*(F.lit(float(s)) for s in stops))))
    inside = (F.col("stop") < current) & (F.lit(current) < F.col("exit")) if direction == "LONG_RESIDUAL" else (F.col("exit") < current) & (F.lit(current) < F.col("stop"))
    says = "stop < state < exit" if direction == "LONG_RESIDUAL" else "exit < state < stop"
    checked = F.when(inside, F.lit(float(current))).otherwise(F.raise_error(F.lit(f"{direction} requires {says}")).cast("double"))
    return df.select(checked.alias("current"), "exit", "stop", F.lit(direction).alias("direction"))


def simulate(theta: float, kappa: float, sigma: float, current: float, exit: float, stop: float, direction: str, *, dt: float = 1.0, paths: int = 10_000, horizon: int = 20, seed: int = 0, substeps: int = 1, samples: int = 0, rng: np.random.Generator | None = None) -> dict[str, np.ndarray]:
    """Per path: exit and stop times (NaN if none) and the largest favourable and adverse moves; of the first ``samples`` paths the states at whole steps.

    A path stands still after its first hit. A step over both boundaries goes to the one nearer to its start, as a
    share of the step; a tie goes to the stop. Hit times are the ends of steps.
    """
    sign = 1.0 if direction == "LONG_RESIDUAL" else -1.0
    if not sign * stop < sign * current < sign * exit:
        raise ValueError(f"{direction}: the state must lie between stop and exit")
    if kappa <= 0 or sigma < 0 or dt <= 0 or paths < 1 or horizon < 1 or substeps < 1:
        raise ValueError("invalid simulation settings")
    rng = rng or np.random.default_rng(seed)
    h = dt / substeps
    decay, sd = math.exp(-kappa * h), math.sqrt(sigma**2 * -math.expm1(-2 * kappa * h) / (2 * kappa))
    x = np.full(paths, float(current))
    high, low = x.copy(), x.copy()
    exits, stops = np.full(paths, np.nan), np.full(paths, np.nan)
    live = np.arange(paths)
    kept = [x[:samples].copy()]
    for step in range(1, horizon * substeps + 1):
        before = x[live]
        after = theta + (before - theta) * decay + rng.normal(0, sd, len(live))
        x[live] = after
        high[live], low[live] = np.maximum(high[live], after), np.minimum(low[live], after)
        out, bad = sign * after >= sign * exit, sign * after <= sign * stop
        out &= sign * before < sign * exit
        bad &= sign * before > sign * stop
        both = out & bad
        if both.any():
            move = np.abs(after[both] - before[both])
            first = np.abs(exit - before[both]) / move < np.abs(stop - before[both]) / move
            out[both], bad[both] = first, ~first
        exits[live[out]], stops[live[bad]] = step * h, step * h
        live = live[~(out | bad)]
        if step % substeps == 0:
            kept.append(x[:samples].copy())
        if not len(live) and not samples:
            break
    up, down = high - current, current - low
    return {"exit_time": exits, "stop_time": stops, "mfe": up if sign > 0 else down, "mae": down if sign > 0 else up, "samples": np.stack(kept, axis=1)}


def _summary(candidate: int, exit: float, stop: float, got: dict[str, np.ndarray]) -> tuple:
    t, n = got["exit_time"], len(got["exit_time"])
    hit = ~np.isnan(t)
    p, q = hit.mean(), (~np.isnan(got["stop_time"])).mean()
    times = t[hit]
    return (candidate, exit, stop, float(p), float(q), float(1 - p - q), *(float((times <= h).sum() / n) for h in (5, 10, 20)), math.sqrt(p * (1 - p) / n), float(np.median(times)) if len(times) else None, float(times.mean()) if len(times) else None, float(got["mfe"].mean()), float(got["mae"].mean()))


def first_passage(candidates: DataFrame, *, theta: float, kappa: float, sigma: float, paths: int = 10_000, horizon: int = 20, seed: int = 0, dt: float = 1.0, substeps: int = 1) -> DataFrame:
    """A summary of each candidate (candidate, current, exit, stop, direction); candidate i draws from seed + i.

    A candidate's paths are one stream of draws, so they are one task; candidates run side by side.
    """
    names = [c.split()[0] for c in SUMMARY.split(", ")]

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        r = g.iloc[0]
        got = simulate(theta, kappa, sigma, r.current, r.exit, r.stop, r.direction, dt=dt, paths=paths, horizon=horizon, seed=seed + int(key[0]), substeps=substeps)
        return pd.DataFrame([_summary(int(key[0]), r.exit, r.stop, got)], columns=names)

    return candidates.groupBy("candidate").applyInPandas(run, SUMMARY)


def first_passage_paths(spark: SparkSession, *, theta: float, kappa: float, sigma: float, current: float, exit: float, stop: float, direction: str, paths: int, chunk: int = 50_000, horizon: int = 20, seed: int = 0) -> DataFrame:
    """(chunk, path, exit_time, stop_time, mfe, mae) in independent chunks of one seed; for counts of any size."""
    n = -(-paths // chunk)

    def run(frames):
        for f in frames:
            for i in f.id:
                rng = np.random.default_rng(np.random.SeedSequence(seed).spawn(n)[int(i)])
                got = simulate(theta, kappa, sigma, current, exit, stop, direction, paths=min(chunk, paths - int(i) * chunk), horizon=horizon, rng=rng)
                got.pop("samples")
                yield pd.DataFrame({"chunk": int(i), "path": np.arange(len(got["mfe"])), **got}).replace({np.nan: None})

    return spark.range(0, n, 1, n).mapInPandas(run, "chunk long, path long, exit_time double, stop_time double, mfe double, mae double")


def sample_paths(candidates: DataFrame, *, theta: float, kappa: float, sigma: float, paths: int = 10_000, samples: int = 100, horizon: int = 20, seed: int = 0, dt: float = 1.0, substeps: int = 1) -> DataFrame:
    """(candidate, path, step, x) of each candidate's first ``samples`` paths, of the same draws as ``first_passage``."""

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        r = g.iloc[0]
        x = simulate(theta, kappa, sigma, r.current, r.exit, r.stop, r.direction, dt=dt, paths=paths, horizon=horizon, seed=seed + int(key[0]), substeps=substeps, samples=min(samples, paths))["samples"]
        path, step = np.indices(x.shape)
        return pd.DataFrame({"candidate": int(key[0]), "path": path.ravel(), "step": step.ravel(), "x": x.ravel()})

    return candidates.groupBy("candidate").applyInPandas(run, "candidate int, path int, step int, x double")
