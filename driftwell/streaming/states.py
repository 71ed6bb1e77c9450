"""Streaming forms: live classification (stateless), the Kalman filter and the signal machine (keyed state)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftwell.operators.folds import KALMAN_COLUMNS, KalmanNoise, benchmark_action, checked_action, kalman_step, next_position
from driftwell.operators.live import classify_live, evaluations


def live_evaluations(quotes: DataFrame, frozen: DataFrame, *, delay: str = "1 day") -> DataFrame:
    """Quotes as a stream against a static table of frozen models; one evaluation for each prediction and time."""
    got = classify_live(quotes.withWatermark("ts", delay), frozen)
    return got.select("prediction_id", "ts", "residual", "state", "distance_to_entry", "distance_to_exit", "distance_to_stop", "fraction_reverted").dropDuplicatesWithinWatermark(["prediction_id", "ts"])


def kalman_stream(pairs: DataFrame, noise: KalmanNoise = KalmanNoise()) -> DataFrame:
    """The pair filter over a stream (target, peer, ts, t, p). Rows not after the last one seen of a pair are dropped."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (*noise.start(), -math.inf)
        s, last = now[:5], now[5]
        g = pd.concat(list(frames)).sort_values("ts")
        rows = []
        for ts, t, p in zip(g.ts, g.t, g.p, strict=True):
            at = pd.Timestamp(ts).timestamp()
            if at <= last or not (math.isfinite(t) and math.isfinite(p)):
                continue
            s, row = kalman_step(s, t, p, noise)
            last = at
            if row:
                rows.append((*key, ts, *row))
        state.update((*s, last))
        if rows:
            yield pd.DataFrame(rows, columns=["target", "peer", "ts", *KALMAN_COLUMNS])

    out = "target string, peer string, ts timestamp, " + ", ".join(f"{c} double" for c in KALMAN_COLUMNS)
    kept = "a double, b double, aa double, ab double, bb double, last double"
    return pairs.groupBy("target", "peer").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)


def signal_stream(prices: DataFrame, *, window: int = 60, entry: float = 2.0, exit: float = 0.5, stop: float = 4.0) -> DataFrame:
    """Benchmark actions over a stream (ticker, ts, price); state is the last ``window`` log prices and the position."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        logs, position, last = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], "FLAT", -math.inf)
        g = pd.concat(list(frames)).sort_values("ts")
        rows = []
        for ts, price in zip(g.ts, g.price, strict=True):
            at = pd.Timestamp(ts).timestamp()
            if at <= last:
                continue
            last, x = at, math.log(price) if price and price > 0 else math.nan
            z = math.nan
            if len(logs) == window and not math.isnan(x) and not any(map(math.isnan, logs)):
                mean = sum(logs) / window
                sd = math.sqrt(sum((v - mean) ** 2 for v in logs) / (window - 1))
                z = (x - mean) / sd if sd > 1e-12 else math.nan
            action = "INSUFFICIENT_DATA" if math.isnan(z) else benchmark_action(z, position, entry, exit, stop)
            position = next_position(position, action)
            logs = (logs + [x])[-window:]
            rows.append((key[0], ts, price, None if math.isnan(z) else z, action, position))
        state.update((logs, position, last))
        if rows:
            yield pd.DataFrame(rows, columns=["ticker", "ts", "price", "zscore", "action", "position"])

    return prices.groupBy("ticker").applyInPandasWithState(step, "ticker string, ts timestamp, price double, zscore double, action string, position string", "logs array<double>, position string, last double", "append", GroupStateTimeout.NoTimeout)


def hook_stream(prices: DataFrame, hook, *, history: int) -> DataFrame:
    """Actions of a user's hook(last ``history`` prices as a pandas Series by ts, position) over a stream (ticker, ts, price)."""
    if history < 1:
        raise ValueError("the hook needs a row of history")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, seen, position = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], "FLAT")
        rows = []
        for ts, price in pd.concat(list(frames)).sort_values("ts")[["ts", "price"]].itertuples(index=False):
            at = pd.Timestamp(ts).timestamp()
            if times and at <= times[-1]:
                continue
            times, seen = [*times, at][-history:], [*seen, price][-history:]
            action = checked_action(hook(pd.Series(seen, index=pd.to_datetime(times, unit="s"), dtype=float), position))
            position = next_position(position, action)
            rows.append((key[0], ts, price, action, position))
        state.update((times, seen, position))
        if rows:
            yield pd.DataFrame(rows, columns=["ticker", "ts", "price", "action", "position"])

    return prices.groupBy("ticker").applyInPandasWithState(step, "ticker string, ts timestamp, price double, action string, position string", "times array<double>, seen array<double>, position string", "append", GroupStateTimeout.NoTimeout)


__all__ = ["evaluations", "hook_stream", "kalman_stream", "live_evaluations", "signal_stream"]
