"""Recursions along a series: the Kalman pair filter and the benchmark's position state machine.

Each keeps its step in one place, for batch folds by series and for stateful streams. A null row leaves state alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# The filter's outputs, by the names users know.
KALMAN_COLUMNS = ["prior_alpha", "prior_beta", "alpha", "beta", "predicted_log_target", "innovation", "innovation_variance", "standardized_innovation", "spread_state"]
OPENING = {"ENTER_LONG": "LONG_RESIDUAL", "ENTER_SHORT": "SHORT_RESIDUAL"}
CLOSING = ("EXIT_LONG", "STOP_LONG", "EXIT_SHORT", "STOP_SHORT")


@dataclass(frozen=True)
class KalmanNoise:
    alpha: float = 1e-5
    beta: float = 1e-5
    observation: float = 1e-4
    first_alpha: float = 0.0
    first_beta: float = 1.0
    covariance: float = 1.0

    def __post_init__(self):
        if min(self.alpha, self.beta, self.observation, self.covariance) <= 0:
            raise ValueError("noise and covariance must be positive")

    def start(self) -> tuple[float, ...]:
        return self.first_alpha, self.first_beta, self.covariance, 0.0, self.covariance


def kalman_step(state: tuple[float, ...], t: float, p: float, noise: KalmanNoise) -> tuple[tuple[float, ...], list[float] | None]:
    """state: (alpha, beta, var alpha, covariance, var beta); one observation t = alpha + beta * p.

    An observation whose innovation variance is not finite or not positive is passed over: the state stays, no row.
    """
    a, b, aa, ab, bb = state
    aa, bb = aa + noise.alpha, bb + noise.beta
    ga, gb = aa + ab * p, ab + bb * p
    predicted = a + b * p
    variance = ga + gb * p + noise.observation
    if not 0 < variance < math.inf:
        return state, None
    e = t - predicted
    ka, kb = ga / variance, gb / variance
    a2, b2 = a + ka * e, b + kb * e
    after = (a2, b2, aa - ka * ga, ab - ka * gb, bb - kb * gb)
    return after, [a, b, a2, b2, predicted, e, variance, e / variance**0.5, t - a2 - b2 * p]


def kalman_pairs(pairs: DataFrame, noise: KalmanNoise = KalmanNoise()) -> DataFrame:
    """The filter over each pair (target, peer, ts, pos, t, p); rows with a missing price are not valid."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        state, rows = noise.start(), []
        for t, p in zip(g.t.to_numpy(float), g.p.to_numpy(float), strict=True):
            row = None
            if np.isfinite(t) and np.isfinite(p):
                state, row = kalman_step(state, t, p, noise)
            rows.append([*row, True] if row else [None] * len(KALMAN_COLUMNS) + [False])
        out = g[["target", "peer", "ts", "pos"]].reset_index(drop=True)
        return pd.concat([out, pd.DataFrame(rows, columns=[*KALMAN_COLUMNS, "valid"])], axis=1)

    kind = pairs.schema["ts"].dataType.simpleString()
    schema = f"target string, peer string, ts {kind}, pos long, " + ", ".join(f"{c} double" for c in KALMAN_COLUMNS) + ", valid boolean"
    return pairs.select("target", "peer", "ts", "pos", "t", "p").groupBy("target", "peer").applyInPandas(fold, schema)


# By position: what is measured of a z-score, the limit that it must reach, and the action; the first that holds is taken.
_RULES = {
    "FLAT": ((lambda z: -z, "entry", "ENTER_LONG"), (lambda z: z, "entry", "ENTER_SHORT")),
    "LONG_RESIDUAL": ((lambda z: -z, "stop", "STOP_LONG"), (lambda z: -abs(z), "exit", "EXIT_LONG")),
    "SHORT_RESIDUAL": ((lambda z: z, "stop", "STOP_SHORT"), (lambda z: -abs(z), "exit", "EXIT_SHORT")),
}
_OTHERWISE = {"FLAT": "WAIT", "LONG_RESIDUAL": "HOLD_LONG", "SHORT_RESIDUAL": "HOLD_SHORT"}


def benchmark_action(z: float, position: str, entry: float = 2.0, exit: float = 0.5, stop: float = 4.0) -> str:
    limits = {"entry": entry, "exit": -exit, "stop": stop}
    return next((action for measure, limit, action in _RULES[position] if measure(z) >= limits[limit]), _OTHERWISE[position])


def next_position(position: str, action: str) -> str:
    return OPENING.get(action, "FLAT" if action in CLOSING else position)


def signal_rows(zs: Iterator[float], entry: float, exit: float, stop: float, position: str = "FLAT") -> Iterator[tuple[str, str]]:
    """(action, position after) of each z-score; a missing one is INSUFFICIENT_DATA and keeps the position."""
    for z in zs:
        if z is None or not np.isfinite(z):
            yield "INSUFFICIENT_DATA", position
        else:
            action = benchmark_action(z, position, entry, exit, stop)
            position = next_position(position, action)
            yield action, position


def benchmark_signals(scored: DataFrame, *, entry: float = 2.0, exit: float = 0.5, stop: float = 4.0) -> DataFrame:
    """Actions of every series (ticker, ts, pos, price, zscore), in order of pos."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos").reset_index(drop=True)
        g["action"], g["position"] = zip(*signal_rows(g.zscore.to_numpy(float), entry, exit, stop), strict=True)
        return g

    kind = scored.schema["ts"].dataType.simpleString()
    return scored.select("ticker", "ts", "pos", "price", "zscore").groupBy("ticker").applyInPandas(fold, f"ticker string, ts {kind}, pos long, price double, zscore double, action string, position string")


def hook_signals(panel: DataFrame, hook, *, history: int | None = None) -> DataFrame:
    """Actions of a user's hook(prices up to and with t as a read-only pandas Series by ts, position); it sees no later row.

    The hook sees the last ``history`` rows, or all; the slices share one array, so nothing is copied. A series is one
    group, as its position follows from all actions before.
    """
    if history is not None and history < 1:
        raise ValueError("the hook needs a row of history")

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos").reset_index(drop=True)
        prices = g.price.to_numpy(float, copy=True)
        prices.flags.writeable = False
        series, position, actions = pd.Series(prices, index=g.ts, copy=False), "FLAT", []
        for i in range(len(series)):
            action = checked_action(hook(series.iloc[0 if history is None else max(0, i + 1 - history) : i + 1], position))
            actions.append(action)
            position = next_position(position, action)
        return g.assign(action=actions)

    kind = panel.schema["ts"].dataType.simpleString()
    return panel.select("ticker", "ts", "pos", "price").groupBy("ticker").applyInPandas(fold, f"ticker string, ts {kind}, pos long, price double, action string")


ACTIONS = frozenset({"WAIT", "INSUFFICIENT_DATA", "NO_SIGNAL", "CONFLICTED", *OPENING, *CLOSING, "HOLD_LONG", "HOLD_SHORT"})


def checked_action(action) -> str:
    if action not in ACTIONS:
        raise TypeError(f"the hook must return an action, not {action!r}")
    return action
