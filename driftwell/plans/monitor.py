"""The decision monitor: from a panel to one gated decision for every ticker, all tickers side by side."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.operators import evidence as ev
from driftwell.operators.ou import compare_estimators, estimators_agree, fit_ou
from driftwell.operators.passage import simulate
from driftwell.operators.residuals import latest, trend_residual
from driftwell.operators.stationarity import stationarity
from driftwell.operators.stopping import POSITIONS, CostModel, StoppingConfig, solve

SOLVED = "ticker string, policy_action string, p_exit_before_stop double, p_stop_before_exit double, p_exit_20d double, median_holding_time double, expected_value double"


def _solved(costs: CostModel, paths: int, seed: int):
    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        r = g.iloc[0]
        row = [r.ticker, "WAIT", None, None, None, None, None]
        if r.valid and r.spread > 0:
            sd = float(r.spread)
            c = StoppingConfig(r.theta, r.kappa, r.sigma, grid_min=r.theta - 3 * sd, grid_max=r.theta + 3 * sd, long_stop=r.theta - 2.5 * sd, short_stop=r.theta + 2.5 * sd)
            x, scores = solve(c, costs)
            at = int(np.abs(x - r.trend_residual).argmin())
            best = int(scores["FLAT"][:, at].argmax())
            row[1], row[6] = POSITIONS["FLAT"][best], float(scores["FLAT"][best, at])
            side = {"LONG_RESIDUAL": -2.5, "SHORT_RESIDUAL": 2.5}.get(r.direction)
            stop = None if side is None else r.theta + side * sd
            inside = side is not None and (stop < r.trend_residual < r.theta if side < 0 else r.theta < r.trend_residual < stop)
            if inside:
                got = simulate(r.theta, r.kappa, r.sigma, r.trend_residual, r.theta, stop, r.direction, paths=paths, seed=seed)
                t = got["exit_time"][~np.isnan(got["exit_time"])]
                row[2:6] = [len(t) / paths, float((~np.isnan(got["stop_time"])).mean()), float((t <= 20).sum() / paths), float(np.median(t)) if len(t) else None]
        return pd.DataFrame([row], columns=[c.split()[0] for c in SOLVED.split(", ")])

    return run


def decision_monitor(panel: DataFrame, *, window: int = 252, trend_window: int = 26, threshold: float = 2.0, costs: CostModel = CostModel(), paths: int = 2000, seed: int = 7, longest_half_life: float = 60.0, regime: Column | None = None) -> DataFrame:
    """One row per ticker: residual, fit, tests, consensus, policy, first passage, decision, confidence and reasons.

    The state is the trend residual of the last ``window`` dates; the fit is that of the exact likelihood, and the
    parameters count as stable if both estimators agree. Regimes are NORMAL unless a column ``regime`` over ticker,
    ts and the fit's columns says otherwise (SEVERE_BREAK closes a gate). Where the state already lies beyond its boundaries no
    passage is simulated and its columns are null.
    """
    regime = F.lit("NORMAL") if regime is None else regime
    residual = trend_residual(panel, trend_window).where("trend_residual is not null")
    end = residual.groupBy("ticker").agg(F.max("pos").alias("end"))
    recent = residual.join(end, "ticker").where(F.col("pos") > F.col("end") - window).drop("end")
    now = latest(recent, ["ticker"]).select("ticker", "ts", "trend_residual", "zscore")
    spread = recent.groupBy("ticker").agg(F.stddev_samp("trend_residual").alias("spread"), F.count("*").alias("n"))
    ar1, mle = (fit_ou(recent, "trend_residual", keys=["ticker"], method=m) for m in ("AR1", "MLE"))
    agree = estimators_agree(compare_estimators(ar1, ["ticker"], mle), ["ticker"], longest_half_life=longest_half_life).select("ticker", "agree")
    fits = mle.select("ticker", "theta", "kappa", "sigma", "half_life", "valid", F.col("invalid_reason").alias("fit_reason"))
    df = now.join(spread, "ticker").join(fits, "ticker").join(agree, "ticker").join(stationarity(recent, "trend_residual", keys=["ticker"]), "ticker")
    df = df.withColumn("direction", ev.direction_of(F.col("zscore"), threshold))
    votes = df.select("ticker", F.lit("trend").alias("model_name"), "direction", F.col("zscore").isNotNull().alias("valid"), F.col("valid").alias("gate_passed"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("reliability"), F.lit(None).cast("string").alias("dependency_group"))
    agreed = ev.consensus(votes, entity="ticker").withColumnRenamed("state", "consensus_state")
    solved = df.select("ticker", "trend_residual", "direction", "spread", "theta", "kappa", "sigma", "valid").groupBy("ticker").applyInPandas(_solved(costs, paths, seed), SOLVED)
    df = df.withColumnRenamed("valid", "ou_valid").join(agreed.select("ticker", "consensus_state", "agreement_percentage", "valid_model_count"), "ticker").join(solved, "ticker")
    df = df.withColumns({
        "sufficient_data": F.col("n") >= 20, "residual_valid": F.col("zscore").isNotNull(), "stationarity_valid": F.col("stationary"), "half_life_acceptable": F.coalesce(F.col("half_life") <= longest_half_life, F.lit(False)),
        "parameter_stable": F.col("agree"), "regime_status": regime, "q_stationarity": F.col("stationary").cast("double"), "q_ou": F.col("agree").cast("double"), "q_half_life": F.coalesce(F.col("half_life") <= longest_half_life, F.lit(False)).cast("double"), "q_regime": (regime == "NORMAL").cast("double"),
    })
    return ev.final_decision(df, stationarity_quality="q_stationarity", ou_agreement="q_ou", half_life_quality="q_half_life", parameter_stability="q_ou", regime_quality="q_regime", first_passage_quality="p_exit_before_stop").drop("q_stationarity", "q_ou", "q_half_life", "q_regime")
