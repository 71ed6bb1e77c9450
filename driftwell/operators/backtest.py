"""Event studies, trades and results of signals; a signal at t is executed at t + lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions.scratch import Scratch
from driftwell.operators.folds import CLOSING, OPENING, benchmark_signals, hook_signals
from driftwell.operators.residuals import zscore_benchmark
from driftwell.operators.stopping import CostModel
from driftwell.sources.panels import halo

HORIZONS = (1, 3, 5, 10, 20)


def _w():
    return Window.partitionBy("ticker").orderBy("pos")


def event_study(signals: DataFrame, *, exit_boundary: float = 0.0, horizons: tuple[int, ...] = HORIZONS, stop_boundary: float | None = None, signed_stop: bool = False) -> DataFrame:
    """Outcomes of every candidate (an opening action) over each horizon; signals: ticker, ts, pos, price, zscore, action.

    Horizons are cut at the series' end. One sort serves all horizons: each is a frame of the same window. The stop
    boundary is the same number for both directions; with ``signed_stop`` long events stop at its negative.
    """
    z0 = F.col("zscore")
    up = z0 < exit_boundary
    sign = F.when(up, 1).otherwise(-1)
    ends = signals.groupBy("ticker").agg(F.max_by("price", "pos").alias("_end_price"), F.max_by("zscore", "pos").alias("_end_zscore"))
    df = halo(signals, 0, ["ticker"], ahead=1 + max(horizons))  # a horizon reaches no farther, so a series is many tasks
    w = Window.partitionBy("ticker", "part").orderBy("pos")
    df = df.join(ends, "ticker").withColumn("entry", F.lead("price").over(w)).withColumn("execution", F.lead("ts").over(w))
    high = F.lit(stop_boundary) if stop_boundary is not None else F.lit(None).cast("double")
    low = -high if signed_stop else high
    records = []
    for h in horizons:
        ahead = w.rowsBetween(1, 1 + h)
        last = lambda c: F.coalesce(F.lead(c, 1 + h).over(w), F.col(f"_end_{c}"))  # noqa: E731, B023
        end_price, end_z = last("price"), last("zscore")
        top, bottom = F.max("price").over(ahead), F.min("price").over(ahead)
        ztop, zbottom = F.max("zscore").over(ahead), F.min("zscore").over(ahead)
        raw = end_price / F.col("entry") - 1
        records.append(
            F.struct(
                F.lit(h).alias("horizon_days"), raw.alias("raw_target_return"), (sign * raw).alias("direction_adjusted_return"), (end_z - z0).alias("residual_change"),
                (F.abs(z0 - exit_boundary) - F.abs(end_z - exit_boundary)).alias("distance_toward_equilibrium"),
                F.when(F.abs(z0 - exit_boundary) >= 1e-12, (z0 - end_z) / (z0 - exit_boundary)).alias("fraction_reverted"),
                F.coalesce(F.when(up, ztop >= exit_boundary).otherwise(zbottom <= exit_boundary), F.lit(False)).alias("exit_reached"),
                F.when(high.isNotNull(), F.coalesce(F.when(up, zbottom <= low).otherwise(ztop >= high), F.lit(False))).alias("stop_reached"),
                F.when(up, top / F.col("entry") - 1).otherwise(1 - bottom / F.col("entry")).alias("mfe"), F.when(up, bottom / F.col("entry") - 1).otherwise(1 - top / F.col("entry")).alias("mae"),
            )
        )
    df = df.withColumn("_r", F.array(*records)).where(F.col("own") & F.col("action").isin(*OPENING) & F.col("execution").isNotNull())
    return df.select("ticker", F.col("ts").alias("signal_date"), F.col("execution").alias("execution_date"), F.inline("_r"))


def trades(signals: DataFrame, *, costs: CostModel = CostModel(), notional: float = 1.0, lag: int = 1) -> DataFrame:
    """Closed trades: an opening action and the next closing one. Actions too late to be executed open or close nothing.

    Opening actions while a trade is open, and closing ones while none is, are passed over, as of any hook's signals:
    after the actions that neither open nor close, only the first of each run of equals counts.
    """
    if lag < 0:
        raise ValueError("an action cannot be executed before its row")
    w = Window.partitionBy("ticker", "part").orderBy("pos")
    df = halo(signals, 0, ["ticker"], ahead=lag).withColumn("fill", F.lead("price", lag).over(w) if lag else F.col("price"))
    df = df.where(F.col("own") & F.col("action").isin(*OPENING, *CLOSING)).drop("part", "own")
    reach = signals.groupBy("ticker").agg(F.max("pos").alias("last"))
    df = df.join(reach, "ticker").where(F.col("pos") + lag <= F.col("last")).withColumn("opens", F.col("action").isin(*OPENING))
    df = df.withColumn("before", F.lag("opens").over(_w())).where((F.col("before").isNull() & F.col("opens")) | (F.col("before") != F.col("opens")))
    nxt = lambda c: F.lead(c).over(_w())
    df = df.withColumn("exit_date", nxt("ts")).withColumn("exit_price", nxt("fill")).withColumn("exit_pos", nxt("pos")).where("opens and exit_date is not null")
    sign = F.when(F.col("action") == "ENTER_LONG", 1).otherwise(-1)
    cost = F.lit(float(costs.trade(notional, True) + costs.trade(notional, False)))
    df = df.withColumn("gross_pnl", notional * sign * (F.col("exit_price") / F.col("fill") - 1))
    return df.select("ticker", F.col("ts").alias("entry_date"), "exit_date", F.col("action").alias("direction"), F.lit(float(notional)).alias("gross_notional"), "gross_pnl", cost.alias("costs"), (F.col("gross_pnl") - cost).alias("net_pnl"), (F.col("exit_pos") - F.col("pos")).alias("holding_days"), F.col("pos").alias("entry_pos"))


def equity(trade_rows: DataFrame) -> DataFrame:
    """Running net result and its distance from the highest so far (which starts at the first trade)."""
    w = Window.partitionBy("ticker").orderBy("entry_pos").rowsBetween(Window.unboundedPreceding, 0)
    df = trade_rows.withColumn("equity", F.sum("net_pnl").over(w))
    return df.withColumn("drawdown", F.col("equity") - F.max("equity").over(w))


def metrics(trade_rows: DataFrame, events: DataFrame, tickers: DataFrame) -> DataFrame:
    """Sixteen figures of each ticker; counts of candidates, exits and stops are counts of event rows."""
    n, hold = F.col("net_pnl"), F.col("holding_days")
    t = equity(trade_rows).groupBy("ticker").agg(
        F.count("*").alias("trade_count"), F.sum("gross_pnl").alias("gross_pnl"), F.sum("costs").alias("costs"), F.sum(n).alias("net_pnl"), F.avg((n > 0).cast("double")).alias("win_rate"), F.avg(F.when(n > 0, n)).alias("average_win"),
        F.avg(F.when(n < 0, n)).alias("average_loss"), F.min("drawdown").alias("maximum_drawdown"), F.sum("gross_notional").alias("turnover"), F.avg(hold).alias("average_holding_period"), F.median(hold).alias("median_holding_period"),
    )
    flag = lambda c: F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0)))
    e = events.groupBy("ticker").agg(F.count("*").alias("candidate_count"), flag("exit_reached").alias("exit_count"), flag("stop_reached").alias("stop_count"), F.avg("fraction_reverted").alias("average_fraction_reverted"), F.median("fraction_reverted").alias("median_fraction_reverted"))
    both = tickers.select("ticker").distinct().join(t, "ticker", "left").join(e, "ticker", "left")
    zero = ["trade_count", "gross_pnl", "costs", "net_pnl", "maximum_drawdown", "turnover", "candidate_count", "exit_count", "stop_count"]
    return both.select("ticker", *(F.coalesce(F.col(c), F.lit(0)).alias(c) if c in zero else F.col(c) for c in both.columns if c != "ticker"))


def horizon_buckets(events: DataFrame) -> DataFrame:
    return events.groupBy("ticker", "horizon_days").agg(F.count("*").alias("observations"), F.avg("fraction_reverted").alias("average_fraction_reverted"), F.avg(F.col("exit_reached").cast("double")).alias("realized_exit_frequency"))


def calibration(predicted: DataFrame, p: str = "predicted", realized: str = "realized") -> DataFrame:
    """Buckets [0.5, 0.6) to [0.9, 1] of predicted probabilities; empty ones stay, with no means."""
    edges = [0.5, 0.6, 0.7, 0.8, 0.9, 1.000001]
    buckets = predicted.sparkSession.createDataFrame(list(zip(edges, edges[1:])), "low double, high double")
    at = F.when(F.col(p) >= 0.9, 0.9)
    for e in edges[-3::-1]:
        at = at.when(F.col(p) >= e, e)
    got = predicted.where(F.col(p).isNotNull() & F.col(realized).isNotNull() & (F.col(p) < edges[-1])).withColumn("low", at).where("low is not null")
    got = got.groupBy("low").agg(F.count("*").alias("observations"), F.avg(p).alias("average_predicted_probability"), F.avg(F.col(realized).cast("double")).alias("actual_exit_frequency"))
    return buckets.join(got, "low", "left").withColumn("observations", F.coalesce("observations", F.lit(0)))


def predicted_events(events: DataFrame, predicted: DataFrame) -> DataFrame:
    """Every event with the probability predicted for its signal (ticker, signal_date, predicted), null if there is none, and what came true."""
    return events.join(predicted.select("ticker", "signal_date", "predicted"), ["ticker", "signal_date"], "left").withColumn("realized", F.col("exit_reached"))


def run_backtest(panel: DataFrame, *, window: int = 60, entry: float = 2.0, exit: float = 0.5, stop: float = 4.0, costs: CostModel = CostModel(), notional: float = 1.0, lag: int = 1, hook=None, history: int | None = None, predicted: DataFrame | None = None) -> dict[str, DataFrame]:
    """Benchmark signals of every ticker, their events, trades, metrics and buckets; and those of a user's hook.

    Signals are folded once, into a table in the checkpoint folder that all results read. With ``predicted`` (ticker,
    signal_date, predicted) the events are also held against predicted probabilities of reaching the exit: calibration.
    """
    scored = zscore_benchmark(panel, window).select("ticker", "ts", "pos", "price", "zscore")
    scratch = Scratch(panel.sparkSession, "backtest")

    def results(signals: DataFrame, name: str) -> dict[str, DataFrame]:
        signals = scratch.table(signals, f"{name}signals")
        events, closed = event_study(signals, stop_boundary=stop), trades(signals, costs=costs, notional=notional, lag=lag)
        found = {"signals": signals, "events": events, "trades": closed, "equity": equity(closed), "metrics": metrics(closed, events, panel), "buckets": horizon_buckets(events)}
        if predicted is not None:
            found["calibration"] = calibration(predicted_events(events, predicted))
        return {f"{name}{k}": v for k, v in found.items()}

    out = results(benchmark_signals(scored, entry=entry, exit=exit, stop=stop), "")
    if hook is not None:
        full = hook_signals(panel, hook, history=history).join(scored.select("ticker", "pos", "zscore"), ["ticker", "pos"])
        out |= results(full.select("ticker", "ts", "pos", "price", "zscore", "action"), "full_")
    return out


def pair_trades(positions: DataFrame, costs: CostModel = CostModel()) -> DataFrame:
    """Two-leg accounting of rows (beta, target_price, peer_price, notional, multiplier, exit_target_price, exit_peer_price)."""
    c = F.col
    unit = c("notional") / (c("target_price") + F.abs(c("beta")) * c("peer_price")) * c("multiplier")
    df = positions.withColumn("target_shares", unit).withColumn("peer_shares", -c("beta") * unit)
    df = df.withColumn("gross_notional", F.abs("target_shares") * c("target_price") + F.abs("peer_shares") * c("peer_price"))
    df = df.withColumn("gross_pnl", c("target_shares") * (c("exit_target_price") - c("target_price")) + c("peer_shares") * (c("exit_peer_price") - c("peer_price")))
    total: Column = costs.trade(c("gross_notional"), True) + costs.trade(c("gross_notional"), False)
    return df.withColumn("costs", total).withColumn("net_pnl", c("gross_pnl") - c("costs"))
