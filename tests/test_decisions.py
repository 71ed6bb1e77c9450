"""Backtests, passages, policies, evidence, live monitoring, the journal and streams."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators import backtest as bt
from driftwell.operators import evidence as ev
from driftwell.operators import folds, live, passage, stopping
from driftwell.operators.stopping import CostModel, StoppingConfig
from driftwell.sources.journal import Journal, new_snapshot, parameter_hash
from tests.test_residuals import panel


@pytest.fixture(scope="module")
def prices(spark):
    x = np.linspace(4, 4.3, 120) + 0.04 * np.sin(np.arange(120) / 3)
    x[60] -= 0.3
    return panel(spark, A=np.exp(x))


def test_actions():
    step = lambda z, p: folds.benchmark_action(z, p)
    assert [step(-2, "FLAT"), step(2, "FLAT"), step(0, "FLAT")] == ["ENTER_LONG", "ENTER_SHORT", "WAIT"]
    assert [step(-4, "LONG_RESIDUAL"), step(0.5, "LONG_RESIDUAL"), step(-1, "LONG_RESIDUAL"), step(4, "SHORT_RESIDUAL")] == ["STOP_LONG", "EXIT_LONG", "HOLD_LONG", "STOP_SHORT"]
    assert list(folds.signal_rows(iter([-3.0, float("nan"), 0.0]), 2, 0.5, 4)) == [("ENTER_LONG", "LONG_RESIDUAL"), ("INSUFFICIENT_DATA", "LONG_RESIDUAL"), ("EXIT_LONG", "FLAT")]


def test_backtest(prices):
    costs = CostModel(fixed_entry_cost=0.1, bid_ask_bps=100)
    got = bt.run_backtest(prices, window=20, entry=1.0, costs=costs)
    signals = {r.pos: r for r in got["signals"].collect()}
    trades = got["trades"].orderBy("entry_pos").collect()
    price = {r.pos: r.price for r in prices.collect()}
    assert trades
    for t in trades:
        i = t.entry_pos
        j = next(k for k in range(i + 1, 120) if signals[k].action in folds.CLOSING)
        sign = 1 if t.direction == "ENTER_LONG" else -1
        assert t.gross_pnl == pytest.approx(sign * (price[j + 1] / price[i + 1] - 1)) and t.costs == pytest.approx(0.12) and t.holding_days == j - i
    events = got["events"].collect()
    assert {e.horizon_days for e in events} == set(bt.HORIZONS) and len(events) % 5 == 0
    m = got["metrics"].first()
    assert m.trade_count == len(trades) and m.candidate_count == len(events) and m.maximum_drawdown <= 0
    e = next(e for e in events if e.horizon_days == 5)
    i = next(k for k, r in signals.items() if str(r.ts) == str(e.signal_date))
    assert e.raw_target_return == pytest.approx(price[min(i + 6, 119)] / price[i + 1] - 1) and e.mae <= e.mfe
    hooked = bt.run_backtest(prices, window=20, hook=lambda h, p: "ENTER_LONG" if len(h) == 30 else "EXIT_LONG" if len(h) == 40 else "WAIT")
    assert hooked["full_trades"].first().holding_days == 10
    with pytest.raises(Exception):  # noqa: B017
        bt.run_backtest(prices, window=20, hook=lambda h, p: 1)["full_signals"].collect()


def test_predicted_probabilities_meet_their_events(spark, prices):
    got = bt.run_backtest(prices, window=20, entry=1.0)
    events = got["events"].select("ticker", "signal_date").distinct()
    some = events.orderBy("signal_date").limit(1).withColumn("predicted", F.lit(0.75))
    buckets = {r.low: r.observations for r in bt.run_backtest(prices, window=20, entry=1.0, predicted=some)["calibration"].collect()}
    assert buckets[0.7] == len(bt.HORIZONS) and sum(buckets.values()) == len(bt.HORIZONS)


def test_hook_with_bounded_history(prices):
    seen = []

    def hook(history, position):
        assert len(history) <= 5 and not history.to_numpy().flags.writeable
        return "ENTER_LONG" if history.index[-1].day == 9 else "EXIT_LONG" if history.index[-1].day == 20 else "WAIT"

    got = folds.hook_signals(prices, hook, history=5).where("action <> 'WAIT'").count()
    assert got >= 4 and not seen
    with pytest.raises(ValueError):
        folds.hook_signals(prices, hook, history=0)


def test_long_series_of_signals_are_cut_into_blocks_without_a_trace(prices, monkeypatch):
    signals = folds.benchmark_signals(bt.zscore_benchmark(prices, 20).select("ticker", "ts", "pos", "price", "zscore"), entry=1.0)
    pick = lambda: (sorted(map(str, bt.event_study(signals, stop_boundary=2.0).collect())), sorted(map(str, bt.trades(signals).collect())))
    whole, halo = pick(), bt.halo
    monkeypatch.setattr(bt, "halo", lambda df, back, keys, block=32, *, ahead=0: halo(df, back, keys, 8, ahead=ahead))
    assert pick() == whole and len(whole[0]) > 5


def test_kalman_passes_over_what_it_cannot_weigh():
    noise = folds.KalmanNoise()
    state, row = folds.kalman_step((0.0, 1.0, 1e308, 0.0, 1e308), 1.0, 1e10, noise)
    assert row is None and state == (0.0, 1.0, 1e308, 0.0, 1e308)
    assert folds.kalman_step(noise.start(), 1.0, 1.0, noise)[1] is not None


def test_open_trade_and_late_signal_are_dropped(spark):
    p = [("A", dt.date(2024, 1, i + 1), i, 100.0 + i, z, a) for i, (z, a) in enumerate([(-2.0, "ENTER_LONG"), (0.0, "EXIT_LONG"), (2.0, "ENTER_SHORT"), (0.0, "EXIT_SHORT")])]
    got = bt.trades(spark.createDataFrame(p, "ticker string, ts date, pos long, price double, zscore double, action string")).collect()
    assert [t.direction for t in got] == ["ENTER_LONG"]


def test_calibration(spark):
    df = spark.createDataFrame([(0.4, True), (0.5, True), (0.55, False), (0.95, True), (None, True), (1.0, True)], "predicted double, realized boolean")
    got = {r.low: r for r in bt.calibration(df).collect()}
    assert [got[k].observations for k in sorted(got)] == [2, 0, 0, 0, 2] and got[0.5].actual_exit_frequency == 0.5 and got[0.7].actual_exit_frequency is None


def test_pair_trades(spark):
    df = spark.createDataFrame([(1.0, 100.0, 50.0, 1000.0, 1.0, 110.0, 50.0)], "beta double, target_price double, peer_price double, notional double, multiplier double, exit_target_price double, exit_peer_price double")
    r = bt.pair_trades(df, CostModel(bid_ask_bps=10)).first()
    assert r.gross_notional == pytest.approx(1000) and r.gross_pnl == pytest.approx(1000 / 150 * 10) and r.costs == pytest.approx(2)


def test_first_passage(spark):
    run = lambda **k: passage.simulate(0.0, 0.1, 0.2, -0.5, 0.0, -1.0, "LONG_RESIDUAL", seed=1, **k)
    a, b = run(paths=4000), run(paths=4000)
    assert np.array_equal(a["exit_time"], b["exit_time"], equal_nan=True) and not (~np.isnan(a["exit_time"]) & ~np.isnan(a["stop_time"])).any()
    assert (a["mfe"] >= 0).all() and (a["mae"] >= 0).all()
    near = passage.boundary_candidates(spark, -0.5, "LONG_RESIDUAL", [-0.3, 0.0], [-1.0]).withColumn("candidate", (F.col("exit") == 0).cast("int"))
    got = {r.candidate: r for r in passage.first_passage(near, theta=0.0, kappa=0.1, sigma=0.2, paths=4000).collect()}
    assert got[0].exit_before_stop > got[1].exit_before_stop and sum(got[0][c] for c in ("exit_before_stop", "stop_before_exit", "neither")) == pytest.approx(1)
    paths = passage.first_passage_paths(spark, theta=0.0, kappa=0.1, sigma=0.2, current=-0.5, exit=-0.3, stop=-1.0, direction="LONG_RESIDUAL", paths=4000, chunk=1500)
    assert paths.count() == 4000 and paths.where("exit_time is not null").count() / 4000 == pytest.approx(got[0].exit_before_stop, abs=0.04)
    with pytest.raises(Exception):  # noqa: B017
        passage.boundary_candidates(spark, 0.5, "LONG_RESIDUAL", [0.0], [-1.0]).collect()
    with pytest.raises(ValueError):
        passage.simulate(0, 0.1, 0.2, 0.5, 0.0, -1.0, "LONG_RESIDUAL")


def test_policy(spark):
    c = StoppingConfig(0.0, 0.2, 0.2)
    x, s = stopping.solve(c, CostModel())
    flat = s["FLAT"].argmax(axis=0)
    assert flat[10] == 1 and flat[-10] == 2 and np.isclose(stopping.transition_masses(c, x).sum(axis=1), 1).all()
    assert s["LONG_RESIDUAL"][2, 0] == 0 and s["LONG_RESIDUAL"][0, 0] == -np.inf
    free, dear = (stopping.solve(c, CostModel(fixed_entry_cost=k))[1]["FLAT"].argmax(axis=0) for k in (0.0, 5.0))
    assert (free > 0).sum() > (dear > 0).sum() == 0
    table = stopping.policy_table(spark, [(c, CostModel())])
    region = stopping.regions(table, "FLAT", "ENTER_LONG").orderBy("start").first()
    assert region.start == -3 and region.end < 0
    states = spark.createDataFrame([(0, -2.0, "FLAT", True, True), (0, -2.0, "FLAT", False, True), (0, -2.0, "FLAT", True, False), (0, -2.9, "LONG_RESIDUAL", True, True)], "config_id int, x double, position string, sufficient_data boolean, gates_pass boolean")
    assert sorted(r.action for r in stopping.act(table, states).collect()) == ["ENTER_LONG", "INSUFFICIENT_DATA", "NO_SIGNAL", "STOP_LONG"]
    assert {r.fixed_entry_cost for r in stopping.sensitivity(spark.createDataFrame([(7, 0.0, 0.2, 0.2)], "config_id int, theta double, kappa double, sigma double"), CostModel(), [0.0, 5.0]).where("config_id = 7").collect()} == {0.0}
    still = stopping.transition_masses(StoppingConfig(0.0, 0.2, 0.0), x)
    assert set(still.sum(axis=1)) == {1.0} and still.max() == 1.0


def votes(spark, *rows):
    return spark.createDataFrame([("e", *r) for r in rows], "entity string, model_name string, direction string, valid boolean, gate_passed boolean, weight double, reliability double, dependency_group string")


def test_consensus(spark):
    one = ev.consensus(votes(spark, ("a", "LONG_RESIDUAL", True, True, 1.0, 1.0, "g"), ("b", "LONG_RESIDUAL", True, True, 1.0, 1.0, "g"), ("c", "SHORT_RESIDUAL", True, True, 1.0, 1.0, None))).first()
    assert (one.state, one.long_support, one.short_support, one.disagreeing_models) == ("CONFLICTED", 1.0, 1.0, ["a", "b", "c"])
    two = ev.consensus(votes(spark, ("a", "LONG_RESIDUAL", True, True, 3.0, 1.0, None), ("c", "SHORT_RESIDUAL", True, True, 1.0, 1.0, None), ("d", "SHORT_RESIDUAL", False, True, 9.0, 1.0, None))).first()
    assert (two.state, two.agreement_percentage, two.disagreeing_models, two.valid_model_count) == ("LONG", 75.0, ["c"], 2)
    none = ev.consensus(votes(spark, ("a", "LONG_RESIDUAL", False, True, 1.0, 1.0, None))).first()
    assert (none.state, none.valid_model_count, none.disagreeing_models) == ("INSUFFICIENT_DATA", 0, [])


def test_decision(spark):
    base = {"sufficient_data": True, "residual_valid": True, "stationarity_valid": True, "ou_valid": True, "half_life_acceptable": True, "parameter_stable": True, "regime_status": "NORMAL", "zscore": -2.5, "consensus_state": "LONG", "agreement_percentage": 100.0, "valid_model_count": 2, "policy_action": "ENTER_LONG"}
    cases = [base, base | {"sufficient_data": False}, base | {"ou_valid": False, "regime_status": "SEVERE_BREAK"}, base | {"consensus_state": "CONFLICTED"}, base | {"consensus_state": "INSUFFICIENT_DATA"}]
    df = spark.createDataFrame([{**c, "i": i} for i, c in enumerate(cases)])
    got = ev.final_decision(df).orderBy("i").collect()
    assert [r.action for r in got] == ["ENTER_LONG", "INSUFFICIENT_DATA", "NO_SIGNAL", "CONFLICTED", "INSUFFICIENT_DATA"]
    assert got[2].invalid_reason == "OU fit; SEVERE_BREAK regime" and got[2].confidence is None and got[3].confidence == 25 == got[0].confidence
    assert got[0].blocking == [] and got[2].blocking[0] == "Critical gates" and got[0].why[1].observed == "LONG"


FROZEN = ("p", "A", "B", 0.1, 0.9, -0.3, (-0.4, -0.2), None, 0.0, -0.6, 0.6)


def quotes(spark, *residuals):
    return spark.createDataFrame([("A", "B", dt.datetime(2025, 1, 1 + i), math.exp(r + 0.1 + 0.9 * math.log(50)), 50.0) for i, r in enumerate(residuals)], "target string, peer string, ts timestamp, target_price double, peer_price double")


def test_live(spark):
    q = quotes(spark, -0.3, 0.1, -0.7)
    for position, want in {"FLAT": ["ENTRY_REGION", "WAIT", "WAIT"], "LONG_RESIDUAL": ["HOLD", "EXIT_REGION", "STOP_REGION"], "SHORT_RESIDUAL": ["EXIT_REGION", "HOLD", "EXIT_REGION"]}.items():
        got = live.classify_live(q, spark.createDataFrame([(*FROZEN, position)], live.FROZEN)).orderBy("ts").collect()
        assert [r.state for r in got] == want
    assert got[1].fraction_reverted == pytest.approx(4 / 3) and got[0].implied_exit == pytest.approx(math.exp(0.1 + 0.9 * math.log(50))) and got[1].distance_to_entry == pytest.approx(0.3) and got[0].implied_short_entry is None
    rows = live.classify_live(q, spark.createDataFrame([(*FROZEN, "FLAT")], live.FROZEN)).withColumn("data_cutoff", F.lit("2024-12-31").cast("timestamp"))
    kept = live.evaluations(rows).orderBy("evaluation_timestamp").collect()
    assert [(r.elapsed_trading_days, r.evaluation_horizon) for r in kept] == [(1, "1 trading days"), (2, "2 trading days"), (3, "3 trading days")]  # Wednesday to Friday
    assert live.evaluations(live.classify_live(q.union(q), spark.createDataFrame([(*FROZEN, "FLAT")], live.FROZEN))).count() == 3
    with pytest.raises(Exception):  # noqa: B017
        live.classify_live(q.withColumn("peer_price", F.lit(-1.0)), spark.createDataFrame([(*FROZEN, "FLAT")], live.FROZEN)).collect()


def test_journal(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "journal"))
    assert j.snapshots().count() == 0
    at = dt.datetime(2025, 1, 2)
    row = new_snapshot(target_ticker="A", current_price=10, data_cutoff=at, created_at=at, frequency="daily", data_source="t", model_version="1", outputs={"ou_outputs": {"b": 1, "a": [2]}})
    j.save_snapshots([row])
    assert j.load_snapshot(row["prediction_id"])["ou_outputs"] == {"a": [2], "b": 1} and row["parameter_hash"] == parameter_hash({"ou_outputs": {"a": [2], "b": 1}})
    with pytest.raises(FileExistsError):
        j.save_snapshots([row])
    e = dict.fromkeys([c.split()[0] for c in __import__("driftwell.sources.journal", fromlist=["x"]).EVALUATIONS.split(", ") if " " in c]) | {"prediction_id": row["prediction_id"], "evaluation_timestamp": at, "live_prices": {"A": 1.0}, "exit_reached": True}
    j.save_evaluations([e])
    with pytest.raises(FileExistsError):
        j.save_evaluations([e])
    with pytest.raises(KeyError):
        j.save_evaluations([e | {"prediction_id": "none"}])
    q = live.classify_live(quotes(spark, 0.1).withColumn("data_cutoff", F.lit(at)), spark.createDataFrame([(*FROZEN, "FLAT")], live.FROZEN)).withColumn("prediction_id", F.lit(row["prediction_id"]))
    j.save_evaluations(live.evaluations(q.withColumn("ts", F.lit(dt.datetime(2025, 1, 7)))))
    last = j.evaluations(row["prediction_id"]).collect()[-1]
    assert last.elapsed_trading_days == 3 and last.live_prices.keys() == {"A", "B"}
    with pytest.raises(ValueError):
        j.save_evaluations(live.evaluations(q).withColumn("elapsed_days", F.lit(1)))
    with pytest.raises(FileExistsError):
        j.save_snapshots([row | {"notes": "n"}], overwrite=True)
    Journal(spark, j.root, allow_overwrite=True).save_snapshots([row | {"notes": "n"}], overwrite=True)
    assert j.load_snapshot(row["prediction_id"])["notes"] == "n" and j.snapshots().count() == 1
    (tmp_path / "journal" / "_lock").write_text("")
    with pytest.raises(RuntimeError):
        j.save_evaluations([e | {"evaluation_timestamp": dt.datetime(2025, 2, 1)}])
    (tmp_path / "journal" / "_lock").unlink()
    assert j.evaluations(row["prediction_id"]).count() == 2 and [r.prediction_id for r in j.list_snapshots().collect()] == [row["prediction_id"]]
    with pytest.raises(ValueError):
        new_snapshot(target_ticker="A", current_price=-1, data_cutoff=at, created_at=at, frequency="daily", data_source="t", model_version="1", outputs={})


def drain(df, name, spark, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path, prices):
    from driftwell.operators.residuals import pair_frame, zscore_benchmark
    from driftwell.streaming.states import kalman_stream, live_evaluations, signal_stream

    src = prices.select("ticker", F.col("ts").cast("timestamp").alias("ts"), "price")
    src.where("ts < '2024-03-01'").coalesce(1).write.parquet(f"{tmp_path}/p")
    src.where("ts >= '2024-03-01'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
    stream = lambda d, s: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(d)
    got = {r.ts.date(): r.action for r in drain(signal_stream(stream(f"{tmp_path}/p", src.schema), window=20, entry=1.0), "signals", spark).collect()}
    want = folds.benchmark_signals(zscore_benchmark(prices, 20).select("ticker", "ts", "pos", "price", "zscore"), entry=1.0).collect()
    assert len(got) == 120 and sum(got[r.ts] != r.action for r in want) == 0

    pairs = pair_frame(panel(spark, A=np.exp(np.linspace(1, 2, 40)), B=np.exp(np.linspace(2, 1, 40)))).select("target", "peer", F.col("ts").cast("timestamp").alias("ts"), "t", "p")
    pairs.coalesce(1).write.parquet(f"{tmp_path}/k")
    assert drain(kalman_stream(stream(f"{tmp_path}/k", pairs.schema)), "kalman", spark).count() == 80

    q = quotes(spark, -0.3, 0.1)
    q.union(q).coalesce(1).write.parquet(f"{tmp_path}/q")
    frozen = spark.createDataFrame([(*FROZEN, "FLAT")], live.FROZEN)
    assert drain(live_evaluations(stream(f"{tmp_path}/q", q.schema), frozen), "live", spark).count() == 2


def test_payloads_positions_and_tails(spark, prices):
    import json

    from driftwell.operators import residuals as rs

    row = ev.snapshot_payloads(spark.createDataFrame([("WAIT", 0.1, None)], "action string, theta double, kappa double")).first()
    assert json.loads(row.ou_outputs) == {"theta": 0.1, "kappa": None} and json.loads(row.model_outputs) == {"action": "WAIT"} and row.probability_outputs == "{}"
    units = spark.createDataFrame([(0.5, "LONG_RESIDUAL"), (0.5, "SHORT_RESIDUAL"), (0.5, "FLAT")], "beta double, side string").select(rs.pair_position(F.col("beta"), F.col("side")).alias("u")).collect()
    assert [tuple(r.u) for r in units] == [(1.0, -0.5), (-1.0, 0.5), (0.0, 0.0)]
    state = rs.state_series(rs.trend_residual(prices, 20), "trend", ["ticker"])
    tail = rs.tail_window(state, 7, ["ticker"]).orderBy("pos").collect()
    assert len(tail) == 7 and tail[-1].pos == state.count() - 1 == 99


def test_explanations_and_records(spark):
    df = spark.createDataFrame([("e", "WAIT", 1.5, None)], "entity string, action string, z double, note string")
    items = [ev.explained("Deviation", F.col("z"), F.lit(2.0), F.lit("CAUTION"), "near the boundary"), ev.explained("Fit", F.lit("no"), F.lit("yes"), F.lit("FAIL")), ev.explained("Regime", F.lit("-"), F.lit("-"), F.lit("NOT_APPLICABLE"))]
    r = ev.explain(df, items, "action").first()
    assert [i.status for i in r.why] == ["CAUTION", "FAIL", "NOT_APPLICABLE"] and r.blocking == ["Fit"] and r.explained_action == "WAIT" and r.why[0].explanation == "near the boundary"
    assert ev.explain(df, [], "action").first().blocking == []
    with pytest.raises(Exception, match="not a status"):
        ev.explain(df, [ev.explained("x", F.lit(1), F.lit(1), F.lit("MAYBE"))], "action").collect()
    full = ev.explain(df, items, "action")
    back = ev.from_records(ev.to_records(full, ["entity"]), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in full.drop("entity").schema))
    assert back.first().asDict(True) == full.first().asDict(True)


def test_settings():
    from driftwell.functions.settings import DataSettings, WindowSettings

    assert DataSettings().frequency == "daily" and WindowSettings().annual == 252
    for bad in (lambda: DataSettings(frequency="x"), lambda: DataSettings(date_column=" "), lambda: DataSettings(minimum_observations=1), lambda: WindowSettings(short=0), lambda: WindowSettings(short=300)):
        with pytest.raises(ValueError):
            bad()
    for bad in ({"kappa": 0}, {"sigma": -1}, {"dt": 0}, {"grid_points": 4}, {"horizon": 0}, {"grid_min": 3.0}, {"long_stop": 2.5}):
        with pytest.raises(ValueError):
            StoppingConfig(**{"theta": 0.0, "kappa": 0.1, "sigma": 0.1} | bad)


def test_sample_paths(spark):
    near = passage.boundary_candidates(spark, -0.5, "LONG_RESIDUAL", [0.0], [-1.0]).withColumn("candidate", F.lit(0))
    rows = passage.sample_paths(near, theta=0.0, kappa=0.1, sigma=0.2, paths=50, samples=7, horizon=12, seed=4).collect()
    assert len(rows) == 7 * 13 and {r.x for r in rows if r.step == 0} == {-0.5}
    got = passage.simulate(0.0, 0.1, 0.2, -0.5, 0.0, -1.0, "LONG_RESIDUAL", paths=50, horizon=12, seed=4)
    ended = {p: x for p, x in enumerate(got["exit_time"][:7]) if x == x}
    by = {(r.path, r.step): r.x for r in rows}
    assert all(by[p, int(t)] >= 0 and by[p, 12] == by[p, int(t)] for p, t in ended.items())


def test_hook_on_a_stream(spark, tmp_path, prices):
    from driftwell.streaming.states import hook_stream

    src = prices.select("ticker", F.col("ts").cast("timestamp").alias("ts"), "price")
    src.where("ts < '2024-03-01'").coalesce(1).write.parquet(f"{tmp_path}/h")
    src.where("ts >= '2024-03-01'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/h")

    def hook(history, position):
        up = len(history) == 5 and history.iloc[-1] > history.mean()
        return ("ENTER_LONG" if up else "WAIT") if position == "FLAT" else ("HOLD_LONG" if up else "EXIT_LONG")

    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/h")
    got = {r.ts.date(): r.action for r in drain(hook_stream(stream, hook, history=5), "hooked", spark).collect()}
    want = {r.ts: r.action for r in folds.hook_signals(prices, hook, history=5).collect()}
    assert got == want and len(got) == 120


def test_monitor_is_gated(spark, prices):
    from driftwell.plans.monitor import decision_monitor

    r = decision_monitor(prices, window=60, trend_window=20, paths=200).first()
    assert r.action in {"NO_SIGNAL", "INSUFFICIENT_DATA", "WAIT", "ENTER_LONG", "ENTER_SHORT"} and (r.confidence is None) == (r.invalid_reason is not None)
    short = decision_monitor(prices.where("pos < 30"), window=60, trend_window=20, paths=50).first()
    assert short.action == "INSUFFICIENT_DATA" and short.confidence is None


def test_entry(spark):
    import __spark_entry__ as entry

    from driftwell.plans.catalog import ORACLES, QUERIES

    assert entry.entry(spark).columns == ["ticker", "ts", "baseline", "std", "residual", "zscore", "valid"]
    assert set(ORACLES) <= set(QUERIES) and set(QUERIES) <= set(entry.queries())
