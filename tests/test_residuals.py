"""Residual models: closed forms, recovery of parameters, and no lookahead."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftwell.operators import ou, pca, quality, stationarity
from driftwell.operators import residuals as rs
from driftwell.operators.folds import KalmanNoise, kalman_pairs
from driftwell.sources import panels as pn
from driftwell.sources.files import CsvSource, SeriesMapping, detect_format, load_vendor_csv, read_text_csv, repeated_pairs_panel, write_wide_csv

DAYS = pd.date_range("2024-01-01", periods=600)


def panel(spark, **series):
    n = len(next(iter(series.values())))
    wide = pd.DataFrame({"Date": DAYS[:n].date, **{k: pd.Series(np.asarray(v, float)) for k, v in series.items()}})
    rows = [(k, d, float(x) if np.isfinite(x) else None) for k in series for d, x in zip(wide.Date, wide[k])]
    return pn.densify(spark.createDataFrame(rows, "ticker string, ts date, price double"))


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_zscore_of_a_step(spark):
    got = rows(rs.zscore_benchmark(panel(spark, A=np.exp([0, 1, 2, 5])), 3), "pos")
    assert got[(3,)].zscore == pytest.approx(4) and got[(3,)].baseline == pytest.approx(1) and got[(3,)].std == pytest.approx(1) and not got[(2,)].valid
    assert all(r.zscore is None for r in rs.zscore_benchmark(panel(spark, A=[100.0] * 6), 3).collect())


def test_trend_is_exact_and_sees_a_shock(spark):
    x = 2 + 0.01 * np.arange(20)
    got = rows(rs.trend_residual(panel(spark, A=np.exp(x)), 8), "pos")
    assert got[(12,)].trend_residual == pytest.approx(0, abs=1e-12) and got[(12,)].slope == pytest.approx(0.01) and got[(12,)].r_squared == pytest.approx(1) and got[(7,)].expected is None
    x[19] += 0.2
    assert rows(rs.trend_residual(panel(spark, A=np.exp(x)), 8), "pos")[(19,)].trend_residual == pytest.approx(0.2)


def test_long_series_are_cut_into_blocks_without_a_trace(spark, monkeypatch):
    r = np.random.default_rng(0)
    p = panel(spark, A=np.exp(np.cumsum(r.normal(0, 0.01, 300))), B=np.exp(r.normal(0, 0.1, 300)))
    whole = rows(rs.trend_residual(p, 10), "ticker", "pos")
    halo = pn.halo
    monkeypatch.setattr(rs, "halo", lambda df, back, keys, block=64: halo(df, back, keys, block))
    cut = rows(rs.trend_residual(p, 10), "ticker", "pos")
    assert whole.keys() == cut.keys() and all((whole[k].zscore or 0) == pytest.approx(cut[k].zscore or 0, abs=1e-9) for k in whole)


@pytest.fixture(scope="module")
def factor_panel(spark):
    r = np.random.default_rng(31)
    m, s = r.uniform(-0.02, 0.02, (2, 90))  # target returns are an exact mix of both
    return panel(spark, T=40 * np.exp(np.cumsum(0.002 + 0.7 * m - 0.4 * s)), M=75 * np.exp(np.cumsum(m)), S=20 * np.exp(np.cumsum(s)))


def test_factors_are_recovered(factor_panel):
    got = rows(rs.factor_residual(factor_panel, market="M", sector="S", window=20), "pos")[(60,)]
    assert (got.alpha, got.beta, got.beta_sector) == pytest.approx((0.002, 0.7, -0.4), abs=1e-9) and got.r_squared == pytest.approx(1)
    one = rows(rs.factor_residual(factor_panel.where("ticker <> 'S'"), market="M", window=20), "pos")
    assert one[(20,)].beta is None and one[(21,)].beta is not None


@pytest.fixture(scope="module")
def pair(spark):
    r = np.random.default_rng(12)
    peer, gap = 3 + np.cumsum(r.standard_t(6, 360) * 0.008), [0.0]
    for shock in r.uniform(-0.008, 0.008, 359):
        gap.append(gap[-1] / 2 + shock)
    return panel(spark, A=np.exp(0.2 + 1.3 * peer + np.array(gap)), B=np.exp(peer))


def test_pairs(pair):
    got = rows(rs.pair_spread(pair, window=252), "target", "pos")
    last = got["A", 359]
    assert last.beta == pytest.approx(1.3, abs=0.12) and last.valid and got["A", 251].invalid_reason.startswith("Insufficient")
    rank = rs.peer_ranking(pair, target="A", peers=["B", "B", "A"], window=252).collect()
    assert [(r.peer, r.research_rank) for r in rank] == [("B", 1)] and rank[0].cointegration_pvalue < 0.05
    kalman = rows(kalman_pairs(rs.pair_frame(pair), KalmanNoise()), "target", "pos")
    assert kalman["A", 359].valid and np.isfinite(kalman["A", 359].beta)
    assert rs.peer_ranking(pair, target="A", peers=[], window=252).count() == 0


def test_walks_are_not_cointegrated():
    r = np.random.default_rng(23)
    found = [stationarity.engle_granger(*np.cumsum(r.choice([-1.0, 1.0], (2, 300)), axis=1))[1] for _ in range(20)]
    assert np.median(found) > 0.1 and sum(p < 0.05 for p in found) <= 4
    assert [round(stationarity.surface_p(s, 1), 3) for s in (-3.43, -2.86, -2.57)] == [0.01, 0.05, 0.099]
    noise = np.random.default_rng(0).normal(size=400)
    assert stationarity.adf(noise)[1] < 0.01 and stationarity.kpss(noise)[1] == pytest.approx(0.1)
    assert stationarity.adf(np.cumsum(noise))[1] > 0.05 and stationarity.kpss(np.cumsum(noise))[1] < 0.05


@pytest.mark.parametrize(
    "model", [lambda p: rs.zscore_benchmark(p, 20), lambda p: rs.trend_residual(p, 20), lambda p: rs.pair_spread(p, window=30), lambda p: kalman_pairs(rs.pair_frame(p)), lambda p: pca.rolling_pca(p, window=30), lambda p: ou.rolling_ou(p.withColumn("x", F.ln("price")), "x", keys=["ticker"], window=30)]
)
def test_no_lookahead(model, pair):
    early = pair.where("pos < 140")
    changed = early.withColumn("price", F.when(F.col("pos") > 100, F.col("price") * 3).otherwise(F.col("price")))
    pick = lambda df: sorted(str(r) for r in model(df).where("pos <= 100").collect())
    assert pick(early) == pick(changed)


def test_cross_section(spark):
    p = panel(spark, A=[1, 1], B=[1, 2], C=[1, 2], D=[1, 5])
    got = rows(rs.cross_sectional(p.where("pos = 1"), "price"), "ticker")
    assert [got[(t,)].rank for t in "ABCD"] == [1, 2.5, 2.5, 4] and got[("D",)].percentile == 1
    assert rs.cross_sectional(p.where("pos = 1 and ticker < 'C'"), "price").count() == 0


def test_pca(spark):
    r = np.random.default_rng(64)
    shared = r.uniform(-0.02, 0.02, 180)
    p = panel(spark, **{f"S{i}": (10 + i) * np.exp(np.cumsum(load * shared + r.uniform(-0.004, 0.004, 180))) for i, load in enumerate((1.5, 0.9, 1.1, 0.7, 1.3))})
    assert pca.latest_loadings(p, window=60).first().explained > 0.8
    got = rows(pca.rolling_pca(p, window=60, block=50), "ticker", "pos")
    assert got["S0", 61].valid and not got["S0", 60].valid and len(got) == 5 * 179
    gap = p.withColumn("price", F.when((F.col("ticker") == "S1") & (F.col("pos") == 100), None).otherwise(F.col("price")))
    assert rows(pca.rolling_pca(gap, window=60), "ticker", "pos")["S0", 120].invalid_reason.startswith("Missing")


def test_ou(spark):
    path = ou.simulate_ou(spark, theta=-0.3, kappa=0.11, sigma=0.2, n=3000, x0=0.4, seed=17).withColumn("k", F.lit(1))
    fit = ou.fit_ou(path, "value", keys=["k"]).first()
    assert fit.theta == pytest.approx(-0.3, abs=0.12) and fit.kappa == pytest.approx(0.11, rel=0.18) and fit.sigma == pytest.approx(0.2, rel=0.1) and fit.valid
    x = np.array([r.value for r in path.orderBy("pos").collect()])
    b = np.polyfit(x[:-1], x[1:], 1)
    e = x[1:] - np.polyval(b, x[:-1])
    assert fit.kappa == pytest.approx(-np.log(b[0])) and fit.log_likelihood == pytest.approx(-0.5 * (2999 * np.log(2 * np.pi * np.mean(e**2)) + 2999))
    short = ou.fit_ou(path.where("pos < 10"), "value", keys=["k"]).first()
    assert not short.valid and short.theta is None and short.invalid_reason.startswith("At least 20")
    flat = ou.fit_ou(path.withColumn("value", F.lit(1.0)), "value", keys=["k"]).first()
    assert flat.invalid_reason.startswith("Input variance")
    band = ou.forecast(ou.fit_ou(path, "value", keys=["k"]).withColumn("x", F.lit(1.0)), "x", [0.0, 10.0]).orderBy("horizon").collect()
    assert band[0].mean == pytest.approx(1) and band[0].deviation == 0 and band[1].lower < band[1].mean < band[1].upper


def test_hedge_ratio(spark):
    r = np.random.default_rng(29)
    p, s = 2 + np.cumsum(r.uniform(-0.04, 0.04, 420)), [0.0]
    for shock in r.uniform(-0.015, 0.015, 419):
        s.append(0.85 * s[-1] + shock)
    best = ou.hedge_ratio_grid(rs.pair_frame(panel(spark, A=np.exp(0.6 * p + np.array(s)), B=np.exp(p))))[1].where("target = 'A'").first()
    assert best.optimal_beta == pytest.approx(0.6, abs=0.11)
    assert ou.hedge_ratio_grid(rs.pair_frame(panel(spark, A=[1, 2.0], B=[2, 3.0])))[1].first().invalid_reason == "Insufficient historical observations."


def test_files(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("Date,AAA,BBB\n2025-01-03,110,\n2025-01-02,100,50\n")
    p = CsvSource(spark).load(str(path))
    assert [(r.ticker, r.pos, r.price) for r in p.orderBy("ticker", "pos").collect()] == [("AAA", 0, 100), ("AAA", 1, 110), ("BBB", 0, 50), ("BBB", 1, None)]
    s = quality.price_summary(p).first()
    assert s.missing_by_ticker == {"AAA": 0, "BBB": 1} and s.complete_row_count == 1
    assert detect_format(read_text_csv(spark, str(path))) == "wide"
    write_wide_csv(p, str(tmp_path / "out"), ["AAA", "BBB"])
    assert CsvSource(spark).load(str(tmp_path / "out")).count() == 4
    for text in ("Date,AAA\n2025-01-02,not-a-number\n2025-01-03,1\n", "Date,AAA\n2025-01-02,0\n2025-01-03,1\n", "Date,AAA\n2025-01-02,1\n2025-01-02,2\n", "Date,AAA\n2025-01-02,1\n", "Date\n2025-01-02\n", "AAA\n1\n"):
        path.write_text(text)
        with pytest.raises(Exception):  # noqa: B017
            CsvSource(spark).load(str(path)).collect()
    path.write_text("XLE Date,XLE PX,XOM Date,XOM PX\n2025-01-02,1,2025-01-03,5\n2025-01-03,2,2025-01-06,x\n")
    two = [SeriesMapping("XLE", "XLE Date", "XLE PX"), SeriesMapping("XOM", "XOM Date", "XOM PX")]
    got = repeated_pairs_panel(read_text_csv(spark, str(path)), two)
    assert sorted((r.ticker, r.pos, r.price or 0) for r in got.collect()) == [("XLE", 0, 1), ("XLE", 1, 2), ("XLE", 2, 0), ("XOM", 0, 0), ("XOM", 1, 5), ("XOM", 2, 0)]
    with pytest.raises(ValueError):
        load_vendor_csv(spark, str(path))


def test_quality(spark):
    rows_ = [("A", DAYS[i].date(), i, x) for i, x in enumerate([100.0, 0.0, None, 150.0])] + [("B", DAYS[3 - i].date(), i, 1.0) for i in range(4)]
    got = rows(quality.quality_by_ticker(spark.createDataFrame(rows_, "ticker string, ts date, pos long, price double")), "ticker")
    assert (got[("A",)].missing, got[("A",)].nonpositive, got[("A",)].large_jumps, got[("A",)].unsorted_dates) == (1, 1, 2, False) and got[("B",)].unsorted_dates
    status = {r.model: r.status for r in quality.model_readiness(panel(spark, A=np.ones(20), B=np.ones(20))).collect()}
    assert status["OU"] == "sufficient" and status["Pair 252-day model"] == "insufficient"


def test_split(spark):
    got = rs.chronological_split(panel(spark, A=np.ones(10))).orderBy("pos").collect()
    assert [r.split for r in got] == ["train"] * 6 + ["validation"] * 2 + ["test"] * 2
    assert [r.split for r in rs.chronological_split(panel(spark, A=np.ones(3))).orderBy("pos").collect()] == ["train", "validation", "test"]
    for read in (lambda d: d.collect(), lambda d: d.count(), lambda d: d.select("ticker").collect()):
        with pytest.raises(Exception, match="every split needs rows"):
            read(rs.chronological_split(panel(spark, A=np.ones(2))))
    for train, validation in ((0.6, 0.4), (0, 0.2), (0.5, -0.1), (1.2, 0.1)):
        with pytest.raises(ValueError):
            rs.chronological_split(panel(spark, A=np.ones(10)), train=train, validation=validation)


def test_peers_that_cannot_be_judged_have_a_row_with_the_reason(spark, pair):
    known = {r.peer: r for r in rs.peer_ranking(pair, target="A", peers=["B", "ZZ", "A"], window=252, cointegration=False).collect()}
    assert known["B"].valid and known["B"].research_rank == 1 and set(known) == {"B", "ZZ"}
    assert not known["ZZ"].valid and known["ZZ"].invalid_reason.startswith("missing ticker") and known["ZZ"].relative_state == "INVALID" and known["ZZ"].valid_observation_count == 0 and known["ZZ"].research_rank is None
    low = pair.withColumn("price", F.when((F.col("ticker") == "B") & (F.col("pos") == 3), -1.0).otherwise(F.col("price")))
    got = rs.peer_ranking(low, target="A", peers=["B"], window=252, cointegration=False).first()
    assert not got.valid and got.invalid_reason == "prices must be strictly positive" and got.spread_zscore is None
    assert [r.valid for r in rs.peer_ranking(pair, target="ZZ", peers=["A"], window=252, cointegration=False).collect()] == [False]


def test_models_refuse_prices_that_are_not_positive(spark, pair):
    low = pair.withColumn("price", F.when((F.col("ticker") == "B") & (F.col("pos") == 3), 0.0).otherwise(F.col("price")))
    for model in (lambda: rs.zscore_benchmark(low, 20), lambda: rs.trend_residual(low, 20), lambda: rs.pair_spread(low, window=30), lambda: kalman_pairs(rs.pair_frame(low)), lambda: pca.rolling_pca(low, window=30), lambda: rs.factor_residual(low, market="B", window=20)):
        with pytest.raises(Exception, match="strictly positive"):
            model().collect()
    with pytest.raises(ValueError):
        rs.factor_residual(pair, market="B", sector="B", window=20)
    with pytest.raises(ValueError, match="missing ticker"):
        rs.factor_residual(pair, market="ZZ", window=20)


def test_likelihood_where_the_autoregression_is_not_valid(spark):
    r = np.random.default_rng(90)
    x = np.cumsum(r.normal(0.05, 0.1, 200)) * np.linspace(1, 2, 200)  # b above 1
    rows_ = [("up", i, float(v)) for i, v in enumerate(x)] + [("down", i, float((-1) ** i + r.normal(0, 0.3))) for i in range(200)]
    df = spark.createDataFrame(rows_, "k string, pos long, v double")
    ar1, mle = (rows(ou.fit_ou(df, "v", keys=["k"], method=m), "k") for m in ("AR1", "MLE"))
    for k, b in (("up", np.exp(-1e-8)), ("down", np.exp(-100.0))):
        v = np.array([x for q, _, x in rows_ if q == k])
        assert not ar1[(k,)].valid and mle[(k,)].valid
        a = np.mean(v[1:]) - b * np.mean(v[:-1])
        sse = np.sum((v[1:] - a - b * v[:-1]) ** 2)
        assert mle[(k,)].log_likelihood == pytest.approx(-0.5 * (199 * np.log(2 * np.pi * sse / 199) + 199), rel=1e-6)
    both = rows(ou.compare_estimators(ou.fit_ou(df, "v", keys=["k"]), ["k"], ou.fit_ou(df, "v", keys=["k"], method="MLE")), "k", "method")
    assert not both["up", "AR1"].valid and both["up", "MLE"].valid
    roll = ou.rolling_ou(df.where("k = 'down'"), "v", keys=["k"], window=60, method="MLE")
    assert roll.count() == 141 and roll.where("valid").count() == 141
    with pytest.raises(ValueError):
        ou.fit_ou(df, "v", keys=["k"], method="x")


def test_two_series_have_principal_components_in_closed_form(spark):
    r = np.random.default_rng(77)
    x = np.cumsum(r.normal(0, 0.01, (120, 2)) @ np.array([[1, 0.6], [0, 0.8]]), axis=0)
    got = rows(pca.rolling_pca(panel(spark, A=np.exp(x[:, 0]), B=np.exp(x[:, 1])), window=40), "ticker", "pos")
    d = np.diff(x, axis=0)  # the first component of two standardised series is their sum or difference
    for pos in (41, 77, 119):
        past, now = d[pos - 41 : pos - 1], d[pos - 1]
        z, s = (now - past.mean(0)) / past.std(0), np.sign(np.corrcoef(past.T)[0, 1])
        assert got["A", pos].reconstructed == pytest.approx((z[0] + s * z[1]) / 2 * past.std(0)[0] + past.mean(0)[0])
    share = rows(pca.explained_variance(panel(spark, A=np.exp(x[:, 0]), B=np.exp(x[:, 1])), window=40, components=2), "pos", "component")
    assert share[41, 1].explained == pytest.approx((1 + abs(np.corrcoef(d[:40].T)[0, 1])) / 2) and share[41, 2].cumulative == pytest.approx(1) and len(share) == 2 * 79
