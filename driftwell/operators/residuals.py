"""Residual models over panels. Every estimate at a row comes from the rows before it.

Functions take long panels (ticker, ts, pos, price) and work on all series at once; a long series is cut into blocks
with a halo of the rows a window reaches back to, so the work of one series spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions import reasons as why
from driftwell.sources.panels import halo

EPSILON = 1e-12


def _over(keys: list[str], lo: int, hi: int):
    return Window.partitionBy(*keys, "part").orderBy("pos").rowsBetween(lo, hi)


def _own(df: DataFrame) -> DataFrame:
    return df.where("own").drop("part", "own")


def returns(panel: DataFrame, *, log: bool = True, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Adds ``ret``: log or simple return against the row before; null where either price is missing."""
    df = halo(panel, 1, list(keys))
    before = F.lag("price").over(Window.partitionBy(*keys, "part").orderBy("pos"))
    return _own(df.withColumn("ret", F.ln(F.col("price") / before) if log else F.col("price") / before - 1))


def complete_rows(panel: DataFrame) -> DataFrame:
    """Dates on which every ticker has a price."""
    whole = panel.groupBy("ts").agg(F.count("price").alias("have"), F.count("*").alias("all")).where("have = all").select("ts")
    return panel.join(whole, "ts", "left_semi")


def rebased(panel: DataFrame) -> DataFrame:
    """Adds ``rebased``: the price over the series' first row (null if that is missing)."""
    first = panel.where("pos = 0").select("ticker", F.col("price").alias("first"))
    return panel.join(first, "ticker", "left").withColumn("rebased", F.col("price") / F.col("first")).drop("first")


def checked(panel: DataFrame) -> DataFrame:
    """The panel; a price at or below zero raises, whatever columns are asked for."""
    bad = F.raise_error(F.concat(F.col("ticker"), F.lit(f": {why.NOT_POSITIVE}"))).cast("boolean")
    return panel.where(F.when(F.col("price") <= 0, bad).otherwise(F.lit(True)))


def chronological_split(panel: DataFrame, *, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Adds ``split`` by position, never at random; each part must have rows, or reading any column raises."""
    if not (train > 0 and validation >= 0 and train + validation < 1):
        raise ValueError("train and validation must leave a share for the test")
    n = panel.agg((F.max("pos") + 1).alias("n"))
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * (train + validation))
    split = F.when(F.col("pos") < a, "train").when(F.col("pos") < b, "validation").otherwise("test")
    fine = F.when((a > 0) & (b > a) & (b < F.col("n")), F.lit(True)).otherwise(F.raise_error(F.lit("every split needs rows")).cast("boolean"))
    return panel.join(F.broadcast(n)).where(fine).withColumn("split", split).drop("n")  # n is one row


def guarded(numerator: Column, denominator: Column) -> Column:
    """A quotient that is null where the denominator is effectively zero."""
    return F.when(F.abs(denominator) > EPSILON, numerator / denominator)


def prior_zscore(df: DataFrame, value: str, window: int, *, keys: tuple[str, ...] = ("ticker",), prefix: str = "") -> DataFrame:
    """Adds baseline, std, residual and zscore against the ``window`` rows before, all of which must have a value."""
    if window < 2:
        raise ValueError("window must be at least 2")
    w = _over(list(keys), -window, -1)
    x, full = F.col(value), F.count(value).over(w) == window
    df = halo(df, window, list(keys))
    df = df.withColumn(f"{prefix}baseline", F.when(full, F.avg(value).over(w))).withColumn(f"{prefix}std", F.when(full, F.stddev_samp(value).over(w)))
    df = df.withColumn(f"{prefix}residual", x - F.col(f"{prefix}baseline"))
    return _own(df.withColumn(f"{prefix}zscore", guarded(F.col(f"{prefix}residual"), F.col(f"{prefix}std"))))


def zscore_benchmark(panel: DataFrame, window: int = 60) -> DataFrame:
    """Log price against its prior mean and sample deviation; valid where a z-score exists."""
    return prior_zscore(checked(panel).withColumn("log_price", F.ln("price")), "log_price", window).withColumn("valid", F.col("zscore").isNotNull())


def r_squared(y: str, x: str, w) -> Column:
    """1 where there is nothing to explain and nothing unexplained, null where only the former."""
    syy, r2 = F.regr_syy(y, x).over(w), F.regr_r2(y, x).over(w)
    return F.when((syy <= 1e-8) & (syy * (1 - F.coalesce(r2, F.lit(1.0))) <= 1e-8), F.lit(1.0)).when(syy > 0, r2)


def trend_residual(panel: DataFrame, window: int = 126, zscore_window: int | None = None) -> DataFrame:
    """Log price against the line through the ``window`` rows before, and the prior z-score of that residual."""
    w = _over(["ticker"], -window, -1)
    df = halo(checked(panel).withColumn("log_price", F.ln("price")).withColumn("x", F.col("pos").cast("double")), window, ["ticker"])
    full = (F.count("log_price").over(w) == window) & F.col("log_price").isNotNull()
    slope, intercept = F.regr_slope("log_price", "x").over(w), F.regr_intercept("log_price", "x").over(w)
    df = df.withColumn("slope", F.when(full, slope)).withColumn("line", F.when(full, intercept)).withColumn("r_squared", F.when(full, r_squared("log_price", "x", w)))
    df = df.withColumn("expected", F.col("line") + F.col("slope") * F.col("x")).withColumn("intercept", F.col("line") + F.col("slope") * (F.col("x") - window))
    df = _own(df.withColumn("trend_residual", F.col("log_price") - F.col("expected")).withColumn("implied_price", F.exp("expected")))
    return prior_zscore(df, "trend_residual", zscore_window or window, prefix="z_").withColumnRenamed("z_zscore", "zscore").drop("x", "line", "z_baseline", "z_std", "z_residual")


def factor_frame(panel: DataFrame, market: str, sector: str | None = None) -> DataFrame:
    """Log returns y of every other ticker beside those of the market (x) and the sector (s) on the same date."""
    names = [t for t in (market, sector) if t is not None]
    if len(set(names)) != len(names):
        raise ValueError("market and sector must be distinct")
    there = {r["ticker"] for r in panel.where(F.col("ticker").isin(names)).select("ticker").distinct().collect()}  # two at most
    if there != set(names):
        raise ValueError(f"{why.UNKNOWN}: {', '.join(sorted(set(names) - there))}")
    r = returns(checked(panel))
    of = lambda name, alias: r.where(F.col("ticker") == name).select("pos", F.col("ret").alias(alias))
    df = r.where(~F.col("ticker").isin([t for t in (market, sector) if t])).withColumnRenamed("ret", "y").join(of(market, "x"), "pos", "left")
    return df.join(of(sector, "s"), "pos", "left") if sector else df


def factor_residual(panel: DataFrame, *, market: str, sector: str | None = None, window: int = 126, zscore_window: int | None = None, state_window: int = 20) -> DataFrame:
    """Log return against a prior-window regression on one or two factor returns, its z-score and running state.

    The two-factor coefficients solve the normal equations of the window's covariances; a singular window gives null.
    """
    df = halo(factor_frame(panel, market, sector), window, ["ticker"])
    w = _over(["ticker"], -window, -1)
    complete = F.col("y").isNotNull() & F.col("x").isNotNull() & (F.col("s").isNotNull() if sector else F.lit(True))
    df = df.withColumn("ok", F.when(complete, 1))
    full = (F.count("ok").over(w) == window) & complete
    if sector:
        c = lambda a, b: F.covar_samp(a, b).over(w)
        for name, col in {"xx": c("x", "x"), "ss": c("s", "s"), "xs": c("x", "s"), "xy": c("x", "y"), "sy": c("s", "y"), "yy": c("y", "y"), "mx": F.avg("x").over(w), "ms": F.avg("s").over(w), "my": F.avg("y").over(w)}.items():
            df = df.withColumn(name, F.when(full, col))
        det = F.col("xx") * F.col("ss") - F.col("xs") * F.col("xs")
        fine = det > 1e-12 * F.col("xx") * F.col("ss")
        df = df.withColumn("beta", F.when(fine, (F.col("xy") * F.col("ss") - F.col("sy") * F.col("xs")) / det)).withColumn("beta_sector", F.when(fine, (F.col("sy") * F.col("xx") - F.col("xy") * F.col("xs")) / det))
        df = df.withColumn("alpha", F.col("my") - F.col("beta") * F.col("mx") - F.col("beta_sector") * F.col("ms"))
        df = df.withColumn("r_squared", F.when(F.col("yy") > 0, (F.col("beta") * F.col("xy") + F.col("beta_sector") * F.col("sy")) / F.col("yy")))
        df = df.withColumn("expected", F.col("alpha") + F.col("beta") * F.col("x") + F.col("beta_sector") * F.col("s")).drop("xx", "ss", "xs", "xy", "sy", "yy", "mx", "ms", "my")
    else:
        df = df.withColumn("beta", F.when(full, F.regr_slope("y", "x").over(w))).withColumn("alpha", F.when(full, F.regr_intercept("y", "x").over(w)))
        df = df.withColumn("r_squared", F.when(full, r_squared("y", "x", w))).withColumn("expected", F.col("alpha") + F.col("beta") * F.col("x"))
    df = _own(df.withColumn("factor_residual", F.col("y") - F.col("expected"))).drop("ok")
    df = prior_zscore(df, "factor_residual", zscore_window or window, prefix="z_").withColumnRenamed("z_zscore", "zscore").drop("z_baseline", "z_std", "z_residual")
    return accumulated(df, "factor_residual", state_window)


def accumulated(df: DataFrame, value: str, window: int = 20, *, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Adds ``state``: the sum of the last ``window`` values, this row's included, all of which must exist."""
    w = _over(list(keys), -(window - 1), 0)
    df = halo(df, window, list(keys))
    return _own(df.withColumn("state", F.when(F.count(value).over(w) == window, F.sum(value).over(w))))


def pair_frame(panel: DataFrame, pairs: DataFrame | None = None, *, strict: bool = True) -> DataFrame:
    """(target, peer, ts, pos, t, p, rt, rp) of the given pairs (target, peer), or of all ordered pairs of tickers.

    Prices at or below zero raise; with ``strict`` off they are missing. A regression of A on B is not that of B on
    A, so both orders are made; a list of pairs keeps the work to what is wanted.
    """
    r = returns(checked(panel) if strict else panel.withColumn("price", F.when(F.col("price") > 0, F.col("price")))).withColumn("log_price", F.ln("price"))
    left = r.select(F.col("ticker").alias("target"), "ts", "pos", F.col("log_price").alias("t"), F.col("ret").alias("rt"))
    right = r.select(F.col("ticker").alias("peer"), "pos", F.col("log_price").alias("p"), F.col("ret").alias("rp"))
    if pairs is None:
        return left.join(right, "pos").where("target <> peer")
    return left.join(pairs.where("target <> peer").distinct(), "target").join(right, ["peer", "pos"])  # Spark broadcasts the list if it is small


def pair_spread(panel: DataFrame, *, window: int = 252, threshold: float = 2.0, pairs: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Each target's log price against its peer's, by the prior window's regression; without the cointegration test.

    ``valid`` asks for a full window and a spread deviation above zero; ``state`` places the z-score.
    """
    if window < 20 or threshold <= 0:
        raise ValueError("window must be at least 20 and the threshold positive")
    keys = ["target", "peer"]
    df = halo(pair_frame(panel, pairs, strict=strict), window, keys)
    w, back = _over(keys, -window, -1), _over(keys, -(window - 1), -1)
    complete = F.col("t").isNotNull() & F.col("p").isNotNull()
    df = df.withColumn("ok", F.when(complete, 1))
    enough, full = F.col("pos") >= window, F.count("ok").over(w) == window
    fit = enough & full & complete
    r2 = r_squared("t", "p", w)
    df = df.withColumn("alpha", F.when(fit, F.regr_intercept("t", "p").over(w))).withColumn("beta", F.when(fit, F.regr_slope("t", "p").over(w))).withColumn("r_squared", F.when(fit, r2))
    df = df.withColumn("spread_std", F.when(fit, F.sqrt(F.greatest(F.regr_syy("t", "p").over(w) * (1 - F.regr_r2("t", "p").over(w)), F.lit(0.0)) / (window - 1))))
    df = df.withColumn("return_correlation", F.when(fit, F.corr("rt", "rp").over(back))).withColumn("spread", F.col("t") - F.col("alpha") - F.col("beta") * F.col("p"))
    df = df.withColumn("zscore", guarded(F.col("spread"), F.col("spread_std"))).withColumn("valid", F.col("zscore").isNotNull())
    reason = F.when(~enough, why.PAIR_SHORT).when(~(full & complete), why.PAIR_MISSING)
    df = df.withColumn("invalid_reason", reason.when(~F.col("valid"), why.PAIR_FLAT).otherwise(""))
    return _own(df.withColumn("state", pair_state(F.col("zscore"), threshold))).drop("ok", "rt", "rp")


def pair_state(z: Column, threshold: float = 2.0) -> Column:
    return F.when(z.isNull(), "INVALID").when(z >= threshold, "TARGET_RELATIVELY_HIGH").when(z <= -threshold, "TARGET_RELATIVELY_LOW").otherwise("NEUTRAL")


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of every series, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "pos").alias("r"))
    return top.select(*keys, *(F.col("r")[c].alias(c) for c in rest))


def peer_ranking(panel: DataFrame, *, target: str, peers: list[str] | None = None, as_of=None, window: int = 252, threshold: float = 2.0, cointegration: bool = True) -> DataFrame:
    """Peers of a target as of a date: valid ones first, by p-value, then name; only valid ones are ranked.

    Every peer asked for has a row: an unknown one, or one that meets the target at a price at or below zero, is an
    invalid row with its reason. Peers asked for twice count once; the target itself is passed over.
    """
    from driftwell.operators.stationarity import engle_granger_last

    spark = panel.sparkSession
    panel = panel if as_of is None else panel.where(F.col("ts") <= F.lit(as_of))
    names = panel.select(F.col("ticker").alias("peer")).distinct()
    if peers is not None:
        names = spark.createDataFrame([(p,) for p in dict.fromkeys(peers)], "peer string")
    pairs = names.where(F.col("peer") != target).select(F.lit(target).alias("target"), "peer")
    df = pair_spread(panel, window=window, threshold=threshold, pairs=pairs, strict=False)
    counts = df.groupBy("target", "peer").agg(F.sum(F.col("valid").cast("long")).alias("valid_observation_count"))
    own = panel.where((F.col("ticker") == target) & F.col("price").isNotNull()).select("pos", F.col("price").alias("own"))
    low = panel.where("price is not null").join(own, "pos").groupBy(F.col("ticker").alias("peer")).agg((F.min(F.least("price", "own")) <= 0).alias("low"))
    table = pairs.join(latest(df, ["target", "peer"]), ["target", "peer"], "left").join(counts, ["target", "peer"], "left").join(low, "peer", "left")
    if cointegration:
        table = table.join(engle_granger_last(pair_frame(panel, pairs, strict=False), window), ["target", "peer"], "left")
    else:
        table = table.withColumn("cointegration_statistic", F.lit(None).cast("double")).withColumn("cointegration_pvalue", F.lit(None).cast("double"))
    error = F.when(F.col("state").isNull(), F.concat(F.lit(f"{why.UNKNOWN}: "), F.col("peer"))).when(F.col("low"), F.lit(why.NOT_POSITIVE))
    bad = error.isNotNull()
    good = ~bad & F.col("valid") & (F.col("cointegration_pvalue").isNotNull() if cointegration else F.lit(True))
    numbers = {"cointegration_pvalue": "cointegration_pvalue", "cointegration_statistic": "cointegration_statistic", "spread_std": "spread_volatility", "zscore": "spread_zscore", "r_squared": "r_squared", "return_correlation": "return_correlation"}
    table = table.select(
        "target", "peer", F.coalesce(good, F.lit(False)).alias("valid"), F.coalesce(error, "invalid_reason").alias("invalid_reason"), *(F.when(~bad, F.col(c)).alias(name) for c, name in numbers.items()),
        F.when(bad, 0).otherwise(F.col("valid_observation_count")).cast("long").alias("valid_observation_count"), F.when(bad, "INVALID").otherwise(F.col("state")).alias("relative_state"),
    )
    order = Window.partitionBy("target").orderBy(F.desc("valid"), F.asc_nulls_last("cointegration_pvalue"), F.asc("peer"))
    return table.withColumn("place", F.row_number().over(order)).withColumn("research_rank", F.when(F.col("valid"), F.col("place"))).drop("place")


def cross_sectional(panel: DataFrame, value: str = "ret", *, minimum: int = 3, threshold: float = 2.0) -> DataFrame:
    """Rank (ties averaged), percentile and z-score of each value among its date's, where ``minimum`` exist."""
    day = Window.partitionBy("ts")
    df = panel.where(F.col(value).isNotNull()).withColumn("n", F.count("*").over(day)).withColumn("mean", F.avg(value).over(day)).withColumn("std", F.stddev_samp(value).over(day))
    rank = F.rank().over(day.orderBy(value)) + (F.count("*").over(Window.partitionBy("ts", value)) - 1) / 2
    df = df.withColumn("rank", rank).where(F.col("n") >= minimum).withColumn("percentile", F.col("rank") / F.col("n")).withColumn("zscore", guarded(F.col(value) - F.col("mean"), F.col("std")))
    z = F.col("zscore")
    return df.withColumn("state", F.when(z.isNull(), "INVALID").when(z >= threshold, "RELATIVELY_HIGH").when(z <= -threshold, "RELATIVELY_LOW").otherwise("NEUTRAL"))


def pair_position(beta: Column, side: Column) -> Column:
    """Units of target and peer of a residual position: +1 and -beta long, -1 and beta short, none flat."""
    sign = F.when(side == "LONG_RESIDUAL", 1.0).when(side == "SHORT_RESIDUAL", -1.0).otherwise(0.0)
    return F.struct(sign.alias("target_units"), (-beta * sign).alias("peer_units"))


STATE_SOURCES = {"trend": "trend_residual", "factor": "state", "pair": "spread"}


def state_series(model: DataFrame, source: str, keys: list[str]) -> DataFrame:
    """(keys, ts, pos, x): a model's state for Ornstein-Uhlenbeck fits, rows without a value left out and positions closed up."""
    column = STATE_SOURCES[source]
    df = model.where(F.col(column).isNotNull())
    return df.select(*keys, "ts", (F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1).cast("long").alias("pos"), F.col(column).alias("x"))


def tail_window(df: DataFrame, window: int, keys: list[str]) -> DataFrame:
    """The last ``window`` positions of every series."""
    end = df.groupBy(*keys).agg(F.max("pos").alias("_end"))
    return df.join(end, keys).where(F.col("pos") > F.col("_end") - window).drop("_end")
