"""Descriptions of panels: summary, quality flags and readiness of models. Flags never change data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def price_summary(panel: DataFrame) -> DataFrame:
    """One row: dates, tickers, missing cells by ticker, complete rows."""
    by_day = panel.groupBy("ts").agg(F.count("price").alias("have"), F.count("*").alias("all"))
    days = by_day.agg(F.min("ts").alias("start_date"), F.max("ts").alias("end_date"), F.count("*").alias("observation_count"), F.count_if(F.col("have") == F.col("all")).alias("complete_row_count"))
    missing = panel.groupBy("ticker").agg(F.count_if(F.col("price").isNull()).alias("missing"))
    names = missing.agg(F.count("*").alias("ticker_count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("ticker", "missing")))).alias("missing_by_ticker"))
    return days.join(F.broadcast(names))


def quality_by_ticker(rows: DataFrame, *, jump: float = 0.25) -> DataFrame:
    """Per ticker: coverage, missing, non-positive and repeated dates, and moves above ``jump``.

    rows: ticker, ts, price and pos (the order of input, which need not be that of dates). A move is taken against
    the last known price, across missing cells.
    """
    w = Window.partitionBy("ticker").orderBy("pos")
    filled = F.last("price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last("price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = rows.withColumn("_move", F.abs(F.when(before != 0, filled / before - 1))).withColumn("_inf", (before == 0) & (filled != 0))
    df = df.withColumn("_late", F.lag("ts").over(w) > F.col("ts"))
    known = F.when(F.col("price").isNotNull(), F.col("ts"))
    return df.groupBy("ticker").agg(
        F.count("*").alias("observation_count"), F.count_if(F.col("price").isNull()).alias("missing"), F.count_if(F.col("price") <= 0).alias("nonpositive"), (F.count("*") - F.countDistinct("ts")).alias("duplicate_dates"),
        F.coalesce(F.bool_or("_late"), F.lit(False)).alias("unsorted_dates"), F.min(known).alias("first_valid"), F.max(known).alias("last_valid"), F.count_if((F.col("_move") > jump) | F.coalesce(F.col("_inf"), F.lit(False))).alias("large_jumps"), (F.count("*") / 252).alias("approximate_years"),
    )


# The models by the names in reports.
MODELS = {"zscore": "Basic benchmark", "trend": "Trend model", "factor": "Factor model", "pair": "Pair {pair}-day model", "pca": "PCA", "ou": "OU", "walk": "Walk-forward"}


def model_needs(*, benchmark: int = 60, regression: int = 126, pair: int = 252, pca_tickers: int = 3, ou: int = 20, forward: int = 20) -> dict[str, tuple[int, int, int]]:
    """For each model: the dates, the tickers and the complete rows it needs. A window's model needs the row after it too."""
    return {
        "zscore": (benchmark + 1, 0, 0), "trend": (regression + 1, 0, 0), "factor": (0, 2, regression + 1), "pair": (0, 2, pair + 1),
        "pca": (0, pca_tickers, regression + 1), "ou": (ou, 0, 0), "walk": (max(pair, benchmark) + forward + 1, 0, 0),
    }


def model_readiness(panel: DataFrame, **windows: int) -> DataFrame:
    """(model, status, reason) of seven models by counts of dates, tickers and complete rows; the reason names what is needed."""
    by_day = panel.groupBy("ts").agg(F.count("price").alias("have"), F.count("*").alias("all"))
    c = by_day.agg(F.count("*").alias("dates"), F.coalesce(F.max("all"), F.lit(0)).alias("tickers"), F.count_if(F.col("have") == F.col("all")).alias("complete rows"))
    rows = []
    for key, needs in model_needs(**windows).items():
        parts = [(n, what) for n, what in zip(needs, ("dates", "tickers", "complete rows"), strict=True) if n]
        ok = F.lit(True)
        for n, what in parts:
            ok = ok & (F.col(what) >= n)
        reason = "needs " + " and ".join(f"{n} {what}" for n, what in parts)
        rows.append(F.struct(F.lit(MODELS[key].format(pair=windows.get("pair", 252))).alias("model"), F.when(ok, "sufficient").otherwise("insufficient").alias("status"), F.lit(reason).alias("reason")))
    return c.select(F.inline(F.array(*rows)))


def violations(panel: DataFrame) -> DataFrame:
    """One row of counts that a valid panel has at zero. Positivity is asked of complete rows only."""
    by_day = panel.groupBy("ts").agg(F.count("price").alias("have"), F.count("*").alias("all"), F.min("price").alias("low"), (F.count("*") - F.countDistinct("ticker")).alias("twice"))
    return by_day.agg(
        (F.count("*") == 0).cast("long").alias("empty"), F.coalesce(F.sum("twice"), F.lit(0)).alias("duplicate_cells"), F.count_if(F.col("ts").isNull()).alias("missing_dates"),
        F.count_if((F.col("have") == F.col("all")) & (F.col("low") <= 0)).alias("nonpositive_complete_rows"),
    )


def validated(panel: DataFrame) -> DataFrame:
    """The panel, or an error that names what is wrong; a price at or below zero is wrong in any row."""
    bad = {k: v for k, v in violations(panel).first().asDict().items() if v}
    if panel.where("price <= 0").take(1):
        bad["nonpositive_prices"] = True
    if panel.where("trim(coalesce(ticker, '')) = ''").take(1):
        bad["empty_tickers"] = True
    if bad:
        raise ValueError(f"invalid price panel: {bad}")
    return panel
