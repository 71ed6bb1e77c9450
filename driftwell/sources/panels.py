"""Panels: long tables (ticker, ts, pos, price), dense over dates and tickers, and their construction from raw tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def densify(cells: DataFrame) -> DataFrame:
    """All dates x all tickers, with the date's position in the calendar; missing prices are null.

    cells: ticker, ts, price, at most one row for each ticker and date. The calendar and the ticker list are
    dimensions: positions come from the distinct dates, never from a sort of all cells.
    """
    calendar = cells.select("ts").distinct().withColumn("pos", (F.row_number().over(Window.orderBy("ts")) - 1).cast("long"))
    tickers = cells.agg(F.sort_array(F.collect_set("ticker")).alias("tickers"))
    grid = calendar.join(F.broadcast(tickers)).select("ts", "pos", F.explode("tickers").alias("ticker"))
    return grid.join(cells, ["ticker", "ts"], "left").select("ticker", "ts", "pos", "price")


def cents_mean(value: str) -> Column:
    """Mean of amounts by exact integer cents, so that the order of addition cannot matter."""
    return F.sum(F.round(F.col(value) * 100).cast("long")).cast("double") / (F.lit(100.0) * F.count("*"))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("ts"), "o_totalprice")
    return densify(t.groupBy("ticker", "ts").agg(cents_mean("o_totalprice").alias("price")))


def weekly_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.date_trunc("week", "l_shipdate").cast("date").alias("ts"), "l_extendedprice")
    return densify(t.groupBy("ticker", "ts").agg(cents_mean("l_extendedprice").alias("price")))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("ticker"), F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("ts"), "value")
    return densify(t.groupBy("ticker", "ts").agg(cents_mean("value").alias("price")))


def from_wide(wide: DataFrame, date_col: str = "Date", tickers: Iterable[str] | None = None) -> DataFrame:
    """A wide frame (one column per ticker) as a panel; values must be numeric or null."""
    names = [c for c in wide.columns if c != date_col] if tickers is None else list(tickers)
    long = wide.select(F.col(date_col).alias("ts"), *(F.col(f"`{c}`").cast("double").alias(c) for c in names)).unpivot("ts", names, "ticker", "price")
    return densify(long.select("ticker", "ts", "price"))


def to_wide(panel: DataFrame, tickers: list[str]) -> DataFrame:
    return panel.groupBy("ts").pivot("ticker", tickers).agg(F.first("price")).orderBy("ts")


def halo(panel: DataFrame, back: int, keys: list[str], block: int = 16_384, *, ahead: int = 0) -> DataFrame:
    """Adds ``part`` and ``own``: a series is cut into blocks of positions, with copies of the ``back`` rows before and ``ahead`` rows after.

    Windows of up to ``back`` prior and ``ahead`` later rows can then be partitioned by keys and part, so that one long
    series is many tasks; rows that are not ``own`` are dropped afterwards. ``pos`` must be dense within keys.
    """
    size = max(block, 4 * max(back, ahead))
    part = F.floor(F.col("pos") / size)
    at = F.col("pos") % size
    parts = F.array_compact(F.array(part, F.when(at >= size - back, part + 1) if back else F.lit(None).cast("long"), F.when((at < ahead) & (part > 0), part - 1) if ahead else F.lit(None).cast("long")))
    return panel.withColumn("part", F.explode(parts)).withColumn("own", F.col("part") == part)


# The same panels as SQL, for checks: common table expressions `cells` and `panel`.
_PANEL = """, panel AS (
  SELECT t.ticker, d.ts, d.pos, c.price FROM (SELECT ts, ROW_NUMBER() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT DISTINCT ts FROM cells)) d
  CROSS JOIN (SELECT DISTINCT ticker FROM cells) t LEFT JOIN cells c ON c.ticker = t.ticker AND c.ts = d.ts)"""
DAILY_SQL = """cells AS (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS ts,
  CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (100.0e0 * COUNT(*)) AS price FROM orders GROUP BY 1, 2)""" + _PANEL
WEEKLY_SQL = """cells AS (SELECT l_returnflag || l_linestatus AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS ts,
  CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (100.0e0 * COUNT(*)) AS price FROM lineitem GROUP BY 1, 2)""" + _PANEL
HOURLY_SQL = """cells AS (SELECT event_type AS ticker, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts,
  CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS DOUBLE) / (100.0e0 * COUNT(*)) AS price FROM events GROUP BY 1, 2)""" + _PANEL
