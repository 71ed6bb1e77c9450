"""Files of prices: wide tables, tables of repeated date and value columns, and CSV out."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from driftwell.functions.settings import DataSettings
from driftwell.operators.quality import validated
from driftwell.operators.residuals import complete_rows
from driftwell.sources.panels import densify, from_wide, to_wide


@dataclass(frozen=True)
class SeriesMapping:
    ticker: str
    date_column: str
    value_column: str


class PanelSource(Protocol):
    """Anything that loads a panel from a place."""

    def load(self, path: str) -> DataFrame: ...


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as text; nothing is inferred."""
    names = spark.read.option("header", True).csv(path).columns
    schema = StructType([StructField(n, StringType()) for n in names])
    return spark.read.option("header", True).schema(schema).csv(path)


def detect_format(raw: DataFrame) -> str:
    named = any(c.strip().lower() == "date" for c in raw.columns)
    return "wide" if named and len(raw.columns) >= 2 else "repeated_pairs_requires_mapping"


def _unique(cells: DataFrame, keys: list[str], what: str) -> DataFrame:
    twice = cells.groupBy(*keys).count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"duplicate {what}: {[twice[0][k] for k in keys]}")
    return cells


def _dates(column, lenient: bool):
    t = column.try_cast("timestamp") if lenient else column.cast("timestamp")
    return t.cast("timestamp_ntz")


def wide_panel(raw: DataFrame, *, date_col: str | None = None, unique: bool = True) -> DataFrame:
    """A wide text table as a panel. Values and dates that cannot be read raise; empty values are missing."""
    date_col = date_col or next((c for c in raw.columns if c.strip().lower() == "date"), None)
    if date_col is None or date_col not in raw.columns:
        raise ValueError("a date column is required")
    names = [c for c in raw.columns if c != date_col]
    if not names:
        raise ValueError("at least one ticker column is required")
    clean = raw.select(_dates(F.col(f"`{date_col}`"), False).alias("Date"), *(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).cast("double").alias(c.strip()) for c in names))
    if clean.where("Date is null").take(1):
        raise ValueError("missing dates")
    if unique:
        _unique(clean, ["Date"], "date")
    return from_wide(clean, "Date")


def repeated_pairs_panel(raw: DataFrame, mappings: list[SeriesMapping]) -> DataFrame:
    """Columns of (date, value) by series, met by date without filling; unreadable cells are missing, dates are dropped."""
    if len({m.ticker for m in mappings}) != len(mappings) or not mappings:
        raise ValueError("every series needs its own ticker")
    parts = [raw.select(F.lit(m.ticker).alias("ticker"), _dates(F.col(f"`{m.date_column}`"), True).alias("ts"), F.col(f"`{m.value_column}`").try_cast("double").alias("price")).where("ts is not null") for m in mappings]
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    return densify(_unique(cells, ["ticker", "ts"], "date in a series"))


@dataclass(frozen=True)
class CsvSource:
    """Wide CSV files as validated panels."""

    spark: SparkSession
    date_col: str = "Date"
    complete_only: bool = False
    minimum_observations: int = 2

    @classmethod
    def of(cls, spark: SparkSession, settings: DataSettings) -> CsvSource:
        return cls(spark, settings.date_column, settings.drop_incomplete_rows, settings.minimum_observations)

    def load(self, path: str) -> DataFrame:
        panel = validated(wide_panel(read_text_csv(self.spark, path), date_col=self.date_col))
        if self.complete_only:
            panel = densify(complete_rows(panel).select("ticker", "ts", "price"))
        n = panel.select("ts").distinct().count()
        if n < max(2, self.minimum_observations):
            raise ValueError(f"only {n} observations")
        return panel


def load_vendor_csv(spark: SparkSession, path: str, mappings: list[SeriesMapping] | None = None) -> DataFrame:
    """A vendor's CSV: wide, or repeated pairs with their mapping."""
    raw = read_text_csv(spark, path)
    if mappings:
        return validated(repeated_pairs_panel(raw, mappings))
    if detect_format(raw) != "wide":
        raise ValueError("repeated date and value columns need a mapping")
    return validated(wide_panel(raw))


class UnavailableSource:
    """A named source that is not connected."""

    def load(self, path: str) -> DataFrame:
        raise NotImplementedError("this source needs a vendor connection")


def write_wide_csv(panel: DataFrame, path: str, tickers: list[str]) -> None:
    to_wide(panel, tickers).withColumnRenamed("ts", "Date").write.option("header", True).csv(path)
