"""Frozen pair models against later prices. Nothing is refitted: boundaries and coefficients stay as they were."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FROZEN = "prediction_id string, target string, peer string, alpha double, beta double, initial_residual double, long_entry struct<lo:double,hi:double>, short_entry struct<lo:double,hi:double>, exit double, long_stop double, short_stop double, position string"


def pair_residual(target_price: Column, peer_price: Column, alpha: Column, beta: Column) -> Column:
    """Raises on prices that are not positive."""
    x = F.ln(target_price) - alpha - beta * F.ln(peer_price)
    return F.when((target_price > 0) & (peer_price > 0), x).otherwise(F.raise_error(F.lit("pair prices must be positive")).cast("double"))


def implied_price(boundary: Column, peer_price: Column, alpha: Column, beta: Column) -> Column:
    return F.exp(boundary + alpha + beta * F.ln(peer_price))


def _distance(x: Column, region: str) -> Column:
    lo, hi = F.least(F.col(region)["lo"], F.col(region)["hi"]), F.greatest(F.col(region)["lo"], F.col(region)["hi"])
    return F.when(F.col(region).isNull(), None).when((x >= lo) & (x <= hi), 0.0).otherwise(F.least(F.abs(x - lo), F.abs(x - hi)))


def classify_live(quotes: DataFrame, frozen: DataFrame) -> DataFrame:
    """Quotes (target, peer, ts, target_price, peer_price, batch or stream) against frozen models; a stateless join."""
    df = quotes.join(frozen, ["target", "peer"])
    x = pair_residual(F.col("target_price"), F.col("peer_price"), F.col("alpha"), F.col("beta"))
    df = df.withColumn("residual", x)
    x, position, exit_at = F.col("residual"), F.coalesce("position", F.lit("FLAT")), F.col("exit")
    df = df.withColumn("_long", _distance(x, "long_entry")).withColumn("_short", _distance(x, "short_entry"))
    stop = F.when(position == "LONG_RESIDUAL", F.col("long_stop")).when(position == "SHORT_RESIDUAL", F.col("short_stop"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    held = lambda stopped, left: F.when(yes(stopped), "STOP_REGION").when(yes(left), "EXIT_REGION").otherwise("HOLD")
    state = F.when(position == "LONG_RESIDUAL", held(x <= stop, x >= exit_at)).when(position == "SHORT_RESIDUAL", held(x >= stop, x <= exit_at))
    state = state.when(yes(F.col("_long") == 0) | yes(F.col("_short") == 0), "ENTRY_REGION").otherwise("WAIT")
    base = F.col("initial_residual") - exit_at
    df = df.withColumn("state", state).withColumn("distance_to_entry", F.least("_long", "_short")).withColumn("distance_to_exit", F.abs(x - exit_at)).withColumn("distance_to_stop", F.abs(x - stop))
    df = df.withColumn("fraction_reverted", F.when(F.abs(base) >= 1e-12, (F.col("initial_residual") - x) / base))
    price = lambda b: implied_price(b, F.col("peer_price"), F.col("alpha"), F.col("beta"))
    for name in ("exit", "long_stop", "short_stop"):
        df = df.withColumn(f"implied_{name}", price(F.col(name)))
    for name in ("long_entry", "short_entry"):
        df = df.withColumn(f"implied_{name}", F.when(F.col(name).isNotNull(), F.struct(price(F.col(name)["lo"]).alias("lo"), price(F.col(name)["hi"]).alias("hi"))))
    return df.drop("_long", "_short")


def trading_days(after: Column, until: Column) -> Column:
    """Mondays to Fridays after one date, up to and with another; 0 if there are none."""
    days = F.sequence(F.date_add(after.cast("date"), 1), F.greatest(until.cast("date"), F.date_add(after.cast("date"), 1)))
    weekdays = F.size(F.filter(days, lambda d: F.weekday(d) < 5))
    return F.when(until.cast("date") > after.cast("date"), weekdays).otherwise(F.when(after.isNotNull() & until.isNotNull(), 0))


def evaluations(classified: DataFrame, cutoff: str = "data_cutoff") -> DataFrame:
    """Journal records of classified quotes, one for each prediction and timestamp, with all of the journal's columns.

    Elapsed trading days are counted from the column ``cutoff``, if there is one; columns named realized_pnl,
    maximum_favorable_excursion, maximum_adverse_excursion and notes are taken over, and are null without.
    """
    there = set(classified.columns)
    elapsed = trading_days(F.col(cutoff), F.col("ts")) if cutoff in there else F.lit(None).cast("int")
    given = lambda name, kind: (F.col(name) if name in there else F.lit(None)).cast(kind).alias(name)
    return classified.select(
        "prediction_id", F.col("ts").cast("timestamp").alias("evaluation_timestamp"), F.concat(elapsed.cast("string"), F.lit(" trading days")).alias("evaluation_horizon"), F.col("target_price").alias("realized_price"),
        (F.col("state") == "EXIT_REGION").alias("exit_reached"), (F.col("state") == "STOP_REGION").alias("stop_reached"), "fraction_reverted", given("maximum_favorable_excursion", "double"), given("maximum_adverse_excursion", "double"),
        elapsed.cast("int").alias("elapsed_trading_days"), F.create_map(F.col("target"), F.col("target_price"), F.col("peer"), F.col("peer_price")).alias("live_prices"), F.col("residual").alias("current_residual"),
        "distance_to_entry", "distance_to_exit", "distance_to_stop", given("realized_pnl", "double"), given("notes", "string"),
    ).dropDuplicates(["prediction_id", "evaluation_timestamp"])
