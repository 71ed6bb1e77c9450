"""From model evidence to a gated decision: consensus, confidence, gates and their explanation, for many entities at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS = ("LONG_RESIDUAL", "SHORT_RESIDUAL", "NEUTRAL")
# The components of the confidence score and their largest shares of 100.
COMPONENTS = {
    "deviation": 12.0, "stationarity_quality": 14.0, "ou_agreement": 15.0, "half_life_quality": 12.0, "parameter_stability": 14.0,
    "regime_quality": 10.0, "model_agreement": 13.0, "first_passage_quality": 5.0, "economic_value_margin": 3.0, "boundary_robustness": 2.0,
}
# The gates in order, and what a failed one is called.
GATES = {"sufficient_data": "Insufficient data", "residual_valid": "Invalid residual", "stationarity_valid": "Stationarity gate", "ou_valid": "OU fit", "half_life_acceptable": "Half-life", "parameter_stable": "Parameter stability"}


def consensus(evidence: DataFrame, *, entity: str = "entity", conflict_share: float = 0.35) -> DataFrame:
    """One row per entity from its models' votes.

    evidence: entity, model_name, direction, valid, gate_passed, weight, reliability, dependency_group. The votes of a
    dependency group share one average weight, by weight times reliability; a null group is a vote of its own.
    """
    if not 0 < conflict_share < 0.5:
        raise ValueError("conflict_share must be between 0 and 0.5")
    votes = evidence.where("valid and gate_passed and direction <> 'INVALID'")
    group = F.coalesce(F.concat(F.lit("g:"), F.nullif("dependency_group", F.lit(""))), F.concat(F.lit("m:"), F.monotonically_increasing_id().cast("string")))
    votes = votes.withColumn("_g", group).withColumn("_raw", F.col("weight") * F.col("reliability"))
    w = Window.partitionBy(entity, "_g")
    total = F.sum("_raw").over(w)
    votes = votes.withColumn("_support", F.when(total > 0, F.avg("weight").over(w) * F.col("_raw") / total).otherwise(0.0))
    of = lambda d, c: F.coalesce(F.sum(F.when(F.col("direction") == d, c)), F.lit(0.0))
    names = F.sort_array(F.collect_list(F.struct("model_name", "direction")))
    g = votes.groupBy(entity).agg(
        F.count("*").alias("valid_model_count"), *(F.count_if(F.col("direction") == d).alias(f"{n}_count") for n, d in zip(("long", "short", "neutral"), DIRECTIONS, strict=True)),
        of(DIRECTIONS[0], F.col("_support")).alias("long_support"), of(DIRECTIONS[1], F.col("_support")).alias("short_support"), of(DIRECTIONS[2], F.col("_support")).alias("neutral_support"), names.alias("_models"),
    )
    g = evidence.select(entity).distinct().join(g, entity, "left")
    long, short, neutral = (F.coalesce(f"{n}_support", F.lit(0.0)) for n in ("long", "short", "neutral"))
    whole = long + short + neutral
    share = lambda x: F.when(whole > 0, x / whole)
    clash = (share(long) >= conflict_share) & (share(short) >= conflict_share)
    winner = F.when((long >= short) & (long >= neutral), DIRECTIONS[0]).when(short >= neutral, DIRECTIONS[1]).otherwise(DIRECTIONS[2])
    state = F.when(whole <= 0, "INSUFFICIENT_DATA").when(clash, "CONFLICTED").otherwise(F.replace(winner, F.lit("_RESIDUAL"), F.lit("")))
    agreement = F.when(whole <= 0, 0.0).when(clash, F.greatest(share(long), share(short)) * 100).otherwise(F.greatest(share(long), share(short), share(neutral)) * 100)
    g = g.withColumn("state", state).withColumn("agreement_percentage", agreement).withColumn("_winner", winner)
    against = F.filter(F.coalesce("_models", F.array()), lambda m: (m["direction"] != "NEUTRAL") & ((F.col("state") == "CONFLICTED") | (m["direction"] != F.col("_winner"))))
    g = g.withColumn("disagreeing_models", F.when(F.col("state") == "INSUFFICIENT_DATA", F.array().cast("array<string>")).otherwise(F.transform(against, lambda m: m["model_name"])))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("valid_model_count", "long_count", "short_count", "neutral_count")]
    return g.select(entity, "state", *counts, "agreement_percentage", "disagreeing_models", long.alias("long_support"), short.alias("short_support"), neutral.alias("neutral_support"))


def confidence(gates_pass: Column, z: Column, **qualities: Column) -> Column:
    """A score of 0 to 100 from qualities of 0 to 1, null where a gate fails; missing qualities count 0."""
    parts = {"deviation": F.coalesce(F.least(F.abs(z) / 2.5, F.lit(1.0)), F.lit(0.0)), **qualities}
    score = F.lit(0.0)
    for name, most in COMPONENTS.items():
        score = score + F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(parts.get(name, F.lit(0.0)), F.lit(0.0)))) * most
    return F.when(gates_pass, F.round(score, 6))


def gate_failures() -> Column:
    """Names of the failed gates, in order; columns are those of GATES and regime_status."""
    named = [F.when(~F.col(g), name) for g, name in GATES.items()]
    return F.array_compact(F.array(*named, F.when(F.col("regime_status") == "SEVERE_BREAK", "SEVERE_BREAK regime")))


def final_decision(rows: DataFrame, **qualities: str) -> DataFrame:
    """Adds action, valid, invalid_reason, confidence and why to rows of gates, consensus and policy.

    rows: the gates, regime_status, zscore, consensus_state, agreement_percentage, valid_model_count, policy_action.
    Missing data comes first, then failed gates, then the consensus, then the policy. Confidence is withheld only
    when a gate failed. ``qualities`` names columns for the confidence score.
    """
    df = rows.withColumn("failures", gate_failures())
    failed, state = F.size("failures") > 0, F.col("consensus_state")
    says = F.array_join("failures", "; ")
    reason = F.when(~F.col("sufficient_data"), "Insufficient data").when(failed, says).when(state == "INSUFFICIENT_DATA", "No valid residual models").when(state == "CONFLICTED", "Valid models have strong long/short disagreement")
    action = F.when(~F.col("sufficient_data"), "INSUFFICIENT_DATA").when(failed, "NO_SIGNAL").when(state.isin("INSUFFICIENT_DATA", "CONFLICTED"), state).otherwise(F.col("policy_action"))
    df = df.withColumn("action", action).withColumn("invalid_reason", reason).withColumn("valid", reason.isNull())
    df = df.withColumn("confidence", confidence(~failed, F.col("zscore"), model_agreement=F.col("agreement_percentage") / 100, **{k: F.col(v) for k, v in qualities.items()}))
    mark = lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    items = [
        explained("Critical gates", F.when(failed, says).otherwise("passed"), F.lit("all critical gates must pass"), mark(~failed)),
        explained("Model consensus", state, F.concat(F.col("valid_model_count").cast("string"), F.lit(" valid models")), mark(F.col("valid") & ~state.isin("CONFLICTED", "INSUFFICIENT_DATA"))),
    ]
    return explain(df, items, "action").drop("failures")


STATUSES = ("PASS", "CAUTION", "FAIL", "NOT_APPLICABLE")


def explained(name: str, observed: Column, required: Column, status: Column, explanation: str = "") -> Column:
    """One item of an explanation; a status that is none of STATUSES raises."""
    checked = F.when(status.isin(*STATUSES), status).otherwise(F.raise_error(F.concat(F.lit(f"{name}: not a status: "), F.coalesce(status, F.lit("null")))).cast("string"))
    return F.struct(F.lit(name).alias("name"), observed.cast("string").alias("observed"), required.cast("string").alias("required"), checked.alias("status"), F.lit(explanation).alias("explanation"))


def explain(rows: DataFrame, items: list[Column], action: str) -> DataFrame:
    """Adds why (the items), blocking (the names of those that fail) and explained_action to rows with an action."""
    empty = F.array().cast("array<struct<name:string,observed:string,required:string,status:string,explanation:string>>")
    df = rows.withColumn("why", F.array(*items) if items else empty)
    return df.withColumn("blocking", F.transform(F.filter("why", lambda i: i["status"] == "FAIL"), lambda i: i["name"])).withColumn("explained_action", F.col(action))


def to_records(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, record): every row as JSON text with all its fields, nulls too; for decisions, consensus, confidence or explanations."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("record"))


def from_records(records: DataFrame, schema: str) -> DataFrame:
    """The rows of ``to_records`` again; schema: the fields of a record. Text that is no such record raises."""
    got = F.from_json("record", schema, {"mode": "FAILFAST", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    keys = [c for c in records.columns if c != "record"]
    return records.select(*keys, got.alias("r")).select(*keys, "r.*")


def direction_of(z: Column, threshold: float = 2.0) -> Column:
    return F.when(z.isNull(), "INVALID").when(z <= -threshold, "LONG_RESIDUAL").when(z >= threshold, "SHORT_RESIDUAL").otherwise("NEUTRAL")


def snapshot_payloads(decisions: DataFrame) -> DataFrame:
    """Adds the JSON payloads of a frozen prediction, from whatever of a decision's columns is there."""
    groups = {
        "ou_outputs": ("theta", "kappa", "sigma", "half_life"),
        "probability_outputs": ("p_exit_before_stop", "p_stop_before_exit", "p_exit_5d", "p_exit_10d", "p_exit_20d", "median_holding_time"),
        "diagnostic_outputs": ("why", "blocking", "adf_pvalue", "kpss_pvalue"),
        "consensus_outputs": ("consensus_state", "agreement_percentage", "confidence"),
        "model_outputs": ("action", "valid", "invalid_reason", "zscore"),
    }
    for name, columns in groups.items():
        there = [c for c in columns if c in decisions.columns]
        decisions = decisions.withColumn(name, F.to_json(F.struct(*there), {"ignoreNullFields": "false"}) if there else F.lit("{}"))
    return decisions
