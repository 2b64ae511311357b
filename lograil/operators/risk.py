"""Hybrid risk, decisions and threshold calibration."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograil.operators.features import window_start
from lograil.operators.ordered import utc_day
from lograil.operators.ranks import value_ranks

FLOOR = 80.0
TARGET = 0.01
STEP = 1e-8
MIB = 1024 * 1024
UNIT = ["user_id", "device_id", "day"]
_TIMES = ("login_us", "read_us", "copy_us", "mount_us")


def candidate_windows(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Scored windows that hold cited evidence of a candidate.

    All evidence shares the candidate's user and device, so its windows follow
    from the evidence times.
    """
    starts = F.array_distinct(F.array_compact(F.array(*[window_start(c) for c in _TIMES])))
    return (found.select("candidate_id", "user_id", "device_id", F.explode(starts).alias("window_us"))
            .join(windows.where("anomaly_percentile is not null"), ["user_id", "device_id", "window_us"]))


def hybrid_risk(found: DataFrame, windows: DataFrame, links: DataFrame | None = None,
                reductions: DataFrame | None = None) -> DataFrame:
    """Components C, A, L, I, B and the clamped score of each candidate.

    `links` has event_id of alias-resolved events, `reductions` candidate_id and reduction.
    """
    anomaly = candidate_windows(found, windows).groupBy("candidate_id").agg(F.max("anomaly_percentile").alias("percentile"))
    result = found.join(anomaly, "candidate_id", "left")
    if links is None:
        result = result.withColumn("linked", F.lit(False))
    else:
        linked = (found.select("candidate_id", F.explode("selected").alias("event_id"))
                  .join(links.select(F.col("event_id").cast("string").alias("event_id")).distinct(), "event_id", "left_semi")
                  .select("candidate_id").distinct().withColumn("linked", F.lit(True)))
        result = result.join(linked, "candidate_id", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    if reductions is None:
        result = result.withColumn("B", F.lit(0.0))
    else:
        result = (result.join(reductions.select("candidate_id", F.col("reduction").alias("B")), "candidate_id", "left")
                  .withColumn("B", F.coalesce("B", F.lit(0.0))))
    impact = F.least(F.coalesce("bytes_written", F.lit(0)) / F.lit(float(MIB)), F.lit(1.0))
    result = (result.withColumn("C", F.col("stages") / 3).withColumn("A", F.coalesce("percentile", F.lit(0.0)))
              .withColumn("L", F.when(F.col("linked"), 0.9).otherwise(1.0))
              .withColumn("I", F.when(F.col("stages") == 3, impact).otherwise(0.0)))
    return result.withColumn("risk", combined())


def combined(anomaly: str | Column = "A") -> Column:
    total = 50 * F.col("C") + 20 * (F.col(anomaly) if isinstance(anomaly, str) else anomaly) + 20 * F.col("L") + 10 * F.col("I") - F.col("B")
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def decide(scored: DataFrame, threshold: float | Column, risk: str = "risk") -> DataFrame:
    """Complete chains below the threshold or without a scored window go to review."""
    threshold = F.lit(threshold) if isinstance(threshold, float) else threshold
    doubtful = (F.col(risk) < threshold) | F.col("percentile").isNull()
    return scored.withColumn("decision", F.when(F.col("stages") < 3, "partial_observation")
                             .when(doubtful, "review").otherwise("incident"))


def neutralise(scored: DataFrame, threshold: float) -> DataFrame:
    """The same candidates with the anomaly term set to zero and everything else kept."""
    return decide(scored.withColumn("risk", combined(F.lit(0.0))), threshold)


def active_units(events: DataFrame, micros: Column) -> DataFrame:
    return (events.where("user_id is not null and device_id is not null")
            .select("user_id", "device_id", utc_day(micros).alias("day")).distinct())


def candidate_units(found: DataFrame) -> DataFrame:
    """(candidate, user, device, day) of every cited event."""
    days = F.array_distinct(F.array_compact(F.array(*[utc_day(c) for c in _TIMES])))
    return found.select("candidate_id", "user_id", "device_id", F.explode(days).alias("day"))


def calibrate(scored: DataFrame, benign: DataFrame, target: float = TARGET) -> DataFrame:
    """One row: the lowest candidate boundary within the false-unit budget.

    A unit is falsely implicated at a cut exactly when the best score touching it
    reaches the cut, so one maximum per unit and ranks over those maxima replace
    testing every boundary against every candidate.
    """
    complete = scored.where("stages = 3").select("candidate_id", "user_id", "device_id", *_TIMES, "risk")
    best = (candidate_units(complete).join(complete.select("candidate_id", "risk"), "candidate_id")
            .groupBy(*UNIT).agg(F.max("risk").alias("value")))
    boundaries = complete.where("risk < 100").select((F.col("risk") + STEP).alias("value")).unionByName(
        scored.sparkSession.range(1).select(F.lit(FLOOR).alias("value")))
    # Boundaries enter with weight 0: their `below` counts the units whose best score is lower.
    pool = best.select("value", F.lit(1).alias("w")).unionByName(boundaries.select("value", F.lit(0).alias("w")))
    ranks = value_ranks(pool, "value", F.col("w"))
    units = benign.agg(F.count("*").alias("benign_units"))
    tested = (boundaries.distinct().join(ranks, "value").withColumn("false_units", F.col("total") - F.col("below"))
              .withColumn("benign_units", units.scalar()))
    within = tested.where(F.col("false_units") / F.col("benign_units") <= target)
    chosen = within.agg(F.min("value").alias("chosen"))
    floor = tested.where(F.col("value") == FLOOR).select("false_units", "benign_units")
    counts = complete.agg(F.count("*").alias("complete_candidates"), F.max("risk").alias("_best"))
    row = (counts.withColumn("_chosen", chosen.scalar())
           .withColumn("benign_units", floor.select("benign_units").scalar())
           .withColumn("_floor_false", floor.select("false_units").scalar())
           .withColumn("_useful", F.col("_chosen").isNotNull()
                       & ((F.col("complete_candidates") == 0) | (F.col("_best") >= F.col("_chosen")))))
    threshold = F.when(F.col("_useful"), F.col("_chosen")).otherwise(F.lit(FLOOR))
    at = within.select(F.min_by("false_units", "value"))
    return row.select(
        threshold.alias("threshold"), "benign_units",
        F.when(F.col("_useful"), at.scalar()).otherwise(F.col("_floor_false")).alias("false_units"), "complete_candidates",
        F.when(F.col("complete_candidates") == 0, "insufficient_complete_candidates")
        .when(F.col("_useful"), "empirical_budget_met").otherwise("budget_not_met").alias("status"),
        F.when((F.col("complete_candidates") == 0) | ~F.col("_useful"), "structural_fallback")
        .otherwise("benign_calibration_candidate_boundary").alias("threshold_origin"))


def anomaly_alarms(windows: DataFrame, benign: DataFrame, threshold: float | Column) -> DataFrame:
    """One row: window alarms at a raw-score threshold and the benign units they touch."""
    threshold = F.lit(threshold) if isinstance(threshold, float) else threshold
    rows = windows.withColumn("day", utc_day("window_us")).withColumn("threshold", threshold).join(
        benign.withColumn("benign", F.lit(True)), UNIT, "left")
    alarm = F.col("raw_anomaly_score") >= F.col("threshold")
    false = alarm & F.col("benign")
    return rows.agg(
        F.count_if(alarm).alias("alert_count"), F.count("raw_anomaly_score").alias("eligible_windows"),
        F.count_if(F.col("raw_anomaly_score").isNull()).alias("missing_windows"),
        F.count_if(F.col("raw_anomaly_score") == F.col("threshold")).alias("threshold_ties"),
        F.count_if(false).alias("false_alarms"),
        F.count_distinct(F.when(false, F.struct(*UNIT))).alias("false_units"))
