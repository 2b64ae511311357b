"""Evaluation against labelled episodes: contract, one-to-one matching, metrics.

labels: scenario_id, user_id, device_id, authentication, collection, transfer (event
ids), context ARRAY, order_constraints ARRAY<STRUCT<before, after>>.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograil.functions.stats import ratio, wilson
from lograil.operators.chain import ACTOR, stage_rows
from lograil.operators.ordered import micros, utc_day
from lograil.operators.risk import UNIT, active_units

STAGES = ("authentication", "collection", "transfer")


def _refs(labels: DataFrame) -> DataFrame:
    return labels.select("scenario_id", *ACTOR, F.explode(F.concat(F.array(*STAGES), "context")).alias("event_id")).where(
        "event_id is not null")


def _facts(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").cast("string").alias("event_id"), micros().alias("us"),
                         F.col("user_id").alias("_user"), F.col("device_id").alias("_device"))


def label_violations(labels: DataFrame, events: DataFrame) -> DataFrame:
    """(scenario, problem): missing stage, reference outside the data, other actor, wrong order."""
    facts = _facts(events)
    incomplete = labels.where(" or ".join(f"{s} is null" for s in STAGES)).select(
        "scenario_id", F.lit("a stage cites no event").alias("problem"))
    refs = _refs(labels).join(facts, "event_id", "left")
    outside = refs.where("us is null").select("scenario_id", F.lit("cites an event that is not there").alias("problem"))
    other = refs.where("_user <> user_id or _device <> device_id").select("scenario_id", F.lit("cites another account or device").alias("problem"))
    order = labels.select("scenario_id", F.inline("order_constraints"))
    moment = facts.select("event_id", "us")
    timed = (order.join(moment.withColumnsRenamed({"event_id": "before", "us": "before_us"}), "before", "left")
             .join(moment.withColumnsRenamed({"event_id": "after", "us": "after_us"}), "after", "left"))
    wrong = timed.where(~F.coalesce(F.col("before_us") < F.col("after_us"), F.lit(False))).select(
        "scenario_id", F.lit("cites events in the wrong order").alias("problem"))
    return incomplete.unionByName(outside).unionByName(other).unionByName(wrong).distinct()


def match_episodes(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    """Status per alert: matched, duplicate_credit_rejected, oversized_or_ambiguous or unmatched.

    An alert is eligible for a label when it cites the label's event at every stage,
    an equi-join. Each label credits the first alert that has it as only choice.
    """
    wanted = F.flatten(F.transform("order_constraints", lambda c: F.array(c["before"], c["after"])))
    keys = labels.select(*ACTOR, *[F.col(s).alias(f"{s}_id") for s in STAGES], "scenario_id", wanted.alias("_wanted"))
    cited = alerts.select(*ACTOR, F.col("login_id").cast("string").alias("authentication_id"),
                          F.col("read_id").cast("string").alias("collection_id"), F.col("copy_id").cast("string").alias("transfer_id"),
                          "candidate_id", "selected")
    eligible = (cited.join(keys, [*ACTOR, *[f"{s}_id" for s in STAGES]])
                .where(F.size(F.array_except("_wanted", "selected")) == 0).select("candidate_id", "scenario_id"))
    choices = eligible.groupBy("candidate_id").agg(F.count("*").alias("choices"), F.min("scenario_id").alias("scenario_id"))
    winners = choices.where("choices = 1").groupBy("scenario_id").agg(F.min("candidate_id").alias("candidate_id"))
    credited = winners.withColumn("credited", F.lit(True))
    return (alerts.select("candidate_id").join(choices, "candidate_id", "left").join(credited, ["candidate_id", "scenario_id"], "left")
            .withColumn("status", F.when(F.col("choices") > 1, "oversized_or_ambiguous").when(F.col("credited"), "matched")
                        .when(F.col("choices") == 1, "duplicate_credit_rejected").otherwise("unmatched"))
            .select("candidate_id", F.when(F.col("status") == "matched", F.col("scenario_id")).alias("scenario_id"), "status"))


def benign_units(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Active (user, device, day) units without any labelled event."""
    attacked = (_refs(labels).select("event_id").distinct().join(_facts(events), "event_id")
                .select(F.col("_user").alias("user_id"), F.col("_device").alias("device_id"), utc_day("us").alias("day")).distinct())
    return active_units(events, micros()).join(attacked, UNIT, "left_anti")


def _evidence_units(found: DataFrame, events: DataFrame) -> DataFrame:
    cited = found.select("candidate_id", F.explode("selected").alias("event_id"))
    return cited.join(_facts(events), "event_id").select(
        "candidate_id", F.col("_user").alias("user_id"), F.col("_device").alias("device_id"), utc_day("us").alias("day")).distinct()


def evaluate(found: DataFrame, labels: DataFrame, events: DataFrame) -> DataFrame:
    """(metric, numerator, denominator, value, low, high) rows over one-to-one matches.

    `found` and `labels` should be durable: every metric reads them.
    """
    alerts = found.where("decision = 'incident'")
    matches = match_episodes(alerts, labels)
    benign = benign_units(events, labels)
    false = _evidence_units(alerts, events).join(benign, UNIT, "left_semi")
    unmatched = matches.where("status <> 'matched'").select("candidate_id")
    truth = labels.select(F.inline(F.array(*[F.struct(F.lit(s).alias("stage_id"), F.col(s).alias("event_id")) for s in STAGES])))
    staged = stage_rows(found)
    evidence = found.select("candidate_id", F.explode("selected").alias("event_id"))
    constraints = labels.select("scenario_id", F.inline("order_constraints")).withColumn(
        "_pair", F.concat_ws(">", "scenario_id", "before", "after"))
    covered = (constraints.join(evidence.select("candidate_id", F.col("event_id").alias("before")), "before")
               .join(evidence.select("candidate_id", F.col("event_id").alias("after")), ["after", "candidate_id"]))
    orders = F.array_compact(F.array(F.col("login_us") < F.col("read_us"), F.col("read_us") < F.col("copy_us"),
                                     F.col("mount_us") < F.col("copy_us")))
    count = lambda df: df.agg(F.count("*").alias("x")).scalar()
    facts = {
        "matched": count(matches.where("status = 'matched'")), "alerts": count(alerts), "labels": count(labels),
        "false_units": count(false.select(*UNIT).distinct()), "benign": count(benign),
        "false_alerts": count(false.select("candidate_id").distinct().join(unmatched, "candidate_id", "left_semi")),
        "events": count(events), "stages": count(staged),
        "valid_stages": count(staged.join(_facts(events).select("event_id"), "event_id", "left_semi")),
        "recalled": count(truth.join(staged, ["stage_id", "event_id"], "left_semi")),
        "constraints": count(constraints), "covered": count(covered.select("_pair").distinct()),
        "orders": found.agg(F.coalesce(F.sum(F.size(orders)), F.lit(0)).alias("x")).scalar(),
        "right_orders": found.agg(F.coalesce(F.sum(F.size(F.filter(orders, lambda o: o))), F.lit(0)).alias("x")).scalar()}
    row = found.sparkSession.range(1).select(*[scalar.alias(name) for name, scalar in facts.items()])
    metric = lambda name, n, d: F.struct(F.lit(name).alias("metric"), F.col(n).cast("bigint").alias("numerator"),
                                         (F.col(d) if isinstance(d, str) else d).cast("bigint").alias("denominator"))
    rows = row.select(F.inline(F.array(
        metric("incident_precision", "matched", "alerts"), metric("incident_recall", "matched", "labels"),
        metric("benign_user_device_day_fpr", "false_units", "benign"),
        metric("benign_false_alerts_per_1000_events", "false_alerts", "events"),
        metric("asserted_stage_evidence_coverage", "valid_stages", "stages"),
        metric("required_stage_recall", "recalled", 3 * F.col("labels")),
        metric("ordering_constraint_coverage", "covered", "constraints"),
        metric("ordering_constraint_accuracy", "right_orders", "orders"))))
    scale = F.when(F.col("metric") == "benign_false_alerts_per_1000_events", 1000).otherwise(1)
    interval = F.when(F.col("metric") == "benign_user_device_day_fpr", wilson(F.col("numerator"), F.col("denominator")))
    return rows.withColumn("value", scale * ratio(F.col("numerator"), F.col("denominator"))).withColumn(
        "_w", interval).select("metric", "numerator", "denominator", "value", F.col("_w.low").alias("low"), F.col("_w.high").alias("high"))


def aggregate_profiles(metrics: DataFrame) -> DataFrame:
    """Sum numerators and denominators per (mode, metric); the rollup adds each profile."""
    return (metrics.rollup("mode", "metric", "profile").agg(
        F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"),
        F.grouping_id().alias("_level")).where("_level <= 1").drop("_level")
        .withColumn("value", ratio(F.col("numerator"), F.col("denominator"))))


def case_outcomes(cases: DataFrame, found: DataFrame) -> DataFrame:
    """Predictions that share an observation with a labelled case; a case without any keeps one empty row."""
    seen = cases.select("case_id", F.explode("observed_refs").alias("event_id"))
    cited = found.select("candidate_id", "decision", "score", "stages", F.explode("selected").alias("event_id"))
    related = seen.join(cited, "event_id").drop("event_id").distinct()
    return cases.select("case_id").distinct().join(related, "case_id", "left")


def calibration_audit(scored: DataFrame, windows: DataFrame, threshold: float | Column, alarm: float | Column) -> DataFrame:
    """One row: complete candidates, alerts at the threshold, scored windows, alarms and ties."""
    complete = scored.where("stages = 3")
    alerts = complete.where((F.col("risk") >= threshold) & F.col("percentile").isNotNull())
    raw = F.col("raw_anomaly_score")
    return (complete.agg(F.count("*").alias("complete_candidates"), F.min("risk").alias("lowest_score"), F.max("risk").alias("highest_score"))
            .withColumn("alerts_at_threshold", alerts.agg(F.count("*")).scalar())
            .withColumn("scored_windows", windows.agg(F.count(raw)).scalar())
            .withColumn("window_alarms", windows.agg(F.count_if(raw >= alarm)).scalar())
            .withColumn("alarm_ties", windows.agg(F.count_if(raw == alarm)).scalar()))
