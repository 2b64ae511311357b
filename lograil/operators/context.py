"""Valid-time context: sensitivity labels, account aliases, copy authorizations.

A context is a small dimension (one to a few intervals per key). It is folded
to one row per key, so every lookup is an equi-join that keeps the row count of
the event side, whatever the number of overlapping intervals.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograil.operators.history import completed
from lograil.operators.ordered import active_intervals, micros

ALIAS_STRENGTH = 0.9
REDUCTION = 20.0


def covers(interval: Column, moment: Column) -> Column:
    """Half-open [from, until), an absent end never closes."""
    return ((interval["effective_from"] <= moment)
            & (interval["effective_until"].isNull() | (moment < interval["effective_until"])))


def folded(context: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    return context.groupBy(*keys).agg(
        F.sort_array(F.collect_set(F.struct("effective_from", "effective_until", *fields))).alias(name))


def with_sensitivity(events: DataFrame, resources: DataFrame) -> DataFrame:
    """Add `sensitive`: a sensitive label covers the event's resource at event time."""
    labels = folded(resources.where("sensitive"), ["resource_id"], [], "_labels")
    return (events.join(labels, "resource_id", "left")
            .withColumn("sensitive", F.coalesce(
                F.exists("_labels", lambda x: covers(x, F.col("event_time"))), F.lit(False)))
            .drop("_labels"))


def sensitive_reads(events: DataFrame, resources: DataFrame) -> DataFrame:
    """Completed reads of a resource while a sensitive label covers it."""
    reads = events.where((F.col("action") == "file_read") & completed())
    return with_sensitivity(reads, resources).where("sensitive").drop("sensitive")


def alias_targets(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """Events with `targets` (distinct active canonical accounts) and `alias_status`."""
    chained = aliases.select(F.col("alias_user_id").alias("canonical_user_id")).distinct().withColumn("chained", F.lit(True))
    marked = aliases.join(chained, "canonical_user_id", "left").withColumn("chained", F.coalesce("chained", F.lit(False)))
    entries = folded(marked, ["alias_user_id"], ["canonical_user_id", "chained"], "_entries")
    active = F.filter("_entries", lambda x: covers(x, F.col("event_time")))
    return (events.join(entries.withColumnRenamed("alias_user_id", "user_id"), "user_id", "left")
            .withColumn("targets", F.coalesce(
                F.sort_array(F.array_distinct(F.transform(active, lambda x: F.struct(x["canonical_user_id"], x["chained"])))),
                F.array().cast("array<struct<canonical_user_id:string,chained:boolean>>")))
            .drop("_entries")
            .withColumn("alias_status", F.when(F.size("targets") == 0, "none")
                        .when((F.size("targets") > 1) | F.col("targets")[0]["chained"], "excluded")
                        .otherwise("resolved")))


def resolve(events: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rewrite accounts with exactly one active, unchained alias.

    Returns the events, one link row per rewritten event, and one warning row per
    account whose alias was excluded as ambiguous or chained.
    """
    found = alias_targets(events, aliases)
    rewritten = (found.withColumn("_original", F.col("user_id"))
                 .withColumn("user_id", F.when(F.col("alias_status") == "resolved",
                                               F.col("targets")[0]["canonical_user_id"]).otherwise(F.col("user_id"))))
    links = rewritten.where(F.col("alias_status") == "resolved").select(
        "event_id", F.col("_original").alias("original_user_id"), F.col("user_id").alias("canonical_user_id"),
        F.lit(ALIAS_STRENGTH).alias("policy_strength"))
    warnings = found.where(F.col("alias_status") == "excluded").select("user_id").distinct().withColumn(
        "warning", F.concat(F.lit("several or chained targets, kept as it is: "), "user_id"))
    return rewritten.select(*events.columns), links, warnings


def authorize(copies: DataFrame, authorizations: DataFrame) -> DataFrame:
    """Copy rows with how many authorizations satisfy each predicate, and the reduction.

    `copies` has copy_user, copy_device, copy_resource, copy_action and copy_us.
    Actor, endpoint, resource and action are counted on their own; a match needs
    all of them and a covering interval on one entry, and lowers risk once.
    """
    names = {"user_id": "copy_user", "device_id": "copy_device", "resource_id": "copy_resource",
             "action": "copy_action"}
    entries = authorizations.withColumnsRenamed(names)
    result = copies
    for name, key in (("actor", "copy_user"), ("endpoint", "copy_device"),
                      ("resource", "copy_resource"), ("action", "copy_action")):
        counts = entries.groupBy(key).agg(F.count("*").alias(f"{name}_entries"))
        result = result.join(counts, key, "left").withColumn(
            f"{name}_entries", F.coalesce(f"{name}_entries", F.lit(0)))
    intervals = entries.select(*names.values(), micros("effective_from").alias("from_us"),
                               micros("effective_until").alias("until_us"))
    return (active_intervals(result, intervals, list(names.values()), "copy_us", "matched_entries")
            .withColumn("matched", F.col("matched_entries") > 0)
            .withColumn("reduction", F.when(F.col("matched"), F.lit(REDUCTION)).otherwise(F.lit(0.0))))
