"""Windowed features, rule and indicator hits, and mount joins on streams."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.operators.features import feature_rows, finished_windows, window_sums
from lograil.operators.history import completed, history_snapshot, snapshot_totals
from lograil.operators.hunts import Rule, sigma_scan
from lograil.operators.intel import group_hits


def stream_features(events: DataFrame, history: DataFrame, resources: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """The features of `window_features` per (user, device) and quarter hour, against a frozen history and labels.

    Append mode emits closed windows only, update mode also the provisional ones. Distinct counts come from sets, which
    a quarter hour bounds; streams allow no exact distinct aggregate. Novelty and labels are joined as static tables,
    per event before the window and per window behind it.
    """
    known, totals = history_snapshot(history), snapshot_totals(history)
    rows = feature_rows(events.withWatermark("event_time", delay), known, resources)
    windows = (rows.groupBy("user_id", "device_id", F.window("event_time", "15 minutes").alias("w"))
               .agg(*window_sums(lambda column: F.size(F.collect_set(column)).cast("bigint")))
               .withColumn("window_us", F.unix_micros("w.start")).drop("w"))
    return finished_windows(windows, known, totals)


def stream_rule_hits(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rule hits row by row, without state."""
    return sigma_scan(events, rules)


def stream_indicator_hits(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """Indicator hits by joining the stream with the static indicator table."""
    return group_hits(events, indicators)


def stream_mount_join(copies: DataFrame, mounts: DataFrame, window: str = "60 minutes", delay: str = "30 minutes") -> DataFrame:
    """Copies with each completed mount of the same user, device and medium in [t - window, t).

    Both sides carry a watermark, so rows leave the state once the range is over.
    """
    left = copies.where(completed()).select("user_id", "device_id", "removable_device_id", F.col("event_id").alias("copy_id"),
                                            F.col("event_time").alias("copy_time")).withWatermark("copy_time", delay)
    right = mounts.where(completed()).select(
        F.col("user_id").alias("_user"), F.col("device_id").alias("_device"), F.col("removable_device_id").alias("_medium"),
        F.col("event_id").alias("mount_id"), F.col("event_time").alias("mount_time")).withWatermark("mount_time", delay)
    same = ((F.col("user_id") == F.col("_user")) & (F.col("device_id") == F.col("_device"))
            & (F.col("removable_device_id") == F.col("_medium")))
    near = (F.col("mount_time") < F.col("copy_time")) & (F.col("mount_time") >= F.col("copy_time") - F.expr(f"interval {window}"))
    return left.join(right, same & near).select("copy_id", "copy_time", "mount_id", "mount_time")
