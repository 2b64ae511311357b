"""Activity bursts per actor; the same code runs on batch and stream."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "60 minutes") -> DataFrame:
    """Sessions of (user, device): a pause longer than `gap` starts the next one."""
    return (events.groupBy("user_id", "device_id", F.session_window("event_time", gap).alias("session"))
            .agg(F.count("*").alias("events"))
            .select("user_id", "device_id", F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "events"))
