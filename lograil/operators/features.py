"""Fifteen-minute activity windows per (user, device) with twelve features."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograil.operators.context import with_sensitivity
from lograil.operators.history import MINIMUM, completed, history_snapshot, snapshot_totals
from lograil.operators.ordered import DAY, MINUTE, micros, utc_hour

WIDTH = 15 * MINUTE
NAMES = ("login_failures", "successful_logins", "new_device_fraction", "new_app_fraction", "unusual_hour_fraction",
         "distinct_resources", "rare_resource_fraction", "sensitive_reads", "bytes_read", "bytes_written", "usb_bytes",
         "distinct_destinations")
LOGGED = ("login_failures", "successful_logins", "distinct_resources", "sensitive_reads", "bytes_read", "bytes_written",
          "usb_bytes", "distinct_destinations")
WINDOW = ["user_id", "device_id", "window_us"]


def window_start(us: str | Column) -> Column:
    us = F.col(us) if isinstance(us, str) else us
    return us - F.pmod(us, F.lit(WIDTH))


def closed_cutoff(events: DataFrame) -> DataFrame:
    """One row: the end of the last window that holds an event."""
    return events.agg(F.max(window_start(micros()) + F.lit(WIDTH)).alias("closed_us"))


def feature_rows(events: DataFrame, known: DataFrame, resources: DataFrame) -> DataFrame:
    """Events of a user and device with `sensitive` and, for logins and reads, `seen`: null for a value new to the history.

    Works row by row against static tables, so the same function serves batch and stream.
    """
    login = (F.col("action") == "login_success") & completed()
    read = (F.col("action") == "file_read") & completed()
    rows = with_sensitivity(events.where("user_id is not null and device_id is not null"), resources)
    return (rows.withColumn("kind", F.when(login, "app").when(read, "resource"))
            .withColumn("value", F.when(login, F.col("app_id")).when(read, F.col("resource_id")))
            .join(known.withColumnRenamed("n", "seen"), ["user_id", "kind", "value"], "left"))


def window_sums(distinct=F.count_distinct) -> list[Column]:
    """Aggregates over the `feature_rows` of a window."""
    fresh, done = F.col("seen").isNull(), completed()
    login, read = (F.col("action") == "login_success") & done, (F.col("action") == "file_read") & done
    return [F.count("*").alias("event_count"), F.count_if(F.col("action") == "login_failure").alias("login_failures"),
            F.count_if(login).alias("successful_logins"), F.count_if(login & fresh).alias("_new_apps"),
            distinct(F.when(read, F.col("resource_id"))).alias("distinct_resources"),
            F.count_if(read).alias("_reads"), F.count_if(read & fresh).alias("_rare"),
            F.count_if(read & F.col("sensitive")).alias("sensitive_reads"),
            *[F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).alias(c) for c in ("bytes_read", "bytes_written")],
            F.coalesce(F.sum(F.when(done & (F.col("action") == "file_copy_to_usb"), F.col("bytes_written"))), F.lit(0)).alias("usb_bytes"),
            distinct(F.when(done, F.col("dst_ip"))).alias("distinct_destinations")]


def finished_windows(windows: DataFrame, known: DataFrame, totals: DataFrame) -> DataFrame:
    """The twelve features and cold_start from the sums of windows; novelty of device and hour is looked up here."""
    devices = known.where("kind = 'device'").select("user_id", F.col("value").alias("device_id"), F.lit(True).alias("_device"))
    hours = known.where("kind = 'hour'").select("user_id", F.col("value").cast("int").alias("_hour"), F.lit(True).alias("_known_hour"))
    enough = (F.col("logins") >= MINIMUM) & (F.col("reads") >= MINIMUM)
    fraction = lambda part, whole: F.when(F.col("cold_start"), 0.0).otherwise(F.col(part) / F.greatest(F.lit(1), F.col(whole)))
    joined = (windows.withColumn("_hour", utc_hour("window_us")).join(totals, "user_id", "left")
              .join(devices, ["user_id", "device_id"], "left").join(hours, ["user_id", "_hour"], "left")
              .withColumn("cold_start", ~F.coalesce(enough, F.lit(False))))
    absent = lambda flag: F.when(F.col("cold_start") | F.col(flag), 0.0).otherwise(1.0)
    return joined.select(
        *WINDOW, "event_count", "login_failures", "successful_logins",
        absent("_device").alias("new_device_fraction"), fraction("_new_apps", "successful_logins").alias("new_app_fraction"),
        absent("_known_hour").alias("unusual_hour_fraction"), "distinct_resources",
        fraction("_rare", "_reads").alias("rare_resource_fraction"), "sensitive_reads", "bytes_read", "bytes_written",
        "usb_bytes", "distinct_destinations", "cold_start")


def window_features(events: DataFrame, history: DataFrame, resources: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Raw features, cold_start and provisional per window.

    An event belongs to the window of its user, device and quarter hour, so the
    window's key stands for its list of events and no list is collected. Novelty is
    an equi-join with the frozen history, one lookup per event and two per window.
    """
    known = history_snapshot(history)
    if as_of is not None:
        events = events.where(F.col("event_time") <= as_of)
    rows = feature_rows(events, known, resources).withColumn("window_us", window_start(micros()))
    end = F.col("window_us") + F.lit(WIDTH)
    provisional = F.lit(False) if as_of is None else end > F.unix_micros(as_of)
    found = finished_windows(rows.groupBy(*WINDOW).agg(*window_sums()), known, snapshot_totals(history))
    return found.withColumn("provisional", provisional)


def transform_features(windows: DataFrame) -> DataFrame:
    """log1p on counts and byte sums, fractions as they are; adds `vector` in feature order."""
    logged = windows.withColumns({name: F.log1p(F.col(name).cast("double")) for name in LOGGED})
    return logged.withColumn("vector", F.array(*[F.col(name).cast("double") for name in NAMES]))


def unit(us: str = "window_us") -> Column:
    """UTC day of a window: with user and device the unit false alarms are counted in."""
    return F.floor(F.col(us) / F.lit(DAY)).cast("bigint")
