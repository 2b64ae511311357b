"""Prior-day history: what an account did on earlier UTC days.

History is reduced to one row per (account, key, day) before any window runs,
so a window never sees more rows than there are days.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograil.operators.ordered import DAY, MINUTE

MINIMUM = 3
LOGIN_COUNTS = ("prior_successful_logins", "same_device_count", "same_app_count", "same_utc_hour_count")


def completed(outcome="outcome") -> Column:
    """An omitted outcome keeps the action's literal meaning; a failure never counts."""
    return F.col(outcome).isNull() | (F.col(outcome) == "success")


def with_time(events: DataFrame) -> DataFrame:
    """Add us (microseconds), day and hour, all UTC."""
    us = "unix_micros(event_time)"
    return events.selectExpr("*", f"{us} as us", f"cast(floor({us} / {DAY}) as bigint) as day",
                             f"cast(floor(pmod({us}, {DAY}) / {60 * MINUTE}) as int) as hour")


def pool(events: DataFrame, history: DataFrame | None, columns: list[str]) -> DataFrame:
    """Rows that define history (n = 1) and rows that only ask for it (n = 0)."""
    own = with_time(events)
    counted = completed().cast("int")
    if history is None:
        return own.select(*columns, counted.alias("n"))
    return (own.select(*columns, F.lit(0).alias("n"))
            .unionByName(with_time(history).select(*columns, counted.alias("n"))))


def earlier_days(rows: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """Per (keys, day), the totals of `sums` (input -> output) over strictly earlier days."""
    daily = rows.groupBy(*keys, "day").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return daily.select(*keys, "day", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name)
                                        for c, name in sums.items()])


def _key(column: str) -> Column:
    # A missing value is a value of its own, as in the comparison it stands for.
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


_CELL = ["user_id", "day", "device_id", "app_id", "hour"]
_KINDS = {"all": None, "device": "device_id", "app": "app_id", "hour": "hour"}
_NAMES = {"all": "prior_successful_logins", "device": "same_device_count", "app": "same_app_count",
          "hour": "same_utc_hour_count", "read": "prior_file_reads"}


def login_cells(events: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(user, day, device, app, hour) -> the four prior counts and `prior_file_reads`.

    All logins of one cell share these counts. Cells and daily reads become lines
    (user, kind, key, day, n); one aggregation and one window over days serve
    every kind of count.
    """
    rows = pool(events, history, [*_CELL, "action"]).where(F.col("user_id").isNotNull())
    cells = rows.where(F.col("action") == "login_success").groupBy(*_CELL).agg(F.sum("n").alias("n"))
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), (_key(c) if c else F.lit("")).alias("key"), F.col("n").alias("n"))
                      for kind, c in _KINDS.items()],
                    F.struct(F.lit("read").alias("kind"), F.lit("").alias("key"), F.lit(0).cast("bigint").alias("n")))
    asked = cells.select(*[F.col(c).alias(f"cell_{c}") for c in _CELL], "user_id", "day", F.inline(kinds))
    reads = (rows.where(F.col("action") == "file_read")
             .select("user_id", F.lit("read").alias("kind"), F.lit("").alias("key"), "day", F.col("n").cast("bigint")))
    lines = asked.select("user_id", "kind", "key", "day", "n").unionByName(reads)
    earlier = earlier_days(lines, ["user_id", "kind", "key"], {"n": "prior"})
    return (asked.drop("n").join(earlier, ["user_id", "kind", "key", "day"])
            .groupBy(*[F.col(f"cell_{c}").alias(c) for c in _CELL])
            .agg(*[F.max(F.when(F.col("kind") == kind, F.col("prior"))).alias(name) for kind, name in _NAMES.items()]))


def unusual(minimum=MINIMUM) -> Column:
    """Enough prior logins, and the device, the application or the hour never seen."""
    return ((F.col("prior_successful_logins") >= minimum)
            & ((F.col("same_device_count") == 0) | (F.col("same_app_count") == 0)
               | (F.col("same_utc_hour_count") == 0)))


def auth_history(events: DataFrame, history: DataFrame | None = None, minimum=MINIMUM, only_unusual=False) -> DataFrame:
    """Login rows with their four prior-day counts and the unusual flag."""
    cells = login_cells(events, history)
    if only_unusual:
        cells = cells.where(unusual(minimum))
    cells = cells.selectExpr(*[f"{c} as _{c}" for c in _CELL], *LOGIN_COUNTS, "prior_file_reads")
    logins = with_time(events.where("action = 'login_success' and user_id is not null"))
    if only_unusual:
        logins = logins.where(completed())
    same = F.expr("user_id = _user_id and day = _day and hour = _hour and device_id <=> _device_id and app_id <=> _app_id")
    return logins.join(cells, same).select(*logins.columns, *LOGIN_COUNTS, "prior_file_reads",
                                           (completed() & unusual(minimum)).alias("unusual"))


def first_read_days(events: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(user, resource) -> first UTC day of a completed read in the history."""
    source = with_time(events if history is None else history)
    return (source.where((F.col("action") == "file_read") & completed())
            .groupBy("user_id", "resource_id").agg(F.min("day").alias("first_day")))


def resource_counts(asked: DataFrame, events: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(user_id, resource_id, day) asked for -> reads of that resource on earlier days."""
    source = with_time(events if history is None else history)
    reads = (source.where((F.col("action") == "file_read") & completed())
             .select("user_id", "resource_id", "day", F.lit(1).alias("n")))
    asked = asked.select("user_id", "resource_id", "day").distinct()
    counts = earlier_days(reads.unionByName(asked.withColumn("n", F.lit(0))),
                          ["user_id", "resource_id"], {"n": "same_resource_count"})
    return asked.join(counts, ["user_id", "resource_id", "day"])


def read_novelty(events: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Completed reads on days with a login: earlier reads, and earlier reads of the same resource."""
    own = with_time(events)
    days = own.where(F.col("action") == "login_success").select("user_id", "day").distinct()
    reads = own.where((F.col("action") == "file_read") & completed()).join(days, ["user_id", "day"], "left_semi")
    source = (own if history is None else with_time(history)).where((F.col("action") == "file_read") & completed())
    totals = earlier_days(source.select("user_id", "day", F.lit(1).alias("n")).unionByName(days.withColumn("n", F.lit(0))),
                          ["user_id"], {"n": "prior_file_reads"})
    return (reads.join(resource_counts(reads, events, history), ["user_id", "resource_id", "day"])
            .join(totals, ["user_id", "day"]))


def pair_novelty(pairs: DataFrame, events: DataFrame, history: DataFrame | None = None, minimum=MINIMUM) -> DataFrame:
    """Pairs of a login and a read with the account's reads before the day of the login.

    `pairs` has user_id, resource_id (of the read) and day (of the login), none of them null; adds prior_file_reads,
    same_resource_count and `novel`: enough earlier reads, and none of this resource. A read on a later day than its
    login is judged by the login's day.
    """
    source = with_time(events if history is None else history).where((F.col("action") == "file_read") & completed())
    asked = pairs.select("user_id", "day").distinct().withColumn("n", F.lit(0))
    totals = earlier_days(source.select("user_id", "day", F.lit(1).alias("n")).unionByName(asked), ["user_id"], {"n": "prior_file_reads"})
    return (pairs.join(resource_counts(pairs, events, history), ["user_id", "resource_id", "day"]).join(totals, ["user_id", "day"])
            .withColumn("novel", (F.col("prior_file_reads") >= minimum) & (F.col("same_resource_count") == 0)))


def established_users(events: DataFrame, minimum=MINIMUM) -> DataFrame:
    """Every account with whether any of its logins, failed or not, had enough history."""
    rows = (with_time(events).where(F.col("user_id").isNotNull())
            .withColumn("login", (F.col("action") == "login_success").cast("int"))
            .withColumn("n", F.col("login") * completed().cast("int")))
    daily = rows.groupBy("user_id", "day").agg(F.sum("n").alias("n"), F.max("login").alias("login"))
    earlier = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return (daily.withColumn("prior", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
            .groupBy("user_id").agg(F.max((F.col("login") == 1) & (F.col("prior") >= minimum)).alias("established")))


def history_snapshot(events: DataFrame) -> DataFrame:
    """Frozen per-account values: (user_id, kind, value, n).

    Kinds are device, app and hour of completed logins and resource of completed
    reads. Rows instead of per-account sets: an account with many values stays
    distributed, and each lookup is an equi-join on (user_id, value).
    """
    login, read = F.col("action") == "login_success", F.col("action") == "file_read"
    entries = F.array(*[F.struct(F.lit(kind).alias("kind"), F.when(when, F.col(column).cast("string")).alias("value"))
                        for kind, column, when in (("device", "device_id", login), ("app", "app_id", login),
                                                   ("hour", "hour", login), ("resource", "resource_id", read))])
    return (with_time(events).where(F.col("user_id").isNotNull() & completed() & (login | read))
            .select("user_id", F.inline(entries)).where("value is not null")
            .groupBy("user_id", "kind", "value").agg(F.count("*").alias("n")))


def snapshot_totals(events: DataFrame) -> DataFrame:
    """(user_id, logins, reads) over completed observations."""
    return (events.where(F.col("user_id").isNotNull() & completed()).groupBy("user_id")
            .agg(F.count_if(F.col("action") == "login_success").alias("logins"),
                 F.count_if(F.col("action") == "file_read").alias("reads")))
