"""Chain detector: unusual login -> novel sensitive read -> copy to removable media.

A login's own candidate never depends on earlier episodes, so candidates are
computed set-wise and only keeping them is sequential (`episodes`).
"""
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.operators.context import sensitive_reads
from lograil.operators.history import MINIMUM, auth_history, completed, first_read_days, with_time
from lograil.operators.ordered import DAY, MINUTE, count_within, nearest, nearest_within
from lograil.session import durable

RULE_VERSION = "login-read-copy/1"
ACTOR = ["user_id", "device_id"]


@dataclass(frozen=True)
class Chain:
    """Detector settings; `window` bounds the chain, `mount` the look-back to the mount."""
    window: int = 60 * MINUTE
    mount: int = 60 * MINUTE
    minimum: int = MINIMUM


def eligible_copies(events: DataFrame) -> DataFrame:
    return with_time(events.where(F.expr(
        "action = 'file_copy_to_usb' and destination_type = 'removable_media' and bytes_written > 0") & completed()))


def asof_mount(copies: DataFrame, events: DataFrame, look_back: int) -> DataFrame:
    """Latest completed mount of the copy's user, device and medium in [t - look_back, t).

    Adds mount_us and mount_id, null when there is none.
    """
    mounts = with_time(events.where((F.col("action") == "usb_mount") & completed())).selectExpr(
        *ACTOR, "removable_device_id", "us", "struct(us as at, event_id as id) as mount")
    found = nearest_within(copies, mounts, [*ACTOR, "removable_device_id"], "us", ["mount"], look_back)
    near = f"mount.at >= us - {look_back}"
    return found.selectExpr(*copies.columns, f"case when {near} then mount.at end as mount_us",
                            f"case when {near} then mount.id end as mount_id")


def active_mount(copies: DataFrame, events: DataFrame, look_back: int) -> DataFrame:
    """Copies whose latest mount has no unmount of that device and medium in [mount, copy].

    The latest unmount at or before the copy decides: earlier ones precede it.
    """
    unmounts = with_time(events.where((F.col("action") == "usb_unmount") & completed())).selectExpr(
        "device_id", "removable_device_id", "us", "struct(us as at) as unmount")
    mounted = asof_mount(copies, events, look_back).where("mount_us is not null")
    found = nearest_within(mounted, unmounts, ["device_id", "removable_device_id"], "us", ["unmount"],
                           look_back, inclusive=True)
    return found.where("unmount is null or unmount.at < mount_us").drop("unmount")


def _login_days(window: int) -> str:
    """UTC days on which a login can be that this read or copy still answers."""
    return f"explode(sequence(day - {-(-window // DAY)}, least(day, first_day))) as login_day"


def candidates(events: DataFrame, resources: DataFrame, config: Chain = Chain(),
               history: DataFrame | None = None) -> DataFrame:
    """One row per unusual login with a qualifying read, before episode thinning.

    A read answers a login when it is sensitive, follows within the window, and
    its resource was not read before the login's UTC day. A copy answers it when
    an active mount is attached and a qualifying read of its resource lies between.
    Both are found by nearest-event passes keyed by (user, device, login day).
    """
    back, w = -(-config.window // DAY), config.window
    counts = ["prior_successful_logins", "same_device_count", "same_app_count", "same_utc_hour_count", "prior_file_reads"]
    logins = (auth_history(events, history, config.minimum, only_unusual=True)
              .where(f"device_id is not null and prior_file_reads >= {config.minimum}")
              .selectExpr(*ACTOR, "day", "day as login_day", "app_id", "event_id as login_id", "us as login_us", *counts))
    reads = with_time(sensitive_reads(events.where("user_id is not null and device_id is not null"), resources)).select(
        *ACTOR, "resource_id", "event_id", "us", "day")
    # Without a matching history row (frozen history) the resource was never read.
    # First-days reads of sensitive resources are few and serve three passes.
    novel = durable(reads.join(first_read_days(events, history), ["user_id", "resource_id"], "left")
                    .selectExpr(*reads.columns, "coalesce(first_day, day) as first_day").where(f"first_day >= day - {back}"))
    read_marks = novel.selectExpr(*ACTOR, _login_days(w), "us as login_us", "struct(us as at, event_id as id, resource_id) as read")
    copies = active_mount(
        eligible_copies(events).select(*ACTOR, "removable_device_id", "resource_id", "event_id", "us", "day",
                                       "bytes_written"), events, config.mount)
    # The latest qualifying read before the copy: the copy answers exactly the logins before that read.
    read_times = novel.selectExpr(*ACTOR, "resource_id", "us", "struct(us as at, first_day) as last_read")
    answered = nearest_within(copies, read_times, [*ACTOR, "resource_id"], "us", ["last_read"], w).where(
        f"last_read.first_day >= day - {back}")
    copy_marks = (answered.selectExpr("*", "last_read.first_day as first_day").selectExpr(
        *ACTOR, _login_days(w), "last_read.at as login_us",
        "struct(us as at, event_id as id, resource_id, removable_device_id, bytes_written, mount_id, mount_us) as copy"))
    marks = read_marks.unionByName(copy_marks, allowMissingColumns=True)
    found = (nearest_within(logins, marks, [*ACTOR, "login_day"], "login_us", ["read", "copy"], w, forward=True)
             .where(f"read.at <= login_us + {w}")
             .selectExpr(*logins.columns, "read", f"case when copy.at <= login_us + {w} then copy end as copy")
             .selectExpr("*", "copy.resource_id as resource_id"))
    # The episode cites the first qualifying read of the copied resource.
    own_reads = novel.selectExpr(*ACTOR, "resource_id", "us as login_us", "struct(us as at, event_id as id) as own_read")
    matched = nearest_within(found, own_reads, [*ACTOR, "resource_id"], "login_us", ["own_read"], w, forward=True)
    chosen = lambda own, first: f"case when copy is not null then {own} else {first} end"
    return matched.selectExpr(
        *ACTOR, "day", "app_id", "login_id", "login_us", *counts, "read.id as first_read_id", "read.at as first_read_us",
        chosen("own_read.id", "read.id") + " as read_id", chosen("own_read.at", "read.at") + " as read_us",
        chosen("copy.resource_id", "read.resource_id") + " as resource_id", "copy.id as copy_id", "copy.at as copy_us",
        "copy.bytes_written as bytes_written", "copy.removable_device_id as removable_device_id",
        "copy.mount_id as mount_id", "copy.mount_us as mount_us", "coalesce(copy.at, read.at) as end_us")


def episodes(rows: DataFrame, keys: list[str] = ACTOR) -> DataFrame:
    """Keep a candidate only when it starts after the end of the last one kept.

    The kept chain of each key is followed by pointer doubling over distributed rows, whatever the
    size of a key's group; the loop sees two counts a round.
    """
    return _chained(durable(rows), keys)


def _chained(rows: DataFrame, keys: list[str]) -> DataFrame:
    start = F.struct(F.col("login_us").alias("at"), F.col("login_id").alias("id"))
    starts = rows.select(*keys, F.col("login_us").alias("end_us"), start.alias("next"))
    # `hop` jumps 2^k kept candidates ahead after round k, `reached` holds the first 2^k behind each head.
    hop = durable(nearest(rows.select(*keys, "login_id", "end_us"), starts, keys, "end_us", ["next"], forward=True)
                  .where("next is not null").select(*keys, F.col("login_id").alias("source"),
                                                    F.col("next.id").alias("target")))
    reached = durable(_heads(rows, keys))
    known = reached.count()
    while True:
        ahead = reached.withColumnRenamed("login_id", "source").join(hop, [*keys, "source"]).select(
            *keys, F.col("target").alias("login_id"))
        reached = durable(reached.unionByName(ahead).distinct())
        now = reached.count()
        if now == known:
            break
        known = now
        onward = hop.selectExpr(*keys, "source as target", "target as beyond")
        hop = durable(hop.join(onward, [*keys, "target"]).select(*keys, "source", F.col("beyond").alias("target")))
    return rows.join(reached, [*keys, "login_id"], "left_semi").select(*rows.columns)


def _heads(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that begin after the end of every earlier one of their key: surely kept.

    They cut a key's chain into short pieces that are followed side by side.
    """
    ends = rows.select(*keys, "login_us", F.col("end_us").alias("until"))
    first = rows.groupBy(*keys, "login_us").agg(F.min("login_id").alias("login_id"))
    return (nearest(first, ends, keys, "login_us", ["until"]).where("until is null or until < login_us")
            .select(*keys, "login_id"))


def scored(rows: DataFrame) -> DataFrame:
    """Stage count, structural risk, decision, evidence and candidate id of each episode."""
    complete = F.col("copy_id").isNotNull()
    evidence = F.sort_array(F.array_distinct(F.array_compact(F.array(
        *[F.col(c).cast("string") for c in ("login_id", "read_id", "copy_id", "mount_id")]))))
    head = F.to_json(F.array(F.lit(RULE_VERSION), F.col("user_id"), F.col("device_id")))
    identity = F.concat(F.rtrim(head, F.lit("]")), F.lit(","), F.to_json("selected"), F.lit("]"))
    return (rows.withColumn("selected", evidence)
            .withColumn("stages", F.when(complete, 3).otherwise(2))
            .withColumn("score", F.when(complete, F.lit(100.0)).otherwise(F.lit(60.0)))
            .withColumn("decision", F.when(complete, "incident").otherwise("partial_observation"))
            .withColumn("candidate_id", F.substring(F.sha2(identity, 256), 1, 24)))


def detect(events: DataFrame, resources: DataFrame, config: Chain = Chain(),
           history: DataFrame | None = None) -> DataFrame:
    """Rules-only detector: one row per non-overlapping episode."""
    return scored(episodes(candidates(events, resources, config, history)))


def first_match(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order, as a partial aggregate instead of a sort."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return (rows.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first"))
            .select(*keys, "_first.*"))


def stage_rows(found: DataFrame) -> DataFrame:
    """Long form: candidate, stage, evidence event, time and claim status."""
    row = lambda name, at, event, claim: F.struct(
        F.lit(name).alias("stage_id"), F.col(event).cast("string").alias("event_id"), F.col(at).alias("us"),
        F.lit(claim).alias("claim_status"))
    stages = F.array(row("authentication", "login_us", "login_id", "supported_inference"),
                     row("collection", "read_us", "read_id", "supported_inference"),
                     row("transfer", "copy_us", "copy_id", "observed"))
    return (found.select("candidate_id", *ACTOR, "app_id", "resource_id", "removable_device_id", "bytes_written",
                         "decision", F.inline(stages)).where("event_id is not null"))


def evidence(found: DataFrame) -> DataFrame:
    """(candidate, cited event) pairs, stage and context evidence together."""
    return found.select("candidate_id", F.explode("selected").alias("event_id")).distinct()


def reads_after(events: DataFrame, window: int) -> DataFrame:
    """Per login, the number of completed reads of the same actor and endpoint in (t, t + window] and the first one."""
    rows = with_time(events).where(F.col("user_id").isNotNull() & F.col("device_id").isNotNull())
    logins = rows.where(F.col("action") == "login_success").select(*ACTOR, F.col("event_id").alias("login_id"), "us")
    reads = rows.where((F.col("action") == "file_read") & completed())
    marks = reads.select(*ACTOR, "us", F.struct(F.col("us").alias("at"), F.col("event_id").alias("id")).alias("read"))
    counts = count_within(logins, reads, ACTOR, "login_id", "us", window, "reads_within")
    first = nearest_within(logins, marks, ACTOR, "us", ["read"], window, forward=True)
    near = F.col("read.at") <= F.col("us") + F.lit(window)
    return counts.join(first.select("login_id", F.when(near, F.col("read.at")).alias("first_read_us"),
                                    F.when(near, F.col("read.id")).alias("first_read_id")), "login_id")


def match_read(events: DataFrame, window: int) -> DataFrame:
    """Per eligible copy, the first completed read of its resource in [t - window, t).

    The read is found forward from just before the window opens.
    """
    reads = (with_time(events).where((F.col("action") == "file_read") & completed())
             .select(*ACTOR, "resource_id", F.col("us").alias("opens"),
                     F.struct(F.col("us").alias("at"), F.col("event_id").alias("id")).alias("read")))
    copies = (eligible_copies(events).select(*ACTOR, "resource_id", F.col("event_id").alias("copy_id"), "us")
              .withColumn("opens", F.col("us") - F.lit(window + 1)))
    return (nearest_within(copies, reads, [*ACTOR, "resource_id"], "opens", ["read"], window + 1, forward=True)
            .where(F.col("read.at") < F.col("us"))
            .select("copy_id", F.col("read.id").alias("read_id"), F.col("read.at").alias("read_us")))


def history_probes(events: DataFrame, config: Chain = Chain(), history: DataFrame | None = None) -> DataFrame:
    """For each login its unusual flag, and for the first read that follows whether it is novel."""
    probes = auth_history(events, history, config.minimum).select(
        *ACTOR, "event_id", "us", "day", "prior_file_reads", F.col("unusual").alias("login_unusual"))
    reads = (with_time(events).where((F.col("action") == "file_read") & completed())
             .select(*ACTOR, "us", F.struct(F.col("us").alias("at"), F.col("event_id").alias("id"), "resource_id").alias("read")))
    first = nearest_within(probes, reads, ACTOR, "us", ["read"], config.window, forward=True)
    found = first.withColumn("read", F.when(F.col("read.at") <= F.col("us") + F.lit(config.window), F.col("read")))
    found = found.withColumn("resource_id", F.col("read.resource_id")).join(
        first_read_days(events, history), ["user_id", "resource_id"], "left")
    novel = (F.col("prior_file_reads") >= config.minimum) & F.coalesce(F.col("first_day") >= F.col("day"), F.lit(True))
    return found.select("event_id", "login_unusual", F.col("read.id").alias("read_id"),
                        F.when(F.col("read").isNotNull(), novel).alias("read_unusual"))
