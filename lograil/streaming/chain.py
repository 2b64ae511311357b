"""The chain detector on a stream, against a history frozen per batch run."""
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from lograil.operators.chain import Chain
from lograil.operators.context import with_sensitivity
from lograil.operators.history import completed, history_snapshot, snapshot_totals, unusual, with_time
from lograil.streaming.mounts import stream_active_mount
from lograil.streaming.slots import WIDTH, Slots

STEP = ["device_id", "user_id", "event_id", "event_time", "us", "kind", "resource_id", "removable_device_id", "bytes_written"]
FOUND = T.StructType([T.StructField(name, kind) for name, kind in (
    ("user_id", T.StringType()), ("device_id", T.StringType()), ("login_id", T.StringType()), ("read_id", T.StringType()),
    ("copy_id", T.StringType()), ("mount_id", T.StringType()), ("decision", T.StringType()))])


def chain_steps(events: DataFrame, history: DataFrame, resources: DataFrame, minimum: int = 3) -> DataFrame:
    """Keep only what can be a step: unusual logins, novel sensitive reads, copies, mounts, unmounts.

    Stateless. History is another, earlier period, joined as static tables, so the
    same function serves batch and stream.
    """
    known = history_snapshot(history)
    values = lambda kind, name, flag: known.where(F.col("kind") == kind).select(
        "user_id", F.col("value").alias(name), F.lit(1).alias(flag))
    totals = snapshot_totals(history).withColumnsRenamed({"logins": "prior_successful_logins", "reads": "prior_file_reads"})
    rows = (with_sensitivity(with_time(events).withColumn("hour", F.col("hour").cast("string")), resources)
            .join(totals, "user_id", "left")
            .join(values("device", "device_id", "same_device_count"), ["user_id", "device_id"], "left")
            .join(values("app", "app_id", "same_app_count"), ["user_id", "app_id"], "left")
            .join(values("hour", "hour", "same_utc_hour_count"), ["user_id", "hour"], "left")
            .join(values("resource", "resource_id", "seen"), ["user_id", "resource_id"], "left")
            .na.fill(0, ["prior_successful_logins", "prior_file_reads", "same_device_count", "same_app_count",
                         "same_utc_hour_count", "seen"]))
    action, enough = F.col("action"), F.col("prior_file_reads") >= minimum
    kind = (F.when((action == "login_success") & unusual(minimum) & enough, "login")
            .when((action == "file_read") & F.col("sensitive") & (F.col("seen") == 0) & enough, "read")
            .when((action == "file_copy_to_usb") & (F.col("destination_type") == "removable_media") & (F.col("bytes_written") > 0), "copy")
            .when(action == "usb_mount", "mount").when(action == "usb_unmount", "unmount"))
    return (rows.withColumn("kind", kind).where(completed() & F.col("kind").isNotNull() & F.col("device_id").isNotNull() & (F.col("user_id").isNotNull() | (F.col("kind") == "unmount")))
            .withColumn("event_id", F.col("event_id").cast("string")).select(*STEP))


class ChainProcessor(StatefulProcessor):
    """Waits until a login's window is behind the watermark, then settles the logins of its minute in event order.

    Keyed by (device, user); copies come with their active mount. State holds the steps of at most one window,
    by minute, and the end of the last episode.
    """

    def __init__(self, config: Chain):
        self.config = config

    def init(self, handle) -> None:
        self.slots = Slots(handle, "steps", "us bigint, event_id string, kind string, resource_id string, mount_id string")
        self.until = handle.getValueState("until", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        for slot, part in batch.groupby(batch.us // WIDTH):
            columns = (part.us.tolist(), part.event_id.tolist(), part.kind.tolist(), part.resource_id.tolist(), part.mount_id.tolist())
            self.slots.add(int(slot), list(zip(*columns)), self._due(int(slot)))
        return iter(())

    def _due(self, slot: int) -> int:
        # A minute more than the window: copies come when the watermark has passed their own minute.
        return (slot + 2) * WIDTH + self.config.window

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        slot = (expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.config.window) // WIDTH - 2
        logins = sorted(s for s in self.slots.read(slot) if s[2] == "login")
        until, window, found = self.until.get(), None, []
        until = until[0] if until else None
        for login in logins:
            if until is not None and login[0] <= until:
                continue
            if window is None:      # read once for all logins of the minute
                last = slot + -(-self.config.window // WIDTH)
                window = sorted((s for at in range(slot, last + 1) for s in self.slots.read(at) if s[2] != "login"), key=lambda s: s[:2])
            hit = self._settle(login, window)
            if hit:
                read, copy = hit
                until = (copy or read)[0]
                found.append((key[1], key[0], login[1], read[1], copy and copy[1], copy and copy[4], "incident" if copy else "partial_observation"))
        self.slots.drop(slot)
        if until is not None:
            self.until.update((until,))
        if found:
            yield pd.DataFrame(found, columns=[f.name for f in FOUND.fields])

    def _settle(self, login, window):
        """The read and, if there is one, the copy that answer a login; the read is the first of the copied resource."""
        first, reads = None, {}
        for step in window[bisect_right(window, login[0], key=lambda s: s[0]):]:
            if step[0] > login[0] + self.config.window:
                break
            if step[2] == "read":
                first = first or step
                reads.setdefault(step[3], step)
            elif step[3] in reads and reads[step[3]][0] < step[0]:
                return reads[step[3]], step
        return first and (first, None)

    def close(self) -> None:
        pass


def stream_chain(steps: DataFrame, config: Chain = Chain(), delay: str = "30 minutes") -> DataFrame:
    """Episodes whose window has closed, as `detect` would find them. Needs the RocksDB state store.

    Two stateful operators: active mounts by (device, medium), for an unmount by any user ends a mount; then
    episodes by (device, user).
    """
    marked = steps.withWatermark("event_time", delay)
    same = ["device_id", "user_id", "event_id", "event_time", "us", "kind", "resource_id", "mount_id"]
    copies = stream_active_mount(marked, config).withColumn("kind", F.lit("copy"))
    others = marked.where(F.col("kind").isin("login", "read")).withColumn("mount_id", F.lit(None).cast("string"))
    return (others.select(*same).union(copies.select(*same)).groupBy("device_id", "user_id")
            .transformWithStateInPandas(ChainProcessor(config), FOUND, "Append", "EventTime"))
