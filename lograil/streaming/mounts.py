"""Copies with the mount that was active, on a stream."""
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from lograil.operators.chain import Chain
from lograil.operators.history import completed, with_time
from lograil.streaming.slots import WIDTH, Slots

MOUNT_STEP = ["device_id", "removable_device_id", "user_id", "event_id", "event_time", "us", "kind", "resource_id", "bytes_written"]
COPIES = T.StructType([T.StructField(name, kind) for name, kind in (
    ("device_id", T.StringType()), ("removable_device_id", T.StringType()), ("user_id", T.StringType()), ("event_id", T.StringType()), ("us", T.LongType()),
    ("resource_id", T.StringType()), ("mount_id", T.StringType()), ("mount_us", T.LongType()), ("event_time", T.TimestampType()))])
ORDER = {"unmount": 0, "copy": 1, "mount": 2}      # of equal times: an unmount counts for a copy, a mount does not


class ActiveMounts(StatefulProcessor):
    """Keyed by (device, medium): the last mount of each user and the last unmount, moved on in event order.

    State is what the watermark has not passed, one mount a user and one time. Emitted rows carry the watermark as
    their event time, so that another stateful operator may follow; `us` stays the copy's own time.
    """

    def __init__(self, look_back: int):
        self.look_back = look_back

    def init(self, handle) -> None:
        self.slots = Slots(handle, "steps", "us bigint, kind string, user_id string, event_id string, resource_id string")
        self.mounted = handle.getMapState("mounted", "user_id string", "us bigint, event_id string")
        self.unmounted = handle.getValueState("unmounted", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        for slot, part in batch.groupby(batch.us // WIDTH):
            columns = (part.us.tolist(), part.kind.tolist(), part.user_id.tolist(), part.event_id.tolist(), part.resource_id.tolist())
            self.slots.add(int(slot), list(zip(*columns)), (int(slot) + 1) * WIDTH)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        slot = expiredTimerInfo.getExpiryTimeInMs() * 1000 // WIDTH - 1
        found, ended = [], self.unmounted.get()
        ended = ended[0] if ended else None
        for us, kind, user, event, resource in sorted(self.slots.read(slot), key=lambda s: (s[0], ORDER[s[1]], s[3])):
            if kind == "unmount":
                ended = us
            elif kind == "mount":
                self.mounted.updateValue((user,), (us, event))
            else:
                mount = self.mounted.getValue((user,))
                if mount and mount[0] >= us - self.look_back and (ended is None or ended < mount[0]):
                    found.append((*key[:2], user, event, us, resource, mount[1], mount[0]))
        self.slots.drop(slot)
        if ended is not None:
            self.unmounted.update((ended,))
        if found:
            now = datetime.fromtimestamp(timerValues.getCurrentWatermarkInMs() / 1000 + 0.001, timezone.utc).replace(tzinfo=None)
            yield pd.DataFrame([(*row, now) for row in found], columns=[f.name for f in COPIES.fields])

    def close(self) -> None:
        pass


def stream_active_mount(steps: DataFrame, config: Chain = Chain()) -> DataFrame:
    """Copies whose user has the medium mounted at the device, one row a copy, as `active_mount` finds them.

    `steps` (device_id, removable_device_id, user_id, event_id, event_time, us, kind, resource_id) carries a watermark on
    event_time; a copy is settled when the watermark has passed its minute. Needs the RocksDB state store.
    """
    rows = steps.where(F.col("kind").isin(*ORDER)).select(*[c for c in MOUNT_STEP if c in steps.columns])
    return (rows.groupBy("device_id", "removable_device_id")
            .transformWithStateInPandas(ActiveMounts(config.mount), COPIES, "Append", "EventTime", eventTimeColumnName="event_time"))


def mount_steps(events: DataFrame) -> DataFrame:
    """Completed copies to removable media, mounts and unmounts of `events`, ready for `stream_active_mount`."""
    copy = (F.col("action") == "file_copy_to_usb") & (F.col("destination_type") == "removable_media") & (F.col("bytes_written") > 0)
    kind = F.when(copy, "copy").when(F.col("action") == "usb_mount", "mount").when(F.col("action") == "usb_unmount", "unmount")
    rows = with_time(events).withColumn("kind", kind).where(completed() & F.col("kind").isNotNull())
    # As in a join, a null key meets nothing.
    keyed = rows.where(F.col("device_id").isNotNull() & F.col("removable_device_id").isNotNull() & (F.col("user_id").isNotNull() | (F.col("kind") == "unmount")))
    return keyed.withColumn("event_id", F.col("event_id").cast("string")).select(*MOUNT_STEP)
