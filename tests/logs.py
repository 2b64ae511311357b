"""Small hand-written logs."""
from datetime import datetime, timedelta, timezone

from pyspark.sql import types as T

START = datetime(2026, 1, 1, 9, tzinfo=timezone.utc)
COLUMNS = {"event_id": T.StringType(), "event_time": T.TimestampType(), "source_type": T.StringType(), "action": T.StringType(),
           "user_id": T.StringType(), "device_id": T.StringType(), "app_id": T.StringType(), "resource_id": T.StringType(),
           "removable_device_id": T.StringType(), "outcome": T.StringType(), "destination_type": T.StringType(),
           "bytes_read": T.LongType(), "bytes_written": T.LongType(), "src_ip": T.StringType(), "dst_ip": T.StringType(),
           "domain": T.StringType(), "file_hash": T.StringType()}
SCHEMA = T.StructType([T.StructField(n, t) for n, t in COLUMNS.items()])
LABEL = T.StructType([T.StructField("resource_id", T.StringType()), T.StructField("sensitive", T.BooleanType()),
                      T.StructField("effective_from", T.TimestampType()), T.StructField("effective_until", T.TimestampType())])


def event(event_id, minutes, action, **fields):
    family = {"login_success": "auth", "login_failure": "auth", "usb_mount": "device", "usb_unmount": "device"}.get(action, "file")
    row = dict.fromkeys(COLUMNS)
    row.update(event_id=event_id, event_time=START + timedelta(minutes=minutes), action=action, source_type=family, user_id="u", device_id="d1")
    row.update(fields)
    return row


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SCHEMA)


def labels(spark, *resources, start=START - timedelta(days=30), end=None):
    return spark.createDataFrame([(r, True, start, end) for r in resources], LABEL)


DAY5 = 5 * 24 * 60


def history():
    """Five ordinary days of one user on d1."""
    rows = []
    for day in range(5):
        rows.append(event(f"h{day}l", day * 1440, "login_success", app_id="a1"))
        rows.append(event(f"h{day}r", day * 1440 + 5, "file_read", resource_id="work", bytes_read=10))
    return rows


def attack():
    """Login from a new device, read of a labelled file, mount, copy."""
    return {"login": event("login", DAY5, "login_success", app_id="a1", device_id="d2"),
            "read": event("read", DAY5 + 10, "file_read", resource_id="secret", device_id="d2", bytes_read=5),
            "mount": event("mount", DAY5 + 15, "usb_mount", removable_device_id="m", device_id="d2"),
            "copy": event("copy", DAY5 + 20, "file_copy_to_usb", resource_id="secret", device_id="d2", removable_device_id="m",
                          destination_type="removable_media", bytes_written=2048)}
