"""Accepted, duplicate and conflicting records of a stream, judged by keyed state."""
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

JUDGED = "event_id string, content_sha256 string, place string, body string, status string"


class FirstRecords(StatefulProcessor):
    """Keeps the content hash of the first record of every id; a key is a bucket of ids.

    State is one short row an id. With `keep` (milliseconds) the store itself drops it so long after
    the first record, and a later record of the id is a first one again.
    """

    def __init__(self, keep: int | None):
        self.keep = keep

    def init(self, handle) -> None:
        self.first = handle.getMapState("first", "event_id string", "content_sha256 string", self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["event_id", "place"], kind="stable")
        head = ~batch.event_id.duplicated()
        ids, contents, known = batch.event_id[head], batch.content_sha256[head], {}
        fresh = set()
        for event_id, content in zip(ids, contents):
            stored = self.first.getValue((event_id,))
            if stored is None:
                self.first.updateValue((event_id,), (content,))
                fresh.add(event_id)
            known[event_id] = content if stored is None else stored[0]
        same = batch.content_sha256 == batch.event_id.map(known)
        batch["status"] = same.map({True: "duplicate", False: "conflict"})
        batch.loc[head & batch.event_id.isin(fresh), "status"] = "accepted"
        yield batch[["event_id", "content_sha256", "place", "body", "status"]]

    def close(self) -> None:
        pass


def stream_status(records: DataFrame, place: str = "record_ref", keep: int | None = None, buckets: int = 1024) -> DataFrame:
    """`records` with `status`: accepted, duplicate or conflict, as `dedup_status` gives it.

    The first record of an id is the one of the earliest micro-batch, in it the one with the least `place`
    (text). Only ids, hashes and one text of the whole row pass through Python; rows are restored from it, so no
    value changes its type on the way. Earlier records are looked up by id in the state store and never read again.
    """
    # The whole row as text: its struct as JSON, restored by the same schema.
    names = records.columns
    body = F.to_json(F.struct(*[F.col(n) for n in names]), {"ignoreNullFields": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    slim = records.select(F.pmod(F.xxhash64("event_id"), F.lit(buckets)).alias("bucket"), F.col("event_id").cast("string").alias("event_id"),
                          "content_sha256", F.col(place).cast("string").alias("place"), body.alias("body"))
    mode = "ProcessingTime" if keep else "None"
    judged = slim.groupBy("bucket").transformWithStateInPandas(FirstRecords(keep), JUDGED, "Append", mode)
    row = F.from_json("body", records.schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return judged.select(row.alias("row"), "status").select("row.*", "status")


def stream_dedup(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First row per event id; state is dropped once the watermark passes it."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])
