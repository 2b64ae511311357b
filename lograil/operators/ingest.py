"""Ingest as one job: normalise, decide duplicates and conflicts, split into events and quarantine."""
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.operators.normalize import Source, checked_records, dedup_status, union_families
from lograil.session import durable

CONFLICT = "another record of this id is already accepted"
REJECT = ("dataset_id", "record_ref", "file_name", "row_number", "raw_json", "raw_record_sha256", "error")


@dataclass(frozen=True)
class Ingested:
    """All records with `status` (accepted, duplicate, conflict, rejected) and `error`."""
    records: DataFrame

    @property
    def events(self) -> DataFrame:
        return self.records.where("status = 'accepted'").drop("status", "error", "raw_json", "file_name")

    @property
    def rejects(self) -> DataFrame:
        """The quarantine: records that failed a rule, and conflicts with an accepted one."""
        return self.records.where("status in ('rejected', 'conflict')").select(*REJECT)


def ingest(feeds: list[tuple[DataFrame, Source]], order: tuple[str, ...] = ("record_ref",), earlier: DataFrame | None = None) -> Ingested:
    """Raw records of any number of sources, each parsed once, with a status for every record.

    `order` says which record of an id comes first; the reference of the record ends it, so that no
    two records are first. Ids of `earlier` events (event_id, content_sha256) are already accepted.
    """
    checked = union_families([checked_records(raw, source).withColumn("_order", F.struct(*dict.fromkeys((*order, "record_ref")))) for raw, source in feeds])
    stored = durable(checked)
    good = dedup_status(stored.where("error is null"), ["_order"])
    if earlier is not None:
        known = earlier.select("event_id", F.col("content_sha256").alias("_known"))
        same = F.col("_known") == F.col("content_sha256")
        good = good.join(known, "event_id", "left").withColumn(
            "status", F.when(F.col("_known").isNull(), F.col("status")).when(same, "duplicate").otherwise("conflict")).drop("_known")
    good = good.withColumn("error", F.when(F.col("status") == "conflict", CONFLICT))
    bad = stored.where("error is not null").withColumn("status", F.lit("rejected"))
    return Ingested(good.unionByName(bad).drop("_order"))
