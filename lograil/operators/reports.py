"""Evidence drill-down, provenance, privacy, reports."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Event columns left out of reports unless raw material is asked for.
PRIVATE = ("file_path", "process_name", "src_ip", "dst_ip", "domain", "geo_country", "geo_latitude", "geo_longitude")


def redact(events: DataFrame) -> DataFrame:
    return events.drop(*PRIVATE)


def events_by_ids(events: DataFrame, ids: DataFrame) -> DataFrame:
    return events.join(ids.select("event_id").distinct(), "event_id", "left_semi")


def missing_ids(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids a retained run cites that the event table no longer holds."""
    return ids.select("event_id").distinct().join(events, "event_id", "left_anti")


def evidence_rows(events: DataFrame, records: DataFrame, refs: DataFrame) -> DataFrame:
    """Each event's source records, restricted to the references frozen with a run."""
    frozen = records.join(refs.select("record_ref").distinct(), "record_ref", "left_semi")
    return events.join(frozen, "event_id", "left")


def provenance_errors(events: DataFrame, records: DataFrame, files: DataFrame) -> DataFrame:
    """(event_id, record_ref, error) of every broken link from event to record to file.

    records: record_ref, event_id, upload_id, row_number, raw_json, raw_sha256, renormalized_sha256.
    files: upload_id, row_number, file_row_json, file_valid.  events: event_id, raw_record_ref,
    raw_record_sha256, content_sha256.
    """
    facts = events.select("event_id", "raw_record_ref", "raw_record_sha256", "content_sha256")
    joined = records.join(facts, "event_id").join(files, ["upload_id", "row_number"], "left")
    source = (~F.coalesce("file_valid", F.lit(False)) | (F.sha2("raw_json", 256) != F.col("raw_sha256"))
              | ~F.col("file_row_json").eqNullSafe(F.col("raw_json")))
    primary = F.col("record_ref") == F.col("raw_record_ref")
    errors = F.array_compact(F.array(
        F.when(source, "record differs from its file"),
        F.when(~F.col("renormalized_sha256").eqNullSafe(F.col("content_sha256")), "record normalises to other content"),
        F.when(primary & (F.col("raw_sha256") != F.col("raw_record_sha256")), "event holds another hash of its record")))
    broken = joined.select("event_id", "record_ref", F.explode(errors).alias("error"))
    held = records.select("event_id", F.col("record_ref").alias("raw_record_ref"))
    lost = facts.join(held, ["event_id", "raw_record_ref"], "left_anti").select(
        "event_id", F.col("raw_record_ref").alias("record_ref"), F.lit("own record of the event is gone").alias("error"))
    return broken.unionByName(lost)


def run_summary(found: DataFrame) -> DataFrame:
    """Candidate counts by decision."""
    return found.agg(*[F.count_if(F.col("decision") == d).alias(name) for d, name in (
        ("incident", "incident_count"), ("partial_observation", "partial_count"), ("review", "review_count"))])


def run_warnings(users: DataFrame, resources: DataFrame, records: DataFrame, events: DataFrame) -> DataFrame:
    """One row of warnings about a run's inputs. `users` is `established_users` output."""
    few = users.agg(F.count_if(~F.col("established")))
    rejected = records.agg(F.count_if(F.col("status") == "rejected"))
    facts = (events.agg(F.count("*").alias("events")).withColumn("few", few.scalar())
             .withColumn("labels", resources.agg(F.count("*")).scalar()).withColumn("rejected", rejected.scalar()))
    return facts.select(F.array_compact(F.array(
        F.when(F.col("few") > 0, F.concat(F.lit("too few earlier login days to judge "), F.col("few").cast("string"),
                                          F.lit(" accounts"))),
        F.when(F.col("labels") == 0, "no resource is marked sensitive, so no read can be"),
        F.when(F.col("events") == 0, "no events up to the cutoff"),
        F.when(F.col("rejected") > 0, F.concat(F.col("rejected").cast("string"), F.lit(" records in quarantine")))
    )).alias("warnings"))


def report_rows(found: DataFrame, events: DataFrame, records: DataFrame | None = None, include_raw=False) -> DataFrame:
    """(candidate_id, report): each candidate with its cited events as one JSON document.

    A candidate cites at most four events, so the evidence list stays small.
    """
    shown = events if include_raw else redact(events)
    cited = found.select("candidate_id", F.explode("selected").alias("event_id"))
    evidence = (cited.join(shown.withColumn("event_id", F.col("event_id").cast("string")), "event_id")
                .groupBy("candidate_id").agg(F.sort_array(F.collect_list(F.to_json(
                    F.struct("event_id", *[c for c in shown.columns if c != "event_id"])))).alias("evidence")))
    body = F.to_json(F.struct(F.struct(*[c for c in found.columns]).alias("incident"), "evidence",
                              F.lit(include_raw).alias("include_raw")))
    return found.join(evidence, "candidate_id", "left").select("candidate_id", body.alias("report"))


def verify_reports(submitted: DataFrame, expected: DataFrame) -> DataFrame:
    """Submitted reports that differ from the recomputed ones, or have none."""
    return (submitted.alias("s").join(expected.select("candidate_id", F.col("report").alias("expected")), "candidate_id", "left")
            .where(~F.col("report").eqNullSafe(F.col("expected")))
            .select("candidate_id", F.when(F.col("expected").isNull(), "unknown candidate").otherwise("claims differ").alias("error")))
