"""Continuous ingest in two queries: records with line numbers, then their status against all earlier ones."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lograil.operators.ingest import CONFLICT, REJECT
from lograil.operators.normalize import Source, checked_records
from lograil.sources.events import raw_json_lines
from lograil.sources.lines import numbered
from lograil.streaming.dedup import stream_status


def _once(df: DataFrame, path: str, batch_id: int) -> None:
    """A batch's rows in a folder of its own, which appears whole; a repeated batch leaves it as it is."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    pending, folder = (hadoop(f"{path}/{name}{batch_id}") for name in ("_pending-", "batch_id="))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        df.write.mode("overwrite").parquet(pending.toString())
        files.rename(pending, folder)


def stream_records(spark: SparkSession, directory: str, source: Source, records_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """JSON-lines files of a directory -> normalised records, good and bad, with line numbers."""
    lines = spark.readStream.text(directory).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("block"))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("at", F.monotonically_increasing_id())
        _once(checked_records(raw_json_lines(numbered(rows)), source), records_path, batch_id)

    return (lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def stream_settled(spark: SparkSession, records_path: str, schema, events_path: str, rejects_path: str, checkpoint: str,
                   keep: int | None = None, **trigger) -> StreamingQuery:
    """Records -> events and quarantine, one folder per micro-batch each.

    Statuses come from keyed state (`stream_status`): a batch reads its own records and the state of their ids,
    however many events are stored. Conflicts join the quarantine, duplicates go.
    """
    records = spark.readStream.schema(schema).parquet(f"{records_path}/batch_id=*")
    judged = stream_status(records.where("error is null"), keep=keep)
    bad = records.where("error is not null").withColumn("status", F.lit("rejected"))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()      # two outputs of one micro-batch
        try:
            events = rows.where("status = 'accepted'").drop("status", "error", "raw_json", "file_name")
            rejects = rows.where("status in ('rejected', 'conflict')").withColumn("error", F.when(F.col("status") == "conflict", CONFLICT).otherwise(F.col("error")))
            _once(events, events_path, batch_id)
            _once(rejects.select(*REJECT), rejects_path, batch_id)
        finally:
            rows.unpersist()

    return (judged.unionByName(bad).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"availableNow": True})).start())


def record_schema(spark: SparkSession, source: Source):
    """Schema of the stored records of a source."""
    empty = spark.createDataFrame([], "line string, file_name string, row_number bigint")
    return checked_records(raw_json_lines(empty), source).schema


def stream_events(spark: SparkSession, directory: str, source: Source, events_path: str, rejects_path: str,
                  checkpoint: str, keep: int | None = None, **trigger) -> list[StreamingQuery]:
    """JSON-lines files of a directory -> events and quarantine, as the batch job `ingest` would judge them.

    Two queries, chained by a folder of normalised records under `checkpoint`; with `availableNow`, the
    default, the first has ended before the second starts. Both go on where they stopped: a repeated batch
    finds its own folder, so a restart neither loses nor doubles rows. Needs the RocksDB state store.
    """
    records, schema = f"{checkpoint}/records", record_schema(spark, source)
    first = stream_records(spark, directory, source, records, f"{checkpoint}/first", **trigger)
    if not trigger or trigger.get("availableNow"):
        first.awaitTermination()
    second = stream_settled(spark, records, schema, events_path, rejects_path, f"{checkpoint}/second", keep, **trigger)
    return [first, second]
