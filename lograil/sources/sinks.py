"""Append-only run storage, quarantine, and exports."""
import time
from urllib.parse import quote
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograil.functions.identity import csv_safe


def write_run(run: DataFrame, incidents: DataFrame, path: str) -> None:
    """Store one run row and its incidents; a run id can be written once.

    Every attempt writes into folders of its own, the run's row last: it marks a complete attempt and names its
    incidents. A retry after a break doubles nothing, and of two writers at once the one that began first
    counts and the other fails; `read_runs` and `read_incidents` see the attempt that counts.
    """
    spark = run.sparkSession
    ids = [row[0] for row in run.select("analysis_run_id").take(2)]
    if len(ids) != 1:
        raise ValueError("exactly one run row is written at a time")
    own, attempt = f"analysis_run_id={quote(str(ids[0]), safe='')}", f"{time.time_ns():020d}-{uuid4().hex}"
    if _is_stored(spark, f"{path}/runs/{own}"):
        raise ValueError(f"run {ids[0]} is already stored; runs are immutable")
    incidents.drop("analysis_run_id").write.parquet(f"{path}/incidents/{own}/attempt={attempt}")
    run.drop("analysis_run_id").write.parquet(f"{path}/runs/{own}/attempt={attempt}")
    if spark.read.parquet(f"{path}/runs/{own}").agg(F.min("attempt")).first()[0] != attempt:
        raise ValueError(f"run {ids[0]} was stored by another writer meanwhile")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Stored runs, one row each, with the attempt that counts."""
    runs = spark.read.parquet(f"{path}/runs")
    counts = runs.groupBy("analysis_run_id").agg(F.min("attempt").alias("attempt"))
    return runs.join(counts, ["analysis_run_id", "attempt"], "left_semi")


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Incidents of stored runs; those of broken or overtaken attempts are not seen."""
    counts = read_runs(spark, path).select("analysis_run_id", "attempt")
    return spark.read.parquet(f"{path}/incidents").join(counts, ["analysis_run_id", "attempt"], "left_semi").drop("attempt")


def _is_stored(spark: SparkSession, folder: str) -> bool:
    try:
        spark.read.parquet(folder)
    except AnalysisException:
        return False
    return True


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Quarantine rejected rows with reference, row number and reason."""
    rejects.write.mode("append").partitionBy("dataset_id").parquet(path)


def export_findings_csv(findings: DataFrame, path: str) -> None:
    """CSV in which no cell starts a spreadsheet formula."""
    findings.select(*[csv_safe(F.col(c)).alias(c) for c in findings.columns]).write.option("header", True).csv(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON document per line."""
    reports.select("report").write.text(path)
