"""Indicator feeds from CSV and JSON arrays, typed and ready for `validate_indicators`."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograil.functions.once import computed_once
from lograil.sources.lines import cell, check_headers, csv_rows, headers

REQUIRED = ("type", "value", "source", "source_reference", "description")
OPTIONAL = ("notes", "source_confidence", "effective_from_utc", "effective_until_utc", "enabled")
ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})$"


def typed_feed(rows: DataFrame) -> DataFrame:
    """Feed rows of text cells and `read_error` -> the columns of an indicator table and `read_error`.

    A number, truth value or time that does not parse is null and named in the error; an absent
    `enabled` is true. Times need an offset. The id is a hash of what the row asserts.
    """
    given = lambda name: F.col(name).isNotNull() & (F.trim(name) != "")
    number = F.expr("try_cast(trim(source_confidence) as double)")
    truth = F.lower(F.trim("enabled"))
    # Seconds may be left out of a feed's times, but not of what Spark casts.
    seconds = lambda text: F.regexp_replace(text, r"^(.{16})(Z|[+-])", "$1:00$2")
    moment = lambda name: F.when(F.trim(name).rlike(ISO), seconds(F.trim(name)).try_cast("timestamp"))
    problem = F.coalesce(
        F.col("read_error"),
        F.when(given("source_confidence") & (number.isNull() | F.isnan(number)), "source_confidence must be a number"),
        F.when(given("enabled") & ~truth.isin("true", "false"), "enabled must be true or false"),
        *[F.when(given(name) & moment(name).isNull(), f"{name} must be an ISO time with an offset")
          for name in ("effective_from_utc", "effective_until_utc")])
    asserted = F.sha2(F.to_json(F.struct(*REQUIRED, "effective_from_utc", "effective_until_utc"), {"ignoreNullFields": "false"}), 256)
    return computed_once(rows, {"problem": problem}).select(
        F.substring(asserted, 1, 24).alias("indicator_id"), *REQUIRED, "notes", number.alias("source_confidence"),
        moment("effective_from_utc").alias("effective_from"), moment("effective_until_utc").alias("effective_until"),
        F.when(given("enabled"), truth == "true").otherwise(True).alias("enabled"), F.col("problem").alias("read_error"))


def split_feed(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows for validation, and rejected rows with their reason."""
    return feed.where("read_error is null").drop("read_error"), feed.where("read_error is not null")


def _known(names: Column) -> Column:
    required, every = F.array(*map(F.lit, REQUIRED)), F.array(*map(F.lit, REQUIRED + OPTIONAL))
    return (F.size(F.array_except(required, names)) == 0) & (F.size(F.array_except(names, every)) == 0)


def read_indicators_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed feed rows with `read_error`; each file may order its columns as it likes."""
    check_headers(headers(spark, path), ~_known(F.col("names")),
                  "an indicator feed has the columns " + ",".join(REQUIRED) + " and may have " + ",".join(OPTIONAL))
    rows = csv_rows(spark, path)
    return typed_feed(rows.select(F.when(F.col("read_error").isNotNull(), "row does not fit its header").alias("read_error"),
                                  *[cell(c).alias(c) for c in REQUIRED + OPTIONAL]))


def read_indicators_json(spark: SparkSession, path: str) -> DataFrame:
    """Typed feed rows of files that hold one JSON array of entries each."""
    schema = ", ".join(f"{c} string" for c in (*REQUIRED, *OPTIONAL, "_damaged"))
    rows = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_damaged").json(path)
    return typed_feed(rows.withColumn("read_error", F.when(F.col("_damaged").isNotNull(), "entry is not valid JSON")).drop("_damaged"))
