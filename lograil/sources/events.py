"""Raw event records from CSV and JSON lines, ready for `normalize`."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograil.functions.once import computed_once
from lograil.operators.normalize import Source, normalize
from lograil.schema import BYTE_COUNTS, GEO, RAW_FIELDS
from lograil.sources.lines import cell, csv_rows, numbered_lines, text, typed

# Schemas of objects whose members are text, null, or whole numbers of bytes.
_MEMBER = rf"(?:\w+: (?:STRING|VOID)|(?:{'|'.join(BYTE_COUNTS)}): BIGINT)"
PLAIN = rf"^OBJECT<(?:{_MEMBER}(?:, {_MEMBER})*+)?>$"


def raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files, whatever the order of columns in each."""
    return raw_cells(csv_rows(spark, path))


def raw_cells(rows: DataFrame) -> DataFrame:
    """Raw records from `csv_cells`; a line that fits no header is kept whole with its error."""
    members = F.map_from_entries(F.array_sort(F.map_entries("cells")))
    unparsed = F.to_json(F.struct(F.col("line").alias("_unparsed")))
    return rows.select(
        F.concat("file_name", F.lit(":"), "row_number").alias("record_ref"), "row_number", "file_name", "read_error",
        F.when(F.col("read_error").isNull(), F.to_json(members)).otherwise(unparsed).alias("raw_json"),
        *[cell(name).alias(name) for name in RAW_FIELDS])


def raw_json_lines(lines: DataFrame) -> DataFrame:
    """Parse (file_name, row_number, line); a line that is no JSON object is kept with an error."""
    parsed = computed_once(lines.where(F.trim("line") != ""), {"v": F.try_parse_json("line")})
    schema = F.schema_of_variant("v")
    rows = computed_once(parsed, {"is_object": F.coalesce(schema.startswith("OBJECT"), F.lit(False)),
                                  "is_plain": F.coalesce(schema.rlike(PLAIN), F.lit(False))})
    kinds = {name: typed("v", f"$.{name}") for name in RAW_FIELDS}
    # Members are looked at one by one only where the object's schema shows another type than those any field may have.
    wrong = F.when(~F.col("is_plain"), F.coalesce(*[
        F.when(~kinds[name].isin("STRING", "VOID", *(("BIGINT", "BOOLEAN") if name in BYTE_COUNTS else ()))
               & ~(F.lit(name in GEO) & kinds[name].rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")),
               F.lit(f"{name} has an unsupported type")) for name in RAW_FIELDS]))
    error = F.when(F.col("v").isNull(), "line is not valid JSON").when(~F.col("is_object"), "line holds no JSON object").otherwise(wrong)
    whole = F.coalesce(F.to_json("v"), F.to_json(F.struct(F.col("line").alias("_unparsed"))))
    fields = {name: F.when(F.col("is_object"), text("v", f"$.{name}")) for name in RAW_FIELDS}
    return (computed_once(rows, {"read_error": error, "raw_json": whole, **fields})
            .withColumn("record_ref", F.concat("file_name", F.lit(":"), "row_number")).drop("v", "is_object", "is_plain", "line"))


def read_events_csv(spark: SparkSession, path: str, source: Source) -> tuple[DataFrame, DataFrame]:
    """Canonical events and rejects of one CSV source; a bad line never fails its file."""
    return normalize(raw_csv(spark, path), source)


def read_events_jsonl(spark: SparkSession, path: str, source: Source) -> tuple[DataFrame, DataFrame]:
    """Canonical events and rejects of one JSON-lines source."""
    return normalize(raw_json_lines(numbered_lines(spark, path)), source)
