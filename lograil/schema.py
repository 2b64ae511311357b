"""Fields of raw records, and the columns of context tables."""
from pyspark.sql import types as T

BYTE_COUNTS = ("bytes_read", "bytes_written", "bytes_sent")
GEO = ("geo_latitude", "geo_longitude")

# Raw records arrive as text; typing and checking is the normaliser's work.
RAW_FIELDS = ("timestamp", "action", "source_event_id", "outcome", "user_id", "device_id", "app_id", "session_id",
              "src_ip", "dst_ip", "domain", "file_path", "file_hash", "resource_id", "resource_scope",
              "removable_device_id", "destination_type", "process_id", "process_name", "geo_country",
              *BYTE_COUNTS, *GEO)

RESOURCES = T.StructType([
    T.StructField("resource_id", T.StringType()), T.StructField("sensitive", T.BooleanType()),
    T.StructField("provenance", T.StringType()), T.StructField("effective_from", T.TimestampType()),
    T.StructField("effective_until", T.TimestampType())])
ALIASES = T.StructType([
    T.StructField("alias_user_id", T.StringType()), T.StructField("canonical_user_id", T.StringType()),
    T.StructField("provenance", T.StringType()), T.StructField("effective_from", T.TimestampType()),
    T.StructField("effective_until", T.TimestampType())])
AUTHORIZATIONS = T.StructType([
    T.StructField("dataset_id", T.StringType()), T.StructField("authorization_id", T.StringType()), T.StructField("user_id", T.StringType()),
    T.StructField("device_id", T.StringType()), T.StructField("resource_id", T.StringType()),
    T.StructField("action", T.StringType()), T.StructField("provenance", T.StringType()),
    T.StructField("effective_from", T.TimestampType()), T.StructField("effective_until", T.TimestampType())])
INDICATORS = T.StructType([
    T.StructField("indicator_id", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("value", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("source_reference", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("notes", T.StringType()), T.StructField("source_confidence", T.DoubleType()),
    T.StructField("effective_from", T.TimestampType()), T.StructField("effective_until", T.TimestampType()),
    T.StructField("enabled", T.BooleanType())])
