"""The canonical event view over the bench tables, and contexts derived from it.

The bench tables hold no security log; this fixed mapping turns `events` into
logins, reads, copies, mounts and unmounts. Each builder has its DuckDB twin in
`PRELUDE`, so that every query and its check start from the same rows.
"""
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograil.operators.ordered import MINUTE, micros, nearest
from lograil.session import durable

# The look-back used on the bench tables, whose events are far apart.
WIDE = 4_320 * MINUTE


# Plans of the query being built, if it stores its view.
_STORED: list[dict] = []


def planned_once(build):
    """Keep the plan (not the rows) of a view per session and folder; building it costs more than reusing it."""
    plans = {}

    @wraps(build)
    def cached(spark, folder, **options):
        kept = _STORED[-1] if _STORED else plans
        key = (build.__name__, spark.sparkContext.applicationId, id(spark), folder, *sorted(options.items()))
        if key not in kept:
            kept[key] = build(spark, folder, **options)
        return kept[key]
    return cached


def stores_view(function):
    """For queries that read the events many times: they are parsed, and copies given their reads, once for the query."""
    @wraps(function)
    def run(spark, folder):
        _STORED.append({})
        try:
            return function(spark, folder)
        finally:
            _STORED.pop()
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@planned_once
def _base(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    event_time = F.col("ts").cast("timestamp")
    return (table(spark, folder, "events").withColumn("k", k)
            .select("event_id", event_time.alias("event_time"), "event_type", "k",
                    F.concat(F.lit("u"), user).alias("user_id"), user.alias("user_number"),
                    F.concat(F.lit("d"), (user + F.floor(F.dayofmonth(event_time) / 10)) % 20).alias("device_id"),
                    F.concat(F.lit("app"), F.col("k") % 6).alias("app_id"),
                    F.concat(F.lit("r"), "k").alias("resource_id"),
                    F.concat(F.lit("m"), user % 3).alias("removable_device_id"),
                    F.round(F.col("value") * 1000).cast("bigint").alias("bytes"),
                    F.when(F.col("k") % 17 == 0, "failure").alias("outcome"),
                    F.concat(F.lit("10.0."), user % 256, F.lit("."), F.col("k")).alias("src_ip"),
                    F.concat(F.lit("203.0.113."), "k").alias("dst_ip"),
                    (F.col("event_id") % 50).alias("page_id")))


@planned_once
def hosts(spark: SparkSession, folder: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    return table(spark, folder, "pages").select("page_id", host.alias("domain"))


@planned_once
def obs(spark: SparkSession, folder: str, *, domains=False) -> DataFrame:
    """Events in canonical columns; `domains` adds the host of the related page.

    A copy refers to the resource of the same user's latest earlier read, found by
    a nearest-event pass. The copies are a separate branch with constant action, so
    a plan that needs no copies drops the branch.
    """
    base = _base(spark, folder)
    kind = F.col("event_type")
    shared = ["event_id", "event_time", "user_id", "user_number", "device_id", "app_id", "removable_device_id",
              "outcome", "src_ip", "dst_ip", "k", "page_id"]
    others = base.where(kind != "purchase").select(
        *shared,
        F.when(kind.isin("signup", "error"), "auth").when(kind == "view", "file").otherwise("device").alias("source_type"),
        F.when(kind == "signup", "login_success").when(kind == "error", "login_failure").when(kind == "view", "file_read")
        .when(F.col("k") % 10 == 0, "usb_unmount").otherwise("usb_mount").alias("action"),
        "resource_id", F.when(kind == "view", F.col("bytes")).alias("bytes_read"),
        F.lit(None).cast("bigint").alias("bytes_written"), F.lit(None).cast("string").alias("destination_type"))
    timed = base.withColumn("us", micros())
    reads = timed.where(kind == "view").select("user_id", "us", F.struct("us", "event_id", "resource_id").alias("last"))
    copies = nearest(timed.where(kind == "purchase").select(*shared, "resource_id", "bytes", "us"), reads,
                     ["user_id"], "us", ["last"]).select(
        *shared, F.lit("file").alias("source_type"), F.lit("file_copy_to_usb").alias("action"),
        F.coalesce("last.resource_id", "resource_id").alias("resource_id"),
        F.lit(None).cast("bigint").alias("bytes_read"), F.col("bytes").alias("bytes_written"),
        F.lit("removable_media").alias("destination_type"))
    rows = others.unionByName(copies)
    if domains:
        return rows.join(hosts(spark, folder), "page_id", "left")
    return durable(rows) if _STORED else rows


def _at(text: str):
    return F.to_timestamp(F.lit(text))


@planned_once
def resources(spark: SparkSession, folder: str, *, ending=False) -> DataFrame:
    """Labels for every resource that is read; even numbers are sensitive."""
    names = obs(spark, folder).where(F.col("action") == "file_read").select("resource_id", "k").distinct()
    until = _at("2024-01-16 00:00:00") if ending else F.lit(None).cast("timestamp")
    return names.select("resource_id", (F.col("k") % 2 == 0).alias("sensitive"), F.lit("catalogue").alias("provenance"),
                        _at("2024-01-01 00:00:00").alias("effective_from"), until.alias("effective_until"))


@planned_once
def aliases(spark: SparkSession, folder: str) -> DataFrame:
    """u(n) -> u(n+1) for n % 7 = 0, a second target for n % 14 = 0."""
    users = _base(spark, folder).select("user_number").distinct().where("user_number % 7 = 0")
    n = F.col("user_number")
    targets = F.when(n % 14 == 0, F.array(n + 1, n + 2)).otherwise(F.array(n + 1))
    return users.select(F.concat(F.lit("u"), n).alias("alias_user_id"), F.explode(targets).alias("t")).select(
        "alias_user_id", F.concat(F.lit("u"), "t").alias("canonical_user_id"), F.lit("directory").alias("provenance"),
        _at("2024-01-05 00:00:00").alias("effective_from"), _at("2024-01-20 00:00:00").alias("effective_until"))


@planned_once
def authorizations(spark: SparkSession, folder: str) -> DataFrame:
    """One per copy with event_id % 5 in 0..2: exact, expired, and wrong resource."""
    rest = F.col("event_id") % 5
    minute = F.expr("interval 1 minute")
    return (obs(spark, folder).where(F.col("action") == "file_copy_to_usb").where(rest <= 2)
            .select(F.concat(F.lit("a"), "event_id").alias("authorization_id"), "user_id", "device_id",
                    F.when(rest == 2, "r-other").otherwise(F.col("resource_id")).alias("resource_id"),
                    "action", F.lit("change board").alias("provenance"),
                    F.when(rest == 1, F.col("event_time") - minute).otherwise(F.col("event_time")).alias("effective_from"),
                    F.when(rest == 1, F.col("event_time")).otherwise(F.col("event_time") + minute).alias("effective_until")))


PRELUDE = """
base AS (
  SELECT event_id, ts, event_type, user_id AS user_number, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value
  FROM events),
shaped AS (
  SELECT event_id, ts, epoch_us(ts) AS us, user_number, k, event_type, 'u' || user_number AS user_id,
    'd' || ((user_number + day(ts) // 10) % 20) AS device_id, 'app' || (k % 6) AS app_id, 'r' || k AS own_resource,
    'm' || (user_number % 3) AS removable_device_id, CAST(round(value * 1000) AS BIGINT) AS bytes,
    CASE WHEN k % 17 = 0 THEN 'failure' END AS outcome,
    '10.0.' || (user_number % 256) || '.' || k AS src_ip, '203.0.113.' || k AS dst_ip, event_id % 50 AS page_id,
    last_value(CASE WHEN event_type = 'view' THEN 'r' || k END IGNORE NULLS) OVER (
      PARTITION BY user_number ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_resource
  FROM base),
hosts AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS domain FROM pages),
obs AS (
  SELECT s.event_id, s.ts, s.us, s.us // 86400000000 AS day, (s.us % 86400000000) // 3600000000 AS hour,
    s.user_id, s.user_number, s.device_id, s.app_id, s.removable_device_id, s.outcome, s.src_ip, s.dst_ip, s.k, s.page_id,
    CASE WHEN event_type IN ('signup', 'error') THEN 'auth' WHEN event_type IN ('view', 'purchase') THEN 'file'
      ELSE 'device' END AS source_type,
    CASE event_type WHEN 'signup' THEN 'login_success' WHEN 'error' THEN 'login_failure' WHEN 'view' THEN 'file_read'
      WHEN 'purchase' THEN 'file_copy_to_usb' ELSE CASE WHEN k % 10 = 0 THEN 'usb_unmount' ELSE 'usb_mount' END END AS action,
    CASE WHEN event_type = 'purchase' THEN coalesce(last_resource, own_resource) ELSE own_resource END AS resource_id,
    CASE WHEN event_type = 'view' THEN bytes END AS bytes_read,
    CASE WHEN event_type = 'purchase' THEN bytes END AS bytes_written,
    CASE WHEN event_type = 'purchase' THEN 'removable_media' END AS destination_type, h.domain,
    outcome IS NULL OR outcome = 'success' AS done
  FROM shaped s LEFT JOIN hosts h ON h.page_id = s.page_id),
resources AS (
  SELECT DISTINCT 'r' || k AS resource_id, k % 2 = 0 AS sensitive, TIMESTAMP '2024-01-01' AS effective_from,
    CAST(NULL AS TIMESTAMP) AS effective_until FROM base WHERE event_type = 'view'),
aliases AS (
  SELECT 'u' || user_number AS alias_user_id, 'u' || (user_number + step) AS canonical_user_id,
    TIMESTAMP '2024-01-05' AS effective_from, TIMESTAMP '2024-01-20' AS effective_until
  FROM (SELECT DISTINCT user_number FROM base WHERE user_number % 7 = 0), (VALUES (1), (2)) AS t(step)
  WHERE step = 1 OR user_number % 14 = 0),
authorizations AS (
  SELECT 'a' || event_id AS authorization_id, user_id, device_id,
    CASE WHEN event_id % 5 = 2 THEN 'r-other' ELSE resource_id END AS resource_id, action,
    CASE WHEN event_id % 5 = 1 THEN us - 60000000 ELSE us END AS from_us,
    CASE WHEN event_id % 5 = 1 THEN us ELSE us + 60000000 END AS until_us
  FROM obs WHERE action = 'file_copy_to_usb' AND event_id % 5 <= 2)"""
