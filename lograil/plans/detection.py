"""Queries over history, context joins and the chain detector."""
import re

from pyspark.sql import functions as F

from lograil.operators import chain, context, history
from lograil.operators.ordered import count_within, micros
from lograil.plans.obs import WIDE, aliases, authorizations, obs, resources
from lograil.plans.registry import query

CONFIG = chain.Chain(WIDE, WIDE)
W = str(WIDE)

# Cumulative counts per day; each login asks for the days before its own.
HISTORY_SQL = """
auth AS (
  SELECT l.*, (SELECT count(*) FROM logins h WHERE h.user_id = l.user_id AND h.day < l.day AND h.done) AS prior_successful_logins,
    (SELECT count(*) FROM logins h WHERE h.user_id = l.user_id AND h.day < l.day AND h.done AND h.device_id = l.device_id) AS same_device_count,
    (SELECT count(*) FROM logins h WHERE h.user_id = l.user_id AND h.day < l.day AND h.done AND h.app_id = l.app_id) AS same_app_count,
    (SELECT count(*) FROM logins h WHERE h.user_id = l.user_id AND h.day < l.day AND h.done AND h.hour = l.hour) AS same_utc_hour_count,
    (SELECT count(*) FROM reads h WHERE h.user_id = l.user_id AND h.day < l.day) AS prior_file_reads
  FROM logins l),
unusual_logins AS (
  SELECT * FROM auth WHERE done AND prior_successful_logins >= 3
    AND (same_device_count = 0 OR same_app_count = 0 OR same_utc_hour_count = 0))"""
EVENTS_SQL = """
logins AS (SELECT * FROM obs WHERE action = 'login_success'),
reads AS (SELECT * FROM obs WHERE action = 'file_read' AND done),
first_days AS (SELECT user_id, resource_id, min(day) AS first_day FROM reads GROUP BY ALL),
copies AS (SELECT * FROM obs WHERE action = 'file_copy_to_usb' AND destination_type = 'removable_media' AND done AND bytes_written > 0),
mounts AS (SELECT * FROM obs WHERE action = 'usb_mount' AND done),
unmounts AS (SELECT * FROM obs WHERE action = 'usb_unmount' AND done),
sensitive_events AS (
  SELECT r.* FROM reads r WHERE EXISTS (SELECT 1 FROM resources s WHERE s.resource_id = r.resource_id AND s.sensitive
    AND s.effective_from <= r.ts AND (s.effective_until IS NULL OR r.ts < s.effective_until)))"""
MOUNT_SQL = f"""
mounted AS (
  SELECT c.*, m.event_id AS mount_id, m.us AS mount_us FROM copies c JOIN mounts m ON m.user_id = c.user_id
    AND m.device_id = c.device_id AND m.removable_device_id = c.removable_device_id AND m.us >= c.us - {W} AND m.us < c.us
  QUALIFY row_number() OVER (PARTITION BY c.event_id ORDER BY m.us DESC, m.event_id DESC) = 1),
attached AS (
  SELECT * FROM mounted c WHERE NOT EXISTS (SELECT 1 FROM unmounts u WHERE u.device_id = c.device_id
    AND u.removable_device_id = c.removable_device_id AND u.us BETWEEN c.mount_us AND c.us))"""
# The sequential rule as written: all pairs, first match, then a recursive walk over each group.
CHAIN_SQL = f"""
novel AS (
  SELECT l.event_id AS login_id, l.us AS login_us, l.user_id, l.device_id, r.event_id AS read_id, r.us AS read_us, r.resource_id
  FROM unusual_logins l JOIN sensitive_events r ON r.user_id = l.user_id AND r.device_id = l.device_id AND r.us > l.us AND r.us <= l.us + {W}
  JOIN first_days f ON f.user_id = r.user_id AND f.resource_id = r.resource_id
  WHERE l.prior_file_reads >= 3 AND f.first_day >= l.day),
first_read AS (SELECT * FROM novel QUALIFY row_number() OVER (PARTITION BY login_id ORDER BY read_us, read_id) = 1),
first_copy AS (
  SELECT n.login_id, c.event_id AS copy_id, c.us AS copy_us, c.mount_id, c.mount_us, c.bytes_written, c.removable_device_id,
    c.resource_id AS copy_resource, n.read_id AS own_read_id, n.read_us AS own_read_us
  FROM novel n JOIN attached c ON c.user_id = n.user_id AND c.device_id = n.device_id AND c.resource_id = n.resource_id
    AND c.us > n.read_us AND c.us <= n.login_us + {W}
  QUALIFY row_number() OVER (PARTITION BY n.login_id ORDER BY c.us, c.event_id, n.read_us, n.read_id) = 1),
cands AS (
  SELECT f.login_id, f.login_us, f.user_id, f.device_id, f.read_id AS first_read_id, f.read_us AS first_read_us,
    coalesce(own_read_id, f.read_id) AS read_id, coalesce(own_read_us, f.read_us) AS read_us,
    coalesce(copy_resource, f.resource_id) AS resource_id, copy_id, copy_us, mount_id, mount_us, bytes_written, removable_device_id,
    coalesce(copy_us, f.read_us) AS end_us,
    row_number() OVER (PARTITION BY f.user_id, f.device_id ORDER BY f.login_us, f.login_id) AS rn
  FROM first_read f LEFT JOIN first_copy c ON c.login_id = f.login_id),
walk AS (
  SELECT login_id, user_id, device_id, rn, TRUE AS kept, end_us AS until_us FROM cands WHERE rn = 1
  UNION ALL
  SELECT c.login_id, c.user_id, c.device_id, c.rn, c.login_us > w.until_us,
    CASE WHEN c.login_us > w.until_us THEN c.end_us ELSE w.until_us END
  FROM walk w JOIN cands c ON c.user_id = w.user_id AND c.device_id = w.device_id AND c.rn = w.rn + 1),
kept AS (
  SELECT c.*, list_sort(list_distinct(list_filter([login_id::VARCHAR, read_id::VARCHAR, copy_id::VARCHAR, mount_id::VARCHAR],
      lambda x: x IS NOT NULL))) AS selected,
    CASE WHEN copy_id IS NULL THEN 2 ELSE 3 END AS stages, CASE WHEN copy_id IS NULL THEN 60.0 ELSE 100.0 END::DOUBLE AS score,
    CASE WHEN copy_id IS NULL THEN 'partial_observation' ELSE 'incident' END AS decision
  FROM cands c WHERE login_id IN (SELECT login_id FROM walk WHERE kept)),
found AS (
  SELECT *, substr(sha256('["login-read-copy/1","' || user_id || '","' || device_id || '",' || to_json(selected)::VARCHAR || ']'), 1, 24) AS candidate_id
  FROM kept)"""
ALL_SQL = ",".join((EVENTS_SQL, HISTORY_SQL, MOUNT_SQL, CHAIN_SQL))
_TABLES = ("logins reads first_days copies mounts unmounts sensitive_events auth unusual_logins mounted attached novel first_read "
           "first_copy cands walk kept found").split()


def chain_sql(events: str, tag: str) -> str:
    """The detector's SQL over another event relation, its names marked with a tag."""
    sql = re.sub(r"\bobs\b", events, ALL_SQL)
    return re.sub(rf"\b({'|'.join(_TABLES)})\b", rf"\1_{tag}", sql)


def us(column):
    return micros(column)


def joined(column):
    return F.array_join(column, ",")


def found(spark, folder):
    return chain.detect(obs(spark, folder), resources(spark, folder), CONFIG)


@query("""
SELECT event_id, us, user_id, device_id, app_id, resource_id, removable_device_id, source_type, action, outcome, bytes_read,
  bytes_written, destination_type, src_ip, dst_ip, domain FROM obs""")
def obs_view(spark, folder):
    return obs(spark, folder, domains=True).withColumn("us", us("event_time")).select(
        "event_id", "us", "user_id", "device_id", "app_id", "resource_id", "removable_device_id", "source_type", "action",
        "outcome", "bytes_read", "bytes_written", "destination_type", "src_ip", "dst_ip", "domain")


@query("SELECT action, done AS is_completed, count(*) AS n FROM obs GROUP BY ALL")
def completed_filter(spark, folder):
    return obs(spark, folder).groupBy("action", history.completed().alias("is_completed")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, prior_successful_logins, same_device_count, same_app_count, same_utc_hour_count, prior_file_reads,
  done AND prior_successful_logins >= 3 AND (same_device_count = 0 OR same_app_count = 0 OR same_utc_hour_count = 0) AS unusual
  FROM auth""", extra=EVENTS_SQL + "," + HISTORY_SQL)
def auth_history(spark, folder):
    return history.auth_history(obs(spark, folder)).select(
        "event_id", "prior_successful_logins", "same_device_count", "same_app_count", "same_utc_hour_count",
        "prior_file_reads", "unusual")


# History from another period: the first fifteen days, asked by the logins after them.
FROZEN = "2024-01-16 00:00:00"


@query(f"""
SELECT event_id, (SELECT count(*) FROM logins h WHERE h.user_id = l.user_id AND h.done AND h.ts < TIMESTAMP '{FROZEN}') AS prior_successful_logins,
  (SELECT count(*) FROM logins h WHERE h.user_id = l.user_id AND h.done AND h.ts < TIMESTAMP '{FROZEN}' AND h.device_id = l.device_id) AS same_device_count,
  (SELECT count(*) FROM logins h WHERE h.user_id = l.user_id AND h.done AND h.ts < TIMESTAMP '{FROZEN}' AND h.app_id = l.app_id) AS same_app_count,
  (SELECT count(*) FROM logins h WHERE h.user_id = l.user_id AND h.done AND h.ts < TIMESTAMP '{FROZEN}' AND h.hour = l.hour) AS same_utc_hour_count
FROM logins l WHERE l.ts >= TIMESTAMP '{FROZEN}'""", extra=EVENTS_SQL)
def frozen_history(spark, folder):
    events, moment = obs(spark, folder), F.lit(FROZEN).cast("timestamp")
    return history.auth_history(events.where(F.col("event_time") >= moment), events.where(F.col("event_time") < moment)).select(
        "event_id", *history.LOGIN_COUNTS)


@query("""
SELECT user_id, 'device' AS kind, device_id AS value, count(*) AS n FROM logins WHERE done GROUP BY ALL UNION ALL
SELECT user_id, 'app', app_id, count(*) FROM logins WHERE done GROUP BY ALL UNION ALL
SELECT user_id, 'hour', hour::VARCHAR, count(*) FROM logins WHERE done GROUP BY ALL UNION ALL
SELECT user_id, 'resource', resource_id, count(*) FROM reads GROUP BY ALL""", extra=EVENTS_SQL)
def history_snapshot(spark, folder):
    return history.history_snapshot(obs(spark, folder))


@query("""
SELECT u.user_id, coalesce(e.established, FALSE) AS established FROM (SELECT DISTINCT user_id FROM obs) u
LEFT JOIN (SELECT user_id, bool_or(prior_successful_logins >= 3) AS established FROM auth GROUP BY ALL) e ON e.user_id = u.user_id""",
       extra=EVENTS_SQL + "," + HISTORY_SQL)
def established_users(spark, folder):
    return history.established_users(obs(spark, folder))


@query("""
SELECT r.event_id AS read_id, d.login_day,
  (SELECT count(*) FROM reads h WHERE h.user_id = r.user_id AND h.day < d.login_day) AS prior_file_reads,
  (SELECT count(*) FROM reads h WHERE h.user_id = r.user_id AND h.day < d.login_day AND h.resource_id = r.resource_id) AS same_resource_count
FROM reads r, LATERAL (SELECT DISTINCT day AS login_day FROM logins l WHERE l.user_id = r.user_id AND l.day = r.day) d""",
       extra=EVENTS_SQL)
def read_novelty(spark, folder):
    """Reads on a day with a login, compared with that login day's history."""
    return history.read_novelty(obs(spark, folder)).select(
        F.col("event_id").alias("read_id"), F.col("day").alias("login_day"), "prior_file_reads", "same_resource_count")


@query(f"""
SELECT login_id, login_day, read_id, read_day,
  (SELECT count(*) FROM reads h WHERE h.user_id = p.user_id AND h.day < p.login_day) AS prior_file_reads,
  (SELECT count(*) FROM reads h WHERE h.user_id = p.user_id AND h.day < p.login_day AND h.resource_id = p.resource_id) AS same_resource_count
FROM (SELECT l.event_id AS login_id, l.user_id, l.day AS login_day, r.event_id AS read_id, r.day AS read_day, r.resource_id,
    row_number() OVER (PARTITION BY l.event_id ORDER BY r.us, r.event_id) AS rn
  FROM (SELECT event_id, user_id, device_id, us, us // 86400000000 AS day FROM obs WHERE action = 'login_success') l
  JOIN reads r ON r.user_id = l.user_id AND r.device_id = l.device_id AND r.us > l.us AND r.us <= l.us + {W}) p WHERE rn = 1""",
       extra=EVENTS_SQL)
def login_read_novelty(spark, folder):
    """The first read after each login, often on a later day, against the history before the day of the login."""
    events = obs(spark, folder)
    first = chain.reads_after(events, WIDE).where("first_read_id is not null").select("login_id", F.col("first_read_id").alias("read_id"))
    logins = history.with_time(events).select(F.col("event_id").alias("login_id"), "user_id", "day")
    reads = history.with_time(events).select(F.col("event_id").alias("read_id"), "resource_id", F.col("day").alias("read_day"))
    pairs = first.join(logins, "login_id").join(reads, "read_id")
    return history.pair_novelty(pairs, events).select(
        "login_id", F.col("day").alias("login_day"), "read_id", "read_day", "prior_file_reads", "same_resource_count")


@query("SELECT event_id, user_id, resource_id, us FROM sensitive2", extra=EVENTS_SQL + """,
sensitive2 AS (SELECT r.* FROM reads r WHERE r.k % 2 = 0 AND r.ts >= TIMESTAMP '2024-01-01' AND r.ts < TIMESTAMP '2024-01-16')""")
def sensitive_reads(spark, folder):
    return context.sensitive_reads(obs(spark, folder), resources(spark, folder, ending=True)).select(
        "event_id", "user_id", "resource_id", us("event_time").alias("us"))


@query(f"""
SELECT l.event_id AS login_id, count(r.event_id) AS reads_within, min(r.us) AS first_read_us, arg_min(r.event_id, (r.us, r.event_id)) AS first_read_id
FROM logins l LEFT JOIN reads r ON r.user_id = l.user_id AND r.device_id = l.device_id AND r.us > l.us AND r.us <= l.us + {W}
GROUP BY ALL""", extra=EVENTS_SQL)
def reads_after_login(spark, folder):
    """Range join reduced to its per-login answer: how many reads follow, and the first."""
    return chain.reads_after(obs(spark, folder), WIDE)


@query("""SELECT c.event_id AS copy_id, r.event_id AS read_id, r.us AS read_us FROM copies c JOIN reads r ON r.user_id = c.user_id
  AND r.device_id = c.device_id AND r.resource_id = c.resource_id AND r.us < c.us AND r.us >= c.us - """ + W + """
  QUALIFY row_number() OVER (PARTITION BY c.event_id ORDER BY r.us, r.event_id) = 1""", extra=EVENTS_SQL)
def copy_read_match(spark, folder):
    return chain.match_read(obs(spark, folder), WIDE)


@query("SELECT event_id AS copy_id, mount_id, mount_us FROM mounted", extra=EVENTS_SQL + "," + MOUNT_SQL)
def asof_mount(spark, folder):
    events = obs(spark, folder)
    return (chain.asof_mount(chain.eligible_copies(events), events, WIDE).where("mount_us is not null")
            .select(F.col("event_id").alias("copy_id"), "mount_id", "mount_us"))


@query("SELECT event_id AS copy_id, mount_id, mount_us FROM attached", extra=EVENTS_SQL + "," + MOUNT_SQL)
def active_mount(spark, folder):
    events = obs(spark, folder)
    return chain.active_mount(chain.eligible_copies(events), events, WIDE).select(
        F.col("event_id").alias("copy_id"), "mount_id", "mount_us")


@query("""SELECT user_id, device_id, arg_min(event_id, (us, event_id)) AS event_id, min(us) AS us FROM reads GROUP BY ALL""",
       extra=EVENTS_SQL)
def first_match(spark, folder):
    reads = history.with_time(obs(spark, folder)).where((F.col("action") == "file_read") & history.completed())
    return chain.first_match(reads.select("user_id", "device_id", "us", "event_id"), chain.ACTOR, ["us", "event_id"])


@query("SELECT login_id, end_us FROM found", extra=ALL_SQL, recursive=True)
def greedy_episodes(spark, folder):
    return chain.episodes(chain.candidates(obs(spark, folder), resources(spark, folder), CONFIG)).select("login_id", "end_us")


@query("""
SELECT candidate_id, user_id, device_id, login_id, login_us, read_id, read_us, resource_id, copy_id, copy_us, mount_id, mount_us,
  bytes_written, removable_device_id, stages, score, decision, array_to_string(selected, ',') AS selected FROM found""",
       extra=ALL_SQL, recursive=True)
def chain_detect(spark, folder):
    return found(spark, folder).select(
        "candidate_id", "user_id", "device_id", "login_id", "login_us", "read_id", "read_us", "resource_id", "copy_id",
        "copy_us", "mount_id", "mount_us", "bytes_written", "removable_device_id", "stages", "score", "decision",
        joined("selected").alias("selected"))


@query("""
SELECT candidate_id, 'authentication' AS stage_id, login_id::VARCHAR AS event_id, login_us AS us, 'supported_inference' AS claim_status FROM found UNION ALL
SELECT candidate_id, 'collection', read_id::VARCHAR, read_us, 'supported_inference' FROM found UNION ALL
SELECT candidate_id, 'transfer', copy_id::VARCHAR, copy_us, 'observed' FROM found WHERE copy_id IS NOT NULL""",
       extra=ALL_SQL, recursive=True)
def stages(spark, folder):
    return chain.stage_rows(found(spark, folder)).select("candidate_id", "stage_id", "event_id", "us", "claim_status")


@query("""
SELECT DISTINCT candidate_id, e AS event_id FROM (SELECT candidate_id, unnest(selected) AS e FROM found)""", extra=ALL_SQL, recursive=True)
def evidence_ids(spark, folder):
    return chain.evidence(found(spark, folder))


@query("""
SELECT event_id, user_id AS original_user_id, CASE WHEN n = 1 AND NOT chained THEN target ELSE user_id END AS user_id,
  CASE WHEN n = 0 THEN 'none' WHEN n > 1 OR chained THEN 'excluded' ELSE 'resolved' END AS alias_status
FROM (SELECT o.event_id, o.user_id, count(DISTINCT a.canonical_user_id) AS n, min(a.canonical_user_id) AS target,
        coalesce(min(a.canonical_user_id) IN (SELECT alias_user_id FROM aliases), FALSE) AS chained
      FROM obs o LEFT JOIN aliases a ON a.alias_user_id = o.user_id AND a.effective_from <= o.ts AND o.ts < a.effective_until
      GROUP BY ALL)""")
def alias_resolution(spark, folder):
    events = obs(spark, folder)
    status = context.alias_targets(events, aliases(spark, folder))
    return status.select("event_id", F.col("user_id").alias("original_user_id"),
                         F.when(F.col("alias_status") == "resolved", F.col("targets")[0]["canonical_user_id"])
                         .otherwise(F.col("user_id")).alias("user_id"), "alias_status")


@query("""
SELECT f.copy_id, (SELECT count(*) FROM authorizations a WHERE a.user_id = f.user_id) AS actor_entries,
  (SELECT count(*) FROM authorizations a WHERE a.device_id = f.device_id) AS endpoint_entries,
  (SELECT count(*) FROM authorizations a WHERE a.resource_id = f.resource_id) AS resource_entries,
  (SELECT count(*) FROM authorizations a WHERE a.action = f.action) AS action_entries,
  count(a.authorization_id) AS matched_entries, count(a.authorization_id) > 0 AS matched,
  CASE WHEN count(a.authorization_id) > 0 THEN 20.0 ELSE 0.0 END::DOUBLE AS reduction
FROM (SELECT event_id AS copy_id, * FROM copies) f LEFT JOIN authorizations a ON a.user_id = f.user_id AND a.device_id = f.device_id AND a.resource_id = f.resource_id
  AND a.action = f.action AND a.from_us <= f.us AND f.us < a.until_us GROUP BY ALL""", extra=EVENTS_SQL)
def authorization_checks(spark, folder):
    copies = chain.eligible_copies(obs(spark, folder)).select(
        F.col("event_id").alias("copy_id"), F.col("user_id").alias("copy_user"), F.col("device_id").alias("copy_device"),
        F.col("resource_id").alias("copy_resource"), F.col("action").alias("copy_action"), F.col("us").alias("copy_us"))
    return context.authorize(copies, authorizations(spark, folder)).select(
        "copy_id", "actor_entries", "endpoint_entries", "resource_entries", "action_entries", "matched_entries", "matched",
        "reduction")
