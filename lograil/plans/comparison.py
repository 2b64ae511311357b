"""Queries over run comparison, replay, evaluation, provenance, paging and revision logs."""
from pyspark.sql import functions as F

from lograil.functions.identity import record_sha256
from lograil.operators import chain, compare, evaluate, merkle, normalize, paging, reports, revisions, validate
from lograil.operators.history import completed
from lograil.operators.ordered import MINUTE, micros, utc_day
from lograil.plans.detection import ALL_SQL, CONFIG, EVENTS_SQL, chain_sql, found, joined
from lograil.plans.normalization import ALERTS_SQL, RECORD, findings
from lograil.plans.obs import authorizations, obs, resources, stores_view, table
from lograil.plans.registry import query
from lograil.session import durable
from lograil.streaming.sessions import sessions as session_rows

CUTOFF = "2024-01-20 00:00:00"
# Observations taken out of a run: a third of the mounts and a seventh of the reads.
EXCLUDED = "(action = 'usb_mount' AND event_id % 3 = 0) OR (action = 'file_read' AND event_id % 7 = 3)"
REDUCED_SQL = f"less AS (SELECT * FROM obs WHERE NOT ({EXCLUDED}))," + chain_sql("less", "b")
BOTH_SQL = ALL_SQL + "," + REDUCED_SQL + """,
pairs AS (
  SELECT a.candidate_id AS left_id, b.candidate_id AS right_id FROM found a JOIN found_b b ON a.user_id = b.user_id AND a.device_id = b.device_id
    AND greatest(a.login_us, b.login_us) <= least(a.end_us, b.end_us) AND list_has_any(a.selected, b.selected)),
degrees AS (SELECT *, count(*) OVER (PARTITION BY left_id) AS ld, count(*) OVER (PARTITION BY right_id) AS rd FROM pairs)"""


def _moment(text):
    return F.lit(text).cast("timestamp")


def _reduced(spark, folder):
    events = obs(spark, folder)
    return chain.detect(compare.exclude(events, events.where(EXCLUDED).select("event_id")), resources(spark, folder), CONFIG)


@query(f"SELECT event_id FROM obs WHERE ts <= TIMESTAMP '{CUTOFF}'")
def as_of_cutoff(spark, folder):
    return compare.as_of(obs(spark, folder), _moment(CUTOFF)).select("event_id")


@query(f"SELECT event_id, action FROM obs WHERE NOT ({EXCLUDED})")
def exclude_ids(spark, folder):
    events = obs(spark, folder)
    return compare.exclude(events, events.where(EXCLUDED)).select("event_id", "action")


@query("""
SELECT a.candidate_id AS left_id, d.right_id, CASE WHEN d.right_id IS NOT NULL THEN 'matched'
    WHEN a.candidate_id IN (SELECT left_id FROM pairs) THEN 'ambiguous' ELSE 'unmatched' END AS status,
  b.score - a.score AS risk_delta, a.decision <> b.decision AS decision_changed
FROM found a LEFT JOIN degrees d ON d.left_id = a.candidate_id AND ld = 1 AND rd = 1 LEFT JOIN found_b b ON b.candidate_id = d.right_id
UNION ALL
SELECT NULL, candidate_id, 'unmatched', NULL, NULL FROM found_b WHERE candidate_id NOT IN (SELECT right_id FROM pairs)""", extra=BOTH_SQL, recursive=True)
@stores_view
def incident_correspondence(spark, folder):
    return compare.correspond(durable(found(spark, folder)), durable(_reduced(spark, folder)))


DIFF_SQL = BOTH_SQL + """,
tangled AS (SELECT DISTINCT left_id FROM degrees WHERE ld > 1 OR rd > 1),
diffs AS (
  SELECT a.candidate_id AS left_id, d.right_id, CASE WHEN t.left_id IS NOT NULL THEN 'ambiguous' WHEN d.right_id IS NOT NULL THEN 'matched' ELSE 'lost' END AS status,
    a.selected AS a, coalesce(b.selected, []) AS b, a.stages AS a_n, coalesce(b.stages, 0) AS b_n
  FROM found a LEFT JOIN tangled t ON t.left_id = a.candidate_id LEFT JOIN degrees d ON d.left_id = a.candidate_id AND ld = 1 AND rd = 1
  LEFT JOIN found_b b ON b.candidate_id = d.right_id
  UNION ALL
  SELECT NULL, candidate_id, 'new', [], selected, 0, stages FROM found_b WHERE candidate_id NOT IN (SELECT right_id FROM pairs))"""
_SORTED = "array_to_string(list_sort(list_filter({x}, lambda e: {n} list_contains({y}, e))), ',')"
KEPT, LOST, GAINED = (_SORTED.format(x=x, y=y, n=n) for x, y, n in (("a", "b", ""), ("a", "b", "NOT"), ("b", "a", "NOT")))


def _diff(spark, folder):
    events = obs(spark, folder)
    return compare.sensitivity(events, resources(spark, folder), events.where(EXCLUDED).select("event_id"), CONFIG,
                               durable(found(spark, folder)))


@query(f"SELECT left_id, right_id, {KEPT} AS surviving, {LOST} AS removed, {GAINED} AS added FROM diffs", extra=DIFF_SQL, recursive=True)
@stores_view
def evidence_diff(spark, folder):
    sort = lambda c: joined(F.sort_array(c)).alias(c)
    return _diff(spark, folder).select("left_id", "right_id", sort("surviving"), sort("removed"), sort("added"))


@query("""
SELECT left_id, right_id, status, array_to_string((['authentication', 'collection', 'transfer'])[b_n + 1:a_n], ',') AS lost_stages,
  array_to_string((['authentication', 'collection', 'transfer'])[a_n + 1:b_n], ',') AS new_stages FROM diffs""", extra=DIFF_SQL, recursive=True)
@stores_view
def sensitivity(spark, folder):
    return _diff(spark, folder).select("left_id", "right_id", "status", joined("lost_stages").alias("lost_stages"),
                                       joined("new_stages").alias("new_stages"))


LONGER_SQL = """
longer AS (SELECT * REPLACE (until_us + 60000000 AS until_us) FROM authorizations),
fewer AS (SELECT * FROM obs WHERE NOT (%s)),
otherwise AS (SELECT * REPLACE (CASE WHEN user_id = 'u1' THEN 'u-one' ELSE user_id END AS user_id) FROM authorizations)""" % EXCLUDED
DIFFERENT = "(SELECT count(*) > 0 FROM ((SELECT * FROM {0} EXCEPT ALL SELECT * FROM {1}) UNION ALL (SELECT * FROM {1} EXCEPT ALL SELECT * FROM {0})))"


@query(f"""
SELECT 'events' AS input, {DIFFERENT.format('obs', 'fewer')} AS changed, (SELECT count(*) FROM obs) AS left_rows, (SELECT count(*) FROM fewer) AS right_rows
UNION ALL SELECT 'resources', {DIFFERENT.format('resources', 'resources')}, (SELECT count(*) FROM resources), (SELECT count(*) FROM resources)
UNION ALL SELECT 'authorizations', {DIFFERENT.format('authorizations', 'longer')}, (SELECT count(*) FROM authorizations), (SELECT count(*) FROM longer)""", extra=LONGER_SQL)
def run_comparison(spark, folder):
    """Two runs: the second has fewer events and extended authorizations; its labels come in another order."""
    events, labels, grants = obs(spark, folder), resources(spark, folder), authorizations(spark, folder)
    left = compare.run_inputs({"events": events, "resources": labels, "authorizations": grants})
    longer = grants.withColumn("effective_until", F.col("effective_until") + F.expr("interval 1 minute"))
    right = compare.run_inputs({"events": events.where(f"NOT ({EXCLUDED})"), "resources": labels.repartition(3), "authorizations": longer})
    return compare.changed_inputs(left, right).select("input", "changed", "left_rows", "right_rows")


@query(f"""
SELECT (e::BIGINT + a::BIGINT) AS changed_inputs, NOT e AS context_only
FROM (SELECT {DIFFERENT.format('obs', 'obs')} AS e, {DIFFERENT.format('authorizations', 'otherwise')} AS a)""", extra=LONGER_SQL)
def context_gate(spark, folder):
    """At most the authorizations differ, those of one account, so the comparison counts as controlled."""
    grants = authorizations(spark, folder)
    other = grants.withColumn("user_id", F.when(F.col("user_id") == "u1", "u-one").otherwise(F.col("user_id")))
    left = compare.run_inputs({"events": obs(spark, folder), "authorizations": grants})
    right = compare.run_inputs({"events": obs(spark, folder).repartition(5), "authorizations": other})
    return compare.context_only(compare.changed_inputs(left, right))


REPLAY_SQL = f"early AS (SELECT * FROM obs WHERE ts <= TIMESTAMP '{CUTOFF}')," + chain_sql("early", "e")


@query("SELECT candidate_id, decision, login_id, copy_id FROM found_e", extra=REPLAY_SQL, recursive=True)
def replay_at(spark, folder):
    return compare.replay(obs(spark, folder), resources(spark, folder), CONFIG, _moment(CUTOFF)).select(
        "candidate_id", "decision", "login_id", "copy_id")


@query("""
SELECT us FROM obs UNION SELECT us - us % 900000000 + 900000000 FROM obs WHERE us - us % 900000000 + 900000000 <= (SELECT max(us) FROM obs)
UNION SELECT min(us) - 1 FROM obs""")
def replay_stops(spark, folder):
    return compare.replay_stops(obs(spark, folder))


# One cutoff per day of January.
CUTOFFS = [1_704_067_200_000_000 + i * 86_400_000_000 for i in range(32)]


@query("""
SELECT c AS cutoff_us, count(*) FILTER (kept_s AND done_s) AS incident_count, count(*) FILTER (kept_s AND NOT done_s) AS partial_count
FROM cutoffs LEFT JOIN sweep USING (c) GROUP BY ALL""", extra=ALL_SQL + """,
cutoffs AS (SELECT 1704067200000000 + i * 86400000000 AS c FROM range(32) AS t(i)),
states AS (
  SELECT c, user_id, device_id, login_us, coalesce(copy_us <= c, FALSE) AS done_s, CASE WHEN copy_us <= c THEN copy_us ELSE first_read_us END AS end_s,
    row_number() OVER (PARTITION BY c, user_id, device_id ORDER BY login_us, login_id) AS rn FROM cands JOIN cutoffs ON first_read_us <= c),
sweep AS (
  SELECT c, user_id, device_id, rn, done_s, TRUE AS kept_s, end_s AS until_s FROM states WHERE rn = 1
  UNION ALL
  SELECT s.c, s.user_id, s.device_id, s.rn, s.done_s, s.login_us > w.until_s, CASE WHEN s.login_us > w.until_s THEN s.end_s ELSE w.until_s END
  FROM sweep w JOIN states s ON s.c = w.c AND s.user_id = w.user_id AND s.device_id = w.device_id AND s.rn = w.rn + 1)""", recursive=True)
def replay_sweep(spark, folder):
    return compare.replay_sweep(chain.candidates(obs(spark, folder), resources(spark, folder), CONFIG), CUTOFFS, CONFIG.window)


@query("""
SELECT event_id, 'not stored' AS problem FROM obs WHERE action = 'file_read' AND event_id % 50 = 0 UNION ALL
SELECT event_id, 'not reproduced' FROM obs WHERE action = 'usb_mount' AND event_id % 40 = 0""")
def result_verification(spark, folder):
    """A stored hit list that lost some reads and gained some mounts."""
    events = obs(spark, folder)
    hits = events.where("action = 'file_read'").select("event_id")
    stored = hits.where("event_id % 50 <> 0").unionByName(events.where("action = 'usb_mount' and event_id % 40 = 0").select("event_id"))
    return compare.verify_result(stored, hits)


@query("""
SELECT event_id, 'missing' AS side FROM obs WHERE event_id % 4 = 0 AND event_id % 6 <> 0 UNION ALL
SELECT event_id, 'extra' FROM obs WHERE event_id % 6 = 0 AND event_id % 4 <> 0""")
def view_diff(spark, folder):
    events = obs(spark, folder)
    return compare.view_diff(events.where("event_id % 4 = 0"), events.where("event_id % 6 = 0"))


@query("SELECT event_id, user_id FROM obs WHERE event_id IN (SELECT DISTINCT unnest(selected)::BIGINT FROM found)", extra=ALL_SQL, recursive=True)
def membership(spark, folder):
    ids = chain.evidence(found(spark, folder)).select(F.col("event_id").cast("bigint").alias("event_id"))
    return reports.events_by_ids(obs(spark, folder), ids).select("event_id", "user_id")


@query("SELECT -event_id - 1 AS event_id FROM obs WHERE action = 'logout' OR event_id % 8 = 0")
def missing_members(spark, folder):
    events = obs(spark, folder)
    ids = events.select("event_id").unionByName(events.where("event_id % 8 = 0").select((-F.col("event_id") - 1).alias("event_id")))
    return reports.missing_ids(events, ids)


# Source records: one per event and, for every ninth event, a second upload of it.
RECORDS_SQL = """
records AS (
  SELECT event_id, 1 AS upload, event_id || ':1' AS ref, k FROM obs UNION ALL
  SELECT event_id, 2, event_id || ':2', k FROM obs WHERE event_id % 9 = 0)"""


def _records(spark, folder):
    events = obs(spark, folder)
    body = F.to_json(F.struct(*RECORD), {"ignoreNullFields": "false"})
    first = events.select("event_id", "k", F.lit(1).alias("upload_id"), body.alias("raw_json"))
    rows = first.unionByName(first.where("event_id % 9 = 0").withColumn("upload_id", F.lit(2)))
    return rows.withColumn("record_ref", F.concat_ws(":", "event_id", "upload_id")).withColumn("row_number", F.col("event_id"))


@query("""
SELECT o.event_id, r.ref AS record_ref FROM obs o LEFT JOIN (SELECT * FROM records WHERE (event_id + upload) % 2 = 0) r ON r.event_id = o.event_id""",
       extra=RECORDS_SQL)
def evidence_rows(spark, folder):
    records = _records(spark, folder)
    frozen = records.where("(event_id + upload_id) % 2 = 0").select("record_ref")
    return reports.evidence_rows(obs(spark, folder), records.drop("k"), frozen).select("event_id", "record_ref")


@query("""
SELECT event_id, ref AS record_ref, unnest(list_filter([
    CASE WHEN k % 19 = 0 OR k % 23 = 0 OR k % 29 = 0 THEN 'record differs from its file' END, CASE WHEN k % 31 = 0 THEN 'record normalises to other content' END,
    CASE WHEN k % 19 = 0 AND upload = 1 THEN 'event holds another hash of its record' END], lambda e: e IS NOT NULL)) AS error
FROM records WHERE NOT (k % 37 = 0 AND upload = 1) UNION ALL
SELECT event_id, ref, 'own record of the event is gone' FROM records WHERE k % 37 = 0 AND upload = 1""", extra=RECORDS_SQL)
def provenance_errors(spark, folder):
    """Damage by k: stored hash, file row, file, renormalised content, lost record."""
    records, content, k = _records(spark, folder), F.sha2("raw_json", 256), F.col("k")
    events = records.where("upload_id = 1").select("event_id", F.col("record_ref").alias("raw_record_ref"),
                                                   content.alias("raw_record_sha256"), content.alias("content_sha256"))
    files = records.select("upload_id", "row_number", F.when(k % 23 == 0, "{}").otherwise(F.col("raw_json")).alias("file_row_json"),
                           (k % 29 != 0).alias("file_valid"))
    held = records.where("not (k % 37 = 0 and upload_id = 1)").select(
        "record_ref", "event_id", "upload_id", "row_number", "raw_json", F.when(k % 19 == 0, "x").otherwise(content).alias("raw_sha256"),
        F.when(k % 31 == 0, "x").otherwise(content).alias("renormalized_sha256"))
    return reports.provenance_errors(events, held, files)


RECORD_SQL = """sha256(to_json({{action: action, bytes_read: bytes_read, bytes_written: {0}, device_id: device_id, outcome: outcome,
  resource_id: resource_id, user_id: user_id}})::VARCHAR)"""


def _nodes(level: int, below: str) -> str:
    return f"""(SELECT substr(range, 1, {level}) AS range, sha256(string_agg(range || ':' || sha256, '|' ORDER BY range || ':' || sha256)) AS sha256, sum(n) AS n
  FROM {below} GROUP BY ALL)"""


@query("SELECT sha256 AS fingerprint, n::BIGINT AS event_count FROM level0", extra=f"""
rows_of AS (SELECT h, count(*) AS n FROM (SELECT {RECORD_SQL.format('bytes_written')} AS h FROM obs) GROUP BY h),
level6 AS (SELECT substr(h, 1, 6) AS range, sha256(string_agg(h || ':' || n, '|' ORDER BY h || ':' || n)) AS sha256, sum(n) AS n FROM rows_of GROUP BY ALL),
level4 AS {_nodes(4, 'level6')}, level2 AS {_nodes(2, 'level4')}, level0 AS {_nodes(0, 'level2')}""")
def fingerprint(spark, folder):
    return merkle.fingerprint(obs(spark, folder), RECORD)


TAMPERED = "CASE WHEN k % 23 = 0 THEN bytes_written + 1 ELSE bytes_written END"


@query("""
SELECT substr(h, 1, 3) AS range, sum(a)::BIGINT AS left_rows, sum(b)::BIGINT AS right_rows FROM both_sides
GROUP BY ALL HAVING bool_or(a <> b)""", extra=f"""
sides AS (SELECT {RECORD_SQL.format('bytes_written')} AS h, 1 AS a, 0 AS b FROM obs UNION ALL SELECT {RECORD_SQL.format(TAMPERED)}, 0, 1 FROM obs),
both_sides AS (SELECT h, sum(a) AS a, sum(b) AS b FROM sides GROUP BY h)""")
def changed_ranges(spark, folder):
    """Ranges of row hashes in which a run differs from one whose byte counts were raised here and there."""
    events = obs(spark, folder)
    left, right = (durable(merkle.tree(rows, RECORD, 3)) for rows in (events, events.withColumn("bytes_written", F.expr(TAMPERED))))
    return merkle.changed_ranges(left, right, 3)


@query("SELECT event_id, user_id, device_id, action FROM obs")
def redacted_events(spark, folder):
    return reports.redact(obs(spark, folder, domains=True)).select("event_id", "user_id", "device_id", "action")


@query("""
SELECT candidate_id, decision, array_to_string(selected, ',') AS cited, string_agg(e || ':' || o.action || ':' || o.user_id, ',' ORDER BY e || ':' || o.action) AS evidence,
  FALSE AS shows_private FROM (SELECT candidate_id, decision, selected, unnest(selected) AS e FROM found) JOIN obs o ON o.event_id::VARCHAR = e GROUP BY candidate_id, decision, selected""",
       extra=ALL_SQL, recursive=True)
def report_rows(spark, folder):
    """The JSON reports, read back: decision, cited ids, evidence, and whether private columns leaked."""
    rows = reports.report_rows(durable(found(spark, folder)), obs(spark, folder, domains=True))
    read = F.from_json("report", F.lit("incident struct<decision string, selected array<string>>, evidence array<string>"))
    item = lambda e: F.concat_ws(":", *[F.get_json_object(e, f"$.{c}") for c in ("event_id", "action", "user_id")])
    return rows.withColumn("r", read).select(
        "candidate_id", "r.incident.decision", joined("r.incident.selected").alias("cited"),
        joined(F.array_sort(F.transform("r.evidence", item))).alias("evidence"),
        F.col("report").rlike('"(src_ip|dst_ip|domain)') .alias("shows_private"))


LABELS_SQL = """
labels_ AS (
  SELECT 's' || candidate_id AS scenario_id, user_id, device_id, login_id, read_id, copy_id, mount_id, selected, login_us, read_us, copy_us, mount_us, bytes_written
  FROM found WHERE decision = 'incident' AND substr(user_id, 2)::INT % 2 = 0)"""


def _labels(rows):
    even = rows.where("decision = 'incident' and cast(substr(user_id, 2) as int) % 2 = 0")
    text = lambda c: F.col(c).cast("string")
    pair = lambda a, b: F.struct(text(a).alias("before"), text(b).alias("after"))
    return even.select(F.concat(F.lit("s"), "candidate_id").alias("scenario_id"), "user_id", "device_id", text("login_id").alias("authentication"),
                       text("read_id").alias("collection"), text("copy_id").alias("transfer"), F.array(text("mount_id")).alias("context"),
                       F.array(pair("login_id", "read_id"), pair("read_id", "copy_id"), pair("mount_id", "copy_id")).alias("order_constraints"),
                       "bytes_written")


@query("""
SELECT scenario_id, CASE bytes_written % 5 WHEN 0 THEN 'a stage cites no event' WHEN 1 THEN 'cites an event that is not there'
  WHEN 2 THEN 'cites another account or device' WHEN 3 THEN 'cites events in the wrong order' END AS problem FROM labels_ WHERE bytes_written % 5 < 4""",
       extra=ALL_SQL + "," + LABELS_SQL, recursive=True)
def label_violations(spark, folder):
    """Labels damaged by the copied byte count."""
    labels, m = _labels(found(spark, folder)), F.col("bytes_written") % 5
    swapped = F.transform("order_constraints", lambda c: F.struct(c["after"].alias("before"), c["before"].alias("after")))
    labels = (labels.withColumn("collection", F.when(m != 0, F.col("collection")))
              .withColumn("context", F.when(m == 1, F.array(F.lit("none"))).otherwise(F.col("context")))
              .withColumn("user_id", F.when(m == 2, "somebody").otherwise(F.col("user_id")))
              .withColumn("order_constraints", F.when(m == 3, swapped).otherwise(F.col("order_constraints"))))
    return evaluate.label_violations(durable(labels), obs(spark, folder))


@query("""
SELECT candidate_id, CASE WHEN first THEN scenario_id END AS scenario_id,
  CASE WHEN scenario_id IS NULL THEN 'unmatched' WHEN first THEN 'matched' ELSE 'duplicate_credit_rejected' END AS status
FROM (SELECT a.candidate_id, l.scenario_id, a.candidate_id = min(a.candidate_id) OVER (PARTITION BY l.scenario_id) AS first
  FROM (SELECT candidate_id, candidate_id AS original FROM found WHERE decision = 'incident' UNION ALL
    SELECT reverse(candidate_id), candidate_id FROM found WHERE decision = 'incident' AND bytes_written % 2 = 0) a
  LEFT JOIN labels_ l ON l.scenario_id = 's' || a.original)""", extra=ALL_SQL + "," + LABELS_SQL, recursive=True)
def episode_matching(spark, folder):
    """Some alerts raised twice under another id."""
    rows = durable(found(spark, folder))
    alerts = rows.where("decision = 'incident'")
    again = alerts.where("bytes_written % 2 = 0").withColumn("candidate_id", F.reverse("candidate_id"))
    return evaluate.match_episodes(alerts.unionByName(again), _labels(rows))


METRICS_SQL = ALL_SQL + "," + LABELS_SQL + """,
alerts AS (SELECT * FROM found WHERE decision = 'incident'),
units AS (SELECT DISTINCT user_id, device_id, day FROM obs),
cited AS (SELECT candidate_id, unnest(selected)::BIGINT AS event_id FROM alerts),
attacked AS (SELECT DISTINCT o.user_id, o.device_id, o.day FROM labels_ l, LATERAL (SELECT unnest([login_id, read_id, copy_id, mount_id]) AS e) x JOIN obs o ON o.event_id = x.e),
benign AS (SELECT * FROM units EXCEPT SELECT * FROM attacked),
false_hits AS (SELECT DISTINCT c.candidate_id, o.user_id, o.device_id, o.day FROM cited c JOIN obs o ON o.event_id = c.event_id
  JOIN benign b ON b.user_id = o.user_id AND b.device_id = o.device_id AND b.day = o.day),
n AS (SELECT (SELECT count(*) FROM labels_) AS labels, (SELECT count(*) FROM alerts) AS alerts, (SELECT count(*) FROM obs) AS events,
  (SELECT count(*) FROM benign) AS benign, (SELECT count(DISTINCT (user_id, device_id, day)) FROM false_hits) AS false_units,
  (SELECT count(DISTINCT candidate_id) FROM false_hits WHERE 's' || candidate_id NOT IN (SELECT scenario_id FROM labels_)) AS false_alerts,
  (SELECT sum(stages)::BIGINT FROM found) AS stages, (SELECT sum(CASE WHEN stages = 3 THEN 3 ELSE 1 END)::BIGINT FROM found) AS orders),
metric_rows AS (
  SELECT 'incident_precision' AS metric, labels AS num, alerts AS den FROM n UNION ALL SELECT 'incident_recall', labels, labels FROM n UNION ALL
  SELECT 'benign_user_device_day_fpr', false_units, benign FROM n UNION ALL SELECT 'benign_false_alerts_per_1000_events', false_alerts, events FROM n UNION ALL
  SELECT 'asserted_stage_evidence_coverage', stages, stages FROM n UNION ALL SELECT 'required_stage_recall', 3 * labels, 3 * labels FROM n UNION ALL
  SELECT 'ordering_constraint_coverage', 3 * labels, 3 * labels FROM n UNION ALL SELECT 'ordering_constraint_accuracy', orders, orders FROM n)"""


@query("""
SELECT metric, num AS numerator, den AS denominator, round(CASE WHEN den > 0 THEN num::DOUBLE / den * CASE WHEN metric LIKE '%1000%' THEN 1000 ELSE 1 END END, 6) AS value,
  CASE WHEN metric LIKE '%fpr' THEN round(greatest(0, c - h), 6) END AS low, CASE WHEN metric LIKE '%fpr' THEN round(least(1, c + h), 6) END AS high
FROM (SELECT *, (p + 1.96 * 1.96 / (2 * den)) / (1 + 1.96 * 1.96 / den) AS c, 1.96 * sqrt(p * (1 - p) / den + 1.96 * 1.96 / (4.0 * den * den)) / (1 + 1.96 * 1.96 / den) AS h
  FROM (SELECT *, num::DOUBLE / den AS p FROM metric_rows))""", extra=METRICS_SQL, recursive=True)
def metrics(spark, folder):
    rows = durable(found(spark, folder))
    return evaluate.evaluate(rows, durable(_labels(rows)), obs(spark, folder)).select(
        "metric", "numerator", "denominator", *[F.round(c, 6).alias(c) for c in ("value", "low", "high")])


@query("SELECT * FROM benign", extra=METRICS_SQL, recursive=True)
def benign_units(spark, folder):
    rows = found(spark, folder)
    return evaluate.benign_units(obs(spark, folder), _labels(rows))


@query("""
SELECT 'c' || c.event_id AS case_id, f.candidate_id, f.decision FROM (SELECT * FROM obs WHERE action = 'file_copy_to_usb') c
LEFT JOIN found f ON list_contains(f.selected, c.event_id::VARCHAR)""", extra=ALL_SQL, recursive=True)
def case_outcomes(spark, folder):
    """One case per copy, observed in that copy."""
    cases = obs(spark, folder).where("action = 'file_copy_to_usb'").select(
        F.concat(F.lit("c"), "event_id").alias("case_id"), F.array(F.col("event_id").cast("string")).alias("observed_refs"))
    return evaluate.case_outcomes(cases, found(spark, folder)).select("case_id", "candidate_id", "decision")


@query("""
SELECT candidate_id, array_to_string(list_filter([
  CASE WHEN login_us >= read_us THEN 'the read does not follow the login in time' END,
  CASE WHEN copy_id IS NOT NULL AND read_us >= copy_us THEN 'the copy does not follow the read in time' END,
  CASE WHEN bytes_written % 3 = 0 THEN 'the copy cites another mount' END,
  CASE WHEN bytes_written % 4 = 0 THEN 'the decision does not fit the stages' END], lambda e: e IS NOT NULL), ',') AS errors FROM found""",
       extra=ALL_SQL, recursive=True)
@stores_view
def revalidate(spark, folder):
    """Retained candidates, some with a forged mount or decision."""
    events, rows = obs(spark, folder), found(spark, folder)
    b = F.col("bytes_written")
    forged = durable(rows.withColumn("mount_id", F.when(b % 3 == 0, F.col("login_id")).otherwise(F.col("mount_id")))
                     .withColumn("mount_us", F.when(b % 3 == 0, F.col("login_us")).otherwise(F.col("mount_us")))
                     .withColumn("decision", F.when(b % 4 == 0, "partial_observation").otherwise(F.col("decision"))))
    return validate.validate(forged, events, resources(spark, folder), CONFIG).select("candidate_id", joined("errors").alias("errors"))


@query("""
SELECT event_id, total, next_cursor FROM (
  SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS total, CASE WHEN 150 < count(*) OVER () THEN 150::BIGINT END AS next_cursor FROM obs)
WHERE rn > 100 AND rn <= 150""")
def event_page(spark, folder):
    return paging.page(obs(spark, folder).select("event_id", "event_time"), ["event_time", "event_id"], 50, 100).select(
        "event_id", "total", F.col("next_cursor").cast("bigint").alias("next_cursor"))


@query("SELECT 'run' || day AS analysis_run_id, count(*) AS event_count FROM obs WHERE source_type = 'file' GROUP BY day ORDER BY day DESC LIMIT 10")
def recent_runs(spark, folder):
    """One run per day and family; the ten latest of one dataset."""
    runs = (obs(spark, folder).withColumn("created", utc_day(micros())).groupBy(F.col("source_type").alias("dataset_id"), "created")
            .agg(F.count("*").alias("event_count")).withColumn("analysis_run_id", F.concat(F.lit("run"), "created")))
    return paging.recent_runs(runs, "file", 10).select("analysis_run_id", "event_count")


@query("SELECT event_id, user_id FROM obs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 20")
def first_k(spark, folder):
    return paging.first_k(obs(spark, folder).select("event_id", "user_id", "event_time"), ["user_id"], ["event_time", "event_id"], 20).select(
        "event_id", "user_id")


@query("""
SELECT l.event_id, a.unusual AS login_unusual, r.event_id AS read_id, CASE WHEN r.event_id IS NOT NULL THEN a.prior_file_reads >= 3 AND f.first_day >= l.day END AS read_unusual
FROM logins l JOIN (SELECT event_id, prior_file_reads, done AND prior_successful_logins >= 3 AND (same_device_count = 0 OR same_app_count = 0 OR same_utc_hour_count = 0) AS unusual FROM auth) a
  ON a.event_id = l.event_id
LEFT JOIN reads r ON r.user_id = l.user_id AND r.device_id = l.device_id AND r.us > l.us AND r.us <= l.us + """ + str(CONFIG.window) + """
LEFT JOIN first_days f ON f.user_id = r.user_id AND f.resource_id = r.resource_id
QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY r.us, r.event_id) = 1""", extra=ALL_SQL.split("\nmounted AS")[0].rstrip(", \n"))
def history_probes(spark, folder):
    return chain.history_probes(obs(spark, folder), CONFIG)


# Case log: one entity per conversation, one revision per turn; every tenth conversation lost revision 2.
LOG_SQL = """
log AS (
  SELECT conv_id AS entity_id, turn + 1 AS revision, role AS author, text AS body,
    CASE turn % 4 WHEN 0 THEN CASE WHEN turn = 0 THEN 'open' ELSE 'investigating' END WHEN 1 THEN 'investigating' WHEN 2 THEN 'resolved' ELSE 'closed' END AS status,
    CASE WHEN turn % 4 = 0 AND turn > 0 AND conv_id % 4 <> 0 THEN 'case_reopened' ELSE 'case_updated' END AS operation,
    CASE WHEN conv_id % 3 = 0 THEN 'undetermined' ELSE 'benign' END AS disposition, CASE WHEN conv_id % 5 = 0 THEN '' ELSE 'checked' END AS reason,
    CASE WHEN conv_id % 2 = 0 THEN 'high' ELSE 'low' END AS priority
  FROM conversations WHERE NOT (conv_id % 10 = 9 AND turn = 1)),
latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY revision DESC) = 1)"""


def _log(spark, folder):
    c, t = F.col("conv_id"), F.col("turn")
    step = t % 4
    return (table(spark, folder, "conversations").where("not (conv_id % 10 = 9 and turn = 1)").select(
        c.alias("entity_id"), (t + 1).alias("revision"), F.col("role").alias("author"), F.col("text").alias("body"),
        F.when(step == 0, F.when(t == 0, "open").otherwise("investigating")).when(step == 1, "investigating")
        .when(step == 2, "resolved").otherwise("closed").alias("status"),
        F.when((step == 0) & (t > 0) & (c % 4 != 0), "case_reopened").otherwise("case_updated").alias("operation"),
        F.when(c % 3 == 0, "undetermined").otherwise("benign").alias("disposition"),
        F.when(c % 5 == 0, "").otherwise("checked").alias("reason"), F.when(c % 2 == 0, "high").otherwise("low").alias("priority")))


@query("SELECT entity_id, revision, status, body FROM latest", extra=LOG_SQL)
def latest_revision(spark, folder):
    return revisions.latest_revision(_log(spark, folder), "entity_id").select("entity_id", "revision", "status", "body")


@query("SELECT entity_id, revision FROM latest WHERE entity_id % 6 = 1", extra=LOG_SQL)
def current_mismatches(spark, folder):
    log = _log(spark, folder)
    current = revisions.latest_revision(log, "entity_id").withColumn(
        "body", F.when(F.col("entity_id") % 6 == 1, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return revisions.current_mismatches(current, log, "entity_id")


@query("""
SELECT l.entity_id, l.revision, p.revision IS NOT NULL AS has_previous, CASE WHEN p.revision IS NULL THEN '' ELSE array_to_string(list_filter([
  CASE WHEN l.author IS DISTINCT FROM p.author THEN 'author' END, CASE WHEN l.status IS DISTINCT FROM p.status THEN 'status' END,
  CASE WHEN l.body IS DISTINCT FROM p.body THEN 'body' END], lambda e: e IS NOT NULL), ',') END AS changed
FROM log l LEFT JOIN log p ON p.entity_id = l.entity_id AND p.revision = l.revision - 1""", extra=LOG_SQL)
def audit_diff(spark, folder):
    return revisions.audit_diff(_log(spark, folder), "entity_id", ["author", "status", "body"]).select(
        "entity_id", "revision", "has_previous", joined("changed").alias("changed"))


@query("""
SELECT entity_id, revision, violation FROM (
  SELECT l.entity_id, l.revision, CASE WHEN l.revision > 1 AND p.revision IS NULL THEN 'revision gap' WHEN l.revision = 1 AND l.status <> 'open' THEN 'first revision must be open'
    WHEN p.revision IS NOT NULL AND NOT (p.status || '>' || l.status IN ('open>open', 'open>investigating', 'investigating>investigating', 'investigating>resolved', 'resolved>resolved', 'resolved>closed')
      OR (l.operation = 'case_reopened' AND p.status IN ('resolved', 'closed') AND l.status = 'investigating')) THEN 'illegal transition'
    WHEN l.status = 'closed' AND p.status <> 'closed' AND trim(l.reason) = '' THEN 'closing needs a rationale'
    WHEN l.status = 'closed' AND p.status <> 'closed' AND l.disposition = 'undetermined' THEN 'closing needs a disposition' END AS violation
  FROM log l LEFT JOIN log p ON p.entity_id = l.entity_id AND p.revision = l.revision - 1) WHERE violation IS NOT NULL""", extra=LOG_SQL)
def transition_violations(spark, folder):
    return revisions.transition_violations(_log(spark, folder), "entity_id")


@query("""
SELECT entity_id, revision FROM latest WHERE status = 'closed' AND priority = 'high' AND contains(lower(author || ' ' || body), 'en')""", extra=LOG_SQL)
def case_search(spark, folder):
    latest = revisions.latest_revision(_log(spark, folder), "entity_id").withColumnRenamed("author", "title")
    return revisions.search_cases(latest, "EN", "closed", "high").select("entity_id", "revision")


@query("""
SELECT user_id, device_id, min(us) AS start_us, max(us) + 3600000000 AS end_us, count(*) AS events FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id, device_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM (
    SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id, device_id ORDER BY us, event_id) <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM obs))
GROUP BY user_id, device_id, burst""")
def sessions(spark, folder):
    return session_rows(obs(spark, folder), "60 minutes").select(
        "user_id", "device_id", micros("session_start").alias("start_us"), micros("session_end").alias("end_us"), "events")
