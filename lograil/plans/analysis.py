"""Queries over features, scores, risk, graph, hunts and indicators."""
import re

from pyspark.sql import functions as F

from lograil.functions.stats import wilson as wilson_interval
from lograil.operators import attack, chain, context, evaluate, features, forest, graph, hunts, intel, ranks, reports, risk
from lograil.operators.history import completed
from lograil.operators.ordered import MINUTE, micros
from lograil.plans.detection import ALL_SQL, EVENTS_SQL, FROZEN, found, joined
from lograil.plans.obs import aliases, authorizations, hosts, obs, resources, stores_view
from lograil.plans.obs import _base as base_events
from lograil.plans.registry import query
from lograil.session import durable

FEATURES_SQL = f"""
hist AS (SELECT * FROM obs WHERE done AND ts < TIMESTAMP '{FROZEN}'),
totals AS (SELECT user_id, count(*) FILTER (action = 'login_success') AS logins, count(*) FILTER (action = 'file_read') AS reads FROM hist GROUP BY ALL),
h_dev AS (SELECT DISTINCT user_id, device_id FROM hist WHERE action = 'login_success'),
h_app AS (SELECT DISTINCT user_id, app_id FROM hist WHERE action = 'login_success'),
h_hour AS (SELECT DISTINCT user_id, hour FROM hist WHERE action = 'login_success'),
h_res AS (SELECT DISTINCT user_id, resource_id FROM hist WHERE action = 'file_read'),
marked AS (
  SELECT o.*, o.us - o.us % 900000000 AS window_us, o.done AND o.action = 'login_success' AS login, o.done AND o.action = 'file_read' AS is_read,
    ha.app_id IS NULL AS fresh_app, hr.resource_id IS NULL AS fresh_res
  FROM obs o LEFT JOIN h_app ha ON ha.user_id = o.user_id AND ha.app_id = o.app_id
  LEFT JOIN h_res hr ON hr.user_id = o.user_id AND hr.resource_id = o.resource_id WHERE o.ts >= TIMESTAMP '{FROZEN}'),
grouped AS (
  SELECT user_id, device_id, window_us, count(*) AS event_count, count(*) FILTER (action = 'login_failure') AS login_failures,
    count(*) FILTER (login) AS successful_logins, count(*) FILTER (login AND fresh_app) AS new_apps,
    count(DISTINCT resource_id) FILTER (is_read) AS distinct_resources, count(*) FILTER (is_read) AS n_reads,
    count(*) FILTER (is_read AND fresh_res) AS rare, count(*) FILTER (is_read AND k % 2 = 0) AS sensitive_reads,
    coalesce(sum(bytes_read) FILTER (done), 0)::BIGINT AS bytes_read, coalesce(sum(bytes_written) FILTER (done), 0)::BIGINT AS bytes_written,
    coalesce(sum(bytes_written) FILTER (done AND action = 'file_copy_to_usb'), 0)::BIGINT AS usb_bytes,
    count(DISTINCT dst_ip) FILTER (done) AS distinct_destinations
  FROM marked GROUP BY ALL),
windows AS (
  SELECT g.*, NOT coalesce(t.logins >= 3 AND t.reads >= 3, FALSE) AS cold_start,
    CASE WHEN t.logins >= 3 AND t.reads >= 3 AND hd.device_id IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS new_device_fraction,
    CASE WHEN t.logins >= 3 AND t.reads >= 3 AND hh.hour IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS unusual_hour_fraction,
    CASE WHEN t.logins >= 3 AND t.reads >= 3 THEN new_apps::DOUBLE / greatest(1, successful_logins) ELSE 0 END::DOUBLE AS new_app_fraction,
    CASE WHEN t.logins >= 3 AND t.reads >= 3 THEN rare::DOUBLE / greatest(1, n_reads) ELSE 0 END::DOUBLE AS rare_resource_fraction,
    window_us + 900000000 > epoch_us(TIMESTAMP '2024-01-28 12:05:00') AS provisional
  FROM grouped g LEFT JOIN totals t ON t.user_id = g.user_id LEFT JOIN h_dev hd ON hd.user_id = g.user_id AND hd.device_id = g.device_id
  LEFT JOIN h_hour hh ON hh.user_id = g.user_id AND hh.hour = (g.window_us % 86400000000) // 3600000000),
rarity AS (
  SELECT *, CASE WHEN NOT cold_start THEN round(new_device_fraction + new_app_fraction + unusual_hour_fraction + rare_resource_fraction
      + 0.1 * sensitive_reads + 0.05 * ln(1 + usb_bytes), 6) END AS raw FROM windows),
calib AS (SELECT raw FROM rarity WHERE raw IS NOT NULL AND window_us < epoch_us(TIMESTAMP '2024-01-23 00:00:00')),
scored_windows AS (
  SELECT r.*, CASE WHEN raw IS NOT NULL THEN ((SELECT count(*) FROM calib c WHERE c.raw < r.raw) + (SELECT count(*) FROM calib c WHERE c.raw <= r.raw))
    / (2.0 * (SELECT count(*) FROM calib)) END::DOUBLE AS pct FROM rarity r)"""


def _windows(spark, folder, as_of=None):
    events, moment = obs(spark, folder), F.lit(FROZEN).cast("timestamp")
    return features.window_features(events.where(F.col("event_time") >= moment), events.where(F.col("event_time") < moment),
                                    resources(spark, folder), as_of)


def _rarity(spark, folder):
    """A deterministic score standing in for the forest, so that SQL can check what follows."""
    score = F.round(F.col("new_device_fraction") + F.col("new_app_fraction") + F.col("unusual_hour_fraction")
                    + F.col("rare_resource_fraction") + 0.1 * F.col("sensitive_reads") + 0.05 * F.log1p("usb_bytes"), 6)
    return _windows(spark, folder).withColumn("raw_anomaly_score", F.when(~F.col("cold_start"), score))


def _scored_windows(spark, folder, rows=None):
    rows = durable(_rarity(spark, folder)) if rows is None else rows
    calibration = rows.where("raw_anomaly_score is not null and window_us < unix_micros(timestamp '2024-01-23 00:00:00')")
    return ranks.midrank(rows, calibration, "raw_anomaly_score")


@query("""
SELECT user_id, device_id, window_us, event_count, login_failures, successful_logins, new_device_fraction, round(new_app_fraction, 6) AS new_app_fraction,
  unusual_hour_fraction, distinct_resources, round(rare_resource_fraction, 6) AS rare_resource_fraction, sensitive_reads, bytes_read, bytes_written,
  usb_bytes, distinct_destinations, cold_start, provisional,
  round(ln(1 + bytes_read), 6) AS log_bytes_read, round(ln(1 + sensitive_reads), 6) AS log_sensitive_reads
FROM windows""", extra=FEATURES_SQL.replace("WHERE o.ts >=", "WHERE o.ts <= TIMESTAMP '2024-01-28 12:05:00' AND o.ts >="))
def window_features(spark, folder):
    raw = _windows(spark, folder, F.lit("2024-01-28 12:05:00").cast("timestamp"))
    logged = features.transform_features(raw.withColumn("b", F.col("bytes_read")).withColumn("s", F.col("sensitive_reads")))
    log = lambda c: F.round(F.log1p(F.col(c).cast("double")), 6)
    return logged.select(
        *features.WINDOW, "event_count", F.round(F.expm1("login_failures")).cast("bigint").alias("login_failures"),
        F.round(F.expm1("successful_logins")).cast("bigint").alias("successful_logins"), "new_device_fraction",
        F.round("new_app_fraction", 6).alias("new_app_fraction"), "unusual_hour_fraction",
        F.round(F.expm1("distinct_resources")).cast("bigint").alias("distinct_resources"),
        F.round("rare_resource_fraction", 6).alias("rare_resource_fraction"), F.col("s").alias("sensitive_reads"),
        F.col("b").alias("bytes_read"), F.round(F.expm1("bytes_written")).cast("bigint").alias("bytes_written"),
        F.round(F.expm1("usb_bytes")).cast("bigint").alias("usb_bytes"),
        F.round(F.expm1("distinct_destinations")).cast("bigint").alias("distinct_destinations"), "cold_start", "provisional",
        F.round("bytes_read", 6).alias("log_bytes_read"), log("s").alias("log_sensitive_reads"))


@query("SELECT user_id, device_id, window_us, raw AS raw_anomaly_score, round(pct, 6) AS anomaly_percentile FROM scored_windows", extra=FEATURES_SQL)
@stores_view
def midrank(spark, folder):
    return _scored_windows(spark, folder).select(*features.WINDOW, "raw_anomaly_score",
                                                 F.round("anomaly_percentile", 6).alias("anomaly_percentile"))


QUANTILE_SQL = """
ordered AS (SELECT raw, row_number() OVER (ORDER BY raw) - 1 AS pos, count(*) OVER () AS n FROM calib),
alarm AS (SELECT raw AS quantile FROM ordered WHERE pos = ceil(0.99 * (n - 1)))"""


def _alarm(rows):
    calibration = rows.where("raw_anomaly_score is not null and window_us < unix_micros(timestamp '2024-01-23 00:00:00')")
    return ranks.quantile_higher(calibration, "raw_anomaly_score", 0.99)


@query("SELECT quantile FROM alarm", extra=FEATURES_SQL + "," + QUANTILE_SQL)
@stores_view
def quantile_higher(spark, folder):
    return _alarm(durable(_rarity(spark, folder).select("window_us", "raw_anomaly_score")))


def _features_sql(history: str, own: str, name: str) -> str:
    """The window features of another choice of history and events, under other names."""
    text = FEATURES_SQL[:FEATURES_SQL.index("rarity AS (")].strip().rstrip(",")
    text = text.replace(f"WHERE done AND ts < TIMESTAMP '{FROZEN}'", f"WHERE done AND {history}").replace(f"WHERE o.ts >= TIMESTAMP '{FROZEN}'", f"WHERE {own}")
    for word in ("hist", "totals", "h_dev", "h_app", "h_hour", "h_res", "marked", "grouped", "windows"):
        text = re.sub(rf"\b{word}\b", f"{word}_{name}", text)
    return text


VECTOR_SQL = "[" + ", ".join(f"round(ln(1 + {c}::DOUBLE), 6)" if c in features.LOGGED else f"round({c}::DOUBLE, 6)" for c in features.NAMES) + "]"
WIDE_SQL = ", ".join(f"{{0}}(v[{i + 1}])" for i in range(len(features.NAMES)))
HEX_SQL = "('0x' || substr(md5('17|' || tree_id || '|' || node_id || '|{0}'), 1, 12))::BIGINT"


def _forest_sql(windows: str) -> str:
    """The forest grown level by level: draws and splits are hashes and sums that any engine repeats."""
    levels = [f"""
ring AS (SELECT v, row_number() OVER (ORDER BY draw, user_id, device_id, window_us) - 1 AS place, count(*) OVER () AS n FROM (
  SELECT user_id, device_id, window_us, {VECTOR_SQL} AS v, md5(concat_ws('|', 17, user_id, device_id, window_us)) AS draw
  FROM {windows} WHERE NOT cold_start ORDER BY draw, user_id, device_id, window_us LIMIT 51200)),
part0 AS (SELECT t AS tree_id, 0::BIGINT AS node_id, ceil(log2(greatest(least(n, 256), 2))) AS deepest, v FROM ring, range(200) AS trees(t)
  WHERE n < 256 OR ((place - t * 256) % n + n) % n < 256)"""]
    for depth in range(9):
        levels.append(f"""
node{depth} AS (SELECT tree_id, node_id, size, f, CASE WHEN split >= hi[f] THEN lo[f] ELSE split END AS split FROM (
  SELECT *, lo[f] + {HEX_SQL.format('split')} / 281474976710656.0::DOUBLE * (hi[f] - lo[f]) AS split FROM (
    SELECT *, CASE WHEN {depth} < deepest AND size > 1 AND len(spread) > 0 THEN spread[1 + {HEX_SQL.format('feature')} % len(spread)] END AS f FROM (
      SELECT *, list_filter(range(1, {len(features.NAMES) + 1}), lambda i: hi[i] > lo[i]) AS spread FROM (
        SELECT tree_id, node_id, deepest, count(*) AS size, [{WIDE_SQL.format('min')}] AS lo, [{WIDE_SQL.format('max')}] AS hi FROM part{depth} GROUP BY ALL)))))""")
        if depth < 8:
            levels.append(f"""
part{depth + 1} AS (SELECT tree_id, 2 * node_id + CASE WHEN v[f] <= split THEN 1 ELSE 2 END AS node_id, deepest, v
  FROM part{depth} JOIN node{depth} USING (tree_id, node_id) WHERE f IS NOT NULL)""")
    levels.append("model AS (" + " UNION ALL ".join(f"SELECT *, {depth} AS depth FROM node{depth}" for depth in range(9)) + ")")
    return ",".join(levels)


def _depth_sql(size: str) -> str:
    return f"CASE WHEN {size} > 2 THEN 2 * (ln({size} - 1) + 0.5772156649015329) - 2 * ({size} - 1) / {size}::DOUBLE WHEN {size} = 2 THEN 1 ELSE 0 END"


WALK_SQL = ",".join(["""
walk0 AS (SELECT user_id, device_id, window_us, %s AS v, t AS tree_id, 0::BIGINT AS node_id FROM windows, range(200) AS trees(t) WHERE NOT cold_start)""" % VECTOR_SQL]
                    + [f"""
walk{d + 1} AS (SELECT user_id, device_id, window_us, v, tree_id, CASE WHEN f IS NULL THEN node_id WHEN v[f] <= split THEN 2 * node_id + 1 ELSE 2 * node_id + 2 END AS node_id
  FROM walk{d} JOIN model USING (tree_id, node_id))""" for d in range(8)])


@query(f"""
SELECT user_id, device_id, window_us, round(2 ^ (-path / base), 9) AS raw_anomaly_score FROM windows LEFT JOIN (
  SELECT user_id, device_id, window_us, avg(depth + {_depth_sql('size')}) AS path FROM walk8 JOIN model USING (tree_id, node_id) GROUP BY ALL)
USING (user_id, device_id, window_us), (SELECT {_depth_sql('max(size)')} AS base FROM node0)""",
       extra=FEATURES_SQL + "," + _features_sql(f"ts < TIMESTAMP '{FROZEN}'", f"o.ts < TIMESTAMP '{FROZEN}'", "early") + "," + _forest_sql("windows_early") + "," + WALK_SQL)
@stores_view
def forest_scores(spark, folder):
    """Fit on the windows before the boundary, score those after it."""
    events, moment = obs(spark, folder), F.lit(FROZEN).cast("timestamp")
    early = events.where(F.col("event_time") < moment)
    fitting = durable(features.transform_features(features.window_features(early, early, resources(spark, folder))))
    model = forest.fit_forest(fitting, features.WINDOW)
    return forest.score_forest(features.transform_features(_windows(spark, folder)), model).select(
        *features.WINDOW, F.round("raw_anomaly_score", 9).alias("raw_anomaly_score"))


@query("""
SELECT tree_id::INTEGER AS tree_id, node_id::INTEGER AS node_id, coalesce(f - 1, -1)::INTEGER AS feature, round(coalesce(split, 0), 9) AS split,
  CASE WHEN f IS NULL THEN -1 ELSE 2 * node_id + 1 END::INTEGER AS left, CASE WHEN f IS NULL THEN -1 ELSE 2 * node_id + 2 END::INTEGER AS right, size::INTEGER AS size
FROM model""", extra=_features_sql("TRUE", "TRUE", "all") + "," + _forest_sql("windows_all"))
@stores_view
def forest_model(spark, folder):
    """The model table: a fixed number of trees, each from its own hash-drawn sample."""
    events = obs(spark, folder)
    fitting = durable(features.transform_features(features.window_features(events, events, resources(spark, folder))))
    return forest.fit_forest(fitting, features.WINDOW).withColumn("split", F.round("split", 9))


RISK_SQL = f"""
links AS (
  SELECT event_id FROM (SELECT o.event_id, count(DISTINCT a.canonical_user_id) AS n, min(a.canonical_user_id) IN (SELECT alias_user_id FROM aliases) AS chained
    FROM obs o JOIN aliases a ON a.alias_user_id = o.user_id AND a.effective_from <= o.ts AND o.ts < a.effective_until GROUP BY ALL)
  WHERE n = 1 AND NOT chained),
reductions AS (
  SELECT f.candidate_id FROM found f JOIN authorizations a ON a.user_id = f.user_id AND a.device_id = f.device_id AND a.resource_id = f.resource_id
    AND a.from_us <= f.copy_us AND f.copy_us < a.until_us GROUP BY ALL),
near AS (
  SELECT f.candidate_id, max(w.pct) AS pct FROM found f, LATERAL (SELECT unnest(selected)::BIGINT AS event_id) e
  JOIN obs o ON o.event_id = e.event_id JOIN scored_windows w ON w.user_id = o.user_id AND w.device_id = o.device_id
    AND w.window_us = o.us - o.us % 900000000 WHERE w.pct IS NOT NULL GROUP BY ALL),
parts AS (
  SELECT f.*, f.stages / 3.0 AS c, n.pct, coalesce(n.pct, 0) AS a,
    CASE WHEN EXISTS (SELECT 1 FROM links l WHERE list_contains(f.selected, l.event_id::VARCHAR)) THEN 0.9 ELSE 1.0 END AS l,
    CASE WHEN f.stages = 3 THEN least(f.bytes_written / 1048576.0, 1.0) ELSE 0 END AS i,
    CASE WHEN f.candidate_id IN (SELECT candidate_id FROM reductions) THEN 20.0 ELSE 0.0 END AS b
  FROM found f LEFT JOIN near n ON n.candidate_id = f.candidate_id),
risky AS (
  SELECT *, round(greatest(0, least(100, 50 * c + 20 * a + 20 * l + 10 * i - b)), 6)::DOUBLE AS risk,
    round(greatest(0, least(100, 50 * c + 20 * l + 10 * i - b)), 6)::DOUBLE AS risk0 FROM parts)"""
SCORED_SQL = ",".join((ALL_SQL, FEATURES_SQL, RISK_SQL))


def _risky(spark, folder, windows=None):
    events = durable(found(spark, folder))
    _, links, _ = context.resolve(obs(spark, folder), aliases(spark, folder))
    copies = events.where("copy_id is not null").select(
        "candidate_id", F.col("user_id").alias("copy_user"), F.col("device_id").alias("copy_device"),
        F.col("resource_id").alias("copy_resource"), F.lit("file_copy_to_usb").alias("copy_action"), F.col("copy_us"))
    reductions = context.authorize(copies, authorizations(spark, folder))
    scored = risk.hybrid_risk(events, _scored_windows(spark, folder, windows), links, reductions)
    return scored.withColumn("risk", F.round("risk", 6))


@query("SELECT candidate_id, round(pct, 6) AS percentile FROM near", extra=SCORED_SQL, recursive=True)
@stores_view
def candidate_windows(spark, folder):
    return risk.candidate_windows(found(spark, folder), _scored_windows(spark, folder)).groupBy("candidate_id").agg(
        F.round(F.max("anomaly_percentile"), 6).alias("percentile"))


@query("""
SELECT candidate_id, risk, l::DOUBLE AS link, b::DOUBLE AS reduction, CASE WHEN stages < 3 THEN 'partial_observation' WHEN risk < 80 OR pct IS NULL THEN 'review' ELSE 'incident' END AS decision
FROM risky""", extra=SCORED_SQL, recursive=True)
@stores_view
def hybrid_risk(spark, folder):
    return risk.decide(_risky(spark, folder), risk.FLOOR).select("candidate_id", "risk", F.col("L").alias("link"),
                                                                 F.col("B").alias("reduction"), "decision")


@query("""
SELECT candidate_id, risk0 AS risk, CASE WHEN stages < 3 THEN 'partial_observation' WHEN risk0 < 75 OR pct IS NULL THEN 'review' ELSE 'incident' END AS decision
FROM risky""", extra=SCORED_SQL, recursive=True)
@stores_view
def ablation(spark, folder):
    return risk.neutralise(_risky(spark, folder), 75.0).select("candidate_id", F.round("risk", 6).alias("risk"), "decision")


@query("""
SELECT count(*) FILTER (stages = 3 AND NOT (risk < 80 OR pct IS NULL)) AS incident_count, count(*) FILTER (stages < 3) AS partial_count,
  count(*) FILTER (stages = 3 AND (risk < 80 OR pct IS NULL)) AS review_count FROM risky""", extra=SCORED_SQL, recursive=True)
@stores_view
def decision_counts(spark, folder):
    return reports.run_summary(risk.decide(_risky(spark, folder), risk.FLOOR))


UNITS_SQL = """
units AS (SELECT DISTINCT user_id, device_id, day FROM obs),
touched AS (
  SELECT DISTINCT r.candidate_id, r.risk, o.user_id, o.device_id, o.day FROM risky r, LATERAL (SELECT unnest(selected)::BIGINT AS event_id) e
  JOIN obs o ON o.event_id = e.event_id WHERE r.stages = 3),
cuts AS (SELECT 80.0::DOUBLE AS cut UNION SELECT risk + 1e-8 FROM risky WHERE stages = 3 AND risk < 100),
tested AS (SELECT cut, count(DISTINCT (user_id, device_id, day)) AS bad FROM cuts LEFT JOIN touched ON risk >= cut GROUP BY ALL),
choice AS (SELECT min(cut) AS cut FROM tested WHERE bad / (SELECT count(*) FROM units) <= 0.01)"""


@query("""
SELECT CASE WHEN useful THEN cut ELSE 80.0 END::DOUBLE AS threshold, (SELECT count(*) FROM units) AS benign_units,
  (SELECT bad FROM tested t WHERE t.cut = CASE WHEN useful THEN c.cut ELSE 80.0 END) AS false_units, n AS complete_candidates,
  CASE WHEN n = 0 THEN 'insufficient_complete_candidates' WHEN useful THEN 'empirical_budget_met' ELSE 'budget_not_met' END AS status,
  CASE WHEN n > 0 AND useful THEN 'benign_calibration_candidate_boundary' ELSE 'structural_fallback' END AS threshold_origin
FROM (SELECT cut, n, cut IS NOT NULL AND (n = 0 OR best >= cut) AS useful FROM choice, (SELECT count(*) AS n, max(risk) AS best FROM risky WHERE stages = 3)) c""",
       extra=SCORED_SQL + "," + UNITS_SQL, recursive=True)
@stores_view
def threshold_calibration(spark, folder):
    return risk.calibrate(durable(_risky(spark, folder)), risk.active_units(obs(spark, folder), micros()))


@query("""
SELECT count(*) FILTER (raw >= quantile) AS alert_count, count(raw) AS eligible_windows, count(*) FILTER (raw IS NULL) AS missing_windows,
  count(*) FILTER (raw = quantile) AS threshold_ties, count(*) FILTER (raw >= quantile AND user_id[-1:] NOT IN ('0', '5')) AS false_alarms,
  count(DISTINCT (user_id, device_id, window_us // 86400000000)) FILTER (raw >= quantile AND user_id[-1:] NOT IN ('0', '5')) AS false_units
FROM rarity, alarm""", extra=FEATURES_SQL + "," + QUANTILE_SQL)
@stores_view
def anomaly_alarms(spark, folder):
    """Users whose number ends in 0 or 5 count as attacked; the rest is benign."""
    benign = risk.active_units(obs(spark, folder).where("user_number % 5 <> 0"), micros())
    windows = durable(_rarity(spark, folder))
    return risk.anomaly_alarms(windows, benign, _alarm(windows).scalar())


@query("""
SELECT count(*) FILTER (stages = 3) AS complete_candidates, min(risk) FILTER (stages = 3) AS lowest_score, max(risk) FILTER (stages = 3) AS highest_score,
  count(*) FILTER (stages = 3 AND risk >= 80 AND pct IS NOT NULL) AS alerts_at_threshold,
  (SELECT count(raw) FROM rarity) AS scored_windows, (SELECT count(*) FROM rarity, alarm WHERE raw >= quantile) AS window_alarms,
  (SELECT count(*) FROM rarity, alarm WHERE raw = quantile) AS alarm_ties FROM risky""", extra=SCORED_SQL + "," + QUANTILE_SQL, recursive=True)
@stores_view
def calibration_audit(spark, folder):
    windows = durable(_rarity(spark, folder))
    return evaluate.calibration_audit(durable(_risky(spark, folder, windows)), windows, risk.FLOOR,
                                      _alarm(windows).select("quantile").scalar())


@query("""
SELECT action, n, bad, round(greatest(0, c - h), 6) AS low, round(least(1, c + h), 6) AS high, round(p, 6) AS rate FROM (
  SELECT *, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS c,
    1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n) AS h
  FROM (SELECT action, count(*) AS n, count(*) FILTER (NOT done) AS bad, (count(*) FILTER (NOT done))::DOUBLE / count(*) AS p FROM obs GROUP BY ALL))""")
def wilson(spark, folder):
    rows = obs(spark, folder).groupBy("action").agg(F.count("*").alias("n"), F.count_if(~completed()).alias("bad"))
    return rows.withColumn("w", wilson_interval(F.col("bad"), F.col("n"))).select(
        "action", "n", "bad", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"),
        F.round(F.col("bad") / F.col("n"), 6).alias("rate"))


@query("""
SELECT source_type AS mode, action AS metric, profile, sum(bad)::BIGINT AS numerator, sum(n)::BIGINT AS denominator, round(sum(bad) / sum(n), 6) AS value
FROM (SELECT source_type, action, user_number % 3 AS profile, count(*) AS n, count(*) FILTER (NOT done) AS bad FROM obs GROUP BY ALL)
GROUP BY GROUPING SETS ((source_type, action, profile), (source_type, action))""")
def profile_totals(spark, folder):
    per = obs(spark, folder).groupBy(F.col("source_type").alias("mode"), F.col("action").alias("metric"),
                                     (F.col("user_number") % 3).alias("profile")).agg(
        F.count_if(~completed()).alias("numerator"), F.count("*").alias("denominator"))
    return evaluate.aggregate_profiles(per).withColumn("value", F.round("value", 6))


NODES_SQL = """
iso AS (
  SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 = 0 THEN '' ELSE '.' || lpad((us % 1000000)::VARCHAR, 6, '0') END || '+00:00' AS stamp FROM obs),
nodes AS (
  SELECT user_id AS node_id, 'user' AS entity_type FROM obs UNION SELECT device_id, 'endpoint' FROM obs UNION SELECT app_id, 'app' FROM obs
  UNION SELECT resource_id, 'file' FROM obs UNION SELECT removable_device_id, 'removable_device' FROM obs
  UNION SELECT 'env:ip:' || url_encode(src_ip || '@' || stamp), 'ip' FROM iso WHERE done
  UNION SELECT 'env:ip:' || url_encode(dst_ip || '@' || stamp), 'ip' FROM iso WHERE done)"""
EDGES_SQL = NODES_SQL + """,
relations AS (
  SELECT *, user_id AS source, app_id AS target, 'authenticated_to' AS relation FROM iso WHERE done AND action = 'login_success' UNION ALL
  SELECT *, user_id, device_id, 'session_on' FROM iso WHERE done AND action = 'login_success' UNION ALL
  SELECT *, user_id, resource_id, 'read_file' FROM iso WHERE done AND action = 'file_read' UNION ALL
  SELECT *, resource_id, device_id, 'local_file_on' FROM iso WHERE done AND action = 'file_read' UNION ALL
  SELECT *, removable_device_id, device_id, 'mounted_on' FROM iso WHERE done AND action = 'usb_mount' UNION ALL
  SELECT *, resource_id, removable_device_id, 'copied_to' FROM iso WHERE done AND action = 'file_copy_to_usb' AND bytes_written > 0 UNION ALL
  SELECT *, user_id, device_id, 'copy_on' FROM iso WHERE done AND action = 'file_copy_to_usb' AND bytes_written > 0 UNION ALL
  SELECT *, device_id, 'env:ip:' || url_encode(src_ip || '@' || stamp), 'connected_from' FROM iso WHERE done UNION ALL
  SELECT *, device_id, 'env:ip:' || url_encode(dst_ip || '@' || stamp), 'connected_to' FROM iso WHERE done),
plain_edges AS (
  SELECT sha256(to_json([event_id::VARCHAR, relation, source, target])::VARCHAR) AS edge_id, event_id::VARCHAR AS event_id, us, relation, source, target,
    user_id AS actor, device_id AS endpoint, 'observed' AS status FROM relations)"""


@query("SELECT node_id, entity_type FROM nodes", extra=NODES_SQL)
def graph_nodes(spark, folder):
    return graph.graph_nodes(obs(spark, folder), "env")


@query("""
SELECT * FROM plain_edges UNION ALL
SELECT sha256(to_json([event_id::VARCHAR, 'trusted_alias', user_id, target])::VARCHAR), event_id::VARCHAR, us, 'trusted_alias', user_id, target, user_id, device_id, 'supported_inference'
FROM (SELECT o.event_id, o.us, o.user_id, o.device_id, count(DISTINCT a.canonical_user_id) AS n, min(a.canonical_user_id) AS target
  FROM obs o JOIN aliases a ON a.alias_user_id = o.user_id AND a.effective_from <= o.ts AND o.ts < a.effective_until GROUP BY ALL)
WHERE n = 1 AND target NOT IN (SELECT alias_user_id FROM aliases)""", extra=EDGES_SQL)
def graph_edges(spark, folder):
    events = obs(spark, folder)
    _, links, _ = context.resolve(events, aliases(spark, folder))
    return graph.graph_edges(events, "env", links).select(
        "edge_id", "event_id", "us", "relation", "source", "target", "actor", "endpoint", "status")


@query("""
SELECT f.candidate_id, e.edge_id, e.relation FROM found f JOIN plain_edges e ON list_contains(f.selected, e.event_id)""",
       extra=ALL_SQL + "," + EDGES_SQL, recursive=True)
def incident_graph(spark, folder):
    return graph.incident_graph(found(spark, folder), graph.graph_edges(obs(spark, folder), "env")).select(
        "candidate_id", "edge_id", "relation")


@query("""
SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, count(DISTINCT event_id) AS independent_events FROM plain_edges""", extra=EDGES_SQL)
def graph_summary(spark, folder):
    events = obs(spark, folder)
    return graph.graph_summary(graph.graph_nodes(events, "env"), graph.graph_edges(events, "env"))


@query("""
SELECT candidate_id, relation, event_id FROM (
  SELECT candidate_id, unnest(['authenticated_to', 'session_on']) AS relation, login_id::VARCHAR AS event_id FROM found UNION ALL
  SELECT candidate_id, unnest(['read_file', 'local_file_on']), read_id::VARCHAR FROM found UNION ALL
  SELECT candidate_id, unnest(['copied_to', 'copy_on']), copy_id::VARCHAR FROM found WHERE copy_id IS NOT NULL UNION ALL
  SELECT candidate_id, 'mounted_on', mount_id::VARCHAR FROM found WHERE copy_id IS NOT NULL) need
WHERE NOT EXISTS (SELECT 1 FROM plain_edges e WHERE e.event_id = need.event_id AND e.relation = need.relation AND e.edge_id NOT LIKE '%a')""",
       extra=ALL_SQL + "," + EDGES_SQL, recursive=True)
def graph_requirements(spark, folder):
    """Checked against a graph that lost the edges whose id ends in a."""
    events = obs(spark, folder)
    edges = graph.graph_edges(events, "env").where(~F.col("edge_id").endswith("a"))
    return graph.requirement_errors(found(spark, folder), events, edges)


@query("""
SELECT node_id, (SELECT count(DISTINCT node_id) FROM nodes) AS total_nodes, TRUE AS truncated
FROM (SELECT DISTINCT node_id FROM nodes ORDER BY node_id LIMIT 200)""", extra=NODES_SQL)
def graph_page(spark, folder):
    events = obs(spark, folder)
    return graph.graph_page(graph.graph_nodes(events, "env"), graph.graph_edges(events, "env"), 200)[0]


@query("""
SELECT edge_id FROM plain_edges WHERE source IN (SELECT node_id FROM p) AND target IN (SELECT node_id FROM p)""",
       extra=EDGES_SQL + ", p AS (SELECT DISTINCT node_id FROM nodes ORDER BY node_id LIMIT 200)")
def graph_page_edges(spark, folder):
    events = obs(spark, folder)
    return graph.graph_page(graph.graph_nodes(events, "env"), graph.graph_edges(events, "env"), 200)[1].select("edge_id")


@query("""
SELECT 'T1005' AS technique_id, candidate_id, 1::BIGINT AS supporting_observations FROM found UNION ALL
SELECT 'T1052.001', candidate_id, 1 FROM found WHERE decision = 'incident'""", extra=ALL_SQL, recursive=True)
def attack_map(spark, folder):
    return attack.attack_map(found(spark, folder), obs(spark, folder))


@query("""
SELECT technique_id FROM (VALUES ('T1005'), ('T1052.001')) AS t(technique_id)
WHERE technique_id = 'T1052.001' OR NOT EXISTS (SELECT 1 FROM found)""", extra=ALL_SQL, recursive=True)
def missing_support(spark, folder):
    """For the partial candidates alone, which cannot support the copy technique."""
    partial = found(spark, folder).where("decision <> 'incident'")
    return attack.missing_support(attack.attack_map(partial, obs(spark, folder))).select("technique_id")


@query("""
SELECT technique_id, least(n, 100)::BIGINT AS score, to_json({techniqueID: technique_id, score: least(n, 100)::BIGINT,
  comment: n || ' supporting observations', enabled: TRUE})::VARCHAR AS entry
FROM (SELECT 'T1005' AS technique_id, count(*) AS n FROM found UNION ALL SELECT 'T1052.001', count(*) FROM found WHERE decision = 'incident') WHERE n > 0""",
       extra=ALL_SQL, recursive=True)
def navigator_layer(spark, folder):
    return attack.navigator_layer(attack.attack_map(found(spark, folder), obs(spark, folder)))


@query("""
SELECT candidate_id, stage_id, evidence FROM (
  SELECT candidate_id, 'authentication' AS stage_id, login_id::VARCHAR AS evidence FROM found UNION ALL
  SELECT candidate_id, 'collection', read_id::VARCHAR FROM found UNION ALL
  SELECT candidate_id, 'transfer', copy_id::VARCHAR FROM found WHERE copy_id IS NOT NULL UNION ALL
  SELECT candidate_id, 'all', array_to_string(selected, ',') FROM found)""", extra=ALL_SQL, recursive=True)
def recommendations(spark, folder):
    return attack.recommendations(found(spark, folder)).select("candidate_id", "stage_id", "evidence")


@query("""
SELECT event_id, action, user_id, domain FROM obs WHERE action IN ('file_read', 'file_copy_to_usb') AND contains(lower(domain), 'example.com')
  AND source_type = 'file' AND ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-22 00:00:00'""")
def hunt_filter(spark, folder):
    filters = [hunts.Filter("action", "in", ("file_read", "file_copy_to_usb")), hunts.Filter("domain", "contains", "Example.COM"),
               hunts.Filter("source_type", "eq", "file")]
    day = lambda text: F.lit(text).cast("timestamp")
    return hunts.hunt(obs(spark, folder, domains=True), filters, ["event_id", "action", "user_id", "domain"],
                      day("2024-01-08 00:00:00"), day("2024-01-22 00:00:00"))


RULE = hunts.Rule("busy-host", "copy related to a blog host", "medium", (
    hunts.Condition("action", ("File_Copy_To_USB", "file_read")), hunts.Condition("domain", ("blog.", "m."), "startswith"),
    hunts.Condition("domain", (".NET", ".org"), "endswith")))


@query("""
SELECT event_id, action || '|' || domain || '|' || domain AS matched FROM obs WHERE action IN ('file_copy_to_usb', 'file_read')
  AND (domain LIKE 'blog.%' OR domain LIKE 'm.%') AND (domain LIKE '%.net' OR domain LIKE '%.org')""")
def sigma_single(spark, folder):
    return hunts.sigma_match(obs(spark, folder, domains=True), RULE).select(
        "event_id", F.array_join(F.map_values("matched_fields"), "|").alias("matched"))


@query("""
SELECT event_id, CASE action WHEN 'login_failure' THEN 'auth-failure' WHEN 'login_success' THEN 'auth-success' WHEN 'file_read' THEN 'file-read'
  WHEN 'usb_mount' THEN 'usb-mount' WHEN 'usb_unmount' THEN 'usb-unmount' WHEN 'file_copy_to_usb' THEN 'explicit-copy' END AS rule_id FROM obs UNION ALL
SELECT event_id, 'sized-copy' FROM obs WHERE bytes_written IN (1000, 2000, 5000, 12310) UNION ALL
SELECT event_id, 'busy-host' FROM obs WHERE action IN ('file_copy_to_usb', 'file_read')
  AND (domain LIKE 'blog.%' OR domain LIKE 'm.%') AND (domain LIKE '%.net' OR domain LIKE '%.org')""")
def sigma_ruleset(spark, folder):
    sized = hunts.Rule("sized-copy", "copies of given sizes", "low", (hunts.Condition("bytes_written", (1000, 2000, 5000, 12310)),))
    return hunts.sigma_scan(obs(spark, folder, domains=True), [*hunts.SHIPPED_RULES, sized, RULE]).select("event_id", "rule_id")


@query("""
SELECT candidate_id FROM found WHERE decision = 'incident' AND contains(lower(concat_ws(' ', candidate_id, user_id, device_id, resource_id, decision)), 'd1')""",
       extra=ALL_SQL, recursive=True)
def candidate_search(spark, folder):
    rows = found(spark, folder).where("decision = 'incident'")
    return hunts.search_text(rows, "D1", ["candidate_id", "user_id", "device_id", "resource_id", "decision"]).select("candidate_id")


INDICATORS_SQL = """
inds AS (
  SELECT 'A' || page_id AS indicator_id, 'domain' AS type, domain AS value, 'feed A' AS source, NULL::TIMESTAMP AS f, NULL::TIMESTAMP AS u, page_id % 3 <> 0 AS enabled, 0.5 AS conf
  FROM hosts WHERE page_id % 7 = 0 UNION ALL
  SELECT 'B' || page_id, 'domain', domain, 'feed B', TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-20', TRUE, page_id / 40.0 FROM hosts WHERE page_id % 5 = 0 UNION ALL
  SELECT DISTINCT 'I' || k, 'ip', '203.0.113.' || k, 'feed C', TIMESTAMP '2024-01-10', NULL::TIMESTAMP, TRUE, 0.9 FROM base WHERE k % 10 = 0),
observed AS (
  SELECT event_id, ts, 'src_ip' AS match_field, 'ip' AS type, src_ip AS value FROM obs UNION ALL SELECT event_id, ts, 'dst_ip', 'ip', dst_ip FROM obs
  UNION ALL SELECT event_id, ts, 'domain', 'domain', domain FROM obs),
hits AS (
  SELECT o.event_id, o.match_field, o.value, i.indicator_id, i.f, i.u, CASE WHEN i.f > o.ts THEN 'not_yet_effective_at_event_time' WHEN i.u <= o.ts THEN 'expired_at_event_time'
      WHEN i.f IS NOT NULL OR i.u IS NOT NULL THEN 'effective_at_event_time' ELSE 'unspecified' END AS validity
  FROM observed o JOIN inds i ON i.type = o.type AND i.value = o.value AND i.enabled),
grouped_hits AS (
  SELECT event_id, match_field, value, count(*) AS n, count(DISTINCT (f, u)) AS intervals, count(DISTINCT validity) AS states, min(validity) AS v FROM hits GROUP BY ALL)"""


def indicators(spark, folder):
    page, rows = F.col("page_id"), hosts(spark, folder)
    none, at = F.lit(None).cast("timestamp"), lambda text: F.lit(text).cast("timestamp")
    shape = lambda df, identity, kind, value, source, start, end, enabled, confidence: df.select(
        identity.alias("indicator_id"), F.lit(kind).alias("type"), value.alias("value"), F.lit(source).alias("source"),
        F.lit("ref").alias("source_reference"), F.lit("host list").alias("description"), confidence.cast("double").alias("source_confidence"),
        start.alias("effective_from"), end.alias("effective_until"), enabled.alias("enabled"))
    a = shape(rows.where("page_id % 7 = 0"), F.concat(F.lit("A"), page), "domain", F.col("domain"), "feed A", none, none, page % 3 != 0, F.lit(0.5))
    b = shape(rows.where("page_id % 5 = 0"), F.concat(F.lit("B"), page), "domain", F.col("domain"), "feed B",
              at("2024-01-05 00:00:00"), at("2024-01-20 00:00:00"), F.lit(True), page / 40)
    k = base_events(spark, folder).select("k").distinct().where("k % 10 = 0")
    c = shape(k, F.concat(F.lit("I"), "k"), "ip", F.concat(F.lit("203.0.113."), "k"), "feed C", at("2024-01-10 00:00:00"), none, F.lit(True), F.lit(0.9))
    return a.unionByName(b).unionByName(c)


@query("""
SELECT event_id, match_field, epoch_us(f) AS from_us, epoch_us(u) AS until_us, validity, count(*) AS assertions FROM hits GROUP BY ALL""", extra=INDICATORS_SQL)
def ioc_matches(spark, folder):
    return intel.ioc_match(obs(spark, folder, domains=True), indicators(spark, folder)).select(
        "event_id", "match_field", micros("effective_from").alias("from_us"), micros("effective_until").alias("until_us"),
        "validity", "assertions")


@query("""
SELECT event_id, match_field, value, CASE WHEN n = 1 THEN 'single_source' WHEN intervals > 1 THEN 'conflicting_sources' ELSE 'corroborated_sources' END AS source_status,
  CASE WHEN states = 1 THEN v ELSE 'conflicting_validity' END AS validity_status, n AS assertions FROM grouped_hits""", extra=INDICATORS_SQL)
def ioc_grouped(spark, folder):
    return intel.group_hits(obs(spark, folder, domains=True), indicators(spark, folder)).select(
        "event_id", "match_field", F.col("normalized_value").alias("value"), "source_status", "validity_status", "assertions")


@query("""
SELECT count(DISTINCT (event_id, match_field)) AS matched_pairs, count(DISTINCT event_id) AS matched_events, count(DISTINCT indicator_id) AS matched_indicators,
  string_agg(DISTINCT match_field, ',' ORDER BY match_field) AS matched_fields FROM hits""", extra=INDICATORS_SQL)
def ioc_summary(spark, folder):
    known = indicators(spark, folder)
    return intel.ioc_summary(durable(intel.group_hits(obs(spark, folder, domains=True), known)), known)


@query("""
SELECT indicator_id, CASE WHEN page_id % 11 = 3 THEN 'value does not fit its indicator type' WHEN conf > 1 THEN 'confidence must lie between 0 and 1'
  WHEN same > 1 THEN 'duplicate source assertion' END AS error
FROM (SELECT *, sum(CASE WHEN page_id % 11 <> 3 THEN 1 ELSE 0 END) OVER (PARTITION BY type, value, source) AS same
  FROM (SELECT i.*, CASE WHEN type = 'domain' THEN substr(indicator_id, 2)::INT ELSE 0 END AS page_id FROM inds i))""", extra=INDICATORS_SQL)
def indicator_validation(spark, folder):
    """Some hosts written with a wildcard; feed B confidences run past 1."""
    rows = indicators(spark, folder)
    page = F.substring("indicator_id", 2, 9).cast("int")
    broken = (F.col("type") == "domain") & (page % 11 == 3)
    value = F.when(broken, F.concat(F.lit("*."), "value")).otherwise(F.col("value"))
    return intel.validate_indicators(rows.withColumn("value", value)).select("indicator_id", "error")
