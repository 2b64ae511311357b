import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lograil.operators import context, evaluate, features, forest, hunts, intel, merkle, ranks, reports, risk
from lograil.operators.chain import detect
from lograil.operators.history import established_users
from tests.logs import LABEL, START, attack, event, frame, history, labels


def test_interval_edges(spark):
    us = timedelta(microseconds=1)
    end = START + timedelta(minutes=10)
    moments = [START - us, START, end - us, end]
    rows = frame(spark, [{**event(f"e{i}", 0, "file_read", resource_id="r"), "event_time": t} for i, t in enumerate(moments)])
    label = spark.createDataFrame([("r", True, START, end), ("r", True, START, end), ("r", False, START - us, None)], LABEL)
    assert sorted(r.event_id for r in context.sensitive_reads(rows, label).collect()) == ["e1", "e2"]


def test_aliases(spark):
    rows = frame(spark, [event("a", 0, "login_success", user_id="one"), event("b", 0, "login_success", user_id="two"),
                         event("c", 0, "login_success", user_id="chain"), event("d", 90, "login_success", user_id="one")])
    until = START + timedelta(minutes=60)
    aliases = spark.createDataFrame([("one", "x", START, until), ("two", "x", START, until), ("two", "y", START, until), ("chain", "one", START, until)],
                                    "alias_user_id string, canonical_user_id string, effective_from timestamp, effective_until timestamp")
    events, links, warnings = context.resolve(rows, aliases)
    assert {r.event_id: r.user_id for r in events.collect()} == {"a": "x", "b": "two", "c": "chain", "d": "one"}
    assert [(r.event_id, r.policy_strength) for r in links.collect()] == [("a", 0.9)]
    assert sorted(r.user_id for r in warnings.collect()) == ["chain", "two"]


def test_indicator_status(spark):
    rows = frame(spark, [event("a", 0, "login_success", src_ip="10.0.0.1", domain="A.example"), event("b", 0, "login_success", src_ip="10.0.0.11")])
    one = lambda i, t, v, s, f=None, u=None: (i, t, v, s, "r", "d", None, f, u, True)
    table = spark.createDataFrame([one("1", "ip", "10.0.0.1", "x"), one("2", "ip", "10.0.0.1", "y"), one("3", "domain", "a.EXAMPLE.", "x"),
                                   one("4", "domain", "a.example", "y", START + timedelta(days=1))],
                                  "indicator_id string, type string, value string, source string, source_reference string, description string,"
                                  "source_confidence double, effective_from timestamp, effective_until timestamp, enabled boolean")
    got = {r.match_field: (r.source_status, r.validity_status) for r in intel.group_hits(rows, table).collect()}
    assert got == {"src_ip": ("corroborated_sources", "unspecified"), "domain": ("conflicting_sources", "conflicting_validity")}


def test_hunt_and_rule_limits():
    with pytest.raises(ValueError):
        hunts._check_filter(hunts.Filter("session_id", "eq", "x"))
    with pytest.raises(ValueError):
        hunts._check_filter(hunts.Filter("file_hash", "contains", "ab"))


def test_rules_from_a_table(spark, tmp_path):
    (tmp_path / "rules.json").write_text('{"rule_id":"x","title":"t","level":"low","conditions":[{"field":"bytes_written","values":["2048"]}]}')
    rules = hunts.load_rules(spark, str(tmp_path / "rules.json"))
    rows = frame(spark, list(attack().values()))
    assert [r.event_id for r in hunts.sigma_scan(rows, rules).collect()] == ["copy"]


def test_ranks_are_exact(spark):
    rng = random.Random(3)
    calibration = [rng.choice([0.0, rng.random(), round(rng.random(), 1)]) for _ in range(700)]
    scores = [*calibration[:50], -1.0, 2.0, 0.5]
    table = lambda values: spark.createDataFrame([(v,) for v in values], "score double")
    for row in ranks.midrank(table(scores), table(calibration), "score").collect():
        low, high = sum(c < row.score for c in calibration), sum(c <= row.score for c in calibration)
        assert row.anomaly_percentile == (low + high) / (2 * len(calibration))
    for q in (0.0, 0.5, 0.99, 1.0):
        assert ranks.quantile_higher(table(calibration), "score", q).first()[0] == np.quantile(calibration, q, method="higher")
    assert ranks.quantile_higher(table([float(i) for i in range(100)]), "score", 0.99).first()[0] == 99.0


def calibrated(scores, units, target=0.01):
    cuts = sorted({80.0} | {s + 1e-8 for _, s in scores if s < 100})
    false = lambda cut: len({u for unit, s in scores if s >= cut for u in unit})
    good = [c for c in cuts if false(c) / units <= target]
    if good and (not scores or any(s >= good[0] for _, s in scores)):
        return good[0], false(good[0])
    return 80.0, false(80.0)


@pytest.mark.parametrize("case", range(4))
def test_threshold_search(spark, case):
    rng = random.Random(case)
    day = 86_400_000_000
    found = [(f"c{i}", f"u{rng.randrange(4)}", "d", rng.randrange(5) * day, rng.choice([70.0, 85.0, 90.0, 95.5, 99.0])) for i in range((0, 3, 20, 30)[case])]
    units = (50, 400, 900, 60)[case]
    rows = spark.createDataFrame([(c, u, d, at, at + 1, at + 2, at + 1, 3, s) for c, u, d, at, s in found],
                                 "candidate_id string, user_id string, device_id string, login_us bigint, read_us bigint, copy_us bigint, mount_us bigint, stages int, risk double")
    benign = spark.range(units).selectExpr("cast(id as string) user_id", "'x' device_id", "0L day")
    row = risk.calibrate(rows, benign).first()
    assert (row.threshold, row.false_units) == calibrated([({(u, at)}, s) for _, u, _, at, s in found], units)


def test_forest(spark):
    rng = np.random.default_rng(0)
    data = [(f"w{i}", [float(x) for x in rng.normal(0, 1, 3)], False, False) for i in range(400)] + [("far", [9.0, 9.0, 9.0], False, False), ("new", [0.0, 0.0, 0.0], True, False)]
    schema = "name string, vector array<double>, cold_start boolean, provisional boolean"
    rows = spark.createDataFrame(data, schema)
    model = forest.fit_forest(rows, ["name"], trees=40, seed=5)
    again = forest.fit_forest(spark.createDataFrame(data[::-1], schema).repartition(7), ["name"], trees=40, seed=5)
    order = ["tree_id", "node_id"]
    assert model.orderBy(*order).collect() == again.orderBy(*order).collect()
    assert model.where("node_id = 0").agg(F.min("size"), F.max("size")).first() == (256, 256)
    scores = {r.name: r.raw_anomaly_score for r in forest.score_forest(rows, model).collect()}
    assert scores["new"] is None and all(0 < s <= 1 for n, s in scores.items() if n != "new")
    assert scores["far"] == max(s for s in scores.values() if s is not None)
    assert scores["far"] > 0.6 > np.median([s for s in scores.values() if s is not None])


def test_baseline_admission(spark):
    window = lambda n, start: spark.range(n).selectExpr(f"{start} + id * {features.WIDTH} as window_us", "false as cold_start", "false as provisional")
    error = lambda a, b: forest.check_baseline(a, b).first().error
    width = features.WIDTH
    assert error(window(20, 0), window(20, 20 * width)) is None
    assert "before calibration opens" in error(window(21, 0), window(20, 20 * width))
    assert "fewer than twenty" in error(window(19, 0), window(20, 20 * width))
    assert "both need" in error(window(0, 0), window(20, 0))


def test_baseline_scores_later_data_only(spark):
    rows, at = frame(spark, list(attack().values())), lambda days: F.lit(START + timedelta(days=days)).cast("timestamp")
    assert forest.check_later(rows, at(6), at(4)).first().error is None
    assert forest.check_later(rows, at(6), at(5.005)).first().error and forest.check_later(rows, at(3), at(4)).first().error


def test_features_of_one_window(spark):
    past, steps = frame(spark, history()), frame(spark, list(attack().values()))
    rows = {r.window_us: r for r in features.window_features(steps, past, labels(spark, "secret"), F.lit(START + timedelta(days=5, minutes=29)).cast("timestamp")).collect()}
    first, second = (rows[k] for k in sorted(rows))
    assert (first.successful_logins, first.sensitive_reads, first.new_device_fraction, first.new_app_fraction, first.rare_resource_fraction) == (1, 1, 1.0, 0.0, 1.0)
    assert (second.usb_bytes, second.bytes_written, second.provisional, first.provisional, first.cold_start) == (2048, 2048, True, False, False)


def test_warnings_and_reports(spark):
    events, known = frame(spark, [*history(), *attack().values()]), labels(spark, "secret")
    records = spark.createDataFrame([("rejected",), ("accepted",)], "status string")
    few = frame(spark, [event("x", 0, "login_success")])
    got = reports.run_warnings(established_users(few), known.where("false"), records, few).first().warnings
    assert [w.split(" ")[0] for w in got] == ["too", "no", "1"]
    rows = reports.report_rows(detect(events, known), events)
    assert reports.verify_reports(rows, rows).count() == 0
    forged = rows.withColumn("report", F.regexp_replace("report", '"score":100', '"score":10'))
    assert reports.verify_reports(forged, rows).first().error == "claims differ"
    assert '"src_ip"' not in rows.first().report


def test_fingerprint_ignores_order_but_not_repeats(spark):
    rows = frame(spark, history()).select("event_id", "action")
    mark = lambda df: merkle.fingerprint(df, ["event_id", "action"]).first().fingerprint
    assert mark(rows) == mark(rows.repartition(4, F.rand(1))) != mark(rows.unionByName(rows.limit(1)))
    assert merkle.fingerprint(rows.limit(0), ["event_id"]).first().event_count == 0


def test_tree_finds_the_changed_rows(spark):
    """Of many rows the few that one side lost, gained or repeats are found through their ranges."""
    rows = spark.range(3000).selectExpr("id", "concat('v', id % 100) as v")
    other = rows.where("id <> 77").unionByName(spark.createDataFrame([(9999, "new"), (5, "v5")], "id bigint, v string"))
    left, right = (merkle.tree(t, ["id", "v"], 3) for t in (rows, other))
    ranges = merkle.changed_ranges(left, right, 3)
    found = merkle.changed_rows(rows, other, ranges, ["id", "v"], 3).collect()
    assert 1 <= ranges.count() <= 3 and sorted((r.left_n, r.right_n) for r in found) == [(0, 1), (1, 0), (1, 2)]
    assert merkle.changed_ranges(left, left, 3).count() == 0
    assert {r.level for r in left.collect()} == {0, 2, 3}
    everything = merkle.changed_ranges(left, left.limit(0), 3)
    assert everything.agg(F.sum("left_rows"), F.sum("right_rows")).first()[:] == (3000, 0)


def test_no_double_credit(spark):
    events, known = frame(spark, [*history(), *attack().values()]), labels(spark, "secret")
    found = detect(events, known)
    label = lambda name: (name, "u", "d2", "login", "read", "copy", ["mount"], [("login", "read")])
    schema = ("scenario_id string, user_id string, device_id string, authentication string, collection string, transfer string, context array<string>,"
              "order_constraints array<struct<before:string,after:string>>")
    again = found.withColumn("candidate_id", F.concat(F.lit("z"), "candidate_id"))
    one, two = spark.createDataFrame([label("s")], schema), spark.createDataFrame([label("s"), label("t")], schema)
    status = lambda truth: sorted(r.status for r in evaluate.match_episodes(found.unionByName(again), truth).collect())
    assert status(one) == ["duplicate_credit_rejected", "matched"]
    assert status(two) == ["oversized_or_ambiguous", "oversized_or_ambiguous"]


def test_events_meet_foreign_spellings_without_python(spark):
    """Spellings of one address or host meet one indicator; only distinct spellings and values reach Python."""
    rows = frame(spark, [event("a", 0, "login_success", src_ip="2001:DB8::0:1", domain="B\u00dcCHER.example."), event("b", 1, "login_success", src_ip="2001:db8::1", domain="b\u00fccher.example"),
                         event("c", 2, "login_success", src_ip="x:y", domain="xn--bcher-kva.example"), event("d", 3, "login_success", src_ip="10.0.0.1 ", domain="a\u00fc/b"),
                         event("e", 4, "login_success", src_ip="10.0.0.1", domain="other.example")])
    one = lambda i, t, v: (i, t, v, "s", "r", "d", None, None, None, True)
    table = spark.createDataFrame([one("1", "ip", "2001:db8:0::1"), one("2", "domain", "b\u00fccher.EXAMPLE"), one("3", "ip", "10.0.0.1"), one("4", "domain", "a\u00fc/b"),
                                   one("5", "ip", "10.0.0.1"), one("6", "ip", "9.9.9.9"), one("7", "domain", None), one("8", "url", "x")],
                                  "indicator_id string, type string, value string, source string, source_reference string, description string,"
                                  "source_confidence double, effective_from timestamp, effective_until timestamp, enabled boolean")
    hits = intel.group_hits(rows, table)
    got = {(r.event_id, r.match_field): (r.normalized_value, r.assertions) for r in hits.collect()}
    host = "xn--bcher-kva.example"
    assert got == {("a", "src_ip"): ("2001:db8::1", 1), ("b", "src_ip"): ("2001:db8::1", 1), ("e", "src_ip"): ("10.0.0.1", 2),
                   ("a", "domain"): (host, 1), ("b", "domain"): (host, 1), ("c", "domain"): (host, 1)}
    assert sorted(r.indicator_id for r in intel.matched_indicators(hits, table).collect()) == ["1", "2", "3", "5"]
    # One Python node for the spellings, one for the known values, which stand in both branches.
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") <= 3
