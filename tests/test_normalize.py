import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lograil.functions import identity, times
from lograil.operators import normalize as norm
from lograil.operators.normalize import Source
from lograil.operators.intel import group_hits, validate_indicators
from lograil.sources import alerts, contexts, indicators, lines, sinks
from lograil.sources.events import raw_json_lines, read_events_csv, read_events_jsonl
from lograil.sources.lines import numbered_lines


def one(spark, column, *values, schema="x string"):
    rows = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in rows.select(column).collect()]


TIMES = [("2026-01-01T09:00:00Z", None, "2026-01-01 09:00:00", None), ("2026-01-01T09:00:00.000001+02:00", None, "2026-01-01 07:00:00.000001", None),
         ("2026-07-01T09:00:00", "Europe/Berlin", "2026-07-01 07:00:00", None), ("2026-01-01T09:00:00", None, None, times.MISSING_ZONE),
         ("2026-03-29T02:30:00", "Europe/Berlin", None, times.AMBIGUOUS), ("2026-10-25T02:30:00", "Europe/Berlin", None, times.AMBIGUOUS),
         ("2026-10-25T02:30:00+02:00", "Europe/Berlin", "2026-10-25 00:30:00", None), ("2026-04-05T01:45:00", "Australia/Lord_Howe", None, times.AMBIGUOUS),
         ("2011-12-30T12:00:00", "Pacific/Apia", None, times.AMBIGUOUS), ("1867-10-19T12:00:00", "America/Juneau", None, times.AMBIGUOUS),
         ("2026-04-05T02:00:00", "Australia/Lord_Howe", "2026-04-04 15:30:00", None),
         ("2026-10-25T04:30:00", "Europe/Berlin", "2026-10-25 03:30:00", None), ("yesterday", "Europe/Berlin", None, times.MALFORMED),
         ("2026-13-01T09:00:00Z", None, None, times.MALFORMED), ("", None, None, "record has no time")]


def test_event_times_with_gaps_and_folds(spark):
    rows = spark.createDataFrame([(t, z) for t, z, *_ in TIMES], "t string, z string")
    got = rows.withColumn("p", times.parse_event_time(F.col("t"), F.col("z"))).select(F.col("p.event_time").cast("string"), "p.error").collect()
    assert [tuple(r) for r in got] == [(time, error) for *_, time, error in TIMES]


def test_unknown_zone_fails_when_the_job_is_defined():
    with pytest.raises(Exception):
        times.declared("Mars/Olympus")


def test_identifiers(spark):
    assert one(spark, identity.entity_id("env", "user", F.col("x")), "a b*c~d/é") == ["env:user:a%20b%2Ac~d%2F%C3%A9"]
    assert one(spark, identity.canon_ip(F.col("x")), "10.0.0.1", "010.0.0.1", "2001:DB8:0::1", "::ffff:1.2.3.4", "x:y") == [
        "10.0.0.1", None, "2001:db8::1", "::ffff:1.2.3.4", None]
    assert one(spark, identity.canon_domain(F.col("x")), "Example.COM.", "*.a.b", "a/b", "1.2.3.4", "bücher.example", "a..", "-a.b", "ab--c.d") == [
        "example.com", None, None, None, "xn--bcher-kva.example" if identity.idna else None, None, None, None]
    assert one(spark, identity.csv_safe(F.col("x")), " =1", "+1", "a=1", None, "\t@x") == ["' =1", "'+1", "a=1", "", "'\t@x"]


RECORD = {"timestamp": "2026-01-01T09:00:00Z", "action": "file_copy_to_usb", "user_id": "u", "device_id": "d", "resource_id": "r",
          "removable_device_id": "m", "bytes_written": 5, "destination_type": "removable_media"}
BAD = [({"bytes_written": True}, "bytes_written is a truth value, not a number of bytes"),
       ({"bytes_written": -1}, "bytes_written must be an integer from 0 to 2^63-1"), ({"user_id": None}, "file_copy_to_usb lacks its user_id"),
       ({"destination_type": "cloud"}, "copy to something else than removable media"), ({"user_id": "  "}, "user_id is blank"),
       ({"user_id": 7}, "user_id has an unsupported type"), ({"action": "usb_mount"}, "action usb_mount is never logged by file sources"),
       ({"src_ip": "1.2.3"}, "src_ip is no IP address"), ({"geo_latitude": 91}, "geo_latitude must be between -90 and 90"),
       ({"timestamp": "2026-01-01T09:00:00"}, times.MISSING_ZONE), ({"file_path": "x" * 70_000}, "record is longer than 64 KiB")]


def test_jsonl_values_and_line_numbers(spark, tmp_path):
    lines = [json.dumps({**RECORD, **change}) for change, _ in BAD]
    odd = json.dumps({**RECORD, "action": "file_shred", "note": "kept out of the event"})
    (tmp_path / "a.jsonl").write_text("﻿" + json.dumps(RECORD) + "\n\n" + "\n".join(lines) + "\n[1]\n{oops\n" + odd + "\n")
    events, rejects = read_events_jsonl(spark, str(tmp_path / "a.jsonl"), Source("ds", "env", "s", "file"))
    good = {e.source_record_number: e for e in events.collect()}
    assert set(good) == {1, 5 + len(BAD)}
    assert good[1].user_id == "env:user:u" and good[1].bytes_written == 5 and good[1].raw_record_sha256
    assert good[5 + len(BAD)].normalization_warnings == [norm.UNSUPPORTED]
    assert {r.row_number: r.error for r in rejects.collect()} == {
        **{i + 3: error for i, (_, error) in enumerate(BAD)}, len(BAD) + 3: "line holds no JSON object", len(BAD) + 4: "line is not valid JSON"}


def test_csv_keeps_other_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("action,app_id,device_id,timestamp,user_id\nlogin_success,a,d,2026-01-01T09:00:00Z,u\n"
                                    "login_success,a,d\nlogin_success,a,d,2026-01-01T09:00:00Z,u,extra\nlogin_failure,,d,2026-01-01T09:00:00Z,u\n")
    events, rejects = read_events_csv(spark, str(tmp_path / "a.csv"), Source("ds", "env", "s", "auth"))
    assert [(e.app_id, e.source_record_number) for e in events.collect()] == [("env:app:a", 2)]
    assert sorted((r.row_number, r.error) for r in rejects.collect()) == [
        (3, lines.MISFIT), (4, lines.MISFIT), (5, "login_failure lacks its app_id")]
    sinks.write_rejects(rejects, str(tmp_path / "quarantine"))
    assert spark.read.parquet(str(tmp_path / "quarantine")).count() == 3
    (tmp_path / "b.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError):
        read_events_csv(spark, str(tmp_path / "b.csv"), Source("ds", "env", "s", "auth"))


def test_line_numbers_across_splits(spark, tmp_path):
    text = "\n".join(f"line {i}" for i in range(1, 3001))
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("line 1\nline 2")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = numbered_lines(spark, f"{tmp_path}/*.txt").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 3002 and all(r.line == f"line {r.row_number}" for r in rows)


def test_first_record_wins(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", "x", 4)], "event_id string, content_sha256 string, row int")
    got = {r.row: r.status for r in norm.dedup_status(rows, ["row"]).collect()}
    assert got == {1: "accepted", 2: "duplicate", 3: "conflict", 4: "accepted"}


def test_hayabusa(spark, tmp_path):
    head = ",".join(alerts.HAYABUSA_COLUMNS)
    (tmp_path / "h.csv").write_text(head + '\n2026-10-07 09:15:00.000 +00:00,host,Security,4663,Informational,101,Title,"a, b"\n'
                                    "2026-10-07 09:15:00.000,host,Security,1,low,102,Title,x\nnever,host,Security,1,low,103,Title,x\n,host,Security,1,fatal,104,Title,x\nshort,row\n")
    rows = {r.source_position: r for r in alerts.read_hayabusa(spark, str(tmp_path / "h.csv")).collect()}
    assert [rows[i].validation_status for i in range(2, 7)] == ["accepted", "accepted_timestamp_unknown_timezone", "rejected", "rejected", "rejected"]
    assert rows[2].stable_source_key == "host|Security|4663|101|2026-10-07 09:15:00.000 +00:00" and rows[2].details == "a, b"
    (tmp_path / "x.csv").write_text("A,B\n1,2\n")
    with pytest.raises(ValueError):
        alerts.read_hayabusa(spark, str(tmp_path / "x.csv"))
    sinks.export_findings_csv(spark.createDataFrame([("  =cmd",)], "cell string"), str(tmp_path / "out"))
    assert spark.read.option("ignoreLeadingWhiteSpace", False).csv(str(tmp_path / "out"), header=True).first()[0] == "'  =cmd"


def test_wazuh(spark, tmp_path):
    good = {"timestamp": "2026-10-07T09:00:00.000+0000", "id": "1", "rule": {"id": "9", "level": 8, "description": "d", "mitre": {"id": ["T2", "T1", "T2"]}},
            "agent": {"name": "h"}, "data": {"srcip": "", "src_ip": "1.2.3.4"}}
    change = lambda **c: json.dumps({**good, **c})
    lines = [json.dumps(good), change(rule={**good["rule"], "level": 17}), change(rule={**good["rule"], "level": True}), change(agent=None),
             change(data={"domain": 5}), change(timestamp=None), change(rule={**good["rule"], "mitre": {"id": "T1"}}), "{"]
    (tmp_path / "w.jsonl").write_text("\n".join(lines))
    rows = {r.source_position: r for r in alerts.read_wazuh(spark, str(tmp_path / "w.jsonl")).collect()}
    assert rows[1].techniques == ["T1", "T2"] and rows[1].src_ip == "1.2.3.4" and str(rows[1].event_time) == "2026-10-07 09:00:00"
    assert [rows[i].validation_status for i in range(1, 9)] == ["accepted", *["rejected"] * 4, "accepted_timestamp_unknown", "rejected", "rejected"]


def test_indicator_feeds(spark, tmp_path):
    (tmp_path / "i.csv").write_text("type,value,source,source_reference,description,enabled\nip,1.2.3.4,s,r,d,true\nip,1.2.3.5,s,r\n")
    rows = indicators.read_indicators_csv(spark, str(tmp_path / "i.csv")).collect()
    assert [r.read_error for r in rows] == [None, "row does not fit its header"]
    assert rows[0].enabled is True and rows[0].effective_from is None
    (tmp_path / "i.json").write_text('[{"type":"domain","value":"a.b","source":"s","source_reference":"r","description":"d"}]')
    assert indicators.read_indicators_json(spark, str(tmp_path / "i.json")).first().value == "a.b"


def test_context_rules(spark):
    rows = spark.createDataFrame([("env:user:a", "env:user:b", "p", 0, 1), ("env:user:a", "env:user:a", "p", 0, 1), ("x", "env:user:b", "p", 0, 1),
                                  ("env:user:a", "env:user:b", " ", 0, 1), ("env:user:a", "env:user:b", "p", 1, 1)],
                                 "alias_user_id string, canonical_user_id string, provenance string, f int, u int")
    rows = rows.select("*", F.timestamp_seconds("f").alias("effective_from"), F.timestamp_seconds("u").alias("effective_until"))
    ok, bad = contexts.validate_context(rows, "aliases", "env")
    assert ok.count() == 1 and bad.count() == 4


def test_run_is_written_once(spark, tmp_path):
    run = spark.createDataFrame([("r1", "ds")], "analysis_run_id string, dataset_id string")
    incidents = spark.createDataFrame([("r1", "i1"), ("r1", "i2")], "analysis_run_id string, incident_id string")
    sinks.write_run(run, incidents, str(tmp_path))
    assert sinks.read_incidents(spark, str(tmp_path)).count() == 2
    with pytest.raises(ValueError):
        sinks.write_run(run, incidents, str(tmp_path))
    # A broken attempt leaves incidents behind, a later writer a second row; neither is seen.
    own = str(incidents.first().analysis_run_id)
    incidents.drop("analysis_run_id").write.parquet(f"{tmp_path}/incidents/analysis_run_id={own}/attempt=0-broken")
    run.drop("analysis_run_id").write.parquet(f"{tmp_path}/runs/analysis_run_id={own}/attempt=9-late")
    assert sinks.read_incidents(spark, str(tmp_path)).count() == 2 and sinks.read_runs(spark, str(tmp_path)).count() == 1


def test_each_csv_file_has_its_own_header(spark, tmp_path):
    one = "action,app_id,device_id,timestamp,user_id\nlogin_success,a,d1,2026-01-01T09:00:00Z,u1\n"
    two = "user_id,device_id,action,timestamp,app_id\nu2,d2,login_success,2026-01-01T09:00:00Z,\"a \"\"b\"\", c\"\n"
    (tmp_path / "a.csv").write_text(one)
    (tmp_path / "b.csv").write_text(two)
    events, rejects = read_events_csv(spark, str(tmp_path), Source("ds", "env", "s", "auth"))
    got = sorted((e.user_id, e.device_id) for e in events.collect())
    assert got == [("env:user:u1", "env:endpoint:d1"), ("env:user:u2", "env:endpoint:d2")] and rejects.count() == 0


def test_a_broken_cell_is_never_an_event(spark, tmp_path):
    good = "login_success,a,d,2026-01-01T09:00:00Z,u\n"
    rows = 'login_success,"a\nb",d,2026-01-01T09:00:00Z,u\n' + good + 'login_success,"a"x,d,2026-01-01T09:00:00Z,u\n' + good + 'login_success,"a,d\n' + good * 2
    (tmp_path / "a.csv").write_text("action,app_id,device_id,timestamp,user_id\n" + rows)
    events, rejects = read_events_csv(spark, str(tmp_path), Source("ds", "env", "s", "auth"))
    assert sorted((e.source_record_number, e.app_id) for e in events.collect()) == [(3, "env:app:a%0Ab"), (4, "env:app:a"), (6, "env:app:a")]
    assert sorted((r.row_number, r.error) for r in rejects.collect()) == [(n, lines.UNCLOSED) for n in (5, 9)]


def csv_records_of(spark, path, size, limit=lines.LIMIT):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        return {r.row_number: (r.line, r.too_long) for r in lines.csv_records(lines.placed_lines(spark, path), limit).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("size", [40, 300, 10 ** 6])
def test_records_over_line_breaks_and_splits(spark, tmp_path, size):
    """The same records and line numbers as a sequential reader, wherever splits cut them."""
    rng, path = random.Random(size), tmp_path / "a.csv"
    rows = [["".join(rng.choice('ab",\n é') for _ in range(rng.choice([0, 1, 3, 8]))) for _ in range(3)] for _ in range(250)]
    with open(path, "w", newline="") as file:
        csv.writer(file, lineterminator="\n").writerows([["x", "y", "z"], *rows])
    with open(path, newline="") as file:
        reader = csv.reader(file, strict=True)
        expected = {reader.line_num: row for row in reader}
    found = csv_records_of(spark, str(path), size)
    assert found.keys() == expected.keys() and not any(long for _, long in found.values())
    cells = spark.createDataFrame([(n, line) for n, (line, _) in found.items()], "n int, line string").select("n", lines.cells_of("line").alias("c")).collect()
    assert {r.n: r.c for r in cells} == expected


def test_only_the_beginning_of_a_record_without_end_is_gathered(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n" + '3,"open\n' + "4,5\n" * 400)
    found = csv_records_of(spark, str(tmp_path / "a.csv"), 200, 1000)
    assert found[1] == ("x,y", False) and found[2] == ("1,2", False) and set(found) == {1, 2, 403}
    line, long = found[403]
    assert long and line.startswith('3,"open\n4,5\n') and len(line) <= 1001
    rows = lines.csv_cells(lines.csv_records(lines.placed_lines(spark, str(tmp_path / "a.csv")), 1000), lines.headers(spark, str(tmp_path / "a.csv"))).collect()
    assert sorted((r.row_number, r.read_error) for r in rows) == [(2, None), (403, lines.TOO_LONG)]


def test_feeds_go_into_validation_and_matching(spark, tmp_path):
    head = "value,type,source,source_reference,description,enabled,source_confidence,effective_from_utc\n"
    (tmp_path / "i.csv").write_text(head + "A.b,domain,s,r1,d,,0.5,2026-01-01T00:00:00Z\n1.2.3.4,ip,s,r2,d,yes,,\n1.2.3.5,ip,s,r3,d,TRUE,x,\n"
                                    "1.2.3.6,ip,s,r4,d,false,,2026-01-01\n1.2.3.7,ip,s,r5,d,true,1,\n")
    good, bad = indicators.split_feed(indicators.read_indicators_csv(spark, str(tmp_path / "i.csv")))
    assert sorted(r.read_error for r in bad.collect()) == ["effective_from_utc must be an ISO time with an offset", "enabled must be true or false",
                                                           "source_confidence must be a number"]
    checked = validate_indicators(good)
    assert [(r.normalized_value, r.error) for r in checked.orderBy("normalized_value").collect()] == [("1.2.3.7", None), ("a.b", None)]
    events = spark.createDataFrame([("e", "1.2.3.7", "2026-02-01 00:00:00")], "event_id string, dst_ip string, t string").select(
        "event_id", "dst_ip", F.col("t").cast("timestamp").alias("event_time"))
    assert [(r.event_id, r.source_status) for r in group_hits(events, good).collect()] == [("e", "single_source")]


def test_ties_of_one_id_never_accept_two_contents(spark):
    rows = spark.createDataFrame([("a", "y", 1), ("a", "x", 1), ("b", "z", None)], "event_id string, content_sha256 string, row int")
    got = {(r.event_id, r.content_sha256): r.status for r in norm.dedup_status(rows, ["row"]).collect()}
    assert got == {("a", "x"): "accepted", ("a", "y"): "conflict", ("b", "z"): "accepted"}


def test_authorizations_of_other_datasets_stay(spark):
    kind = "dataset_id string, authorization_id string"
    current = spark.createDataFrame([("d1", "a"), ("d2", "b")], kind)
    merged = contexts.merge_context(current, spark.createDataFrame([("d2", "c")], kind), "authorizations")
    assert sorted(map(tuple, merged.collect())) == [("d1", "a"), ("d2", "c")]


def test_iso_basic_forms_and_left_out_seconds(spark):
    forms = ("20240101T101500Z", "2024-01-01T10Z", "2024-01-01T10:15Z", "20240101T1015+0000", "20240101", "2024-01-01T10:15:30.5Z", "2024-1-1T10Z", "202401")
    time = times.parse_event_time(F.col("x"), F.lit("UTC"))
    got = spark.createDataFrame([(f,) for f in forms], "x string").select(time.alias("t")).collect()
    assert [str(r.t.event_time)[:21] for r in got] == ["2024-01-01 10:15:00", "2024-01-01 10:00:00", "2024-01-01 10:15:00", "2024-01-01 10:15:00",
                                                       "2024-01-01 00:00:00", "2024-01-01 10:15:30.5", "None", "None"]


def test_a_time_is_rewritten_once(spark):
    row = spark.createDataFrame([("2026-01-01T09:00:00Z", None)], "t string, z string").select(times.parse_event_time(F.col("t"), F.col("z")))
    assert row._jdf.queryExecution().analyzed().toString().count("regexp_replace(") <= 12


def test_normalized_records_parse_every_line_once(spark):
    plan = queries()["normalized_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("src_ip is no IP address") == 1


def test_member_types_behind_odd_names_and_nesting(spark, tmp_path):
    good = {"timestamp": "2026-01-01T09:00:00Z", "action": "file_read", "user_id": "u", "device_id": "d", "resource_id": "r"}
    odd = [({}, None), ({"bytes_read": 5}, None), ({"note": "a: STRING, b: VOID>"}, None), ({"x: STRING, y": None}, None), ({"note": [1]}, None),
           ({"domain": 5}, "domain has an unsupported type"), ({"process_id": True}, "process_id has an unsupported type"),
           ({"x: STRING, domain": "a", "domain": {"a": "b"}}, "domain has an unsupported type"), ({"geo_latitude": 1.5}, None)]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(good | more) for more, _ in odd))
    raw = raw_json_lines(numbered_lines(spark, str(tmp_path / "a.jsonl"))).orderBy("row_number").collect()
    assert [r.read_error for r in raw] == [error for _, error in odd]
