import json
import random
import time
from datetime import datetime, timedelta

import pytest

from lograil.operators.chain import Chain, active_mount, detect, eligible_copies
from lograil.operators.features import window_features
from lograil.operators.hunts import SHIPPED_RULES
from lograil.operators.ingest import ingest
from lograil.operators.normalize import Source, dedup_status
from lograil.sources.events import raw_json_lines
from lograil.sources.lines import numbered_lines
from lograil.streaming.chain import chain_steps, stream_chain
from lograil.streaming.dedup import stream_dedup, stream_status
from lograil.streaming.ingest import stream_events
from lograil.streaming.late import LateRows
from lograil.streaming.mounts import mount_steps, stream_active_mount
from lograil.streaming.sessions import sessions
from lograil.streaming.windows import stream_features, stream_mount_join, stream_rule_hits
from tests.logs import DAY5, SCHEMA, START, attack, event, frame, history, labels


def feed(spark, folder, *batches):
    """One parquet file per micro-batch, read back in order."""
    for i, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.parquet(f"{folder}/in/{i:02d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/in/*")


def drain(stream, folder, mode="append"):
    name = f"out_{abs(hash(str(folder)))}"
    query = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start())
    query.awaitTermination(120)
    return stream.sparkSession.table(name).collect(), query


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_ingest_splits_events_and_quarantine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = '{"timestamp":"2026-01-01T09:00:00Z","action":"login_success","user_id":"u","device_id":"d","app_id":"a"}'
    (tmp_path / "in" / "a.jsonl").write_text(good + "\n\nnot json\n")
    paths = [str(tmp_path / n) for n in ("events", "rejects", "ck")]
    stream_events(spark, str(tmp_path / "in"), Source("ds", "env", "s", "auth"), *paths)[1].awaitTermination(120)
    events, rejects = spark.read.parquet(paths[0]).collect(), spark.read.parquet(paths[1]).collect()
    assert [(e.user_id, e.source_record_number) for e in events] == [("env:user:u", 1)]
    assert [(r.row_number, r.error) for r in rejects] == [(3, "line is not valid JSON")]


def test_dedup_within_the_watermark(spark, tmp_path):
    rows = [event("a", 0, "login_success"), event("a", 0, "login_success"), event("b", 1, "login_success")]
    got, _ = drain(stream_dedup(feed(spark, tmp_path, rows, [event("a", 0, "login_success")])), tmp_path)
    assert sorted(r.event_id for r in got) == ["a", "b"]


def test_closed_windows_only_and_late_rows_dropped(spark, tmp_path):
    first = [event("a", 0, "login_success"), event("b", 3, "login_failure")]
    later = [event("c", 300, "login_success")]
    late = [event("d", 5, "login_success")]
    counted = LateRows()
    spark.streams.addListener(counted)
    # A batch judges lateness by the watermark of the batch before it.
    got, query = drain(stream_features(feed(spark, tmp_path, first, later, [event("e", 301, "login_success")], late), frame(spark, []), labels(spark)), tmp_path)
    assert [(r.event_count, r.login_failures, r.successful_logins) for r in got] == [(2, 1, 1)]
    for _ in range(100):  # progress arrives on a thread of its own
        if counted.dropped[str(query.id)]:
            break
        time.sleep(0.1)
    spark.streams.removeListener(counted)
    assert counted.dropped[str(query.id)] == 1


def test_closed_windows_equal_the_batch_features(spark, tmp_path):
    """All twelve features, with novelty against a frozen history and labels that begin and end."""
    rng, rows = random.Random(3), []
    for i in range(160):
        action = rng.choice(["login_success", "login_failure", "file_read", "file_read", "file_copy_to_usb"])
        rows.append({**event(f"e{i}", DAY5 + rng.randrange(180), action, app_id=rng.choice("ab"), resource_id=rng.choice(["work", "secret", "x"]), dst_ip=rng.choice(["1", "2", None]),
                             bytes_read=rng.choice([None, 3]), bytes_written=rng.choice([None, 7]), destination_type="removable_media", outcome=rng.choice([None, "success", "failure"])),
                     "user_id": rng.choice(["u", "v", None]), "device_id": rng.choice(["d1", "d2"])})
    closing = [event(n, DAY5 + t, "login_success", device_id="d9") for n, t in (("z", 900), ("zz", 2000))]
    known = labels(spark, "secret", start=START + timedelta(minutes=DAY5 + 60), end=START + timedelta(minutes=DAY5 + 120))
    stream = feed(spark, tmp_path, rows[:90], rows[90:], closing[:1], closing[1:])
    got, _ = drain(stream_features(stream, frame(spark, history()), known, "6 hours"), tmp_path)
    batch = window_features(frame(spark, [*rows, closing[0]]), frame(spark, history()), known).drop("provisional")
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.collect())) and len(got) > 20


def test_rule_hits_and_sessions(spark, tmp_path):
    hits, _ = drain(stream_rule_hits(feed(spark, tmp_path, list(attack().values())), list(SHIPPED_RULES)).select("event_id", "rule_id"), tmp_path)
    assert sorted(hits) == [("copy", "explicit-copy"), ("login", "auth-success"), ("mount", "usb-mount"), ("read", "file-read")]
    rows = [event("a", 0, "login_success"), event("b", 59, "login_success"), event("c", 120, "login_success"), event("z", 900, "login_success")]
    other = tmp_path / "s"
    stream = sessions(feed(spark, other, rows, [event("y", 2000, "login_success")]).withWatermark("event_time", "10 minutes"))
    got, _ = drain(stream, other)
    batch = sessions(frame(spark, rows)).collect()
    assert sorted((r.session_start, r.events) for r in got) == sorted((r.session_start, r.events) for r in batch)
    assert sorted(r.events for r in got) == [1, 1, 2]


def test_mount_join(spark, tmp_path):
    steps = list(attack().values())
    stream = feed(spark, tmp_path, steps, [event("z", DAY5 + 900, "usb_mount", removable_device_id="m")])
    joined = stream_mount_join(stream.where("action = 'file_copy_to_usb'"), stream.where("action = 'usb_mount'"))
    got, _ = drain(joined, tmp_path)
    assert [(r.copy_id, r.mount_id) for r in got] == [("copy", "mount")]


def test_active_mount_equals_the_batch(spark, tmp_path):
    """One row a copy: the latest mount of its user, unless anyone unmounted the medium since."""
    rng, rows = random.Random(12), []
    for i in range(240):
        action = rng.choice(["usb_mount", "usb_unmount", "file_copy_to_usb", "file_copy_to_usb"])
        more = {"destination_type": "removable_media", "bytes_written": 5, "resource_id": "r"} if action == "file_copy_to_usb" else {}
        rows.append({**event(f"e{i:03d}", DAY5 + rng.randrange(0, 300) // 2, action, removable_device_id=rng.choice("mn"), device_id="hot", **more),
                     "user_id": rng.choice(["u1", "u2", "u3"])})
    rng.shuffle(rows)
    closing = [event(n, DAY5 + t, "usb_mount", removable_device_id="x", device_id="d9") for n, t in (("z", 2000), ("zz", 2100))]
    stream = feed(spark, tmp_path, rows[:80], rows[80:160], rows[160:], closing[:1], closing[1:])
    got, _ = drain(stream_active_mount(mount_steps(stream).withWatermark("event_time", "12 hours")), tmp_path)
    whole = frame(spark, rows)
    batch = active_mount(eligible_copies(whole), whole, Chain().mount).select("event_id", "mount_id", "mount_us").collect()
    assert sorted((r.event_id, r.mount_id, r.mount_us) for r in got) == sorted(map(tuple, batch)) and len(got) > 10


def test_chain_on_a_stream_equals_the_batch_detector(spark, tmp_path):
    past = frame(spark, history())
    steps = attack()
    second = [event("login2", DAY5 + 200, "login_success", app_id="a1", device_id="d2"),
              event("read2", DAY5 + 210, "file_read", resource_id="secret2", device_id="d2")]
    overlapping = event("login1b", DAY5 + 12, "login_success", app_id="a1", device_id="d2")
    rows = [*steps.values(), overlapping, *second]
    closing = [event("end", DAY5 + 2000, "usb_mount", removable_device_id="x", device_id="d9")]
    closing2 = [event("end2", DAY5 + 2100, "usb_mount", removable_device_id="x", device_id="d9")]
    stream = feed(spark, tmp_path, list(steps.values()), [overlapping, *second], closing, closing2)
    known = labels(spark, "secret", "secret2")
    got, _ = drain(stream_chain(chain_steps(stream, past, known)), tmp_path)
    batch = detect(frame(spark, rows), known, Chain(), past).collect()
    key = lambda r: (r.login_id, r.read_id, r.copy_id, r.mount_id, r.decision)
    assert sorted(map(key, got), key=str) == sorted(map(key, batch), key=str)
    assert {r.decision for r in got} == {"incident", "partial_observation"}


def test_repeats_and_conflicts_of_earlier_batches(spark, tmp_path):
    line = '{"timestamp":"2026-01-01T09:00:00Z","action":"login_success","user_id":"%s","device_id":"d","app_id":"a","source_event_id":"v%d"}\n'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(line % ("u", 1) + line % ("u", 2))
    paths = [str(tmp_path / n) for n in ("events", "rejects", "ck")]
    start = lambda: stream_events(spark, str(tmp_path / "in"), Source("ds", "env", "s", "auth"), *paths)[1].awaitTermination(120)
    start()
    (tmp_path / "in" / "b.jsonl").write_text(line % ("u", 1) + line % ("other", 2) + line % ("u", 3))
    start()
    assert sorted(r.source_event_id for r in spark.read.parquet(paths[0]).collect()) == ["v1", "v2", "v3"]
    assert [(r.row_number, r.error) for r in spark.read.parquet(paths[1]).collect()] == [(2, "another record of this id is already accepted")]


RECORDS = "event_id string, content_sha256 string, record_ref string, size bigint, event_time timestamp, notes array<string>"


def test_statuses_equal_a_batch_replay(spark, tmp_path):
    """Twenty micro-batches get the statuses of one batch over all, and each reads its own rows alone."""
    rng, batches = random.Random(6), []
    for n in range(20):
        batches.append([(f"id{rng.randrange(60)}", rng.choice("ab"), f"{n:02d}:{i:02d}", 2 ** 63 - 1 - i, None if i % 3 else time_of(n), [str(i)] if i % 2 else None)
                        for i in range(8)])
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, RECORDS).coalesce(1).write.parquet(f"{tmp_path}/in/{n:02d}")
    stream = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got, query = drain(stream_status(stream, buckets=4), tmp_path)
    whole = spark.createDataFrame([r for rows in batches for r in rows], RECORDS)
    expected = dedup_status(whole, ["record_ref"]).select(*whole.columns, "status").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, expected), key=str)
    assert {r.status for r in got} == {"accepted", "duplicate", "conflict"}
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(progress) == 20 and {p["numInputRows"] for p in progress} == {8}


def time_of(minute):
    return datetime(2026, 1, 1, 9, minute, 0, 1)


def test_status_state_expires(spark, tmp_path):
    row = [("a", "x", "1", 1, None, None)]
    for n in range(2):
        spark.createDataFrame(row, RECORDS).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(RECORDS).parquet(f"{tmp_path}/in/*")
        query = (stream_status(stream, keep=1000, buckets=2).writeStream.format("parquet").option("path", f"{tmp_path}/out")
                 .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start())
        query.awaitTermination(120)
        time.sleep(1.5)
    assert [r.status for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["accepted", "accepted"]


def test_stream_ingest_equals_batch_ingest(spark, tmp_path):
    """Files arriving one after the other leave the events and the quarantine of one batch over all of them."""
    rng, source = random.Random(8), Source("ds", "env", "s", "auth")
    (tmp_path / "in").mkdir()
    paths = [str(tmp_path / n) for n in ("events", "rejects", "ck")]
    for n in range(4):
        rows = [json.dumps({"timestamp": "2026-01-01T09:00:00Z", "action": rng.choice(["login_success", "login_success", "login_failure", "file_read"]), "user_id": f"u{rng.randrange(3)}",
                            "device_id": "d", "app_id": "a", "source_event_id": f"v{rng.randrange(12)}"}) for _ in range(10)]
        (tmp_path / "in" / f"{n}.jsonl").write_text("\n".join(rows) + "\n{odd\n")
        stream_events(spark, str(tmp_path / "in"), source, *paths)[1].awaitTermination(120)
    done = ingest([(raw_json_lines(numbered_lines(spark, str(tmp_path / "in"))), source)])
    key = lambda rows: sorted((r.record_ref, r.error) for r in rows)
    assert sorted(r.raw_record_ref for r in spark.read.parquet(paths[0]).collect()) == sorted(r.raw_record_ref for r in done.events.collect())
    assert key(spark.read.parquet(paths[1]).collect()) == key(done.rejects.collect())
