import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from lograil.operators import chain, compare
from lograil.operators.chain import Chain, candidates, detect, episodes
from lograil.operators.ordered import MINUTE
from lograil.operators.validate import validate
from tests.logs import DAY5, START, attack, event, frame, history, labels


def run(spark, steps, **options):
    return detect(frame(spark, [*history(), *steps]), labels(spark, "secret"), **options).collect()


def test_complete_chain_is_one_incident(spark):
    rows = run(spark, attack().values())
    assert [(r.decision, r.stages, r.selected) for r in rows] == [("incident", 3, ["copy", "login", "mount", "read"])]
    found = detect(frame(spark, [*history(), *attack().values()]), labels(spark, "secret"))
    checked = validate(found, frame(spark, [*history(), *attack().values()]), labels(spark, "secret"), Chain()).first()
    assert checked.errors == []


def test_without_copy_partial_and_benign_nothing(spark):
    steps = attack()
    del steps["copy"]
    assert [r.decision for r in run(spark, steps.values())] == ["partial_observation"]
    assert run(spark, [event("later", DAY5, "login_success", app_id="a1")]) == []


MUTATIONS = [("copy", "user_id", "other"), ("copy", "device_id", "d1"), ("copy", "resource_id", "work"), ("mount", "removable_device_id", "n"),
             ("copy", "event_time", START + timedelta(minutes=DAY5 + 9)), ("copy", "event_time", START + timedelta(minutes=DAY5 + 10)),
             ("mount", "event_time", START + timedelta(minutes=DAY5 + 20)), ("copy", "bytes_written", 0), ("mount", "action", "usb_unmount")]


@pytest.mark.parametrize("step,field,value", MUTATIONS)
def test_one_changed_field_leaves_a_partial(spark, step, field, value):
    steps = attack()
    steps[step][field] = value
    assert [r.decision for r in run(spark, steps.values())] == ["partial_observation"]


def test_unmount_between_mount_and_copy_breaks_the_chain(spark):
    extra = event("gone", DAY5 + 20, "usb_unmount", removable_device_id="m", device_id="d2", user_id="someone")
    assert [r.decision for r in run(spark, [*attack().values(), extra])] == ["partial_observation"]


@pytest.mark.parametrize("step,expected", [("login", 0), ("read", 0), ("mount", 1), ("copy", 1)])
def test_failed_steps_support_nothing(spark, step, expected):
    steps = attack()
    steps[step]["outcome"] = "failure"
    rows = run(spark, steps.values())
    assert len(rows) == expected and all(r.decision == "partial_observation" for r in rows)


def sequential(rows, resources, window, minimum=3):
    """The rule as one would write it for a list in memory."""
    done = lambda e: e["outcome"] in (None, "success")
    day = lambda e: e["event_time"].date()
    rows = sorted(rows, key=lambda e: (e["event_time"], e["event_id"]))
    found, until = [], {}
    for login in rows:
        key = (login["user_id"], login["device_id"])
        if login["action"] != "login_success" or not done(login) or (key in until and login["event_time"] <= until[key]):
            continue
        past = [e for e in rows if e["user_id"] == key[0] and done(e) and day(e) < day(login)]
        logins, reads = ([e for e in past if e["action"] == a] for a in ("login_success", "file_read"))
        same = [sum(f(e) == f(login) for e in logins) for f in (
            lambda e: e["device_id"], lambda e: e["app_id"], lambda e: e["event_time"].hour)]
        if len(logins) < minimum or all(same) or len(reads) < minimum:
            continue
        inside = [e for e in rows if (e["user_id"], e["device_id"]) == key and done(e)
                  and login["event_time"] < e["event_time"] <= login["event_time"] + window]
        hits = [e for e in inside if e["action"] == "file_read" and e["resource_id"] in resources
                and all(p["resource_id"] != e["resource_id"] for p in reads)]
        if not hits:
            continue
        end, copy, read = hits[0]["event_time"], None, hits[0]
        for c in inside:
            if c["action"] != "file_copy_to_usb" or not (c["bytes_written"] or 0) > 0:
                continue
            own = [h for h in hits if h["resource_id"] == c["resource_id"] and h["event_time"] < c["event_time"]]
            medium = [e for e in rows if done(e) and e["device_id"] == c["device_id"] and e["removable_device_id"] == c["removable_device_id"]]
            mounts = [m for m in medium if m["action"] == "usb_mount" and m["user_id"] == key[0]
                      and c["event_time"] - window <= m["event_time"] < c["event_time"]]
            active = [m for m in mounts if not any(u["action"] == "usb_unmount" and m["event_time"] <= u["event_time"] <= c["event_time"] for u in medium)]
            if own and active:
                end, copy, read = c["event_time"], c, own[0]
                break
        until[key] = end
        found.append((login["event_id"], read["event_id"], copy and copy["event_id"]))
    return sorted(found, key=str)


def random_log(seed, n=420):
    rng = random.Random(seed)
    rows, last = [], {}
    for i, minute in enumerate(sorted(rng.randrange(0, 6 * 1440, 7) for _ in range(n))):
        action = rng.choice(["login_success", "login_success", "file_read", "file_read", "file_copy_to_usb", "file_copy_to_usb", "usb_mount", "usb_mount", "usb_unmount"])
        user = rng.choice("uv")
        if action == "file_read":
            last[user] = f"r{rng.randrange(60)}"
        rows.append(event(f"e{i:04d}", minute, action, user_id=user, device_id=f"d{1 + (minute // 1440 + rng.randrange(2)) % 4}",
                          app_id=rng.choice(["a1", "a2", "a3"]) if action == "login_success" else None,
                          resource_id=last.get(user, "r0") if action.startswith("file") else None,
                          removable_device_id="m" if action.startswith("usb") or action == "file_copy_to_usb" else None,
                          destination_type="removable_media" if action == "file_copy_to_usb" else None,
                          bytes_written=rng.choice([0, 9, 9]) if action == "file_copy_to_usb" else None, outcome=rng.choice([None, None, None, None, "failure"])))
    return rows


@pytest.mark.parametrize("seed", [7, 8])
def test_random_logs_equal_the_sequential_rule(spark, seed):
    rows, sensitive = random_log(seed), [f"r{i}" for i in range(0, 60, 2)]
    window = 1440 * MINUTE
    expected = sequential(rows, set(sensitive), timedelta(minutes=1440))
    shuffled = frame(spark, rows).repartition(5, F.rand(seed))
    got = detect(shuffled, labels(spark, *sensitive), Chain(window, window)).collect()
    assert sorted(((r.login_id, r.read_id, r.copy_id) for r in got), key=str) == expected
    assert any(c for *_, c in expected) and any(c is None for *_, c in expected)


def test_later_rows_do_not_change_an_earlier_frame(spark):
    rows = random_log(3)
    cutoff = START + timedelta(days=4)
    moment = F.lit(cutoff).cast("timestamp")
    config = Chain(600 * MINUTE, 600 * MINUTE)
    names = [f"r{i}" for i in range(0, 60, 2)]
    replayed = compare.replay(frame(spark, rows), labels(spark, *names), config, moment).select("candidate_id", "decision").collect()
    prefix = detect(frame(spark, [r for r in rows if r["event_time"] <= cutoff]), labels(spark, *names), config)
    assert sorted(replayed) == sorted(prefix.select("candidate_id", "decision").collect())


def walk(rows):
    kept, until = [], {}
    for user, device, at, login, end in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        if at > until.get((user, device), -1):
            kept.append(login)
            until[user, device] = end
    return sorted(kept)


def test_episodes_of_hot_and_cold_groups(spark):
    rng = random.Random(7)
    rows = [(u, "d", t, f"{u}{i:03d}", t + rng.randrange(0, 90)) for u in ("hot", "cold")
            for i in range(300 if u == "hot" else 12) for t in [rng.randrange(0, 3000)]]
    table = spark.createDataFrame(rows, "user_id string, device_id string, login_us bigint, login_id string, end_us bigint")
    assert sorted(r.login_id for r in episodes(table).collect()) == walk(rows)


def test_reference_window_is_sixty_minutes(spark):
    steps = attack()
    steps["read"]["event_time"] = START + timedelta(minutes=DAY5 + 60)
    del steps["copy"]
    assert len(run(spark, steps.values())) == 1
    steps["read"]["event_time"] += timedelta(microseconds=1)
    assert run(spark, steps.values()) == []


def test_forged_candidates_are_reported(spark):
    events = frame(spark, [*history(), *attack().values()])
    found = detect(events, labels(spark, "secret"))
    forged = found.withColumn("mount_id", F.lit("read")).withColumn("decision", F.lit("partial_observation"))
    errors = validate(forged, events, labels(spark, "secret"), Chain()).first().errors
    assert errors == ["the copy cites another mount", "the decision does not fit the stages"]
    assert candidates(events, labels(spark, "nothing")).count() == 0
    assert chain.RULE_VERSION == "login-read-copy/1"


def test_sweep_over_a_thousand_cutoffs(spark):
    """Decision counts at every cutoff as thinning the candidates of that moment one by one would give them."""
    rng, window, rows = random.Random(4), 60, []
    for user in ("u", "v"):
        for at in sorted(rng.sample(range(900), 70)):
            read = at + rng.randrange(1, window + 1)
            copy = rng.choice([None, rng.randrange(read, at + window + 1)])
            rows.append((user, "d", f"{user}{at:03d}", at, read, copy, copy or read))
    found = spark.createDataFrame(rows, "user_id string, device_id string, login_id string, login_us bigint, first_read_us bigint, copy_us bigint, end_us bigint")
    got = {r.cutoff_us: (r.incident_count, r.partial_count) for r in compare.replay_sweep(found, list(range(1000)), window).collect()}
    expected = {}
    for cutoff in range(1000):
        counts, until = [0, 0], {}
        for user, _, _, login, read, copy, _ in rows:
            done = copy is not None and copy <= cutoff
            if read <= cutoff and login > until.get(user, -1):
                until[user] = copy if done else read
                counts[not done] += 1
        expected[cutoff] = tuple(counts)
    assert got == expected
