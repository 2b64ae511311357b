"""The shape of the plans: what reaches the scan, and which joins never appear."""
from pyspark.sql import functions as F

from lograil.operators import compare, context, history, hunts, intel
from lograil.operators.chain import candidates, episodes
from lograil.plans.analysis import indicators
from lograil.plans.obs import authorizations, obs, resources
from lograil.session import durable
from tests.logs import START, attack, event, frame, history as ordinary

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    frame(spark, [*ordinary(), *attack().values()]).write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    text = plan(compare.as_of(events, F.lit(START).cast("timestamp")).select("event_id"))
    assert "LessThanOrEqual(event_time" in text and "ReadSchema: struct<event_id:string,event_time:timestamp>" in text
    text = plan(hunts.hunt(events, [hunts.Filter("action", "eq", "file_read")], ["event_id"]))
    assert "EqualTo(action,file_read)" in text and "ReadSchema: struct<event_id:string,action:string>" in text


def test_no_pairwise_joins(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events, labels = obs(spark, FOLDER), resources(spark, FOLDER)
        copies = events.where("action = 'file_copy_to_usb'").selectExpr(
            "user_id copy_user", "device_id copy_device", "resource_id copy_resource", "action copy_action", "unix_micros(event_time) copy_us")
        plans = [candidates(events, labels), history.auth_history(events), context.with_sensitivity(events, labels),
                 context.authorize(copies, authorizations(spark, FOLDER)),
                 intel.group_hits(obs(spark, FOLDER, domains=True), indicators(spark, FOLDER))]
        for df in plans:
            text = plan(df)
            assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text.replace("ArrowEvalPython", "")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_repeated_and_shuffled_rows_change_nothing(spark):
    from lograil.operators.chain import detect
    from tests.logs import labels
    rows = [*ordinary(), *attack().values(), event("other", 7000, "login_success", app_id="a1")]
    once = detect(frame(spark, rows), labels(spark, "secret")).select("candidate_id", "decision").collect()
    mixed = frame(spark, rows[::-1]).repartition(6, F.rand(4))
    assert detect(mixed, labels(spark, "secret")).select("candidate_id", "decision").collect() == once
    assert episodes(candidates(mixed, labels(spark, "secret"))).count() == 1


def test_view_is_stored_once_for_a_query(spark, monkeypatch):
    """Inside a marked query events, labels and the detector start from one stored table; outside nothing is kept."""
    from lograil.plans import obs as view

    folder, stored = "/root/testdata/sf0.001", []
    monkeypatch.setattr(view, "durable", lambda rows: stored.append(durable(rows)) or stored[-1])
    seen = {}

    @view.stores_view
    def query(spark, folder):
        seen["files"] = set(view.obs(spark, folder).inputFiles())
        seen["labels"] = set(view.resources(spark, folder).inputFiles())
        return view.authorizations(spark, folder)

    grants = query(spark, folder)
    assert len(stored) == 1 and seen["files"] == seen["labels"] == set(grants.inputFiles()) == set(stored[0].inputFiles())
    assert all(f.endswith("events.parquet") for f in view.obs(spark, folder).inputFiles())
    assert sorted(stored[0].collect(), key=str) == sorted(view.obs(spark, folder).collect(), key=str)


def test_window_scores_are_worked_out_once_for_an_audit(spark, monkeypatch):
    from lograil.plans import analysis

    calls, rarity = [], analysis._rarity
    monkeypatch.setattr(analysis, "_rarity", lambda *a: calls.append(a) or rarity(*a))
    analysis.calibration_audit(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
