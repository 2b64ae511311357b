"""Comparing runs: correspondence, sensitivity, replay, re-verification."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograil.operators.chain import ACTOR, Chain, detect, episodes
from lograil.operators.features import WIDTH, window_start
from lograil.operators.merkle import fingerprint
from lograil.operators.ordered import micros, nearest
from lograil.session import durable

STAGES = ("authentication", "collection", "transfer")


def as_of(events: DataFrame, cutoff: Column) -> DataFrame:
    """Observations up to and including the cutoff; the filter reaches the scan."""
    return events.where(F.col("event_time") <= cutoff)


def exclude(events: DataFrame, ids: DataFrame) -> DataFrame:
    return events.join(ids.select("event_id").distinct(), "event_id", "left_anti")


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Candidates of one subject whose intervals overlap and which share evidence.

    Joined on the shared event: an event is cited by few candidates, a subject may
    have very many.
    """
    side = lambda df, p: df.select(*ACTOR, F.col("candidate_id").alias(f"{p}_id"), F.col("login_us").alias(f"{p}_from"),
                                   F.col("end_us").alias(f"{p}_to"), F.explode("selected").alias("event_id"))
    overlap = F.greatest("left_from", "right_from") <= F.least("left_to", "right_to")
    return (side(left, "left").join(side(right, "right"), [*ACTOR, "event_id"]).where(overlap)
            .select("left_id", "right_id").distinct())


def _degrees(left: DataFrame, right: DataFrame) -> DataFrame:
    pairs = durable(_pairs(left, right))
    lefts = pairs.groupBy("left_id").agg(F.count("*").alias("left_degree"))
    rights = pairs.groupBy("right_id").agg(F.count("*").alias("right_degree"))
    return pairs.join(lefts, "left_id").join(rights, "right_id")


def correspond(left: DataFrame, right: DataFrame, score: str = "score") -> DataFrame:
    """One-to-one pairs are matched, others ambiguous, the rest unmatched on either side."""
    linked = _degrees(left, right)
    unique = linked.where("left_degree = 1 and right_degree = 1").select("left_id", "right_id")
    busy = linked.select("left_id").distinct().withColumn("linked", F.lit(True))
    a = left.select(F.col("candidate_id").alias("left_id"), F.col(score).alias("left_score"), F.col("decision").alias("left_decision"))
    b = right.select(F.col("candidate_id").alias("right_id"), F.col(score).alias("right_score"), F.col("decision").alias("right_decision"))
    rows = (a.join(unique, "left_id", "left").join(busy, "left_id", "left").join(b, "right_id", "left")
            .select("left_id", "right_id",
                    F.when(F.col("right_id").isNotNull(), "matched").when(F.col("linked"), "ambiguous").otherwise("unmatched").alias("status"),
                    (F.col("right_score") - F.col("left_score")).alias("risk_delta"),
                    (F.col("left_decision") != F.col("right_decision")).alias("decision_changed")))
    alone = b.join(linked, "right_id", "left_anti").select(
        F.lit(None).cast("string").alias("left_id"), "right_id", F.lit("unmatched").alias("status"),
        F.lit(None).cast("double").alias("risk_delta"), F.lit(None).cast("boolean").alias("decision_changed"))
    return rows.unionByName(alone)


def evidence_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a changed run kept, lost and gained per candidate: matched, lost, new or ambiguous."""
    linked = _degrees(before, after)
    tangled = linked.where("left_degree > 1 or right_degree > 1")
    unique = linked.where("left_degree = 1 and right_degree = 1").select("left_id", "right_id")
    steps = lambda c: F.slice(F.array(*[F.lit(s) for s in STAGES]), 1, F.col(c))
    a = before.select(F.col("candidate_id").alias("left_id"), F.col("selected").alias("a"), steps("stages").alias("a_stages"))
    b = after.select(F.col("candidate_id").alias("right_id"), F.col("selected").alias("b"), steps("stages").alias("b_stages"))
    empty = F.array().cast("array<string>")
    rows = (a.join(tangled.select("left_id").distinct().withColumn("tangled", F.lit(True)), "left_id", "left")
            .join(unique, "left_id", "left").join(b, "right_id", "left")
            .withColumns({c: F.coalesce(c, empty) for c in ("b", "b_stages")}))
    known = rows.select(
        "left_id", "right_id",
        F.when(F.col("tangled"), "ambiguous").when(F.col("right_id").isNotNull(), "matched").otherwise("lost").alias("status"),
        F.array_intersect("a", "b").alias("surviving"), F.array_except("a", "b").alias("removed"),
        F.array_except("b", "a").alias("added"), F.array_except("a_stages", "b_stages").alias("lost_stages"),
        F.array_except("b_stages", "a_stages").alias("new_stages"))
    fresh = b.join(linked, "right_id", "left_anti").select(
        F.lit(None).cast("string").alias("left_id"), "right_id", F.lit("new").alias("status"), empty.alias("surviving"),
        empty.alias("removed"), F.col("b").alias("added"), empty.alias("lost_stages"), F.col("b_stages").alias("new_stages"))
    return known.unionByName(fresh)


def sensitivity(events: DataFrame, resources: DataFrame, excluded: DataFrame, config: Chain,
                before: DataFrame | None = None) -> DataFrame:
    """Rerun the detector without some observations and compare with the parent run."""
    before = before if before is not None else detect(events, resources, config)
    return evidence_diff(before, detect(exclude(events, excluded), resources, config))


def run_inputs(inputs: dict[str, DataFrame]) -> DataFrame:
    """(input, sha256, rows) of a run's tables: the roots of their hash trees."""
    rows = [fingerprint(t, t.columns).select(F.lit(name).alias("input"), F.col("fingerprint").alias("sha256"), F.col("event_count").alias("rows")) for name, t in inputs.items()]
    result = rows[0]
    for row in rows[1:]:
        result = result.unionByName(row)
    return result


def changed_inputs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inputs whose hash differs between two runs, or which only one of them has."""
    a, b = (side.withColumnsRenamed({"sha256": f"{name}_sha256", "rows": f"{name}_rows"}) for side, name in ((left, "left"), (right, "right")))
    return a.join(b, "input", "full_outer").withColumn("changed", ~F.col("left_sha256").eqNullSafe(F.col("right_sha256")))


def context_only(changes: DataFrame) -> DataFrame:
    """One row: whether nothing but the authorization context changed."""
    others = F.count_if(F.col("changed") & (F.col("input") != "authorizations"))
    return changes.agg(F.count_if("changed").alias("changed_inputs"), (others == 0).alias("context_only"))


def replay(events: DataFrame, resources: DataFrame, config: Chain, cutoff: Column) -> DataFrame:
    """The detector's findings as they stood at the cutoff."""
    return detect(as_of(events, cutoff), resources, config)


def replay_stops(events: DataFrame) -> DataFrame:
    """Instants at which a replayed run can change: events, window closures up to the end, and just before the start."""
    times = events.select(micros().alias("us"))
    span = times.agg(F.min("us").alias("first"), F.max("us").alias("last"))
    closures = times.select((window_start("us") + F.lit(WIDTH)).alias("us")).distinct().where(
        F.col("us") <= span.select("last").scalar())
    start = span.where("first is not null").select((F.col("first") - 1).alias("us"))
    return times.unionByName(closures).unionByName(start).distinct()


def replay_sweep(found: DataFrame, cutoffs: list[int], window: int) -> DataFrame:
    """Decision counts at many cutoffs from one pass over the candidates.

    `found` is `candidates` output for this chain window. At a cutoff a candidate exists once its first
    read happened and is complete once its copy did. When the window of a login is over, its candidate is what
    it stays, and so is its place in the kept chain: the chain is followed once over all candidates, and each kept one is
    counted at the first cutoff behind its window and carried on. At a cutoff only candidates of open windows are thinned
    anew, behind the end of the settled chain; so a candidate has a row for each cutoff inside its window and no more.
    """
    marks = F.array(*[F.lit(c).cast("bigint") for c in sorted(cutoffs)])
    found = durable(found)
    kept = durable(episodes(found).select(*ACTOR, "login_us", "end_us", F.col("copy_us").isNotNull().alias("complete")))
    closes = F.col("login_us") + F.lit(window)
    settled = kept.select(F.array_min(F.filter(marks, lambda c: c >= closes)).alias("cutoff_us"), "complete")
    opened = found.select("*", F.explode(F.filter(marks, lambda c: (c >= F.col("first_read_us")) & (c < closes))).alias("cutoff_us"))
    copied = F.col("copy_us") <= F.col("cutoff_us")
    opened = opened.select(*ACTOR, "cutoff_us", "login_id", "login_us", F.coalesce(copied, F.lit(False)).alias("complete"),
                           F.when(copied, F.col("copy_us")).otherwise(F.col("first_read_us")).alias("end_us"))
    ends = kept.select(*ACTOR, closes.alias("cutoff_us"), F.col("end_us").alias("until"))
    behind = nearest(opened, ends, ACTOR, "cutoff_us", ["until"], inclusive=True).where("until is null or login_us > until").drop("until")
    tail = episodes(behind, [*ACTOR, "cutoff_us"])
    counts = lambda rows: rows.groupBy("cutoff_us").agg(F.count_if("complete").alias("incidents"), F.count_if(~F.col("complete")).alias("partials"))
    every = found.sparkSession.range(1).select(F.explode(marks).alias("cutoff_us"))
    so_far = Window.orderBy("cutoff_us").rowsBetween(Window.unboundedPreceding, 0)      # a row for each cutoff
    carried = every.join(counts(settled), "cutoff_us", "left").select("cutoff_us", *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in ("incidents", "partials")])
    open_now = counts(tail).withColumnsRenamed({"incidents": "open_incidents", "partials": "open_partials"})
    return carried.join(open_now, "cutoff_us", "left").select(
        "cutoff_us", *[(F.col(f"{c}s") + F.coalesce(f"open_{c}s", F.lit(0))).alias(f"{c}_count") for c in ("incident", "partial")])


def verify_result(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows a stored result has too many or too few of, compared with its recomputation."""
    columns = stored.columns
    extra = stored.exceptAll(recomputed.select(*columns)).withColumn("problem", F.lit("not reproduced"))
    return extra.unionByName(recomputed.select(*columns).exceptAll(stored).withColumn("problem", F.lit("not stored")))


def view_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids only one of two frozen views holds."""
    left, right = a.select("event_id").distinct(), b.select("event_id").distinct()
    return (left.join(right, "event_id", "left_anti").withColumn("side", F.lit("missing"))
            .unionByName(right.join(left, "event_id", "left_anti").withColumn("side", F.lit("extra"))))
