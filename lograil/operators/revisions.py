"""Append-only revision logs: latest state, audit trail, chain checks.

A revision finds its predecessor by an equi-join on (entity, revision - 1), so no
entity's whole log is sorted in one task.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Allowed status changes; reopening is the explicit way back.
TRANSITIONS = (("open", "open"), ("open", "investigating"), ("investigating", "investigating"),
               ("investigating", "resolved"), ("resolved", "resolved"), ("resolved", "closed"))
REOPENABLE = ("resolved", "closed")


def latest_revision(log: DataFrame, key: str, revision: str = "revision") -> DataFrame:
    rest = [c for c in log.columns if c not in (key, revision)]
    return log.groupBy(key).agg(F.max(revision).alias(revision), F.max_by(F.struct(*rest), revision).alias("_last")).select(
        key, revision, "_last.*")


def current_mismatches(current: DataFrame, log: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Entities whose stored current body differs from their last revision."""
    last = latest_revision(log, key).select(key, F.col("revision").alias("_revision"), F.col(body).alias("_body"))
    differs = ~(F.col("revision").eqNullSafe(F.col("_revision")) & F.col(body).eqNullSafe(F.col("_body")))
    return current.join(last, key, "left").where(differs).select(key, "revision")


def _with_previous(log: DataFrame, key: str, columns: list[str]) -> DataFrame:
    previous = log.select(key, (F.col("revision") + 1).alias("revision"), F.lit(True).alias("has_previous"),
                          *[F.col(c).alias(f"previous_{c}") for c in columns])
    return log.join(previous, [key, "revision"], "left").withColumn("has_previous", F.coalesce("has_previous", F.lit(False)))


def audit_diff(log: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each revision with the fields that changed since the one before."""
    paired = _with_previous(log, key, columns)
    changed = F.array_compact(F.array(*[F.when(F.col("has_previous") & ~F.col(c).eqNullSafe(F.col(f"previous_{c}")), F.lit(c))
                                        for c in columns]))
    return paired.withColumn("changed", changed)


def transition_violations(log: DataFrame, key: str) -> DataFrame:
    """Gaps, illegal status changes, and closings without rationale or disposition."""
    paired = _with_previous(log, key, ["status"])
    change = F.concat_ws(">", "previous_status", "status")
    legal = change.isin(*[f"{a}>{b}" for a, b in TRANSITIONS])
    reopened = (F.col("operation") == "case_reopened") & F.col("previous_status").isin(*REOPENABLE) & (F.col("status") == "investigating")
    closing = (F.col("status") == "closed") & F.col("has_previous") & (F.col("previous_status") != "closed")
    violation = F.coalesce(
        F.when((F.col("revision") > 1) & ~F.col("has_previous"), "revision gap"),
        F.when((F.col("revision") == 1) & (F.col("status") != "open"), "first revision must be open"),
        F.when(F.col("has_previous") & ~legal & ~reopened, "illegal transition"),
        F.when(closing & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "closing needs a rationale"),
        F.when(closing & (F.col("disposition") == "undetermined"), "closing needs a disposition"))
    return paired.withColumn("violation", violation).where("violation is not null").select(key, "revision", "violation")


def search_cases(latest: DataFrame, needle: str = "", status: str | None = None, priority: str | None = None) -> DataFrame:
    rows = latest
    if status:
        rows = rows.where(F.col("status") == status)
    if priority:
        rows = rows.where(F.col("priority") == priority)
    return rows.where(F.instr(F.lower(F.concat_ws(" ", "title", "body")), needle.lower()) > 0) if needle else rows
