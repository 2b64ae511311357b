"""Observation hunts and single-event rules, compiled to column predicates."""
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields a hunt may filter and show.
HUNT_FIELDS = ("source_type", "action", "user_id", "device_id", "resource_id", "src_ip", "dst_ip", "domain",
               "file_path", "file_hash", "process_name", "destination_type", "outcome")
HUNT_COLUMNS = ("event_id", "event_time", *HUNT_FIELDS)
MAX_FILTERS, MAX_VALUES, MAX_COLUMNS = 20, 25, 20
# The fields a rule may name. Text compares without case, byte counts as integers.
RULE_TEXT = ("source_type", "action", "outcome", "user_id", "device_id", "app_id", "session_id", "src_ip", "dst_ip",
             "domain", "file_path", "file_hash", "resource_id", "resource_scope", "destination_type",
             "removable_device_id", "process_id", "process_name", "geo_country")
RULE_INTEGER = ("bytes_read", "bytes_written", "bytes_sent")
MODIFIERS = ("contains", "startswith", "endswith")


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: str | tuple[str, ...]


@dataclass(frozen=True)
class Condition:
    field: str
    values: tuple
    modifier: str | None = None

    @property
    def expression(self) -> str:
        return f"{self.field}|{self.modifier}" if self.modifier else self.field


@dataclass(frozen=True)
class Rule:
    rule_id: str
    title: str
    level: str
    conditions: tuple[Condition, ...]


# The shipped hunting rules.
SHIPPED_RULES = (
    Rule("auth-failure", "a sign-in failed", "low", (Condition("action", ("login_failure",)),)),
    Rule("auth-success", "a sign-in succeeded", "informational", (Condition("action", ("login_success",)),)),
    Rule("file-read", "a file was read", "informational", (Condition("action", ("file_read",)),)),
    Rule("usb-mount", "a removable medium was attached", "low", (Condition("action", ("usb_mount",)),)),
    Rule("usb-unmount", "a removable medium was detached", "informational", (Condition("action", ("usb_unmount",)),)),
    Rule("explicit-copy", "a file went to a removable medium", "medium",
         (Condition("action", ("file_copy_to_usb",)), Condition("destination_type", ("removable_media",)))),
)


def _check_filter(f: Filter) -> None:
    if f.field not in HUNT_FIELDS or f.op not in ("eq", "in", "contains"):
        raise ValueError(f"unsupported hunt filter: {f.field} {f.op}")
    if f.op == "in" and not (1 <= len(f.value) <= MAX_VALUES and len(set(f.value)) == len(f.value)):
        raise ValueError("membership values must be 1 to 25 unique strings")
    if f.op == "contains" and (f.field == "file_hash" or len(f.value) < 2):
        raise ValueError("substring filters need a text field and at least two characters")


def _filter_column(f: Filter) -> Column:
    column = F.col(f.field)
    if f.op == "eq":
        return column == f.value
    if f.op == "in":
        return column.isin(*f.value)
    return F.lower(column).contains(f.value.lower())


def hunt(events: DataFrame, filters: list[Filter], columns: list[str], start: Column | None = None,
         end: Column | None = None) -> DataFrame:
    """Events matching every filter within [start, end); a missing value never matches."""
    if len(filters) > MAX_FILTERS:
        raise ValueError("at most 20 filters")
    for f in filters:
        _check_filter(f)
    if not 1 <= len(columns) <= MAX_COLUMNS or len(set(columns)) != len(columns) or set(columns) - set(HUNT_COLUMNS):
        raise ValueError("columns must be unique, nonempty and allow-listed")
    tests = [_filter_column(f) for f in filters]
    if start is not None:
        tests.append(F.col("event_time") >= start)
    if end is not None:
        tests.append(F.col("event_time") < end)
    return (events.where(reduce(and_, tests)) if tests else events).select(*columns)


def _condition_column(condition: Condition) -> Column:
    column = F.col(condition.field)
    if condition.field in RULE_INTEGER:
        if condition.modifier or any(isinstance(v, bool) or not isinstance(v, int) for v in condition.values):
            raise ValueError(f"{condition.field} takes integer equality only")
        return column.isin(*condition.values)
    if condition.field not in RULE_TEXT or condition.modifier not in (None, *MODIFIERS):
        raise ValueError(f"unsupported rule condition: {condition.expression}")
    left = F.lower(column.cast("string"))
    if condition.modifier is None:
        return left.isin(*[v.lower() for v in condition.values])
    return reduce(or_, [getattr(left, condition.modifier)(v.lower()) for v in condition.values])


def rule_column(rule: Rule) -> Column:
    """All conditions hold, each for one of its values; unknown counts as no match."""
    return F.coalesce(reduce(and_, [_condition_column(c) for c in rule.conditions]), F.lit(False))


def matched_fields(rule: Rule) -> Column:
    """Map from condition to the value that satisfied it."""
    return F.map_from_arrays(F.array(*[F.lit(c.expression) for c in rule.conditions]),
                             F.array(*[F.col(c.field).cast("string") for c in rule.conditions]))


def sigma_match(events: DataFrame, rule: Rule) -> DataFrame:
    return events.where(rule_column(rule)).withColumn("matched_fields", matched_fields(rule))


def sigma_scan(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Hits of a whole rule set in one pass: (rule_id, matched_fields) per event and rule."""
    hits = F.array_compact(F.array(*[F.when(rule_column(r), F.struct(
        F.lit(r.rule_id).alias("rule_id"), matched_fields(r).alias("matched_fields"))) for r in rules]))
    return events.withColumn("_hits", hits).where(F.size("_hits") > 0).select(
        *events.columns, F.inline("_hits"))


def load_rules(spark: SparkSession, path: str, limit: int = 1000) -> list[Rule]:
    """Rules kept as JSON rows; they are job definition, not data."""
    schema = ("rule_id string, title string, level string, "
              "conditions array<struct<field string, modifier string, values array<string>>>")
    rows = spark.read.schema(schema).json(path).take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"a rule set holds at most {limit} rules")
    typed = lambda c: tuple(int(v) for v in c["values"]) if c["field"] in RULE_INTEGER else tuple(c["values"])
    return [Rule(r["rule_id"], r["title"], r["level"], tuple(Condition(c["field"], typed(c), c["modifier"])
                                                              for c in r["conditions"])) for r in rows]


def search_text(rows: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Case-insensitive substring over several text columns."""
    return rows.where(F.lower(F.concat_ws(" ", *columns)).contains(needle.lower()))
