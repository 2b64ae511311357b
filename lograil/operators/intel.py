"""Indicator validation and exact matching against structured event fields."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograil.functions.identity import canon_domain_ascii, canon_ip4, canon_ip_or_domain, canon_sha256, foreign_canon
from lograil.functions.once import computed_once

# Which indicator type each event field can match.
FIELDS = {"src_ip": "ip", "dst_ip": "ip", "domain": "domain", "file_hash": "sha256"}


def normalized(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """Add `normalized_value`, the canonical value of a typed indicator, null when it is not exactly of its type.

    Python is called once a row, whatever is later filtered or read.
    """
    clean = F.when((F.trim(value) == F.col(value)) & F.length(value).between(1, 1000), F.col(value))
    addressed, named = F.coalesce(F.col(kind) == "ip", F.lit(False)), F.when(F.col(kind).isin("ip", "domain"), clean)
    found = rows.withColumn("_found", foreign_canon(addressed, named))
    return computed_once(found, {"normalized_value": (
        F.when(F.col(kind).isin("ip", "domain"), canon_ip_or_domain(addressed, named, F.col("_found")))
        .when(F.col(kind) == "sha256", canon_sha256(clean)))}).drop("_found")


def _foreign(value: str) -> Column:
    """Addresses with a colon and non-ASCII values: what may have to travel to Python."""
    return F.col(value).contains(":") | F.col(value).rlike(r"[^\x00-\x7F]")


def _native(kind: str, value: str) -> Column:
    """The canonical value in generated code, of a value that is not foreign."""
    clean = F.when((F.trim(value) == F.col(value)) & F.length(value).between(1, 1000), F.col(value))
    return (F.when(F.col(kind) == "ip", canon_ip4(clean)).when(F.col(kind) == "domain", canon_domain_ascii(clean))
            .when(F.col(kind) == "sha256", canon_sha256(clean)))


def with_normalized(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """Add `normalized_value`, row by row, as a stream needs it. Only foreign rows travel to Python."""
    return (computed_once(rows.where(~_foreign(value)), {"normalized_value": _native(kind, value)})
            .unionByName(normalized(rows.where(_foreign(value)), kind, value)))


def validate_indicators(rows: DataFrame) -> DataFrame:
    """Add `normalized_value` and `error` (first broken rule, else null)."""
    key = ["type", "normalized_value", "source", "source_reference"]
    found = computed_once(normalized(rows, "type", "value"), {
        "_blank": F.coalesce(*[F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(f"{c} must be nonblank"))
                               for c in ("source", "source_reference", "description")])})
    repeated = (found.where("normalized_value is not null").groupBy(*key).agg(F.count("*").alias("_n"))
                .where("_n > 1").withColumnsRenamed({k: f"_{k}" for k in key}))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    joined = found.join(repeated, same, "left")
    confidence = F.col("source_confidence")
    error = F.coalesce(
        F.when(F.col("normalized_value").isNull(), "value does not fit its indicator type"), F.col("_blank"),
        F.when(confidence.isNotNull() & ~confidence.between(0.0, 1.0), "confidence must lie between 0 and 1"),
        F.when(F.col("effective_from") >= F.col("effective_until"), "interval must increase"),
        F.when(F.col("_n").isNotNull(), "duplicate source assertion"))
    return joined.withColumn("error", error).drop("_blank", "_n", *[f"_{k}" for k in key])


def observables(events: DataFrame) -> DataFrame:
    """(match_field, indicator_type, observed_value) rows next to the event columns."""
    entries = F.array(*[F.struct(F.lit(f).alias("match_field"), F.lit(t).alias("indicator_type"),
                                 F.col(f).cast("string").alias("observed_value"))
                        for f, t in FIELDS.items() if f in events.columns])
    return events.select(*[c for c in events.columns if c not in FIELDS], F.inline(entries)).where("observed_value is not null")


def _met(seen: DataFrame, known: DataFrame) -> DataFrame:
    """Observed rows with the known value that theirs means.

    The foreign spellings that occur are normalised once each and meet the known values; rows then meet a known value
    by its canonical form or, foreign ones, by their spelling, so no row of events travels to Python.
    """
    kind, value = "indicator_type", "observed_value"
    spelt = normalized(seen.where(_foreign(value)).select(kind, value).distinct(), kind, value)
    as_it_is = known.withColumns({"_key": F.col("normalized_value"), "_foreign": F.lit(False)})
    as_spelt = spelt.join(known, [kind, "normalized_value"]).withColumnRenamed(value, "_key").withColumn("_foreign", F.lit(True))
    keyed = computed_once(seen, {"_foreign": _foreign(value), "_key": F.when(_foreign(value), F.col(value)).otherwise(_native(kind, value))})
    met = keyed.join(as_it_is.unionByName(as_spelt), [kind, "_key", "_foreign"])
    rest = [c for c in seen.columns if c != kind]
    return met.select(kind, "normalized_value", *rest, "_intervals", "assertions")


def group_hits(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """One row per (event, field) whose value equals an enabled indicator.

    Assertions of one indicator value are first counted per validity interval, then
    brought into one row, so the event side meets each value once: neither a value
    seen in very many events nor one asserted very often multiplies rows.
    """
    # Python sees each assertion's value once for an interval, not once for each assertion.
    asserted = (indicators.where("enabled").groupBy(F.col("type").alias("indicator_type"), "value", "effective_from", "effective_until")
                .agg(F.count("*").alias("n")))
    known = (normalized(asserted, "indicator_type", "value")
             .groupBy("indicator_type", "normalized_value", "effective_from", "effective_until").agg(F.sum("n").alias("n"))
             .where("normalized_value is not null")
             .groupBy("indicator_type", "normalized_value")
             .agg(F.sort_array(F.collect_list(F.struct("effective_from", "effective_until", "n"))).alias("_intervals"),
                  F.sum("n").alias("assertions")))
    seen, key = observables(events), ["indicator_type", "normalized_value"]
    if seen.isStreaming:
        found = with_normalized(seen, "indicator_type", "observed_value").join(known, key)
    else:
        found = _met(seen, known)
    moment = F.col("event_time")
    validity = lambda a: (
        F.when(a["effective_from"] > moment, "not_yet_effective_at_event_time")
        .when(a["effective_until"] <= moment, "expired_at_event_time")
        .when(a["effective_from"].isNotNull() | a["effective_until"].isNotNull(), "effective_at_event_time")
        .otherwise("unspecified"))
    hits = (found
            .withColumn("intervals", F.transform("_intervals", lambda a: F.struct(
                a["effective_from"].alias("effective_from"), a["effective_until"].alias("effective_until"),
                a["n"].alias("assertions"), validity(a).alias("validity"))))
            .drop("_intervals"))
    states = F.array_distinct(F.transform("intervals", lambda a: a["validity"]))
    return (hits.withColumn("source_status", F.when(F.col("assertions") == 1, "single_source")
                            .when(F.size("intervals") > 1, "conflicting_sources").otherwise("corroborated_sources"))
            .withColumn("validity_status", F.when(F.size(states) == 1, states[0]).otherwise("conflicting_validity")))


def ioc_match(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """Per (event, field) and validity interval, how many assertions hold it and their state at event time."""
    return group_hits(events, indicators).select(
        "event_id", "match_field", "indicator_type", "normalized_value", F.inline("intervals"))


def matched_indicators(hits: DataFrame, indicators: DataFrame) -> DataFrame:
    """The enabled assertions behind grouped hits."""
    values = hits.select("indicator_type", "normalized_value").distinct()
    known = indicators.where("enabled").withColumnRenamed("type", "indicator_type")
    spelt = normalized(known.select("indicator_type", "value").distinct(), "indicator_type", "value")
    met = spelt.join(values, ["indicator_type", "normalized_value"], "left_semi")
    rest = [c for c in known.columns if c != "indicator_type"]
    return known.join(met, ["indicator_type", "value"]).select("indicator_type", "normalized_value", *rest)


def ioc_summary(hits: DataFrame, indicators: DataFrame) -> DataFrame:
    """Pairs, events, indicators and fields of grouped hits."""
    ids = matched_indicators(hits, indicators).agg(F.count_distinct("indicator_id"))
    return hits.agg(F.count("*").alias("matched_pairs"), F.count_distinct("event_id").alias("matched_events"),
                    F.array_join(F.sort_array(F.collect_set("match_field")), ",").alias("matched_fields")
                    ).withColumn("matched_indicators", ids.scalar())
