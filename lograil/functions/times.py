"""Event times: offsets, declared zones, DST gaps and folds."""
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from lograil.functions.once import let

_DATE = r"\d{4}-\d{2}-\d{2}"
_CLOCK = r"\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?"
_OFFSET = r"(Z|[+-]\d{2}:?\d{2}(:\d{2})?)"
NAIVE = rf"^{_DATE}([T ]{_CLOCK})?$"
ZONED = rf"^{_DATE}[T ]{_CLOCK}{_OFFSET}$"
# Longer than any clock change, shorter than the time between two: the offsets so far before and after an
# instant are those on either side of a change near it.
_AROUND = "26 hours"
MISSING_ZONE = "time without offset, and its source declares no zone"
AMBIGUOUS = "local time that the zone skips or repeats"
MALFORMED = "time cannot be read"


def declared(zone: str | None) -> Column:
    """A source's declared zone as a column; an unknown name fails when the job is defined."""
    if zone:
        ZoneInfo(zone)
    return F.lit(zone).cast("string")


def _extended(text: Column) -> Column:
    """ISO basic forms and left-out minutes or seconds in the extended form; other text as it is."""
    given, ends = text, r"(?=$|Z|[+-]\d)"
    for pattern, form in ((r"^(\d{4})(\d{2})(\d{2})(?=T|$)", "$1-$2-$3"), (rf"^({_DATE}[T ]\d{{2}})(\d{{2}})(\d{{2}})", "$1:$2:$3"),
                          (rf"^({_DATE}[T ]\d{{2}})(\d{{2}}){ends}", "$1:$2"), (rf"^({_DATE}[T ]\d{{2}}){ends}", "$1:00"),
                          (rf"^({_DATE}[T ]\d{{2}}:\d{{2}}){ends}", "$1:00")):
        text = F.regexp_replace(text, pattern, form)
    # None of the patterns fits a time written down to its seconds.
    return F.when(given.rlike(rf"^{_DATE}[T ]\d{{2}}:\d{{2}}:\d{{2}}"), given).otherwise(text)


def _instant(text: Column) -> Column:
    coloned = F.regexp_replace(text, r"([T ]\d{2}:\d{2}.*[+-]\d{2})(\d{2})$", "$1:$2")
    return F.try_to_timestamp(F.translate(F.when(text.rlike(r"[+-]\d{4}$"), coloned).otherwise(text), ",", "."))


def _also_shows(seen: Column, utc: Column, near: Column, zone: Column) -> Column:
    """Whether with the offset of the instant `near` another instant than `utc` shows the local time `seen`."""
    offset = F.unix_micros(F.from_utc_timestamp(near, zone)) - F.unix_micros(near)
    return let(F.timestamp_micros(F.unix_micros(seen) - offset), lambda other: (other != utc) & (F.from_utc_timestamp(other, zone) == seen))


def parse_event_time(text: Column, zone: Column) -> Column:
    """struct(event_time, timezone_assumption, error).

    A value with an offset is taken as it is; a naive one needs the source's zone
    and must name exactly one instant there.
    """
    def judged(text: Column, seen: Column, utc: Column) -> Column:
        zoned, naive = text.rlike(ZONED), text.rlike(NAIVE)
        gap = F.from_utc_timestamp(utc, zone) != seen
        step = F.expr(f"interval '{_AROUND}'")
        fold = _also_shows(seen, utc, utc - step, zone) | _also_shows(seen, utc, utc + step, zone)
        error = (F.when(text.isNull() | (text == ""), "record has no time")
                 .when(seen.isNull() | ~(zoned | naive), MALFORMED).when(zoned, None)
                 .when(zone.isNull(), MISSING_ZONE).when(gap | fold, AMBIGUOUS))
        return let(error, lambda problem: F.struct(
            F.when(problem.isNull(), F.when(zoned, seen).otherwise(utc)).alias("event_time"),
            F.when(problem.isNull() & naive, zone).alias("timezone_assumption"), problem.alias("error")))
    # Bound before it is used: each use would rewrite the text again.
    return let(_extended(text), lambda whole: let(_instant(whole), lambda seen: let(
        F.to_utc_timestamp(seen, zone), lambda utc: judged(whole, seen, utc))))


def parse_external_time(text: Column) -> Column:
    """struct(event_time, status); a null status marks a malformed value."""
    joined = F.regexp_replace(text, rf"^({_DATE})[ T](\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?) ([+-]\d{{2}}:\d{{2}})$", "$1T$2$3")

    def judged(seen: Column) -> Column:
        zoned = seen.isNotNull() & joined.rlike(ZONED)
        status = (F.when(text.isNull() | (text == ""), "accepted_timestamp_unknown").when(zoned, "accepted")
                  .when(seen.isNotNull() & joined.rlike(NAIVE), "accepted_timestamp_unknown_timezone"))
        return F.struct(F.when(zoned, seen).alias("event_time"), status.alias("status"))
    return let(_instant(joined), judged)
