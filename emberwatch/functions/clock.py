"""Timestamp parsing.

Results do not depend on the session time zone: text without a zone is UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch.functions.text import let, safe_int

_ISO = (
    r"\A([0-9]{4}-[0-9]{2}-[0-9]{2})"
    r"(?:[T ]([0-9]{2})(?::([0-9]{2})(?::([0-9]{2})(\.[0-9]+)?)?)?"
    r"(Z|[+-][0-9]{2}:?[0-9]{2})?)?\z"
)
_ZONED = r"(?:Z|[+-][0-9]{2}:?[0-9]{2})\z"
_EPOCH_UNITS = [(10**17, 10**9), (10**14, 10**6), (10**11, 10**3)]


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text to a timestamp, NULL where it is not valid."""

    def parsed(trimmed: Column) -> Column:
        # Missing hours, minutes and seconds become 00, a missing zone UTC.
        spelled = F.regexp_replace(trimmed, _ISO, "$1T$2:$3:$4$5$6")
        padded = F.regexp_replace(F.replace(spelled, F.lit("T:"), F.lit("T00:")), ":(?![0-9])", ":00")
        zoned = trimmed.rlike("[T ].*" + _ZONED)
        full = F.concat(padded, F.when(zoned, F.lit("")).otherwise(F.lit("Z")))
        return F.when(trimmed.rlike(_ISO), full.try_cast("timestamp"))

    return let(F.trim(text), parsed)


def missing_text(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def timestamp_error(text: Column, parsed: Column, name: str) -> Column:
    """NULL when parsed, else why not."""
    return F.when(missing_text(text), F.lit(f"missing {name}")).when(
        parsed.isNull(), F.concat(F.lit(f"invalid {name}: '"), text, F.lit("'"))
    )


def epoch_timestamp(text: Column) -> Column:
    """Epoch digits to a timestamp; the magnitude tells s, ms, us or ns.

    The value is taken as floating-point seconds rounded half-even to a
    microsecond.  Whole units and the remainder are divided apart, which keeps
    the quotient correctly rounded beyond 2^53.
    """

    def in_seconds(epoch: Column) -> Column:
        seconds = epoch.cast("double")
        for lower, unit in reversed(_EPOCH_UNITS):
            scaled = (epoch - epoch % unit) / unit + (epoch % unit) / F.lit(float(unit))
            seconds = F.when(F.abs(epoch) >= lower, scaled).otherwise(seconds)
        return seconds

    def as_timestamp(seconds: Column) -> Column:
        whole = seconds.cast("bigint")
        micros = F.rint((seconds - whole) * 1_000_000).cast("bigint")
        in_range = whole.between(-62_135_596_800, 253_402_300_799)
        return F.when(in_range, F.timestamp_micros(whole * 1_000_000 + micros))

    return let(let(safe_int(text, "bigint"), in_seconds), as_timestamp)


def zone_suffix(zone: Column) -> Column:
    """``Z``/``UTC`` to ``+00:00``, ``+0700`` to ``+07:00``, anything else as it is."""
    text = F.trim(F.coalesce(zone, F.lit("")))
    return (
        F.when(text.isin("Z", "UTC"), F.lit("+00:00"))
        .when(
            text.rlike(r"\A[+-][0-9]{4}\z"),
            F.concat(F.substring(text, 1, 3), F.lit(":"), F.substring(text, 4, 2)),
        )
        .otherwise(text)
    )


def local_clock_text(date: Column, time: Column, zone: Column) -> Column:
    """``<date>T<time><zone>``; NULL where date or time is missing."""
    present = (F.coalesce(date, F.lit("")) != "") & (F.coalesce(time, F.lit("")) != "")
    return F.when(present, F.concat(date, F.lit("T"), time, zone_suffix(zone)))
