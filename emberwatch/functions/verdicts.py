"""Severity, office hours and verdict labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch.fixed_values import (
    LEVEL_TO_SEVERITY,
    LOWEST_VERDICT,
    OFFICE_CLOSE_HOUR,
    OFFICE_OPEN_HOUR,
    OFFICE_UTC_OFFSET_HOURS,
    SEVERITY_LABELS,
    VERDICT_BOUNDS,
)

HOUR_US = 3_600_000_000


def severity_from_level(level: Column) -> Column:
    steps = [F.when(level >= bound, F.lit(sev)) for bound, sev in LEVEL_TO_SEVERITY]
    return F.coalesce(*steps, F.lit(1))


def severity_label(severity: Column) -> Column:
    named = [F.when(severity == n, F.lit(name)) for n, name in SEVERITY_LABELS.items()]
    return F.coalesce(*named, F.lit(SEVERITY_LABELS[1]))


def in_office_hours(us: Column) -> Column:
    """Local office hours for a UTC time in microseconds; whole UTC hours count."""
    hour = F.pmod(F.floor(us / HOUR_US) + OFFICE_UTC_OFFSET_HOURS, F.lit(24))
    return (hour >= OFFICE_OPEN_HOUR) & (hour < OFFICE_CLOSE_HOUR)


def verdict(confidence: Column) -> Column:
    steps = [F.when(confidence >= bound, F.lit(name)) for bound, name in VERDICT_BOUNDS]
    return F.coalesce(*steps, F.lit(LOWEST_VERDICT))
