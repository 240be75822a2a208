"""Correlation rules and the key fan-out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.fixed_values import CORRELATION_RULES

MINUTE_US = 60_000_000


@dataclass(frozen=True)
class Rule:
    name: str
    key_fields: tuple[str, ...]
    window_minutes: float
    min_events: int

    @property
    def window_us(self) -> int:
        return int(self.window_minutes * MINUTE_US)


DEFAULT_RULES: tuple[Rule, ...] = tuple(
    Rule(name, tuple(fields), minutes, minimum)
    for name, fields, minutes, minimum in CORRELATION_RULES
)


def per_rule(rules: Sequence[Rule], attribute: str) -> Column:
    """The value of a rule attribute for the row's ``rule_idx``."""
    values = F.array(*[F.lit(getattr(rule, attribute)) for rule in rules])
    return F.element_at(values, F.col("rule_idx") + 1)


def event_micros(events: DataFrame) -> Column:
    return F.unix_micros(F.col("timestamp"))


def fan_out(events: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """One lean row per (event, rule whose key fields are all present).

    ``bucket`` cuts the time axis into cells one microsecond wider than the
    rule's window, so a cell holds at most one window start and a hot key
    spreads over as many groups as it has cells.
    """
    us = event_micros(events)
    arms = []
    for idx, rule in enumerate(rules):
        parts = [F.col(name).cast("string") for name in rule.key_fields]
        complete = F.lit(True)
        for part in parts:
            complete = complete & part.isNotNull()
        cell = F.lit(rule.window_us + 1)
        arms.append(
            F.when(
                complete,
                F.struct(
                    F.lit(idx).alias("rule_idx"),
                    F.array(*parts).alias("key"),
                    F.floor((us - F.pmod(us, cell)) / cell).cast("bigint").alias("bucket"),
                ),
            )
        )
    return events.select(
        us.alias("us"),
        F.col("event_id"),
        F.inline(F.array_compact(F.array(*arms))),
    ).select("rule_idx", "key", "bucket", "us", "event_id")
