"""Group events into incidents by rule, key and first-event window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.operators.anchors import anchored_windows
from emberwatch.operators.ordering import number_rows
from emberwatch.operators.rules import DEFAULT_RULES, Rule, per_rule
from emberwatch.operators.session_chains import STRIP_POINTS
from emberwatch.operators.suppress import suppress_overlaps
from emberwatch.storage import stage


@dataclass(frozen=True)
class Correlation:
    """``incidents``: one row each.  ``membership``: ``window_id, event_id, us``.

    An incident never carries its events; ``window_id`` joins the two tables.
    """

    incidents: DataFrame
    membership: DataFrame


def candidate_incidents(
    events: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    strip_points: int = STRIP_POINTS,
) -> Correlation:
    """Every window with enough events, numbered, before suppression.

    Ids follow rule, then the key's first event, then window start.
    """
    assignments, cells = anchored_windows(events, rules, strip_points)
    windows = assignments.groupBy("window_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("us").alias("start_us"),
        F.max("us").alias("end_us"),
        F.min(F.when(F.col("us") == F.col("anchor_us"), F.col("event_id"))).alias(
            "first_event_id"
        ),
    )
    whole_key = Window.partitionBy("rule_idx", "key")
    opens_key = F.col("start_us") == F.col("key_first_us")
    named = (
        windows.join(
            cells.select(
                F.col("cell_id").alias("window_id"), "rule_idx", "key", "key_first_us"
            ),
            "window_id",
        )
        .withColumn(
            "key_first_event_id",
            F.min(F.when(opens_key, F.col("first_event_id"))).over(whole_key),
        )
        .where(F.col("event_count") >= per_rule(rules, "min_events"))
    )
    numbered = number_rows(
        named,
        [
            F.col("rule_idx").asc(),
            F.col("key_first_us").asc(),
            F.col("key_first_event_id").asc(),
            F.col("start_us").asc(),
        ],
        "id",
        "candidates",
    )
    incidents = numbered.select(
        "id",
        "window_id",
        "rule_idx",
        per_rule(rules, "name").alias("rule_name"),
        "key",
        "start_us",
        "end_us",
        F.timestamp_micros("start_us").alias("start_time"),
        F.timestamp_micros("end_us").alias("end_time"),
        "event_count",
        "first_event_id",
    )
    return Correlation(incidents, assignments.select("window_id", "event_id", "us"))


def correlate(
    events: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    strip_points: int = STRIP_POINTS,
) -> Correlation:
    """Candidates, suppression, and the membership of what is kept."""
    candidates = candidate_incidents(events, rules, strip_points)
    kept = stage(suppress_overlaps(candidates.incidents, candidates.membership), "kept")
    membership = candidates.membership.join(kept.select("window_id"), "window_id")
    return Correlation(kept, stage(membership, "membership"))
