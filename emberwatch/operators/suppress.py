"""Greedy suppression of overlapping incidents, in parallel rounds.

Sequentially: walk incidents from largest to smallest (ties by id) and drop one
when more than half of its events are already covered by the incidents kept so
far.  In parallel, for every undecided incident count over its events

* ``sure``     - events covered by a higher-ranked incident already kept,
* ``possible`` - events covered by a higher-ranked incident kept or undecided.

``sure`` over the limit drops it, ``possible`` within the limit keeps it, and the
rest waits for the next round.  The highest-ranked undecided incident always has
``sure = possible``, so every round decides something and the outcome equals the
sequential one.

Events that lie in the same set of incidents are interchangeable, so they are
collapsed to one weighted row first: the rounds run on distinct overlaps and not
on events, and a hot key shrinks to a handful of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.fixed_values import OVERLAP_LIMIT
from emberwatch.storage import stage_measured

# Sorts like the sequential walk: larger incidents first, then the lower id.
_RANK = "named_struct('minus_n', -event_count, 'id', id)"


def _overlaps(incidents: DataFrame, membership: DataFrame) -> DataFrame:
    """Distinct sets of incidents that share events, with the number of events."""
    shared = (
        membership.groupBy("event_id")
        .agg(F.array_sort(F.collect_list("window_id")).alias("windows"))
        .where(F.size("windows") > 1)
        .groupBy("windows")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    return (
        shared.select("windows", "weight", F.explode("windows").alias("window_id"))
        .join(incidents.select("window_id", F.expr(_RANK).alias("rank")), "window_id")
        .groupBy("windows", "weight")
        .agg(F.array_sort(F.collect_list("rank")).alias("undecided"))
        .where(F.size("undecided") > 1)
        .groupBy("undecided")
        .agg(F.sum("weight").alias("weight"))
        .select(
            F.monotonically_increasing_id().alias("overlap_id"),
            "weight",
            F.lit(None).cast("struct<minus_n:bigint,id:bigint>").alias("kept_rank"),
            "undecided",
            F.array().cast("array<bigint>").alias("dropped"),
        )
    )


def _decide(overlaps: DataFrame, limit: float) -> DataFrame:
    members = overlaps.select(
        "weight", "kept_rank", F.posexplode("undecided").alias("place", "rank")
    )
    covered = F.coalesce(F.col("kept_rank") < F.col("rank"), F.lit(False))
    counts = members.groupBy("rank").agg(
        F.sum(F.when(covered, F.col("weight")).otherwise(0)).alias("sure"),
        F.sum(F.when(covered | (F.col("place") > 0), F.col("weight")).otherwise(0)).alias(
            "possible"
        ),
    )
    allowed = -F.col("rank.minus_n") * F.lit(limit)
    return counts.select(
        "rank",
        F.when(F.col("sure") > allowed, F.lit(False))
        .when(F.col("possible") <= allowed, F.lit(True))
        .alias("keep"),
    ).where(F.col("keep").isNotNull())


def _play_round(overlaps: DataFrame, limit: float) -> DataFrame:
    """Decide what can be decided and take it out of the undecided lists."""
    rank, keep = F.col("rank"), F.col("keep")
    return (
        overlaps.select(
            "overlap_id", "weight", "kept_rank", F.explode("undecided").alias("rank")
        )
        .join(_decide(overlaps, limit), "rank", "left")
        .groupBy("overlap_id", "weight")
        .agg(
            F.least(F.min("kept_rank"), F.min(F.when(keep, rank))).alias("kept_rank"),
            F.array_sort(F.collect_list(F.when(keep.isNull(), rank))).alias("undecided"),
            F.collect_list(F.when(~keep, rank["id"])).alias("dropped"),
        )
        .select("overlap_id", "weight", "kept_rank", "undecided", "dropped")
    )


def suppress_overlaps(
    incidents: DataFrame, membership: DataFrame, limit: float = OVERLAP_LIMIT
) -> DataFrame:
    """Incidents that survive suppression.

    ``incidents`` needs ``window_id, id, event_count``; ``membership`` needs
    ``window_id, event_id``.  Nothing is merged: a covered incident is dropped.
    """
    is_open = F.size("undecided") > 0
    still_open = F.count_if(is_open).alias("still_open")
    rounds: list[DataFrame] = []
    state, measured = stage_measured(
        _overlaps(incidents, membership), "overlaps", still_open
    )
    while measured.get("still_open"):
        state, measured = stage_measured(
            _play_round(state.where(is_open), limit), "overlaps", still_open
        )
        rounds.append(state)

    if not rounds:
        return incidents
    dropped = (
        reduce(DataFrame.unionByName, rounds)
        .select(F.explode("dropped").alias("id"))
        .distinct()
    )
    return incidents.join(dropped, "id", "left_anti")
