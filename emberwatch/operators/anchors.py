"""First-event anchored windows.

A window opens at the first event of a key and takes every later event within
the window length of that first event; the next event opens the next window.
Neither ``window`` (clock aligned) nor ``session_window`` (gap based) says that.

The work is arranged by time cell (see ``fan_out``):

1. events pre-aggregate to one row per (rule, key, cell) before any shuffle;
2. cells join into sessions wherever the silence between two cells is not longer
   than the window - a longer silence always opens a new window;
3. a session no longer than the window *is* one window and needs nothing more;
4. a longer session's window starts are the chain of links between its timestamps; a
   session of any size is followed in bounded pieces (``session_chains``);
5. each cell then knows the window that starts in it and the one that was open
   before it, so events find their window with one equi-join on the cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.operators.rules import DEFAULT_RULES, Rule, fan_out, per_rule
from emberwatch.operators.session_chains import STRIP_POINTS, session_starts
from emberwatch.storage import stage, stage_measured

_IS_LONG = "session_last_us - session_first_us > window_us"


def session_cells(keyed: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, int]:
    """Stage one row per (rule, key, cell) with its session.

    ``cell_id`` names the cell; a window is later named by the cell it starts in.
    Also returns the event count of the largest session longer than its window.
    """
    cells = keyed.groupBy("rule_idx", "key", "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
    )
    by_key = Window.partitionBy("rule_idx", "key").orderBy("bucket")
    whole_key = Window.partitionBy("rule_idx", "key")
    by_session = Window.partitionBy("rule_idx", "key", "session")
    silence = F.col("first_us") - F.lag("last_us").over(by_key)
    sessions = (
        cells.withColumn("window_us", per_rule(rules, "window_us").cast("bigint"))
        .withColumn(
            "opens",
            F.when(silence <= F.col("window_us"), F.lit(0)).otherwise(F.lit(1)),
        )
        .withColumn("session", F.sum("opens").over(by_key))
        .withColumn("cell_id", F.monotonically_increasing_id())
        .withColumn("session_id", F.min("cell_id").over(by_session))
        .withColumn("session_first_us", F.min("first_us").over(by_session))
        .withColumn("session_last_us", F.max("last_us").over(by_session))
        .withColumn("session_n", F.sum("n").over(by_session))
        .withColumn("key_first_us", F.min("first_us").over(whole_key))
        .withColumn("key_largest_session", F.max("session_n").over(whole_key))
    )
    minimum = per_rule(rules, "min_events")
    # A session below the threshold cannot hold a qualifying window.  The first
    # session of a useful key stays: its first event fixes the incident numbering.
    needed = (F.col("key_largest_session") >= minimum) & (
        (F.col("session_n") >= minimum) | (F.col("session") == 1)
    )
    cells, measured = stage_measured(
        sessions.where(needed).select(
            "rule_idx", "key", "bucket", "cell_id", "window_us", "session_id",
            "session_first_us", "session_last_us", "session_n", "key_first_us",
        ),
        "cells",
        F.max(F.when(F.expr(_IS_LONG), F.col("session_n"))).alias("largest_long"),
    )
    return cells, measured.get("largest_long") or 0


def _session_points(keyed: DataFrame, long_cells: DataFrame) -> DataFrame:
    """Timestamps of long sessions: all that decides where windows open."""
    return (
        keyed.select("rule_idx", "key", "bucket", "us")
        .join(
            long_cells.select("rule_idx", "key", "bucket", "session_id", "session_n", "window_us"),
            ["rule_idx", "key", "bucket"],
        )
        .select("session_id", "window_us", "us", "session_n")
    )


def anchored_windows(
    events: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    strip_points: int = STRIP_POINTS,
) -> tuple[DataFrame, DataFrame]:
    """Assign every keyed event to its window.

    Returns ``(assignments, cells)``: assignments hold ``window_id, anchor_us,
    event_id, us`` and are staged; a ``window_id`` is the ``cell_id`` of the cell
    its window starts in.
    """
    keyed = fan_out(events, rules)
    cells, largest_long = session_cells(keyed, rules)

    columns = ["rule_idx", "key", "bucket"]
    starts = cells.where(f"NOT ({_IS_LONG})").select(
        *columns,
        F.col("session_first_us").alias("anchor_us"),
        F.col("session_id").alias("window_id"),
        F.lit(None).cast("bigint").alias("open_anchor_us"),
        F.lit(None).cast("bigint").alias("open_window_id"),
    )

    if largest_long:
        long_cells = cells.where(_IS_LONG)
        anchors = session_starts(_session_points(keyed, long_cells), largest_long, strip_points).select(
            "session_id",
            F.expr("(anchor_us - pmod(anchor_us, window_us + 1)) div (window_us + 1)").alias("bucket"),
            "anchor_us",
        )
        opened = stage(
            long_cells.join(anchors, ["session_id", "bucket"]).select(
                "session_id", "bucket", "anchor_us", F.col("cell_id").alias("window_id")
            ),
            "window_starts",
        )
        # A window reaches into the next cell at most.
        before = opened.select(
            "session_id",
            (F.col("bucket") + 1).alias("bucket"),
            F.col("anchor_us").alias("open_anchor_us"),
            F.col("window_id").alias("open_window_id"),
        )
        opening = long_cells.join(opened, ["session_id", "bucket"], "left").join(
            before, ["session_id", "bucket"], "left"
        )
        starts = starts.unionByName(opening.select(*starts.columns))

    in_new = F.col("us") >= F.col("anchor_us")
    assignments = keyed.join(starts, columns).select(
        F.when(in_new, F.col("window_id"))
        .otherwise(F.col("open_window_id"))
        .alias("window_id"),
        F.when(in_new, F.col("anchor_us"))
        .otherwise(F.col("open_anchor_us"))
        .alias("anchor_us"),
        "event_id",
        "us",
    )
    return stage(assignments, "assignments"), cells
