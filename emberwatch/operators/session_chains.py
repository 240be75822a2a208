"""Window starts of sessions of any size.

A session's timestamps are points; the window that starts at one point is followed by the
one that starts at the first point later than the window's end.  The starts are the chain
of these links from the session's first point.  Links and chains of all sessions in a
batch are followed together in numpy; a session reaches a task whole if it has at most
``strip_points`` points.

A larger session is laid out as a grid: one row per time cell (one microsecond longer than
the window), one column per offset inside the cell.  After a start at offset x of a row
comes the first point of the *next* row at offset >= x; when that row has none, the first
point of the row after it.  So starts drift to the right from row to row and fall back to
the left edge only after a row without a start.

In the order of (offset, time) such a session is cut into strips of ``strip_points`` points
each, by position in one range-partitioned sort.  A strip is entered at the first of its
points in some row and left for a later row, whatever happened elsewhere, so strips are
summarised independently (row in -> row out).  Every summary leads to exactly one other:
the next strip with points in the row that it was left for, else the first strip of the
row after that.  Which summaries the session's chain passes is found by doubling: those
2^n steps ahead of the ones found so far, joined on (session, strip, row), for n = 0, 1,
2, ... until nothing is added.  The strips that were passed then name their starts.

So no task holds a session; the largest group is a strip, and the joined rows are at most
one per strip and cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.operators.ordering import number_rows
from emberwatch.storage import stage, stage_measured

STRIP_POINTS = 500_000
_START_SCHEMA = "session_id bigint, window_us bigint, anchor_us bigint"
_NODE = ["session_id", "strip", "row"]


# --- points in a task -------------------------------------------------------------------


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted rows, cut so that rows with the same first ``keys`` columns stay together."""
    held: list[pa.RecordBatch] = []

    def columns(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(parts)
        return {name: table.column(name).to_numpy() for name in table.column_names}

    def key(batch: pa.RecordBatch, at: int) -> tuple:
        return tuple(batch.column(i)[at].as_py() for i in range(keys))

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield columns(held)
            held = []
        turns = np.zeros(batch.num_rows - 1, dtype=bool)
        for i in range(keys):
            turns |= np.diff(batch.column(i).to_numpy()) != 0
        cut = int(np.flatnonzero(turns)[-1]) + 1 if turns.any() else 0
        if cut:
            yield columns([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield columns(held)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    turns = np.ones(len(columns[0]), dtype=bool)
    turns[1:] = np.any([np.diff(c) != 0 for c in columns], axis=0)
    return np.flatnonzero(turns)


def links(first: np.ndarray, us: np.ndarray, width: np.ndarray) -> np.ndarray:
    """For each point the first one of its group at least ``width`` later, or -1.

    Groups begin at ``first``; points are in ascending order within each.
    """
    last = np.r_[first[1:], len(us)] - 1
    spans = us[last] - us[first] + width[first] + 1
    if spans.astype(np.float64).sum() > 2.0**62:  # too long for one line of time
        found = np.full(len(us), -1)
        for a, b in zip(first, last + 1, strict=True):
            at = np.searchsorted(us[a:b], us[a:b] + width[a:b])
            found[a:b] = np.where(at < b - a, at + a, -1)
        return found
    # All groups on one line of time, further apart than any link reaches.
    begin = np.r_[0, np.cumsum(spans)[:-1]]
    group = np.zeros(len(us), dtype=np.int64)
    group[first[1:]] = 1
    group = np.cumsum(group)
    line = begin[group] + us - us[first][group]
    found = np.searchsorted(line, line + width)
    inside = found <= last[group]
    return np.where(inside, found, -1)


def chains(starts: np.ndarray, following: np.ndarray) -> np.ndarray:
    """All points on the chains from ``starts``, ascending."""
    found, at = [starts], starts
    while len(at):
        at = following[at]
        at = at[at >= 0]
        found.append(at)
    return np.sort(np.concatenate(found))


def _found(points: dict[str, np.ndarray], at: np.ndarray) -> pa.RecordBatch:
    names = ["session_id", "window_us", "us"]
    return pa.RecordBatch.from_arrays([pa.array(points[n][at]) for n in names], [*names[:2], "anchor_us"])


def _session_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for points in _whole_groups(batches, 1):
        first = _firsts(points["session_id"])
        yield _found(points, chains(first, links(first, points["us"], points["window_us"] + 1)))


def _strip_links(points: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the strip, which lead to the next row, and the first points of all rows."""
    us, row = points["us"], points["row"]
    following = links(_firsts(points["session_id"], points["strip"]), us, points["window_us"] + 1)
    following[(following >= 0) & (row[following] != row + 1)] = -1
    return following, _firsts(points["session_id"], points["strip"], row)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for points in _whole_groups(batches, 2):
        following, entry = _strip_links(points)
        end = np.where(following >= 0, following, np.arange(len(following)))
        while (end != end[end]).any():
            end = end[end]
        columns = [points["session_id"][entry], points["strip"][entry], points["row"][entry], points["row"][end[entry]] + 1]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*_NODE, "row_out"])


def _strip_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for points in _whole_groups(batches, 2):
        following, entry = _strip_links(points)
        yield _found(points, chains(entry[points["passed"][entry] > 0], following))


# --- sessions in strips -----------------------------------------------------------------


def _strips(points: DataFrame, strip_points: int) -> DataFrame:
    """Points with their row and strip; a strip has ``strip_points`` points."""
    cell = F.col("window_us") + 1
    offset = F.pmod("us", cell)
    placed = points.select("session_id", "window_us", "us").distinct().withColumn("offset", offset)
    order = [F.col("session_id").asc(), F.col("offset").asc(), F.col("us").asc()]
    numbered = number_rows(placed, order, "number", "session_points")
    begins = numbered.groupBy("session_id").agg(F.min("number").alias("begin"))
    strip = F.expr(f"(number - begin) div {strip_points}")
    row = F.expr("(us - offset) div (window_us + 1)")
    return stage(
        numbered.join(begins, "session_id").select(
            "session_id", strip.alias("strip"), row.alias("row"), "us", "window_us"
        ),
        "session_strips",
    )


def _passed(summaries: DataFrame) -> DataFrame:
    """The summaries (session, strip, row) on the chain of their session."""
    # A strip's number as seen from the row that a summary was left for.
    there = summaries.select("session_id", F.col("row").alias("row_out"), F.col("strip").alias("found"), "strip")
    left = summaries.select("session_id", "row_out", F.lit(None).cast("bigint").alias("found"), "strip", "row")
    # Among equal strips the summary comes first, so it sees the strips to its right only.
    to_the_left = Window.partitionBy("session_id", "row_out").orderBy(
        F.col("strip").desc(), F.col("found").asc_nulls_first()
    )
    right = F.min("found").over(to_the_left.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = summaries.groupBy("session_id", (F.col("row") - 1).alias("row_out")).agg(F.min("strip").alias("after"))
    found = (
        left.unionByName(there.withColumn("row", F.lit(None).cast("bigint")))
        .withColumn("right", right)
        .where(F.col("row").isNotNull())
        .join(after, ["session_id", "row_out"], "left")
    )
    jump = stage(
        found.select(
            *_NODE,
            F.coalesce("right", "after").alias("to_strip"),
            F.when(F.col("right").isNotNull(), F.col("row_out")).otherwise(F.col("row_out") + 1).alias("to_row"),
        ).where(F.col("to_strip").isNotNull()),
        "session_jumps",
    )
    first = summaries.groupBy("session_id").agg(F.min(F.struct("row", "strip")).alias("first"))
    passed, count = stage(first.select("session_id", "first.strip", "first.row"), "session_passed"), 0
    while True:
        ahead = passed.join(jump, _NODE).select(
            "session_id", F.col("to_strip").alias("strip"), F.col("to_row").alias("row")
        )
        passed, measured = stage_measured(
            passed.unionByName(ahead), "session_passed", F.count(F.lit(1)).alias("found")
        )
        if measured["found"] == count:
            return passed
        count = measured["found"]
        further = jump.select(
            "session_id", F.col("strip").alias("to_strip"), F.col("row").alias("to_row"),
            F.col("to_strip").alias("then_strip"), F.col("to_row").alias("then_row"),
        )
        jump = stage(
            jump.join(further, ["session_id", "to_strip", "to_row"]).select(
                *_NODE, F.col("then_strip").alias("to_strip"), F.col("then_row").alias("to_row")
            ),
            "session_jumps",
        )


def session_starts(points: DataFrame, largest: int, strip_points: int = STRIP_POINTS) -> DataFrame:
    """Window starts (``session_id, window_us, anchor_us``) of ``points``.

    ``points`` hold ``session_id, window_us, us`` and ``session_n``, the size of the session;
    ``largest`` is the largest of these.
    """
    columns = ["session_id", "window_us", "us"]
    whole = points.where(F.col("session_n") <= strip_points).select(*columns)
    starts = (
        whole.repartition("session_id").sortWithinPartitions("session_id", "us")
        .mapInArrow(_session_starts, _START_SCHEMA)
    )
    if largest <= strip_points:
        return starts
    strips = _strips(points.where(F.col("session_n") > strip_points), strip_points)
    in_order = ["session_id", "strip", "us"]
    summaries = stage(
        strips.repartition("session_id", "strip").sortWithinPartitions(*in_order)
        .mapInArrow(_summaries, "session_id bigint, strip bigint, row bigint, row_out bigint"),
        "session_summaries",
    )
    marked = strips.join(_passed(summaries).withColumn("passed", F.lit(1)), _NODE, "left")
    split = (
        marked.select("session_id", "strip", "row", "us", "window_us", F.coalesce("passed", F.lit(0)).alias("passed"))
        .repartition("session_id", "strip").sortWithinPartitions(*in_order)
        .mapInArrow(_strip_starts, _START_SCHEMA)
    )
    return starts.unionByName(split)
