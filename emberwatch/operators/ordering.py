"""Global ordering without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.storage import stage

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def stage_in_order(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """Stage ``df`` with ``position``: unique, ascending in ``order``, with gaps.

    ``order`` must be a total order.  The sort is range partitioned, so no task
    sees more than its slice.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ordered.withColumn("position", F.monotonically_increasing_id()), label)


def number_rows(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """Stage ``df`` with ``name`` = 1, 2, 3, ... in ``order``."""
    staged = stage_in_order(df, order, label)
    slice_no = F.shiftright("position", _ROW_BITS)
    # One row per sort partition: small by construction.
    offsets = (
        staged.groupBy(slice_no.alias("slice_no"))
        .count()
        .select(
            "slice_no",
            (
                F.sum("count").over(Window.orderBy("slice_no")) - F.col("count")
            ).alias("rows_before"),
        )
    )
    in_slice = F.col("position") - F.shiftleft(F.col("slice_no"), _ROW_BITS)
    return (
        staged.withColumn("slice_no", slice_no)
        .join(F.broadcast(offsets), "slice_no")
        .withColumn(name, in_slice + F.col("rows_before") + 1)
        .drop("slice_no", "rows_before", "position")
    )
