"""Text lines with the position that reproduces input order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINEAGE_ORDER = ["file_name", "file_path", "block_start", "row_id"]


def decoded_file_name() -> Column:
    """Plain file name; the metadata column holds it percent-encoded."""
    return F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))


def with_lineage(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Add lineage.  (file, block, row) orders lines as they are in the files, also
    when a file is split over several tasks."""
    return df.select(
        *columns,
        decoded_file_name().alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
    )


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return with_lineage(spark.read.text(paths), F.col("value").alias("line"))


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\n\x0b\x0c"))
