"""Tail a folder of logs into tables: events, rejects, errors and counts per file.

Scan and normalization are those of the batch ingest and run once per micro-batch; what
did not become an event is kept beside what did, with its reason.  Every table has a
``batch`` partition that a micro-batch writes whole, so a batch that is run again after a
failure replaces its own rows and adds none.

Events get ids that ascend in order of arrival.  A registry numbers each (file, split)
once, above those of all earlier batches, and a batch that is run again finds the same
numbers.  Incidents need the whole history of a key and are built from the event table by
``analyze_events``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberwatch.operators.normalize import split_normalized
from emberwatch.plans.ingest import (
    block_numbers,
    ingest_stats,
    rejected,
    with_event_ids,
)
from emberwatch.sources.lines import decoded_file_name
from emberwatch.sources.registry import get_source, source_names
from emberwatch.storage import stage

TABLES = ("events", "rejects", "errors", "stats")
_BLOCKS = "blocks"


@dataclass(frozen=True)
class Tail:
    """The tables of a folder that is tailed to ``path``."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        """One of ``TABLES``, of all batches so far."""
        if name not in TABLES:
            raise ValueError(f"no table {name!r}; there are {', '.join(TABLES)}")
        return self.spark.read.parquet(f"{self.path}/{name}").drop("batch")

    @property
    def events(self) -> DataFrame:
        return self.table("events")


def tail_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Streaming lines with the file and split they come from."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder).select(
        F.col("value").alias("line"),
        decoded_file_name().alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def _numbered_blocks(events: DataFrame, path: str, batch: int) -> DataFrame:
    """The numbers of the batch's blocks, kept in the registry."""
    registry, spark = f"{path}/{_BLOCKS}", events.sparkSession
    last = 0
    if batch:  # every earlier batch has written its part
        earlier = spark.read.parquet(registry).where(F.col("batch") < batch)
        last = earlier.agg(F.max("block_no")).first()[0] or 0
    found = block_numbers(events).withColumn("block_no", F.col("block_no") + last)
    found.write.mode("overwrite").parquet(f"{registry}/batch={batch}")
    return spark.read.schema(found.schema).parquet(f"{registry}/batch={batch}")


def batch_writer(source: str, path: str) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: writes the tables of one micro-batch of lines."""
    known = get_source(source)
    if known is None or known.parse is None:
        raise ValueError(f"no source of lines {source!r}; known: {source_names()}")

    def write(lines: DataFrame, batch: int) -> None:
        rows = lines.withColumn("row_id", F.monotonically_increasing_id())
        records = stage(known.normalize(known.parse(rows)), "tail")
        events, errors = split_normalized(records)
        tables = {
            "rejects": rejected(records),
            "errors": errors,
            "stats": ingest_stats(records),
            # Last, so that events are there only with what goes with them.
            "events": with_event_ids(events, _numbered_blocks(events, path, batch)),
        }
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")

    return write


def tail(
    spark: SparkSession,
    folder: str,
    source: str,
    path: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    **trigger,
) -> tuple[Tail, StreamingQuery]:
    """Start tailing ``folder`` into tables below ``path``; all files there by default."""
    query = (
        tail_lines(spark, folder, files_per_batch)
        .writeStream.foreachBatch(batch_writer(source, path))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    return Tail(spark, path), query
