"""Files to events: scan, account, normalize, number."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.operators.normalize import split_normalized
from emberwatch.operators.ordering import number_rows
from emberwatch.schema import EVENT_FIELDS, LINEAGE
from emberwatch.sources.csv_export import csv_columns, read_csv_export
from emberwatch.sources.directory import list_files, route_files
from emberwatch.sources.registry import get_source, source_names
from emberwatch.storage import stage


@dataclass(frozen=True)
class Scan:
    """One read of one or more files of a kind."""

    kind: str
    records: DataFrame
    paths: tuple[str, ...]

    def normalized(self) -> DataFrame:
        """Every record with its event columns, ``reject_reason`` and
        ``normalize_error``."""
        return get_source(self.kind).normalize(self.records)


def is_corrupt() -> Column:
    """Rejected records; blank lines are no records."""
    return F.col("reject_reason").isNotNull() & (F.col("reject_reason") != "blank")


def ingest_stats(records: DataFrame) -> DataFrame:
    """Parsed, skipped and total records per source and file."""
    return records.groupBy("source", "file_name").agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(F.col("reject_reason").isNull()).alias("parsed"),
        F.count_if(is_corrupt()).alias("skipped"),
    )


def rejects_by_reason(records: DataFrame) -> DataFrame:
    return records.where(is_corrupt()).groupBy("source", "reject_reason").agg(
        F.count(F.lit(1)).alias("n")
    )


def error_report(errors: DataFrame, shown: int = 5) -> DataFrame:
    """The first ``shown`` normalization errors of each source, and how many more."""
    order = Window.partitionBy("source").orderBy(
        "file_name", "file_path", "block_start", "row_id"
    )
    first = (
        errors.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= shown)
        .select("source", "place", "error")
    )
    totals = errors.groupBy("source").agg(F.count(F.lit(1)).alias("n_errors"))
    return first.join(totals, "source").select(
        "source", "place", "error", "n_errors",
        F.greatest(F.col("n_errors") - shown, F.lit(0)).alias("omitted"),
    )


def scan_file(
    spark: SparkSession,
    kind: str,
    path: str | Sequence[str],
    mappings: Mapping | None = None,
) -> Scan:
    """Scan a named source; a CSV file takes the given kind as authoritative."""
    paths = (path,) if isinstance(path, str) else tuple(path)
    if all(p.lower().endswith(".csv") for p in paths):
        kind, records = read_csv_export(spark, list(paths), kind, True, mappings)
        if get_source(kind) is None:
            raise ValueError(f"no normalizer for {kind!r}; known: {source_names()}")
        return Scan(kind, records, paths)
    source = get_source(kind)
    if source is None:
        raise ValueError(f"no source {kind!r}; known: {source_names()}")
    return Scan(kind, source.read(spark, list(paths)), paths)


@dataclass(frozen=True)
class DirectoryScan:
    scans: list[Scan]
    unrouted: list[str] = field(default_factory=list)
    unsupported: list[tuple[str, str]] = field(default_factory=list)


def read_directory(
    spark: SparkSession, directory: str, mappings: Mapping | None = None
) -> DirectoryScan:
    """Scan every recognised file directly in a directory.

    Native files of a kind are one scan.  CSV exports are grouped by header, and the
    header decides their kind.
    """
    native: dict[str, list[str]] = {}
    exports: dict[tuple[str, ...], list[str]] = {}
    unrouted: list[str] = []
    unsupported: list[tuple[str, str]] = []
    for kind, path in route_files(spark, list_files(spark, directory)):
        if not kind:
            unrouted.append(path)
        elif path.lower().endswith(".csv"):
            exports.setdefault(tuple(csv_columns(spark, path)), []).append(path)
        elif get_source(kind) is None:
            unsupported.append((kind, path))
        else:
            native.setdefault(kind, []).append(path)

    scans = [scan_file(spark, kind, paths) for kind, paths in native.items()]
    for columns, paths in exports.items():
        kind, records = read_csv_export(
            spark, paths, mappings=mappings, columns=list(columns)
        )
        if get_source(kind) is None:
            unsupported.extend((kind, path) for path in paths)
        else:
            scans.append(Scan(kind, records, tuple(paths)))
    return DirectoryScan(scans, unrouted, unsupported)


@dataclass(frozen=True)
class Ingest:
    """``events`` are staged and numbered; ``errors`` and ``rejects`` what did not
    become one; ``stats`` counts per file."""

    events: DataFrame
    errors: DataFrame
    rejects: DataFrame
    stats: DataFrame


_BLOCK = ["file_name", "file_path", "block_start"]
_ROW_BITS = 33


def block_numbers(events: DataFrame) -> DataFrame:
    """The input splits of ``events``, numbered in order of file and place.

    There is one row per split, no more than the scan had tasks.
    """
    order = [F.col(name) for name in _BLOCK]
    return stage(
        number_rows(events.select(*_BLOCK).distinct(), order, "block_no", "block_order"), "blocks"
    )


def with_event_ids(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add ``event_id`` from the numbers of the blocks.

    A block's rows were read in order by one task, so the block's place among all
    blocks and the row's place in its task make the id.
    """
    row_in_task = F.col("row_id").bitwiseAND((1 << _ROW_BITS) - 1)
    return events.join(blocks, _BLOCK).select(
        (F.shiftleft("block_no", _ROW_BITS) + row_in_task).alias("event_id"),
        *LINEAGE,
        *EVENT_FIELDS,
    )


def number_events(events: DataFrame) -> DataFrame:
    """Add ``event_id``: unique, ascending in input order (file, block, line)."""
    return with_event_ids(events, block_numbers(events))


def rejected(records: DataFrame) -> DataFrame:
    """The corrupt records with their reasons."""
    return records.where(is_corrupt()).select(
        *LINEAGE, "source", F.col("raw_event").alias("line"), "reject_reason"
    )


def ingest(scans: Sequence[Scan]) -> Ingest:
    """Normalize all scans into one staged table, reading every file once.

    Rejects, errors and counts come from that table too.
    """
    if not scans:
        raise ValueError("no log file was found")
    records = stage(
        reduce(DataFrame.unionByName, [scan.normalized() for scan in scans]), "normalized"
    )
    events, errors = split_normalized(records)
    return Ingest(number_events(events), errors, rejected(records), ingest_stats(records))
