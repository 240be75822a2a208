"""Sinks: normalized events, report tables, rejects and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.plans import report as r
from emberwatch.plans.ingest import Ingest
from emberwatch.operators.detect import Detection
from emberwatch.storage import owned, publish

_ISO = "yyyy-MM-dd'T'HH:mm:ss"


def to_contract(events: DataFrame) -> DataFrame:
    """The full normalized contract: 15 fields, ISO time in UTC."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("timestamp").cast("timestamp_ntz"))
    fraction = F.pmod(F.unix_micros("timestamp"), F.lit(1_000_000))
    iso = F.concat(
        F.date_format(utc, _ISO),
        F.when(fraction != 0, F.format_string(".%06d", fraction)).otherwise(""),
        F.lit("+00:00"),
    )
    return events.select(
        iso.alias("timestamp"),
        "source", "src_host", "src_ip", "dst_ip", "dst_host", "dst_port", "user",
        "process", "action", "result", "protocol", "severity", "extra", "raw_event",
    )


def write_events(events: DataFrame, path: str, fmt: str = "json") -> None:
    """Normalized events as JSON lines or parquet.

    In JSON every line has all fields of the contract; ``extra`` is an object of the
    members that are there, and ``raw_event`` is one too where the record was JSON.
    """
    contract = to_contract(events)
    writer = contract.write
    if fmt == "json":
        raw = F.col("raw_event")
        writer = contract.withColumns(
            {
                "extra": F.parse_json(F.to_json("extra")),
                "raw_event": F.coalesce(F.try_parse_json(raw), raw.cast("variant")),
            }
        ).write.option("ignoreNullFields", "false")
    writer.format(fmt).save(path)


def report_tables(
    detection: Detection, events: DataFrame, detail: bool = False, verbose: bool = False
) -> dict[str, DataFrame]:
    """The tables of a depth: summary, plus detail, plus event lists."""
    incidents = detection.incidents
    tables = {
        "source_totals": r.source_totals(events),
        "severity_histogram": r.severity_histogram(events),
        "time_range": r.time_range(events),
        "verdict_counts": r.verdict_counts(incidents),
        "incident_summary": r.incident_summary(detection),
    }
    if detail or verbose:
        tables |= {
            "incident_timeline": r.incident_timeline(detection),
            "incident_metrics": r.incident_metrics(detection),
            "incident_values": incidents.select("window_id", "id")
            .join(r.incident_value_list(detection.facts), "window_id")
            .drop("window_id"),
            "sample_raw_events": r.sample_raw_events(detection, events),
            "incident_reasons": r.incident_reasons(incidents),
            "recommendations": r.recommendations(detection),
            "document_overview": r.document_overview(detection),
        }
    if verbose:
        tables["incident_event_list"] = r.incident_event_list(detection)
        tables["document_events"] = r.document_events(detection)
    return tables


def write_report(
    detection: Detection,
    events: DataFrame,
    path: str,
    detail: bool = False,
    verbose: bool = False,
    fmt: str = "parquet",
) -> list[str]:
    """Write each table below ``path``; the event lists are sorted by incident and
    time across files.  Tables appear when all are complete; what is staged for them
    is released."""
    with owned(events.sparkSession, release=True):
        tables = report_tables(detection, events, detail, verbose)
        if "incident_event_list" in tables:
            order = ["id", "us", "event_id"]
            listed = tables["incident_event_list"]
            tables["incident_event_list"] = listed.repartitionByRange(*order).sortWithinPartitions(*order)
        return publish(tables, path, fmt)


def write_problems(ingested: Ingest, path: str, fmt: str = "parquet") -> list[str]:
    """Corrupt records and normalization errors."""
    return publish({"rejects": ingested.rejects, "errors": ingested.errors}, path, fmt)
