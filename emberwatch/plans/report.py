"""Report tables at the three depths: summary, incident detail, event list.

Everything is a table.  Lists that can be long are rows (``incident_value_list``);
a cell holds a list only where the report shows the first few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.fixed_values import VERDICTS
from emberwatch.functions.text import duration_text, first_truthy, truthy
from emberwatch.functions.verdicts import severity_label
from emberwatch.operators.detect import Detection, incident_values
from emberwatch.operators.ordering import number_rows
from emberwatch.plans.ingest import Ingest
from emberwatch.storage import stage

SECOND_US = 1_000_000
DASH = "—"


# --- whole input ----------------------------------------------------------------------


def source_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("source").agg(F.count(F.lit(1)).alias("n_events"))


def severity_histogram(events: DataFrame) -> DataFrame:
    """Four rows, also for levels without events."""
    counts = events.agg(
        *[F.count_if(F.col("severity") == level).alias(f"s{level}") for level in (1, 2, 3, 4)]
    )
    levels = [
        F.struct(F.lit(level).alias("severity"), F.col(f"s{level}").alias("n_events"))
        for level in (1, 2, 3, 4)
    ]
    return counts.select(F.inline(F.array(*levels)))


def time_range(events: DataFrame) -> DataFrame:
    return events.agg(
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
        F.count(F.lit(1)).alias("n_events"),
    )


def verdict_counts(incidents: DataFrame) -> DataFrame:
    """One row per verdict, also for verdicts without incidents."""
    counts = incidents.agg(
        *[F.count_if(F.col("verdict") == name).alias(name) for name in VERDICTS]
    )
    rows = [
        F.struct(F.lit(name).alias("verdict"), F.col(name).alias("n_incidents"))
        for name in VERDICTS
    ]
    return counts.select(F.inline(F.array(*rows)))


def pipeline_stats(ingested: Ingest, detection: Detection) -> DataFrame:
    """Raw, normalized, skipped, incidents and grouped events in one row."""
    files = ingested.stats.agg(
        F.coalesce(F.sum("parsed"), F.lit(0)).alias("raw_events"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped_records"),
    )
    errors = ingested.errors.agg(F.count(F.lit(1)).alias("normalize_errors"))
    incidents = detection.incidents.agg(
        F.count(F.lit(1)).alias("incidents"),
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("events_grouped"),
    )
    # Single-row totals side by side.
    joined = files.join(errors).join(incidents)
    return joined.select(
        "raw_events",
        (F.col("raw_events") - F.col("normalize_errors")).alias("normalized_events"),
        (F.col("skipped_records") + F.col("normalize_errors")).alias("skipped"),
        "incidents",
        "events_grouped",
    )


# --- value lists ------------------------------------------------------------------------


def _value_order() -> list[Column]:
    """Ports by number, everything else as text."""
    number = F.when(F.col("kind") == "port", F.col("value").cast("int"))
    return [number.asc_nulls_first(), F.col("value").asc()]


def incident_value_list(facts: DataFrame) -> DataFrame:
    """All addresses, users, ports, hosts, processes and sources of every incident as
    rows, without a position, so that no incident is sorted as a whole."""
    return incident_values(facts)


def leading_values(
    values: DataFrame, kind: str, k: int, name: str, separator: str = ", "
) -> DataFrame:
    """The first ``k`` sorted values of a kind as one text per incident.

    The rank filter keeps ``k`` rows per incident in every task before the shuffle.
    """
    order = Window.partitionBy("window_id").orderBy(*_value_order())
    first = (
        values.where(F.col("kind") == kind)
        .select("window_id", "kind", "value")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= k)
    )
    listed = F.array_sort(F.collect_list(F.struct("place", "value")))
    return first.groupBy("window_id").agg(
        F.array_join(F.transform(listed, lambda x: x["value"]), separator).alias(name)
    )


def _with_leading(
    incidents: DataFrame, values: DataFrame, wanted: dict[str, tuple[str, int]]
) -> DataFrame:
    for name, (kind, k) in wanted.items():
        incidents = incidents.join(leading_values(values, kind, k, name), "window_id", "left")
    return incidents


# --- incident tables ------------------------------------------------------------------------


def _seconds() -> Column:
    return F.floor((F.col("end_us") - F.col("start_us")) / SECOND_US)


def advice(verdict: Column) -> Column:
    return (
        F.when(verdict == "CONFIRMED", "ACTION: investigate now, the attack pattern is confirmed")
        .when(verdict == "LIKELY_TRUE", "needs analysis: strong signs with some noise")
        .when(verdict.contains("FP"), "likely a false positive, verify by hand")
    )


def incident_summary(detection: Detection) -> DataFrame:
    """One line per incident, by rank."""
    values = incident_values(detection.facts, ["ip", "host"])
    rows = _with_leading(
        detection.incidents, values, {"first_ips": ("ip", 3), "first_hosts": ("host", 2)}
    )
    return rows.select(
        "rank",
        "id",
        "pattern",
        "verdict",
        severity_label(F.col("max_severity")).alias("severity"),
        "confidence",
        "event_count",
        duration_text(_seconds()).alias("duration"),
        F.coalesce("first_ips", F.lit(DASH)).alias("first_ips"),
        F.coalesce("first_hosts", F.lit(DASH)).alias("first_hosts"),
        advice(F.col("verdict")).alias("advice"),
    )


def select_incident(incidents: DataFrame, incident_id: int) -> DataFrame:
    """One incident by id; an error when there is none."""
    chosen = incidents.where(F.col("id") == incident_id)
    if chosen.isEmpty():
        raise ValueError(f"incident {incident_id} does not exist")
    return chosen


def _event_line() -> list[Column]:
    port = F.when(F.col("dst_port") != 0, F.col("dst_port").cast("string"))
    unknown = F.lit("?")
    return [
        F.coalesce(truthy(F.col("action")), F.lit("unknown")).alias("action"),
        F.coalesce(truthy(F.col("user")), unknown).alias("user"),
        F.coalesce(
            F.concat(truthy(F.col("src_ip")), F.lit(":"), port),
            truthy(F.col("src_ip")),
            unknown,
        ).alias("origin"),
        F.coalesce(first_truthy(F.col("dst_host"), F.col("dst_ip")), unknown).alias("target"),
    ]


def incident_timeline(detection: Detection, k: int = 5) -> DataFrame:
    """The earliest ``k`` events of each incident and how many follow."""
    order = Window.partitionBy("window_id").orderBy("us", "event_id")
    place = F.row_number().over(order)
    moment = F.struct("us", "event_id")
    # Times and ids decide which events are listed; only those are read with their columns.
    ends = (
        detection.facts.select("window_id", "us", "event_id")
        .withColumn("place", place)
        .where(F.col("place") <= k)
        .groupBy("window_id")
        .agg(F.max(moment).alias("end"))
    )
    first = (
        detection.facts.select(
            "window_id", "event_id", "us", "action", "user", "src_ip", "dst_port",
            "dst_host", "dst_ip",
        )
        .join(stage(ends, "timeline_ends"), "window_id")
        .where(moment <= F.col("end"))
        .drop("end")
        .withColumn("place", place)
        .where(F.col("place") <= k)
    )
    incidents = detection.incidents.select("window_id", "id", "event_count")
    return first.join(incidents, "window_id").select(
        "id",
        "place",
        "event_id",
        F.timestamp_micros("us").alias("time"),
        *_event_line(),
        F.greatest(F.col("event_count") - k, F.lit(0)).alias("more_events"),
    )


def incident_metrics(detection: Detection) -> DataFrame:
    """Counts and short lists per incident; ``incident_value_list`` has all values."""
    values = incident_values(detection.facts)
    kind = F.col("kind")
    counts = values.groupBy("window_id").agg(
        F.count_if(kind == "port").alias("n_target_ports"),
        F.count_if(kind == "process").alias("n_processes"),
    )
    rows = _with_leading(
        detection.incidents.join(counts, "window_id", "left"),
        values,
        {"first_ports": ("port", 10), "first_processes": ("process", 3)},
    )
    return rows.select(
        "id",
        "event_count",
        _seconds().alias("duration_seconds"),
        F.array_join("sources", ", ").alias("sources"),
        "n_ips",
        "n_users",
        "n_hosts",
        F.coalesce("n_target_ports", F.lit(0)).alias("n_target_ports"),
        "first_ports",
        F.greatest(F.coalesce("n_target_ports", F.lit(0)) - 10, F.lit(0)).alias("more_ports"),
        F.coalesce("n_processes", F.lit(0)).alias("n_processes"),
        "first_processes",
    )


def sample_raw_events(detection: Detection, events: DataFrame) -> DataFrame:
    """The raw record of each incident's first event."""
    first = detection.incidents.select("id", F.col("first_event_id").alias("event_id"))
    return first.join(events.select("event_id", "raw_event"), "event_id")


def incident_reasons(incidents: DataFrame) -> DataFrame:
    """The scoring lines, one row each."""
    return incidents.select(
        "id", F.posexplode("reasoning").alias("place", "line")
    ).select("id", (F.col("place") + 1).alias("place"), "line.code", "line.delta", "line.detail")


_STEPS = {
    "BRUTE_FORCE": [
        "reset the passwords of the affected users",
        "check the Windows event log (event id 4625) for confirmation",
    ],
    "SUSPICIOUS_PROC": [
        "check whether the process is legitimate (change request)",
        "take a sample and its hash for analysis",
        "isolate the host when there is no justification",
    ],
}


def recommendations(detection: Detection) -> DataFrame:
    """What to do, by verdict and pattern, with the addresses to block."""
    outside = incident_values(detection.facts, ["ip"]).where(~F.col("value").startswith("10."))
    rows = _with_leading(detection.incidents, outside, {"block_ips": ("ip", 3)})
    confirmed = F.col("verdict") == "CONFIRMED"
    brute = confirmed & (F.col("pattern") == "BRUTE_FORCE")
    block = F.when(brute, F.concat(F.lit("block addresses: "), F.col("block_ips")))
    steps = F.lit(None).cast("array<string>")
    for name, texts in _STEPS.items():
        listed = F.array(*[F.lit(text) for text in texts])
        steps = F.when(confirmed & (F.col("pattern") == name), listed).otherwise(steps)
    headline = (
        F.when(confirmed, F.concat(F.lit("confirmed incident, pattern "), "pattern"))
        .when(
            F.col("verdict") == "FALSE_POSITIVE",
            "very likely a false positive, no action; review the trust list regularly",
        )
        .otherwise(F.concat("verdict", F.lit(": needs manual analysis")))
    )
    none = F.array().cast("array<string>")
    return rows.select(
        "id",
        "verdict",
        "pattern",
        headline.alias("headline"),
        F.array_join(
            F.array_compact(F.concat(F.array(block), F.coalesce(steps, none))), "; "
        ).alias("steps"),
    )


def incident_event_list(detection: Detection) -> DataFrame:
    """Every event of every incident with its number in the incident, by time.

    One range-partitioned sort numbers all events; the number in an incident is the
    distance from the incident's first one, so no task holds an incident.
    """
    incidents = detection.incidents.select("window_id", "id")
    dash, unknown = F.lit("-"), F.lit("?")
    port = F.when(F.col("dst_port") != 0, F.col("dst_port").cast("string"))
    listed = detection.facts.join(incidents, "window_id").select(
        "id",
        "event_id",
        "us",
        F.timestamp_micros("us").alias("time"),
        "severity",
        F.coalesce(truthy(F.col("action")), unknown).alias("action"),
        F.coalesce(truthy(F.col("user")), unknown).alias("user"),
        F.coalesce(truthy(F.col("src_ip")), unknown).alias("origin"),
        F.coalesce(first_truthy(F.col("dst_host"), F.col("dst_ip")), unknown).alias("target"),
        F.coalesce(port, dash).alias("port"),
        "source",
        F.coalesce(truthy(F.col("result")), dash).alias("result"),
    )
    order = [F.col("id").asc(), F.col("us").asc(), F.col("event_id").asc()]
    numbered = number_rows(listed, order, "overall", "event_list")
    first = numbered.groupBy("id").agg(F.min("overall").alias("first"))
    return (
        numbered.join(first, "id")
        .withColumn("number", F.col("overall") - F.col("first") + 1)
        .select("id", "number", *listed.columns[1:])
    )


def document_overview(detection: Detection) -> DataFrame:
    """The five-row metric table of each incident, as columns."""
    values = incident_values(detection.facts, ["ip", "user"])
    rows = _with_leading(
        detection.incidents, values, {"source_ips": ("ip", 5), "users": ("user", 5)}
    )
    return rows.select(
        "id",
        "verdict",
        "confidence",
        F.col("event_count").alias("events"),
        F.coalesce("source_ips", F.lit(DASH)).alias("source_ips"),
        F.coalesce("users", F.lit(DASH)).alias("users"),
        F.coalesce(truthy(F.array_join("sources", ", ")), F.lit(DASH)).alias("sources"),
        "pattern",
    )


def document_events(detection: Detection, k: int = 50) -> DataFrame:
    """The first ``k`` events of each incident for the document form."""
    return incident_timeline(detection, k)


def document_totals(events: DataFrame, incidents: DataFrame) -> DataFrame:
    """Event and incident totals; only LIKELY_FP counts as a false positive here."""
    totals = incidents.agg(
        F.count(F.lit(1)).alias("n_incidents"),
        F.count_if(F.col("verdict") == "CONFIRMED").alias("n_confirmed"),
        F.count_if(F.col("verdict").contains("FP")).alias("n_fp"),
    )
    return time_range(events).join(totals)
