"""Classify, score and judge incidents.

Facts are one staged row per (incident, event), so the join of membership with
events happens once.  Everything below is plain aggregation over them: nothing
collects or sorts a whole incident, because one incident may hold a large share
of all events.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from emberwatch.fixed_values import (
    ADMIN_USERS,
    ESCALATION_ACTIONS,
    MAINTENANCE_PROCESSES,
    PATTERN_THRESHOLDS,
    ROUTINE_DESCRIPTION_WORDS,
    SCANNER_NAMES,
    SENSITIVE_PORTS,
    SUSPICIOUS_PROCESS_WORDS,
)
from emberwatch.functions.network import (
    is_external_ip,
    is_internal_ip,
    is_sensitive_port,
)
from emberwatch.functions.text import contains_any, first_word_found, truthy
from emberwatch.functions.verdicts import in_office_hours, verdict
from emberwatch.operators.correlate import Correlation
from emberwatch.operators.ordering import number_rows
from emberwatch.operators.trust import MATCHES, Trust, trust_table, trusted_addresses
from emberwatch.storage import stage

SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US


@dataclass(frozen=True)
class PatternRules:
    """Thresholds and word lists of the pattern classifier."""

    thresholds: Mapping[str, float] = field(
        default_factory=lambda: dict(PATTERN_THRESHOLDS)
    )
    suspicious_words: Sequence[str] = tuple(SUSPICIOUS_PROCESS_WORDS)
    escalation_actions: Sequence[str] = tuple(ESCALATION_ACTIONS)
    lateral_ports: Sequence[int] = tuple(SENSITIVE_PORTS)


def incident_facts(events: DataFrame, membership: DataFrame) -> DataFrame:
    """Stage one row per (incident, event) with what detection and reports read."""
    looked_at = F.concat_ws(
        " ", F.coalesce("full_log", F.lit("")), F.coalesce("user_agent", F.lit(""))
    )
    attributes = events.select(
        "event_id", "source", "src_ip", "dst_ip", "dst_host", "dst_port", "user",
        "process", "action", "result", "severity",
        first_word_found(looked_at, SCANNER_NAMES).alias("scanner"),
        first_word_found(
            F.col("extra.rule_description"), ROUTINE_DESCRIPTION_WORDS
        ).alias("routine_word"),
    )
    return stage(
        membership.select("window_id", "event_id", "us").join(attributes, "event_id"),
        "facts",
    )


VALUE_COLUMNS = {
    "ip": ["src_ip", "dst_ip"],
    "user": ["user"],
    "port": ["dst_port"],
    "host": ["dst_host"],
    "process": ["process"],
    "source": ["source"],
}


def incident_values(
    facts: DataFrame, kinds: Sequence[str] = tuple(VALUE_COLUMNS)
) -> DataFrame:
    """Distinct values per incident: ``window_id, kind, value, n``.

    One row per value and never a set in a cell, because an incident may have
    millions of addresses.  Port 0 is a value here; the counters that ignore it
    say so.
    """
    # One narrow read per column: cheaper than rows of structs, and each read adds up its
    # values before the shuffle.
    columns = [
        facts.select(
            "window_id", F.lit(kind).alias("kind"), truthy(F.col(name).cast("string")).alias("value")
        ).where(F.col("value").isNotNull())
        for kind in kinds
        for name in VALUE_COLUMNS[kind]
    ]
    return (
        reduce(DataFrame.unionByName, columns)
        .groupBy("window_id", "kind", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _value_facts(values: DataFrame, port_type: DataType, rules: PatternRules) -> DataFrame:
    """What an incident's distinct values tell; tests on texts see each value once."""
    kind, value = F.col("kind"), F.col("value")
    ip, process = F.when(kind == "ip", value), F.when(kind == "process", value)
    port = F.when((kind == "port") & (value != "0"), value.cast(port_type))
    return values.groupBy("window_id").agg(
        F.count_if(kind == "ip").alias("n_ips"),
        F.count_if(kind == "user").alias("n_users"),
        F.count_if((kind == "port") & (value != "0")).alias("n_ports"),
        F.count_if(kind == "host").alias("n_hosts"),
        F.sum(F.when(contains_any(process, MAINTENANCE_PROCESSES), F.col("n")).otherwise(0)).alias(
            "n_maintenance"
        ),
        F.bool_or(contains_any(process, rules.suspicious_words)).alias("any_suspicious_process"),
        F.bool_or((kind == "user") & value.isin(ADMIN_USERS)).alias("any_admin"),
        F.array_sort(F.collect_set(F.when(is_sensitive_port(port), port))).alias("sensitive_ports"),
        F.bool_or(is_sensitive_port(port, list(rules.lateral_ports))).alias("any_lateral_port"),
        F.bool_or(is_internal_ip(ip)).alias("any_internal"),
        F.min(F.when(is_external_ip(ip), ip)).alias("external_ip"),
    )


def _trusted_address(values: DataFrame, trust: Trust, trust_match: str) -> DataFrame:
    """The smallest trusted internal address of each incident that has one."""
    if trust_match not in MATCHES:
        raise ValueError(f"unknown trust match: {trust_match!r}")
    entries = trust_table(values.sparkSession, trust)
    if entries is None:
        return values.sparkSession.createDataFrame([], "window_id bigint, trusted_ip string")
    internal = values.where(F.col("kind") == "ip").where(is_internal_ip(F.col("value")))
    pairs = internal.select("window_id", F.col("value").alias("ip"))
    known = stage(trusted_addresses(pairs, entries, trust_match), "trusted")
    return pairs.join(known, "ip").groupBy("window_id").agg(F.min("ip").alias("trusted_ip"))


def incident_statistics(
    facts: DataFrame,
    trust: Trust = None,
    trust_match: str = "prefix",
    rules: PatternRules = PatternRules(),
) -> DataFrame:
    """One row per incident.

    Facts add up to small groups of plain numbers first, so nothing sorts them; lists and
    texts are taken from those groups and from the distinct values.
    """
    severity = F.when(F.col("severity") != 0, F.col("severity"))
    port_type = facts.schema["dst_port"].dataType
    groups = facts.groupBy("window_id", "source", "severity").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("us").alias("last_us"),
        F.count_if(F.col("action") == "login_failed").alias("n_login_failed"),
        F.count_if(F.col("result") == "failure").alias("n_failures"),
        F.bool_or(
            F.coalesce(F.col("action").isin(*rules.escalation_actions), F.lit(False))
        ).alias("any_escalation"),
    )
    totals = stage(
        groups.groupBy("window_id").agg(
            F.array_sort(F.collect_set("source")).alias("sources"),
            F.sum("n_login_failed").alias("n_login_failed"),
            F.sum("n_failures").alias("n_failures"),
            F.sum(F.when(severity.isNotNull(), F.col("n")).otherwise(0)).alias("n_rated"),
            F.max(F.when(severity.isNotNull(), F.struct(severity.alias("severity"), "last_us"))).alias("highest"),
            F.max("severity").alias("max_severity"),
            F.bool_or("any_escalation").alias("any_escalation"),
        ),
        "totals",
    )
    highest = totals.select("window_id", F.col("highest.severity").alias("severity"), F.col("highest.last_us").alias("us"))
    last = (
        facts.select("window_id", "severity", "us", "event_id")
        .join(highest, ["window_id", "severity", "us"])
        .groupBy("window_id")
        .agg(F.max("event_id").alias("last_event_id"))
    )
    peak = F.struct("highest.severity", F.col("highest.last_us").alias("us"), F.col("last_event_id").alias("event_id"))

    def first(name: str) -> DataFrame:
        found = facts.where(F.col(name).isNotNull()).groupBy("window_id")
        return found.agg(F.min(F.struct("us", "event_id", name)).alias("first")).select("window_id", f"first.{name}")

    values = stage(incident_values(facts), "values")
    return (
        totals.join(_value_facts(values, port_type, rules), "window_id", "left")
        .join(_trusted_address(values, trust, trust_match), "window_id", "left")
        .join(last, "window_id", "left")
        .join(first("scanner"), "window_id", "left")
        .join(first("routine_word"), "window_id", "left")
        .fillna(0, ["n_ips", "n_users", "n_ports", "n_hosts", "n_maintenance"])
        .fillna(False, ["any_suspicious_process", "any_admin", "any_lateral_port", "any_internal"])
        .withColumn("sensitive_ports", F.coalesce("sensitive_ports", F.array().cast(ArrayType(port_type))))
        .withColumn("peak", F.when(F.col("highest").isNotNull(), peak))
        .drop("highest", "last_event_id")
    )


def _late_peak(facts: DataFrame, statistics: DataFrame) -> DataFrame:
    """TP8: incidents whose highest severity also occurs in the second half.

    The second half reaches the maximum exactly when the last event of maximal
    severity has at least half of the events before it, so counting replaces
    ordering the incident.
    """
    peaks = statistics.where("n_rated >= 5 AND peak.severity >= 3").select(
        "window_id",
        "n_rated",
        F.struct("peak.us", "peak.event_id").alias("last_peak"),
    )
    earlier = F.struct("us", "event_id") < F.col("last_peak")
    return (
        facts.where(F.col("severity") != 0)
        .select("window_id", "us", "event_id")
        .join(peaks, "window_id")
        .groupBy("window_id", "n_rated")
        .agg(F.count_if(earlier).alias("before_peak"))
        .where(F.col("before_peak") >= F.floor(F.col("n_rated") / 2))
        .select("window_id", F.lit(True).alias("late_peak"))
    )


def _clockwork(facts: DataFrame, incidents: DataFrame) -> DataFrame:
    """FP4: evenly spaced events, mean gap over 5 minutes, variance below 1 s^2.

    A mean gap over 300 s bounds the number of events by the window length, so
    only incidents of a dozen events reach the window function.  Gaps stay whole
    microseconds, so the comparison is exact.
    """
    sparse = incidents.where(
        (F.col("event_count") >= 3)
        & (
            F.col("end_us") - F.col("start_us")
            > F.lit(300 * SECOND_US) * (F.col("event_count") - 1)
        )
    ).select("window_id")
    in_order = Window.partitionBy("window_id").orderBy("us", "event_id")
    gap = (F.col("us") - F.lag("us").over(in_order)).cast("decimal(19,0)")
    spread = (
        F.col("gaps") * F.col("sum_sq") - F.col("sum_gap") * F.col("sum_gap")
        < F.col("gaps") * F.col("gaps") * F.lit(SECOND_US * SECOND_US)
    )
    return (
        facts.select("window_id", "us", "event_id")
        .join(sparse, "window_id")
        .select("window_id", gap.alias("gap"))
        .where(F.col("gap").isNotNull())
        .groupBy("window_id")
        .agg(
            F.count("gap").cast("decimal(6,0)").alias("gaps"),
            F.sum("gap").cast("decimal(16,0)").alias("sum_gap"),
            F.sum(F.col("gap") * F.col("gap")).cast("decimal(30,0)").alias("sum_sq"),
        )
        .where(spread)
        .select("window_id", F.lit(True).alias("clockwork"))
    )


def pattern(rules: PatternRules = PatternRules()) -> Column:
    """First matching attack pattern."""
    t = rules.thresholds
    length = F.col("end_us") - F.col("start_us")
    return (
        F.when(
            (F.col("n_login_failed") >= t["brute_force_failures"]) & (F.col("n_ips") >= 1),
            "BRUTE_FORCE",
        )
        .when(
            (F.col("n_ports") >= t["port_scan_ports"])
            & (F.col("n_ips") <= t["port_scan_max_ips"])
            & (length < t["port_scan_minutes"] * MINUTE_US),
            "PORT_SCAN",
        )
        .when(F.col("any_suspicious_process"), "SUSPICIOUS_PROC")
        .when(
            F.col("any_escalation") & (F.col("max_severity") >= t["escalation_severity"]),
            "PRIV_ESCALATION",
        )
        .when(
            (F.col("n_hosts") >= t["lateral_hosts"])
            & F.col("any_internal")
            & F.col("any_lateral_port"),
            "LATERAL_MOVEMENT",
        )
        .when(
            (F.col("event_count") >= t["exfil_events"])
            & (length < t["exfil_minutes"] * MINUTE_US),
            "DATA_EXFIL",
        )
        .otherwise("UNKNOWN")
    )


def indicators() -> list[tuple[str, Column, Column, Column]]:
    """``(code, condition, delta, detail)`` in reporting order."""
    n, length = F.col("event_count"), F.col("end_us") - F.col("start_us")
    office = in_office_hours(F.col("start_us"))

    def text(template: str, *columns: Column) -> Column:
        return F.format_string(template, *columns)

    return [
        ("TP0a", (length < SECOND_US) & (n > 20), F.lit(-40),
         F.lit("impossible: more than 20 events within one second")),
        ("TP0b", (length == 0) & (n > 10), F.lit(-30),
         F.lit("all events carry the same timestamp")),
        ("TP1", F.col("external_ip").isNotNull(), F.lit(15),
         text("external address, e.g. %s", F.col("external_ip"))),
        ("TP2", F.size("sensitive_ports") > 0, F.lit(5),
         text("sensitive ports: %s",
              F.array_join(F.col("sensitive_ports").cast("array<string>"), ", "))),
        ("TP3", F.col("n_users") >= 3, F.lit(12),
         text("%d different users", F.col("n_users"))),
        ("TP4", F.col("any_admin"), F.lit(8), F.lit("administrative user")),
        ("TP5", ~office, F.lit(10), F.lit("outside office hours")),
        ("TP6", n >= 100, F.lit(10), text("large: %d events", n)),
        ("TP7", length > 30 * MINUTE_US, F.lit(8),
         text("long: %d minutes", F.floor(length / MINUTE_US))),
        ("TP8", F.col("late_peak"), F.lit(12), F.lit("severity stays at or reaches its peak")),
        ("TP9", F.col("n_failures") >= 20, F.lit(15),
         text("persistent: %d failures", F.col("n_failures"))),
        ("TP10", F.size("sources") >= 2, F.lit(15),
         text("seen by several sources: %s", F.array_join("sources", ", "))),
        ("FP1", F.col("trusted_ip").isNotNull(), F.lit(-25),
         text("trusted internal address, e.g. %s", F.col("trusted_ip"))),
        ("FP2", F.col("any_internal") & office, F.lit(-10),
         F.lit("internal address in office hours")),
        ("FP3", F.col("scanner").isNotNull(), F.lit(-40),
         text("vulnerability scanner: %s", F.col("scanner"))),
        ("FP4", F.col("clockwork"), F.lit(-30), F.lit("evenly spaced, likely scheduled")),
        ("FP5", n <= 2, F.lit(-15), F.lit("fewer than three events")),
        # Far below any score, so that the bound never shows and the delta stays an INT.
        ("FP6", F.col("n_maintenance") > 0,
         F.greatest(F.lit(-2_000_000_000), -20 * F.col("n_maintenance")).cast("int"),
         text("%d events of maintenance processes", F.col("n_maintenance"))),
        ("FP7", F.col("routine_word").isNotNull(), F.lit(-20),
         text("rule description: %s", F.col("routine_word"))),
    ]


def score(profiles: DataFrame) -> DataFrame:
    """Add ``reasoning``, ``confidence`` (0-100) and ``verdict``."""
    lines = [
        F.when(
            condition,
            F.struct(
                F.lit(code).alias("code"),
                delta.cast("int").alias("delta"),
                detail.alias("detail"),
            ),
        )
        for code, condition, delta, detail in indicators()
    ]
    total = F.aggregate("reasoning", F.lit(50), lambda acc, line: acc + line["delta"])
    return (
        profiles.withColumn("reasoning", F.array_compact(F.array(*lines)))
        .withColumn(
            "confidence",
            F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("double"),
        )
        .withColumn("verdict", verdict(F.col("confidence")))
    )


def incident_profiles(
    incidents: DataFrame,
    facts: DataFrame,
    trust: Trust = None,
    trust_match: str = "prefix",
    rules: PatternRules = PatternRules(),
) -> DataFrame:
    """Incidents with everything classification and scoring look at."""
    statistics = stage(incident_statistics(facts, trust, trust_match, rules), "statistics")
    return (
        incidents.join(statistics, "window_id")
        .join(_late_peak(facts, statistics), "window_id", "left")
        .join(_clockwork(facts, incidents), "window_id", "left")
        .fillna(False, ["late_peak", "clockwork"])
    )


def order_incidents(incidents: DataFrame) -> DataFrame:
    """Add ``rank``: largest first, then most addresses, then id."""
    return number_rows(
        incidents,
        [F.col("event_count").desc(), F.col("n_ips").desc(), F.col("id").asc()],
        "rank",
        "ranked",
    )


@dataclass(frozen=True)
class Detection:
    """``incidents`` ranked and judged; ``facts`` one row per (incident, event)."""

    incidents: DataFrame
    facts: DataFrame


def detect(
    correlation: Correlation,
    events: DataFrame,
    trust: Trust = None,
    trust_match: str = "prefix",
    rules: PatternRules = PatternRules(),
) -> Detection:
    facts = incident_facts(events, correlation.membership)
    profiles = incident_profiles(
        correlation.incidents, facts, trust, trust_match, rules
    ).withColumn("pattern", pattern(rules))
    return Detection(order_incidents(score(profiles)), facts)
