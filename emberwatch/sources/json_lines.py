"""JSON-lines sources: HIDS alerts and Windows events.

A parsed record keeps its document as text (``doc``) and the members that
normalization reads (``d``).  A member that is present but null is a JSON null
there and not a missing value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions.documents import (
    Path,
    computed_once,
    has_key,
    leaf,
    member_schema,
)
from emberwatch.session import prepare_for_parsing
from emberwatch.sources.lines import read_lines, stripped

def paths(parent: Path, names: str) -> list[Path]:
    return [(*parent, name) for name in names.split()]


WIN_SYSTEM: Path = ("data", "win", "system")
WIN_DATA: Path = ("data", "win", "eventdata")
LOG_TEXTS: list[Path] = [("log.original",), ("host",), ("full_log",), ("message",)]
EVENT_DATA_PLACES: list[Path] = [("winlog", "event_data"), ("event_data",), ("EventData",)]

HIDS_MEMBERS: list[Path] = [
    *paths((), "timestamp @timestamp location user_agent"),
    *LOG_TEXTS,
    *paths(("rule",), "id level description groups mitre"),
    *paths(("agent",), "id name ip"),
    *paths(("manager",), "name"),
    *paths(("predecoder",), "srcip source.ip dstip destination.ip hostname program_name"),
    *paths(("source",), "ip port"),
    *paths(("destination",), "ip port"),
    *paths(("data",), "srcip ip dstip dstport srcport srcuser dstuser command cmdline"),
    *paths(("data",), "proto action id suricata.eve.dest_port suricata.eve.user"),
    *paths(("data",), "suricata.eve.proto"),
    *paths(WIN_SYSTEM, "computer eventID eventId"),
    *paths(WIN_DATA, "ipAddress sourceNetworkAddress destinationPort targetUserName"),
    *paths(WIN_DATA, "subjectUserName commandLine newProcessName processName"),
    *paths(WIN_DATA, "protocol logonType"),
]
WINDOWS_MEMBERS: list[Path] = [
    *paths((), "timestamp @timestamp location full_log user_agent event_id EventID"),
    *paths((), "event.code computer_name user_name"),
    *[(*place, "any") for place in EVENT_DATA_PLACES],
    *paths(("rule",), "id level description"),
    *paths(("agent",), "id name ip"),
    *paths(("data",), "dstuser srcuser TargetUserName target_user srcip SourceIp"),
    *paths(("data",), "IpAddress source_ip command CommandLine cmd process dstport"),
    *paths(("data",), "DestPort dest_port logon_type LogonType event_id EventID id"),
    *paths(WIN_SYSTEM, "computer eventID eventId"),
    *paths(WIN_DATA, "ipAddress sourceNetworkAddress destinationPort targetUserName"),
    *paths(WIN_DATA, "subjectUserName commandLine newProcessName processName protocol"),
    *paths(WIN_DATA, "logonType workstationName status subStatus"),
    *paths(("winlog",), "event_id computer_name channel log_name provider_name"),
    *paths(("winlog",), "keywords task"),
    *paths(("event",), "code"),
    *paths(("host",), "name ip"),
    *paths(("user",), "name"),
    *paths(("source",), "ip"),
]


def members(df: DataFrame, names: Sequence[Path]) -> Column:
    """``doc`` parsed into ``d`` with the members at the paths as VARIANT."""
    prepare_for_parsing(df.sparkSession)
    return F.from_json("doc", member_schema(names), {"allowSingleQuotes": "false"})


def _documents(lines: DataFrame, names: Sequence[Path]) -> DataFrame:
    """Unwrap search-export envelopes and parse."""
    others = [name for name in lines.columns if name != "line"]
    line = F.col("line")
    wrapped = F.when(line.contains('"_source"'), F.get_json_object(line, "$._source"))
    trimmed = lines.withColumn("line", stripped(line))
    documents = trimmed.withColumn("wrapped", wrapped).withColumn(
        "doc",
        F.when(
            line.startswith("{") & line.endswith("}"),
            F.when(F.col("wrapped").startswith("{"), F.col("wrapped")).otherwise(line),
        ),
    )
    return computed_once(
        documents, *others, "line", "doc", members(documents, names).alias("d")
    )


def _reject_reason(valid: Column, needed: list[str], lacking: str) -> Column:
    """NULL for valid records; blank lines are no records and are marked apart."""
    keys = F.json_object_keys("doc")
    present = F.lit(True)
    for name in needed:
        present = present & F.array_contains(keys, name)
    return (
        F.when(valid, F.lit(None).cast("string"))
        .when(F.col("line") == "", "blank")
        .when(keys.isNull() | present, "not a JSON object")
        .otherwise(lacking)
    )


def parse_hids_alerts(lines: DataFrame) -> DataFrame:
    """``line`` to ``doc``, ``d`` and ``reject_reason`` (NULL for valid alerts)."""
    parsed = _documents(lines, HIDS_MEMBERS)
    valid = leaf("timestamp").isNotNull() & has_key("rule")
    return parsed.withColumn(
        "reject_reason",
        _reject_reason(valid, ["timestamp", "rule"], "no timestamp or rule"),
    )


def parse_windows_events(lines: DataFrame) -> DataFrame:
    """As HIDS alerts, with ``parser_mode``: ``wazuh`` for the alert form, else
    ``generic``."""
    parsed = _documents(lines, WINDOWS_MEMBERS)
    alert_form = has_key("agent") & has_key("rule")
    moded = parsed.withColumn(
        "parser_mode", F.when(alert_form, F.lit("wazuh")).otherwise(F.lit("generic"))
    )
    valid = leaf("timestamp").isNotNull() | (
        leaf("@timestamp").isNotNull() & (F.col("parser_mode") == "generic")
    )
    return moded.withColumn(
        "reject_reason", _reject_reason(valid, ["timestamp"], "no timestamp")
    )


def read_hids_alerts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_hids_alerts(read_lines(spark, paths))


def read_windows_events(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_windows_events(read_lines(spark, paths))
