"""Raw records to the event schema, one select per source.

Each normalizer keeps every valid record and says in ``normalize_error`` why a
record cannot become an event; ``split_normalized`` parts the two.  A record
without a usable time is never given one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.fixed_values import (
    ALLOWING_WORDS_FIREWALL,
    ALLOWING_WORDS_HIDS,
    BLOCKING_WORDS,
    DESCRIPTION_ACTIONS,
    EVENT_ID_ACTIONS,
    FIREWALL_HIGH_PORTS,
    GROUP_ACTIONS,
    GROUPS_FIRST,
    RULE_EVENT_IDS,
    TERMINATING_WORDS,
    WINDOWS_DESCRIPTION_ACTIONS,
)
from emberwatch.functions import clock
from emberwatch.functions.documents import (
    SHIPPED,
    as_text,
    computed_once,
    has_key,
    head,
    is_string,
    is_truthy,
    is_unsized,
    leaf,
    pick,
    string_only,
    struct_at,
    text_or_empty,
    to_integer,
)
from emberwatch.functions.free_text import extract_from_text
from emberwatch.functions.network import looks_like_ip, protocol_name
from emberwatch.functions.text import (
    first_keyword_value,
    lookup,
    looks_like_uuid,
    safe_int,
    truthy,
)
from emberwatch.functions.verdicts import severity_from_level
from emberwatch.sources.json_lines import (
    EVENT_DATA_PLACES,
    LOG_TEXTS,
    WIN_DATA,
    WIN_SYSTEM,
    paths,
)
from emberwatch.schema import CARRIED, EVENT_FIELDS, event_columns, extra


def _carried(df: DataFrame) -> list[str]:
    return [name for name in CARRIED if name in df.columns]


def _raw(df: DataFrame) -> Column:
    """The document, or the line where it is not one."""
    return F.coalesce("doc", "line") if "line" in df.columns else F.col("doc")


def _finish(df: DataFrame, error: Column, **values: Column) -> DataFrame:
    return computed_once(
        df, *_carried(df), *event_columns(**values), error.alias("normalize_error")
    )


def outcome_of_action(action: Column) -> Column:
    return F.when(action == "login_failed", "failure").when(
        action == "login_success", "success"
    )


# --- HIDS alerts ---------------------------------------------------------------------


def rule_action(description: Column, groups: Column) -> Column:
    """Action from the rule text, then from specific groups, then from any known group."""
    specific = [
        F.when(F.array_contains(groups, name), F.lit(GROUP_ACTIONS[name]))
        for name in GROUPS_FIRST
    ]
    known = F.filter(groups, lambda g: g.isin(list(GROUP_ACTIONS)))
    return F.coalesce(
        first_keyword_value(description, DESCRIPTION_ACTIONS),
        *specific,
        lookup(F.try_element_at(known, F.lit(1)), GROUP_ACTIONS),
    )


def connection_override(verb: Column) -> Column:
    """Connection action named by ``data.action``; exact lower-case words only."""
    return (
        F.when(verb.isin(BLOCKING_WORDS), "connection_blocked")
        .when(verb.isin(ALLOWING_WORDS_HIDS), "connection_allowed")
        .when(verb == "close", "connection_closed")
    )


def longest_log_text(*candidates: Column) -> Column:
    """Longest of the texts over 50 characters, the earlier one on ties, else ''."""
    ranked = F.array(
        *[
            F.struct(F.length(text).alias("size"), F.lit(-place).alias("place"), text.alias("text"))
            for place, text in enumerate(candidates)
        ]
    )
    return F.coalesce(
        F.array_max(F.filter(ranked, lambda c: c["size"] > 50))["text"], F.lit("")
    )


def merge_text_fallback(rows: DataFrame) -> DataFrame:
    """Fill what the structured fields lack from the log text.

    Applies to bare archive records and to records whose addresses are not
    addresses, and only where there is a log text.
    """
    empty = F.lit("")
    src, dst = F.coalesce("src_ip", empty), F.coalesce("dst_ip", empty)
    src_bad = (src != "") & ~looks_like_ip(src)
    dst_bad = (dst != "") & ~looks_like_ip(dst)
    bare = (src == "") & (F.col("level") == 0)
    for name in ("user", "process", "protocol"):
        bare = bare & (F.coalesce(name, empty) == "")
    wanted = (bare | src_bad | dst_bad) & (F.col("log_text") != "")
    found = F.col("found")
    use = found.isNotNull()
    unnamed = F.coalesce("user", empty).isin("", "N/A", "?")
    no_action = F.coalesce("action", empty).isin("", "generic_alert")
    quiet = (F.col("level") == 0) & (F.col("severity") == 1)
    no_port = F.coalesce(F.col("dst_port"), F.lit(0)) == 0

    def replaced(name: str, condition: Column, value: Column) -> Column:
        return F.when(use & condition, value).otherwise(F.col(name)).alias(name)

    merged = {
        "src_ip": replaced(
            "src_ip", src_bad | (src == ""), F.coalesce(found["srcip"], F.col("src_ip"))
        ),
        "dst_ip": replaced(
            "dst_ip", dst_bad | (dst == ""), F.coalesce(found["dstip"], F.col("dst_ip"))
        ),
        "dst_port": replaced(
            "dst_port", no_port & found["dstport"].isNotNull(), safe_int(found["dstport"])
        ),
        "user": replaced("user", unnamed, found["user"]),
        "protocol": replaced(
            "protocol", F.coalesce("protocol", empty) == "", found["proto"]
        ),
        "action": replaced(
            "action", no_action, F.coalesce(found["action"], F.col("action"))
        ),
        "severity": replaced(
            "severity", quiet, F.coalesce(found["severity"], F.col("severity"))
        ),
    }
    found_once = computed_once(
        rows, *rows.columns, F.when(wanted, extract_from_text(F.col("log_text"))).alias("found")
    )
    others = [name for name in rows.columns if name not in merged]
    return found_once.select(*others, *merged.values())


def clean_hids(rows: DataFrame) -> DataFrame:
    """Blank out addresses that are none and users that are placeholders or ids."""

    def address(name: str) -> Column:
        value = F.col(name)
        return F.when((value == "") | looks_like_ip(value), value)

    user = F.col("user")
    nameless = (
        (user == "N/A") | (F.length(user) > 30) | user.contains(":") | looks_like_uuid(user)
    )
    encoded = F.lower("log_text").contains("powershell -enc")
    return rows.withColumns(
        {
            "src_ip": address("src_ip"),
            "dst_ip": address("dst_ip"),
            "user": F.when(~nameless, user),
            "process": F.when(
                (F.coalesce("process", F.lit("")) == "") & encoded, F.col("log_text")
            ).otherwise(F.col("process")),
        }
    )


def _hids_picks() -> dict[str, Column]:
    """Values found in one of several places, still typed."""
    return {
        "picked_time": pick(("timestamp",), ("@timestamp",)),
        "picked_src": pick(
            ("data", "srcip"), ("data", "ip"),
            *paths(WIN_DATA, "ipAddress sourceNetworkAddress"),
            ("source", "ip"), *paths(("predecoder",), "srcip source.ip"),
        ),
        "picked_dst": pick(
            ("data", "dstip"), ("destination", "ip"),
            *paths(("predecoder",), "dstip destination.ip"), ("agent", "ip"),
        ),
        "picked_host": pick(
            ("agent", "name"), (*WIN_SYSTEM, "computer"), ("predecoder", "hostname")
        ),
        "picked_port": pick(
            ("data", "dstport"), ("destination", "port"), ("source", "port"),
            (*WIN_DATA, "destinationPort"), ("data", "srcport"),
            ("data", "suricata.eve.dest_port"),
        ),
        "picked_user": pick(
            *paths(("data",), "srcuser dstuser"),
            *paths(WIN_DATA, "targetUserName subjectUserName"),
            ("data", "suricata.eve.user"),
        ),
        "picked_process": pick(
            *paths(("data",), "command cmdline"),
            *paths(WIN_DATA, "commandLine newProcessName processName"),
        ),
        "picked_protocol": pick(
            ("data", "proto"), (*WIN_DATA, "protocol"), ("data", "suricata.eve.proto")
        ),
        "picked_event_id": pick(*paths(WIN_SYSTEM, "eventID eventId"), ("data", "id")),
        "verb": as_text(pick(("data", "action"))),
    }


def _hids_shape_error() -> Column:
    """Why a record of unexpected shape cannot become an event."""
    description = leaf("rule", "description")
    bare_manager = struct_at("manager").isNull() & has_key("manager")
    checks = [
        (struct_at("rule").isNull(), "rule is not an object"),
        (description.isNotNull() & ~is_string(description), "rule.description is not text"),
        *[(is_unsized(leaf(*path)), f"{path[0]} is not text") for path in LOG_TEXTS],
        (is_unsized(F.col("picked_user")), "user is not text"),
        (bare_manager, "manager is not an object"),
    ]
    return F.coalesce(*[F.when(failed, F.lit(text)) for failed, text in checks])


def _hids_fields(alerts: DataFrame) -> DataFrame:
    typed = [value.alias(name) for name, value in _hids_picks().items()]
    picked = alerts.select(*_carried(alerts), _raw(alerts).alias("doc"), "d", *typed)
    port, groups = F.col("picked_port"), leaf("rule", "groups")
    return picked.select(
        *_carried(alerts),
        F.col("doc"),
        string_only(F.col("picked_time")).alias("time_text"),
        F.coalesce(to_integer(leaf("rule", "level")), F.lit(0)).alias("level"),
        text_or_empty(leaf("rule", "description")).alias("description"),
        F.when(
            F.to_json(groups).startswith("["), F.variant_get(groups, "$", "array<string>")
        ).alias("groups"),
        head(F.col("picked_src")).alias("src_ip"),
        head(F.col("picked_dst")).alias("dst_ip"),
        as_text(F.col("picked_host")).alias("dst_host"),
        F.when(
            F.to_json(port).rlike(r'\A("[0-9]+"|-?[0-9]+)\z'), as_text(port).try_cast("int")
        ).alias("dst_port"),
        as_text(F.col("picked_user")).alias("user"),
        as_text(F.col("picked_process")).alias("process"),
        as_text(F.col("picked_protocol")).alias("protocol"),
        F.col("verb"),
        longest_log_text(*[string_only(leaf(*path)) for path in LOG_TEXTS]).alias("log_text"),
        _hids_shape_error().alias("shape_error"),
        F.struct(
            text_or_empty(leaf("rule", "id")).alias("rule_id"),
            as_text(leaf("rule", "mitre")).alias("mitre"),
            text_or_empty(leaf("location")).alias("location"),
            text_or_empty(F.col("picked_event_id")).alias("event_id"),
            text_or_empty(leaf(*WIN_DATA, "logonType")).alias("logon_type"),
            text_or_empty(leaf("full_log")).alias("full_log"),
            text_or_empty(leaf("agent", "id")).alias("agent_id"),
            text_or_empty(leaf("manager", "name")).alias("manager"),
            text_or_empty(leaf("predecoder", "program_name")).alias("program"),
        ).alias("more"),
        text_or_empty(leaf("user_agent")).alias("user_agent"),
    )


def normalize_hids(alerts: DataFrame) -> DataFrame:
    rows = (
        _hids_fields(alerts)
        .withColumn("severity", severity_from_level(F.col("level")))
        .withColumn(
            "action",
            F.coalesce(
                connection_override(F.col("verb")),
                rule_action(F.col("description"), F.col("groups")),
            ),
        )
        .withColumn("timestamp", clock.iso_timestamp(F.col("time_text")))
    )
    rows = clean_hids(merge_text_fallback(rows))
    more = {
        name: F.col(f"more.{name}")
        for name in (
            "rule_id", "mitre", "location", "event_id", "logon_type", "full_log",
            "agent_id", "manager", "program",
        )
    }
    failed = F.when(F.lower("description").contains("fail"), F.lit("failure"))
    return _finish(
        rows,
        F.coalesce(
            clock.timestamp_error(
                F.col("time_text"), F.col("timestamp"), "Wazuh timestamp"
            ),
            F.col("shape_error"),
        ),
        timestamp=F.col("timestamp"),
        source=F.lit("wazuh"),
        src_ip=F.col("src_ip"),
        dst_ip=F.col("dst_ip"),
        dst_host=F.col("dst_host"),
        dst_port=F.col("dst_port"),
        user=F.col("user"),
        process=F.col("process"),
        action=F.col("action"),
        result=F.coalesce(outcome_of_action(F.col("action")), failed),
        protocol=F.col("protocol"),
        severity=F.col("severity"),
        extra=extra(
            rule_level=F.col("level"),
            rule_description=F.col("description"),
            rule_groups=F.coalesce("groups", F.array().cast("array<string>")),
            **more,
        ),
        raw_event=F.col("doc"),
        full_log=F.col("more.full_log"),
        user_agent=F.col("user_agent"),
    )


# --- firewall --------------------------------------------------------------------------


def firewall_action(verb: Column) -> Column:
    return (
        F.when(verb.isin(ALLOWING_WORDS_FIREWALL), "connection_allowed")
        .when(verb.isin(BLOCKING_WORDS), "connection_blocked")
        .when(verb == "close", "connection_closed")
        .when(verb.isin(TERMINATING_WORDS), "connection_terminated")
        .when(verb != "", F.concat(F.lit("fortigate_"), verb))
    )


def firewall_result(verb: Column) -> Column:
    return (
        F.when(verb.isin(ALLOWING_WORDS_FIREWALL), "allowed")
        .when(verb.isin(BLOCKING_WORDS), "blocked")
        .when(verb == "close", "closed")
        .when(verb.isin(TERMINATING_WORDS), "terminated")
        .otherwise(verb)
    )


def normalize_firewall(records: DataFrame) -> DataFrame:
    f = {name: F.col(f"f.{name}") for name in records.schema["f"].dataType.names}

    def text(name: str) -> Column:
        return F.coalesce(f[name], F.lit(""))

    explicit = truthy(f["timestamp"])
    assembled = clock.local_clock_text(f["date"], f["time"], f["tz"])
    rows = records.withColumn("by_epoch", clock.epoch_timestamp(f["eventtime"]))
    rows = rows.withColumn(
        "timestamp",
        F.coalesce("by_epoch", clock.iso_timestamp(F.coalesce(explicit, assembled))),
    )
    parsed = F.col("timestamp")
    error = F.when(
        parsed.isNull(),
        F.when(
            explicit.isNotNull(),
            clock.timestamp_error(explicit, parsed, "FortiGate timestamp"),
        )
        .when(assembled.isNull(), "missing FortiGate eventtime and date/time")
        .otherwise(clock.timestamp_error(assembled, parsed, "FortiGate date/time")),
    )
    verb = F.lower(text("action"))
    port = safe_int(f["dstport"])
    return _finish(
        rows,
        error,
        timestamp=parsed,
        source=F.lit("fortigate"),
        src_host=f["devname"],
        src_ip=f["srcip"],
        dst_ip=f["dstip"],
        dst_port=port,
        action=firewall_action(verb),
        result=firewall_result(verb),
        protocol=protocol_name(safe_int(f["proto"])),
        severity=F.when(
            (verb == "deny") & F.coalesce(port.isin(FIREWALL_HIGH_PORTS), F.lit(False)), 3
        ).otherwise(2),
        extra=extra(
            log_type=text("type"),
            subtype=text("subtype"),
            service=text("service"),
            policy_id=text("policyid"),
            sent_bytes=safe_int(f["sentbyte"], "bigint"),
            rcvd_bytes=safe_int(f["rcvdbyte"], "bigint"),
            duration=safe_int(f["duration"], "bigint"),
            log_id=text("logid"),
        ),
        raw_event=_raw(records),
        full_log=f["full_log"],
        user_agent=f["user_agent"],
    )


# --- Windows events ------------------------------------------------------------------------


def _present_text(value: Column) -> Column:
    """Text of a value that is neither null nor ''."""
    return truthy(as_text(value))


def alert_event_id() -> Column:
    """Event id of an alert-form record: carried by the event, else by the rule."""
    carried = [
        _present_text(F.col("picked_system_id")),
        *[
            truthy(F.get_json_object("doc", f"$.data['win.system.{name}']"))
            for name in ("eventID", "eventId")
        ],
        *[_present_text(leaf("data", name)) for name in ("event_id", "EventID", "id")],
    ]
    rule_id = text_or_empty(leaf("rule", "id"))
    without_id = [key for key, value in RULE_EVENT_IDS.items() if value is None]
    by_rule = F.when(
        ~rule_id.isin(without_id), F.coalesce(lookup(rule_id, RULE_EVENT_IDS), rule_id)
    )
    shipped = F.coalesce(
        as_text(leaf("winlog", "event_id")),
        _present_text(leaf("event", "code")),
        as_text(leaf("event_id")),
        as_text(leaf("EventID")),
        as_text(leaf("event.code")),
    )
    return F.coalesce(*carried, F.when(struct_at("rule").isNotNull(), by_rule).otherwise(shipped))


def _alert_picks() -> dict[str, Column]:
    """Fields of a Windows event that came as an alert."""
    return {
        "time": pick(("timestamp",), ("@timestamp",)),
        "src_host": leaf(*WIN_DATA, "workstationName"),
        "src_ip": pick(
            *paths(("data",), "srcip SourceIp IpAddress source_ip"),
            *paths(WIN_DATA, "ipAddress sourceNetworkAddress"),
        ),
        "dst_ip": leaf("agent", "ip"),
        "dst_host": pick(("agent", "name"), (*WIN_SYSTEM, "computer")),
        "dst_port": pick(
            *paths(("data",), "dstport DestPort dest_port"), (*WIN_DATA, "destinationPort")
        ),
        "user": pick(
            *paths(("data",), "dstuser srcuser TargetUserName target_user"),
            *paths(WIN_DATA, "targetUserName subjectUserName"),
        ),
        "process": pick(
            *paths(("data",), "command CommandLine cmd process"),
            *paths(WIN_DATA, "commandLine newProcessName processName"),
        ),
        "protocol": leaf(*WIN_DATA, "protocol"),
        "logon_type": pick(
            (*WIN_DATA, "logonType"), *paths(("data",), "logon_type LogonType")
        ),
        "status": leaf(*WIN_DATA, "status"),
        "sub_status": leaf(*WIN_DATA, "subStatus"),
    }


def _shipper_picks() -> dict[str, Column]:
    """The same fields of a Windows event in shipper form."""
    return {
        "time": pick(("@timestamp",), ("timestamp",)),
        "src_host": pick(*paths(SHIPPED, "WorkstationName workstationName")),
        "src_ip": pick(
            *paths(SHIPPED, "IpAddress ipAddress SourceNetworkAddress"), ("source", "ip")
        ),
        "dst_ip": pick(("host", "ip"), ("agent", "ip")),
        "dst_host": pick(("winlog", "computer_name"), ("host", "name"), ("computer_name",)),
        "dst_port": pick(*paths(SHIPPED, "DestinationPort DestPort")),
        "user": pick(
            *paths(SHIPPED, "TargetUserName targetUserName"), ("user", "name"), ("user_name",)
        ),
        "process": pick(*paths(SHIPPED, "CommandLine commandLine NewProcessName ProcessName")),
        "protocol": pick(*paths(SHIPPED, "Protocol protocol")),
        "logon_type": pick(*paths(SHIPPED, "LogonType logonType")),
        "status": leaf(*SHIPPED, "Status"),
        "sub_status": leaf(*SHIPPED, "SubStatus"),
    }


def _windows_picks(records: DataFrame) -> DataFrame:
    """Typed fields of both forms, in one pass over the records."""
    alert = F.col("parser_mode") == "wazuh"
    shipped = F.coalesce(
        *[
            F.when(F.size(struct_at(*path)) > 0, struct_at(*path))
            for path in EVENT_DATA_PLACES
        ]
    )
    leaves = records.select(
        *_carried(records), _raw(records).alias("doc"), "d", "parser_mode",
        F.when(~alert, shipped).alias("shipped"),
    )
    by_alert, by_shipper = _alert_picks(), _shipper_picks()
    picked = (
        {
            f"picked_{name}": F.when(alert, by_alert[name]).otherwise(by_shipper[name])
            for name in by_alert
        }
        | {
            "picked_system_id": pick(*paths(WIN_SYSTEM, "eventID eventId")),
            "picked_event_id": pick(
                ("winlog", "event_id"), ("event", "code"), ("event_id",), ("EventID",),
                ("event.code",),
            ),
            "picked_channel": pick(*paths(("winlog",), "channel log_name")),
        }
    )
    return leaves.withColumns(picked)


def normalize_windows(records: DataFrame) -> DataFrame:
    """Alert form and shipper form; rows without a mode are in shipper form."""
    if "parser_mode" not in records.columns:
        records = records.withColumn("parser_mode", F.lit("generic"))
    alert = F.col("parser_mode") == "wazuh"
    description = leaf("rule", "description")
    by_text = first_keyword_value(F.col("description"), WINDOWS_DESCRIPTION_ACTIONS)

    def told(name: str) -> Column:
        return F.when(alert, text_or_empty(leaf(*name.split("/"))))

    def shipped(name: str) -> Column:
        return F.when(~alert, text_or_empty(leaf("winlog", name)))

    rows = (
        _windows_picks(records)
        .withColumns(
            {
                "time_text": string_only(F.col("picked_time")),
                "event_id": F.when(alert, alert_event_id()).otherwise(
                    text_or_empty(F.col("picked_event_id"))
                ),
                "description": F.when(alert, as_text(description)),
                "odd_description": alert & description.isNotNull() & ~is_string(description),
            }
        )
        .withColumns(
            {
                "timestamp": clock.iso_timestamp(F.col("time_text")),
                "known_action": lookup(F.col("event_id"), EVENT_ID_ACTIONS),
            }
        )
        .withColumn("action", F.coalesce("known_action", by_text, F.lit("windows_event")))
    )
    form = F.when(alert, F.lit("Windows/Wazuh timestamp")).otherwise("Winlogbeat timestamp")
    error = (
        F.when(clock.missing_text(F.col("time_text")), F.concat(F.lit("missing "), form))
        .when(
            F.col("timestamp").isNull(),
            F.concat(F.lit("invalid "), form, F.lit(": '"), "time_text", F.lit("'")),
        )
        .when(
            F.col("odd_description") & F.col("known_action").isNull(),
            "rule.description is not text",
        )
    )
    host = as_text(F.col("picked_dst_host"))
    level = F.coalesce(to_integer(leaf("rule", "level")), F.lit(0))
    picked = {
        name: as_text(F.col(f"picked_{name}"))
        for name in ("src_host", "user", "process", "protocol")
    }
    return _finish(
        rows,
        error,
        timestamp=F.col("timestamp"),
        source=F.lit("windows"),
        src_ip=head(F.col("picked_src_ip")),
        dst_ip=F.when(alert, as_text(F.col("picked_dst_ip"))).otherwise(
            head(F.col("picked_dst_ip"))
        ),
        # In shipper form the host falls back to '' where no name is present at all.
        dst_host=F.when(alert | leaf("computer_name").isNotNull(), host).otherwise(
            F.when(is_truthy(F.col("picked_dst_host")), host).otherwise("")
        ),
        dst_port=to_integer(F.col("picked_dst_port")),
        action=F.col("action"),
        result=outcome_of_action(F.col("action")),
        severity=F.when(alert, severity_from_level(level)).otherwise(2),
        extra=extra(
            event_id=F.col("event_id"),
            logon_type=F.when(
                is_truthy(F.col("picked_logon_type")), as_text(F.col("picked_logon_type"))
            ).otherwise(""),
            status=text_or_empty(F.col("picked_status")),
            sub_status=text_or_empty(F.col("picked_sub_status")),
            rule_id=told("rule/id"),
            rule_description=F.when(alert, F.coalesce("description", F.lit(""))),
            location=told("location"),
            full_log=told("full_log"),
            agent_id=told("agent/id"),
            log_name=F.when(~alert, text_or_empty(F.col("picked_channel"))),
            provider=shipped("provider_name"),
            keywords=shipped("keywords"),
            task=shipped("task"),
        ),
        raw_event=F.col("doc"),
        full_log=text_or_empty(leaf("full_log")),
        user_agent=text_or_empty(leaf("user_agent")),
        **picked,
    )


def split_normalized(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(events, errors)``; rejected records are in neither."""
    if "reject_reason" in normalized.columns:
        normalized = normalized.where(F.col("reject_reason").isNull())
    kept = _carried(normalized)
    failed = F.col("normalize_error").isNotNull()
    events = normalized.where(~failed).select(*kept, *EVENT_FIELDS)
    errors = normalized.where(failed).select(
        *kept, "source", F.col("normalize_error").alias("error"), "raw_event"
    )
    return events, errors
