"""Raw log lines of every source format, derived from the EVENT view.

Parsing operators are checked by round trip: write the view's rows as log lines,
parse them, compare with the view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.event_view import view

CLOCK = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _time(pattern: str, us: Column | None = None) -> Column:
    return F.date_format(F.timestamp_micros(F.col("us") if us is None else us), pattern)


def _choose(column: str, pairs: dict[str, str], default: str | None = None) -> Column:
    chosen = F.lit(default)
    for key, value in pairs.items():
        chosen = F.when(F.col(column) == key, value).otherwise(chosen)
    return chosen


def _lines(rows: DataFrame, line: Column) -> DataFrame:
    """Lines with the event id as their lineage."""
    return rows.select(
        line.alias("line"),
        F.col("source").alias("file_name"),
        F.lit("events").alias("file_path"),
        F.lit(0).cast("bigint").alias("block_start"),
        F.col("event_id").alias("row_id"),
    )


def level() -> Column:
    return _choose_int("severity", {1: 3, 2: 5, 3: 8, 4: 13})


def _choose_int(column: str, pairs: dict[int, int]) -> Column:
    chosen = F.lit(None).cast("int")
    for key, value in pairs.items():
        chosen = F.when(F.col(column) == key, value).otherwise(chosen)
    return chosen


def description() -> Column:
    return _choose(
        "action",
        {
            "login_failed": "PAM: Authentication failure",
            "login_success": "sshd: authentication success",
            "user_created": "New user added to the system",
            "process_create": "Command execution by user root",
        },
        "firewall: outbound",
    )


def hids_document(time: Column | None = None) -> Column:
    return F.to_json(
        F.struct(
            (F.concat(_time(CLOCK), F.lit("+0000")) if time is None else time).alias("timestamp"),
            F.struct(level().alias("level"), description().alias("description")).alias("rule"),
            F.struct(F.col("dst_host").alias("name"), F.col("dst_ip").alias("ip")).alias("agent"),
            F.struct(
                F.col("src_ip").alias("srcip"),
                F.col("dst_port").cast("string").alias("dstport"),
                F.col("user_name").alias("dstuser"),
                F.col("process").alias("command"),
                F.lit("-").alias("srcuser"),
            ).alias("data"),
        )
    )


def hids_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir)
    doc = hids_document()
    wrapped = F.concat(F.lit('{"_index":"i","_source":'), doc, F.lit("}"))
    return _lines(rows, F.when(F.col("event_id") % 2 == 0, doc).otherwise(wrapped))


def defective_hids_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIDS lines with planted defects, by event type."""
    doc = hids_document()
    kind = F.col("action")
    line = (
        F.when(kind == "login_failed", F.substring(doc, F.lit(1), F.length(doc) - 1))
        .when(kind == "login_success", F.concat(F.lit("["), doc, F.lit("]")))
        .when(kind == "user_created", F.to_json(F.struct(F.lit("x").alias("timestamp"))))
        .when(kind == "process_create", F.lit("   "))
        .otherwise(doc)
    )
    return _lines(view(spark, sf_dir), line)


def defective_firewall_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firewall lines without their markers for some event types, and blank ones."""
    whole = F.concat(_pair("devname", F.lit("FW"), '"'), F.lit(" type=traffic "), _pair("srcip", F.col("dst_ip")))
    line = (
        F.when(F.col("action") == "login_failed", _pair("srcip", F.col("dst_ip")))
        .when(F.col("action") == "login_success", _pair("devname", F.lit("FW"), '"'))
        .when(F.col("action") == "process_create", F.lit(" \t"))
        .otherwise(whole)
    )
    return _lines(view(spark, sf_dir), line)


def defective_windows_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows lines with planted defects, by event type."""
    doc = F.to_json(F.struct(F.concat(_time(CLOCK), F.lit("Z")).alias("@timestamp"), F.struct("dst_host").alias("winlog")))
    line = (
        F.when(F.col("action") == "login_failed", F.substring(doc, F.lit(2), F.length(doc)))
        .when(F.col("action") == "login_success", F.concat(doc, F.lit(",")))
        .when(F.col("action") == "user_created", F.to_json(F.struct(F.lit("x").alias("message"))))
        .when(F.col("action") == "process_create", F.lit(""))
        .otherwise(doc)
    )
    return _lines(view(spark, sf_dir), line)


def badly_timed_hids_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIDS lines whose times are bad for some event types."""
    time = (
        F.when(F.col("action") == "login_failed", "not-a-timestamp")
        .when(F.col("action") == "login_success", "")
        .when(F.col("action") == "user_created", "2024-13-01T00:00:00Z")
        .otherwise("2024-01-01T00:00:00Z")
    )
    return _lines(view(spark, sf_dir), hids_document(time))


FIREWALL_VERBS = {
    "login_failed": "deny",
    "login_success": "accept",
    "user_created": "close",
    "process_create": "reset",
    "connection_allowed": "ip-conn",
}


def _pair(key: str, value: Column, quote: str = "") -> Column:
    return F.concat(F.lit(f"{key}={quote}"), value.cast("string"), F.lit(quote))


def firewall_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events carry a microsecond epoch, odd ones a local clock at +0700."""
    local_us = F.col("us") + F.lit(7 * 3_600_000_000)
    epoch = F.concat(_pair("eventtime", F.col("us")), F.lit(" date=1999-01-01 time=00:00:00"))
    clock = F.concat_ws(
        " ",
        _pair("date", _time("yyyy-MM-dd", local_us)),
        _pair("time", _time("HH:mm:ss", local_us)),
        F.lit('tz="+0700"'),
    )
    number = F.when(F.col("protocol") == "TCP", F.lit(6)).otherwise(F.lit(17))
    line = F.concat_ws(
        " ",
        F.when(F.col("event_id") % 2 == 0, epoch).otherwise(clock),
        _pair("devname", F.concat(F.lit("FW "), F.col("k")), '"'),
        F.lit("logid=0000000013 type='traffic' subtype=forward"),
        _pair("srcip", F.lit("0.0.0.0")),
        _pair("srcip", F.col("src_ip")),
        _pair("dstip", F.col("dst_ip")),
        _pair("dstport", F.col("dst_port")),
        _pair("proto", number),
        _pair("action", _choose("action", FIREWALL_VERBS)),
    )
    return _lines(view(spark, sf_dir), line)


WINDOWS_IDS = {
    "login_failed": "4625",
    "login_success": "4624",
    "user_created": "4720",
    "process_create": "4688",
}


def windows_alert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections carry no event id, so their rule decides."""
    doc = F.to_json(
        F.struct(
            F.concat(_time(CLOCK), F.lit("Z")).alias("timestamp"),
            F.struct(F.lit("60225").alias("id"), level().alias("level")).alias("rule"),
            F.struct(F.col("dst_host").alias("name"), F.col("dst_ip").alias("ip")).alias("agent"),
            F.struct(
                F.struct(
                    F.struct(_choose("action", WINDOWS_IDS).alias("eventID")).alias("system"),
                    F.struct(
                        F.col("user_name").alias("targetUserName"),
                        F.col("src_ip").alias("ipAddress"),
                        F.col("process").alias("commandLine"),
                        F.col("src_host").alias("workstationName"),
                        F.col("dst_port").alias("destinationPort"),
                        F.col("protocol").alias("protocol"),
                    ).alias("eventdata"),
                ).alias("win")
            ).alias("data"),
        )
    )
    return _lines(view(spark, sf_dir), doc)


def windows_shipper_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.to_json(
        F.struct(
            F.concat(_time(CLOCK), F.lit("Z")).alias("@timestamp"),
            F.struct(F.array("dst_ip", F.lit("fe80::1")).alias("ip")).alias("host"),
            F.struct(
                _choose("action", WINDOWS_IDS).cast("int").alias("event_id"),
                F.col("dst_host").alias("computer_name"),
                F.struct(
                    F.col("user_name").alias("TargetUserName"),
                    F.col("src_ip").alias("IpAddress"),
                    F.col("process").alias("CommandLine"),
                    F.col("src_host").alias("WorkstationName"),
                    F.col("dst_port").cast("string").alias("DestinationPort"),
                    F.col("protocol").alias("Protocol"),
                ).alias("event_data"),
            ).alias("winlog"),
        )
    )
    return _lines(view(spark, sf_dir), doc)


def archive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level-0 records with nothing but log text: firewall text or an SSH line."""
    pairs = F.concat_ws(
        " ",
        F.lit("date=2024-01-01 devname=FW-1 vd=root"),
        _pair("srcip", F.col("src_ip")),
        _pair("dstip", F.col("dst_ip"), '"'),
        _pair("dstport", F.col("dst_port")),
        _pair("proto", F.lit(6)),
        _pair("action", _choose("action", FIREWALL_VERBS)),
    )
    ssh = F.concat(
        F.lit("Jan  1 00:00:00 gateway sshd[77]: Failed password for invalid user "),
        F.coalesce("user_name", F.lit("guest")),
        F.lit(" from "),
        F.coalesce("src_ip", F.lit("198.51.100.7")),
        F.lit(" port "),
        (F.lit(40000) + F.col("k")).cast("string"),
        F.lit(" ssh2"),
    )
    text = F.when(F.col("event_id") % 2 == 0, pairs).otherwise(ssh)
    doc = F.to_json(
        F.struct(
            F.concat(_time(CLOCK), F.lit("Z")).alias("timestamp"),
            F.struct(F.lit(0).alias("level")).alias("rule"),
            text.alias("full_log"),
        )
    )
    return _lines(view(spark, sf_dir), doc)


def odd_user_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIDS records with users and addresses that cleaning must judge."""
    pick = F.col("event_id") % 6
    user = (
        F.when(pick == 0, "N/A")
        .when(pick == 1, "123e4567-e89b-12d3-a456-426614174000")
        .when(pick == 2, "aa:bb:cc:dd:ee:ff")
        .when(pick == 3, "a-user-name-that-is-longer-than-thirty")
        .when(pick == 4, "mary-ann-of-the-hill")
        .otherwise(F.col("user_name"))
    )
    address = F.when(pick < 2, F.col("dst_host")).otherwise(F.col("src_ip"))
    doc = F.to_json(
        F.struct(
            F.concat(_time(CLOCK), F.lit("Z")).alias("timestamp"),
            F.struct(F.lit(5).alias("level"), F.lit("odd users").alias("description")).alias("rule"),
            F.struct(user.alias("srcuser"), address.alias("srcip")).alias("data"),
        )
    )
    return _lines(view(spark, sf_dir), doc)


HIDS_EXPORT = [
    "@timestamp", "rule_id", "Rule_Level", "rule.groups", "agent_name", "src_ip",
    "dstport", "data_dstuser", "agent", "message",
]


def hids_export_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir)
    groups = F.when(
        F.col("action") == "login_failed", F.lit('["windows","authentication_failed"]')
    ).otherwise(F.lit('["local","syslog"]'))
    cells = [
        F.concat(_time(CLOCK), F.lit("Z")),
        F.lit("60122"),
        F.concat(F.lit(" "), level().cast("string")),
        groups,
        F.col("dst_host"),
        F.coalesce("src_ip", F.lit("-")),
        F.col("dst_port").cast("string"),
        F.col("user_name"),
        # A whole-object column in the way of agent.name wins where it is filled.
        F.when(F.col("event_id") % 5 == 0, F.lit('{"name":"OVERRIDE","id":"9"}')),
        F.lit("exported"),
    ]
    return _cells(rows, cells)


FIREWALL_EXPORT = [
    "date", "time", "hostname", "SourceIP", "dest_ip", "DestPort", "protocol",
    "fw_action", "log_type", "subtype",
]


def firewall_export_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.when(F.col("protocol") == "TCP", F.lit("6")).otherwise(F.lit("47"))
    cells = [
        _time("yyyy-MM-dd"),
        _time("HH:mm:ss"),
        F.concat(F.lit("FW"), F.col("k")),
        F.col("src_ip"),
        F.col("dst_ip"),
        F.col("dst_port").cast("string"),
        number,
        F.upper(_choose("action", FIREWALL_VERBS)),
        F.lit("traffic"),
        F.lit("-"),
    ]
    return _cells(view(spark, sf_dir), cells)


def _cells(rows: DataFrame, cells: list[Column]) -> DataFrame:
    from emberwatch.sources.csv_export import SURPLUS

    return rows.select(
        *[cell.cast("string").alias(f"c{place}") for place, cell in enumerate(cells)],
        F.when(F.col("event_id") % 11 == 0, F.lit("surplus")).alias(SURPLUS),
        F.col("source").alias("file_name"),
        F.lit("events").alias("file_path"),
        F.lit(0).cast("bigint").alias("block_start"),
        F.col("event_id").alias("row_id"),
    )
