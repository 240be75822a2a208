"""Registered queries: every operator over the given tables.

Correlation, detection and report queries look at all candidate incidents, before
suppression, so that plain SQL can state the expected rows; suppression and the
whole pipeline have their own queries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions import clock, free_text, network, text, verdicts
from emberwatch.operators import normalize as n
from emberwatch.operators.correlate import Correlation, candidate_incidents, correlate
from emberwatch.operators.detect import Detection, detect
from emberwatch.operators.normalize import split_normalized
from emberwatch.operators.rules import Rule, fan_out
from emberwatch.operators.suppress import suppress_overlaps
from emberwatch.operators.trust import trust_table, trusted_addresses
from emberwatch.plans import profile, report, sinks
from emberwatch.plans.ingest import ingest, ingest_stats, read_directory, rejects_by_reason
from emberwatch.plans.pipeline import analyze_events
from emberwatch.sources import csv_export, firewall, json_lines
from emberwatch.sources.directory import route_by_name
from emberwatch.storage import stage, staging_root
from emberwatch.streaming.tail import tail
from workload import lines
from workload.event_view import DENSE, NORMAL, PLANTED, events, view

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str = "timestamp") -> Column:
    return F.unix_micros(column)


# --- scans and normalizers, by round trip -------------------------------------------------


def _events_of(normalized: DataFrame, *columns: str) -> DataFrame:
    good = normalized.where(F.col("normalize_error").isNull())
    renamed = {"user": F.col("user").alias("user_name"), "us": micros().alias("us")}
    return good.select(
        F.col("row_id").alias("event_id"), *[renamed.get(c, F.col(c)) for c in columns]
    )


def _valid(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull())


@query
def scan_hids_jsonl(spark, sf_dir):
    parsed = json_lines.parse_hids_alerts(lines.hids_lines(spark, sf_dir))
    return _events_of(
        n.normalize_hids(_valid(parsed)), "us", "src_ip", "dst_ip", "dst_host", "dst_port",
        "user", "process", "action", "result", "severity",
    )


@query
def scan_firewall_kv(spark, sf_dir):
    parsed = firewall.parse_firewall_lines(lines.firewall_lines(spark, sf_dir))
    return _events_of(
        n.normalize_firewall(_valid(parsed)), "us", "src_host", "src_ip", "dst_ip",
        "dst_port", "action", "result", "protocol", "severity",
    )


_WINDOWS_COLUMNS = [
    "us", "src_host", "src_ip", "dst_ip", "dst_host", "dst_port", "user", "process",
    "action", "result", "protocol", "severity",
]


@query
def scan_windows_alert(spark, sf_dir):
    parsed = json_lines.parse_windows_events(lines.windows_alert_lines(spark, sf_dir))
    return _events_of(n.normalize_windows(_valid(parsed)), *_WINDOWS_COLUMNS)


@query
def scan_windows_generic(spark, sf_dir):
    parsed = json_lines.parse_windows_events(lines.windows_shipper_lines(spark, sf_dir))
    return _events_of(n.normalize_windows(_valid(parsed)), *_WINDOWS_COLUMNS)


@query
def rejects_by_reason_hids(spark, sf_dir):
    parsed = json_lines.parse_hids_alerts(lines.defective_hids_lines(spark, sf_dir))
    return rejects_by_reason(parsed.withColumn("source", F.lit("wazuh")))


@query
def rejects_by_reason_firewall(spark, sf_dir):
    parsed = firewall.parse_firewall_lines(lines.defective_firewall_lines(spark, sf_dir))
    return rejects_by_reason(parsed.withColumn("source", F.lit("fortigate")))


@query
def rejects_by_reason_windows(spark, sf_dir):
    parsed = json_lines.parse_windows_events(lines.defective_windows_lines(spark, sf_dir))
    return rejects_by_reason(parsed.withColumn("source", F.lit("windows")))


@query
def contract_json(spark, sf_dir):
    """Normalized events written as JSON lines and read again as text."""
    path = _folder(spark)
    parsed = json_lines.parse_hids_alerts(lines.hids_lines(spark, sf_dir))
    sinks.write_events(split_normalized(n.normalize_hids(parsed))[0], path)
    written = spark.read.text(path)
    found = F.json_tuple(
        "value", "timestamp", "src_ip", "dst_host", "dst_port", "user", "severity"
    ).alias("time", "src_ip", "dst_host", "dst_port", "user_name", "severity")
    return (
        written.where(F.size(F.json_object_keys("value")) == 15)
        .select(
            found,
            F.get_json_object("value", "$.extra.rule_level").cast("int").alias("rule_level"),
            F.get_json_object("value", "$.raw_event.agent.name").alias("raw_name"),
        )
        .withColumns({"dst_port": F.col("dst_port").cast("int"), "severity": F.col("severity").cast("int")})
        .groupBy("time", "src_ip", "dst_host", "dst_port", "user_name", "severity", "rule_level", "raw_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def ingest_accounting(spark, sf_dir):
    parsed = json_lines.parse_hids_alerts(lines.defective_hids_lines(spark, sf_dir))
    return ingest_stats(parsed.withColumn("source", F.lit("wazuh")))


def _written(lines_: DataFrame, folder: str, name: str) -> None:
    """The lines as text files below ``folder``, the name at the start of each file's."""
    context = lines_.sparkSession.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    lines_.select("line").repartition(3).write.text(f"{folder}/{name}.parts")
    source = hadoop.Path(f"{folder}/{name}.parts")
    files = source.getFileSystem(context._jsc.hadoopConfiguration())
    for i, status in enumerate(files.globStatus(hadoop.Path(source, "part-*"))):
        files.rename(status.getPath(), hadoop.Path(f"{folder}/{name}-{i}.json"))


def _written_together(lines_: dict[str, DataFrame], folder: str) -> None:
    """``_written`` for several names at once, as each one's files are too few for all cores."""
    with ThreadPoolExecutor(len(lines_)) as pool:
        for done in [pool.submit(_written, rows, folder, name) for name, rows in lines_.items()]:
            done.result()


def _folder(spark) -> str:
    return f"{staging_root(spark)}/emberwatch/logs-{uuid.uuid4().hex}"


@query
def tail_accounting(spark, sf_dir):
    """Files with defects tailed in several micro-batches: what became of every line."""
    folder = _folder(spark)
    made = {"alerts": lines.defective_hids_lines(spark, sf_dir), "times": lines.badly_timed_hids_lines(spark, sf_dir)}
    _written_together(made, f"{folder}/in")
    tailed, running = tail(
        spark, f"{folder}/in/*.json", "wazuh", f"{folder}/out", f"{folder}/checkpoint", files_per_batch=2
    )
    running.awaitTermination()
    events_ = tailed.events.agg(
        F.lit("events").alias("kind"), F.lit("distinct ids").alias("what"), F.countDistinct("event_id").alias("n")
    )
    rows = [events_]
    for kind, reason in (("rejects", "reject_reason"), ("errors", "error")):
        counted = tailed.table(kind).groupBy(F.col(reason).alias("what")).agg(F.count(F.lit(1)).alias("n"))
        rows.append(counted.select(F.lit(kind).alias("kind"), "what", "n"))
    for column in ("total_lines", "parsed", "skipped"):
        total = F.sum(column).alias("n")
        rows.append(tailed.table("stats").agg(F.lit("stats").alias("kind"), F.lit(column).alias("what"), total))
    return reduce(DataFrame.unionByName, rows)


@query
def csv_records(spark, sf_dir):
    """Whole texts with line ends and quotes in the cells of files, each read in many splits."""
    folder = _folder(spark)
    columns = ["doc_id", "lang", "text"]
    table(spark, sf_dir, "documents").select(*columns).write.options(
        header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(folder)
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        cells = stage(csv_export.read_csv_cells(spark, folder, columns), "csv_cells")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    text = F.coalesce("c2", F.lit(""))
    return cells.select(
        F.col("c0").cast("long").alias("doc_id"), F.col("c1").alias("lang"),
        F.char_length(text).alias("n_chars"), F.md5(text).alias("digest"),
        F.col(csv_export.SURPLUS).isNotNull().alias("surplus"),
    )


@query
def ingest_directory(spark, sf_dir):
    """A folder of files of three sources: routed, read, normalized and numbered."""
    folder = _folder(spark)
    made = {
        "wazuh-alerts": lines.hids_lines(spark, sf_dir),
        "fortigate-traffic": lines.firewall_lines(spark, sf_dir),
        "windows-events": lines.windows_shipper_lines(spark, sf_dir),
    }
    _written_together(made, folder)
    read = ingest(read_directory(spark, folder).scans)
    found = read.events.groupBy("source").agg(
        F.countDistinct("event_id").alias("n_events"),
        F.min(micros()).alias("first_us"),
        F.max(micros()).alias("last_us"),
        F.countDistinct("file_name").alias("n_files"),
        F.count_if(F.col("action") == "login_failed").alias("n_login_failed"),
    )
    counted = read.stats.groupBy("source").agg(F.sum("parsed").alias("n_parsed"), F.sum("skipped").alias("n_skipped"))
    return found.join(counted, "source")


@query
def normalize_errors(spark, sf_dir):
    parsed = json_lines.parse_hids_alerts(lines.badly_timed_hids_lines(spark, sf_dir))
    return n.normalize_hids(_valid(parsed)).groupBy(
        F.coalesce("normalize_error", F.lit("ok")).alias("outcome")
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def archive_fallback_merge(spark, sf_dir):
    parsed = json_lines.parse_hids_alerts(lines.archive_lines(spark, sf_dir))
    return _events_of(
        n.normalize_hids(_valid(parsed)), "src_ip", "dst_ip", "dst_port", "user", "action",
        "result", "protocol", "severity",
    )


@query
def post_clean(spark, sf_dir):
    parsed = json_lines.parse_hids_alerts(lines.odd_user_lines(spark, sf_dir))
    return _events_of(n.normalize_hids(_valid(parsed)), "src_ip", "user")


@query
def csv_hids_export(spark, sf_dir):
    cells = lines.hids_export_cells(spark, sf_dir)
    kind = csv_export.detect_csv_kind(lines.HIDS_EXPORT)
    documents = csv_export.parse_csv_rows(cells, lines.HIDS_EXPORT, kind)
    return _events_of(
        n.normalize_hids(_valid(documents)), "us", "src_ip", "dst_host", "dst_port",
        "user", "action", "result", "severity",
    )


@query
def csv_firewall_export(spark, sf_dir):
    cells = lines.firewall_export_cells(spark, sf_dir)
    kind = csv_export.detect_csv_kind(lines.FIREWALL_EXPORT)
    documents = csv_export.parse_csv_rows(cells, lines.FIREWALL_EXPORT, kind)
    return _events_of(
        n.normalize_firewall(_valid(documents)), "us", "src_host", "src_ip", "dst_ip",
        "dst_port", "action", "result", "protocol", "severity",
    )


@query
def json_cell_restore(spark, sf_dir):
    """``props`` as a CSV cell: JSON comes back as JSON, other text as a string."""
    cell = csv_export.cell_value(
        F.when(F.col("event_id") % 3 == 0, F.col("props"))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit(" ["), F.col("event_type")))
        .otherwise("-")
    )
    restored = csv_export.nest_columns([("a.b", csv_export.cell_json(cell))])
    return table(spark, sf_dir, "events").select("event_id", restored.alias("doc"))


@query
def route_by_filename(spark, sf_dir):
    name = F.concat(
        F.element_at(
            F.array(*[F.lit(x) for x in ROUTE_NAMES]), (F.col("event_id") % len(ROUTE_NAMES) + 1).cast("int")
        ),
        F.lit("-"),
        F.col("event_type"),
        F.when(F.col("user_id") % 2 == 0, ".JSON").otherwise(".txt"),
    )
    return (
        table(spark, sf_dir, "events")
        .groupBy(name.alias("name"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("name", "n", route_by_name(F.col("name")).alias("kind"))
    )


ROUTE_NAMES = ["Alerts", "FG-01", "fw.log", "Sysmon", "cyberark", "pam", "export", "darwin"]


@query
def contract_projection(spark, sf_dir):
    return sinks.to_contract(events(spark, sf_dir)).select(
        F.col("timestamp").alias("time_text"), "source", "src_host", "src_ip", "dst_ip",
        "dst_host", "dst_port", F.col("user").alias("user_name"), "process", "action",
        "result", "protocol", "severity",
        F.col("extra.rule_description").alias("rule_description"),
    )


@query
def first_truthy_chain(spark, sf_dir):
    return view(spark, sf_dir).select(
        "event_id",
        text.first_truthy(
            F.col("full_log"), F.col("user_name"), F.col("process"), F.col("src_ip")
        ).alias("chosen"),
    )


# --- scalar functions ----------------------------------------------------------------------


def _clock_text(us: Column) -> Column:
    def stamp(pattern: str) -> Column:
        return F.date_format(F.timestamp_micros(us), pattern)

    form = F.col("event_id") % 8
    return (
        F.when(form == 0, F.concat(stamp(lines.CLOCK), F.lit("Z")))
        .when(form == 1, F.concat(stamp("yyyy-MM-dd HH:mm:ss"), F.lit("+0700")))
        .when(form == 2, F.concat(stamp("yyyy-MM-dd'T'HH:mm"), F.lit("-03:30")))
        .when(form == 3, stamp("yyyy-MM-dd"))
        .when(form == 4, F.concat(F.lit("  "), stamp("yyyy-MM-dd'T'HH:mm:ss.SSS")))
        .when(form == 5, stamp("yyyy-MM"))
        .when(form == 6, F.concat(stamp("yyyy-MM-dd"), F.lit("T25:00:00")))
        .otherwise("")
    )


@query
def timestamp_formats(spark, sf_dir):
    words = _clock_text(F.col("us"))
    return view(spark, sf_dir).select("event_id", words.alias("words")).select(
        "event_id", F.unix_micros(clock.iso_timestamp(F.col("words"))).alias("us")
    )


@query
def epoch_units(spark, sf_dir):
    us, form = F.col("us"), F.col("event_id") % 5
    digits = (
        F.when(form == 0, F.floor(us / 1_000_000).cast("bigint"))
        .when(form == 1, F.floor(us / 1_000).cast("bigint"))
        .when(form == 2, us)
        .when(form == 3, us * 1_000)
    ).cast("string")
    rows = view(spark, sf_dir).select(
        "event_id", F.coalesce(digits, F.lit("12x")).alias("digits")
    )
    return rows.select(
        "event_id", F.unix_micros(clock.epoch_timestamp(F.col("digits"))).alias("us")
    )


@query
def firewall_clock(spark, sf_dir):
    zones = F.array(*[F.lit(z) for z in ["+0700", "Z", "UTC", "", "-03:30", "local"]])
    zone = F.element_at(zones, (F.col("event_id") % 6 + 1).cast("int"))
    stamp = F.timestamp_micros("us")
    assembled = clock.local_clock_text(
        F.when(F.col("event_id") % 7 != 0, F.date_format(stamp, "yyyy-MM-dd")),
        F.date_format(stamp, "HH:mm:ss"),
        zone,
    )
    return view(spark, sf_dir).select("event_id", assembled.alias("words")).select(
        "event_id", F.unix_micros(clock.iso_timestamp(F.col("words"))).alias("us")
    )


@query
def severity_level(spark, sf_dir):
    level = (F.col("event_id") % 18 - 1).cast("int")
    return (
        table(spark, sf_dir, "events")
        .groupBy(level.alias("level"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("level", "n", verdicts.severity_from_level(F.col("level")).alias("severity"))
    )


@query
def action_keywords(spark, sf_dir):
    """Rule-text keywords over all documents and conversation turns."""
    none = F.lit(None).cast("array<string>")
    documents = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("item"), "text"
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("item"), "text"
    )
    return documents.unionByName(turns).select(
        "item", n.rule_action(F.col("text"), none).alias("action")
    )


@query
def action_groups(spark, sf_dir):
    groups = F.when(
        F.col("event_type") == "error", F.array(F.lit("windows"), F.lit("authentication_failed"))
    ).when(
        F.col("event_type") == "view", F.array(F.lit("web"), F.lit("syslog"), F.lit("windows"))
    ).when(F.col("event_type") == "click", F.array(F.lit("web")))
    words = F.concat(F.lit("Rule "), F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id", n.rule_action(words, groups).alias("action")
    )


@query
def action_override(spark, sf_dir):
    words = F.array(
        *[F.lit(w) for w in ["pass", "deny", "close", "accept", "drop", "block", "Deny", "reset"]]
    )
    verb = F.element_at(words, (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", n.connection_override(verb).alias("action")
    )


@query
def windows_event_actions(spark, sf_dir):
    ids = F.array(*[F.lit(i) for i in WINDOWS_IDS])
    event_id = F.element_at(ids, (F.col("event_id") % len(WINDOWS_IDS) + 1).cast("int"))
    from emberwatch.fixed_values import EVENT_ID_ACTIONS, WINDOWS_DESCRIPTION_ACTIONS

    rows = view(spark, sf_dir).select(
        "event_id", event_id.alias("code"), F.concat(F.lit("Audit: "), "rule_description").alias("words")
    )
    return rows.select(
        "event_id",
        F.coalesce(
            text.lookup(F.col("code"), EVENT_ID_ACTIONS),
            text.first_keyword_value(F.col("words"), WINDOWS_DESCRIPTION_ACTIONS),
            F.lit("windows_event"),
        ).alias("action"),
    )


WINDOWS_IDS = ["4624", "4625", "4732", "7045", "1102", "21", "3", "9999", ""]


@query
def outcome(spark, sf_dir):
    return view(spark, sf_dir).select(
        "event_id", n.outcome_of_action(F.col("action")).alias("outcome")
    )


@query
def full_log_choice(spark, sf_dir):
    """Longest text per page among its address and its markup."""
    chosen = n.longest_log_text(F.col("url"), F.col("html"))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.length(chosen).alias("n_chars"), (chosen == F.col("html")).alias("is_markup")
    )


@query
def text_extract_kv(spark, sf_dir):
    """``key=value`` pairs in all page markup."""
    pairs = free_text.key_value_pairs(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", pairs.alias("pairs")).select(
        "page_id",
        F.size("pairs").alias("n_pairs"),
        F.try_element_at("pairs", F.lit(1))["k"].alias("first_key"),
        F.try_element_at("pairs", F.lit(-1))["v"].alias("last_value"),
    )


@query
def text_extract_ssh(spark, sf_dir):
    """Failed-password lines written around the view, with and without the phrase."""
    phrase = F.when(F.col("event_id") % 3 == 0, "invalid user ").otherwise("")
    start = F.when(F.col("event_id") % 5 == 0, "Accepted password for ").otherwise(
        "x\tfailed password for "
    )
    line = F.concat(
        start, phrase, F.coalesce("user_name", F.lit("guest")), F.lit(" from "),
        F.col("dst_ip"), F.lit(" port "), F.col("dst_port").cast("string"), F.lit(" ssh2"),
    )
    found = F.col("found")
    rows = view(spark, sf_dir).select("event_id", free_text.extract_from_text(line).alias("found"))
    return rows.select(
        "event_id", found["user"].alias("user_name"), found["srcip"].alias("src_ip"),
        found["dstport"].alias("dst_port"), found["action"].alias("action"),
        found["severity"].alias("severity"),
    )


@query
def text_extract_ip(spark, sf_dir):
    """Routable addresses in all documents, pages and conversation turns."""
    items = [
        table(spark, sf_dir, "documents").select(
            F.concat(F.lit("d"), "doc_id").alias("item"), "text"
        ),
        table(spark, sf_dir, "pages").select(
            F.concat(F.lit("p"), "page_id").alias("item"), F.col("html").alias("text")
        ),
        table(spark, sf_dir, "conversations").select(
            F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("item"), "text"
        ),
    ]
    found = reduce(DataFrame.unionByName, items).select(
        "item", free_text.routable_addresses(F.col("text")).alias("ips")
    )
    return found.select(
        "item",
        F.size("ips").alias("n_ips"),
        F.try_element_at("ips", F.lit(1)).alias("first_ip"),
        F.try_element_at("ips", F.lit(-1)).alias("last_ip"),
    )


ADDRESSES = [
    ("10.0.0.1", True), ("256.1.1.1", False), ("1.2.3", False), ("01.2.3.4", False),
    ("::1", True), ("2001:db8::9", True), ("fe80::1%eth0", True), ("1::2::3", False),
    ("::ffff:192.0.2.1", True), ("1:2:3:4:5:6:7:8", True), ("1:2:3:4:5:6:7::8", False),
    ("host.example", False), (" 192.168.1.9 ", True), ("", False), ("12345::", False),
    ("1:2:3:4:5:6:1.2.3.4", True), ("::", True), ("1:2:3:4:5:6:7:8:9", False),
]
UUIDS = [
    ("123e4567-e89b-12d3-a456-426614174000", True), ("abc-def-123456", True),
    ("a-b-c", False), ("deadbeefdeadbeef", False), ("ab-cd-ef-ab-cd-zz-zz", True),
    ("mary-ann-of-the-hill", False), ("ABCDEF-012345-6789", True), ("------------------", True),
]


def _sampled(spark, sf_dir, values, test) -> DataFrame:
    listed = F.array(*[F.lit(value) for value, _ in values])
    value = F.element_at(listed, (F.col("event_id") % len(values) + 1).cast("int"))
    return (
        table(spark, sf_dir, "events")
        .select("event_id", value.alias("value"))
        .select("event_id", "value", test(F.col("value")).alias("valid"))
    )


@query
def ip_check(spark, sf_dir):
    return _sampled(spark, sf_dir, ADDRESSES, network.looks_like_ip)


@query
def uuid_check(spark, sf_dir):
    return _sampled(spark, sf_dir, UUIDS, text.looks_like_uuid)


@query
def rfc1918(spark, sf_dir):
    return view(spark, sf_dir).select(
        "event_id",
        network.is_internal_ip(F.col("src_ip")).alias("internal"),
        network.is_external_ip(F.col("src_ip")).alias("external"),
    )


@query
def sensitive_port(spark, sf_dir):
    return view(spark, sf_dir).select(
        "event_id", network.is_sensitive_port(F.col("dst_port")).alias("sensitive")
    )


@query
def protocol_names(spark, sf_dir):
    number = (F.col("event_id") % 60).cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", network.protocol_name(number).alias("protocol")
    )


@query
def safe_integers(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in [" 42 ", "+7", "-3", "22.0", "x", "", "00012"]])
    word = F.element_at(words, (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", word.alias("word")).select(
        "event_id", text.safe_int(F.col("word")).alias("number")
    )


@query
def office_hours(spark, sf_dir):
    return view(spark, sf_dir).select(
        "event_id", verdicts.in_office_hours(F.col("us")).alias("office")
    )


@query
def verdict_labels(spark, sf_dir):
    score = (F.col("event_id") % 101).cast("double")
    return table(spark, sf_dir, "events").select(
        "event_id", verdicts.verdict(score).alias("verdict")
    )


@query
def duration_texts(spark, sf_dir):
    seconds = F.col("event_id") % 4000
    return table(spark, sf_dir, "events").select(
        "event_id", text.duration_text(seconds).alias("duration")
    )


# --- correlation ----------------------------------------------------------------------------


# Reports over one event table share its staged incidents, as they would in a session.
_SHARED: dict[tuple, tuple] = {}


def forget_shared() -> None:
    _SHARED.clear()


def candidates(spark: SparkSession, sf_dir: str, squeeze: int = NORMAL) -> Correlation:
    key = (spark.sparkContext.applicationId, sf_dir, squeeze, "candidates")
    if key not in _SHARED:
        found = candidate_incidents(events(spark, sf_dir, squeeze))
        qualified = found.membership.join(found.incidents.select("window_id"), "window_id")
        _SHARED[key] = Correlation(found.incidents, qualified)
    return _SHARED[key]


def judged(
    spark: SparkSession, sf_dir: str, squeeze: int = NORMAL, trust=None, match="prefix"
) -> Detection:
    key = (spark.sparkContext.applicationId, sf_dir, squeeze, str(trust), match)
    if key not in _SHARED:
        _SHARED[key] = detect(
            candidates(spark, sf_dir, squeeze), events(spark, sf_dir, squeeze), trust, match
        )
    return _SHARED[key]


def key_text() -> Column:
    return F.array_join("key", "|")


@query
def fan_out_keys(spark, sf_dir):
    return (
        fan_out(events(spark, sf_dir))
        .groupBy("rule_idx", "key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("us").alias("first_us"),
            F.max("us").alias("last_us"),
        )
        .select("rule_idx", key_text().alias("key"), "n", "first_us", "last_us")
    )


def _windows(correlation: Correlation) -> DataFrame:
    return correlation.incidents.select(
        "rule_idx", key_text().alias("key"), "start_us", "end_us", "event_count"
    )


@query
def anchored_windows(spark, sf_dir):
    return _windows(candidates(spark, sf_dir))


@query
def anchored_windows_dense(spark, sf_dir):
    return _windows(candidates(spark, sf_dir, DENSE))


# One key for all events, whose session is cut into strips of a few hundred events.
HOT_RULES = (Rule("Everything", ("protocol",), 15, 1),)
HOT_STRIP = 300


@query
def anchored_windows_hot(spark, sf_dir):
    same = events(spark, sf_dir).withColumn("protocol", F.lit("ANY"))
    return _windows(candidate_incidents(same, HOT_RULES, HOT_STRIP))


@query
def incident_ids(spark, sf_dir):
    return candidates(spark, sf_dir).incidents.select(
        "id", "rule_idx", key_text().alias("key"), "start_us", "first_event_id"
    )


@query
def select_incident(spark, sf_dir):
    return report.select_incident(judged(spark, sf_dir).incidents, 3).select(
        "id", "rule_idx", key_text().alias("key"), "start_us", "end_us", "event_count"
    )


@query
def pipeline_counters(spark, sf_dir):
    """Counters of a folder with defects, beside those of the incidents."""
    folder = _folder(spark)
    made = {
        "wazuh-alerts": lines.defective_hids_lines(spark, sf_dir),
        "wazuh-times": lines.badly_timed_hids_lines(spark, sf_dir),
    }
    _written_together(made, folder)
    read = ingest(read_directory(spark, folder).scans)
    return report.pipeline_stats(read, judged(spark, sf_dir))


@query
def incident_membership(spark, sf_dir):
    found = candidates(spark, sf_dir)
    return found.membership.join(found.incidents.select("window_id", "id"), "window_id").select(
        "id", "event_id"
    )


@query
def incidents_raw(spark, sf_dir):
    return judged(spark, sf_dir).incidents.select(
        "id", "event_count", "start_us", "end_us", "n_ips", "n_users", "n_ports", "n_hosts",
        F.array_join("sources", ",").alias("sources"),
    )


@query
def incident_order(spark, sf_dir):
    return judged(spark, sf_dir).incidents.select("rank", "id", "event_count", "n_ips")


def _suppressed(spark, sf_dir, squeeze) -> DataFrame:
    found = candidates(spark, sf_dir, squeeze)
    return suppress_overlaps(found.incidents, found.membership).select("id", "event_count")


@query
def suppress_overlapping(spark, sf_dir):
    return _suppressed(spark, sf_dir, NORMAL)


@query
def suppress_overlapping_dense(spark, sf_dir):
    return _suppressed(spark, sf_dir, DENSE)


# --- detection --------------------------------------------------------------------------------


@query
def classify_patterns(spark, sf_dir):
    return judged(spark, sf_dir).incidents.select("id", "pattern")


@query
def classify_patterns_dense(spark, sf_dir):
    return judged(spark, sf_dir, DENSE).incidents.select("id", "pattern")


@query
def classify_patterns_planted(spark, sf_dir):
    return judged(spark, sf_dir, PLANTED).incidents.select("id", "pattern")


def _indicator_table(incidents: DataFrame, prefix: str) -> DataFrame:
    codes = F.transform(
        F.filter("reasoning", lambda x: x["code"].startswith(prefix)),
        lambda x: F.concat(x["code"], F.lit("="), x["delta"].cast("string")),
    )
    return incidents.select("id", F.array_join(codes, ",").alias("indicators"))


@query
def tp_indicators(spark, sf_dir):
    return _indicator_table(judged(spark, sf_dir).incidents, "TP")


@query
def tp_indicators_dense(spark, sf_dir):
    return _indicator_table(judged(spark, sf_dir, DENSE).incidents, "TP")


@query
def tp_indicators_planted(spark, sf_dir):
    return _indicator_table(judged(spark, sf_dir, PLANTED).incidents, "TP")


@query
def fp_indicators(spark, sf_dir):
    return _indicator_table(judged(spark, sf_dir).incidents, "FP")


@query
def fp_indicators_planted(spark, sf_dir):
    return _indicator_table(judged(spark, sf_dir, PLANTED).incidents, "FP")


@query
def fp_indicators_dense(spark, sf_dir):
    return _indicator_table(judged(spark, sf_dir, DENSE).incidents, "FP")


TRUST = {
    "known_scanners": {"ips": ["10.0.1.1"], "subnets": ["192.168.5.0/29"]},
    "trusted_hosts": {"ips": [], "subnets": ["10.0.3.0/24"]},
}


def _addresses(spark, sf_dir) -> DataFrame:
    addresses = F.inline(
        F.array(F.struct(F.col("src_ip").alias("ip")), F.struct(F.col("dst_ip").alias("ip")))
    )
    return view(spark, sf_dir).select(addresses).where(F.col("ip").isNotNull())


def _with_trust(addresses, trust, match) -> DataFrame:
    """Each address, how often it occurs, and whether the list covers it."""
    known = trusted_addresses(addresses, trust_table(addresses.sparkSession, trust), match)
    counted = addresses.groupBy("ip").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(known.withColumn("known", F.lit(True)), "ip", "left").select(
        "ip", "n", F.coalesce("known", F.lit(False)).alias("known")
    )


def _trusted(spark, sf_dir, match) -> DataFrame:
    trusted = network.is_internal_ip(F.col("ip")) & F.col("known")
    return _with_trust(_addresses(spark, sf_dir), TRUST, match).select("ip", "n", trusted.alias("trusted"))


@query
def trust_prefix(spark, sf_dir):
    return _trusted(spark, sf_dir, "prefix")


@query
def trust_cidr(spark, sf_dir):
    return _trusted(spark, sf_dir, "cidr")


# Networks of both families by the fours of their part; a name and a bad network are none.
NETWORKS = [f"2001:DB8:{part:x}::/48" for part in range(0, 40, 4)] + [
    f"fd00::{part:x}:0:0/96" for part in range(0, 40, 4)
] + ["::ffff:10.9.0.0/112", "10.9.8.0/21", "10.9.3.7", "backup-host", "10.9.0.0/40"]


@query
def trust_networks(spark, sf_dir):
    """A trust table of both address families, over addresses made of the events."""
    part, host = F.col("event_id") % 40, F.col("event_id") % 16
    low = F.lower(F.hex(part))
    forms = [
        F.concat(F.lit("2001:db8:"), low, F.lit("::"), F.lower(F.hex(host))),
        F.concat(F.lit("2001:0DB8:"), F.lpad(F.hex(part), 4, "0"), F.lit(":0:0:0:0:"), F.hex(host)),
        F.concat(F.lit("fd00::"), low, F.lit(":0:"), F.lower(F.hex(host))),
        F.concat(F.lit("::ffff:10.9."), (part % 2).cast("string"), F.lit("."), host.cast("string")),
        F.concat(F.lit("10.9."), host.cast("string"), F.lit("."), part.cast("string")),
    ]
    addresses = view(spark, sf_dir).select(F.explode(F.array(*forms)).alias("ip"))
    listed = spark.createDataFrame([(entry,) for entry in NETWORKS], "entry string")
    return _with_trust(addresses, listed, "cidr").select("ip", "n", F.col("known").alias("trusted"))


@query
def score_and_verdict(spark, sf_dir):
    return judged(spark, sf_dir).incidents.select("id", "confidence", "verdict")


@query
def score_with_trust(spark, sf_dir):
    return judged(spark, sf_dir, NORMAL, TRUST, "cidr").incidents.select(
        "id", "confidence", "verdict"
    )


@query
def incident_reasons(spark, sf_dir):
    return report.incident_reasons(judged(spark, sf_dir).incidents).select(
        "id", "place", "code", "delta"
    )


# --- reports ------------------------------------------------------------------------------------


@query
def source_totals(spark, sf_dir):
    return report.source_totals(events(spark, sf_dir))


@query
def severity_histogram(spark, sf_dir):
    return report.severity_histogram(events(spark, sf_dir))


@query
def time_range(spark, sf_dir):
    return report.time_range(events(spark, sf_dir)).select(
        micros("first_time").alias("first_us"), micros("last_time").alias("last_us"), "n_events"
    )


@query
def verdict_counts(spark, sf_dir):
    return report.verdict_counts(judged(spark, sf_dir).incidents)


@query
def incident_summary(spark, sf_dir):
    return report.incident_summary(judged(spark, sf_dir)).drop("advice")


@query
def incident_advice(spark, sf_dir):
    return judged(spark, sf_dir).incidents.select(
        "id", report.advice(F.col("verdict")).alias("advice")
    )


@query
def incident_timeline(spark, sf_dir):
    return report.incident_timeline(judged(spark, sf_dir)).select(
        "id", "place", "event_id", micros("time").alias("us"), "action",
        F.col("user").alias("user_name"), "origin", "target", "more_events",
    )


@query
def incident_metrics(spark, sf_dir):
    return report.incident_metrics(judged(spark, sf_dir))


@query
def incident_value_list(spark, sf_dir):
    found = judged(spark, sf_dir)
    return (
        report.incident_value_list(found.facts)
        .join(found.incidents.select("window_id", "id"), "window_id")
        .select("id", "kind", "value", "n")
    )


@query
def sample_raw_events(spark, sf_dir):
    return report.sample_raw_events(judged(spark, sf_dir), events(spark, sf_dir)).select(
        "id", "event_id", "raw_event"
    )


@query
def recommendations(spark, sf_dir):
    return report.recommendations(judged(spark, sf_dir, DENSE))


@query
def incident_event_list(spark, sf_dir):
    return report.incident_event_list(judged(spark, sf_dir)).select(
        "id", "number", "event_id", "us", "severity", "action", F.col("user").alias("user_name"),
        "origin", "target", "port", "source", "result",
    )


@query
def document_overview(spark, sf_dir):
    return report.document_overview(judged(spark, sf_dir))


@query
def document_totals(spark, sf_dir):
    return report.document_totals(
        events(spark, sf_dir), judged(spark, sf_dir).incidents
    ).select("n_events", "n_incidents", "n_confirmed", "n_fp")


# --- CSV profile -----------------------------------------------------------------------------------


@query
def profile_mapping(spark, sf_dir):
    """Header mapping beside the value counts of the whole export."""
    mapping = profile.profile_mapping(spark, lines.HIDS_EXPORT)
    values = profile.profile_values(lines.hids_export_cells(spark, sf_dir), lines.HIDS_EXPORT)
    return mapping.join(values.select("place", "n_filled"), "place").select(
        F.col("column").alias("column_name"), "mapped_to", "status", "n_filled"
    )


@query
def profile_values(spark, sf_dir):
    cells = lines.firewall_export_cells(spark, sf_dir)
    return profile.profile_values(cells, lines.FIREWALL_EXPORT).select(
        F.col("column").alias("column_name"), "n_distinct", "n_filled"
    )


@query
def profile_suggestions(spark, sf_dir):
    cells = lines.hids_export_cells(spark, sf_dir).withColumn("file_name", F.lit("f"))
    return profile.profile_suggestions(spark, cells, lines.HIDS_EXPORT).select(
        F.col("column").alias("column_name"), "samples"
    )


@query
def profile_yield(spark, sf_dir):
    cells = lines.hids_export_cells(spark, sf_dir)
    return profile.profile_yield(csv_export.parse_csv_rows(cells, lines.HIDS_EXPORT, "wazuh"))


@query
def profile_normalize(spark, sf_dir):
    cells = lines.hids_export_cells(spark, sf_dir).withColumn(
        "c0", F.when(F.col("row_id") % 4 != 0, F.col("c0")).otherwise("soon")
    )
    documents = csv_export.parse_csv_rows(cells, lines.HIDS_EXPORT, "wazuh")
    return profile.profile_normalize(documents, "wazuh")


# --- whole pipeline ------------------------------------------------------------------------------------


@query
def analyze_flagship(spark, sf_dir):
    """Events to ranked, judged incidents after suppression."""
    run = analyze_events(events(spark, sf_dir))
    return run.detection.incidents.select(
        "rank", "id", "rule_idx", key_text().alias("key"), "start_us", "end_us",
        "event_count", "n_ips", "pattern", "confidence", "verdict",
    )


@query
def correlate_membership(spark, sf_dir):
    """Membership of the incidents that survive suppression."""
    kept = correlate(events(spark, sf_dir))
    return kept.membership.join(kept.incidents.select("window_id", "id"), "window_id").select(
        "id", "event_id"
    )
