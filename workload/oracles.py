"""Expected rows of the registered queries, as SQL for DuckDB."""

from __future__ import annotations

from emberwatch import fixed_values as fv
from emberwatch.operators.rules import DEFAULT_RULES
from workload import queries as q
from workload.event_view import DENSE, NORMAL, PLANTED, view_sql

ORACLES: dict[str, str] = {}


def _v(squeeze: int = NORMAL) -> str:
    return f"WITH v AS ({view_sql(squeeze)})"


def _list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _case(subject: str, table: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {subject} {arms} ELSE {default} END"


def _contains_first(subject: str, pairs) -> str:
    arms = " ".join(f"WHEN contains(lower({subject}), '{k}') THEN '{v}'" for k, v in pairs)
    return f"CASE {arms} END"


def _pick_list(values, modulus: int | None = None) -> str:
    return f"list_extract([{_list(values)}], CAST(event_id % {modulus or len(values)} AS INT) + 1)"


# --- round trips ------------------------------------------------------------------------------

_HIDS_ACTION = """CASE action WHEN 'login_failed' THEN 'login_failed' WHEN 'login_success' THEN 'login_success'
  WHEN 'user_created' THEN 'user_created' WHEN 'process_create' THEN 'process_create' END"""
_OUTCOME = "CASE action WHEN 'login_failed' THEN 'failure' WHEN 'login_success' THEN 'success' END"

ORACLES["scan_hids_jsonl"] = f"""{_v()}
SELECT event_id, us, src_ip, dst_ip, dst_host, dst_port, user_name, process,
       {_HIDS_ACTION} AS action, {_OUTCOME} AS result, severity FROM v"""

_FW_ACTION = """CASE action WHEN 'login_failed' THEN 'connection_blocked' WHEN 'login_success' THEN 'connection_allowed'
  WHEN 'user_created' THEN 'connection_closed' WHEN 'process_create' THEN 'connection_terminated' ELSE 'fortigate_ip-conn' END"""
_FW_RESULT = """CASE action WHEN 'login_failed' THEN 'blocked' WHEN 'login_success' THEN 'allowed'
  WHEN 'user_created' THEN 'closed' WHEN 'process_create' THEN 'terminated' ELSE 'ip-conn' END"""
_FW_SEVERITY = "CAST(CASE WHEN action = 'login_failed' AND dst_port IN (22, 3389, 445, 5985) THEN 3 ELSE 2 END AS INT)"

ORACLES["scan_firewall_kv"] = f"""{_v()}
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN us ELSE us - us % 1000000 END AS us,
       'FW ' || CAST(k AS VARCHAR) AS src_host, coalesce(src_ip, '0.0.0.0') AS src_ip, dst_ip, dst_port,
       {_FW_ACTION} AS action, {_FW_RESULT} AS result, protocol, {_FW_SEVERITY} AS severity FROM v"""

_WINDOWS_COMMON = "event_id, us, src_host, src_ip, dst_ip, {host} AS dst_host, dst_port, user_name, process"
ORACLES["scan_windows_alert"] = f"""{_v()}
SELECT {_WINDOWS_COMMON.format(host="dst_host")},
       CASE action WHEN 'connection_allowed' THEN 'explicit_logon' ELSE action END AS action,
       {_OUTCOME} AS result, protocol, severity FROM v"""
ORACLES["scan_windows_generic"] = f"""{_v()}
SELECT {_WINDOWS_COMMON.format(host="coalesce(dst_host, '')")},
       CASE action WHEN 'connection_allowed' THEN 'windows_event' ELSE action END AS action,
       {_OUTCOME} AS result, protocol, CAST(2 AS INT) AS severity FROM v"""

ORACLES["rejects_by_reason_hids"] = f"""{_v()}
SELECT 'wazuh' AS source, CASE action WHEN 'user_created' THEN 'no timestamp or rule' ELSE 'not a JSON object' END AS reject_reason,
       count(*) AS n FROM v WHERE action IN ('login_failed', 'login_success', 'user_created') GROUP BY ALL"""
ORACLES["ingest_accounting"] = f"""{_v()}
SELECT 'wazuh' AS source, source AS file_name, count(*) AS total_lines,
       count(*) FILTER (action = 'connection_allowed') AS parsed,
       count(*) FILTER (action IN ('login_failed', 'login_success', 'user_created')) AS skipped
FROM v GROUP BY v.source"""
_BAD_TIMES = """CASE action WHEN 'login_failed' THEN 'invalid Wazuh timestamp: ''not-a-timestamp'''
       WHEN 'login_success' THEN 'missing Wazuh timestamp'
       WHEN 'user_created' THEN 'invalid Wazuh timestamp: ''2024-13-01T00:00:00Z''' END"""
_ISO = """strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S')
  || CASE WHEN us % 1000000 <> 0 THEN '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00'"""
ORACLES["contract_json"] = f"""{_v()}
SELECT {_ISO} AS time, src_ip, dst_host, dst_port, user_name, severity,
       list_extract([3, 5, 8, 13], severity) AS rule_level, dst_host AS raw_name, count(*) AS n
FROM v GROUP BY ALL"""
ORACLES["rejects_by_reason_firewall"] = f"""{_v()}
SELECT 'fortigate' AS source, CASE action WHEN 'login_failed' THEN 'no device or type marker' ELSE 'no type' END AS reject_reason,
       count(*) AS n FROM v WHERE action IN ('login_failed', 'login_success') GROUP BY ALL"""
ORACLES["rejects_by_reason_windows"] = f"""{_v()}
SELECT 'windows' AS source, CASE action WHEN 'user_created' THEN 'no timestamp' ELSE 'not a JSON object' END AS reject_reason,
       count(*) AS n FROM v WHERE action IN ('login_failed', 'login_success', 'user_created') GROUP BY ALL"""
ORACLES["tail_accounting"] = f"""{_v()},
bad AS (SELECT CASE action WHEN 'user_created' THEN 'no timestamp or rule' ELSE 'not a JSON object' END AS what
  FROM v WHERE action IN ('login_failed', 'login_success', 'user_created'))
SELECT 'events' AS kind, 'distinct ids' AS what, count(*) FILTER (action = 'connection_allowed')
  + count(*) FILTER (action IN ('connection_allowed', 'process_create')) AS n FROM v
UNION ALL SELECT 'rejects', what, count(*) FROM bad GROUP BY what
UNION ALL SELECT 'errors', {_BAD_TIMES}, count(*) FROM v WHERE action IN ('login_failed', 'login_success', 'user_created') GROUP BY 2
UNION ALL SELECT 'stats', 'total_lines', 2 * count(*) FROM v
UNION ALL SELECT 'stats', 'parsed', count(*) + count(*) FILTER (action = 'connection_allowed') FROM v
UNION ALL SELECT 'stats', 'skipped', (SELECT count(*) FROM bad)"""
ORACLES["csv_records"] = """
SELECT doc_id, lang, CAST(length(coalesce(text, '')) AS INT) AS n_chars, md5(coalesce(text, '')) AS digest, false AS surplus
FROM documents"""
ORACLES["ingest_directory"] = f"""{_v()}
SELECT source, count(*) AS n_events, min(us) AS first_us, max(us) AS last_us, 3 AS n_files,
       count(*) FILTER (action = 'login_failed' AND source <> 'fortigate') AS n_login_failed, count(*) AS n_parsed, 0 AS n_skipped
FROM (SELECT 'wazuh' AS source, us, action FROM v UNION ALL SELECT 'windows', us, action FROM v
      UNION ALL SELECT 'fortigate', CASE WHEN event_id % 2 = 0 THEN us ELSE us - us % 1000000 END, action FROM v)
GROUP BY source"""
ORACLES["normalize_errors"] = f"""{_v()}
SELECT CASE action WHEN 'login_failed' THEN 'invalid Wazuh timestamp: ''not-a-timestamp'''
       WHEN 'login_success' THEN 'missing Wazuh timestamp'
       WHEN 'user_created' THEN 'invalid Wazuh timestamp: ''2024-13-01T00:00:00Z''' ELSE 'ok' END AS outcome,
       count(*) AS n FROM v GROUP BY ALL"""
ORACLES["archive_fallback_merge"] = f"""{_v()}
SELECT event_id,
       CASE WHEN event_id % 2 = 1 THEN coalesce(src_ip, '198.51.100.7')
            ELSE coalesce(src_ip, dst_ip) END AS src_ip,
       CASE WHEN event_id % 2 = 0 THEN dst_ip END AS dst_ip,
       CAST(CASE WHEN event_id % 2 = 0 THEN dst_port ELSE 40000 + k END AS INT) AS dst_port,
       CASE WHEN event_id % 2 = 1 THEN coalesce(user_name, 'guest') END AS user_name,
       CASE WHEN event_id % 2 = 1 THEN 'login_failed' WHEN action = 'login_failed' THEN 'connection_blocked'
            WHEN action = 'login_success' THEN 'connection_allowed' END AS action,
       CASE WHEN event_id % 2 = 1 THEN 'failure' END AS result,
       CASE WHEN event_id % 2 = 0 THEN '6' END AS protocol,
       CAST(CASE WHEN event_id % 2 = 1 OR action = 'login_failed' THEN 3 WHEN action = 'login_success' THEN 2 ELSE 1 END AS INT) AS severity
FROM v"""
ORACLES["post_clean"] = f"""{_v()}
SELECT event_id, CASE WHEN event_id % 6 >= 2 THEN src_ip END AS src_ip,
       CASE event_id % 6 WHEN 4 THEN 'mary-ann-of-the-hill' WHEN 5 THEN user_name END AS user_name FROM v"""
ORACLES["csv_hids_export"] = f"""{_v()}
SELECT event_id, us, src_ip, CASE WHEN event_id % 5 = 0 THEN 'OVERRIDE' ELSE dst_host END AS dst_host, dst_port, user_name,
       CASE action WHEN 'login_failed' THEN 'login_failed' ELSE 'syslog_event' END AS action,
       CASE action WHEN 'login_failed' THEN 'failure' END AS result, severity
FROM v WHERE event_id % 11 <> 0"""
ORACLES["csv_firewall_export"] = f"""{_v()}
SELECT event_id, us - us % 1000000 AS us, 'FW' || CAST(k AS VARCHAR) AS src_host, src_ip, dst_ip, dst_port,
       {_FW_ACTION} AS action, {_FW_RESULT} AS result,
       CASE protocol WHEN 'TCP' THEN 'TCP' ELSE 'GRE' END AS protocol, {_FW_SEVERITY} AS severity
FROM v WHERE event_id % 11 <> 0"""
ORACLES["json_cell_restore"] = """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"a":{"b":' || props || '}}'
       WHEN 1 THEN '{"a":{"b":"[' || event_type || '"}}' END AS doc FROM events"""


def _route_sql() -> str:
    arms = " ".join(
        f"WHEN {' OR '.join(f'contains(lower(name), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{kind}'"
        for kind, words in fv.FILE_NAME_ROUTES
    )
    return f"CASE {arms} WHEN lower(name) LIKE '%.csv' OR lower(name) LIKE '%.json' THEN 'wazuh' ELSE '' END"


ORACLES["route_by_filename"] = f"""
SELECT name, count(*) AS n, {_route_sql()} AS kind FROM (
  SELECT {_pick_list(q.ROUTE_NAMES)} || '-' || event_type ||
         CASE WHEN user_id % 2 = 0 THEN '.JSON' ELSE '.txt' END AS name FROM events) GROUP BY name"""
ORACLES["contract_projection"] = f"""{_v()}
SELECT strftime(make_timestamp(us - us % 1000000), '%Y-%m-%dT%H:%M:%S') ||
       CASE WHEN us % 1000000 <> 0 THEN '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' AS time_text,
       source, src_host, src_ip, dst_ip, dst_host, dst_port, user_name, process, action, result, protocol, severity, rule_description FROM v"""
ORACLES["first_truthy_chain"] = f"""{_v()}
SELECT event_id, coalesce(nullif(full_log, ''), user_name, process, src_ip) AS chosen FROM v"""

# --- scalar functions ---------------------------------------------------------------------------

ORACLES["timestamp_formats"] = f"""{_v()}
SELECT event_id, CASE event_id % 8 WHEN 0 THEN us WHEN 1 THEN us - us % 1000000 - 25200000000
       WHEN 2 THEN us - us % 60000000 + 12600000000 WHEN 3 THEN us - us % 86400000000
       WHEN 4 THEN us - us % 1000 END AS us FROM v"""
ORACLES["epoch_units"] = f"""{_v()}
SELECT event_id, CASE event_id % 5 WHEN 0 THEN us - us % 1000000 WHEN 1 THEN us - us % 1000
       WHEN 2 THEN us WHEN 3 THEN us END AS us FROM v"""
ORACLES["firewall_clock"] = f"""{_v()}
SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 6 = 5 THEN NULL
       ELSE us - us % 1000000 + CASE event_id % 6 WHEN 0 THEN -25200000000 WHEN 4 THEN 12600000000 ELSE 0 END END AS us FROM v"""
ORACLES["severity_level"] = """
SELECT level, count(*) AS n, CAST(CASE WHEN level >= 13 THEN 4 WHEN level >= 8 THEN 3 WHEN level >= 5 THEN 2 ELSE 1 END AS INT) AS severity
FROM (SELECT CAST(event_id % 18 - 1 AS INT) AS level FROM events) GROUP BY level"""
ORACLES["action_keywords"] = f"""
SELECT item, {_contains_first("text", fv.DESCRIPTION_ACTIONS)} AS action FROM (
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS item, text FROM documents UNION ALL
  SELECT 'c' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR), text FROM conversations)"""
ORACLES["action_groups"] = """
SELECT event_id, CASE event_type WHEN 'error' THEN 'login_failed' WHEN 'view' THEN 'syslog_event' END AS action FROM events"""
ORACLES["action_override"] = """
SELECT event_id, list_extract(['connection_allowed', 'connection_blocked', 'connection_closed', 'connection_allowed',
       'connection_blocked', 'connection_blocked', NULL, NULL], CAST(event_id % 8 AS INT) + 1) AS action FROM events"""
ORACLES["windows_event_actions"] = f"""{_v()}
SELECT event_id, list_extract(['login_success', 'login_failed', 'user_added_to_local_group', 'service_installed',
       'audit_log_cleared', 'rdp_session_start', 'sysmon_network_connect', 'windows_event', 'windows_event'],
       CAST(event_id % 9 AS INT) + 1) AS action FROM v"""
ORACLES["outcome"] = f"{_v()} SELECT event_id, {_OUTCOME} AS outcome FROM v"
ORACLES["full_log_choice"] = """
SELECT page_id, CAST(CASE WHEN greatest(length(url), length(html)) > 50 THEN greatest(length(url), length(html)) ELSE 0 END AS INT) AS n_chars,
       CASE WHEN length(html) > 50 AND length(html) > length(url) THEN true ELSE html = '' END AS is_markup FROM pages"""
ORACLES["text_extract_kv"] = r"""
SELECT page_id, CAST(len(ks) AS INT) AS n_pairs, lower(ks[1]) AS first_key, trim(trim(vs[-1], '"'), '''') AS last_value FROM (
  SELECT page_id, regexp_extract_all(html, '(\w+)=("[^"]*"|\S+)', 1) AS ks,
         regexp_extract_all(html, '(\w+)=("[^"]*"|\S+)', 2) AS vs FROM pages)"""
ORACLES["text_extract_ssh"] = f"""{_v()}
SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN coalesce(user_name, 'guest') END AS user_name, dst_ip AS src_ip,
       CASE WHEN event_id % 5 <> 0 THEN CAST(dst_port AS VARCHAR) END AS dst_port,
       CASE WHEN event_id % 5 <> 0 THEN 'login_failed' END AS action,
       CAST(CASE WHEN event_id % 5 <> 0 THEN 3 END AS INT) AS severity FROM v"""
ORACLES["text_extract_ip"] = r"""
SELECT item, CAST(len(ips) AS INT) AS n_ips, ips[1] AS first_ip, ips[-1] AS last_ip FROM (
  SELECT item, list_filter(regexp_extract_all(text, '\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b', 1),
         lambda ip: NOT (ip LIKE '0.%' OR ip LIKE '127.%' OR ip LIKE '255.%')) AS ips FROM (
    SELECT 'd' || CAST(doc_id AS VARCHAR) AS item, text FROM documents UNION ALL
    SELECT 'p' || CAST(page_id AS VARCHAR), html FROM pages UNION ALL
    SELECT 'c' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR), text FROM conversations))"""


def _validity(values) -> str:
    flags = ", ".join(str(valid).lower() for _, valid in values)
    return f"""
SELECT event_id, {_pick_list([value for value, _ in values])} AS value,
       list_extract([{flags}], CAST(event_id % {len(values)} AS INT) + 1) AS valid FROM events"""


ORACLES["ip_check"] = _validity(q.ADDRESSES)
ORACLES["uuid_check"] = _validity(q.UUIDS)
_INTERNAL = "({0} LIKE '10.%' OR {0} LIKE '192.168.%' OR regexp_matches({0}, '^172\\.(1[6-9]|2[0-9]|3[01])\\.'))"
_QUAD = "regexp_full_match({0}, '[0-9]+(\\.[0-9]+){{3}}')"
ORACLES["rfc1918"] = f"""{_v()}
SELECT event_id, coalesce({_INTERNAL.format("src_ip")}, false) AS internal,
       coalesce({_QUAD.format("src_ip")} AND NOT {_INTERNAL.format("src_ip")}, false) AS external FROM v"""
_PORTS = ", ".join(str(p) for p in fv.SENSITIVE_PORTS)
ORACLES["sensitive_port"] = f"{_v()} SELECT event_id, dst_port IN ({_PORTS}) AS sensitive FROM v"
ORACLES["protocol_names"] = """
SELECT event_id, CASE event_id % 60 WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' WHEN 47 THEN 'GRE'
       WHEN 50 THEN 'ESP' WHEN 51 THEN 'AH' ELSE CAST(event_id % 60 AS VARCHAR) END AS protocol FROM events"""
ORACLES["safe_integers"] = """
SELECT event_id, CAST(list_extract([42, 7, -3, NULL, NULL, NULL, 12], CAST(event_id % 7 AS INT) + 1) AS INT) AS number FROM events"""
_OFFICE = "(CAST(floor({0} / 3600000000) AS BIGINT) + 7) % 24 BETWEEN 8 AND 17"
ORACLES["office_hours"] = f"{_v()} SELECT event_id, {_OFFICE.format('us')} AS office FROM v"
_VERDICT = """CASE WHEN {0} >= 75 THEN 'CONFIRMED' WHEN {0} >= 50 THEN 'LIKELY_TRUE' WHEN {0} >= 26 THEN 'LIKELY_FP' ELSE 'FALSE_POSITIVE' END"""
ORACLES["verdict_labels"] = f"SELECT event_id, {_VERDICT.format('(event_id % 101)')} AS verdict FROM events"
_DURATION = """CASE WHEN {0} >= 60 THEN CAST({0} // 60 AS VARCHAR) || 'm' || CAST({0} % 60 AS VARCHAR) || 's' ELSE CAST({0} AS VARCHAR) || 's' END"""
ORACLES["duration_texts"] = f"SELECT event_id, {_DURATION.format('(event_id % 4000)')} AS duration FROM events"

# --- correlation --------------------------------------------------------------------------------------


def _keyed() -> str:
    arms = []
    for idx, rule in enumerate(DEFAULT_RULES):
        fields = [f"CAST({name} AS VARCHAR)" for name in rule.key_fields]
        present = " AND ".join(f"{name} IS NOT NULL" for name in rule.key_fields)
        arms.append(
            f"SELECT {idx} AS rule_idx, {' || chr(124) || '.join(fields)} AS key, us, event_id,"
            f" {rule.window_us} AS w, {rule.min_events} AS m FROM v WHERE {present}"
        )
    return " UNION ALL ".join(arms)


def incidents_sql(squeeze: int = NORMAL) -> str:
    """All candidate incidents ``inc`` and their events ``mem``."""
    widths = sorted({rule.window_us for rule in DEFAULT_RULES})
    following = " UNION ALL ".join(
        f"SELECT rule_idx, key, us, min(us) OVER (PARTITION BY rule_idx, key ORDER BY us"
        f" RANGE BETWEEN {w + 1} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM points WHERE w = {w}"
        for w in widths
    )
    return f"""WITH RECURSIVE v AS MATERIALIZED ({view_sql(squeeze)}),
keyed AS MATERIALIZED ({_keyed()}),
points AS (SELECT DISTINCT rule_idx, key, us, w FROM keyed),
following AS MATERIALIZED ({following}),
anchors AS (
  SELECT rule_idx, key, min(us) AS anchor FROM keyed GROUP BY rule_idx, key
  UNION ALL
  SELECT a.rule_idx, a.key, f.nxt FROM anchors a JOIN following f
    ON f.rule_idx = a.rule_idx AND f.key = a.key AND f.us = a.anchor WHERE f.nxt IS NOT NULL),
assigned AS MATERIALIZED (
  SELECT k.*, a.anchor FROM keyed k ASOF JOIN anchors a
    ON k.rule_idx = a.rule_idx AND k.key = a.key AND k.us >= a.anchor),
windows AS (
  SELECT rule_idx, key, anchor, any_value(m) AS m, count(*) AS event_count, max(us) AS end_us,
         min(event_id) FILTER (us = anchor) AS first_event_id FROM assigned GROUP BY rule_idx, key, anchor),
named AS (
  SELECT *, first(anchor) OVER k AS key_us, first(first_event_id) OVER k AS key_event FROM windows
  WINDOW k AS (PARTITION BY rule_idx, key ORDER BY anchor ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
inc AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY rule_idx, key_us, key_event, anchor) AS id, rule_idx, key, anchor AS start_us,
         end_us, event_count, first_event_id FROM named WHERE event_count >= m),
mem AS MATERIALIZED (
  SELECT inc.id, v.* FROM assigned a JOIN inc ON inc.rule_idx = a.rule_idx AND inc.key = a.key AND inc.start_us = a.anchor
  JOIN v ON v.event_id = a.event_id)"""


ORACLES["fan_out_keys"] = f"""{_v()}, keyed AS ({_keyed()})
SELECT rule_idx, key, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM keyed GROUP BY rule_idx, key"""
for _name, _squeeze in (("anchored_windows", NORMAL), ("anchored_windows_dense", DENSE)):
    ORACLES[_name] = f"""{incidents_sql(_squeeze)}
SELECT rule_idx, key, start_us, end_us, event_count FROM inc"""
ORACLES["anchored_windows_hot"] = f"""WITH RECURSIVE v AS MATERIALIZED ({view_sql(NORMAL)}),
points AS (SELECT us, count(*) AS n FROM v GROUP BY us),
following AS MATERIALIZED (
  SELECT us, n, min(us) OVER (ORDER BY us RANGE BETWEEN 900000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM points),
anchors AS (
  SELECT min(us) AS anchor FROM points
  UNION ALL
  SELECT f.nxt FROM anchors a JOIN following f ON f.us = a.anchor WHERE f.nxt IS NOT NULL)
SELECT 0 AS rule_idx, 'ANY' AS key, anchor AS start_us, max(us) AS end_us, CAST(sum(n) AS BIGINT) AS event_count
FROM points p ASOF JOIN anchors a ON p.us >= a.anchor GROUP BY anchor"""
ORACLES["incident_ids"] = f"{incidents_sql()} SELECT id, rule_idx, key, start_us, first_event_id FROM inc"
ORACLES["select_incident"] = f"""{incidents_sql()}
SELECT id, rule_idx, key, start_us, end_us, event_count FROM inc WHERE id = 3"""
ORACLES["pipeline_counters"] = f"""{incidents_sql()}
SELECT (SELECT count(*) + count(*) FILTER (action = 'connection_allowed') FROM v) AS raw_events,
       (SELECT count(*) FILTER (action = 'connection_allowed') + count(*) FILTER (action IN ('connection_allowed', 'process_create')) FROM v)
         AS normalized_events,
       (SELECT 2 * count(*) FILTER (action IN ('login_failed', 'login_success', 'user_created')) FROM v) AS skipped,
       count(*) AS incidents, CAST(coalesce(sum(event_count), 0) AS BIGINT) AS events_grouped FROM inc"""
ORACLES["incident_membership"] = f"{incidents_sql()} SELECT id, event_id FROM mem"

# --- detection ------------------------------------------------------------------------------------------


def _any_word(subject: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({subject}), '{w}')" for w in words) + ")"


_EXTERNAL = f"({_QUAD} AND NOT {_INTERNAL})"
_CIDR = "({0} = '10.0.1.1' OR regexp_matches({0}, '^192\\.168\\.5\\.[0-7]$') OR {0} LIKE '10.0.3.%')"


def profiles_sql(squeeze: int = NORMAL, trusted: str = "false") -> str:
    return f"""{incidents_sql(squeeze)},
ips AS (
  SELECT id, ip, any_value({_INTERNAL.format("ip")}) AS internal, any_value({_EXTERNAL.format("ip")}) AS external,
         any_value({trusted.format("ip")}) AS trusted, count(*) AS n
  FROM (SELECT id, src_ip AS ip FROM mem UNION ALL SELECT id, dst_ip FROM mem) WHERE ip IS NOT NULL AND ip <> '' GROUP BY id, ip),
ip_stats AS (
  SELECT id, count(*) AS n_ips, bool_or(internal) AS any_internal, bool_or(external) AS any_external,
         bool_or(internal AND trusted) AS any_trusted FROM ips GROUP BY id),
ordered AS (
  SELECT *, row_number() OVER o AS pos, count(*) OVER (PARTITION BY id) AS n_all,
         us - lag(us) OVER o AS gap FROM mem WINDOW o AS (PARTITION BY id ORDER BY us, event_id)),
stats AS (
  SELECT id, count(DISTINCT nullif(dst_port, 0)) AS n_ports, count(DISTINCT nullif(dst_host, '')) AS n_hosts,
         count(DISTINCT user_name) AS n_users, count(DISTINCT source) AS n_sources,
         string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
         count(*) FILTER (action = 'login_failed') AS n_failed, count(*) FILTER (result = 'failure') AS n_failures,
         max(severity) AS max_severity,
         coalesce(bool_or({_any_word("process", fv.SUSPICIOUS_PROCESS_WORDS)}), false) AS any_suspicious,
         count(*) FILTER ({_any_word("process", fv.MAINTENANCE_PROCESSES)}) AS n_maintenance,
         bool_or(action IN ({_list(fv.ESCALATION_ACTIONS)})) AS any_escalation,
         coalesce(bool_or(user_name IN ({_list(fv.ADMIN_USERS)})), false) AS any_admin,
         bool_or(dst_port IN ({_PORTS})) AS any_sensitive,
         bool_or({_any_word("full_log", fv.SCANNER_NAMES)}) AS any_scanner,
         bool_or({_any_word("rule_description", fv.ROUTINE_DESCRIPTION_WORDS)}) AS any_routine,
         max(severity) FILTER (pos <= n_all // 2) AS first_half, max(severity) FILTER (pos > n_all // 2) AS second_half,
         var_pop(gap / 1000000.0) AS gap_variance, avg(gap / 1000000.0) AS gap_mean
  FROM ordered GROUP BY id),
p AS MATERIALIZED (
  SELECT inc.*, stats.* EXCLUDE (id), ip_stats.* EXCLUDE (id), end_us - start_us AS span,
         {_OFFICE.format("start_us")} AS office
  FROM inc JOIN stats USING (id) JOIN ip_stats USING (id)),
pattern AS (
  SELECT id, CASE WHEN n_failed >= 10 AND n_ips >= 1 THEN 'BRUTE_FORCE'
       WHEN n_ports >= 10 AND n_ips <= 3 AND span < 600000000 THEN 'PORT_SCAN'
       WHEN any_suspicious THEN 'SUSPICIOUS_PROC'
       WHEN any_escalation AND max_severity >= 3 THEN 'PRIV_ESCALATION'
       WHEN n_hosts >= 3 AND any_internal AND any_sensitive THEN 'LATERAL_MOVEMENT'
       WHEN event_count >= 50 AND span < 3600000000 THEN 'DATA_EXFIL' ELSE 'UNKNOWN' END AS pattern FROM p),
lines AS MATERIALIZED (
  SELECT id, 1 AS ord, 'TP0a' AS code, -40 AS delta FROM p WHERE span < 1000000 AND event_count > 20
  UNION ALL SELECT id, 2, 'TP0b', -30 FROM p WHERE span = 0 AND event_count > 10
  UNION ALL SELECT id, 3, 'TP1', 15 FROM p WHERE any_external
  UNION ALL SELECT id, 4, 'TP2', 5 FROM p WHERE any_sensitive
  UNION ALL SELECT id, 5, 'TP3', 12 FROM p WHERE n_users >= 3
  UNION ALL SELECT id, 6, 'TP4', 8 FROM p WHERE any_admin
  UNION ALL SELECT id, 7, 'TP5', 10 FROM p WHERE NOT office
  UNION ALL SELECT id, 8, 'TP6', 10 FROM p WHERE event_count >= 100
  UNION ALL SELECT id, 9, 'TP7', 8 FROM p WHERE span > 1800000000
  UNION ALL SELECT id, 10, 'TP8', 12 FROM p WHERE event_count >= 5 AND second_half >= first_half AND second_half >= 3
  UNION ALL SELECT id, 11, 'TP9', 15 FROM p WHERE n_failures >= 20
  UNION ALL SELECT id, 12, 'TP10', 15 FROM p WHERE n_sources >= 2
  UNION ALL SELECT id, 13, 'FP1', -25 FROM p WHERE any_trusted
  UNION ALL SELECT id, 14, 'FP2', -10 FROM p WHERE any_internal AND office
  UNION ALL SELECT id, 15, 'FP3', -40 FROM p WHERE any_scanner
  UNION ALL SELECT id, 16, 'FP4', -30 FROM p WHERE event_count >= 3 AND gap_variance < 1.0 AND gap_mean > 300
  UNION ALL SELECT id, 17, 'FP5', -15 FROM p WHERE event_count <= 2
  UNION ALL SELECT id, 18, 'FP6', -20 * n_maintenance FROM p WHERE n_maintenance > 0
  UNION ALL SELECT id, 19, 'FP7', -20 FROM p WHERE any_routine),
scored AS (
  SELECT p.id, CAST(greatest(0, least(100, 50 + coalesce(sum(delta), 0))) AS DOUBLE) AS confidence
  FROM p LEFT JOIN lines ON lines.id = p.id GROUP BY p.id),
judged AS MATERIALIZED (
  SELECT p.*, pattern, confidence, {_VERDICT.format("confidence")} AS verdict
  FROM p JOIN pattern USING (id) JOIN scored USING (id))"""


ORACLES["incidents_raw"] = f"""{profiles_sql()}
SELECT id, event_count, start_us, end_us, n_ips, n_users, n_ports, n_hosts, sources FROM p"""
ORACLES["incident_order"] = f"""{profiles_sql()}
SELECT row_number() OVER (ORDER BY event_count DESC, n_ips DESC, id) AS rank, id, event_count, n_ips FROM p"""
for _suffix, _squeeze in (("", NORMAL), ("_dense", DENSE), ("_planted", PLANTED)):
    ORACLES[f"classify_patterns{_suffix}"] = f"{profiles_sql(_squeeze)} SELECT id, pattern FROM pattern"
    for _prefix in ("TP", "FP"):
        ORACLES[f"{_prefix.lower()}_indicators{_suffix}"] = f"""{profiles_sql(_squeeze)}
SELECT p.id, coalesce(string_agg(code || '=' || CAST(delta AS VARCHAR), ',' ORDER BY ord), '') AS indicators
FROM p LEFT JOIN lines ON lines.id = p.id AND code LIKE '{_prefix}%' GROUP BY p.id"""


def _trust_counts(test: str) -> str:
    return f"""{_v()}
SELECT ip, count(*) AS n, {_INTERNAL.format("ip")} AND {test.format("ip")} AS trusted
FROM (SELECT src_ip AS ip FROM v UNION ALL SELECT dst_ip FROM v) WHERE ip IS NOT NULL GROUP BY ip"""


ORACLES["trust_prefix"] = _trust_counts(
    "({0} LIKE '10.0.1.1%' OR {0} LIKE '192.168.5.29%' OR {0} LIKE '10.0.3.24%')"
)
ORACLES["trust_cidr"] = _trust_counts(_CIDR)
ORACLES["trust_networks"] = f"""{_v()},
n AS (SELECT event_id % 40 AS part, event_id % 16 AS host FROM v),
a AS (
  SELECT '2001:db8:' || to_base(part, 16) || '::' || to_base(host, 16) AS ip, part % 4 = 0 AS trusted FROM n
  UNION ALL
  SELECT '2001:0DB8:' || lpad(to_base(part, 16), 4, '0') || ':0:0:0:0:' || to_base(host, 16), part % 4 = 0 FROM n
  UNION ALL
  SELECT 'fd00::' || lower(to_base(part, 16)) || ':0:' || lower(to_base(host, 16)), part % 4 = 0 FROM n
  UNION ALL
  SELECT '::ffff:10.9.' || part % 2 || '.' || host, true FROM n
  UNION ALL
  SELECT '10.9.' || host || '.' || part, host BETWEEN 8 AND 15 OR (host = 3 AND part = 7) FROM n)
SELECT CASE WHEN ip LIKE '2001:db8%' THEN lower(ip) ELSE ip END AS ip, count(*) AS n, any_value(trusted) AS trusted
FROM a GROUP BY 1"""
ORACLES["score_and_verdict"] = f"{profiles_sql()} SELECT id, confidence, verdict FROM judged"
ORACLES["score_with_trust"] = f"{profiles_sql(NORMAL, _CIDR)} SELECT id, confidence, verdict FROM judged"
ORACLES["incident_reasons"] = f"""{profiles_sql()}
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY ord) AS INT) AS place, code, CAST(delta AS INT) AS delta FROM lines"""

# --- reports ----------------------------------------------------------------------------------------------

ORACLES["source_totals"] = f"{_v()} SELECT source, count(*) AS n_events FROM v GROUP BY source"
ORACLES["severity_histogram"] = f"""{_v()}
SELECT CAST(s AS INT) AS severity, count(event_id) AS n_events FROM (VALUES (1), (2), (3), (4)) l(s) LEFT JOIN v ON severity = s GROUP BY s"""
ORACLES["time_range"] = f"{_v()} SELECT min(us) AS first_us, max(us) AS last_us, count(*) AS n_events FROM v"
ORACLES["verdict_counts"] = f"""{profiles_sql()}
SELECT name AS verdict, count(id) AS n_incidents
FROM (VALUES {", ".join(f"('{name}')" for name in fv.VERDICTS)}) l(name) LEFT JOIN judged ON verdict = name GROUP BY name"""


def _first(table: str, value: str, k: int, order: str | None = None, where: str = "true") -> str:
    """Sorted first values per incident."""
    return f"""(SELECT id, string_agg(x, ', ' ORDER BY r) AS x FROM (
      SELECT id, CAST(x AS VARCHAR) AS x, row_number() OVER (PARTITION BY id ORDER BY {order or "x"}) AS r
      FROM (SELECT DISTINCT id, {value} AS x FROM {table} WHERE {where}) WHERE x IS NOT NULL AND CAST(x AS VARCHAR) <> '') WHERE r <= {k} GROUP BY id)"""


_RANK = "row_number() OVER (ORDER BY event_count DESC, n_ips DESC, judged.id)"
ORACLES["incident_summary"] = f"""{profiles_sql()}
SELECT {_RANK} AS rank, judged.id, pattern, verdict,
       CASE max_severity WHEN 1 THEN 'LOW' WHEN 2 THEN 'MED' WHEN 3 THEN 'HIGH' ELSE 'CRIT' END AS severity,
       confidence, event_count, {_DURATION.format("(span // 1000000)")} AS duration,
       coalesce(i.x, '—') AS first_ips, coalesce(h.x, '—') AS first_hosts
FROM judged LEFT JOIN {_first("ips", "ip", 3)} i ON i.id = judged.id LEFT JOIN {_first("mem", "dst_host", 2)} h ON h.id = judged.id"""
ORACLES["incident_advice"] = f"""{profiles_sql()}
SELECT id, CASE verdict WHEN 'CONFIRMED' THEN 'ACTION: investigate now, the attack pattern is confirmed'
       WHEN 'LIKELY_TRUE' THEN 'needs analysis: strong signs with some noise'
       WHEN 'LIKELY_FP' THEN 'likely a false positive, verify by hand' END AS advice FROM judged"""
ORACLES["incident_timeline"] = f"""{incidents_sql()}
SELECT id, CAST(pos AS INT) AS place, event_id, us, coalesce(action, 'unknown') AS action, coalesce(user_name, '?') AS user_name,
       coalesce(src_ip || ':' || CAST(nullif(dst_port, 0) AS VARCHAR), src_ip, '?') AS origin,
       coalesce(dst_host, dst_ip, '?') AS target, greatest(n_all - 5, 0) AS more_events
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY us, event_id) AS pos, count(*) OVER (PARTITION BY id) AS n_all FROM mem)
WHERE pos <= 5"""
ORACLES["incident_metrics"] = f"""{profiles_sql()}
SELECT p.id, event_count, span // 1000000 AS duration_seconds, replace(sources, ',', ', ') AS sources, n_ips, n_users, n_hosts,
       coalesce(c.n_target_ports, 0) AS n_target_ports, f.x AS first_ports, greatest(coalesce(c.n_target_ports, 0) - 10, 0) AS more_ports,
       coalesce(c.n_processes, 0) AS n_processes, g.x AS first_processes
FROM p JOIN (SELECT id, count(DISTINCT dst_port) AS n_target_ports, count(DISTINCT process) AS n_processes FROM mem GROUP BY id) c ON c.id = p.id
LEFT JOIN {_first("mem", "dst_port", 10)} f ON f.id = p.id LEFT JOIN {_first("mem", "process", 3)} g ON g.id = p.id"""
ORACLES["incident_value_list"] = f"""{incidents_sql()}
SELECT id, kind, value, count(*) AS n FROM (
  SELECT id, 'ip' AS kind, src_ip AS value FROM mem UNION ALL SELECT id, 'ip', dst_ip FROM mem
  UNION ALL SELECT id, 'user', user_name FROM mem UNION ALL SELECT id, 'port', CAST(dst_port AS VARCHAR) FROM mem
  UNION ALL SELECT id, 'host', dst_host FROM mem UNION ALL SELECT id, 'process', process FROM mem
  UNION ALL SELECT id, 'source', source FROM mem) WHERE value IS NOT NULL AND value <> '' GROUP BY id, kind, value"""
ORACLES["sample_raw_events"] = f"""{incidents_sql()}
SELECT inc.id, first_event_id AS event_id, full_log AS raw_event FROM inc JOIN v ON v.event_id = first_event_id"""
ORACLES["recommendations"] = f"""{profiles_sql(DENSE)}
SELECT judged.id, verdict, pattern,
       CASE verdict WHEN 'CONFIRMED' THEN 'confirmed incident, pattern ' || pattern
            WHEN 'FALSE_POSITIVE' THEN 'very likely a false positive, no action; review the trust list regularly'
            ELSE verdict || ': needs manual analysis' END AS headline,
       CASE WHEN verdict <> 'CONFIRMED' THEN '' WHEN pattern = 'BRUTE_FORCE' THEN concat_ws('; ', 'block addresses: ' || i.x,
            'reset the passwords of the affected users', 'check the Windows event log (event id 4625) for confirmation')
            WHEN pattern = 'SUSPICIOUS_PROC' THEN 'check whether the process is legitimate (change request); take a sample and its hash for analysis; isolate the host when there is no justification'
            ELSE '' END AS steps
FROM judged LEFT JOIN {_first("ips", "ip", 3, where="ip NOT LIKE '10.%'")} i ON i.id = judged.id"""
ORACLES["incident_event_list"] = f"""{incidents_sql()}
SELECT id, row_number() OVER (PARTITION BY id ORDER BY us, event_id) AS number, event_id, us, severity,
       coalesce(action, '?') AS action, coalesce(user_name, '?') AS user_name,
       coalesce(src_ip, '?') AS origin, coalesce(dst_host, dst_ip, '?') AS target,
       coalesce(CAST(nullif(dst_port, 0) AS VARCHAR), '-') AS port, source, coalesce(result, '-') AS result FROM mem"""
ORACLES["document_overview"] = f"""{profiles_sql()}
SELECT judged.id, verdict, confidence, event_count AS events, coalesce(i.x, '—') AS source_ips, coalesce(u.x, '—') AS users,
       replace(sources, ',', ', ') AS sources, pattern
FROM judged LEFT JOIN {_first("ips", "ip", 5)} i ON i.id = judged.id LEFT JOIN {_first("mem", "user_name", 5)} u ON u.id = judged.id"""
ORACLES["document_totals"] = f"""{profiles_sql()}
SELECT (SELECT count(*) FROM v) AS n_events, count(*) AS n_incidents, count(*) FILTER (verdict = 'CONFIRMED') AS n_confirmed,
       count(*) FILTER (verdict = 'LIKELY_FP') AS n_fp FROM judged"""

# --- CSV profile --------------------------------------------------------------------------------------------

ORACLES["profile_mapping"] = f"""{_v()}
SELECT column_name, mapped_to, status, n_filled FROM (VALUES
  ('@timestamp', 'timestamp', 'mapped', (SELECT count(*) FROM v)), ('rule_id', 'rule.id', 'mapped', (SELECT count(*) FROM v)),
  ('Rule_Level', 'rule.level', 'mapped', (SELECT count(*) FROM v)), ('rule.groups', 'rule.groups', 'mapped', (SELECT count(*) FROM v)),
  ('agent_name', 'agent.name', 'mapped', (SELECT count(dst_host) FROM v)), ('src_ip', 'data.srcip', 'mapped', (SELECT count(*) FROM v)),
  ('dstport', 'data.dstport', 'mapped', (SELECT count(*) FROM v)), ('data_dstuser', 'data.dstuser', 'mapped', (SELECT count(user_name) FROM v)),
  ('agent', 'agent', 'unmapped', (SELECT count(*) FILTER (event_id % 5 = 0) FROM v)), ('message', 'full_log', 'mapped', (SELECT count(*) FROM v))
) t(column_name, mapped_to, status, n_filled)"""
ORACLES["profile_values"] = f"""{_v()}, c AS (
  SELECT strftime(make_timestamp(us), '%Y-%m-%d') AS "date", strftime(make_timestamp(us - us % 1000000), '%H:%M:%S') AS "time",
         'FW' || CAST(k AS VARCHAR) AS hostname, coalesce(src_ip, '') AS "SourceIP", dst_ip AS dest_ip, CAST(dst_port AS VARCHAR) AS "DestPort",
         protocol, action AS fw_action, 'traffic' AS log_type, '-' AS subtype FROM v)
SELECT column_name, count(DISTINCT value) AS n_distinct, count(*) FILTER (value <> '') AS n_filled
FROM (UNPIVOT c ON COLUMNS(*) INTO NAME column_name VALUE value) GROUP BY column_name"""
ORACLES["profile_suggestions"] = f"""{_v()}
SELECT 'agent' AS column_name, string_agg('{{"name":"OVERRIDE","id":"9"}}', ', ') AS samples
FROM (SELECT event_id FROM v WHERE event_id % 5 = 0 ORDER BY event_id LIMIT 3)"""
ORACLES["profile_yield"] = f"""{_v()}
SELECT count(*) AS total_rows, count(*) FILTER (event_id % 11 <> 0) AS parsed, count(*) FILTER (event_id % 11 = 0) AS skipped,
       round(count(*) FILTER (event_id % 11 <> 0) / count(*) * 100, 1) AS percent FROM v"""
ORACLES["profile_normalize"] = f"""{_v()}
SELECT CASE WHEN event_id % 4 <> 0 THEN 'ok' ELSE 'invalid Wazuh timestamp: ''soon''' END AS outcome, count(*) AS n_rows
FROM v WHERE event_id % 11 <> 0 GROUP BY ALL"""

# --- suppression and the whole pipeline ------------------------------------------------------------------------


def _kept(incidents: str) -> str:
    """Greedy suppression in rounds; ``status`` 0 undecided, 1 kept, 2 dropped."""
    return f"""{incidents},
ranked AS MATERIALIZED (SELECT id, event_count, row_number() OVER (ORDER BY event_count DESC, id) AS r FROM inc),
held AS MATERIALIZED (SELECT r, event_id FROM mem JOIN ranked USING (id)),
rounds AS (
  SELECT 0 AS round, r, event_count, 0 AS status FROM ranked
  UNION ALL
  SELECT s.round + 1, s.r, s.event_count,
         CASE WHEN s.status <> 0 THEN s.status WHEN c.sure > s.event_count * 0.5 THEN 2
              WHEN c.possible <= s.event_count * 0.5 THEN 1 ELSE 0 END
  FROM rounds s JOIN (
    SELECT h.r, count(*) FILTER (e.kept < h.r) AS sure, count(*) FILTER (e.alive < h.r) AS possible
    FROM held h JOIN (
      SELECT event_id, min(h2.r) FILTER (s2.status = 1) AS kept, min(h2.r) FILTER (s2.status <> 2) AS alive
      FROM held h2 JOIN rounds s2 ON s2.r = h2.r GROUP BY event_id) e ON e.event_id = h.event_id
    GROUP BY h.r) c ON c.r = s.r
  WHERE (SELECT count(*) FROM rounds WHERE status = 0) > 0),
kept AS MATERIALIZED (
  SELECT ranked.id, ranked.event_count FROM ranked
  JOIN (SELECT r, max(status) AS status FROM rounds GROUP BY r) last ON last.r = ranked.r AND last.status = 1)"""


for _suffix, _squeeze in (("", NORMAL), ("_dense", DENSE)):
    ORACLES[f"suppress_overlapping{_suffix}"] = f"""{_kept(incidents_sql(_squeeze))}
SELECT id, event_count FROM kept"""
ORACLES["correlate_membership"] = f"""{_kept(incidents_sql())}
SELECT id, event_id FROM mem JOIN kept USING (id)"""
ORACLES["analyze_flagship"] = f"""{_kept(profiles_sql())}
SELECT row_number() OVER (ORDER BY judged.event_count DESC, n_ips DESC, id) AS rank, id, rule_idx, key, start_us, end_us,
       judged.event_count, n_ips, pattern, confidence, verdict FROM judged JOIN kept USING (id)"""
