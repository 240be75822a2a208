"""The EVENT view: security-log shaped rows derived from the ``events`` table.

The thirty days of ``events`` are compressed so that 15-minute windows fill.
The same text runs on both engines; only the epoch function differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VIEW = """
SELECT event_id, us, k, source, src_ip, dst_ip, dst_host, dst_port, user_name, process,
       CASE WHEN event_id % 3 = 2 AND process IS NOT NULL THEN 'WS' || CAST(k AS STRING) END AS src_host,
       CASE event_type WHEN 'error' THEN 'login_failed' WHEN 'view' THEN 'login_success'
            WHEN 'signup' THEN 'user_created' WHEN 'click' THEN 'process_create'
            ELSE 'connection_allowed' END AS action,
       CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'success'
            WHEN 'purchase' THEN 'allowed' END AS result,
       CASE event_id % 2 WHEN 0 THEN 'TCP' ELSE 'UDP' END AS protocol,
       CAST(1 + event_id % 4 AS INT) AS severity,
       CASE WHEN event_id % 101 = 0 THEN 'Scheduled backup' ELSE 'rule ' || event_type END AS rule_description,
       CASE WHEN event_id % 997 = 0 THEN 'user-agent: Nessus' ELSE '' END AS full_log
FROM (
  SELECT event_id, event_type, k,
         1704067200000000 + CAST((us0 - us0 % {squeeze}) / {squeeze} AS BIGINT) AS us,
         CASE event_id % 3 WHEN 0 THEN 'wazuh' WHEN 1 THEN 'fortigate' ELSE 'windows' END AS source,
         CASE WHEN k < 10 THEN '203.0.113.' || CAST(k AS STRING)
              WHEN k < 25 THEN '10.0.1.' || CAST(k AS STRING)
              WHEN k < 38 THEN '192.168.5.' || CAST(k AS STRING) END AS src_ip,
         '10.0.0.' || CAST(event_id % 4 AS STRING) AS dst_ip,
         CASE WHEN event_id % 17 <> 0 THEN 'HOST' || CAST(event_id % 6 AS STRING) END AS dst_host,
         CAST(CASE event_id % 13 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 3389
              WHEN 4 THEN 445 WHEN 5 THEN 8080 WHEN 6 THEN 21 WHEN 7 THEN 25 WHEN 8 THEN 53
              WHEN 9 THEN 110 WHEN 10 THEN 143 WHEN 11 THEN 5985 ELSE 0 END AS INT) AS dst_port,
         CASE WHEN event_type IN ('error', 'view', 'signup') THEN
              CASE event_id % 7 WHEN 0 THEN 'Administrator' WHEN 1 THEN 'root' WHEN 2 THEN 'alice'
                   WHEN 3 THEN 'bob' WHEN 4 THEN 'svc_web' WHEN 5 THEN 'admin' END END AS user_name,
         CASE WHEN event_type = 'click' AND event_id % 9 = 0 THEN 'powershell -enc AAAA'
              WHEN event_type = 'click' AND event_id % 9 = 1 THEN 'taskeng.exe /run'
              WHEN event_type = 'click' THEN 'notepad.exe' END AS process
  FROM (SELECT event_id, event_type, user_id % 40 AS k, {micros} - 1704067200000000 AS us0 FROM {table}) a
) b
"""

NORMAL, DENSE = 60, 600

# A quarter of the events are transfers to one address in one instant of the evening, a
# quarter are group changes; the rest is as it was.
_PLANTED = """
SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 1704118500000000 ELSE us END AS us, k, source,
       CASE WHEN event_id % 4 = 1 THEN '10.77.0.' || CAST(event_id % 12 AS STRING) ELSE src_ip END AS src_ip,
       CASE WHEN event_id % 4 = 1 THEN '198.51.100.7' ELSE dst_ip END AS dst_ip,
       CASE WHEN event_id % 4 = 1 THEN 'OUTSIDE' WHEN event_id % 4 = 2 THEN 'DIRECTORY' ELSE dst_host END AS dst_host,
       CASE WHEN event_id % 4 IN (1, 2) THEN CAST(0 AS INT) ELSE dst_port END AS dst_port,
       CASE WHEN event_id % 4 IN (0, 3) THEN user_name END AS user_name,
       CASE WHEN event_id % 4 IN (0, 3) THEN process END AS process,
       CASE WHEN event_id % 4 IN (0, 3) THEN src_host END AS src_host,
       CASE WHEN event_id % 4 = 1 THEN 'connection_allowed' WHEN event_id % 4 = 2 THEN 'user_added_to_group'
            ELSE action END AS action,
       CASE WHEN event_id % 4 IN (0, 3) THEN result END AS result,
       protocol, severity, rule_description, full_log
FROM ({view}) c
"""
PLANTED = -1


def _view_text(squeeze: int, micros: str, table: str) -> str:
    if squeeze == PLANTED:
        return _PLANTED.format(view=_VIEW.format(squeeze=NORMAL, micros=micros, table=table))
    return _VIEW.format(squeeze=squeeze, micros=micros, table=table)


def view_sql(squeeze: int = NORMAL) -> str:
    """The view for DuckDB."""
    return _view_text(squeeze, "epoch_us(ts)", "events").strip()


TASK_ROWS = 250_000  # parsing a row of the view takes a good part of a millisecond


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when a table arrives as fewer splits than cores, and no task
    more rows than ``TASK_ROWS``."""
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def view(spark: SparkSession, sf_dir: str, squeeze: int = NORMAL) -> DataFrame:
    """The view as plain columns."""
    events = spread(
        spark.read.parquet(f"{sf_dir}/events.parquet").select(
            "event_id", "event_type", "user_id", F.expr("CAST(ts AS TIMESTAMP) AS ts")
        )
    )
    sql = _view_text(squeeze, "unix_micros(ts)", "{events}")
    return spark.sql(sql, events=events)


def events(spark: SparkSession, sf_dir: str, squeeze: int = NORMAL) -> DataFrame:
    """The view in the event schema the operators take."""
    rows = view(spark, sf_dir, squeeze)
    return rows.select(
        "event_id",
        F.timestamp_micros("us").alias("timestamp"),
        "source",
        "src_host",
        "src_ip",
        "dst_ip",
        "dst_host",
        "dst_port",
        F.col("user_name").alias("user"),
        "process",
        "action",
        "result",
        "protocol",
        "severity",
        F.struct("rule_description").alias("extra"),
        F.col("full_log").alias("raw_event"),
        "full_log",
        F.lit("").alias("user_agent"),
    )
