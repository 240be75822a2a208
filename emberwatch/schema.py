"""Event schema shared by all sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Union of the source-specific fields; nested pruning reads only what is used.
EXTRA_FIELDS = {
    "rule_id": "string", "rule_level": "int", "rule_description": "string",
    "rule_groups": "array<string>", "mitre": "string", "location": "string",
    "event_id": "string", "logon_type": "string", "full_log": "string",
    "agent_id": "string", "manager": "string", "program": "string",
    "log_type": "string", "subtype": "string", "service": "string",
    "policy_id": "string", "sent_bytes": "bigint", "rcvd_bytes": "bigint",
    "duration": "bigint", "log_id": "string",
    "status": "string", "sub_status": "string", "log_name": "string",
    "provider": "string", "keywords": "string", "task": "string",
}

EVENT_FIELDS = {
    "timestamp": "timestamp", "source": "string", "src_host": "string",
    "src_ip": "string", "dst_ip": "string", "dst_host": "string", "dst_port": "int",
    "user": "string", "process": "string", "action": "string", "result": "string",
    "protocol": "string", "severity": "int",
    "extra": "struct<" + ",".join(f"{k}:{v}" for k, v in EXTRA_FIELDS.items()) + ">",
    "raw_event": "string", "full_log": "string", "user_agent": "string",
}

# What every raw record and every normalized row keeps about where it came from.
LINEAGE = ["file_name", "file_path", "block_start", "row_id"]
CARRIED = [*LINEAGE, "reject_reason"]


def extra(**values: Column) -> Column:
    """The ``extra`` struct with the given fields set."""
    unknown = values.keys() - EXTRA_FIELDS.keys()
    if unknown:
        raise ValueError(f"unknown extra fields: {sorted(unknown)}")
    return F.struct(
        *[
            values.get(name, F.lit(None)).cast(kind).alias(name)
            for name, kind in EXTRA_FIELDS.items()
        ]
    )


def event_columns(**values: Column) -> list[Column]:
    """All event columns in order, cast to their types."""
    return [
        values.get(name, F.lit(None)).cast(kind).alias(name)
        for name, kind in EVENT_FIELDS.items()
    ]
