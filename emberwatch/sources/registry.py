"""Registered sources: how to read a kind and how to normalize it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from emberwatch.operators.normalize import (
    normalize_firewall,
    normalize_hids,
    normalize_windows,
)
from emberwatch.sources.firewall import parse_firewall_lines, read_firewall_syslog
from emberwatch.sources.json_lines import (
    parse_hids_alerts,
    parse_windows_events,
    read_hids_alerts,
    read_windows_events,
)

ReadFn = Callable[[SparkSession, object], DataFrame]
NormalizeFn = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Source:
    """``read`` yields lineage, ``doc`` and ``reject_reason``; ``normalize`` yields the
    event columns and ``normalize_error``.  ``parse`` does the work of ``read`` on lines
    with lineage; a source that has it can be tailed."""

    name: str
    read: ReadFn
    normalize: NormalizeFn
    parse: NormalizeFn | None = None


_SOURCES: dict[str, Source] = {}


def register_source(
    name: str, read: ReadFn, normalize: NormalizeFn, parse: NormalizeFn | None = None
) -> None:
    _SOURCES[name] = Source(name, read, normalize, parse)


def get_source(name: str) -> Source | None:
    return _SOURCES.get(name)


def source_names() -> list[str]:
    return sorted(_SOURCES)


register_source("wazuh", read_hids_alerts, normalize_hids, parse_hids_alerts)
register_source("fortigate", read_firewall_syslog, normalize_firewall, parse_firewall_lines)
register_source("windows", read_windows_events, normalize_windows, parse_windows_events)
