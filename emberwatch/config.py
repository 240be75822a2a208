"""Configuration documents: trust list, column mappings, pattern rules.

Each loader takes a mapping or the path of a YAML (or JSON) file.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from emberwatch.fixed_values import PATTERN_THRESHOLDS
from emberwatch.operators.detect import PatternRules
from emberwatch.sources.csv_export import lower_keys


def load_document(source: Mapping | str | Path | None) -> dict:
    if source is None:
        return {}
    if isinstance(source, Mapping):
        return dict(source)
    text = Path(source).read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:
        return json.loads(text) or {}
    return yaml.safe_load(text) or {}


def load_mappings(source: Mapping | str | Path | None) -> dict | None:
    """Column mappings with lower-case keys; None means the defaults."""
    return None if source is None else lower_keys(load_document(source))


def load_pattern_rules(source: Mapping | str | Path | None) -> PatternRules:
    """Pattern rules from a ``patterns:`` document.

    By default the built-in constants decide; a document given here overrides the
    ones it names.
    """
    by_name = {entry["name"]: entry for entry in load_document(source).get("patterns", [])}
    thresholds = dict(PATTERN_THRESHOLDS)
    places = {
        "brute_force_failures": ("brute_force", "min_events"),
        "port_scan_ports": ("port_scan", "min_unique_ports"),
        "port_scan_minutes": ("port_scan", "window_minutes"),
        "escalation_severity": ("priv_escalation", "min_severity"),
        "lateral_hosts": ("lateral_movement", "min_unique_dst_hosts"),
        "exfil_events": ("data_exfil", "min_events"),
        "exfil_minutes": ("data_exfil", "window_minutes"),
    }
    for name, (pattern, field) in places.items():
        thresholds[name] = by_name.get(pattern, {}).get(field, thresholds[name])
    built_in = PatternRules()
    words = by_name.get("suspicious_process", {}).get("process_keywords")
    action = by_name.get("priv_escalation", {}).get("action")
    ports = by_name.get("lateral_movement", {}).get("dst_ports")
    return PatternRules(
        thresholds=thresholds,
        suspicious_words=tuple(words or built_in.suspicious_words),
        escalation_actions=(action,) if action else built_in.escalation_actions,
        lateral_ports=tuple(ports or built_in.lateral_ports),
    )
