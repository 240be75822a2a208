"""Plain-Python model of windows and suppression, the oracle for small event sets."""

from __future__ import annotations


def anchored(times, window_us):
    """Window number of each time in a sorted list."""
    numbers, start = [], None
    for us in times:
        if start is None or us - start > window_us:
            start = us
            numbers.append((numbers[-1] + 1) if numbers else 0)
        else:
            numbers.append(numbers[-1])
    return numbers


def candidates(events, rules):
    """``events``: dicts with us, event_id and key fields.  Returns incidents in id
    order as dicts with id, rule_idx, key, ids, start, end."""
    ordered = sorted(events, key=lambda e: (e["us"], e["event_id"]))
    found = []
    for idx, rule in enumerate(rules):
        groups = {}
        for event in ordered:
            parts = [event[name] for name in rule.key_fields]
            if None not in parts:
                groups.setdefault(tuple(str(p) for p in parts), []).append(event)
        for key, members in groups.items():
            windows = {}
            numbers = anchored([m["us"] for m in members], rule.window_us)
            for number, event in zip(numbers, members, strict=True):
                windows.setdefault(number, []).append(event)
            for part in windows.values():
                if len(part) >= rule.min_events:
                    found.append({
                        "id": len(found) + 1, "rule_idx": idx, "key": key,
                        "ids": [e["event_id"] for e in part],
                        "start": part[0]["us"], "end": part[-1]["us"],
                    })
    return found


def suppress(incidents):
    covered, kept = set(), []
    for incident in sorted(incidents, key=lambda i: (-len(i["ids"]), i["id"])):
        ids = set(incident["ids"])
        if len(ids & covered) > len(ids) * 0.5:
            continue
        covered |= ids
        kept.append(incident)
    return kept
