"""One invented day at a harbour office, and the incidents that follow from the rules.

Each activity has addresses of its own, so its incident can be derived by hand:

* survey: 12 refused ports on one machine, in office hours
* backup: three evenly spaced reports of a scheduled backup, in office hours
* burst: 120 transfers outwards in one instant, in the evening
* rights: four group changes, in the evening
* guessing: 22 failed logons of four users from outside, in the evening, while the
  firewall refuses six connections of the same address
* lone: two unrelated records that belong to no incident
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta

GUESSER = "198.51.100.23"
CLOSED_PORTS = (21, 25, 53, 80, 110, 143, 389, 443, 636, 993, 995, 8088)
NAMES = ("m.ono", "k.berg", "t.adeyemi", "postgres")


def at(clock: str, seconds: int = 0) -> datetime:
    return datetime.fromisoformat(f"2027-03-16T{clock}:00") + timedelta(seconds=seconds)


def report(when, machine, address, rule, level, words, **data) -> str:
    """One HIDS record of a machine."""
    return json.dumps({
        "timestamp": f"{when:%Y-%m-%dT%H:%M:%S}Z",
        "agent": {"name": machine, "ip": address},
        "rule": {"id": rule, "level": level, "description": words},
        "data": data,
        "full_log": f"{machine}: {words}",
    })


def packet(when, source, target, port, verb) -> str:
    return (
        f'devname="harbour-gw" type="traffic" date={when:%Y-%m-%d} time={when:%H:%M:%S} '
        f"action={verb} srcip={source} dstip={target} dstport={port} proto=6"
    )


def hids() -> list[str]:
    backup = [
        report(at("03:00", 400 * i), "tide-db", "10.40.3.4", "900401", 3,
               "Scheduled backup of the tide tables", srcip="10.40.3.3")
        for i in range(3)
    ]
    rights = [
        report(at("14:00", 60 * i), "berth-app", "10.40.7.30", "900812", 10,
               "User added to group wheel", srcip="10.40.7.12", dstuser="o.lind")
        for i in range(4)
    ]
    lone = [
        report(at(clock), "gate-kiosk", "10.40.8.1", "900100", 2, "Door opened", srcip="10.40.8.8")
        for clock in ("05:00", "07:30")
    ]
    return backup + rights + lone


def firewall() -> list[str]:
    survey = [
        packet(at("02:10", 5 * i), "10.40.2.9", "10.40.2.200", port, "deny")
        for i, port in enumerate(CLOSED_PORTS)
    ]
    burst = [packet(at("13:30"), "10.40.9.77", "198.51.100.201", 8443, "accept")] * 120
    refused = [packet(at("15:00", 10 + 60 * i), GUESSER, "10.40.1.8", 5985, "deny") for i in range(6)]
    return survey + burst + refused


def windows() -> list[str]:
    return [
        report(at("15:00", 20 * i), "quay-srv", "10.40.1.8", "60122", 5, "Logon failure",
               srcip=GUESSER, dstuser=NAMES[i % len(NAMES)])
        for i in range(22)
    ]


# id, rule index, events, pattern, indicator codes, score, verdict - in output order.
# Ids: candidates by rule, then by the first event of their key.
BURST = (120, "DATA_EXFIL", "TP0a TP0b TP1 TP5 TP6", 15, "FALSE_POSITIVE")
SURVEY = (12, "PORT_SCAN", "FP2", 40, "LIKELY_FP")
RIGHTS = (4, "PRIV_ESCALATION", "TP5", 60, "LIKELY_TRUE")
BACKUP = (3, "UNKNOWN", "FP2 FP4 FP7", 0, "FALSE_POSITIVE")
EXPECTED = {
    "hids": [(2, 0, *RIGHTS), (1, 0, *BACKUP)],
    "firewall": [
        (2, 2, *BURST),
        (1, 2, *SURVEY),
        (3, 2, 6, "UNKNOWN", "TP1 TP2 TP5 TP8", 92, "CONFIRMED"),
    ],
    "windows": [(1, 0, 22, "BRUTE_FORCE", "TP1 TP3 TP4 TP5 TP9", 100, "CONFIRMED")],
    "all": [
        (6, 2, *BURST),
        (7, 2, 28, "BRUTE_FORCE", "TP1 TP2 TP3 TP4 TP5 TP8 TP9 TP10", 100, "CONFIRMED"),
        (5, 2, *SURVEY),
        (2, 0, *RIGHTS),
        (1, 0, *BACKUP),
    ],
}
CANDIDATES = {"hids": 4, "firewall": 10, "windows": 4, "all": 16}
