"""Address and port predicates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch.fixed_values import PROTOCOL_NAMES, SENSITIVE_PORTS

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _ipv6_pattern() -> str:
    group = "[0-9a-fA-F]{1,4}"
    forms = [f"(?:{group}:){{7}}{group}", f"(?:{group}:){{6}}{_IPV4}"]
    for left in range(8):
        head = f"{group}(?::{group}){{{left - 1}}}" if left else ""
        right = 7 - left
        tail = f"(?:{group}(?::{group}){{0,{right - 1}}})?" if right else ""
        forms.append(f"{head}::{tail}")
        if left <= 5:
            forms.append(f"{head}::(?:{group}:){{0,{5 - left}}}{_IPV4}")
    return "|".join(forms)


_ANY_IPV4 = rf"\A{_IPV4}\z"
_ANY_IPV6 = rf"\A(?:{_ipv6_pattern()})\z"
_INTERNAL = r"\A(?:10\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.)"
_DOTTED_QUAD = r"\A[0-9]+(?:\.[0-9]+){3}\z"


def looks_like_ip(column: Column) -> Column:
    """IPv4 or IPv6 literal; a zone id after ``%`` is ignored.  NULL is False."""
    address = F.split_part(F.trim(column), F.lit("%"), F.lit(1))
    valid = F.when(address.contains(":"), address.rlike(_ANY_IPV6)).otherwise(
        address.rlike(_ANY_IPV4)
    )
    return F.coalesce(valid, F.lit(False))


def is_internal_ip(column: Column) -> Column:
    """RFC 1918 prefix.  NULL is False."""
    return F.coalesce(column.rlike(_INTERNAL), F.lit(False))


def is_dotted_quad(column: Column) -> Column:
    """Four dot-separated numbers, ranges unchecked.  NULL is False."""
    return F.coalesce(column.rlike(_DOTTED_QUAD), F.lit(False))


def is_external_ip(column: Column) -> Column:
    return is_dotted_quad(column) & ~is_internal_ip(column)


def is_sensitive_port(column: Column, ports: list[int] = SENSITIVE_PORTS) -> Column:
    return F.coalesce(column.isin(ports), F.lit(False))


def protocol_name(number: Column) -> Column:
    """Name of a protocol number, or the number as text."""
    named = F.coalesce(
        *[F.when(number == key, F.lit(name)) for key, name in PROTOCOL_NAMES.items()]
    )
    return F.coalesce(named, number.cast("string"))


def trust_entries(config: Mapping | None) -> list[str]:
    """Addresses and subnets of both trust sections, sorted and without repeats."""
    found: set[str] = set()
    for section in ("known_scanners", "trusted_hosts"):
        part = (config or {}).get(section) or {}
        for kind in ("ips", "subnets"):
            found.update(e for e in part.get(kind) or [] if isinstance(e, str))
    return sorted(found)
