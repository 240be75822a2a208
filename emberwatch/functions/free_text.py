"""Field extraction from free log text, the fallback for unstructured alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch.fixed_values import (
    FREE_TEXT_ACTIONS,
    IPV4_IN_TEXT_PATTERN,
    KEY_VALUE_PATTERN_FREE_TEXT,
    SSH_FAILURE_PATTERN,
)
from emberwatch.functions.text import first_truthy, let, truthy

# Java needs to be told: Unicode classes, and only \n ends a line.
_FLAGS = "(?Ud)"


def _extract_all(text: Column, pattern: str, group: int) -> Column:
    """All matches; Unicode-aware matching is slow and only matters beyond ASCII."""
    plain, unicode_aware = (
        F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group)) for flags in ("", "(?U)")
    )
    return F.when(F.octet_length(text) == F.length(text), plain).otherwise(unicode_aware)


def key_value_pairs(text: Column, pattern: str = KEY_VALUE_PATTERN_FREE_TEXT) -> Column:
    """``key=value`` pairs in order, keys lower-cased, quotes stripped from values."""
    return F.transform(
        F.arrays_zip(
            _extract_all(text, pattern, 1).alias("k"), _extract_all(text, pattern, 2).alias("v")
        ),
        lambda pair: F.struct(
            F.lower(pair["k"]).alias("k"),
            F.btrim(F.btrim(pair["v"], F.lit('"')), F.lit("'")).alias("v"),
        ),
    )


def _last_value(pairs: Column, key: str) -> Column:
    return F.try_element_at(F.filter(pairs, lambda p: p["k"] == key), F.lit(-1))["v"]


def routable_addresses(text: Column) -> Column:
    found = _extract_all(text, IPV4_IN_TEXT_PATTERN, 1)
    return F.filter(found, lambda ip: ~ip.rlike(r"\A(0|127|255)\."))


def ssh_failure(text: Column, group: int) -> Column:
    """1 user, 2 address, 3 port of a failed-password line, else NULL."""
    found = F.regexp_extract(text, _FLAGS + r"\A" + SSH_FAILURE_PATTERN, group)
    # The pattern begins with anything, so texts without its words take long to fail.
    return F.when(text.contains("ailed password for "), truthy(found))


def extract_from_text(text: Column) -> Column:
    """Struct of what the text tells: srcip, dstip, dstport, srcport, proto, action,
    severity, user, devname."""
    user, address, port = (ssh_failure(text, group) for group in (1, 2, 3))
    found = F.struct(
        key_value_pairs(text).alias("pairs"),
        routable_addresses(text).alias("addresses"),
        user.alias("user"),
        address.alias("address"),
        port.alias("port"),
    )
    return let(found, _combined)


def _combined(found: Column) -> Column:
    """What the pieces found in a text say together."""
    pairs = F.when(F.size(found["pairs"]) >= 5, found["pairs"])
    addresses = found["addresses"]
    is_ssh = found["user"].isNotNull()
    verb = F.lower(
        F.try_element_at(
            F.filter(
                pairs,
                lambda p: (p["k"] == "action") & F.lower(p["v"]).isin(FREE_TEXT_ACTIONS),
            ),
            F.lit(-1),
        )["v"]
    )
    pair_severity = F.when(verb.isin("deny", "block"), 3).when(verb.isNotNull(), 2)
    return F.struct(
        F.coalesce(
            first_truthy(_last_value(pairs, "srcip"), found["address"]),
            F.try_element_at(addresses, F.lit(1)),
        ).alias("srcip"),
        F.coalesce(
            truthy(_last_value(pairs, "dstip")),
            F.when(F.size(addresses) > 1, F.try_element_at(addresses, F.lit(-1))),
        ).alias("dstip"),
        first_truthy(_last_value(pairs, "dstport"), found["port"]).alias("dstport"),
        _last_value(pairs, "srcport").alias("srcport"),
        _last_value(pairs, "proto").alias("proto"),
        F.when(is_ssh, F.lit("login_failed"))
        .when(verb == "accept", F.lit("connection_allowed"))
        .when(verb.isNotNull(), F.lit("connection_blocked"))
        .alias("action"),
        F.coalesce(pair_severity, F.when(is_ssh, F.lit(3))).alias("severity"),
        found["user"].alias("user"),
        _last_value(pairs, "devname").alias("devname"),
    )
