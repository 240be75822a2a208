"""Firewall syslog: one ``key=value`` line per record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.fixed_values import FIREWALL_NUMERIC_FIELDS, KEY_VALUE_PATTERN
from emberwatch.functions.documents import as_text, computed_once
from emberwatch.functions.text import safe_int
from emberwatch.session import prepare_for_parsing
from emberwatch.sources.json_lines import members
from emberwatch.sources.lines import read_lines, stripped

FIELDS = [
    "timestamp", "eventtime", "date", "time", "tz", "srcip", "dstip", "srcport",
    "dstport", "devname", "proto", "action", "type", "subtype", "service",
    "policyid", "sentbyte", "rcvdbyte", "sentpkt", "rcvdpkt", "duration", "cpu",
    "mem", "disk", "logid", "full_log", "user_agent",
]


def _unquoted(value: Column) -> Column:
    quoted = value.startswith('"') | value.startswith("'")
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    return F.when(quoted, inner).otherwise(value)


def _last_occurrence(name: str) -> Column:
    """Value of the last pair with this key; the pairs are stored last first."""
    return F.get("values", (F.array_position("keys", name) - 1).cast("int"))


def parse_firewall_lines(lines: DataFrame) -> DataFrame:
    """``line`` to ``doc`` (the line), ``f`` (struct of texts), ``numbers`` (the
    numeric fields), ``local_time`` and ``reject_reason``."""
    prepare_for_parsing(lines.sparkSession)
    others = [name for name in lines.columns if name != "line"]
    doc = F.col("doc")
    trimmed = lines.select(*others, stripped(F.col("line")).alias("doc"))
    marked = doc.contains("devname=") | doc.contains("type=")
    # Unicode-aware matching is slow and only matters beyond ASCII.
    ascii_only = F.octet_length(doc) == F.length(doc)

    def matches(group: int) -> Column:
        found = [
            F.regexp_extract_all(doc, F.lit(flags + KEY_VALUE_PATTERN), F.lit(group))
            for flags in ("", "(?U)")
        ]
        return F.when(
            marked, F.reverse(F.when(ascii_only, found[0]).otherwise(found[1]))
        )

    pairs = trimmed.select(
        *others,
        "doc",
        matches(1).alias("keys"),
        F.transform(matches(2), _unquoted).alias("values"),
    )
    reason = (
        F.when(doc == "", F.lit("blank"))
        .when(F.col("keys").isNull(), F.lit("no device or type marker"))
        .when(~F.array_contains("keys", "type"), F.lit("no type"))
    )
    fields = F.struct(*[_last_occurrence(name).alias(name) for name in FIELDS])
    return with_numbers(
        computed_once(
            pairs,
            *others,
            doc.alias("line"),
            "doc",
            fields.alias("f"),
            reason.alias("reject_reason"),
        )
    )


def with_numbers(df: DataFrame) -> DataFrame:
    numbers = [
        safe_int(F.col(f"f.{name}"), "bigint").alias(name)
        for name in FIREWALL_NUMERIC_FIELDS
    ]
    return df.withColumn("numbers", F.struct(*numbers)).withColumn(
        "local_time", F.concat("f.date", F.lit("T"), "f.time")
    )


def fields_from_documents(df: DataFrame) -> DataFrame:
    """The same shape from a JSON ``doc`` (CSV exports)."""
    parsed = computed_once(df, *df.columns, members(df, [(name,) for name in FIELDS]).alias("d"))
    fields = [as_text(F.col(f"d.{name}")).alias(name) for name in FIELDS]
    return with_numbers(computed_once(parsed, *df.columns, F.struct(*fields).alias("f")))


def read_firewall_syslog(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_firewall_lines(read_lines(spark, paths))
