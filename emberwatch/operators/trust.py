"""The trust list as a table, joined to distinct addresses.

The list is rows, never part of a plan, so it may have any length.  ``prefix`` takes each
entry, without any ``0/``, as a text prefix: an address joins on all its prefixes.
``cidr`` is containment in networks of both address families: an address is 128 bits (IPv4
the first 32 of them) and joins on these bits cut to each prefix length that the list has,
of which there are at most 33 and 129.  Both are equi-joins, and only distinct addresses
take part in them.

An entry that is neither an address nor a network contains no address; an address that is
none is in no network.  IPv4 addresses written as IPv6 (``::ffff:10.0.0.1``) are IPv6.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions.network import trust_entries
from emberwatch.storage import stage

Trust = Mapping | DataFrame | None
MATCHES = ("prefix", "cidr")
_BITS = "family int, size int, high long, low long"


def trust_table(spark: SparkSession, trust: Trust) -> DataFrame | None:
    """The entries as distinct rows (``entry``); None when there is no list.

    ``trust`` is a trust document or a table whose first column has the entries.
    """
    if isinstance(trust, DataFrame):
        first = F.col(f"`{trust.columns[0]}`").cast("string")
        return trust.select(first.alias("entry")).where("entry is not null").distinct()
    entries = trust_entries(trust)
    if not entries:
        return None
    return stage(spark.createDataFrame([(entry,) for entry in entries], "entry string"), "trust")


def _halves(family: int, number: int) -> tuple[int, int]:
    """The address as the high and low half of 128 bits, as signed numbers."""
    bits = number << 96 if family == 4 else number
    return tuple((half ^ (1 << 63)) - (1 << 63) for half in (bits >> 64, bits & (1 << 64) - 1))


def _parsed(text: str) -> tuple[int, int, int, int] | None:
    """family, prefix length and both halves of an address or network."""
    try:
        network = ipaddress.ip_network(text.strip().partition("%")[0], strict=False)
    except ValueError:
        return None
    return network.version, network.prefixlen, *_halves(network.version, int(network.network_address))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["text", "family", "size", "high", "low"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    for batch in batches:
        found = [(text, *parsed) for text in batch.column(0).to_pylist() if (parsed := _parsed(text))]
        columns = list(zip(*found, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
        )


def _cut(size: Column) -> Column:
    """The first ``size`` of an address's 128 bits."""
    # A shift of 64 would be one of 0.
    high = F.when(size == 0, 0).when(size >= 64, F.col("high")).otherwise(
        F.expr("shiftright(high, 64 - cut) << (64 - cut)")
    )
    low = F.when(size <= 64, 0).when(size == 128, F.col("low")).otherwise(
        F.expr("shiftright(low, 128 - cut) << (128 - cut)")
    )
    return F.struct(F.col("family"), size.alias("size"), high.cast("long").alias("high"), low.cast("long").alias("low"))


def _contained(addresses: DataFrame, entries: DataFrame) -> DataFrame:
    networks = stage(entries.mapInArrow(_parse, f"text string, {_BITS}").drop("text").distinct(), "networks")
    sizes = {4: [], 6: []}
    for row in networks.select("family", "size").distinct().collect():  # 162 at most
        sizes[row["family"]].append(row["size"])
    listed = {f: F.array(*[F.lit(s) for s in sorted(found)]).cast("array<int>") for f, found in sizes.items()}
    single = addresses.where(~F.col("ip").contains("/")).mapInArrow(_parse, f"ip string, {_BITS}").drop("size")
    cuts = single.withColumn(
        "cut", F.explode(F.when(F.col("family") == 4, listed[4]).otherwise(listed[6]))
    )
    keyed = cuts.select("ip", _cut(F.col("cut")).alias("key")).select("ip", "key.*")
    return keyed.join(networks, ["family", "size", "high", "low"], "left_semi").select("ip").distinct()


def _starting(addresses: DataFrame, entries: DataFrame) -> DataFrame:
    prefixes = entries.select(F.replace("entry", F.lit("0/"), F.lit("")).alias("start")).distinct()
    sizes = F.sequence(F.lit(0), F.char_length("ip"))
    starts = addresses.select("ip", F.explode(sizes).alias("n")).select(
        "ip", F.substring("ip", F.lit(1), F.col("n")).alias("start")
    )
    by_start = starts.join(prefixes, "start", "left_semi").select("ip")
    exact = addresses.join(entries, F.col("ip") == F.col("entry"), "left_semi").select("ip")
    return by_start.unionByName(exact).distinct()


def trusted_addresses(addresses: DataFrame, entries: DataFrame | None, match: str = "prefix") -> DataFrame:
    """The distinct addresses (``ip``) that an entry covers."""
    if match not in MATCHES:
        raise ValueError(f"unknown trust match: {match!r}")
    distinct = addresses.select("ip").where(F.col("ip").isNotNull()).distinct()
    if entries is None:
        return distinct.limit(0)
    return _contained(distinct, entries) if match == "cidr" else _starting(distinct, entries)
