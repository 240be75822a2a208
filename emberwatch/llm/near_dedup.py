"""Near deduplication: fast similarity sketches, banding, and exact verification.

A document's set is its distinct word shingles.  Sketching places every shingle, round
after round under a new hash, into one of ``COORDINATES`` bins; a bin keeps the smallest
(round, hash) it has seen.  A set stops as soon as all its bins are full; from round
``COORDINATES`` on, round i places everything into bin i, so that every coordinate is
filled after twice as many rounds at the latest.  Two sets agree in a coordinate with
the probability of their Jaccard similarity, with concentration as for independent
hashes.  ``BANDS`` bands of ``ROWS`` coordinates make candidates: two sets at the
threshold 0.8 miss all bands with probability (1 - 0.8^4)^24, about three in a million.

Verification is exact, on the full sets, and never compares all pairs of a group:

* Documents with equal sets are one node; nodes that share a band are a group.
* In a group, the ``HUBS`` nodes with the smallest sets are the hubs, and every node is
  compared with each of them, with the most similar one first.  A hub is done with its
  group then, and a group whose other nodes are in one component is done.
* The nodes of the others are grouped anew by shingles, so that linked nodes still meet:
  in the order of frequency among these nodes, two sets at the threshold share one of
  the first |set| - ceil(0.8 |set|) + 1 shingles.  Shingles of one node only come first
  and make no group, so most nodes drop out here.
* In these groups, hubs are the nodes beyond the group's largest component.  Rounds go
  on, each with twice as many hubs up to ``MOST_HUBS``, until no group has nodes of
  several components; every round takes its hubs out of their groups, so this ends.
  Pairs in one component are never compared.  Groups with the same nodes are one.
* Size and parity maps rule out a pair inside the join that would make it; only pairs
  that may be linked become rows.  The long map of a large set grows with it, as a short
  one tells nothing of sets that differ in more shingles than it has bits.
* Texts and full sets are moved only for rows that a filter of bounded size lets pass.

Cases: null or empty text, and text without words, has an empty set and is its own
component; fewer words than a shingle are one shingle; equal rows are one class; a row
with a null id is counted in no component: its component_id is null and it is kept;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import maybe_wanted, mix64, slices, utf8
from emberwatch.llm.components import connected
from emberwatch.storage import stage

SHINGLE = 4
THRESHOLD = 80  # per cent
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
# Nodes of a group that all its nodes are compared with at a time.
HUBS = 64
# The same in later rounds, at most.
MOST_HUBS = 1_000
PAIR = ["node", "hub", "m", "n", "differ"]
# 64-bit words of a set's short parity map.
MAP_WORDS = 8
# Shingles that are told to all tasks as one list, at most: those of most nodes.
FREQUENT = 1_024


# --- sets and sketches --------------------------------------------------------------------


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, ascending."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split()  # for bytes: A-Z, and the six ASCII white-space characters
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed = mix64(np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)))
    size = min(width, len(words))
    value = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + hashed[i : i + len(value)])
    return np.unique(value)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDINATES values for each set; rows of empty sets are infinite."""
    count, t = len(sets), COORDINATES
    bins = np.full(count * t, np.inf)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    values = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
    for turn in range(2 * t):
        if not len(values):
            break
        hashed = mix64(values + np.uint64((turn + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        at = (hashed % np.uint64(t)).astype(np.int64) if turn < t else np.int64(turn - t)
        # 53 bits of the hash as a fraction; bits that chose the bin hardly count.
        fraction = (hashed >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        np.minimum.at(bins, owner * t + at, turn + fraction)
        open_ = np.isinf(bins.reshape(count, t)).any(axis=1)[owner]
        owner, values = owner[open_], values[open_]
    return bins.reshape(count, t)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """BANDS hashes for each sketch."""
    bits = rows.view(np.uint64).reshape(len(rows), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(rows), BANDS))
    for i in range(ROWS):
        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + bits[:, :, i])
    return key.view(np.int64)


def _sketch(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, width) for t in utf8(batch.column(1))]
            keys = band_keys(sketches(sets)) if sets else np.zeros((0, BANDS), dtype=np.int64)
            digests = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            bands = pa.ListArray.from_arrays(
                np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()), bands,
                ],
                ["doc_id", "n_shingles", "class", "bands"],
            )

    return task


def parity_maps(found: np.ndarray) -> tuple[list[int], list[int] | None]:
    """The set's short parity map, a bit flipped for each shingle, and its long one.

    The long map has two to four bits for each shingle; a set that the short map is as
    long for has none.  Its halves, one flipped by the other, are the map of half its size.
    """
    words = max(MAP_WORDS, 1 << max(0, 2 * len(found) - 1).bit_length() >> 6)
    at = (found & np.uint64(64 * words - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=64 * words) & 1).astype(np.uint8)
    long = np.packbits(odd, bitorder="little").view("<i8")
    short = np.bitwise_xor.reduce(long.reshape(-1, MAP_WORDS), axis=0)
    return short.tolist(), long.tolist() if words > MAP_WORDS else None


def _sets(width: int):
    """Sets of the rows whose class is the wanted one, with their parity maps."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, sets, short, long = [], [], [], []
            columns = (batch.column(0).to_pylist(), batch.column(2).to_pylist())
            for node, wanted, text in zip(*columns, utf8(batch.column(1)), strict=True):
                found = shingle_set(text, width)
                if hashlib.md5(found.tobytes()).digest() == wanted:
                    nodes.append(node)
                    sets.append(found.view(np.int64))
                    for maps, one in zip((short, long), parity_maps(found), strict=True):
                        maps.append(one)
            arrays = [pa.array(x, pa.list_(pa.int64())) for x in (sets, short, long)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), *arrays], ["node", "shingles", "parity", "long_map"]
            )

    return task


# --- verification -------------------------------------------------------------------------


def _differ(a: Column, b: Column) -> Column:
    """Bits in which two long maps differ, at the smaller one's size; null if they cannot tell."""

    def folded(x: Column, to: Column) -> Column:
        half = F.size(to)
        halves = F.slice(x, F.lit(1), half), F.slice(x, half + 1, half)
        return F.when(F.size(x) > half, F.zip_with(*halves, lambda u, v: u.bitwiseXOR(v))).otherwise(x)

    flipped = F.zip_with(folded(a, b), folded(b, a), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    near = (F.size(a) <= 2 * F.size(b)) & (F.size(b) <= 2 * F.size(a))
    return F.when(near, F.aggregate(flipped, F.lit(0), lambda total, bits: total + bits))


def _several(members: DataFrame, components: DataFrame | None) -> DataFrame:
    """Groups that have nodes of several components, each set of nodes once: grp, node, component."""
    if components is None:
        found = members.withColumn("component", F.col("node"))
    else:
        found = members.join(components, "node", "left").withColumn(
            "component", F.coalesce("component", F.col("node"))
        )
    mixed = (
        found.groupBy("grp")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.bit_xor(F.xxhash64("node")).alias("sign1"),
            F.bit_xor(F.xxhash64(F.lit("second"), F.col("node"))).alias("sign2"),
            F.count(F.lit(1)).alias("size"),
        )
        .where("low != high")
        .groupBy("sign1", "sign2", "size")
        .agg(F.min("grp").alias("grp"))
        .select("grp")
    )
    return found.join(stage(mixed, "near_groups"), "grp", "left_semi")


def _hubs(members: DataFrame, measured: DataFrame, count: int, first: bool) -> DataFrame:
    """grp, hub, hub_component, n, hub_map, hub_long of each group's hubs.

    At first these are the smallest sets, later the smallest ones beyond the group's
    largest component, so that few nodes outside a large component are done at once.
    """
    able = members
    if not first:
        tally = members.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("size"))
        main = tally.groupBy("grp").agg(
            F.max_by("component", F.struct("size", "component")).alias("main")
        )
        able = members.join(main, "grp").where("component != main").drop("main")
    by_size = Window.partitionBy("grp").orderBy("n", "node")
    ranked = able.join(measured, "node").withColumn("place", F.row_number().over(by_size))
    return ranked.where(F.col("place") <= count).select(
        "grp",
        F.col("node").alias("hub"),
        F.col("component").alias("hub_component"),
        "n",
        F.col("parity").alias("hub_map"),
        F.col("long_map").alias("hub_long"),
    )


def _possible(members: DataFrame, hubs: DataFrame, measured: DataFrame, threshold: int) -> DataFrame:
    """Pairs of a node and a hub of its group that may be linked: node, hub, m, n, differ.

    Two sets differ in at least as many shingles as their parity maps differ in bits,
    so most pairs are told apart inside the join, and without moving a set.
    """
    nodes = members.join(measured.select("node", F.col("n").alias("m"), "parity", "long_map"), "node")
    m, n = F.col("m"), F.col("n")
    differ = F.lit(0)
    for i in range(MAP_WORDS):
        differ = differ + F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("hub_map")[i]))
    # Sets too small for long maps are told apart by the short ones alone.
    by_long = F.coalesce(_differ(F.col("long_map"), F.col("hub_long")), differ)
    return (
        nodes.join(hubs, "grp")
        .where("node != hub and component != hub_component")
        .where(F.least(m, n) * 100 >= F.greatest(m, n) * threshold)
        .where(differ * (100 + threshold) <= (m + n) * (100 - threshold))
        .where(by_long * (100 + threshold) <= (m + n) * (100 - threshold))
        .select("node", "hub", "m", "n", by_long.alias("differ"))
        .distinct()
    )


def _linked(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs (node, hub, m, n) that are linked, as (a, b), on the full sets."""
    once = pairs.select(
        F.least("node", "hub").alias("a"),
        F.greatest("node", "hub").alias("b"),
        (F.col("m") + F.col("n")).alias("both"),
    ).distinct()
    once = stage(once, "near_once")
    overlap = F.size(F.array_intersect("of_a", "of_b"))
    of_a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    of_b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    return (
        once.join(maybe_wanted(of_a, "a", once), "a")
        .join(maybe_wanted(of_b, "b", once), "b")
        .withColumn("overlap", overlap)
        .where(F.lit(100) * F.col("overlap") >= F.lit(threshold) * (F.col("both") - F.col("overlap")))
        .select("a", "b")
    )


def _between(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components, with low and high of the two."""
    of_node = components.select("node", F.col("component").alias("node_label"))
    of_hub = components.select(F.col("node").alias("hub"), F.col("component").alias("hub_label"))
    labels = F.coalesce("node_label", "node"), F.coalesce("hub_label", "hub")
    found = pairs.join(of_node, "node", "left").join(of_hub, "hub", "left")
    return found.select(*PAIR, F.least(*labels).alias("low"), F.greatest(*labels).alias("high")).where("low != high")


def _nearest_hub(pairs: DataFrame) -> DataFrame:
    """One pair of each node."""
    closest = F.min_by(F.struct("hub", "m", "n"), F.struct("differ", "hub")).alias("best")
    return pairs.groupBy("node").agg(closest).select("node", "best.*")


def _nearest_components(pairs: DataFrame) -> DataFrame:
    """One pair of each two components."""
    closest = F.min_by(F.struct("node", "hub", "m", "n"), F.struct("differ", "node", "hub")).alias("best")
    return pairs.groupBy("low", "high").agg(closest).select("best.*")


def _merged(links: DataFrame, components: DataFrame | None) -> DataFrame:
    """(node, component) with the links (a, b) added; only components are walked over."""
    if components is None:
        return stage(connected(links), "near_components")
    of_a = components.select(F.col("node").alias("a"), F.col("component").alias("label_a"))
    of_b = components.select(F.col("node").alias("b"), F.col("component").alias("label_b"))
    named = links.join(of_a, "a", "left").join(of_b, "b", "left")
    moved = connected(
        named.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    )
    target = moved.select(F.col("node").alias("component"), F.col("component").alias("target"))
    known = components.join(target, "component", "left").select(
        "node", F.coalesce("target", "component").alias("component")
    )
    added = moved.join(components, "node", "left_anti")
    return stage(known.unionByName(added), "near_components")


def _ordered(sets: DataFrame, threshold: int) -> DataFrame:
    """node, shared (shingles of several nodes, rare ones first), first (how many of them to use).

    ``first`` leaves out the nodes whose first shingles are all their own.
    """
    shingles = sets.select(F.explode("shingles").alias("shingle"))
    often = stage(
        shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1"), "near_often"
    )
    place = F.struct("nodes", "shingle")
    # The last ones in the order, which make most of the rows, need no join: they are one
    # bounded list, in which every node finds its own.
    last = often.where(F.col("nodes") > HUBS).select(place.alias("last")).orderBy(F.desc("last")).limit(FREQUENT)
    last = stage(last.agg(F.sort_array(F.collect_list("last"))["shingle"].alias("last")), "near_last")
    parts = sets.crossJoin(F.broadcast(last)).select(
        "node",
        F.size("shingles").alias("n"),
        F.array_except("shingles", "last").alias("others"),
        F.array_intersect("last", "shingles").alias("frequent"),
    )
    others = parts.select("node", F.explode("others").alias("shingle"))
    rare = (
        maybe_wanted(others, "shingle", often)
        .join(often, "shingle")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(place))["shingle"].alias("rare"))
    )
    n = F.col("n")
    prefix = n - F.ceil(n * threshold / 100) + 1
    shared = F.when(F.col("rare").isNull(), F.col("frequent")).otherwise(F.concat("rare", "frequent"))
    return (
        parts.select("node", "n", "frequent")
        .join(rare, "node", "left")
        .select("node", "n", shared.alias("shared"))
        .select("node", "shared", (prefix - (n - F.size("shared"))).cast("int").alias("first"))
        .where("first > 0 and size(shared) > 0")
    )


def verified_links(groups: DataFrame, sets: DataFrame, threshold: int) -> DataFrame | None:
    """(node, component) of all links at the threshold between nodes that share a group.

    ``groups`` has grp, node; ``sets`` has node, shingles, parity, long_map.
    """
    sizes = sets.select("node", F.size("shingles").alias("n"), "parity", "long_map")
    measured = stage(sizes, "near_sizes")
    components, first, count = None, True, HUBS
    members = stage(_several(groups, None), "near_members")
    while not members.isEmpty():
        hubs = stage(_hubs(members, measured, count, first), "near_hubs")
        pairs = stage(_possible(members, hubs, measured, threshold), "near_possible")
        if first:
            # A link with the most similar hub puts most nodes in their component, and one
            # link between two components is as good as all.
            for closest in (_nearest_hub, _nearest_components):
                links = stage(_linked(closest(pairs), sets, threshold), "near_linked")
                if links.isEmpty():
                    break
                components = _merged(links, components)
                pairs = stage(_between(pairs, components), "near_between")
        links = stage(_linked(pairs, sets, threshold), "near_linked")
        if not links.isEmpty():
            components = _merged(links, components)
        done = hubs.select("grp", F.col("hub").alias("node"))
        members = members.drop("component").join(done, ["grp", "node"], "left_anti")
        if first:
            open_ = stage(_several(members, components).select("node").distinct(), "near_open")
            full = maybe_wanted(sets.select("node", "shingles"), "node", open_).join(open_, "node")
            ordered = _ordered(stage(full, "near_open_sets"), threshold)
            members = stage(
                ordered.select(F.explode(F.slice("shared", F.lit(1), F.col("first"))).alias("grp"), "node"),
                "near_ordered",
            )
        else:
            count = min(2 * count, MOST_HUBS)
        members = stage(_several(members, components), "near_members")
        first = False
    return components


# --- the operator -------------------------------------------------------------------------


def near_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    threshold: int = THRESHOLD,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per input row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = stage(
        rows.mapInArrow(
            _sketch(shingle), "doc_id long, n_shingles long, class binary, bands array<long>"
        ),
        "near_sketches",
    )
    classes = stage(
        sketched.where("class is not null and doc_id is not null")
        .groupBy("class")
        .agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"))
        # Unique, and fixed once the table is written.
        .withColumn("node", F.monotonically_increasing_id()),
        "near_classes",
    )
    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = stage(
        banded.groupBy("band")
        .agg(F.count(F.lit(1)).alias("nodes"))
        .where("nodes > 1")
        .select("band"),
        "near_bands",
    )
    groups = stage(
        banded.join(shared, "band").select(F.col("band").alias("grp"), "node"), "near_banded"
    )
    wanted = stage(
        groups.select("node").distinct().join(classes, "node")
        .select("node", F.col("first_id").alias("doc_id"), "class"),
        "near_wanted",
    )
    sets = stage(
        maybe_wanted(rows, "doc_id", wanted)
        .join(wanted, "doc_id")
        .select("node", "text", "class")
        .mapInArrow(_sets(shingle), "node long, shingles array<long>, parity array<long>, long_map array<long>")
        .dropDuplicates(["node"]),
        "near_sets",
    )
    components = verified_links(groups, sets, threshold)
    if components is None:
        components = classes.select("node", F.col("node").alias("component"))
    labelled = classes.select("class", "node", "first_id").join(components, "node", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", F.col("node")))
    smallest = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = stage(
        labelled.join(stage(smallest, "near_smallest"), "component").select("class", "component_id"),
        "near_labels",
    )
    found = sketched.select("doc_id", "n_shingles", "class").join(of_class, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", F.col("doc_id")))
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
