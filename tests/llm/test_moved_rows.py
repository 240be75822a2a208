"""What line and near deduplication move between tasks."""

from collections import Counter
from math import ceil

import numpy as np
from pyspark.sql import functions as F

from emberwatch.llm import common, line_dedup, near_dedup


def test_filter_keeps_all_wanted_rows_and_few_others(spark):
    rows = spark.range(200_000).withColumnRenamed("id", "key")
    wanted = rows.where("key % 100 = 0")
    found = common.maybe_wanted(rows, "key", wanted)
    assert found.columns == ["key"]
    assert found.join(wanted, "key", "left_semi").count() == wanted.count() == 2_000
    assert found.count() < 2_500
    assert common.maybe_wanted(rows, "key", wanted.limit(0)).count() == 0


def test_variants_order_the_words_of_a_line_once(spark):
    words = [f"w{i}" for i in range(10)]
    row = [(1, (False, 5, 7, 0), 10, [0], words)]
    place = "struct<late: boolean, doc_id: long, row: long, line_no: int>"
    candidates = spark.createDataFrame(row, f"line long, place {place}, n int, shared array<int>, words array<string>")
    variants = line_dedup._variants(candidates)
    assert variants.columns == ["v1", "v2", "i", "line"]
    plan = variants._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(line") == 1
    moved = plan[plan.index("Exchange hashpartitioning(line") :]
    assert "late" not in moved.split("Generate")[0]
    # The line itself, and without each word after the shared first four.
    assert sorted(r["i"] for r in variants.collect()) == [0, 5, 6, 7, 8, 9, 10]


def test_long_maps_bound_the_difference_and_tell_large_sets_apart(spark):
    random = np.random.default_rng(7)
    pool = np.unique(random.integers(0, 1 << 63, 9_000, dtype=np.uint64))
    half = np.unique(np.concatenate([pool[:3000], pool[6000:9000]]))
    sets = {1: pool[:6000], 2: half, 3: pool[:5800], 4: pool[:4100], 5: pool[:200], 6: pool[:240]}
    rows = []
    for node, found in sets.items():
        short, long = near_dedup.parity_maps(found)
        assert len(short) == near_dedup.MAP_WORDS and (long is None) == (len(found) <= 256)
        rows.append((node, len(found), short, long))
    measured = spark.createDataFrame(rows, "node long, n int, parity array<long>, long_map array<long>")
    members = spark.createDataFrame([(1, x, x) for x in sets], "grp long, node long, component long")
    hubs = near_dedup._hubs(members, measured, 64, True)
    pairs = {(r["node"], r["hub"]): r["differ"] for r in near_dedup._possible(members, hubs, measured, 80).collect()}
    for (a, b), differ in pairs.items():
        assert differ <= len(np.setxor1d(sets[a], sets[b]))
    # A third of the shingles in common was not seen by 512 bits.
    assert set(pairs) == {(1, 3), (3, 1), (5, 6), (6, 5)}


def test_order_of_shared_shingles_with_a_list_of_frequent_ones(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HUBS", 3)
    monkeypatch.setattr(near_dedup, "FREQUENT", 4)
    base, sets = list(range(100, 130)), {}
    for node in range(12):
        sets[node] = sorted({*base[node % 3 :], 200 + node // 2, 300 + node // 5, 1000 + node, 2000 + node})
    sets[12] = [5000, 5001]
    times = Counter(x for s in sets.values() for x in s)
    expected = {}
    for node, found in sets.items():
        shared = [x for _, x in sorted((times[x], x) for x in found if times[x] > 1)]
        first = len(found) - ceil(0.8 * len(found)) + 1 - (len(found) - len(shared))
        if first > 0 and shared:
            expected[node] = (shared, first)
    frame = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    ordered = near_dedup._ordered(frame, 80)
    assert {r["node"]: (r["shared"], r["first"]) for r in ordered.collect()} == expected
    assert near_dedup._ordered(frame.where(F.lit(False)), 80).count() == 0
