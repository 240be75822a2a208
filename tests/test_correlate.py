import random

import pytest
from pyspark.sql import functions as F
from sequential_model import candidates, suppress

from emberwatch.operators.correlate import candidate_incidents, correlate
from emberwatch.operators.rules import DEFAULT_RULES, Rule

BASE = 1_704_067_200_000_000
FIELDS = ["src_ip", "dst_ip", "dst_host", "dst_port", "src_host", "process"]
SCHEMA = (
    "event_id bigint, us bigint, src_ip string, dst_ip string, dst_host string,"
    " dst_port int, src_host string, process string"
)


def random_events(seed, n, span_minutes, hot=0.0, tick_us=1_000_000):
    rng = random.Random(seed)
    out = []
    for event_id in range(n):
        one = rng.random() < hot
        ticks = span_minutes * 60_000_000 // tick_us
        out.append({
            "event_id": event_id,
            "us": BASE + rng.randrange(ticks) * tick_us,
            "src_ip": "1.1.1.1" if one else rng.choice([None, "", "a", "b", "c"]),
            "dst_ip": "9.9.9.9" if one else rng.choice([None, "x", "y"]),
            "dst_host": rng.choice([None, "", "H1", "H2"]),
            "dst_port": rng.choice([None, 0, 22, 80]),
            "src_host": rng.choice([None, None, "W1"]),
            "process": rng.choice([None, "p", "q"]),
        })
    return out


def to_events(spark, rows):
    frame = spark.createDataFrame(
        [tuple(r[name] for name in ["event_id", "us", *FIELDS]) for r in rows], SCHEMA
    )
    return frame.select("event_id", F.timestamp_micros("us").alias("timestamp"), *FIELDS)


def as_tuples(correlation):
    members = {}
    for row in correlation.membership.collect():
        members.setdefault(row["window_id"], []).append(row["event_id"])
    return {
        (
            r["id"], r["rule_idx"], tuple(r["key"]), r["start_us"], r["end_us"],
            r["event_count"], tuple(sorted(members[r["window_id"]])),
        )
        for r in correlation.incidents.collect()
    }


def model_tuples(incidents):
    return {
        (i["id"], i["rule_idx"], i["key"], i["start"], i["end"], len(i["ids"]), tuple(sorted(i["ids"])))
        for i in incidents
    }


CASES = [
    pytest.param(1, 400, 600, 0.0, 1_000_000, {}, id="sparse"),
    pytest.param(2, 600, 120, 0.5, 1_000_000, {}, id="hot-folded"),
    pytest.param(3, 600, 240, 0.5, 1_000_000, {"strip_points": 7}, id="hot-strips"),
    pytest.param(4, 500, 90, 0.9, 1, {"strip_points": 40}, id="dense-strips"),
    pytest.param(5, 300, 400, 0.4, 900_000_001, {"strip_points": 2}, id="cell-edges"),
    pytest.param(6, 300, 400, 0.4, 900_000_000, {"strip_points": 3}, id="window-edges"),
    pytest.param(7, 500, 300, 0.9, 1_000_000, {"strip_points": 1}, id="one-point-strips"),
]


@pytest.mark.parametrize("seed,n,span,hot,tick,options", CASES)
def test_equals_sequential_model(spark, seed, n, span, hot, tick, options):
    rows = random_events(seed, n, span, hot, tick)
    expected = candidates(rows, DEFAULT_RULES)
    found = candidate_incidents(to_events(spark, rows), **options)
    wanted = {i[0]: i for i in model_tuples(expected)}
    assert {t for t in as_tuples_qualified(found)} == set(wanted.values())
    kept = correlate(to_events(spark, rows), **options)
    assert as_tuples(kept) == model_tuples(suppress(expected))


def as_tuples_qualified(correlation):
    """Candidate membership also holds windows below the threshold."""
    ids = correlation.incidents.select("window_id")
    trimmed = type(correlation)(
        correlation.incidents, correlation.membership.join(ids, "window_id")
    )
    return as_tuples(trimmed)


@pytest.mark.parametrize("partitions", [1, 13, 64])
def test_independent_of_partitioning(spark, partitions):
    rows = random_events(7, 400, 200, 0.3)
    expected = model_tuples(suppress(candidates(rows, DEFAULT_RULES)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        shuffled = to_events(spark, rows).orderBy(F.rand(partitions)).repartition(partitions)
        assert as_tuples(correlate(shuffled)) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_custom_rules_and_empty_input(spark):
    rules = [Rule("port only", ("dst_port",), 5, 2)]
    rows = random_events(8, 200, 60)
    expected = model_tuples(suppress(candidates(rows, rules)))
    assert as_tuples(correlate(to_events(spark, rows), rules)) == expected
    empty = correlate(to_events(spark, []), DEFAULT_RULES)
    assert empty.incidents.isEmpty() and empty.membership.isEmpty()


def test_suppression_chain(spark):
    """Each incident overlaps the next one by more than half: only every other stays."""
    from emberwatch.operators.suppress import suppress_overlaps

    sizes = [12 - i for i in range(8)]
    incidents, members, start = [], [], 0
    for number, size in enumerate(sizes, 1):
        ids = list(range(start, start + size))
        incidents.append({"id": number, "ids": ids})
        members += [(number, e) for e in ids]
        start += size // 2 - 1
    expected = {i["id"] for i in suppress(incidents)}
    frame = spark.createDataFrame(
        [(i["id"], i["id"], len(i["ids"])) for i in incidents],
        "window_id bigint, id bigint, event_count bigint",
    )
    kept = suppress_overlaps(
        frame, spark.createDataFrame(members, "window_id bigint, event_id bigint")
    )
    assert {r["id"] for r in kept.collect()} == expected
