"""How steps are arranged where results alone do not tell: no task holds what grows with the input."""

from pyspark.sql import functions as F

from emberwatch.operators import detect, session_chains
from emberwatch.plans import report
from emberwatch.storage import stage


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_strips_find_the_next_one_without_a_list_of_strips(spark, monkeypatch):
    plans = {}

    def noted(df, label):
        plans.setdefault(label, plan(df))
        return stage(df, label)

    monkeypatch.setattr(session_chains, "stage", noted)
    points = spark.range(400).select(
        F.lit(1).cast("bigint").alias("session_id"), F.lit(99).cast("bigint").alias("window_us"),
        (F.col("id") * 7).alias("us"), F.lit(400).cast("bigint").alias("session_n"),
    )
    found = session_chains.session_starts(points, 400, 3).collect()
    expected, at = [], 0
    while at < 2800:
        expected.append(at)
        at = -(-(at + 100) // 7) * 7
    assert sorted(r["anchor_us"] for r in found) == expected
    assert "collect_" not in plans["session_jumps"]


FACTS = (
    "window_id bigint, us bigint, event_id bigint, source string, src_ip string, dst_ip string, dst_host string,"
    " dst_port int, user string, process string, action string, result string, severity int, scanner string,"
    " routine_word string"
)


def test_statistics_sort_no_facts(spark, monkeypatch):
    plans = {}

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, label)

    monkeypatch.setattr(detect, "stage", noted)
    same = (None, "10.0.0.1", None, 0, "root", "taskeng.exe /run", "login_failed", "failure")
    facts = spark.createDataFrame(
        [
            (1, 5, 1, "b", *same, 4, None, "backup"), (1, 5, 2, "a", *same, 4, "nmap", None),
            (1, 7, 3, "a", *same, 0, "zap", "update"), (2, 9, 4, "", *same, None, None, None),
        ],
        FACTS,
    )
    rows = {r["window_id"]: r for r in detect.incident_statistics(facts).collect()}
    one, two = rows[1], rows[2]
    assert (one["sources"], one["n_rated"], tuple(one["peak"])) == (["a", "b"], 2, (4, 5, 2))
    assert (one["scanner"], one["routine_word"], one["n_maintenance"]) == ("nmap", "backup", 3)
    assert (two["sources"], two["n_rated"], two["peak"], two["sensitive_ports"]) == ([""], 0, None, [])
    assert "Generate" not in plans["values"] and "window_id" in plans["totals"]
    assert "SortAggregate" not in plans["values"] + plans["totals"]


def test_timeline_ranks_times_and_ids_only(spark, monkeypatch):
    plans = {}

    def noted(df, label):
        plans[label] = plan(df)
        return stage(df, label)

    monkeypatch.setattr(report, "stage", noted)
    row = ("a", None, None, None, 0, None, None, "x", None, 1, None, None)
    facts = spark.createDataFrame([(1, 10 - i // 2, i, *row) for i in range(9)] * 2, FACTS)
    incidents = spark.createDataFrame([(1, 1, 18)], "window_id bigint, id bigint, event_count bigint")
    found = report.incident_timeline(detect.Detection(incidents, facts), 4).orderBy("place").collect()
    assert [r["event_id"] for r in found] == [8, 8, 6, 6]
    assert "action" not in plans["timeline_ends"].split("LogicalRDD")[0]
