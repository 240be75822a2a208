"""Tailed tables against the batch ingest of the same files."""

import os

import pytest
from golden_logs import EXPECTED, windows
from pyspark.sql import functions as F

from emberwatch.plans.ingest import ingest, scan_file
from emberwatch.plans.pipeline import analyze_events
from emberwatch.schema import EVENT_FIELDS
from emberwatch.streaming.tail import TABLES, batch_writer, tail

BAD = ["", "no json", '{"rule": {}}', '{"timestamp": "yesterday", "rule": {}, "agent": {}}']


@pytest.fixture(scope="module")
def tailed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tail")
    folder = root / "in"
    folder.mkdir()
    records = windows()
    for i, part in enumerate((records[:9] + BAD[:2], records[9:10] + BAD, records[10:])):
        path = folder / f"security-{i}.json"
        path.write_text("\n".join(part) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))  # files arrive in this order
    found, running = tail(spark, str(folder), "windows", str(root / "out"), str(root / "state"), files_per_batch=1)
    running.awaitTermination(300)
    return found, ingest([scan_file(spark, "windows", str(folder))]), folder


def _rows(frame, columns):
    return sorted(map(repr, frame.select(*columns).collect()))


def test_tables_equal_the_batch(tailed):
    found, batch, _ = tailed
    names = ["file_name", *EVENT_FIELDS]
    in_order = [f.orderBy("event_id").select(*names).collect() for f in (found.events, batch.events)]
    assert in_order[0] == in_order[1] and len(in_order[0]) == len(windows())
    assert _rows(found.table("rejects"), ["file_name", "line", "reject_reason"]) == _rows(
        batch.rejects, ["file_name", "line", "reject_reason"]
    )
    assert _rows(found.table("errors"), ["file_name", "error"]) == _rows(batch.errors, ["file_name", "error"])
    assert _rows(found.table("stats"), batch.stats.columns) == _rows(batch.stats, batch.stats.columns)
    assert found.table("rejects").count() == 3 and found.table("errors").count() == 1
    assert found.events.select("event_id").distinct().count() == len(windows())


def test_incidents_of_the_appended_table(tailed):
    found, _, _ = tailed
    rows = analyze_events(found.events).detection.incidents.orderBy("rank").collect()
    got = [
        (
            r["id"], r["rule_idx"], r["event_count"], r["pattern"],
            " ".join(line["code"] for line in r["reasoning"]), r["confidence"], r["verdict"],
        )
        for r in rows
    ]
    assert got == EXPECTED["windows"]


def test_a_batch_that_is_run_again_changes_no_table(spark, tailed):
    found, _, folder = tailed
    before = {name: _rows(found.table(name), found.table(name).columns) for name in TABLES}
    again = spark.read.text(str(folder / "security-1.json")).select(
        F.col("value").alias("line"), F.lit("security-1.json").alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"),
    )
    batch_writer("windows", found.path)(again, 1)
    assert {name: _rows(found.table(name), found.table(name).columns) for name in TABLES} == before


def test_unknown_sources_and_tables(spark, tailed, tmp_path):
    with pytest.raises(ValueError, match="no source of lines"):
        batch_writer("pager", str(tmp_path))
    with pytest.raises(ValueError, match="no table"):
        tailed[0].table("blocks")
