"""Released staging, and outputs that appear complete or not at all."""

import json
import os

import pytest
from golden_logs import firewall, hids
from pyspark.sql import functions as F

from emberwatch.plans import sinks
from emberwatch.plans.pipeline import analyze
from emberwatch.storage import MANIFEST, owned, publish, stage, staging_root


def _staged(spark):
    root = os.path.join(staging_root(spark).removeprefix("file:"), "emberwatch")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("logs")
    (path / "fortigate-fw.log").write_text("\n".join(firewall()) + "\n")
    (path / "wazuh-alerts.json").write_text("\n".join(hids()) + "\n")
    (path / "export-wazuh.csv").write_text(
        'rule.id,agent.name,timestamp,rule.description\n1,web-1,2027-03-16T02:00:00Z,"two\nlines"\n'
    )
    return path


def test_nothing_is_left_after_a_run(spark, folder, tmp_path):
    before = _staged(spark)
    with analyze(spark, directory=str(folder)) as run:
        written = sinks.write_report(run.detection, run.events, str(tmp_path / "out"), True, True)
        sinks.write_problems(run.ingested, str(tmp_path / "problems"))
        assert _staged(spark) > before
    assert _staged(spark) == before
    manifest = json.loads((tmp_path / "out" / MANIFEST).read_text())
    assert sorted(manifest["tables"]) == written
    for name, rows in manifest["tables"].items():
        assert spark.read.parquet(str(tmp_path / "out" / name)).count() == rows
    assert manifest["tables"]["incident_summary"] > 0


def test_a_failed_run_releases_its_tables(spark, tmp_path):
    before = _staged(spark)
    (tmp_path / "wazuh.json").write_text("no json\n")
    with pytest.raises(ValueError, match="no event"):
        analyze(spark, directory=str(tmp_path))
    assert _staged(spark) == before


def test_a_failed_write_leaves_no_table(spark, tmp_path):
    good = spark.range(3)
    bad = spark.range(3).select(F.raise_error(F.lit("lost")).cast("string").alias("x"))
    with pytest.raises(Exception, match="lost"):
        publish({"good": good, "bad": bad}, str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == []
    assert publish({"good": good}, str(tmp_path / "out")) == ["good"]
    with pytest.raises(FileExistsError):
        publish({"good": good}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "good")).count() == 3


def test_owners_do_not_take_tables_of_others(spark):
    with owned(spark) as outer:
        first = stage(spark.range(2), "first")
        with owned(spark, release=True) as inner:
            stage(spark.range(2), "second")
            assert len(inner.paths) == 1
        assert not inner.paths and first.count() == 2
    outer.release()
    assert not outer.paths
