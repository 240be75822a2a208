import pytest
from golden_logs import CANDIDATES, EXPECTED, firewall, hids, windows
from pyspark.sql import functions as F

from emberwatch.operators.correlate import candidate_incidents
from emberwatch.plans import report, sinks
from emberwatch.plans.pipeline import analyze


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("logs")
    (path / "fortigate-fw.log").write_text("\n".join(firewall()) + "\n")
    (path / "wazuh-alerts.json").write_text("\n".join(hids()) + "\n")
    (path / "windows-security.json").write_text("\n".join(windows()) + "\n")
    return path


@pytest.fixture(scope="module")
def analyses(spark, folder):
    files = {
        "hids": ("wazuh-alerts.json", "wazuh"),
        "firewall": ("fortigate-fw.log", "fortigate"),
        "windows": ("windows-security.json", "windows"),
    }
    done = {
        name: analyze(spark, str(folder / file), source)
        for name, (file, source) in files.items()
    }
    # A file named windows-security.json routes to windows, alerts to HIDS.
    done["all"] = analyze(spark, directory=str(folder))
    return done


@pytest.mark.parametrize("name", list(EXPECTED))
def test_incidents(analyses, name):
    rows = analyses[name].detection.incidents.orderBy("rank").collect()
    got = [
        (
            r["id"], r["rule_idx"], r["event_count"], r["pattern"],
            " ".join(line["code"] for line in r["reasoning"]), r["confidence"], r["verdict"],
        )
        for r in rows
    ]
    assert got == EXPECTED[name]
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("name", list(CANDIDATES))
def test_candidates_before_suppression(analyses, name):
    found = candidate_incidents(analyses[name].events)
    assert found.incidents.count() == CANDIDATES[name]


def test_reports(analyses, tmp_path, spark):
    run = analyses["all"]
    summary = report.incident_summary(run.detection).orderBy("rank").collect()
    guessing = summary[1]
    assert guessing["first_ips"] == "10.40.1.8, 198.51.100.23"
    assert guessing["first_hosts"] == "quay-srv"
    assert guessing["severity"] == "HIGH"
    assert guessing["duration"] == "7m0s"
    assert summary[2]["advice"].startswith("likely a false positive")
    assert summary[0]["advice"] is None  # FALSE_POSITIVE has no advice line

    timeline = report.incident_timeline(run.detection).where("id = 7").orderBy("place").collect()
    assert [r["place"] for r in timeline] == [1, 2, 3, 4, 5]
    assert {r["more_events"] for r in timeline} == {23}

    steps = report.recommendations(run.detection).where("id = 7").first()
    assert steps["steps"].startswith("block addresses: 198.51.100.23; reset")

    stats = report.pipeline_stats(run.ingested, run.detection).first().asDict()
    assert stats == {
        "raw_events": 169, "normalized_events": 169, "skipped": 0,
        "incidents": 5, "events_grouped": 167,
    }
    sample = report.sample_raw_events(run.detection, run.events).where("id = 2").first()
    assert "wheel" in sample["raw_event"]

    written = sinks.write_report(
        run.detection, run.events, str(tmp_path / "out"), detail=True, verbose=True
    )
    events = spark.read.parquet(str(tmp_path / "out" / "incident_event_list"))
    assert events.count() == 167
    assert len(written) == 14
    sinks.write_problems(run.ingested, str(tmp_path / "problems"))


def test_select_incident(analyses):
    incidents = analyses["all"].detection.incidents
    assert report.select_incident(incidents, 7).count() == 1
    with pytest.raises(ValueError, match="incident 4 does not exist"):
        report.select_incident(incidents, 4)


def test_trust_list_prefix_and_cidr(analyses):
    from emberwatch.operators.detect import detect

    run = analyses["all"]

    def trusted(config, match="prefix"):
        found = detect(run.correlation, run.events, config, match).incidents
        return sorted(
            r["id"] for r in found.where(F.exists("reasoning", lambda x: x["code"] == "FP1")).collect()
        )

    assert trusted({"known_scanners": {"ips": ["10.40.2.9"]}}) == [5]
    # As a text prefix the network trusts nothing here.
    network = {"trusted_hosts": {"subnets": ["10.40.2.0/23"]}}
    assert trusted(network) == []
    assert trusted(network, "cidr") == [1, 5]


def test_contract(analyses):
    row = sinks.to_contract(analyses["firewall"].events).first().asDict(recursive=True)
    assert list(row) == [
        "timestamp", "source", "src_host", "src_ip", "dst_ip", "dst_host", "dst_port",
        "user", "process", "action", "result", "protocol", "severity", "extra", "raw_event",
    ]
    assert row["timestamp"] == "2027-03-16T02:10:00+00:00"
