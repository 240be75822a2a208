"""The driver contract.  ``oracle_check.py`` runs every query; here are one or two of
each kind."""

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from workload.oracles import ORACLES
from workload.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
CHOSEN = [
    "scan_hids_jsonl", "csv_firewall_export", "archive_fallback_merge", "text_extract_ip",
    "anchored_windows_dense", "incident_ids", "suppress_overlapping_dense",
    "tp_indicators_dense", "fp_indicators_dense", "classify_patterns_dense",
    "incident_metrics", "profile_values",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    # Trained models and sketches, which the corpus queries have, are tested otherwise.
    assert REGISTRY.keys() == ORACLES.keys()
    assert queries().keys() >= oracle_sql().keys() >= REGISTRY.keys()


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, name, queries()[name], oracle_sql()[name], SF_DIR) is None


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns[:3] == ["rank", "id", "rule_idx"]
    assert frame.count() == 89
