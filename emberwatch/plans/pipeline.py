"""The two entry points: parse files into events, analyze files into incidents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from emberwatch.config import load_document, load_mappings, load_pattern_rules
from emberwatch.operators.correlate import Correlation, correlate
from emberwatch.operators.detect import Detection, detect
from emberwatch.operators.rules import DEFAULT_RULES, Rule
from emberwatch.plans.ingest import Ingest, ingest, read_directory, scan_file
from emberwatch.storage import Owner, owned


@dataclass(frozen=True)
class Analysis:
    ingested: Ingest | None
    events: DataFrame
    correlation: Correlation
    detection: Detection
    staged: Owner | None = None

    def close(self) -> None:
        """Release what was staged for the run; its tables cannot be read afterwards."""
        if self.staged is not None:
            self.staged.release()

    def __enter__(self) -> Analysis:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def parse(
    spark: SparkSession,
    path: str | Sequence[str],
    source: str,
    mappings: Mapping | str | None = None,
) -> Ingest:
    """Parse and normalize one source.

    Fails when there were records and none of them became an event.
    """
    ingested = ingest([scan_file(spark, source, path, load_mappings(mappings))])
    if ingested.events.isEmpty() and not ingested.errors.isEmpty():
        failed = ingested.errors.count()
        example = ingested.errors.select("error").first()["error"]
        raise ValueError(f"all {failed} parsed records failed normalization: {example}")
    return ingested


def analyze_events(
    events: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    trust: Mapping | DataFrame | str | None = None,
    trust_match: str = "prefix",
    patterns: Mapping | str | None = None,
    ingested: Ingest | None = None,
) -> Analysis:
    """Correlate and judge an event table.

    ``events`` needs a unique ``event_id`` that ascends in input order.  ``trust`` is a
    document, its path, or a table of entries of any length.
    """
    with owned(events.sparkSession) as staged:
        correlation = correlate(events, rules)
        trusted = trust if isinstance(trust, DataFrame) else load_document(trust)
        detection = detect(
            correlation, events, trusted, trust_match, load_pattern_rules(patterns)
        )
    return Analysis(ingested, events, correlation, detection, staged)


def analyze(
    spark: SparkSession,
    path: str | Sequence[str] | None = None,
    source: str | None = None,
    directory: str | None = None,
    mappings: Mapping | str | None = None,
    **options,
) -> Analysis:
    """Files of one source, or every recognised file of a directory, to incidents."""
    with owned(spark) as staged:
        if path and source:
            scans = [scan_file(spark, source, path, load_mappings(mappings))]
        elif directory:
            scans = read_directory(spark, directory, load_mappings(mappings)).scans
        else:
            raise ValueError("give path and source, or directory")
        ingested = ingest(scans)
        if ingested.events.isEmpty():
            raise ValueError("no event could be parsed from any file")
        run = analyze_events(ingested.events, ingested=ingested, **options)
        staged.paths += run.staged.paths
    return replace(run, staged=staged)
