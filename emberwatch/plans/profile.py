"""Profile of a CSV export: does its header map, and do its rows become events?

The profile reads the whole export.  ``sample_rows`` restricts the value samples to
the first rows of the file, the way a quick look at an export does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from emberwatch.fixed_values import (
    CRITICAL_COLUMNS,
    CRITICAL_COLUMNS_OTHER,
    DEFAULT_COLUMN_MAPPINGS,
)
from emberwatch.sources.csv_export import cell_value, detect_csv_kind, lower_keys
from emberwatch.sources.lines import LINEAGE_ORDER
from emberwatch.sources.registry import get_source

_SCHEMA = "place int, column string, mapped_to string, status string"


def _configured(name: str, kind: str, mappings: Mapping | None) -> str | None:
    known = lower_keys(DEFAULT_COLUMN_MAPPINGS if mappings is None else mappings)
    key = name.lower().strip()
    return (known.get(kind) or {}).get(key) or (known.get("global") or {}).get(key)


def _mapping_rows(columns: Sequence[str], mappings: Mapping | None) -> list[tuple]:
    kind = detect_csv_kind(columns)
    rows = []
    for place, name in enumerate(columns):
        target = _configured(name, kind, mappings)
        status = "mapped" if target else "native" if "." in name else "unmapped"
        rows.append((place, name, target or name, status))
    return rows


def profile_mapping(
    spark: SparkSession, columns: Sequence[str], mappings: Mapping | None = None
) -> DataFrame:
    """Per column: mapped by configuration, native dotted name, or unmapped.
    Built-in aliases do not count here."""
    return spark.createDataFrame(_mapping_rows(columns, mappings), _SCHEMA)


def missing_columns(
    columns: Sequence[str],
    mappings: Mapping | None = None,
    critical: Mapping[str, Sequence[str]] = CRITICAL_COLUMNS,
) -> list[str]:
    """Critical fields of the detected kind that no column maps to."""
    kind = detect_csv_kind(columns)
    targets = {_configured(name, kind, mappings) or name for name in columns}
    needed = critical.get(kind, CRITICAL_COLUMNS_OTHER)
    return [name for name in needed if name not in targets]


def _cells(rows: DataFrame, columns: Sequence[str], sample_rows: int | None) -> DataFrame:
    """``(lineage, place, column, value)`` for every cell."""
    if sample_rows is not None:
        rows = rows.orderBy(*LINEAGE_ORDER).limit(sample_rows)
    entries = [
        F.struct(
            F.lit(place).alias("place"),
            F.lit(name).alias("column"),
            F.col(f"c{place}").alias("value"),
        )
        for place, name in enumerate(columns)
    ]
    return rows.select(*LINEAGE_ORDER, F.inline(F.array(*entries)))


def _first_filled(places: Sequence[int], shown: int) -> Callable[[Iterator], Iterator]:
    """For ``mapInArrow``: the first filled cells of each column among a task's rows."""
    in_order = [(name, "ascending") for name in LINEAGE_ORDER]

    def first(rows: pa.Table) -> pa.Table:
        return rows.take(pc.sort_indices(rows, sort_keys=in_order, null_placement="at_start")[:shown])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Table] = {}
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for place in places:
                column = rows.column(f"c{place}")
                filled = rows.select(LINEAGE_ORDER).append_column("value", column).filter(pc.is_valid(column))
                if filled.num_rows:
                    known = [held[place]] if place in held else []
                    held[place] = first(pa.concat_tables([*known, filled]))
        for place, rows in held.items():
            number = pa.array([place] * rows.num_rows, pa.int32())
            yield from rows.add_column(0, "place", number).combine_chunks().to_batches()

    return run


def profile_suggestions(
    spark: SparkSession,
    rows: DataFrame,
    columns: Sequence[str],
    mappings: Mapping | None = None,
    sample_rows: int | None = None,
) -> DataFrame:
    """Unmapped columns with their first three non-empty values.

    Every task keeps its first three of each column, so nothing sorts the cells.
    """
    unmapped = profile_mapping(spark, columns, mappings).where("status = 'unmapped'")
    places = [row[0] for row in _mapping_rows(columns, mappings) if row[3] == "unmapped"]
    if sample_rows is not None:
        rows = rows.orderBy(*LINEAGE_ORDER).limit(sample_rows)
    cells = rows.select(*LINEAGE_ORDER, *[cell_value(F.col(f"c{p}")).alias(f"c{p}") for p in places])
    kinds = [StructField(name, rows.schema[name].dataType) for name in LINEAGE_ORDER]
    schema = StructType([StructField("place", IntegerType()), *kinds, StructField("value", StringType())])
    order = Window.partitionBy("place").orderBy(*LINEAGE_ORDER)
    samples = (
        cells.mapInArrow(_first_filled(places, 3), schema)
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= 3)
        .groupBy("place")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "value"))).alias("listed"))
    )
    shown = F.array_join(F.transform("listed", lambda x: x["value"]), ", ")
    return unmapped.join(samples, "place", "left").select(
        "place", "column", F.coalesce(shown, F.lit("?")).alias("samples")
    )


def profile_values(
    rows: DataFrame, columns: Sequence[str], sample_rows: int | None = None
) -> DataFrame:
    """Distinct and non-empty values per column."""
    text = F.coalesce("value", F.lit(""))
    return (
        _cells(rows, columns, sample_rows)
        .groupBy("place", "column")
        .agg(
            F.count_distinct(text).alias("n_distinct"),
            F.count_if(text != "").alias("n_filled"),
            F.min(F.when(text != "", F.col("value"))).alias("smallest"),
        )
    )


def profile_yield(documents: DataFrame) -> DataFrame:
    """Rows, parsed, skipped and the parsed share of the data rows in percent."""
    parsed = F.count_if(F.col("reject_reason").isNull())
    total = F.count(F.lit(1))
    return documents.agg(
        total.alias("total_rows"),
        parsed.alias("parsed"),
        (total - parsed).alias("skipped"),
        F.round(parsed / F.greatest(total, F.lit(1)) * 100, 1).alias("percent"),
    )


def profile_normalize(
    documents: DataFrame, kind: str, sample_rows: int | None = None
) -> DataFrame:
    """How many parsed rows fail to normalize, by reason."""
    valid = documents.where(F.col("reject_reason").isNull())
    if sample_rows is not None:
        valid = valid.orderBy(*LINEAGE_ORDER).limit(sample_rows)
    normalized = get_source(kind).normalize(valid)
    return normalized.groupBy(
        F.coalesce("normalize_error", F.lit("ok")).alias("outcome")
    ).agg(F.count(F.lit(1)).alias("n_rows"))
