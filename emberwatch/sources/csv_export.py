"""CSV exports with arbitrary columns.

The header decides the kind and how columns map to record fields; that is driver
work on names only.  Each row becomes a JSON document shaped like the native
records, so exports share the normalizers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.fixed_values import (
    ACTION_EXCLUDED_COLUMNS,
    ACTION_PEER_COLUMNS,
    BUILTIN_ALIASES,
    DEFAULT_COLUMN_MAPPINGS,
    DEVICE_COLUMNS,
    HIDS_ID_COLUMNS,
    HIDS_PEER_COLUMNS,
    TRAFFIC_COLUMNS,
    WINDOWS_CODE_COLUMN,
    WINDOWS_ID_COLUMNS,
    WINDOWS_PREFIXES,
)
from emberwatch.functions.documents import computed_once
from emberwatch.functions.text import let
from emberwatch.sources.json_lines import HIDS_MEMBERS, WINDOWS_MEMBERS, members
from emberwatch.sources.firewall import fields_from_documents
from emberwatch.sources.csv_records import read_csv_records
from emberwatch.sources.lines import LINEAGE_ORDER, stripped

SURPLUS = "__surplus_cell"


def detect_csv_kind(columns: Sequence[str]) -> str:
    """Source kind from header names; ``unknown`` when nothing distinctive is there."""
    names = {name.lower() for name in columns}

    def any_in(candidates: Sequence[str]) -> bool:
        return not names.isdisjoint(candidates)

    windows = (
        any(name.startswith(tuple(WINDOWS_PREFIXES)) for name in names)
        or WINDOWS_CODE_COLUMN in names
        or any_in(WINDOWS_ID_COLUMNS)
    )
    firewall = (
        (any_in(TRAFFIC_COLUMNS) and any_in(DEVICE_COLUMNS))
        or names >= {"type", "srcip"}
        or (
            "action" in names
            and any_in(ACTION_PEER_COLUMNS)
            and not any_in(ACTION_EXCLUDED_COLUMNS)
        )
    )
    if windows:
        return "windows"
    if firewall:
        return "fortigate"
    if any_in(HIDS_ID_COLUMNS) and any_in(HIDS_PEER_COLUMNS):
        return "wazuh"
    return "unknown"


def choose_kind(columns: Sequence[str], hint: str | None, authoritative: bool) -> str:
    """An authoritative hint wins; otherwise the header decides."""
    return hint if authoritative and hint else detect_csv_kind(columns)


def lower_keys(value):
    if isinstance(value, Mapping):
        return {key.lower(): lower_keys(inner) for key, inner in value.items()}
    return value


def resolve_column(name: str, kind: str, mappings: Mapping | None = None) -> str:
    """Record field of a column: source mapping, global mapping, built-in alias, or
    the name itself.  Names compare without case."""
    known = lower_keys(DEFAULT_COLUMN_MAPPINGS if mappings is None else mappings)
    key = name.lower()
    for table in (known.get(kind), known.get("global"), BUILTIN_ALIASES):
        if isinstance(table, Mapping) and key in table:
            return table[key]
    return name


def resolve_columns(
    columns: Sequence[str], kind: str, mappings: Mapping | None = None
) -> list[tuple[int, str]]:
    """``(column position, record field)`` for every named column, in order."""
    return [
        (place, resolve_column(name.strip(), kind, mappings))
        for place, name in enumerate(columns)
        if name.strip()
    ]


def cell_value(cell: Column) -> Column:
    """Trimmed cell; empty cells and the ``-`` placeholder are NULL."""
    text = stripped(cell)
    return F.when(~text.isin("", "-"), text)


def cell_json(cell: Column) -> Column:
    """JSON text of a cell: JSON inside a cell is restored, the rest is a string."""
    looks_json = cell.rlike(r"(?s)\A[\[{].*[\]}]\z")
    quoted = F.to_json(cell.cast("variant"))
    return F.when(
        cell.isNotNull(),
        F.when(looks_json & F.try_parse_json(cell).isNotNull(), cell).otherwise(quoted),
    )


class _Node:
    """One field of the record tree with the cells that write to it, in column order."""

    def __init__(self) -> None:
        self.cells: list[tuple[int, Column]] = []
        self.children: dict[str, _Node] = {}

    def json(self) -> Column:
        """JSON text of the field, NULL when no cell of the row writes to it."""
        own = (
            F.coalesce(*[cell for _, cell in reversed(self.cells)]) if self.cells else None
        )
        if not self.children:
            return F.lit(None).cast("string") if own is None else own
        members = F.array_compact(
            F.array(
                *[
                    F.concat(F.lit(f"{_quoted(name)}:"), child.masked(self.cells).json())
                    for name, child in self.children.items()
                ]
            )
        )
        if own is None:
            return let(members, lambda m: F.when(F.size(m) > 0, _braced(m)))
        return let(
            F.struct(members.alias("members"), own.alias("own")),
            lambda x: F.when(
                F.size(x["members"]) > 0, _braced(_merged(x["own"], x["members"]))
            ).otherwise(x["own"]),
        )

    def masked(self, overwriting: list[tuple[int, Column]]) -> _Node:
        """Copy without the cells that a later cell of the parent overwrites."""
        if not overwriting:
            return self
        copy = _Node()
        copy.cells = [
            (place, F.when(~_any_later(overwriting, place), cell))
            for place, cell in self.cells
        ]
        copy.children = {
            name: child.masked(overwriting) for name, child in self.children.items()
        }
        return copy


def _any_later(cells: list[tuple[int, Column]], place: int) -> Column:
    later = F.lit(False)
    for other, cell in cells:
        if other > place:
            later = later | cell.isNotNull()
    return later


def _braced(members: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def _merged(own: Column, members: Column) -> Column:
    """A scalar in the way of members stays as ``_value``; an object takes them in."""
    inside = F.trim(F.substring(own, F.lit(2), F.length(own) - 2))
    kept = F.when(own.startswith("{"), F.nullif(inside, F.lit(""))).otherwise(
        F.concat(F.lit('"_value":'), own)
    )
    return F.concat(F.array_compact(F.array(kept)), members)


def _quoted(name: str) -> str:
    return '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '"'


def nest_columns(targets: Sequence[tuple[str, Column]]) -> Column:
    """Nested JSON document from ``(dotted field, cell JSON)`` pairs in column order.

    The last non-empty cell of a field wins.  NULL when every cell is empty.
    """
    root = _Node()
    for place, (field, cell) in enumerate(targets):
        node = root
        for part in field.split("."):
            node = node.children.setdefault(part, _Node())
        node.cells.append((place, cell))
    return root.json() if root.children else F.lit(None).cast("string")


def parse_csv_rows(rows: DataFrame, columns: Sequence[str], kind: str, mappings=None) -> DataFrame:
    """Cells ``c0, c1, ...`` (plus the surplus sentinel) to documents.

    Adds ``doc`` and ``reject_reason``; for HIDS and Windows also ``d``, for the
    firewall ``f``.
    """
    resolved = resolve_columns(columns, kind, mappings)
    cells = [f"c{place}" for place in range(len(columns))]
    others = [name for name in rows.columns if name not in {*cells, SURPLUS}]
    trimmed = computed_once(
        rows, *others, SURPLUS, *[cell_value(F.col(name)).alias(name) for name in cells]
    )
    as_json = computed_once(
        trimmed, *others, SURPLUS, *[cell_json(F.col(name)).alias(name) for name in cells]
    )
    targets = [(field, F.col(f"c{place}")) for place, field in resolved]
    documents = computed_once(
        as_json, *others, nest_columns(targets).alias("doc"), SURPLUS
    ).withColumn(
        "reject_reason",
        F.when(F.col(SURPLUS).isNotNull(), F.lit("more cells than columns")).when(
            F.col("doc").isNull(), F.lit("empty row")
        ),
    ).drop(SURPLUS)
    if kind == "fortigate":
        return fields_from_documents(documents)
    names = HIDS_MEMBERS if kind == "wazuh" else WINDOWS_MEMBERS
    return computed_once(documents, *documents.columns, members(documents, names).alias("d"))


_CELLS = {
    "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Header names, read without the data."""
    header = (
        spark.read.options(
            header=False, multiLine=True, quote='"', escape='"', nullValue=""
        )
        .csv(path)
        .limit(1)
        .collect()
    )
    return [name or "" for name in header[0]] if header else []


def read_csv_cells(spark: SparkSession, paths, columns: Sequence[str]) -> DataFrame:
    """Rows as ``c0..cN`` with a sentinel for surplus cells, plus lineage.

    Files are read in splits, whatever their cells hold (``csv_records``).
    """
    names = [f"c{place}" for place in range(len(columns))] + [SURPLUS]
    records = read_csv_records(spark, paths)
    cells = F.from_csv("record", ", ".join(f"{name} string" for name in names), _CELLS)
    return computed_once(records, *LINEAGE_ORDER, cells.alias("cells")).select(
        *[F.col(f"cells.{name}").alias(name) for name in names], *LINEAGE_ORDER
    )


def read_csv_export(
    spark: SparkSession,
    path: str | Sequence[str],
    hint: str | None = None,
    authoritative: bool = False,
    mappings: Mapping | None = None,
    columns: Sequence[str] | None = None,
) -> tuple[str, DataFrame]:
    """``(kind, documents)``.  Several paths must share one header."""
    first = path if isinstance(path, str) else path[0]
    columns = csv_columns(spark, first) if columns is None else columns
    kind = choose_kind(columns, hint, authoritative)
    return kind, parse_csv_rows(read_csv_cells(spark, path, columns), columns, kind, mappings)
