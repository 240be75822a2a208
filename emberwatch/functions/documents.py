"""Typed access to loosely typed JSON.

Records arrive with any JSON type anywhere.  The members a normalizer reads are
parsed as VARIANT, which keeps the type, so emptiness follows the value: 0, false,
"", [], {} and null are empty, the text "0" is not.

A member is named by its path.  Objects above it are structs, so absent members
cost nothing, except where members differ only by case: those objects are maps.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import safe_int

Path = tuple[str, ...]
_EMPTY_JSON = ['""', "0", "-0", "0.0", "-0.0", "false", "null", "[]", "{}"]

# Objects with members that differ only by case.
CASED_OBJECTS: set[Path] = {
    ("data", "win", "system"), ("winlog", "event_data"), ("event_data",), ("EventData",),
}
# The event data object a Windows record uses, as a map in a column of its own.
SHIPPED: Path = ("shipped",)


def computed_once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``select`` whose results are computed once per row.

    A filter on a selected column would otherwise be pushed below the select with
    its whole expression copied, so that a record would be parsed again for every
    filter.  Unnesting one struct per row keeps filters above.
    """
    packed = df.select(F.struct(*columns).alias("row"))
    return packed.select(F.inline(F.array("row")))


def member_schema(paths: Iterable[Path]) -> str:
    """Schema for ``from_json`` that parses exactly the members at the paths."""
    tree: dict = {}
    for path in paths:
        node = tree
        for depth, part in enumerate(path):
            if path[:depth] in CASED_OBJECTS:
                break
            node = node.setdefault(part, {})

    def render(node: dict, at: Path) -> str:
        if at in CASED_OBJECTS:
            return "MAP<STRING, VARIANT>"
        if not node:
            return "VARIANT"
        fields = (f"`{name}`: {render(child, (*at, name))}" for name, child in node.items())
        return f"STRUCT<{', '.join(fields)}>"

    return ", ".join(f"`{name}` {render(child, (name,))}" for name, child in tree.items())


def struct_at(*path: str) -> Column:
    return F.col("d." + ".".join(f"`{part}`" for part in path))


def leaf(*path: str) -> Column:
    """A parsed member below ``d``."""
    parent = path[:-1]
    if parent == SHIPPED:
        return F.try_element_at("shipped", F.lit(path[-1]))
    if parent in CASED_OBJECTS:
        return F.try_element_at(struct_at(*parent), F.lit(path[-1]))
    return struct_at(*path)


def has_key(*path: str) -> Column:
    """True where the top-level key is present, whatever its value."""
    (name,) = path
    return struct_at(name).isNotNull() | (
        F.col("doc").contains(f'"{name}"')
        & F.coalesce(F.array_contains(F.json_object_keys("doc"), name), F.lit(False))
    )


def as_text(value: Column) -> Column:
    """Text of a VARIANT: strings bare, everything else as JSON; JSON null is NULL."""
    return value.cast("string")


def text_or_empty(value: Column) -> Column:
    return F.coalesce(as_text(value), F.lit(""))


def is_truthy(value: Column) -> Column:
    return F.coalesce(~F.to_json(value).isin(_EMPTY_JSON), F.lit(False))


def is_string(value: Column) -> Column:
    return F.coalesce(F.to_json(value).startswith('"'), F.lit(False))


def is_unsized(value: Column) -> Column:
    """A number other than zero, or ``true``: a value without a length."""
    return F.coalesce(
        F.to_json(value).rlike(r"\A(?:true|-?[0-9.Ee+-]*[1-9][0-9.Ee+-]*)\z"), F.lit(False)
    )


def _loses_placeholders(path: Path) -> bool:
    """Direct members of ``data`` count as absent when empty or ``-``."""
    return len(path) == 2 and path[0] == "data"


def _usable(path: Path) -> Column:
    value = leaf(*path)
    usable = is_truthy(value)
    if _loses_placeholders(path):
        usable = usable & (F.trim(as_text(value)) != "-")
    return F.when(usable, value)


def pick(*paths: Path) -> Column:
    """First truthy member, or the last one (``a or b or c``)."""
    chosen = [_usable(path) for path in paths]
    if not _loses_placeholders(paths[-1]):
        chosen.append(leaf(*paths[-1]))
    return F.coalesce(*chosen)


def head(value: Column) -> Column:
    """Text of the value, or of its first element when it is an array."""
    return F.when(
        F.to_json(value).startswith("["), F.variant_get(value, "$[0]", "string")
    ).otherwise(as_text(value))


def string_only(value: Column) -> Column:
    return F.when(is_string(value), as_text(value))


def to_integer(value: Column, kind: str = "int") -> Column:
    """Numbers lose their fraction, digit texts convert, the rest is NULL."""
    text = F.to_json(value)
    return (
        F.when(text.startswith('"'), safe_int(as_text(value), kind))
        .when(text == "true", F.lit(1).cast(kind))
        .when(text == "false", F.lit(0).cast(kind))
        .otherwise(F.try_variant_get(value, "$", "double").try_cast(kind))
    )
