"""Text and truthiness helpers as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(column: Column) -> Column:
    """The text itself, or NULL where it is missing or empty."""
    return F.nullif(column, F.lit(""))


def first_truthy(*columns: Column) -> Column:
    """First text that is neither NULL nor empty (``a or b or c``)."""
    return F.coalesce(*[truthy(column) for column in columns])


def any_of(words: Iterable[str]) -> str:
    """Regular expression that matches any of the literal words."""
    return "|".join(re.escape(word) for word in words)


def contains_any(column: Column, words: Sequence[str]) -> Column:
    """True where the lower-cased text contains one of the words; NULL text is False."""
    return F.coalesce(F.lower(column).rlike(any_of(words)), F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_word_found(column: Column, words: Sequence[str]) -> Column:
    """The first listed word that the lower-cased text contains, else NULL."""
    listed = F.array(*[F.lit(word) for word in words])
    return let(
        F.lower(column),
        lambda text: F.get(F.filter(listed, lambda w: F.contains(text, w)), F.lit(0)),
    )


def first_keyword_value(column: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Value of the first listed keyword that the lower-cased text contains."""
    listed = F.array(
        *[F.struct(F.lit(k).alias("keyword"), F.lit(v).alias("value")) for k, v in pairs]
    )
    return let(
        F.lower(column),
        lambda text: F.get(
            F.filter(listed, lambda p: F.contains(text, p["keyword"])), F.lit(0)
        )["value"],
    )


def lookup(column: Column, table: Mapping[str, str | None]) -> Column:
    """Constant-table lookup; NULL for unknown keys and for keys mapped to None."""
    entries = [F.lit(item) for pair in table.items() if pair[1] is not None for item in pair]
    return F.try_element_at(F.create_map(*entries), column)


def safe_int(column: Column, kind: str = "int") -> Column:
    """Integer text to a number; anything else is NULL."""
    # The cast alone would also take fractions and named values of wider types.
    return F.when(column.rlike(r"\A\s*[+-]?[0-9]+\s*\z"), F.trim(column).try_cast(kind))


def looks_like_uuid(column: Column) -> Column:
    """Hyphenated hex groups: at least 14 characters, 3 groups, the first five all hex."""
    groups = F.split(column, "-")
    hex_groups = F.forall(F.slice(groups, 1, 5), lambda g: g.rlike(r"\A[0-9a-fA-F]*\z"))
    return F.coalesce(
        (F.length(column) >= 14) & (F.size(groups) >= 3) & hex_groups, F.lit(False)
    )


def duration_text(seconds: Column) -> Column:
    """``XmYs``, or ``Ys`` below a minute."""
    whole = seconds.cast("bigint")
    minutes = F.floor(whole / 60).cast("string")
    rest = (whole % 60).cast("string")
    return F.when(
        whole >= 60, F.concat(minutes, F.lit("m"), rest, F.lit("s"))
    ).otherwise(F.concat(whole.cast("string"), F.lit("s")))
