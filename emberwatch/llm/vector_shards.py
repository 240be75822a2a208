"""Vectors in shards, and a set of query vectors streamed through each shard's index.

Candidates are dealt into shards of at most about ``SHARD_BYTES``; a shard's rows reach
one task first, which indexes them, and the queries follow as a stream, so a task holds a
shard and a batch of queries at a time, however many there are.  Candidates move once;
queries, the small side, move to every shard.

Shards are searched in rounds: ``FIRST_SHARDS`` at first, then ``WIDER`` times as many in
all.  What a round finds bounds the next one, so that a shard returns rows that may still
count and not its own best ones, and the rows returned grow with the logarithm of the
number of shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from emberwatch.storage import stage

SHARD_BYTES = 32_000_000
# Small tables are still dealt into this many shards, of this many rows at least.
FIRST_SHARDS, LEAST_ROWS = 16, 1_000
WIDER = 8

# Answers one batch of queries from a shard's index.
Answer = Callable[[pa.RecordBatch], pa.RecordBatch]


def finite_vectors(table: DataFrame, vec_id: str, vector: str, *more: Column) -> DataFrame:
    """Staged rows with an id and a vector of finite numbers: row, id, dim, vector, and more."""
    kind = table.schema[vector].dataType
    if not isinstance(kind, ArrayType):
        raise TypeError(f"{vector} must be an array of numbers, not {kind.simpleString()}")
    whole = F.col(vector)
    if not isinstance(kind.elementType, FloatType | DoubleType):
        whole = whole.cast(ArrayType(DoubleType()))
    least, most = -np.finfo(np.float64).max, np.finfo(np.float64).max
    finite = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & x.between(least, most))
    kept = table.where(F.col(vec_id).isNotNull() & F.coalesce(finite, F.lit(False)))
    return stage(
        kept.select(
            F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("id"),
            F.size(whole).alias("dim"), whole.alias("vector"), *more,
        ),
        "vectors",
    )


def shard_counts(rows: DataFrame) -> DataFrame:
    """dim, shards: how many shards the vectors of a length have."""
    count = F.count(F.lit(1))
    by_size = F.ceil(count * F.greatest("dim", F.lit(1)) * 8 / SHARD_BYTES)
    by_rows = F.least(F.ceil(count / LEAST_ROWS), F.lit(FIRST_SHARDS))
    return stage(
        rows.groupBy("dim").agg(F.greatest(by_size, by_rows).cast("int").alias("shards")), "vector_shards"
    )


def most_shards(counts: DataFrame) -> int:
    return counts.agg(F.max("shards")).first()[0] or 0


def bounds_of_rounds(shards: int) -> Iterator[tuple[int, int]]:
    begin, end = 0, FIRST_SHARDS
    while begin < shards:
        yield begin, end
        begin, end = end, end * WIDER


def streamed(
    rows: DataFrame, queries: DataFrame, counts: DataFrame, begin: int, end: int,
    index: Callable[[pa.Table], Answer], schema: str,
) -> DataFrame:
    """What ``index``, made of the rows of a shard, answers for each batch of ``queries``.

    ``queries`` has the columns of ``rows`` and more of its own; ``index`` gets those of
    ``rows``, its answer all of them.
    """
    dealt = (
        rows.join(counts, "dim")
        .withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))
        .where(F.col("shard").between(begin, end - 1))
        .withColumn("late", F.lit(False))
    )
    last = F.least(F.col("shards"), F.lit(end)) - 1
    sent = (
        queries.join(counts, "dim")
        .where(F.col("shards") > begin)
        .withColumn("shard", F.explode(F.sequence(F.lit(begin), last)))
        .withColumn("late", F.lit(True))
    )
    both = dealt.unionByName(sent, allowMissingColumns=True).drop("shards")
    names, own = both.columns, rows.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, answer = None, [], None
        for batch in batches:
            marks = [batch.column(names.index(n)).to_numpy(zero_copy_only=False) for n in ("dim", "shard", "late")]
            turns = np.any([np.diff(m.astype(np.int64)) != 0 for m in marks], axis=0)
            edges = [0, *(np.flatnonzero(turns) + 1), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                part, place = batch.slice(a, b - a), (marks[0][a], marks[1][a])
                if place != at:
                    at, held, answer = place, [], None
                if not marks[2][a]:
                    held.append(part.select(own))
                elif held or answer:
                    if answer is None:
                        answer, held = index(pa.Table.from_batches(held)), []
                    found = answer(part)
                    if found.num_rows:
                        yield found

    return (
        both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "late").mapInArrow(task, schema)
    )


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of a column as the rows of a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(values, dtype=np.float64).reshape(len(column), dim)
