"""Approximate nearest neighbours by randomly rotated one-bit codes.

Within a shard, vectors are taken relative to the shard's mean, normalised, and rotated by
a random orthogonal matrix; the signs are the code, packed into 64-bit words.  For a unit
vector o and its code o' (signs / sqrt(dim)), the inner product with a unit query q is
estimated by <o', q> / <o', o>; <o', o> is kept as the correction scalar.  The query is
rotated too and written as ``PLANES`` bit planes, so <o', q> is counted from packed bits:
AND and bit counts.  The error of the estimate is at most

    sqrt((1 - <o', o>^2) / <o', o>^2) * CONFIDENCE / sqrt(dim - 1)

but for a probability that falls as the Gaussian tail of ``CONFIDENCE``; what rounding the
query adds is bounded exactly.  So each vector has a lower bound of its distance.  The
``k`` most promising ones are measured, and then every vector whose lower bound is within
the k-th distance so far, of this shard or of earlier rounds, on original vectors in
double precision.  No vector is left out for another reason; recall is measured in tests.

Every row whose id is divisible by ``every`` is a query, against all other rows of the
same number of components.  ``vector_shards`` says how shards and queries meet.

Cases: a row with a null id, a null, empty or zero vector, or one with null or non-finite
components takes no part; vectors of other lengths are no candidates; repeated ids are rows
of their own (each is a query, and a candidate of the other); equal distances go to the
smaller id; squared distances beyond the doubles are infinite; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.vector_shards import (
    bounds_of_rounds,
    finite_vectors,
    matrix,
    most_shards,
    shard_counts,
    streamed,
)
from emberwatch.storage import stage

EVERY = 100
K = 10
# Bits of a query's components.
PLANES = 6
CONFIDENCE = 3.5
# Pairs of a query and a code that are estimated at a time.
BLOCK = 1 << 18
SCHEMA = "query_row long, query_id long, row long, vec_id long, score double"


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in all tasks."""
    drawn, upper = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return drawn * np.sign(np.diag(upper))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    words = -(-bits.shape[1] // 64)
    padded = np.zeros((len(bits), words * 64), dtype=bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1).view(np.uint64)


class Codes:
    """The codes of a shard's vectors with their correction scalars."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.dim = vectors, vectors.shape[1]
        # Scaled before anything is squared, so that large components stay finite.
        self.scale = float(np.abs(vectors).max())
        scaled = vectors / self.scale
        self.centre = scaled.mean(axis=0)
        rest = scaled - self.centre
        self.norm = np.sqrt((rest * rest).sum(axis=1))
        unit = rest / np.where(self.norm > 0, self.norm, 1)[:, None]
        turned = unit @ rotation(self.dim)
        self.bits = packed(turned > 0)
        self.ones = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        # <o', o>; a vector at the centre has no direction, and its estimate no weight.
        self.fit = np.abs(turned).sum(axis=1) / np.sqrt(self.dim)
        safe = np.where(self.fit > 0, self.fit, 1)
        spread = np.sqrt(np.maximum(0, 1 - self.fit**2)) / safe
        self.error = spread * CONFIDENCE / np.sqrt(max(1, self.dim - 1))
        self.safe = safe

    def lower_bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and vector a lower bound of the squared distance / scale^2."""
        rest = queries / self.scale - self.centre
        norm = np.sqrt((rest * rest).sum(axis=1))
        turned = (rest / np.where(norm > 0, norm, 1)[:, None]) @ rotation(self.dim)
        low = turned.min(axis=1)
        step = (turned.max(axis=1) - low) / ((1 << PLANES) - 1)
        level = np.rint((turned - low[:, None]) / np.where(step > 0, step, 1)[:, None]).astype(np.int64)
        rounded = low[:, None] + level * step[:, None]
        lost = np.abs(turned - rounded).sum(axis=1)
        counted = np.zeros((len(queries), len(self.bits)), dtype=np.int64)
        for plane in range(PLANES):
            bits = packed((level >> plane & 1).astype(bool))
            for word in range(bits.shape[1]):
                shared = np.bitwise_count(bits[:, word, None] & self.bits[None, :, word])
                counted += shared.astype(np.int64) << plane
        # The sum over the code's ones, doubled, less the sum over all components.
        signed = 2 * (low[:, None] * self.ones[None, :] + step[:, None] * counted) - rounded.sum(axis=1)[:, None]
        product = (signed + lost[:, None]) / np.sqrt(self.dim) / self.safe[None, :] + self.error[None, :]
        product = np.where(self.fit[None, :] > 0, np.minimum(product, 1), 1)
        return (
            self.norm[None, :] ** 2 + norm[:, None] ** 2 - 2 * product * self.norm[None, :] * norm[:, None]
        )

    def distances(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Euclidean distances, squares added one after the other."""
        with np.errstate(over="ignore"):
            apart = self.vectors[at] - query
            return np.sqrt(np.cumsum(apart * apart, axis=1)[:, -1])


def _index(k: int):
    def index(shard: pa.Table):
        dim = shard.column("dim")[0].as_py()
        codes = Codes(matrix(shard.column("vector"), dim))
        rows, ids = (shard.column(n).to_numpy() for n in ("row", "id"))

        def nearest(query: np.ndarray, own: int, bound: float, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            lower = np.where(rows == own, np.inf, lower)
            at = np.argpartition(lower, k)[:k] if len(lower) > k else np.arange(len(lower))
            at = at[rows[at] != own]
            if len(at) >= k:
                bound = min(bound, float(np.sort(codes.distances(query, at))[k - 1]))
            # A little above, for what rounding may take from the bounds.
            limit = (bound / codes.scale) ** 2 * (1 + 1e-9) + 1e-9
            at = np.flatnonzero((lower <= limit) & (rows != own))
            far = codes.distances(query, at)
            order = np.lexsort((rows[at], ids[at], far))[:k]
            order = order[far[order] <= bound]
            return at[order], far[order]

        def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
            queries = matrix(batch.column("vector"), dim)
            own, own_id, bounds = (batch.column(n).to_numpy() for n in ("row", "id", "bound"))
            found: list[tuple[np.ndarray, ...]] = []
            width = max(1, BLOCK // len(rows))
            for a in range(0, len(queries), width):
                lower = codes.lower_bounds(queries[a : a + width])
                for i, line in enumerate(lower, a):
                    at, far = nearest(queries[i], own[i], bounds[i], line)
                    found.append((np.full(len(at), own[i]), np.full(len(at), own_id[i]), rows[at], ids[at], far))
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], ["query_row", "query_id", "row", "vec_id", "score"]
            )

        return answer

    return index


def nearest_neighbours(
    table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = K
) -> DataFrame:
    """The ``k`` nearest rows of each query: query_id, rank, vec_id, score."""
    rows = finite_vectors(table.where(F.exists(vector, lambda x: x != 0)), vec_id, vector)
    counts = shard_counts(rows)
    asked = rows.where(F.col("id") % every == 0)
    found = None
    by_query = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")
    for begin, end in bounds_of_rounds(most_shards(counts)):
        bounded = asked.withColumn("bound", F.lit(float("inf")))
        if found is not None:
            full = found.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("kth"))
            bounded = asked.join(full, "row", "left").select(
                *asked.columns, F.coalesce("kth", F.lit(float("inf"))).alias("bound")
            )
        more = streamed(rows, bounded, counts, begin, end, _index(k), SCHEMA)
        if found is not None:
            more = more.unionByName(found.drop("rank"))
        found = stage(
            more.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k), "neighbours"
        )
    if found is None:
        found = table.sparkSession.createDataFrame([], SCHEMA + ", rank int")
    return found.select("query_id", "rank", "vec_id", "score")
