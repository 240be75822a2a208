"""Hard negatives for anchors, found by coordinate pruning in length buckets.

Vectors become integers, floor(256 * x), and a row's score for an anchor is their inner
product.  An anchor's positives are its ``positives`` best other rows of the same label;
for each positive, the best ``negatives`` rows of another label are returned whose score
lies between ``low`` and ``high`` per cent of the positive's.

A shard's rows are put in buckets, longest first, of lengths within ``SHORTEST`` of the
bucket's longest; each coordinate of a bucket has its list of unit-vector components in
ascending order.  Both searches go through the buckets with the score a row must reach: at
first what the band asks for, then that of the last row that would be returned.

* A bucket whose longest row cannot reach it, for its length alone, ends the search.
* Otherwise, with the least cosine t that can reach it, the anchor's ``FOCUS`` largest
  components q name the focus coordinates; in each, only rows whose component lies in
  [q t - s, q t + s], s = sqrt((1 - q^2)(1 - t^2)), can have that cosine (up to 1 if
  q >= t, from -1 if -q >= t).  The ranges are cut from the sorted lists, and rows in all
  of them are candidates.
* Candidates are verified: integer inner products, exact in doubles while no product of
  two lengths passes 2^53, else in 64-bit integers.

Pruning is exact, so nothing is lost where it excludes little, as with vectors of equal
length in many dimensions; the work is then that of the verification.  ``vector_shards``
says how shards and anchors meet; the scores of a round bound the next one's.

Cases: a row with a null id, label or vector, or with null or non-finite components takes
no part, nor does one whose integers have a squared length of 2^62 or more, as its scores
fit no 64-bit integer; zero vectors take part with score 0; vectors of other lengths are
neither positives nor negatives; repeated ids are rows of their own; equal scores go to
the smaller id; a positive with a negative score has no negatives; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
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
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score
SCALE = 256
# A bucket holds lengths down to this share of its longest, and so many rows at most.
SHORTEST, BUCKET_ROWS = 0.9, 2_048
FOCUS = 3
LARGEST = float(1 << 62)
LEAST = np.iinfo(np.int64).min

POSITIVE_SCHEMA = "anchor long, positive_row long, positive_id long, score long"
NEGATIVE_SCHEMA = "anchor long, positive_row long, negative_row long, negative_id long, score long"


class Bucket:
    """Rows of about one length: integer vectors, and a sorted list for each coordinate."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, lengths: np.ndarray):
        self.rows, self.vectors = rows, vectors
        self.longest = float(lengths.max())
        unit = vectors / np.where(lengths > 0, lengths, 1)[:, None]
        self.order = np.argsort(unit, axis=0)
        self.sorted = np.take_along_axis(unit, self.order, axis=0)

    def candidates(self, unit: np.ndarray, length: float, least: int) -> np.ndarray | None:
        """Positions that may score ``least`` or more; None if no row of this length can."""
        everything = np.arange(len(self.rows))
        if least <= 0:
            return everything
        reach = length * self.longest
        if least > reach * (1 + 1e-12):
            return None
        cosine = min(1.0, least / reach) * (1 - 1e-12)
        hits = np.zeros(len(self.rows), dtype=np.int8)
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        for f in focus:
            q = unit[f]
            spread = np.sqrt(max(0.0, 1 - q * q) * (1 - cosine * cosine))
            above = 1.0 if q >= cosine else q * cosine + spread
            below = -1.0 if -q >= cosine else q * cosine - spread
            a, b = np.searchsorted(self.sorted[:, f], [below - 1e-9, above + 1e-9])
            hits[self.order[a:b, f]] += 1
        return np.flatnonzero(hits == len(focus))


class Shard:
    """A shard's rows in length buckets."""

    def __init__(self, table: pa.Table, dim: int):
        self.dim = dim
        self.row, self.id = (table.column(n).to_numpy() for n in ("row", "id"))
        self.label = table.column("label").to_numpy()
        vectors = matrix(table.column("vector"), dim)
        squared = (vectors * vectors).sum(axis=1)
        lengths = np.sqrt(squared)
        self.exact = float(lengths.max()) if len(lengths) else 0.0
        self.buckets: list[Bucket] = []
        order = np.argsort(-lengths, kind="stable")
        begin = 0
        while begin < len(order):
            part = order[begin : begin + BUCKET_ROWS]
            part = part[lengths[part] >= SHORTEST * lengths[part[0]]]
            self.buckets.append(Bucket(part, vectors[part], lengths[part]))
            begin += len(part)

    def scores(self, bucket: Bucket, at: np.ndarray, query: np.ndarray, length: float) -> np.ndarray:
        chosen = bucket.vectors if len(at) == len(bucket.rows) else bucket.vectors[at]
        if self.exact * length < float(1 << 52):
            return (chosen @ query).astype(np.int64)
        return chosen.astype(np.int64) @ query.astype(np.int64)

    def best(self, rows: np.ndarray, scores: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``count`` by score, then id."""
        order = np.lexsort((self.row[rows], self.id[rows], -scores))[:count]
        return rows[order], scores[order]

    def positives(self, own: int, label: int, query: np.ndarray, count: int, least: int):
        length = float(np.sqrt(query @ query))
        unit = query / length if length else query
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for bucket in self.buckets:
            at = bucket.candidates(unit, length, least)
            if at is None:
                break
            at = at[(self.label[bucket.rows[at]] == label) & (self.row[bucket.rows[at]] != own)]
            found = self.scores(bucket, at, query, length)
            able = found >= least
            rows, scores = self.best(
                np.concatenate([rows, bucket.rows[at[able]]]), np.concatenate([scores, found[able]]), count
            )
            if len(rows) == count:
                least = max(least, int(scores[-1]))
        return rows, scores

    def negatives(self, label: int, query: np.ndarray, count: int, lows: list[int], highs: list[int]):
        """For each band (low, high) its first rows of other labels, and their scores."""
        length = float(np.sqrt(query @ query))
        unit = query / length if length else query
        lows = list(lows)
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in lows]
        open_ = [i for i, (low, high) in enumerate(zip(lows, highs, strict=True)) if low <= high]
        for bucket in self.buckets if open_ else []:
            at = bucket.candidates(unit, length, min(lows[i] for i in open_))
            if at is None:
                break
            at = at[self.label[bucket.rows[at]] != label]
            found = self.scores(bucket, at, query, length)
            for i in open_:
                able = (found >= lows[i]) & (found <= highs[i])
                if not able.any():
                    continue
                rows, scores = kept[i]
                kept[i] = self.best(
                    np.concatenate([rows, bucket.rows[at[able]]]), np.concatenate([scores, found[able]]), count
                )
                if len(kept[i][0]) == count:
                    lows[i] = max(lows[i], int(kept[i][1][-1]))
        return kept


def _batch(found: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    parts = list(found)
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _positive_index(count: int):
    def index(table: pa.Table):
        dim = table.column("dim")[0].as_py()
        shard = Shard(table, dim)

        def found(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
            anchors = [batch.column(n).to_numpy() for n in ("row", "label", "least")]
            for own, label, least, query in zip(*anchors, matrix(batch.column("vector"), dim), strict=True):
                rows, scores = shard.positives(own, label, query, count, int(least))
                yield np.full(len(rows), own), shard.row[rows], shard.id[rows], scores

        return lambda batch: _batch(found(batch), ["anchor", "positive_row", "positive_id", "score"])

    return index


def _negative_index(count: int):
    def index(table: pa.Table):
        dim = table.column("dim")[0].as_py()
        shard = Shard(table, dim)

        def found(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
            anchors = [batch.column(n).to_numpy() for n in ("row", "label")]
            bands = batch.column("bands").to_pylist()
            for own, label, query, wanted in zip(*anchors, matrix(batch.column("vector"), dim), bands, strict=True):
                kept = shard.negatives(
                    label, query, count, [b["low"] for b in wanted], [b["high"] for b in wanted]
                )
                for band, (rows, scores) in zip(wanted, kept, strict=True):
                    if len(rows):
                        same = np.full(len(rows), own), np.full(len(rows), band["positive_row"])
                        yield *same, shard.row[rows], shard.id[rows], scores

        names = ["anchor", "positive_row", "negative_row", "negative_id", "score"]
        return lambda batch: _batch(found(batch), names)

    return index


def _ranked(found: DataFrame, groups: list[str], tie: list[str], count: int) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), *tie)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _share(score: str, per_cent: int, up: bool) -> Column:
    """score * per_cent / 100, rounded up or down; no product passes 64 bits."""
    hundreds = F.expr(f"({score} - pmod({score}, 100L)) div 100L")
    rest = F.pmod(F.col(score), F.lit(100)) * per_cent + (99 if up else 0)
    return hundreds * per_cent + F.floor(rest / 100)


def hard_negatives(
    table: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    label = (F.col(label) if isinstance(label, str) else label).cast("long")
    # NaN becomes null, as its floor would be 0.
    whole = F.transform(
        vector, lambda x: F.when(~F.isnan(x), F.floor(x.cast("double") * SCALE).cast("double"))
    )
    squared = F.aggregate(whole, F.lit(0.0), lambda total, x: total + x * x)
    labelled = table.where(label.isNotNull()).select(
        F.col(vec_id).alias("id"), label.alias("label"), F.col(vector).alias("vector"), whole.alias("whole"),
        squared.alias("squared"),
    )
    # The sum is null with a null component, and too large with an infinite one.
    rows = finite_vectors(labelled.where(F.col("squared") < LARGEST), "id", "whole", F.col("label"))
    counts = shard_counts(rows)
    shards = most_shards(counts)
    anchors = rows.where(F.col("id") % every == 0)

    best = None
    for begin, end in bounds_of_rounds(shards):
        asked = anchors.withColumn("least", F.lit(LEAST))
        if best is not None:
            full = best.where(F.col("rank") == positives).select(
                F.col("anchor").alias("row"), F.col("score").alias("worst")
            )
            asked = anchors.join(full, "row", "left").select(
                *anchors.columns, F.coalesce("worst", F.lit(LEAST)).alias("least")
            )
        found = streamed(rows, asked, counts, begin, end, _positive_index(positives), POSITIVE_SCHEMA)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = stage(_ranked(found, ["anchor"], ["positive_id", "positive_row"], positives), "positives")
    if best is None:
        schema = (
            "anchor_id long, positive_id long, rank int, negative_id long, positive_score long,"
            " negative_score long"
        )
        return table.sparkSession.createDataFrame([], schema)

    bands = best.select(
        "anchor", "positive_row", _share("score", low, True).alias("low"), _share("score", high, False).alias("high")
    )
    chosen = None
    for begin, end in bounds_of_rounds(shards):
        wanted = bands
        if chosen is not None:
            full = chosen.where(F.col("rank") == negatives).select(
                "anchor", "positive_row", F.col("score").alias("worst")
            )
            wanted = bands.join(full, ["anchor", "positive_row"], "left").select(
                "anchor", "positive_row", F.coalesce("worst", "low").alias("low"), "high"
            )
        wanted = wanted.groupBy(F.col("anchor").alias("row")).agg(
            F.collect_list(F.struct("positive_row", "low", "high")).alias("bands")
        )
        asked = anchors.join(wanted, "row").select(*anchors.columns, "bands")
        found = streamed(rows, asked, counts, begin, end, _negative_index(negatives), NEGATIVE_SCHEMA)
        if chosen is not None:
            found = found.unionByName(chosen.drop("rank"))
        chosen = stage(
            _ranked(found, ["anchor", "positive_row"], ["negative_id", "negative_row"], negatives), "negatives"
        )
    named = best.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select(
        "anchor", "positive_row", "anchor_id", "positive_id", F.col("score").alias("positive_score")
    )
    return chosen.join(named, ["anchor", "positive_row"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score")
    )
