"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are its byte n-grams of ``ORDERS`` bytes, lower-cased over A-Z, with
everything that is not a letter as one space.  Each hashes to a row of an embedding
table; the mean of the rows goes through a linear softmax.  Both are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows.  A part of
the sample is held back to fit a temperature and the score below which a text is
rejected.  For prediction the table is multiplied by the softmax weights once, so that
a text costs one lookup per subword; whole texts are read.

The sample: at most about ``SAMPLE`` labelled rows, spread evenly over the labels, picked
by a hash of text and id.  Features of a sampled row are hashed counts, bounded by the
table, so a long text costs no more than the table on its way to the driver.

Cases: null text, and text without a letter, is ``und`` with score 0 and rejected; rows
without a label are predicted but not learned from; equal texts get equal results; with
no labelled row at all every text is ``und`` and rejected; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from emberwatch.llm.common import joined, slices
from emberwatch.storage import stage

UNKNOWN = "und"
SAMPLE = 6_000
ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
WIDTH = 16
EPOCHS, RATE, BATCH = 12, 0.5, 64
HELD_BACK = 5  # every so-manieth sampled row calibrates
# Share of correctly predicted calibration rows that the rejection score may cost.
COST_OF_REJECTION = 0.002
MOST_REJECTING_SCORE = 0.6

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


class Model(NamedTuple):
    labels: list[str]
    embedding: np.ndarray  # BUCKETS x WIDTH
    weights: np.ndarray  # WIDTH x labels
    bias: np.ndarray
    temperature: float
    reject_below: float


def subwords(data: np.ndarray, order: int) -> np.ndarray:
    """A bucket for the n-gram that begins at each byte but the last ``order - 1``."""
    folded = _FOLD[data].astype(np.uint32)
    value = np.full(len(folded) - order + 1, order, dtype=np.uint32)
    for i in range(order):
        value *= np.uint32(0x01000193)
        value ^= folded[i : i + len(value)]
    value *= np.uint32(0x9E3779B1)
    return value >> np.uint32(32 - 15)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's used buckets (16 bits each) and their shares (float32), packed."""
    for batch in slices(batches):
        data, starts = joined(batch.column(1))
        buckets, shares = [], []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a < max(ORDERS):
                used, share = np.zeros(0, np.int64), np.zeros(0, np.float32)
            else:
                counts = sum(np.bincount(subwords(data[a:b], o), minlength=BUCKETS) for o in ORDERS)
                used = np.flatnonzero(counts)
                share = counts[used].astype(np.float32) / counts.sum()
            buckets.append(used.astype(np.uint16).tobytes())
            shares.append(share.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())],
            ["label", "buckets", "shares"],
        )


def _sampled(labelled: DataFrame, limit: int) -> DataFrame:
    """About ``limit`` rows, as many of each label as there are or its even share."""
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    known = {r["label"]: r["n"] for r in sizes.orderBy(F.desc("n"), "label").limit(limit).collect()}
    if not known:
        return labelled.limit(0)
    share = limit / len(known)
    # Each label's chance as a threshold on a uniform hash of the row.
    chance = F.create_map(
        *[F.lit(x) for label, n in known.items() for x in (label, min(1.0, share / n))]
    )
    uniform = F.pmod(F.xxhash64("pick", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(uniform < F.element_at(chance, F.col("label"))).drop("pick")


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, bytes, bytes]], seed: int = 7) -> Model:
    """Train on (label, buckets, shares) rows, packed, and calibrate on those held back."""
    rows = [r for r in rows if r[1]]
    labels = sorted({r[0] for r in rows})
    number = {label: i for i, label in enumerate(labels)}
    random = np.random.default_rng(seed)
    rows = [rows[i] for i in random.permutation(len(rows))]
    features = [(np.frombuffer(b, np.uint16), np.frombuffer(c, np.float32)[:, None]) for _, b, c in rows]
    target = np.array([number[r[0]] for r in rows], dtype=np.int64)
    held = np.arange(len(rows)) % HELD_BACK == 0 if len(rows) >= 20 * HELD_BACK else np.zeros(len(rows), bool)
    table = (random.standard_normal((BUCKETS, WIDTH)) / WIDTH).astype(np.float32)
    weights = (random.standard_normal((WIDTH, len(labels))) / WIDTH).astype(np.float32)
    bias = np.zeros(len(labels), dtype=np.float32)
    learn = np.flatnonzero(~held)
    # Means of rows are small, so the table moves faster than the softmax.
    for epoch in range(EPOCHS if len(labels) > 1 else 0):
        rate = RATE * (1 - epoch / EPOCHS)
        for first in range(0, len(learn), BATCH):
            chosen = learn[first : first + BATCH]
            mean = np.stack([(table[features[i][0]] * features[i][1]).sum(axis=0) for i in chosen])
            error = _softmax(mean @ weights + bias)
            error[np.arange(len(chosen)), target[chosen]] -= 1
            back = error @ weights.T
            weights -= rate * (mean.T @ error) / len(chosen)
            bias -= rate * error.mean(axis=0)
            for i, gradient in zip(chosen, back, strict=True):
                table[features[i][0]] -= 20 * rate * features[i][1] * gradient[None, :]
        learn = random.permutation(learn)
    temperature, reject = 1.0, 0.0
    if held.any() and len(labels) > 1:
        chosen = np.flatnonzero(held)
        mean = np.stack([(table[features[i][0]] * features[i][1]).sum(axis=0) for i in chosen])
        logits, truth = mean @ weights + bias, target[chosen]

        def loss(t: float) -> float:
            return -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()

        temperature = min(np.geomspace(0.05, 5, 60), key=loss)
        best = _softmax(logits / temperature)
        right = np.sort(best.max(axis=1)[best.argmax(axis=1) == truth])
        if len(right):
            cost = right[int(len(right) * COST_OF_REJECTION)]
            reject = min(MOST_REJECTING_SCORE, float(cost))
    return Model(labels, table, weights, bias, float(temperature), reject)


def train(labelled: DataFrame, limit: int = SAMPLE) -> Model:
    """``labelled`` has label, text and pick, a value that the sample is picked by."""
    sample = _sampled(labelled.where("label is not null"), limit)
    features = sample.select("label", "text").mapInArrow(
        _features, "label string, buckets binary, shares binary"
    )
    # Made by all tasks, then read a part at a time: six bytes for each bucket that a text uses.
    found = stage(features, "language_features").toLocalIterator()
    rows = [(r["label"], bytes(r["buckets"]), bytes(r["shares"])) for r in found]
    rows.sort()
    return fit(rows)


def _has_letter(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; only texts without a-z and with other bytes are decoded."""
    plain = np.add.reduceat(((_FOLD[data] != 32) & (data < 128)).astype(np.int64), starts[:-1])
    other = np.add.reduceat((data >= 128).astype(np.int64), starts[:-1])
    found = plain > 0
    for i in np.flatnonzero(~found & (other > 0)):
        text = data[starts[i] : starts[i + 1]].tobytes().decode("utf-8", "replace")
        found[i] = any(c.isalpha() for c in text)
    return found


def predict_texts(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Label, score and whether rejected, for each text."""
    data, starts = joined(texts)
    rows = len(starts) - 1
    if not model.labels:
        return [UNKNOWN] * rows, np.zeros(rows), np.ones(rows, dtype=bool)
    scores = (model.embedding @ model.weights).astype(np.float32)
    total = np.zeros((rows, len(model.labels)), dtype=np.float64)
    count = np.zeros(rows)
    for order in ORDERS:
        if len(data) < order:
            continue
        buckets = subwords(data, order)
        # N-grams that would reach into the next text belong to none.
        inside = np.ones(len(buckets), dtype=bool)
        for back in range(1, order):
            at = starts[1:] - back
            inside[at[(at >= 0) & (at < len(buckets))]] = False
        ends = np.minimum(starts, len(buckets))
        for label in range(len(model.labels)):
            values = scores[buckets, label] * inside
            sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
            total[:, label] += sums[ends[1:]] - sums[ends[:-1]]
        sums = np.concatenate([[0], np.cumsum(inside)])
        count += sums[ends[1:]] - sums[ends[:-1]]
    logits = total / np.maximum(count, 1)[:, None] + model.bias
    chance = _softmax(logits / model.temperature)
    best = chance.argmax(axis=1)
    score = chance.max(axis=1)
    letters = _has_letter(data, starts)
    labels = [model.labels[b] if known else UNKNOWN for b, known in zip(best, letters, strict=True)]
    score = np.where(letters, np.clip(score, 0.0, 1.0), 0.0)
    return labels, score, ~letters | (score < model.reject_below)


def _predict(model: Model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            labels, score, rejected = predict_texts(model, batch.column(batch.num_columns - 1))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(labels, pa.string()), pa.array(score), pa.array(rejected)],
                [*names, "lang_pred", "score", "rejected"],
            )

    return task


def predict(model: Model, docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns with lang_pred, score and rejected."""
    kept = [F.col(c) for c in (keep or [])]
    rows = docs.select(*kept, F.col(text).alias("__text"))
    judged = StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return rows.mapInArrow(_predict(model), StructType([*rows.schema.fields[:-1], *judged.fields]))


def labelled_rows(docs: DataFrame, label: Column, learn: Column) -> DataFrame:
    """Rows to learn from, in the form that ``train`` takes."""
    return docs.where(learn).select(
        label.cast("string").alias("label"), F.col("text"), F.xxhash64("doc_id", "text").alias("pick")
    )
