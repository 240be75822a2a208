"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

Tokens are words and one end per text.  The model splits the probability of a token,

    P(token | context) = P(class | context) P(member | class, context) P(token | bucket),

where a token's hash is its bucket, a class with a member.  Class and member are
softmax outputs over hashed features of the context: the token before, the two before
together (n-grams), and the second before alone (a skip).  The last factor is a token's
share of its bucket by exact counts, with half a count added for every known token and
for all unknown ones together, which are one kind in one bucket; so the probabilities of
all known tokens and of the unknown kind add up to one.  Without features the model is
the base score, from which training starts.

Counts and training cover all rows to learn from.  A feature has about as many rows as
an eighth of the square root of the counted tokens (``contexts_for``), up to
``MOST_CONTEXTS``, so that a larger corpus trains a larger model and each weight sees more
tokens.  Weights are trained in ``ROUNDS`` rounds, each over its own part of the rows:
every task starts from the shared weights and makes gradient steps over its rows, and
Spark averages the weights of all tasks by the tokens they saw, in two levels so that no
group grows with the number of tasks.  Input partitions are put together until a task
sees about a token per weight, so what is averaged stays in proportion to the tokens.
``score`` therefore depends, slightly, on how the input is cut into partitions.

Counts never leave the cluster: a *block* is a run of rows of one input file; its
different words are joined with the counts and come back to the block's texts, which
are scored in sparse numpy batches.  A block is bounded in rows, and with it what one
group holds.

Cases: null text is empty and has one token, its end; a row with a null id is learned
from and is not held out; equal rows each count; a text of any length is read whole;
without rows to learn from every count is zero; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import fold, mix64, slices, utf8
from emberwatch.storage import stage

CLASSES, MEMBERS = 16, 16
BUCKETS = CLASSES * MEMBERS
FEATURES = 3
# Hashed rows of each feature; the most of them bound the weights to 107 MB.
LEAST_CONTEXTS, MOST_CONTEXTS = 1 << 8, 1 << 15
LEAST_TASKS = 64  # partitions that a training round keeps at least
ROUNDS = 2
MINIBATCH = 1 << 15
RATE = 0.3
# A block's text, about, and how many blocks a small table is cut into at least.
BLOCK_BYTES = 16_000_000
LEAST_BLOCKS = 64
CHUNK = 1 << 12  # weights that one row of an averaging step holds
END = b""
UNKNOWN_BUCKET = 0


class Weights(NamedTuple):
    class_bias: np.ndarray  # CLASSES
    member_bias: np.ndarray  # CLASSES x MEMBERS
    by_class: np.ndarray  # FEATURES * rows of a feature x CLASSES
    by_member: np.ndarray  # FEATURES * rows of a feature * CLASSES x MEMBERS

    @property
    def contexts(self) -> int:
        """Rows of one feature."""
        return len(self.by_class) // FEATURES

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self]).astype(np.float32)


PER_CONTEXT = FEATURES * CLASSES * (1 + MEMBERS)


def contexts_for(tokens: int) -> int:
    """Rows of a feature for so many tokens to learn from: a power of two."""
    wanted = 1 << max(0, round(np.log2(max(1, tokens)) / 2 - 3))
    return int(min(max(wanted, LEAST_CONTEXTS), MOST_CONTEXTS))


def unflat(values: np.ndarray) -> Weights:
    contexts = (len(values) - CLASSES - BUCKETS) // PER_CONTEXT
    rows = FEATURES * contexts
    out, at = [], 0
    for shape in ((CLASSES,), (CLASSES, MEMBERS), (rows, CLASSES), (rows * CLASSES, MEMBERS)):
        size = int(np.prod(shape))
        out.append(values[at : at + size].reshape(shape).copy())
        at += size
    return Weights(*out)


def starting(bins: Bins) -> Weights:
    """Without any feature the model gives each bucket its share of the tokens."""
    # An empty bucket has a share as well, so that its logarithm is finite.
    share = bins.sizes().reshape(CLASSES, MEMBERS) + 1e-6
    of_class, rows = share.sum(axis=1), FEATURES * contexts_for(bins.tokens)
    return Weights(
        np.log(of_class / of_class.sum()).astype(np.float32),
        np.log(share / of_class[:, None]).astype(np.float32),
        np.zeros((rows, CLASSES), dtype=np.float32),
        np.zeros((rows * CLASSES, MEMBERS), dtype=np.float32),
    )


# --- tokens -------------------------------------------------------------------------------


def tokens_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, and the end."""
    words = text.lower().split()
    words.append(END)
    return words


def hashes_of(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


class Stream(NamedTuple):
    """Texts one after the other: a hash per token, and where each text begins."""

    hashes: np.ndarray
    starts: np.ndarray


def contexts(stream: Stream, size: int) -> np.ndarray:
    """FEATURES rows of context numbers for every token; texts begin after two ends."""
    h, end = stream.hashes, hashes_of([END])[0]
    one = np.concatenate([[end], h[:-1]])
    two = np.concatenate([[end, end], h[:-2]])[: len(h)]
    # The token before a text is the end of another one, or the same end mark.
    second = stream.starts[:-1] + 1
    two[second[second < len(h)]] = end
    two[stream.starts[:-1]] = end
    parts = (mix64(one), mix64(one * np.uint64(0x9E3779B97F4A7C15) + two), mix64(two + np.uint64(77)))
    return np.stack(
        [(x >> np.uint64(40)).astype(np.int64) % size + i * size for i, x in enumerate(parts)]
    )


_ONES = np.ones(max(CLASSES, MEMBERS), dtype=np.float32)


def _exp(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials, and their totals per row; logits are at most 60 either way, in place."""
    np.clip(logits, -60, 60, out=logits)
    e = np.exp(logits)
    return e, e @ _ONES[: e.shape[1]]


def _soft(logits: np.ndarray) -> np.ndarray:
    e, total = _exp(logits)
    e /= total[:, None]
    return e


def _logits(w: Weights, rows: np.ndarray, of_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs for the classes, and for the members of tokens' given classes."""
    first = w.class_bias + w.by_class[rows[0]]
    second = w.member_bias[of_class] + w.by_member[rows[0] * CLASSES + of_class]
    for row in rows[1:]:
        first += w.by_class[row]
        second += w.by_member[row * CLASSES + of_class]
    return first, second


def _log_share(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of one output per row."""
    _, total = _exp(logits)
    return logits[np.arange(len(logits)), chosen] - np.log(total)


def _summed(rows: np.ndarray, size: int, gradient: np.ndarray) -> np.ndarray:
    """Sums of the tokens' gradients for the FEATURES * size rows that they use."""
    own = rows - np.arange(FEATURES)[:, None] * size
    out = np.empty((gradient.shape[1], FEATURES * size), dtype=np.float32)
    for column, weights in zip(out, np.ascontiguousarray(gradient.T, dtype=np.float64), strict=True):
        for f in range(FEATURES):
            column[f * size : (f + 1) * size] = np.bincount(own[f], weights, size)
    return np.ascontiguousarray(out.T)


def log10_tokens(w: Weights, bins: Bins, stream: Stream, counts: np.ndarray) -> np.ndarray:
    """log10 of the model's probability of every token; ``counts`` has 0 for an unknown one."""
    rows = contexts(stream, w.contexts)
    bucket = np.where(counts > 0, bucket_of(stream.hashes), UNKNOWN_BUCKET)
    of_class, member = np.divmod(bucket, MEMBERS)
    out = np.empty(len(bucket))
    for i in range(0, len(bucket), MINIBATCH):
        part = slice(i, i + MINIBATCH)
        first, second = _logits(w, rows[:, part], of_class[part])
        out[part] = _log_share(first, of_class[part]) + _log_share(second, member[part])
    return out / np.log(10) + np.log10((counts + 0.5) / bins.sizes()[bucket])


# --- training -----------------------------------------------------------------------------


class Trainer:
    """Gradient steps with per-weight rates over the tokens of one task."""

    def __init__(self, w: Weights):
        self.w = w
        self.squares = [np.full(x.shape, 1e-6, dtype=np.float32) for x in w]
        self.tokens = 0

    def learn(self, stream: Stream) -> None:
        rows, bucket = contexts(stream, self.w.contexts), bucket_of(stream.hashes)
        of_class, member = np.divmod(bucket, MEMBERS)
        for i in range(0, len(bucket), MINIBATCH):
            part = slice(i, i + MINIBATCH)
            self._step(rows[:, part], of_class[part], member[part])
        self.tokens += len(bucket)

    def _step(self, rows: np.ndarray, of_class: np.ndarray, member: np.ndarray) -> None:
        first, second = (_soft(x) for x in _logits(self.w, rows, of_class))
        n, contexts = np.arange(len(first)), self.w.contexts
        first[n, of_class] -= 1
        second[n, member] -= 1
        scale = np.float32(1.0 / len(n))
        by_class = _summed(rows, contexts, first)
        by_member = _summed(rows * CLASSES + of_class, contexts * CLASSES, second)
        by_bias = np.stack([np.bincount(of_class, second[:, o], CLASSES) for o in range(MEMBERS)], axis=1)
        for w, s, g in zip(
            self.w, self.squares, (first.sum(axis=0), by_bias, by_class, by_member), strict=True
        ):
            g = np.multiply(g, scale, dtype=np.float32)
            s += g * g
            g *= np.float32(RATE)
            g /= np.sqrt(s)
            w -= g


def _train(values: np.ndarray):
    """One task's weights after its rows, in chunks, with the tokens they stand for."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trainer = Trainer(unflat(values))
        for batch in slices(batches):
            trainer.learn(stream_of(utf8(batch.column(0))))
        if not trainer.tokens:
            return
        flat = trainer.w.flat()
        chunks = range(0, len(flat), CHUNK)
        number = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([i // CHUNK for i in chunks], pa.int32()),
                pa.array([number] * len(chunks), pa.int64()),
                pa.array([trainer.tokens] * len(chunks), pa.float64()),
                pa.array([flat[i : i + CHUNK].tobytes() for i in chunks], pa.binary()),
            ],
            ["chunk", "part", "tokens", "weights"],
        )

    return task


def _average(table: pa.Table) -> pa.Table:
    """The mean of a chunk over tasks, weighed by their tokens."""
    tokens = np.asarray(table.column("tokens"))
    total = np.zeros(1)
    for weight, values in zip(tokens, table.column("weights"), strict=True):
        total = total + weight * np.frombuffer(values.as_py(), dtype=np.float32).astype(np.float64)
    mean = (total / tokens.sum()).astype(np.float32).tobytes()
    return pa.table(
        {
            "chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()),
            "part": pa.array([0], pa.int64()),
            "tokens": pa.array([float(tokens.sum())], pa.float64()),
            "weights": pa.array([mean], pa.binary()),
        }
    )


_CHUNKS = "chunk int, part long, tokens double, weights binary"


def train_round(texts: DataFrame, w: Weights, tasks: int) -> Weights:
    """One round of distributed gradient updates over ``texts``, which has text, in ``tasks`` at most."""
    local = texts.select("text").coalesce(tasks).mapInArrow(_train(w.flat()), _CHUNKS)
    some = (
        local.withColumn("part", F.pmod("part", F.lit(64)))
        .groupBy("chunk", "part")
        .applyInArrow(_average, _CHUNKS)
        .groupBy("chunk")
        .applyInArrow(_average, _CHUNKS)
    )
    # The weights grow with the square root of the corpus, up to MOST_CONTEXTS.
    found = {r["chunk"]: r["weights"] for r in some.collect()}
    if not found:
        return w
    return unflat(np.frombuffer(b"".join(bytes(found[i]) for i in sorted(found)), dtype=np.float32))


def stream_of(texts: list[bytes]) -> Stream:
    words: list[bytes] = []
    starts = [0]
    for text in texts:
        words += tokens_of(text)
        starts.append(len(words))
    return Stream(hashes_of(words), np.array(starts))


# --- counts -------------------------------------------------------------------------------


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word, n): every word of a block once per task, with its training count."""
    now, known, learned = None, set(), Counter()  # known has words of rows that are held out

    def ready() -> pa.RecordBatch:
        others = known.difference(learned)
        words = [*learned, *others]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(words), now)),
                pa.array(words, pa.binary()).cast(pa.string()),
                pa.array([*learned.values(), *[0] * len(others)], pa.int64()),
            ],
            ["block", "word", "n"],
        )

    for batch in slices(batches):
        for block, held, text in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True
        ):
            if block != now:
                if known or learned:
                    yield ready()
                now, known, learned = block, set(), Counter()
            (known if held else learned).update(tokens_of(text))
    if known or learned:
        yield ready()


class Bins(NamedTuple):
    """Exact totals: tokens, different words, and both per bucket."""

    tokens: int
    words: int
    bucket_tokens: np.ndarray
    bucket_words: np.ndarray

    def sizes(self) -> np.ndarray:
        """Counts of each bucket with the half added for each known word and the unknown kind."""
        out = self.bucket_tokens + 0.5 * self.bucket_words
        out[UNKNOWN_BUCKET] += 0.5
        return out


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, c, v): tokens and different words of the buckets, once per task."""
    tokens, words = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        bucket = bucket_of(hashes_of(utf8(batch.column(0))))
        # Whole numbers: a sum of floating-point weights would not be exact for all counts.
        np.add.at(tokens, bucket, np.asarray(batch.column(1)))
        words += np.bincount(bucket, minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(BUCKETS), pa.int32()), pa.array(tokens), pa.array(words)], ["bucket", "c", "v"]
    )


def _bins(counts: DataFrame) -> Bins:
    tally = counts.select("word", "c").mapInArrow(_tally, "bucket int, c long, v long")
    rows = tally.groupBy("bucket").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect()
    tokens, words = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        tokens[r["bucket"]], words[r["bucket"]] = r["c"], r["v"]
    return Bins(sum(r["c"] for r in rows), sum(r["v"] for r in rows), tokens, words)


# --- scoring ------------------------------------------------------------------------------

SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)


class Known:
    """The words of a block, each found by its hash; by itself where two of them share one."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        hashes = hashes_of(words)
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        # A block's words may come from several tasks, so one word can be there more than once.
        repeated = self.hashes[1:][self.hashes[1:] == self.hashes[:-1]]
        often = np.flatnonzero(np.isin(hashes, repeated)).tolist()
        first = {int(hashes[i]): words[i] for i in often}
        different = {int(hashes[i]) for i in often if first[int(hashes[i])] != words[i]}
        self.shared = np.array(sorted(different), dtype=np.uint64)
        self.apart = {words[i]: counts[i] for i in often if int(hashes[i]) in different}

    def counts_of(self, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Counts of words that are all known."""
        found = self.counts[np.searchsorted(self.hashes, hashes)]
        if len(self.shared):
            for i in np.flatnonzero(np.isin(hashes, self.shared)):
                found[i] = self.apart[words[i]]
        return found


def _score(values: np.ndarray, bins: Bins):
    def block(docs: pa.Table, words: pa.Table) -> pa.Table:
        w = unflat(values)
        counts = np.asarray(words.column("c")).astype(np.float64)
        known = Known(words.column("word").cast(pa.binary()).to_numpy().tolist(), counts)
        total = np.log10(bins.tokens + 0.5 * (bins.words + 1))
        parts = []
        for batch in slices(iter(docs.combine_chunks().to_batches())):
            texts = [tokens_of(t) for t in utf8(batch.column(batch.schema.get_field_index("text")))]
            flat = list(chain.from_iterable(texts))
            stream = Stream(hashes_of(flat), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
            c = known.counts_of(flat, stream.hashes)
            model = log10_tokens(w, bins, stream, c)
            base = np.log10(c + 0.5) - total
            sums = [np.add.reduceat(x, stream.starts[:-1]) for x in (c > 0, base, model)]
            rows = len(texts)
            parts.append(
                pa.table(
                    {
                        "doc_id": batch.column(batch.schema.get_field_index("doc_id")),
                        "held_out": batch.column(batch.schema.get_field_index("held_out")),
                        "n_tokens": pa.array(np.diff(stream.starts).astype(np.int64)),
                        "n_known": pa.array(sums[0].astype(np.int64)),
                        "train_tokens": pa.array([bins.tokens] * rows, pa.int64()),
                        "base_score": pa.array(sums[1]),
                        "score": pa.array(sums[2]),
                    }
                )
            )
        if not parts:
            parts = [pa.table({}, schema=_scored_schema())]
        return pa.concat_tables(parts)

    return block


def _scored_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SCORED.split(", "))])


def _in_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, text, held_out and block, a run of rows of one file."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *place)
    except AnalysisException:  # rows that are not read from files
        placed = stage(named, "lm_rows").select("doc_id", "text", *place)
    size = placed.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text").cast("long")).alias("bytes")
    ).first()
    rows, text = size["rows"], size["bytes"] or 0
    blocks = max(LEAST_BLOCKS, -(-text // BLOCK_BYTES))
    per_block = max(1, rows // blocks)
    return placed.select(
        F.xxhash64("file", F.floor(F.col("row") / per_block)).alias("block"),
        F.coalesce(fold() == 1, F.lit(False)).alias("held_out"),
        "text",
        "doc_id",
    )


def lm_score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    placed = _in_blocks(docs)
    words = stage(
        placed.select("block", "held_out", "text").mapInArrow(
            _block_words, "block long, word string, n long"
        ),
        "lm_words",
    )
    counts = stage(
        words.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"),
        "lm_counts",
    )
    bins = _bins(counts)
    w = starting(bins)
    tasks = max(LEAST_TASKS, bins.tokens // rounds // len(w.flat()))
    part = F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds))
    for i in range(rounds):
        w = train_round(placed.where(~F.col("held_out") & (part == i)), w, tasks)
    found = words.select("block", "word").join(counts.select("word", "c"), "word", "left").select(
        "block", "word", F.coalesce("c", F.lit(0)).alias("c")
    )
    return (
        placed.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_score(w.flat(), bins), SCORED)
    )
