"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its hashed word embedding beside the mean of its hashed character
trigram embeddings.  Two gated recurrent layers read a window of words, one from each
end; attention weighs their states into one vector, whose logit is the window's.  A
text is cut into windows of ``WINDOW`` words that overlap by half, all of them are
scored, and the highest logit, put on a probability scale, is the text's score.

Only whole texts are labelled, so training picks windows: of a toxic text the one that
looks worst, of a clean text its worst-looking and a random one; at first by the log
odds of words, then by the network itself.  The sample has at most about ``SAMPLE``
labelled texts, half of each label as far as there are, picked by a hash of the id; a
part of it is held back to fit the scale, with the labels' true shares as weights.

Cases: null and empty texts are one window of padding, and are scored; short texts are
one padded window; a text labelled more than once counts as toxic if any label says so;
null labels are not learned from; with one label only, every score is its share; equal
texts get equal scores; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import plain_words, slices, utf8

SAMPLE = 3_000
WINDOW, STRIDE = 32, 16
WORD_ROWS, WORD_WIDTH = 1 << 13, 12
CHAR_ROWS, CHAR_WIDTH = 1 << 10, 6
INPUT = WORD_WIDTH + CHAR_WIDTH
HIDDEN, ATTEND = 8, 8
EPOCHS, ROUNDS, RATE, BATCH = 4, 3, 0.01, 128
# A small sample takes smaller batches and more epochs, up to this many steps in a round.
LEAST_STEPS, LEAST_BATCH = 160, 16
HELD_BACK = 4
WINDOWS_AT_ONCE = 4096
CLOSED = 30.0  # update gate of padding: the state stays as it is


class Model(NamedTuple):
    p: dict[str, np.ndarray]
    slope: float
    shift: float


# --- words and windows --------------------------------------------------------------------


class Words(NamedTuple):
    """Different words of a batch: hashed rows of their embeddings. Number 0 is padding."""

    rows: np.ndarray
    grams: np.ndarray
    firsts: np.ndarray  # where each word's trigrams begin


def hashed_words(words: list[bytes]) -> Words:
    from xxhash import xxh3_64_intdigest

    rows = np.array([xxh3_64_intdigest(w) % WORD_ROWS for w in words], dtype=np.int64)
    marked = np.frombuffer(b"".join(b"<" + w + b">" for w in words), dtype=np.uint8).astype(np.uint32)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    if not len(words):
        return Words(rows, np.zeros(0, np.int64), np.zeros(1, np.int64))
    value = (marked[:-2] * np.uint32(961) + marked[1:-1] * np.uint32(31) + marked[2:]) * np.uint32(0x9E3779B1)
    grams = (value >> np.uint32(22)).astype(np.int64)
    # Of the trigrams that begin at each byte, those of a word are its first ``size``.
    begin = np.cumsum(sizes + 2) - sizes - 2
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.repeat(begin - firsts[:-1], sizes) + np.arange(firsts[-1])
    return Words(rows, grams[inside], firsts)


def windows_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different words, all windows as word numbers from 1, and the window count per text."""
    numbers: dict[bytes, int] = {}
    parts, counts = [], []
    for text in texts:
        words = plain_words(text)
        ids = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], dtype=np.int32)
        if len(ids) <= WINDOW:
            row = np.zeros((1, WINDOW), dtype=np.int32)
            row[0, : len(ids)] = ids
            parts.append(row)
        else:
            starts = np.arange(0, len(ids) - WINDOW, STRIDE)
            starts = np.append(starts, len(ids) - WINDOW)
            parts.append(ids[starts[:, None] + np.arange(WINDOW)])
        counts.append(len(parts[-1]))
    windows = np.concatenate(parts) if parts else np.zeros((0, WINDOW), dtype=np.int32)
    return list(numbers), windows, np.array(counts, dtype=np.int64)


# --- the network --------------------------------------------------------------------------


def initial(random: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(*shape: int) -> np.ndarray:
        return (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    p = {
        "word": (random.standard_normal((WORD_ROWS, WORD_WIDTH)) * 0.1).astype(np.float32),
        "char": (random.standard_normal((CHAR_ROWS, CHAR_WIDTH)) * 0.1).astype(np.float32),
        "A": normal(2 * HIDDEN, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": normal(ATTEND),
        "w": normal(2 * HIDDEN), "b": np.zeros(1, np.float32),
    }
    for side in "fb":
        p |= {
            f"W{side}": normal(INPUT, 3 * HIDDEN),
            f"U{side}": normal(HIDDEN, 3 * HIDDEN),
            f"c{side}": np.zeros(3 * HIDDEN, np.float32),
        }
    return p


def inputs(p: dict, words: Words) -> np.ndarray:
    """One row per word, and row 0 for padding."""
    sizes = np.maximum(np.diff(words.firsts), 1)
    sums = np.concatenate([np.zeros((1, CHAR_WIDTH)), np.cumsum(p["char"][words.grams], axis=0, dtype=np.float64)])
    mean = (sums[words.firsts[1:]] - sums[words.firsts[:-1]]) / sizes[:, None]
    out = np.zeros((len(words.rows) + 1, INPUT), dtype=np.float32)
    out[1:, :WORD_WIDTH] = p["word"][words.rows]
    out[1:, WORD_WIDTH:] = mean
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def projected(p: dict, x: np.ndarray, side: str) -> np.ndarray:
    """Gate inputs (update, reset, new) of every word; padding keeps the state."""
    out = x @ p[f"W{side}"] + p[f"c{side}"]
    out[0] = 0
    out[0, :HIDDEN] = CLOSED
    return out


def _layer(p: dict, gates: np.ndarray, windows: np.ndarray, side: str, keep: list | None) -> np.ndarray:
    """States after each word, in the order of the words."""
    n, H = len(windows), HIDDEN
    h = np.zeros((n, H), dtype=np.float32)
    out = np.empty((WINDOW, n, H), dtype=np.float32)
    for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
        g = gates[windows[:, t]]
        u = h @ p[f"U{side}"]
        zr = _sigmoid(g[:, : 2 * H] + u[:, : 2 * H])
        z, r = zr[:, :H], zr[:, H:]
        new = np.tanh(g[:, 2 * H :] + r * u[:, 2 * H :])
        before, h = h, new + z * (h - new)
        out[t] = h
        if keep is not None:
            keep.append((t, z, r, new, u[:, 2 * H :], before))
    return out


def _pool(p: dict, states: np.ndarray, windows: np.ndarray) -> tuple:
    """Logits by attention over the words of each window; padding has no weight."""
    u = np.tanh(states @ p["A"] + p["a"])
    score = u @ p["v"]
    score[windows.T == 0] = -1e9
    weight = np.exp(score - score.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (weight[:, :, None] * states).sum(axis=0)
    return pooled @ p["w"] + p["b"][0], (u, weight, pooled)


def logits_of(p: dict, words: list[bytes], windows: np.ndarray) -> np.ndarray:
    x = inputs(p, hashed_words(words))
    gates = {side: projected(p, x, side) for side in "fb"}
    out = np.empty(len(windows), dtype=np.float32)
    for i in range(0, len(windows), WINDOWS_AT_ONCE):
        part = windows[i : i + WINDOWS_AT_ONCE]
        states = np.concatenate([_layer(p, gates[s], part, s, None) for s in "fb"], axis=2)
        out[i : i + WINDOWS_AT_ONCE] = _pool(p, states, part)[0]
    return out


def gradients(p: dict, words: Words, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss over the windows."""
    n, H = len(windows), HIDDEN
    x = inputs(p, words)
    kept: dict[str, list] = {"f": [], "b": []}
    gates = {side: projected(p, x, side) for side in "fb"}
    states = np.concatenate([_layer(p, gates[s], windows, s, kept[s]) for s in "fb"], axis=2)
    logit, (u, weight, pooled) = _pool(p, states, windows)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    d = ((_sigmoid(logit) - target) / n).astype(np.float32)
    g["w"], g["b"][0] = d @ pooled, d.sum()
    d_pooled = d[:, None] * p["w"]
    d_weight = (states * d_pooled).sum(axis=2)
    d_states = weight[:, :, None] * d_pooled
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["v"] = np.einsum("tna,tn->a", u, d_score)
    d_u = d_score[:, :, None] * p["v"] * (1 - u * u)
    g["A"], g["a"] = np.einsum("tnh,tna->ha", states, d_u), d_u.sum(axis=(0, 1))
    d_states += d_u @ p["A"].T
    d_x = np.zeros_like(x)
    for k, side in enumerate("fb"):
        own = d_states[:, :, k * H : (k + 1) * H]
        back = np.zeros((n, H), dtype=np.float32)
        d_gates = np.zeros_like(gates[side])
        for t, z, r, new, un, before in reversed(kept[side]):
            back = back + own[t]
            d_new = back * (1 - z) * (1 - new * new)
            d_z = back * (before - new) * z * (1 - z)
            d_r = d_new * un * r * (1 - r)
            into = np.concatenate([d_z, d_r, d_new], axis=1)
            through = np.concatenate([d_z, d_r, d_new * r], axis=1)
            np.add.at(d_gates, windows[:, t], into)
            g[f"U{side}"] += before.T @ through
            back = back * z + through @ p[f"U{side}"].T
        d_gates[0] = 0
        g[f"W{side}"] += x.T @ d_gates
        g[f"c{side}"] += d_gates.sum(axis=0)
        d_x += d_gates @ p[f"W{side}"].T
    np.add.at(g["word"], words.rows, d_x[1:, :WORD_WIDTH])
    sizes = np.diff(words.firsts)
    share = d_x[1:, WORD_WIDTH:] / np.maximum(sizes, 1)[:, None]
    np.add.at(g["char"], words.grams, np.repeat(share, sizes, axis=0))
    return g


class _Adam:
    def __init__(self, p: dict):
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}
        self.t = 0

    def step(self, p: dict, g: dict, rate: float) -> None:
        self.t += 1
        for k in p:
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.s[k] += 0.001 * (g[k] * g[k] - self.s[k])
            m, s = self.m[k] / (1 - 0.9**self.t), self.s[k] / (1 - 0.999**self.t)
            p[k] -= (rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)


# --- training -----------------------------------------------------------------------------


def _word_odds(windows: np.ndarray, owner: np.ndarray, toxic: np.ndarray, n_words: int) -> np.ndarray:
    """Log odds of each word by the labels of the texts that it is in."""
    pairs = np.unique(np.repeat(owner, WINDOW) * np.int64(n_words + 1) + windows.ravel())
    doc, word = np.divmod(pairs, n_words + 1)
    odds = np.zeros((2, n_words + 1))
    for label in (0, 1):
        inside = np.bincount(word[toxic[doc] == label], minlength=n_words + 1)
        share = (inside + 1.0) / ((toxic == label).sum() + 2.0)
        odds[label] = np.log(share / (1 - np.minimum(share, 0.999)))
    out = odds[1] - odds[0]
    out[0] = 0
    return out


def _picked(score: np.ndarray, owner: np.ndarray, toxic: np.ndarray, random) -> np.ndarray:
    """The worst-looking window of every text, and a random one of each clean text."""
    order = np.lexsort((score, owner))
    worst = order[np.append(owner[order][1:] != owner[order][:-1], True)]
    sizes = np.bincount(owner, minlength=len(toxic))
    starts = np.cumsum(sizes) - sizes
    clean = np.flatnonzero(toxic == 0)
    any_ = starts[clean] + (random.random(len(clean)) * sizes[clean]).astype(np.int64)
    return np.concatenate([worst, any_])


def _platt(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift that put logits on a probability scale."""
    slope, shift = 1.0, 0.0
    for _ in range(60):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(slope * logit + shift, -30, 30)))
        e, h = weight * (q - label), weight * q * (1 - q) + 1e-9
        grad = np.array([(e * logit).sum() + 0.01 * (slope - 1), e.sum() + 0.01 * shift])
        hess = np.array([[(h * logit * logit).sum() + 0.01, (h * logit).sum()], [(h * logit).sum(), h.sum() + 0.01]])
        move = np.linalg.solve(hess, grad)
        slope, shift = slope - np.clip(move[0], -1, 1), shift - np.clip(move[1], -2, 2)
    return float(max(slope, 1e-3)), float(shift)


def fit(texts: list[bytes], labels: list[int], share: float, seed: int = 5) -> Model:
    """``share`` is that of label 1 among all labelled rows, whatever the sample has."""
    random = np.random.default_rng(seed)
    toxic = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        shift = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return Model({}, 0.0, float(shift))
    words, windows, counts = windows_of(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    held = np.arange(len(texts)) % HELD_BACK == 0
    if len(set(toxic[held])) < 2 or len(set(toxic[~held])) < 2:
        held[:] = False
    inside = ~held[owner]
    odds = _word_odds(windows[inside], owner[inside], toxic, len(words))
    top = np.sort(odds[windows], axis=1)[:, -3:].sum(axis=1)
    p, adam = initial(random), None
    all_hashed = hashed_words(words)
    adam = _Adam(p)
    for turn in range(ROUNDS):
        score = top if turn == 0 else logits_of(p, words, windows)
        chosen = _picked(score, owner, toxic, random)
        chosen = chosen[~held[owner[chosen]]]
        size = min(BATCH, max(LEAST_BATCH, len(chosen) // 16))
        epochs = max(EPOCHS, -(-LEAST_STEPS * size // max(1, len(chosen))))
        for epoch in range(epochs):
            rate = RATE * (1 - (turn + epoch / epochs) / (ROUNDS + 0.1))
            chosen = random.permutation(chosen)
            for i in range(0, len(chosen), size):
                batch = windows[chosen[i : i + size]]
                used, at = np.unique(batch, return_inverse=True)
                if used[0] != 0:
                    used, at = np.append(0, used), at + 1
                some = _subset(all_hashed, used[1:] - 1)
                label = toxic[owner[chosen[i : i + size]]]
                adam.step(p, gradients(p, some, at.reshape(batch.shape), label), rate)
    logit = np.full(len(texts), -np.inf)
    np.maximum.at(logit, owner, logits_of(p, words, windows))
    use = held if held.any() else np.ones(len(texts), dtype=bool)
    fraction = toxic[use].mean()
    weight = np.where(toxic[use] == 1, share / fraction, (1 - share) / (1 - fraction))
    return Model(p, *_platt(logit[use], toxic[use], weight))


def _subset(words: Words, chosen: np.ndarray) -> Words:
    sizes = np.diff(words.firsts)[chosen]
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(words.firsts[chosen] - firsts[:-1], sizes) + np.arange(firsts[-1])
    return Words(words.rows[chosen], words.grams[at], firsts)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """``docs`` has doc_id, text; ``labels`` has doc_id, toxic and only rows to learn from."""
    known = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return fit([], [], 0.0)
    chance = F.when(F.col("toxic") == 1, min(1.0, sample / 2 / sizes.get(1, 1))).otherwise(
        min(1.0, sample / 2 / sizes.get(0, 1))
    )
    uniform = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 30)) / float(1 << 30)
    # The sample's ids are about ``sample`` at most, whatever the size of the tables.
    picked = known.where(uniform < chance)
    rows = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")
    found = sorted((r["doc_id"], r["text"] or "", r["toxic"]) for r in rows.toLocalIterator())
    random = np.random.default_rng(3)
    found = [found[i] for i in random.permutation(len(found))]
    share = sizes.get(1, 0) / sum(sizes.values())
    return fit([t.encode() for _, t, _ in found], [label for *_, label in found], share)


# --- scoring ------------------------------------------------------------------------------


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    """A probability for each text, from the worst of its windows."""
    if not model.p:
        logit = np.zeros(len(texts))
    else:
        words, windows, counts = windows_of(texts)
        every = logits_of(model.p, words, windows)
        logit = np.maximum.reduceat(every, np.cumsum(counts) - counts) if len(every) else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(model.slope * logit.astype(np.float64) + model.shift, -40, 40)))


def _score(model: Model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = score_texts(model, utf8(batch.column(batch.num_columns - 1)))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                [*batch.schema.names[:-1], "score", "predicted"],
            )

    return task


def score(model: Model, docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of ``docs`` with score and predicted, from ``text``."""
    rows = docs.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_score(model), f"{fields}, score double, predicted int")
