"""Benchmark decontamination with an FM-index per shard of the corpus.

A shard is a slice of documents.  Its words become symbols: a word that some benchmark
item contains has its own, and each run of other words is one symbol 0, as no window
can contain it.  Over the symbols of a shard an FM-index is built: a suffix array by
prefix doubling, the Burrows-Wheeler transform in a wavelet tree with rank counts, and
suffix positions sampled by place in the text.  All windows of the benchmark are
searched backward together; the occurrences of those that are found are located by
walking to the nearest sampled position, and their spans are merged per document.

Items are searched in blocks of about ``BLOCK_BYTES`` of text, each sent to all tasks;
blocks are one after the other in the same task, so nothing is shuffled or joined, and
memory is bounded by a shard and a block whatever the size of the benchmark.

Cases: null text has no words; an item without words has no window; an item with fewer
words than a window is one window; equal items and equal windows are found under each
item id; an item with a null id has windows without a name, which hit words but count as
no item; equal rows each get their result; without items nothing is contaminated; an empty table gives an
empty result; other columns are not read (``decontaminate`` keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.llm.common import plain, plain_words, slices, utf8
from emberwatch.storage import stage

WINDOW = 10
BLOCK_BYTES = 4_000_000
SAMPLED_EVERY = 16

# --- the index ----------------------------------------------------------------------------


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling; only suffixes that are not yet told apart are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    heads = np.concatenate([[True], symbols[order][1:] != symbols[order][:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.flatnonzero(heads)[np.cumsum(heads) - 1]
    step = 1
    while True:
        # Places in ``order`` whose suffix shares its rank with a neighbour.
        ends = np.concatenate([heads[1:], [True]])
        open_ = np.flatnonzero(~(heads & ends))
        if not len(open_):
            return order
        suffixes = order[open_]
        after = suffixes + step
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.lexsort((follow, rank[suffixes]))
        suffixes, follow = suffixes[by], follow[by]
        order[open_] = suffixes
        same = rank[suffixes]
        split = np.concatenate([[True], (same[1:] != same[:-1]) | (follow[1:] != follow[:-1])])
        heads[open_] |= split
        firsts = open_[split][np.cumsum(split) - 1]
        rank[suffixes] = firsts
        step *= 2


class WaveletTree:
    """Ranks of symbols in a sequence: per bit, from the highest, a stable partition by it."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones_before = bits, [], []
        now = symbols
        for bit in range(bits - 1, -1, -1):
            one = (now >> bit) & 1
            self.ones_before.append(np.concatenate([[0], np.cumsum(one, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(now) - int(one.sum()))
            now = np.concatenate([now[one == 0], now[one == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``end`` places."""
        low, high = np.zeros_like(ends), ends
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones_before[level], self.zeros[level]
            one = ((symbols >> bit) & 1).astype(bool)
            low_ones, high_ones = ones[low], ones[high]
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        low, here = np.zeros_like(places), places
        value = np.zeros_like(places)
        for level in range(self.bits):
            ones, zeros = self.ones_before[level], self.zeros[level]
            one = ones[here + 1] - ones[here]
            low_ones, here_ones = ones[low], ones[here]
            value = value * 2 + one
            low = np.where(one == 1, zeros + low_ones, low - low_ones)
            here = np.where(one == 1, zeros + here_ones, here - here_ones)
        return value, here - low


class FmIndex:
    """Symbols are at least 1; the end mark 0 is added here."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        text = np.concatenate([symbols, [0]]).astype(np.int64)
        order = suffix_array(text)
        self.tree = WaveletTree(text[order - 1], max(1, int(alphabet).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))])
        self.size = len(text)
        sampled = order % SAMPLED_EVERY == 0
        self.sampled, self.sample_rank = sampled, np.cumsum(sampled) - 1
        self.positions = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns of one length, a row each, by backward search."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.size, dtype=np.int64)
        alive = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, column]
            low[alive] = self.before[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.tree.rank(symbol, high[alive])
            alive = alive[high[alive] > low[alive]]
        dead = high <= low
        low[dead] = high[dead] = 0
        return low, high

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back to a sampled one are added to it."""
        found = np.zeros(len(places), dtype=np.int64)
        now, steps, todo = places.copy(), 0, np.arange(len(places))
        while len(todo):
            done = self.sampled[now]
            found[todo[done]] = self.positions[self.sample_rank[now[done]]] + steps
            todo, now = todo[~done], now[~done]
            if len(todo):
                symbol, earlier = self.tree.at(now)
                now = self.before[symbol] + earlier
            steps += 1
        return found


# --- the benchmark ------------------------------------------------------------------------


class Block(NamedTuple):
    """Part of the benchmark: its words as symbols and its different windows by length."""

    symbols: dict[bytes, int]  # from 2; 1 stands for all other words
    windows: dict[int, tuple[np.ndarray, list[tuple[str, ...]]]]


def make_block(items: list[tuple[str | None, bytes]], window: int) -> Block:
    """The windows of an item without an id have no name: they hit words, and count as no item."""
    symbols: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        ids = [symbols.setdefault(w, len(symbols) + 2) for w in plain_words(text)]
        size = min(window, len(ids))
        for i in range(len(ids) - size + 1 if size else 0):
            names = found.setdefault(tuple(ids[i : i + size]), set())
            if item is not None:
                names.add(item)
    by_length: dict[int, list] = {}
    for words, names in found.items():
        by_length.setdefault(len(words), []).append((words, tuple(sorted(names))))
    return Block(
        symbols,
        {n: (np.array([w for w, _ in x]), [names for _, names in x]) for n, x in by_length.items()},
    )


def blocks_of(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Block]:
    """The items in blocks of about equal size; one block at a time is on the driver."""
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text")
    )
    size = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-size // block_bytes))
    for i in range(count):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == i)
        yield make_block([(r["item"], r["text"].encode()) for r in part.toLocalIterator()], window)


# --- shards -------------------------------------------------------------------------------


def search_shard(block: Block, texts: list[bytes]) -> list[tuple[int, list, set]]:
    """Per text: number of words, merged hit spans in words, ids of items that occur."""
    get = block.symbols.get
    parts, places, counts, firsts, total = [], [], [], [0], 0
    for text in texts:
        ids = np.array([get(w, 1) for w in plain_words(text)] + [1], dtype=np.int64)
        counts.append(len(ids) - 1)
        # A run of other words is one symbol; the one after the text parts it from the next.
        keep = np.concatenate([[True], (ids[1:] != 1) | (ids[:-1] != 1)])
        keep[-1] = True
        at = np.flatnonzero(keep)
        parts.append(ids[at])
        places.append(at)
        total += len(at)
        firsts.append(total)
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    if block.windows and total:
        index = FmIndex(np.concatenate(parts), len(block.symbols) + 1)
        place, first = np.concatenate(places), np.array(firsts)
        for length, (patterns, names) in block.windows.items():
            low, high = index.search(patterns)
            hits = np.flatnonzero(high > low)
            sizes = (high - low)[hits]
            which = np.repeat(hits, sizes)
            within = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = index.locate(low[which] + within)
            docs = np.searchsorted(first, at, side="right") - 1
            for pattern, position, doc in zip(which, at, docs, strict=True):
                begin = int(place[position])
                spans[doc].append((begin, begin + length))
                items[doc].update(names[pattern])
    return [(n, merge_spans(s), i) for n, s, i in zip(counts, spans, items, strict=True)]


def merge_spans(spans: list) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for begin, end in sorted(spans):
        if merged and begin <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([begin, end])
    return [(a, b) for a, b in merged]


_FOUND = pa.schema(
    [
        ("n_words", pa.int64()),
        ("begins", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int64())),
        ("items", pa.list_(pa.string())),
    ]
)
_FOUND_SQL = "__n_words long, __begins array<long>, __ends array<long>, __items array<string>"


def _search(block: Block, with_earlier: bool):
    """Adds what this block finds to what earlier blocks have found."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            own = batch.num_columns - (4 if with_earlier else 0)
            text = batch.column(batch.schema.get_field_index("__text"))
            found = search_shard(block, utf8(text))
            if with_earlier:
                before = [batch.column(own + i).to_pylist() for i in range(1, 4)]
                found = [
                    (n, merge_spans([*s, *zip(a, b, strict=True)]), i | set(c))
                    for (n, s, i), a, b, c in zip(found, *before, strict=True)
                ]
            columns = [
                [n for n, _, _ in found],
                [[a for a, _ in s] for _, s, _ in found],
                [[b for _, b in s] for _, s, _ in found],
                [sorted(i) for _, _, i in found],
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(own)),
                 *(pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True))],
                [*batch.schema.names[:own], *(f"__{f.name}" for f in _FOUND)],
            )

    return task


def find(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs``, which has ``__text``, with __n_words, __begins, __ends (spans in words) and __items."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    found, earlier = docs, False
    for block in blocks_of(benchmark, window, block_bytes):
        found = found.mapInArrow(_search(block, earlier), f"{fields}, {_FOUND_SQL}")
        earlier = True
    return found


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        begins, ends, items = (batch.column(i).to_pylist() for i in (2, 3, 4))
        hits = [sum(b) - sum(a) for a, b in zip(begins, ends, strict=True)]
        digests = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(hits, pa.int64()),
                pa.array([len(i) for i in items], pa.int64()), pa.array(digests),
                pa.array([h > 0 for h in hits]),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text"))
    found = find(rows, benchmark, window, **options).drop("__text")
    return found.mapInArrow(
        _digest,
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean",
    )


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans of words; a line end takes the place of each."""
    folded, place, ends, begins = plain(text), 0, [], []
    for word in folded.split():
        at = folded.index(word, place)
        place = at + len(word)
        begins.append(at)
        ends.append(place)
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : begins[a]])
        done = ends[b - 1]
    out.append(text[done:])
    return b"\n".join(out)


def _texts_cut(texts: list[bytes], null: list[bool]) -> pa.Array:
    return pa.array([None if n else t.decode() for n, t in zip(null, texts, strict=True)], pa.string())


def _cut(block: Block, column: int):
    """Cuts what the only block finds; words that a cut brings together are searched again."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = utf8(batch.column(column))
            for i, (_, spans, _) in enumerate(search_shard(block, texts)):
                while spans:
                    texts[i] = cut_words(texts[i], spans)
                    spans = search_shard(block, [texts[i]])[0][1]
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[column] = _texts_cut(texts, columns[column].is_null().to_pylist())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return task


def _cut_found(column: int, own: int):
    """Cuts the merged spans of all blocks once; ``__changed`` tells which rows had any."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            begins, ends = (batch.column(names.index(f"__{x}")).to_pylist() for x in ("begins", "ends"))
            texts = [
                cut_words(t, list(zip(a, b, strict=True))) if a else t
                for t, a, b in zip(utf8(batch.column(column)), begins, ends, strict=True)
            ]
            columns = [batch.column(i) for i in range(own)]
            columns[column] = _texts_cut(texts, columns[column].is_null().to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([bool(a) for a in begins], pa.bool_())], [*names[:own], "__changed"]
            )

    return task


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` with the spans of benchmark windows cut from ``text``; other documents as they were.

    All blocks are searched in the same text and their spans cut together; the documents
    that had any are searched again for all blocks, until nothing is found.  With one
    block a task does so on its own, with several each round is written.
    """
    column, own = docs.columns.index("text"), len(docs.columns)
    blocks = blocks_of(benchmark, window, block_bytes)
    first = next(blocks)
    if next(blocks, None) is None:
        return docs.mapInArrow(_cut(first, column), docs.schema)
    changed = T.StructType([*docs.schema.fields, T.StructField("__changed", T.BooleanType())])
    todo, done = docs, []
    while True:
        found = find(todo.withColumn("__text", F.col("text")), benchmark, window, block_bytes)
        cut = stage(found.mapInArrow(_cut_found(column, own), changed), "benchmark_cut")
        done.append(cut.where("not __changed").select(docs.columns))
        todo = cut.where("__changed").select(docs.columns)
        if todo.isEmpty():
            return reduce(DataFrame.unionAll, done)
