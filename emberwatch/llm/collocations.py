"""Phrase collocations: candidates counted by double-array tries over word numbers.

Level by level, a phrase of n words is counted only if it can reach ``min_count``
(Apriori): its words, then its two phrases of n - 1 words must have.

1. Words are counted per language; those that reach the count are numbered, and texts are
   written once as arrays of these numbers (-1: another word, or the end of a piece).
2. Safe positions of the level are hashed into bins, twice; a bin's count is an upper
   bound of that of each phrase in it.  Distinct phrases whose two bins reach the count
   are the candidates, less those with a part that was counted below it.  Bins grow with
   the texts, as nearly all phrases pass full ones; beyond ``SLICE_TOKENS`` words the
   phrases are cut by hash into slices, which have the bins one after the other.
3. Candidates are cut into blocks of ``BLOCK`` phrases; each block becomes a double-array
   trie (``double_array``), and ``TRIES`` of them are broadcast at a time.  All text
   positions advance in them at once, digit by digit; the cells in which phrases end are
   counted by ``bincount`` in each task, and the counts of all tasks are summed.

Bounds: a broadcast holds one block of words (``WORDS``), ``TRIES`` blocks of candidates, or a
bitmap of at most 2 * 2^``MOST_BITS`` bins; more data make more blocks, each with a pass over
the texts or number arrays.  Tables move in batches of ``BATCH_BYTES``, number arrays in
rows of ``ROW``, and a task holds the bins of ``GATHERED`` phrases.  Fuller bins let more
candidates through and change no result.

The score of a cut after k words is floor(10^6 a a / (l r)) in 38-digit decimals, exact for
counts below 10^13.  A phrase inside a longer candidate with at least ``absorb`` per cent
of its count is dropped.  Each language's first ``top`` phrases are returned.

Cases: a null text is empty, a null language is ``und``; empty texts and pieces have no
words; texts of any length are read in parts; equal texts count as often as they occur;
ids are not read, other columns neither; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import mix64, session_settings, slices, utf8
from emberwatch.llm.double_array import Trie, build
from emberwatch.storage import stage

MIN_COUNT, LONGEST, TOP, ABSORB = 10, 3, 2_000, 50
# Words and candidates of a broadcast block.
WORDS, BLOCK = 2_000_000, 250_000
# Blocks of candidates that are followed in one pass.
TRIES = 2
LEAST_BITS, MOST_BITS = 16, 27
# Words of all texts whose phrases share the bins.
SLICE_TOKENS = 1 << 30
# Bins of a row, in the tables of counted bins, and rows that a task adds up.
ROW_BINS, BIN_ROWS = 1 << 16, 32
# Distinct words or candidates that a task holds before it hands them on.
HELD = 500_000
# Words of texts whose numbers a task keeps at hand.
KNOWN = 200_000
# Positions whose phrases are counted or made distinct at a time.
GATHERED = 1 << 20
# Rows of words in a batch.
BATCH_ROWS = 50_000
# Numbers of an array.
ROW = 1 << 15
# Texts beyond this many bytes are read in parts.
PART_BYTES = 4_000_000
# Bytes of a batch between Spark and Python.  By default it has 10,000 rows of any size.
BATCH_BYTES = 4_000_000
# Rows that a scan holds at a time; those of number arrays and bins are large.
SCAN_ROWS = 128

_ENDS = re.compile(rb"[.,;:!?\n\x0b\x0c\r]+")
_GAP = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")


# --- texts --------------------------------------------------------------------------------


def parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of about PART_BYTES, cut between words."""
    begin = 0
    while len(text) - begin > PART_BYTES:
        gap = _GAP.search(text, begin + PART_BYTES)
        if gap is None:
            break
        yield text[begin : gap.start()]
        begin = gap.start()
    yield text[begin:]


def tokens(text: bytes) -> list[bytes]:
    """Words, A-Z in lower case, and a full stop for each end of a piece."""
    return _ENDS.sub(b" . ", text.lower()).split()


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
    """The texts of a slice by language: of short ones one text, long ones in parts."""
    for batch in slices(batches):
        texts = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            texts[lang].append(text)
        for lang, own in texts.items():
            yield lang, parts(b"\n".join(own))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: defaultdict[str, Counter] = defaultdict(Counter)

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, counted in held.items():
            counted.pop(b".", None)
            words = list(counted)
            for begin in range(0, len(words), BATCH_ROWS):
                own = words[begin : begin + BATCH_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(own), pa.string()), pa.array(own, pa.binary()),
                        pa.array([counted[w] for w in own], pa.int64()),
                    ],
                    ["lang", "word", "n"],
                )
        held.clear()

    for lang, texts in _by_language(batches):
        for text in texts:
            held[lang].update(tokens(text))
            if sum(map(len, held.values())) > HELD:
                yield from rows()
    yield from rows()


class Words:
    """The numbers of a block's words as flat arrays; each process finds them by its own hashes."""

    def __init__(self, batches: Iterable[pa.RecordBatch]):
        """``lang``, ``word`` and ``number`` of each word."""
        read: defaultdict[str, list[tuple[bytes, int]]] = defaultdict(list)
        parts_: defaultdict[str, list[tuple[bytes, np.ndarray, np.ndarray]]] = defaultdict(list)
        for batch in batches:
            columns = batch["lang"].to_pylist(), utf8(batch["word"]), batch["number"].to_pylist()
            for lang, word, number in zip(*columns, strict=True):
                read[lang].append((word, number))
            for lang, own in read.items():
                words, numbers = zip(*own, strict=True)
                sizes = np.array([len(w) for w in words], dtype=np.int32)
                parts_[lang].append((b"".join(words), sizes, np.array(numbers, dtype=np.int32)))
            read.clear()
        self.words = {
            lang: (b"".join(x[0] for x in own), *(np.concatenate([x[i] for x in own]) for i in (1, 2)))
            for lang, own in parts_.items()
        }
        self.found: dict[str, tuple[np.ndarray, ...]] = {}

    def _by_hash(self, lang: str) -> tuple[np.ndarray, ...]:
        """Hashes in order; where their words begin and end; their numbers."""
        if lang not in self.found:
            text, sizes, numbers = self.words[lang]
            ends = np.cumsum(sizes, dtype=np.int64)
            begins = ends - sizes
            cuts = (text[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True))
            hashes = np.fromiter(map(hash, cuts), dtype=np.int64, count=len(sizes))
            order = np.argsort(hashes, kind="stable")
            self.found[lang] = hashes[order], begins[order], ends[order], numbers[order]
        return self.found[lang]

    def find(self, lang: str, words: list[bytes]) -> list[int]:
        """The number of each word, -1 for those that are not in the block."""
        found = [-1] * len(words)
        if lang not in self.words or not words:
            return found
        text = self.words[lang][0]
        hashes, begins, ends, numbers = self._by_hash(lang)
        hashed = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
        at = np.searchsorted(hashes, hashed)
        open_ = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == hashed)
        # Words of one hash stand side by side.
        while len(open_):
            cells = at[open_]
            columns = (x[cells].tolist() for x in (begins, ends, numbers))
            for i, begin, end, number in zip(open_.tolist(), *columns, strict=True):
                if text[begin:end] == words[i]:
                    found[i] = number
            at[open_] += 1
            more = at[open_] < len(hashes)
            open_ = open_[more]
            open_ = open_[hashes[at[open_]] == hashed[open_]]
        return found


def _numbered(vocabulary: Broadcast, ahead: int):
    """Texts as number arrays: ``own`` positions, and the ``ahead`` numbers after them.

    ``task`` and ``place`` name an array; they are the same for each block of the vocabulary.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, place, here = vocabulary.value, 0, TaskContext.get().partitionId()
        known: defaultdict[str, dict[bytes, int]] = defaultdict(dict)

        def rows(read: np.ndarray, own: int) -> Iterator[pa.RecordBatch]:
            nonlocal place
            for begin in range(0, own, ROW):
                end = min(begin + ROW, own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([read[begin : end + ahead].tobytes()], pa.binary()), pa.array([end - begin], pa.int32()),
                        pa.array([here], pa.int32()), pa.array([place], pa.int32()),
                    ],
                    ["numbers", "own", "task", "place"],
                )
                place += 1

        for lang, texts in _by_language(batches):
            rest = np.zeros(0, dtype=np.int32)
            for text in texts:
                read = tokens(text)
                distinct_words = set(read)
                if sum(map(len, known.values())) + len(distinct_words) > KNOWN:
                    known.clear()
                numbers = known[lang]
                new = list(distinct_words.difference(numbers))
                numbers.update(zip(new, words.find(lang, new), strict=True))
                read = np.fromiter(map(numbers.__getitem__, read), dtype=np.int32, count=len(read))
                read = np.concatenate([rest, read])
                # The last numbers wait for those that follow in the next part.
                own = max(0, len(read) - ahead)
                yield from rows(read, own)
                rest = read[own:]
            if len(rest):
                yield from rows(np.concatenate([rest, np.full(ahead, -1, dtype=np.int32)]), len(rest))

    return task


_NUMBERS = "numbers binary, own int, task int, place int"


def _combined(table: pa.Table) -> pa.Table:
    """The arrays of all blocks of the vocabulary as one; a word is in one block."""
    arrays = [np.frombuffer(x.as_buffer(), np.int32) for x in table.column("numbers")]
    whole = pa.array([np.maximum.reduce(arrays).tobytes()], pa.binary())
    return table.slice(0, 1).set_column(0, "numbers", whole)


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    for batch in batches:
        for numbers, own in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            yield np.frombuffer(numbers.as_buffer(), dtype=np.int32), own


# --- bins ---------------------------------------------------------------------------------


def windows(numbers: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` numbers from each start."""
    value = np.full(len(starts), length, dtype=np.uint64)
    for i in range(length):
        value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + numbers[starts + i].astype(np.uint64) + np.uint64(1))
    return value


def _bins(hashed: np.ndarray, bits: int) -> np.ndarray:
    """Two bins for each hash, the second among the latter half of all bins."""
    second = hashed & np.uint64((1 << bits) - 1) | np.uint64(1 << bits)
    return np.stack([hashed >> np.uint64(64 - bits), second]).astype(np.int64)


def _set(bitmap: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Whether both bins are marked."""
    good = np.ones(bins.shape[1], dtype=bool)
    for half in bins:
        good[good] = bitmap[half[good] >> 3] >> (half[good] & 7).astype(np.uint8) & 1
    return good


def safe_starts(numbers: np.ndarray, own: int, length: int, bits: int, shorter: np.ndarray | None) -> np.ndarray:
    """Positions of phrases whose words, and whose two shorter phrases, may reach the count."""
    known = numbers >= 0
    able = known[:own].copy()
    for i in range(1, length):
        able &= known[i : own + i]
    starts = np.flatnonzero(able)
    if shorter is not None:
        for shift in (0, 1):
            bins = _bins(windows(numbers, starts + shift, length - 1), bits)
            starts = starts[_set(shorter, bins)]
    return starts


def _of_slice(hashed: np.ndarray, slice_: int, of: int) -> np.ndarray:
    """Which hashes are in a slice, by digits that the bins do not read."""
    return (hashed >> np.uint64(MOST_BITS + 1)) % np.uint64(of) == np.uint64(slice_)


def _bin_rows(hashed: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """The bins of distinct hashes in order, ROW_BINS of them to a row: block, places, counts."""
    least = np.uint64(255)
    for half in _bins(hashed, bits):
        # A bin and a count in one number, as bins of the second half are in no order.
        packed = half.astype(np.uint64) << np.uint64(8) | counts
        packed.sort()
        bins, added = (packed >> np.uint64(8)).astype(np.int64), (packed & least).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]][: len(bins)])
        if not len(first):
            continue
        added = np.minimum(np.add.reduceat(added, first), 255).astype(np.uint8)
        bins = bins[first]
        for begin in range(0, len(bins), GATHERED):
            blocks = bins[begin : begin + GATHERED] // ROW_BINS
            edges = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1], True]).astype(np.int32)
            places = (bins[begin : begin + GATHERED] % ROW_BINS).astype(np.uint16)
            columns = [
                pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
                for ends, data in ((edges * np.int32(2), places), (edges, added[begin : begin + GATHERED]))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks[edges[:-1]].astype(np.int32)), *columns], ["block", "places", "counts"]
            )


def _count_bins(length: int, bits: int, shorter: Broadcast | None, most: int, slice_: int, of: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []

        def rows() -> Iterator[pa.RecordBatch]:
            if gathered:
                phrases, counts = np.unique(np.concatenate(gathered), return_counts=True)
                gathered.clear()
                yield from _bin_rows(phrases, np.minimum(counts, most).astype(np.uint64), bits)

        for numbers, own in _arrays(batches):
            starts = safe_starts(numbers, own, length, bits, shorter and shorter.value)
            hashed = windows(numbers, starts, length)
            gathered.append(hashed[_of_slice(hashed, slice_, of)] if of > 1 else hashed)
            if sum(map(len, gathered)) > GATHERED:
                yield from rows()
        yield from rows()

    return task


def _sum_bins(most: int):
    """Adds up rows of bins as they come; a task holds the blocks dealt to it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, places, added in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                counts = held.setdefault(block, np.zeros(ROW_BINS, dtype=np.uint8))
                # A row has a bin once.
                places, added = np.frombuffer(places, np.uint16), np.frombuffer(added, np.uint8).astype(np.uint16)
                counts[places] = np.minimum(counts[places] + added, most)
        for block, counts in held.items():
            full = np.packbits(counts >= most, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([full], pa.binary())], ["block", "full"]
            )

    return task


def _bitmap(rows: DataFrame, bits: int, most: int) -> np.ndarray:
    """One bit for each bin whose count reaches ``most``; at most 2^(MOST_BITS + 1) of them."""
    # So many tasks that each holds few blocks, also where there are few rows.
    dealt = rows.repartition(-(-(2 << bits) // (ROW_BINS * BIN_ROWS)), "block")
    full = dealt.mapInArrow(_sum_bins(most), "block int, full binary")
    bitmap = np.zeros((2 << bits) // 8, dtype=np.uint8)
    for row in full.collect():
        begin = row.block * ROW_BINS // 8
        bitmap[begin : begin + ROW_BINS // 8] = np.frombuffer(row.full, np.uint8)
    return bitmap


# --- candidates ---------------------------------------------------------------------------


def _names(length: int) -> list[str]:
    return [f"w{i}" for i in range(length)]


def _schema(length: int, more: str = "") -> str:
    return ", ".join(f"{w} int" for w in _names(length)) + more


def distinct(found: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in the order of their hashes."""
    order = np.argsort(hashed, kind="stable")
    differ = (found[order[1:]] != found[order[:-1]]).any(axis=1)
    if (differ & (hashed[order[1:]] == hashed[order[:-1]])).any():  # one hash, two phrases
        order = np.lexsort((*found.T, hashed))
        differ = (found[order[1:]] != found[order[:-1]]).any(axis=1)
    kept = order[np.r_[True, differ][: len(order)]]
    return found[kept], hashed[kept]


def _marked_bins(length: int, bits: int, most: int):
    """The bins of given phrases, as full ones."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.stack([c.to_numpy() for c in batch.columns], axis=1).ravel()
            phrases = np.unique(windows(flat, np.arange(0, len(flat), length), length))
            yield from _bin_rows(phrases, np.full(len(phrases), most, dtype=np.uint64), bits)

    return task


def _candidates(
    length: int, bits: int, shorter: Broadcast | None, full: Broadcast, parts_: int, slice_: int, of: int
):
    """Distinct phrases of a task, packed by part; a part is a range of hashes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, hashed = np.zeros((0, length), np.int32), np.zeros(0, np.uint64)
        gathered: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> None:
            nonlocal found, hashed
            found, hashed = distinct(
                np.concatenate([found, *(x for x, _ in gathered)]), np.concatenate([hashed, *(x for _, x in gathered)])
            )
            gathered.clear()

        def rows() -> Iterator[pa.RecordBatch]:
            least = np.array([(i << 64) // parts_ for i in range(parts_)], dtype=np.uint64)
            edges = [*np.searchsorted(hashed, least), len(hashed)]
            for part, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if b > a:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int32()), pa.array([found[a:b].tobytes()], pa.binary())],
                        ["part", "phrases"],
                    )

        for numbers, own in _arrays(batches):
            starts = safe_starts(numbers, own, length, bits, shorter and shorter.value)
            keys = windows(numbers, starts, length)
            good = _set(full.value, _bins(keys, bits))
            if of > 1:
                good &= _of_slice(keys, slice_, of)
            starts, keys = starts[good], keys[good]
            gathered.append(distinct(np.stack([numbers[starts + i] for i in range(length)], axis=1), keys))
            if sum(len(x) for _, x in gathered) > GATHERED:
                merge()
                if len(found) > HELD:
                    yield from rows()
                    found, hashed = found[:0], hashed[:0]
        merge()
        yield from rows()

    return task


def _merged(length: int):
    """Distinct phrases of each part, as rows; a task holds the parts dealt to it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                flat = np.frombuffer(packed.as_buffer(), np.int32)
                more, keys = flat.reshape(-1, length), windows(flat, np.arange(0, len(flat), length), length)
                if part in held:
                    before, hashes = held[part]
                    more, keys = np.concatenate([before, more]), np.concatenate([hashes, keys])
                held[part] = distinct(more, keys)
        for found, _ in held.values():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(found[:, i])) for i in range(length)], _names(length)
            )

    return task


# --- tries --------------------------------------------------------------------------------


def _build(length: int):
    def task(table: pa.Table) -> pa.Table:
        phrases = np.stack([table.column(w).to_numpy() for w in _names(length)], axis=1)
        trie = build(phrases)
        columns = [x.tobytes() for x in (trie.base, trie.check, trie.accept.astype(np.int32), phrases.astype(np.int32))]
        return pa.table(
            {
                "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
                "digits": pa.array([trie.digits], pa.int32()),
                **{n: pa.array([c], pa.binary()) for n, c in zip(_TRIE[2:], columns, strict=True)},
            }
        )

    return task


_TRIE = ["block", "digits", "base", "check", "accept", "phrases"]
_TRIE_SCHEMA = "block int, digits int, base binary, check binary, accept binary, phrases binary"


def _follow(length: int, packed: Broadcast):
    """Counts in one pass the phrases of several tries."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = []
        for digits, base, check, accept, _ in packed.value:
            trie = Trie(*(np.frombuffer(x, np.int32) for x in (base, check, accept)), digits)
            tries.append((trie, np.zeros(len(trie.base), dtype=np.int64), []))

        def flush(counts: np.ndarray, ended: list[np.ndarray]) -> None:
            if ended:
                counts += np.bincount(np.concatenate(ended), minlength=len(counts))
                ended.clear()

        for numbers, own in _arrays(batches):
            starts = safe_starts(numbers, own, length, 0, None)
            for trie, counts, ended in tries:
                ended.append(trie.ends(numbers, length, starts))
                if sum(map(len, ended)) > HELD:
                    flush(counts, ended)
        for (trie, counts, ended), (*_, phrases) in zip(tries, packed.value, strict=True):
            flush(counts, ended)
            found = counts[trie.accept]
            seen = np.flatnonzero(found)
            words = np.frombuffer(phrases, np.int32).reshape(-1, length)[seen]
            if len(seen):
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.ascontiguousarray(words[:, i])) for i in range(length)), pa.array(found[seen])],
                    [*_names(length), "n"],
                )

    return task


# --- the search ---------------------------------------------------------------------------


class _Search:
    """The tables of one search: words, number arrays, and counted phrases of each length."""

    def __init__(self, docs: DataFrame, text: str, lang: Column, min_count: int, longest: int, words: int, block: int):
        self.spark: SparkSession = docs.sparkSession
        self.min_count, self.longest, self.block = min_count, longest, block
        texts = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        counted = texts.mapInArrow(_count_words, "lang string, word binary, n long")
        everything = stage(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
        self.totals = everything.groupBy("lang").agg(F.sum("n").alias("n"))
        self.vocabulary = self._number_words(everything.where(F.col("n") >= min_count), words)
        self.numbers = self._number_texts(texts)
        tokens_ = everything.agg(F.sum("n")).first()[0] or 0
        self.parts = max(64, tokens_ >> 20)
        self.bits = min(MOST_BITS, max(LEAST_BITS, int(tokens_ // 2).bit_length()))
        self.slices = max(1, -(-tokens_ // SLICE_TOKENS))

    def _number_words(self, frequent: DataFrame, words: int) -> DataFrame:
        """lang, word, n, block, number; blocks of about ``words`` by hash."""
        self.blocks = max(1, -(-frequent.count() // words))
        block = F.pmod(F.xxhash64("lang", "word"), F.lit(self.blocks)).cast("int")
        in_block = Window.partitionBy("block").orderBy("lang", "word")
        numbered = frequent.withColumn("block", block).withColumn("place", F.row_number().over(in_block) - 1)
        return stage(
            numbered.withColumn("number", (F.col("place") * self.blocks + F.col("block")).cast("int")).drop("place"),
            "vocabulary",
        )

    def _words(self, block: int) -> Words:
        rows = self.vocabulary.where(F.col("block") == block).select("lang", "word", "number").toArrow()
        return Words(rows.to_batches(max_chunksize=BATCH_ROWS))

    def _number_texts(self, texts: DataFrame) -> DataFrame:
        if self.blocks > 1:
            texts = stage(texts, "texts")  # the same tasks for each block
        made = []
        for block in range(self.blocks):
            shared = self.spark.sparkContext.broadcast(self._words(block))
            made.append(stage(texts.mapInArrow(_numbered(shared, self.longest - 1), _NUMBERS), "numbers"))
            shared.destroy()
        if self.blocks > 1:
            whole = reduce(DataFrame.unionByName, made)
            made = [stage(whole.groupBy("task", "place").applyInArrow(_combined, _NUMBERS), "numbers")]
        return made[0].select("numbers", "own")

    def _shared_bitmap(self, rows: DataFrame) -> Broadcast:
        return self.spark.sparkContext.broadcast(_bitmap(rows, self.bits, self.min_count))

    def _candidates(self, length: int, before: Broadcast | None, shorter: DataFrame, slice_: int) -> DataFrame:
        """Phrases of a slice of the hashes that may reach the count."""
        names, bits = _names(length), self.bits
        counted = _count_bins(length, bits, before, self.min_count, slice_, self.slices)
        full = self._shared_bitmap(self.numbers.mapInArrow(counted, _BIN_SCHEMA))
        packed = self.numbers.mapInArrow(
            _candidates(length, bits, before, full, self.parts, slice_, self.slices), "part int, phrases binary"
        )
        found = packed.repartition("part").mapInArrow(_merged(length), _schema(length))
        if length > 2:
            for shift in (0, 1):
                part = [F.col(f"w{i}").alias(f"w{i + shift}") for i in range(length - 1)]
                found = found.join(shorter.select(*part), names[shift : shift + length - 1], "left_semi")
        found = stage(found, "candidates")
        full.destroy()
        return found

    def phrases(self, length: int, shorter: DataFrame) -> DataFrame:
        """w0, ..., n: the phrases of ``length`` words that reach the count, from those one shorter."""
        names = _names(length)
        before = None
        if length > 2:
            marked = shorter.select(*names[:-1]).mapInArrow(
                _marked_bins(length - 1, self.bits, self.min_count), _BIN_SCHEMA
            )
            before = self._shared_bitmap(marked)
        found = reduce(
            DataFrame.unionByName, [self._candidates(length, before, shorter, i) for i in range(self.slices)]
        )
        if before is not None:
            before.destroy()

        blocks = max(1, -(-found.count() // self.block))
        # Phrases of one first word are in one trie, so that a position advances in one; those of
        # words that begin many, at most 8 words a block, are in all.
        often = found.groupBy("w0").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") > self.block // 8)
        of = F.when(F.col("often").isNull(), F.xxhash64("w0")).otherwise(F.xxhash64(*names))
        dealt = found.join(F.broadcast(often), "w0", "left").select(
            *names, F.pmod(of, F.lit(blocks)).cast("int").alias("block")
        )
        # A trie is one large row; few of them are in a task and in a file.
        built = dealt.repartition(blocks, "block").groupBy("block").applyInArrow(_build(length), _TRIE_SCHEMA)
        tries = stage(built, "tries")
        sums = []
        for block in range(0, blocks, TRIES):
            some = tries.where((F.col("block") >= block) & (F.col("block") < block + TRIES)).select(*_TRIE[1:])
            if some := some.toArrow().to_pylist():
                packed = self.spark.sparkContext.broadcast([tuple(trie[n] for n in _TRIE[1:]) for trie in some])
                followed = self.numbers.mapInArrow(_follow(length, packed), _schema(length, ", n long"))
                summed = followed.groupBy(*names).agg(F.sum("n").alias("n"))
                sums.append(stage(summed.where(F.col("n") >= self.min_count), "phrases"))
                packed.destroy()
        if not sums:
            return self.spark.createDataFrame([], _schema(length, ", n long"))
        return reduce(DataFrame.unionByName, sums)


_BIN_SCHEMA = "block int, places binary, counts binary"


def _cut(found: DataFrame, counted: dict[int, DataFrame], length: int) -> DataFrame:
    """w0, ..., a, l, r, score: that of the lowest-scoring cut, the first of equal ones."""
    names, cuts = _names(length), []
    for k in range(1, length):
        left = counted[k].select(*_names(k), F.col("n").alias(f"l{k}"))
        tail = [F.col(f"w{i}").alias(f"w{i + k}") for i in range(length - k)]
        right = counted[length - k].select(*tail, F.col("n").alias(f"r{k}"))
        found = found.join(left, names[:k]).join(right, names[k:])
        score = F.expr(
            "(CAST(n AS DECIMAL(13, 0)) * CAST(n AS DECIMAL(13, 0)) * CAST(1000000 AS DECIMAL(7, 0)))"
            f" div (CAST(l{k} AS DECIMAL(13, 0)) * CAST(r{k} AS DECIMAL(13, 0)))"
        )
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    lowest = F.array_min(F.array(*cuts))
    return found.withColumn("cut", lowest).select(*names, F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")


def _kept(cut: DataFrame, counted: dict[int, DataFrame], length: int, absorb: int) -> DataFrame:
    """Phrases that no longer one holds with ``absorb`` per cent of their count."""
    names = _names(length)
    for longer in range(length + 1, max(counted) + 1):
        inside = F.explode(
            F.array(
                *(
                    F.struct(*(F.col(f"w{i + at}").alias(w) for i, w in enumerate(names)))
                    for at in range(longer - length + 1)
                )
            )
        )
        most = (
            counted[longer].select(inside.alias("part"), "n").groupBy("part").agg(F.max("n").alias("most"))
            .select("part.*", "most")
        )
        cut = cut.join(most, names, "left").where(F.coalesce(F.col("most") * 100 < F.col("a") * absorb, F.lit(True)))
        cut = cut.drop("most")
    return cut


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: Column | str = "lang",
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    top: int = TOP,
    absorb: int = ABSORB,
    words: int = WORDS,
    block: int = BLOCK,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    if not 1 <= min_count <= 255 or longest < 2:
        raise ValueError("min_count must be 1 to 255, longest 2 at least")
    lang = F.col(lang) if isinstance(lang, str) else lang
    with session_settings(
        docs.sparkSession,
        {
            "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
            "spark.sql.parquet.columnarReaderBatchSize": str(SCAN_ROWS),
        },
    ):
        search = _Search(docs, text, lang.cast("string"), min_count, longest, words, block)
        vocabulary = search.vocabulary
        counted = {1: vocabulary.select(F.col("number").alias("w0"), "n")}
        for length in range(2, longest + 1):
            counted[length] = search.phrases(length, counted[length - 1])

        rows = []
        for length in range(2, longest + 1):
            kept = _kept(_cut(counted[length], counted, length), counted, length, absorb)
            for i in range(length):
                word = [F.col("number").alias(f"w{i}"), F.col("word").cast("string").alias(f"word{i}")]
                kept = kept.join(vocabulary.select(*word, *(["lang"] if i == 0 else [])), f"w{i}")
            phrase = F.concat_ws(" ", *(f"word{i}" for i in range(length))).alias("phrase")
            rows.append(kept.select("lang", phrase, "a", "l", "r", "score"))
        scored = stage(reduce(DataFrame.unionByName, rows), "collocations")
    # A language's first rows are among the first of each of its parts.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    in_part = F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))
    first = scored.withColumn("rank", in_part).where(F.col("rank") <= top)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = first.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return ranked.join(search.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
