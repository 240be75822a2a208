"""Cost-balanced packing of documents into token sequences.

A document's ids (its tokens and one end id) are cut into whole sequences as long as it
fills them; what remains is a piece.  The cost of a piece is linear in its length plus
quadratic, as attention is within a document.  In blocks of about ``BLOCK_TOKENS`` the
pieces are taken in descending length and each goes to the open sequence of lowest cost
that has room for it; where none has, the piece is cut to fill the roomiest one.  A
block opens only as many sequences as its tokens fill, so all of them end full, and
what is left joins the next block.  Only the last sequence of a task can be padded.

Blocks follow the rows of a task, so nothing is shuffled, and memory is bounded by a
block and one document.  Sequence ids carry the task's number above ``ID_BITS`` bits and
are the same when a task runs again.

Cases: null text is empty and gives the end id alone; equal rows are packed each; a text
of any length is tokenised whole; an empty table gives no piece; other columns are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import slices, utf8

SEQUENCE = 1024
BLOCK_TOKENS = 2_000_000
ID_BITS = 36
# Cost of a token, and of a pair of tokens of one piece, in the unit of the first.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
SPECIAL = "<|endoftext|>"
# Words whose ids a task remembers.
REMEMBERED = 400_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


def tokenizer_file() -> str:
    """The public byte-level vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordTokens:
    """Ids of a text from the ids of its words, which are remembered.

    The pre-tokeniser never joins a space to what stands before it, so a text without
    runs of spaces has the ids of its space-led words in a row.  Other texts, and those
    with a special token, go through the tokeniser whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.fast = self._fast(path)

    @staticmethod
    def _fast(path: str):
        """The same vocabulary as ranks, where it lies beside the file."""
        import base64
        from pathlib import Path

        import public_tokenizers
        import tiktoken

        ranks = Path(path).with_suffix(".tiktoken")
        if not ranks.exists():
            return None
        pairs = (line.split() for line in ranks.read_bytes().splitlines() if line)
        return tiktoken.Encoding(
            "words",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs},
            special_tokens={},
        ).encode_ordinary

    def _one(self, text: str) -> list[int]:
        if self.fast and SPECIAL not in text:
            return self.fast(text)
        return self.whole.encode(text, add_special_tokens=False).ids

    def ids(self, text: bytes) -> np.ndarray:
        if b"  " in text or SPECIAL.encode() in text:
            return np.array(self._one(text.decode()), dtype="<u4")
        first, *rest = text.split(b" ")
        known = self.words
        missing = {w for w in rest if w not in known}
        if missing:
            if len(known) + len(missing) > REMEMBERED:
                known.clear()
                missing = set(rest)
            for word in missing:
                known[word] = np.array(self._one(" " + word.decode()), dtype="<u4").tobytes()
        head = np.array(self._one(first.decode()) if first else [], dtype="<u4").tobytes()
        return np.frombuffer(head + b"".join([known[w] for w in rest]), dtype="<u4")


class Piece:
    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc: int | None, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc, self.start, self.ids[:at], self.total),
            Piece(self.doc, self.start + at, self.ids[at:], self.total),
        )


class OpenSequences:
    """Open sequences by room left; finds the cheapest with room in log(SEQUENCE) steps."""

    def __init__(self, count: int):
        self.leaves = 1 << SEQUENCE.bit_length()
        self.heaps: list[list] = [[] for _ in range(SEQUENCE + 1)]
        self.best: list[tuple | None] = [None] * (2 * self.leaves)
        for number in range(count):
            heappush(self.heaps[SEQUENCE], (0.0, number))
        self._renew(SEQUENCE)

    def _renew(self, room: int) -> None:
        node, heap = self.leaves + room, self.heaps[room]
        self.best[node] = (heap[0], room) if heap else None
        node //= 2
        while node:
            a, b = self.best[2 * node], self.best[2 * node + 1]
            self.best[node] = b if a is None else a if b is None or a <= b else b
            node //= 2

    def cheapest(self, length: int) -> tuple[float, int, int] | None:
        """(cost, number, room) of the sequence to take, which is taken out."""
        low, high, found = self.leaves + length, self.leaves + SEQUENCE + 1, None
        while low < high:
            for node, inside in ((low, low & 1), (high - 1, high & 1)):
                if inside and self.best[node] and (found is None or self.best[node] < found):
                    found = self.best[node]
            low, high = (low + 1) // 2, high // 2
        return self._take(found[1]) if found else None

    def roomiest(self) -> tuple[float, int, int] | None:
        room = next((r for r in range(SEQUENCE, 0, -1) if self.heaps[r]), 0)
        return self._take(room) if room else None

    def _take(self, room: int) -> tuple[float, int, int]:
        cost, number = heappop(self.heaps[room])
        self._renew(room)
        return cost, number, room

    def put(self, cost: float, number: int, room: int) -> None:
        heappush(self.heaps[room], (cost, number))
        self._renew(room)


def cost_of(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


def pack_block(pieces: list[Piece], last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences of a block, and what is left over; with ``last`` nothing is left."""
    total = sum(len(p.ids) for p in pieces)
    count = total // SEQUENCE
    open_, filled, left = OpenSequences(count), [[] for _ in range(count)], []
    for piece in sorted(pieces, key=lambda p: -len(p.ids)):
        rest: Piece | None = piece
        while rest is not None:
            found = open_.cheapest(len(rest.ids)) or open_.roomiest()
            if found is None:
                left.append(rest)
                break
            cost, number, room = found
            part, rest = rest.cut(room) if len(rest.ids) > room else (rest, None)
            filled[number].append(part)
            open_.put(cost + cost_of(len(part.ids)), number, room - len(part.ids))
    if last and left:
        filled.append(left)
        left = []
    return filled, left


def _pack(path: str, with_ids: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = WordTokens(path)
        number = TaskContext.get().partitionId() << ID_BITS
        waiting: list[Piece] = []
        held = 0

        def rows(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            out: list[tuple] = []
            for sequence in sequences:
                offset = 0
                for p in sequence:
                    crc = zlib.crc32(p.ids.tobytes())
                    row = (p.doc, p.start, len(p.ids), crc, p.total, number, offset)
                    out.append((*row, p.ids) if with_ids else row)
                    offset += len(p.ids)
                number += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = [pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:7]]
            if with_ids:
                names.append("ids")
                columns.append(pa.array([list(r[7]) for r in out], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in slices(batches):
            whole: list[list[Piece]] = []
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                ids = np.append(tokens.ids(text), np.zeros(1, dtype="<u4"))
                end = len(ids) - len(ids) % SEQUENCE
                whole += [[Piece(doc, i, ids[i : i + SEQUENCE], len(ids))] for i in range(0, end, SEQUENCE)]
                if end < len(ids):
                    waiting.append(Piece(doc, end, ids[end:], len(ids)))
                    held += len(ids) - end
            if whole:
                yield rows(whole)
            if held >= BLOCK_TOKENS:
                filled, waiting = pack_block(waiting, last=False)
                held = sum(len(p.ids) for p in waiting)
                yield rows(filled)
        filled, _ = pack_block(waiting, last=True)
        if filled:
            yield rows(filled)

    return task


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece; ``with_ids`` adds its token ids.

    ``tokenizer`` is the vocabulary file, by the same path on every machine.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(_pack(tokenizer or tokenizer_file(), with_ids), schema)
