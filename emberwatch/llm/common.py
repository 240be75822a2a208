"""What several corpus operators share: folds, text buffers and byte-bounded slices."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text bytes that one task holds in working arrays at a time; a longer text is held alone.
SLICE_BYTES = 4_000_000
# 64-bit words of the filter of wanted keys, at most; a power of two.
FILTER_BITS = 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def session_settings(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """The settings for what runs inside; those of before come back."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % 5


def maybe_wanted(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """All rows whose ``key`` is in ``wanted``, and some others.

    The keys set bits in 2^FILTER_BITS words of 64, a table of bounded size at any input,
    so that rows without a partner seldom reach the exchange of the join that follows.
    """
    hashed = F.xxhash64(key)
    word = F.shiftrightunsigned(hashed, 64 - FILTER_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), hashed.bitwiseAND(F.lit(63)).cast("int"))
    words = wanted.select(word.alias("__word"), bit.alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    found = rows.withColumn("__word", word).join(F.broadcast(words), "__word")
    return found.where(F.col("__bits").bitwiseAND(bit) != 0).drop("__word", "__bits")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most SLICE_BYTES of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
        ends = np.cumsum(sizes, dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            floor = ends[begin - 1] if begin else 0
            end = int(np.searchsorted(ends, floor + SLICE_BYTES, side="right"))
            end = max(begin + 1, end)
            yield batch.slice(begin, end - begin)
            begin = end


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def joined(column: pa.Array, separator: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array with a separator after each; where each begins, and the end."""
    texts = utf8(column)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=starts[1:])
    mark = bytes([separator])
    return np.frombuffer(mark.join(texts) + mark, dtype=np.uint8), starts


_PLAIN = bytes(
    b if b >= 128 or chr(b).isalnum() and chr(b) == chr(b).lower() else b + 32 if chr(b).isalpha() else 32
    for b in range(256)
)


def plain(text: bytes) -> bytes:
    """A-Z in lower case, and a space for every other ASCII byte but letters and digits."""
    return text.translate(_PLAIN)


def plain_words(text: bytes) -> list[bytes]:
    """Runs of letters and digits and of everything beyond ASCII, A-Z in lower case."""
    return plain(text).split()


def mix64(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = values ^ (values >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
