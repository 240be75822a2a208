"""CSV records from files that are read in parts, also where quoted cells hold line ends.

Whether a line begins a record depends on all lines before it, but only through one bit:
whether a quoted cell is open.  A line maps that bit to the one after it, and maps
compose.  So files are read as lines in splits of any size:

1. each split reports the map of all its lines (one row per split);
2. the maps of a file, composed in order, give the bit at the start of each split;
3. each split joins its lines to records; of a record that runs over the end of a split,
   the pieces (two per split at most) are put together by a grouping of their own.

A task reads as many neighbouring splits as make up ``TASK_BYTES``, so that small splits cost
no task each.

A quote opens a cell only at the cell's start; a doubled quote is none.  Lines end in a line
feed, with or without a carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.sources.lines import with_lineage
from emberwatch.storage import stage

_BLOCK = ["file_path", "block_start"]
_RECORD = "file_name string, file_path string, block_start long, row_id long, record string, piece int, header boolean"
# Pieces of a record: all of it, its end from an earlier split, its beginning.
WHOLE, END, BEGINNING = 0, 1, 2
# Bytes of small splits that one task reads.
TASK_BYTES = 16 << 20


def _dealt(read: DataFrame) -> DataFrame:
    """The rows of a scan in tasks of TASK_BYTES or of one split, but no fewer than fill the cores."""
    spark = read.sparkSession
    splits = read._jdf.queryExecution().toRdd().getNumPartitions()
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = max(-(-splits * min(most, TASK_BYTES) // TASK_BYTES), 2 * spark.sparkContext.defaultParallelism)
    # The splits keep their order and their row ids.
    return read.coalesce(tasks) if tasks < splits else read


def _leaves_open(text: Column) -> Column:
    """Whether a quoted cell is open after the text, which begins outside of one."""
    return F.regexp_replace(text, r'(^|,)"[^"]*+"', "$1").rlike(r'(^|,)"')


def _maps(line: Column) -> list[Column]:
    """The bit after the line if no quoted cell was open before it, and if one was."""
    single = F.replace(line, F.lit('""'), F.lit(""))
    # What follows the closing quote is not at the start of a cell.
    after = F.concat(F.lit("x"), F.substring(single, F.instr(single, '"') + 1, F.length(single)))
    quoted = line.contains('"')
    return [
        F.when(quoted, _leaves_open(single)).otherwise(False).alias("from_closed"),
        F.when(single.contains('"'), _leaves_open(after)).otherwise(True).alias("from_open"),
    ]


def states(from_closed: np.ndarray, from_open: np.ndarray, start: bool) -> np.ndarray:
    """The bit after each line, from the bit before the first one."""
    constant, swaps = from_closed == from_open, from_closed & ~from_open
    turned = np.cumsum(swaps)
    last = np.maximum.accumulate(np.where(constant, np.arange(len(constant)), -1))
    base = np.where(last >= 0, from_closed[last], start)
    since = turned - np.where(last >= 0, turned[last], 0)
    return base ^ (since % 2 == 1)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The batch in runs of one split."""
    paths = batch.column("file_path").dictionary_encode()
    begins = batch.column("block_start").to_numpy()
    turns = (np.diff(paths.indices.to_numpy()) != 0) | (np.diff(begins) != 0)
    edges = [0, *(np.flatnonzero(turns) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield (paths[a].as_py(), int(begins[a])), batch.slice(a, b - a)


def _bits(part: pa.RecordBatch) -> list[np.ndarray]:
    return [part.column(n).to_numpy(zero_copy_only=False).astype(bool) for n in ("from_closed", "from_open")]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, ends = None, (False, True)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x]) for x in (at[0], at[1], bool(ends[0]), bool(ends[1]))], [*_BLOCK, "from_closed", "from_open"]
        )

    for batch in batches:
        for block, part in _blocks(batch):
            if block != at:
                if at is not None:
                    yield row()
                at, ends = block, (False, True)
            ends = tuple(states(*_bits(part), end)[-1] for end in ends)
    if at is not None:
        yield row()


def _starts(blocks: DataFrame) -> DataFrame:
    """Whether a quoted cell is open where a split begins; there is one row per split."""
    before = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("file_path").orderBy("block_start")
    constant = F.col("from_closed") == F.col("from_open")
    swap = F.col("from_closed") & ~F.col("from_open")
    turned = blocks.withColumn("turned", F.sum(swap.cast("int")).over(up_to))
    last = F.last(F.when(constant, F.struct("from_closed", "turned")), True).over(before)
    known = turned.withColumn("last", last).withColumn("so_far", F.last("turned").over(before))
    since = F.coalesce("so_far", F.lit(0)) - F.coalesce("last.turned", F.lit(0))
    base = F.coalesce("last.from_closed", F.lit(False))
    return known.select(*_BLOCK, (base != (since % 2 == 1)).alias("open"))


class _Joiner:
    """Joins the lines of one split to records."""

    def __init__(self, block: tuple[str, int], open_: bool):
        self.open = open_
        self.held: list[str] = []
        self.row: int | None = None
        self.piece = END if open_ else WHOLE
        self.header = block[1] == 0  # the file's first record
        self.block = block

    def flush(self, name: str, last: bool) -> list[tuple]:
        if not self.held:
            return []
        piece = BEGINNING if last and self.open and self.piece == WHOLE else self.piece
        done = (name, *self.block, self.row, "\n".join(self.held), piece, self.header)
        self.held, self.piece, self.header = [], WHOLE, False
        return [done]

    def add(self, part: pa.RecordBatch) -> Iterator[tuple]:
        after = states(*_bits(part), self.open)
        before = np.r_[self.open, after[:-1]]
        rows, names = part.column("row_id").to_numpy(), part.column("file_name")
        for i, (line, inside) in enumerate(zip(part.column("line").to_pylist(), before.tolist(), strict=True)):
            if not inside:
                yield from self.flush(names[0].as_py(), False)
            if not self.held:
                self.row = int(rows[i])
            self.held.append(line)
        self.open = bool(after[-1])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in _RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
        )

    joiner, name = None, ""
    for batch in batches:
        found: list[tuple] = []
        for block, part in _blocks(batch):
            if joiner is None or joiner.block != block:
                if joiner is not None:
                    found += joiner.flush(name, True)
                joiner = _Joiner(block, part.column("open")[0].as_py())
                name = part.column("file_name")[0].as_py()
            found += joiner.add(part)
        if found:
            yield made(found)
    if joiner is not None and (found := joiner.flush(name, True)):
        yield made(found)


def _put_together(pieces: DataFrame) -> DataFrame:
    """Records of several splits, with the place of their beginning."""
    place = ["file_path", "block_start", "piece", "row_id"]
    in_file = Window.partitionBy("file_path").orderBy(*place[1:])
    number = F.sum((F.col("piece") == BEGINNING).cast("int")).over(in_file)
    # A file's pieces are numbered without their text; a split has two at most.
    numbers = pieces.select(*place).withColumn("number", number)
    ordered = F.sort_array(F.collect_list(F.struct("block_start", "row_id", "record")))
    first = F.min(F.struct("block_start", "row_id", "file_name", "header"))
    return (
        pieces.join(numbers, place)
        .groupBy("file_path", "number")
        .agg(ordered.alias("parts"), first.alias("first"))
        .select(
            "first.file_name", "file_path", "first.block_start", "first.row_id",
            F.concat_ws("\n", "parts.record").alias("record"), "first.header",
        )
    )


def read_csv_records(spark: SparkSession, paths) -> DataFrame:
    """The records below the headers as text (``record``), with the lineage of their first line."""
    text = spark.read.option("lineSep", "\n").text(paths)
    lines = _dealt(with_lineage(text, F.col("value").alias("line")))
    mapped = lines.select("*", *_maps(F.col("line")))
    schema = "file_path string, block_start long, from_closed boolean, from_open boolean"
    summaries = stage(mapped.select(*_BLOCK, "from_closed", "from_open").mapInArrow(_summaries, schema), "csv_splits")
    # One row per split of the input; the lines keep their order.
    marked = mapped.join(F.broadcast(_starts(summaries)), _BLOCK)
    records = marked.mapInArrow(_records, _RECORD)
    crossing = F.col("piece") != WHOLE
    if not summaries.where("from_closed").isEmpty():
        records = _dealt(stage(records, "csv_records"))
        joined = _put_together(records.where(crossing))
        records = records.where(~crossing).drop("piece").unionByName(joined)
    ended = F.replace(F.regexp_replace("record", "\r$", ""), F.lit("\r\n"), F.lit("\n"))
    return (
        records.where(~F.col("header"))
        .select("file_name", "file_path", "block_start", "row_id", ended.alias("record"))
        .where(F.col("record") != "")
    )
