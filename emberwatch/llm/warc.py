"""WARC archives of pages, and the merge of their locally sorted capture runs.

``write_archives`` writes one record per page as gzip'd WARC/1.1 files: of records with
equal payloads of at least ``min_payload`` bytes the one with the largest page id is the
response and the others are revisits that refer to it.  ``read_runs`` reads archives
back by Content-Length; the entries of an archive, sorted by (URL key, timestamp,
page id), are one run.  ``merge_runs`` deals all runs into key ranges and merges the
part that each range got of every run with a loser tree; ranges follow each other, so
the table is in global order, and ``position`` is the place in it.  A range holds a
bounded number of index entries (never payloads), and ids and offsets break ties, so
one host or one URL may span many ranges.

Cases: a null payload is an empty one; a null or odd URL is written without control
characters and may be empty; a null page id is never referred to, and reads back as
null; rows with the id of the response are all responses; an empty table writes no
record and gives an empty index; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.storage import stage

# Records of one archive file at most; index entries of one merge range, about.
RECORDS_PER_ARCHIVE = 10_000
ENTRIES_PER_RANGE = 200_000
# Captures without a time of their own get this second plus their id.
EPOCH = 1_600_000_000
CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HEAD = b"\r\n\r\n"

INDEX = T.StructType(
    [
        T.StructField("urlkey", T.StringType()),
        T.StructField("captured", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("run", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)
MERGED = T.StructType(
    [*INDEX.fields, T.StructField("range", T.LongType()), T.StructField("local", T.LongType())]
)


# --- writing ------------------------------------------------------------------------------


def base32_of_hex(hexes: Column) -> Column:
    """Base32 of a 40-digit SHA-1: eight groups of 20 bits."""
    groups = [
        F.lpad(F.conv(F.substring(hexes, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record_id(page_id: Column) -> Column:
    """A reversible URN: the id's 64 bits are the last 16 digits; no id is all f."""
    digits = F.lower(F.lpad(F.hex(page_id), 16, "0"))
    named = F.concat(
        F.lit("<urn:uuid:00000000-0000-0000-"), F.substring(digits, 1, 4), F.lit("-"),
        F.substring(digits, 5, 12), F.lit(">"),
    )
    return F.coalesce(named, F.lit("<urn:uuid:ffffffff-ffff-ffff-ffff-ffffffffffff>"))


def _lines(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def records(
    pages: DataFrame,
    min_payload: int = 0,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    captured: str | None = None,
) -> DataFrame:
    """One column ``record``: the text of a WARC record without the two line ends after it."""
    when = (
        F.col(captured).cast("timestamp")
        if captured
        else F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9)))
    )
    named = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\x00-\x20\x7f]", "").alias("url"),
        F.coalesce(F.col(payload), F.lit("")).alias("payload"),
        *([F.col(captured)] if captured else []),
    )
    hashed = named.withColumns(
        {
            "size": F.octet_length("payload").cast("long"),
            "sha1": F.sha1(F.col("payload").cast("binary")),
            "date": F.date_format(
                F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"
            ),
        }
    )
    repeated = stage(
        hashed.where(F.col("size") >= min_payload)
        .groupBy("sha1", "size")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("times"))
        .where("times > 1 and response is not null")
        .drop("times"),
        "warc_repeated",
    )
    full = hashed.join(repeated, ["sha1", "size"], "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    http = _lines(
        "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF,
        "Content-Length: ", F.col("size").cast("string"), CRLF + CRLF,
    )
    body = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    refers = F.when(
        revisit,
        _lines(
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            CRLF + "WARC-Refers-To: ", record_id(F.col("response")), CRLF,
        ),
    ).otherwise("")
    parts = full.select("page_id", "url", "date", "sha1", refers.alias("refers"), body.alias("body"),
                        revisit.alias("revisit"))
    return parts.select(
        _lines(
            "WARC/1.1" + CRLF + "WARC-Type: ",
            F.when(F.col("revisit"), "revisit").otherwise("response"), CRLF,
            "WARC-Record-ID: ", record_id(F.col("page_id")), CRLF,
            "WARC-Date: ", F.col("date"), CRLF,
            "WARC-Target-URI: ", F.col("url"), CRLF,
            "WARC-Payload-Digest: sha1:", base32_of_hex(F.col("sha1")), CRLF,
            F.col("refers"),
            "Content-Type: application/http; msgtype=response" + CRLF,
            "Content-Length: ", F.octet_length("body").cast("string"), CRLF + CRLF,
            F.col("body"),
        ).alias("record")
    )


def write_archives(pages: DataFrame, path: str, **names) -> None:
    """Archives of at most RECORDS_PER_ARCHIVE records below ``path``."""
    (
        records(pages, **names)
        .write.option("compression", "gzip")
        .option("lineSep", CRLF + CRLF)
        .option("maxRecordsPerFile", RECORDS_PER_ARCHIVE)
        .text(path)
    )


# --- reading ------------------------------------------------------------------------------


def url_key(url: str) -> str:
    """Host parts from the top domain down, then the path, in lower case."""
    rest = url.lower().partition("://")[2] or url.lower()
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].split("."))) + ")" + rest[cut:]


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split(CRLF)[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _id(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").rpartition("uuid:")[2].replace("-", "")
    if not digits or digits == "f" * 32:
        return None
    value = int(digits[16:], 16)
    return value - (1 << 64) if value >> 63 else value


def parse_archive(run: str, data: bytes) -> Iterator[dict]:
    """An index entry for each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(_HEAD, at) + 4
        warc = _fields(data[at : end - 4])
        size = int(warc["content-length"])
        http_end = data.index(_HEAD, end, end + size) + 4
        http = _fields(data[end : http_end - 4])
        payload = data[http_end : end + size]
        kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if found != digest or len(payload) != int(http["content-length"]):
                raise ValueError(f"{run} at {at}: the payload does not match its digest")
        yield {
            "urlkey": url_key(warc.get("warc-target-uri", "")),
            "captured": "".join(c for c in warc["warc-date"] if c.isdigit()),
            "page_id": _id(warc["warc-record-id"]),
            "url": warc.get("warc-target-uri", ""),
            "record_type": kind,
            "refers_to": _id(warc.get("warc-refers-to")),
            "payload_bytes": int(http["content-length"]),
            "payload_digest": digest,
            "run": run,
            "start": at,
            "length": end + size - at,
        }
        at = end + size + 4


def _order(row: dict) -> tuple:
    missing = row["page_id"] is None
    return (
        row["urlkey"], row["captured"], missing, 0 if missing else row["page_id"],
        row["run"], row["start"],
    )


def _arrow(schema: T.StructType, rows: list[dict]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(*(batch.column(i) for i in (0, 1)), strict=True):
            data = zlib.decompress(content.as_py(), wbits=31) if len(content.as_py()) else b""
            name = path.as_py().rpartition("/")[2]
            entries = sorted(parse_archive(name, data), key=_order)
            for i in range(0, len(entries), 10_000):
                yield _arrow(INDEX, entries[i : i + 10_000])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives below ``path``; each archive's are sorted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(_runs, INDEX)


# --- merging ------------------------------------------------------------------------------


class LoserTree:
    """Merges sorted runs: each inner node holds the run that lost there, the root the winner."""

    def __init__(self, runs: list[list], key: Callable):
        self.runs, self.key = runs, key
        self.places = [0] * len(runs)
        self.size = 1 << max(1, (len(runs) - 1).bit_length())
        self.heads = [self._head(i) for i in range(self.size)]
        self.losers = [0] * self.size
        won = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            left, right = won[2 * node], won[2 * node + 1]
            if not self._before(left, right):
                left, right = right, left
            won[node], self.losers[node] = left, right
        self.winner = won[1]

    def _head(self, run: int):
        if run >= len(self.runs) or self.places[run] >= len(self.runs[run]):
            return None
        return self.key(self.runs[run][self.places[run]])

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self) -> Iterator:
        while self.heads[self.winner] is not None:
            run = self.winner
            yield self.runs[run][self.places[run]]
            self.places[run] += 1
            self.heads[run] = self._head(run)
            node = (run + self.size) // 2
            while node:
                if not self._before(run, self.losers[node]):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    runs: dict[str, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            runs.setdefault(row["run"], []).append(row)
    for entries in runs.values():
        entries.sort(key=_order)  # in order already unless blocks of a run arrived mixed
    number, ready = TaskContext.get().partitionId(), []
    for local, row in enumerate(LoserTree([runs[k] for k in sorted(runs)], _order)):
        ready.append(row | {"range": number, "local": local})
        if len(ready) == 10_000:
            yield _arrow(MERGED, ready)
            ready = []
    if ready:
        yield _arrow(MERGED, ready)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All entries with ``position``, from 0 in the order of URL key, time and page id."""
    entries = runs.count()
    ranges = max(1, -(-entries // ENTRIES_PER_RANGE))
    order = ["urlkey", "captured", F.col("page_id").isNull(), "page_id", "run", "start"]
    merged = stage(
        runs.repartitionByRange(ranges, *order).mapInArrow(_merge, MERGED), "warc_merged"
    )
    # One row per range: how many entries the ranges before it have.
    sizes = merged.groupBy("range").agg(F.count(F.lit(1)).alias("entries"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("range", F.coalesce(F.sum("entries").over(before), F.lit(0)).alias("before"))
    return (
        merged.join(F.broadcast(offsets), "range")
        .withColumn("position", F.col("before") + F.col("local"))
        .drop("range", "local", "before")
    )


def histories(index: DataFrame) -> DataFrame:
    """Captures per URL key: how many, the first, the last, and how many different payloads."""
    return index.groupBy("urlkey").agg(
        F.count(F.lit(1)).alias("captures"),
        F.min("captured").alias("first"),
        F.max("captured").alias("last"),
        F.approx_count_distinct("payload_digest").alias("payloads"),
    )


def archive_round_trip(pages: DataFrame, path: str, **names) -> DataFrame:
    """Write ``pages`` as archives below ``path``, read them back and merge their runs."""
    write_archives(pages, path, **names)
    return merge_runs(stage(read_runs(pages.sparkSession, path), "warc_runs"))
