"""Exact deduplication by a 128-bit content hash, with the bytes compared inside groups.

Texts are equal when they are identical after deleting ASCII white space.  Documents
are grouped by the hash *and* the normalised bytes, so equal hashes of different texts
stay apart; partial aggregation leaves one row per group and map task, whatever a
group's size.  The result is joined back by the hash alone.  Where a hash turns out to
have more than one text, its documents are joined by hash and text instead.

Cases: null text is empty; a null id never stays unless its group has no other id, and
then ``keep_id`` is null and ``kept`` true; rows with the same id and equal texts are
counted each and all have ``kept`` true if theirs is the id that stays; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.storage import stage

WHITE_SPACE = " \t\n\x0b\f\r"


def content_key(sha256: Column) -> Column:
    """The first 128 bits of the digest."""
    return F.unhex(F.substring(sha256, 1, 32))


def _best(points: Column, doc_id: Column) -> Column:
    """Most code points, then smallest id; the complement turns order round without overflow."""
    return F.max(F.struct(points.alias("points"), F.bitwise_not(doc_id).alias("turned")))


def _groups(hashed: DataFrame) -> DataFrame:
    return (
        hashed.groupBy("key", "body")
        .agg(
            _best(F.col("points"), F.col("doc_id")).alias("best"),
            F.count(F.lit(1)).alias("group_size"),
        )
        .withColumn("keep_id", F.bitwise_not("best.turned"))
        .drop("best")
    )


def exact_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    key_of: Callable[[Column], Column] = content_key,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per input row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    hashed = (
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.char_length(whole).alias("points"),
            F.translate(whole, WHITE_SPACE, "").alias("body"),
        )
        .withColumn("text_sha256", F.sha2(F.col("body").cast("binary"), 256))
        .withColumn("key", key_of(F.col("text_sha256")))
    )
    groups = stage(_groups(hashed).drop("body"), "exact_groups")
    shared = stage(
        groups.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("key"),
        "exact_shared_keys",
    )
    if shared.isEmpty():
        found = hashed.drop("body", "points").join(groups, "key", "left")
    else:
        alone = hashed.join(shared, "key", "left_anti").drop("body").join(groups, "key")
        mixed = hashed.join(shared, "key", "left_semi")
        several = mixed.join(_groups(mixed), ["key", "body"]).drop("body")
        found = alone.unionByName(several)
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
