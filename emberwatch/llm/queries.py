"""Registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm import (
    collocations,
    decontaminate,
    exact_dedup,
    hard_negatives,
    langid,
    line_dedup,
    lm_score,
    near_dedup,
    neighbours,
    packing,
    secrets,
    toxicity,
    warc,
)
from emberwatch.llm.common import fold, table
from emberwatch.storage import staging_root

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_warc_merge(spark, sf_dir):
    path = f"{staging_root(spark)}/emberwatch/warc-{uuid.uuid4().hex}"
    index = warc.archive_round_trip(table(spark, sf_dir, "pages"), path)
    return index.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "position"
    )


@query
def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs, every_line=True)


@query
def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query
def op6_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


@query
def op7_decontamination(spark, sf_dir):
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, benchmark)


@query
def op8_secret_scan(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@query
def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op3_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = F.coalesce(fold() != 0, F.lit(False))
    model = langid.train(langid.labelled_rows(docs, F.col("lang"), learn))
    return langid.predict(
        model, docs.withColumn("held_out", F.coalesce(fold() == 0, F.lit(False))), keep=["doc_id", "held_out"]
    )


@query
def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold() != 0).select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    held_out = F.coalesce(fold() == 0, F.lit(False))
    return toxicity.score(model, docs.withColumn("held_out", held_out), keep=["doc_id", "held_out"])


@query
def op10_lm_score(spark, sf_dir):
    return lm_score.lm_score(table(spark, sf_dir, "documents"))


@query
def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label=label)


@query
def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op13_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))
