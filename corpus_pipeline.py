"""A corpus pipeline of five stages, each one of the operators in ``emberwatch.llm``.

``run`` applies them to ``documents``; every stage's rows are written as Parquet in the
shared folder and read again by the next one.

1. language: documents whose language cannot be told with confidence go.  Labels of the
   table are learned from; the decision uses the text alone.
2. lines: lines within one word edit of an earlier line are cut; of fewer than eight
   words, those equal to an earlier line.
3. near copies: of each group linked by 5-word shingles at a similarity of 0.8 or more
   one row stays, that with the smallest id (null is last); ids may repeat or be null.
4. benchmark: spans of benchmark windows are cut.
5. packing: what is left becomes token sequences, one row per piece.

``n_chars`` follows the text.  No SQL can state trained models and sketches, so
ORACLE_SQL is None and the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm import decontaminate as benchmark_cut
from emberwatch.llm import langid, line_dedup, near_dedup, packing
from emberwatch.llm.common import fold, table
from emberwatch.storage import stage

ORACLE_SQL = None
SHINGLE, THRESHOLD = 5, 80


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select(columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learn = F.coalesce(fold() != 0, F.lit(False))
    model = langid.train(langid.labelled_rows(docs, F.col("lang"), learn))
    # The rows as one column: a table may have columns of the names that the operator adds.
    packed = docs.select(F.struct("*").alias("__doc"), "text")
    return langid.predict(model, packed, keep=["__doc"]).where("not rejected").select("__doc.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.line_dedup(docs, every_line=True, counts=False), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Rows are told apart by a key of their own, fixed once written.
    keyed = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "corpus_rows")
    found = near_dedup.near_dedup(keyed, doc_id="__row", shingle=SHINGLE, threshold=THRESHOLD)
    members = found.select(F.col("doc_id").alias("__row"), "component_id").join(
        keyed.select("__row", "doc_id"), "__row"
    )
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "__row")
    first = members.groupBy("component_id").agg(F.min(place).alias("first"))
    return keyed.join(first.select("first.__row"), "__row", "left_semi").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = benchmark_cut.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _counted(clean, docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"corpus_{name}")
    return docs
