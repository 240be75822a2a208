import csv
from pathlib import Path

from pyspark.sql import functions as F

from emberwatch.sources import csv_records
from emberwatch.sources.csv_export import read_csv_cells
from workload import queries


def test_texts_are_written_by_as_many_tasks_as_read_them(spark, tmp_path, monkeypatch):
    made = spark.range(0, 90, 1, 3).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit('a "b"\r\nc,\n\n').alias("text")
    )
    made.write.parquet(str(tmp_path / "documents.parquet"))
    # As separate splits, whatever their size.
    monkeypatch.setattr(queries, "table", lambda *_: made)
    monkeypatch.setattr(queries, "_folder", lambda _: str(tmp_path / "csv"))
    found = queries.csv_records(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(90))
    assert len(list(Path(tmp_path / "csv").glob("part-*.csv"))) == 3


def test_pieces_are_numbered_without_their_text(spark):
    rows = [
        ("f", "p", 0, 1, "a", csv_records.BEGINNING, True), ("f", "p", 10, 5, "b", csv_records.END, False),
        ("f", "p", 20, 9, "c", csv_records.END, False), ("f", "p", 20, 11, "d", csv_records.BEGINNING, False),
        ("f", "p", 30, 14, "e", csv_records.END, False),
    ]
    pieces = spark.createDataFrame(rows, csv_records._RECORD)
    joined = csv_records._put_together(pieces)
    assert sorted((r["row_id"], r["record"], r["header"]) for r in joined.collect()) == [
        (1, "a\nb\nc", True), (11, "d\ne", False),
    ]
    plan = joined._jdf.queryExecution().optimizedPlan().toString().splitlines()
    window = next(i for i, line in enumerate(plan) if "Window [" in line)
    assert "record" not in plan[window + 1]


def test_small_splits_share_tasks(spark, tmp_path):
    wanted = [(str(i), f'line "{i}"\nand, another\n') for i in range(3_000)]
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator="\n").writerows([("id", "text"), *wanted])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        found = read_csv_cells(spark, str(tmp_path), ["id", "text"])
        tasks = found.rdd.getNumPartitions()
        rows = found.orderBy("file_name", "file_path", "block_start", "row_id").collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert [(r.c0, r.c1) for r in rows] == wanted
    assert len({r.block_start for r in rows}) > 100
    # Records of one split, and those of several.
    assert tasks <= 4 * spark.sparkContext.defaultParallelism
