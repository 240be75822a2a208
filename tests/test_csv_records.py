"""Records of CSV files read in small splits, against the csv module and Spark's own reader."""

import csv
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.sources.csv_export import SURPLUS, read_csv_cells
from emberwatch.sources.csv_records import states

CELLS = [
    "plain", "", "with, comma", "two\nlines", 'a "quoted" word', '"', '""', "\n", "a\n\n\"b\"\n,c", " spaced ",
    '{"k": "v", "n": [1, 2]}', "x" * 300, "-", 'ends with "', '"begins"', ",", ',"', '",', "é\n日本",
]


def _table(rng, rows, columns):
    return [[rng.choice(CELLS) for _ in range(columns)] for _ in range(rows)]


def _write(path, header, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator=end).writerows([header, *rows])


def _cells(spark, folder, columns):
    frame = read_csv_cells(spark, str(folder), columns)
    rows = frame.orderBy("file_name", "file_path", "block_start", "row_id").collect()
    assert all(r[SURPLUS] is None for r in rows)
    return [[r[f"c{i}"] or "" for i in range(len(columns))] for r in rows]


@pytest.mark.parametrize("split", [64, 200, 1_000, 1 << 20])
def test_rows_equal_the_csv_module(spark, tmp_path, split):
    rng = random.Random(split)
    header = ["a", "b\nb", 'c "c"']
    wanted = []
    for i in range(3):
        rows = _table(rng, 120, 3)
        rows.append(["last", "cell\nover\n\nlines", "end"])
        _write(tmp_path / f"{i}.csv", header, rows)
        wanted += rows
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = _cells(spark, tmp_path, header)
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == wanted
    assert split > 1_000 or tasks > 20


def test_carriage_returns_and_stray_quotes(spark, tmp_path):
    header = ["a", "b"]
    rows = [["1", "two\nlines"], ["3", "4"], ["", "x"]]
    _write(tmp_path / "a.csv", header, rows, "\r\n")
    with open(tmp_path / "b.csv", "w", newline="") as out:
        out.write('a,b\n5\' 6",six\n\n7,8"9"\n10,"open to\nthe end')
    got = _cells(spark, tmp_path, header)
    assert got == [*rows, ["5' 6\"", "six"], ["7", '8"9"'], ["10", "open to\nthe end"]]


def test_rows_equal_sparks_reader_in_one_task(spark, tmp_path):
    rows = _table(random.Random(5), 300, 4)
    header = ["a", "b", "c", "d"]
    _write(tmp_path / "x.csv", header, rows)
    one = spark.read.options(header=True, multiLine=True, quote='"', escape='"', nullValue="").csv(str(tmp_path))
    names = [f"c{i}" for i in range(4)]
    ours = read_csv_cells(spark, str(tmp_path), header).select(*names)
    assert sorted(map(repr, map(tuple, ours.collect()))) == sorted(map(repr, map(tuple, one.toDF(*names).collect())))


def test_states_compose():
    rng = np.random.default_rng(3)
    for _ in range(50):
        closed, opened = rng.random(40) < 0.3, rng.random(40) < 0.6
        for start in (False, True):
            bit, wanted = start, []
            for c, o in zip(closed, opened, strict=True):
                bit = bool(o if bit else c)
                wanted.append(bit)
            assert states(closed, opened, start).tolist() == wanted


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n")
    (tmp_path / "b.csv").write_text("")
    assert read_csv_cells(spark, str(tmp_path), ["a", "b"]).where(F.col("c0").isNotNull()).collect() == []
