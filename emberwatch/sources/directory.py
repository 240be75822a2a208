"""Directory scan with routing by file name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from emberwatch.fixed_values import (
    DEFAULT_ROUTE,
    DEFAULT_ROUTE_EXTENSIONS,
    FILE_NAME_ROUTES,
)


def route_by_name(name: Column) -> Column:
    """Source kind of a file name, '' when it is not recognised."""
    lowered = F.lower(name)
    steps = []
    for kind, words in FILE_NAME_ROUTES:
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        steps.append(F.when(hit, F.lit(kind)))
    for extension in DEFAULT_ROUTE_EXTENSIONS:
        steps.append(F.when(lowered.endswith(extension), F.lit(DEFAULT_ROUTE)))
    return F.coalesce(*steps, F.lit(""))


def list_files(spark: SparkSession, directory: str) -> list[str]:
    """Paths of the files directly in a directory, sorted by name."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise ValueError(f"{directory!r} is not a directory")
    files = [s.getPath() for s in fs.listStatus(path) if s.isFile()]
    return [str(p.toString()) for p in sorted(files, key=lambda p: p.getName())]


def route_files(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str]]:
    """``(kind, path)`` per file, in the given order."""
    if not paths:
        return []
    names = spark.createDataFrame(
        [(i, p, p.rsplit("/", 1)[-1]) for i, p in enumerate(paths)],
        "place int, path string, name string",
    )
    routed = names.select("place", "path", route_by_name(F.col("name")).alias("kind"))
    return [(row["kind"], row["path"]) for row in sorted(routed.collect())]
