"""Durable staging: cut lineage with tables written to the shared checkpoint folder.

Every multi-pass operator stages its intermediate tables here, so a lost
executor costs a re-read of a file and never a re-run of the whole job.  The
folder is the one the cluster names in ``spark.checkpoint.dir``.  Tables staged in an
``owned`` block are released by their owner.

Finished outputs are published at once: a table gets its name when it is complete.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.functions import count, lit

_LOCAL_FALLBACK: dict[str, str] = {}


def _file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    context = spark.sparkContext
    named = context._jvm.org.apache.hadoop.fs.Path(path)
    return named, named.getFileSystem(context._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    named, files = _file_system(spark, path)
    files.delete(named, True)


@dataclass
class Owner:
    """Staged tables that are released together."""

    spark: SparkSession
    paths: list[str] = field(default_factory=list)

    def release(self) -> None:
        """Delete the tables; frames that read them can no longer be used."""
        while self.paths:
            delete(self.spark, self.paths.pop())


_OWNER: ContextVar[Owner | None] = ContextVar("staging_owner", default=None)


@contextmanager
def owned(spark: SparkSession, release: bool = False) -> Iterator[Owner]:
    """Tables staged inside belong to the owner.

    They are released when the block fails, with ``release`` also when it ends.
    """
    owner = Owner(spark)
    token = _OWNER.set(owner)
    done = False
    try:
        yield owner
        done = True
    finally:
        _OWNER.reset(token)
        if release or not done:
            owner.release()


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables, read from the session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(
            "spark.checkpoint.dir must name a folder all executors share; "
            "it is unset on this cluster"
        )
    # Single-JVM runs (tests, laptops) have one machine, so a local folder is shared.
    if context.applicationId not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[context.applicationId] = tempfile.mkdtemp(prefix="emberwatch-")
    return _LOCAL_FALLBACK[context.applicationId]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet under the staging root and return the written table."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/emberwatch/{label}-{uuid.uuid4().hex}"
    owner = _OWNER.get()
    if owner is not None:
        owner.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_measured(df: DataFrame, label: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """``stage`` plus aggregates observed while writing, without another job."""
    observation = Observation()
    staged = stage(df.observe(observation, *metrics), label)
    return staged, observation.get


MANIFEST = "_manifest.json"


def publish(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet", **options: str) -> list[str]:
    """Write each table below ``path``, where a table is visible only when it is complete.

    A table is written under a hidden name and renamed when all of them are there; the
    manifest, written last, lists the tables with their rows.  When a write fails, nothing
    of it stays.
    """
    if not tables:
        return []
    spark = next(iter(tables.values())).sparkSession
    for name in tables:
        named, files = _file_system(spark, f"{path}/{name}")
        if files.exists(named):
            raise FileExistsError(f"{path}/{name} exists")
    hidden = f"{path}/_parts-{uuid.uuid4().hex}"
    try:
        rows = {}
        for name, table in tables.items():
            counted = Observation()
            observed = table.observe(counted, count(lit(1)).alias("rows"))
            observed.write.format(fmt).options(**options).save(f"{hidden}/{name}")
            rows[name] = counted.get["rows"]
        for name in tables:
            named, files = _file_system(spark, f"{hidden}/{name}")
            if not files.rename(named, _file_system(spark, f"{path}/{name}")[0]):
                raise OSError(f"{path}/{name} could not be named")
        named, files = _file_system(spark, f"{path}/{MANIFEST}")
        out = files.create(named, True)
        out.write(bytearray(json.dumps({"format": fmt, "tables": rows}, indent=1).encode()))
        out.close()
    finally:
        delete(spark, hidden)
    return sorted(tables)
