"""Session settings the engine is designed around."""

from __future__ import annotations

from pyspark.sql import SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits the map blocks of a hot (rule, key, time bucket) over several tasks.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Settings the parsers need in any session; both can be set at run time.
PARSER_SETTINGS = {
    # Repeated JSON keys keep the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # The JVM never compiles methods over 8000 bytes; wide projections run faster
    # when Spark splits them instead of fusing them into one such method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def prepare_for_parsing(spark: SparkSession) -> None:
    for name, value in PARSER_SETTINGS.items():
        spark.conf.set(name, value)


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for name, value in RECOMMENDED.items():
        builder = builder.config(name, value)
    return builder


def local_session(cpus: int = 8, app: str = "emberwatch", **extra: str) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        configure(SparkSession.builder.master(f"local[{cpus}]").appName(app))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
    )
    for name, value in extra.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
