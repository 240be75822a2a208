from pyspark.sql import functions as F

from emberwatch.plans import profile


def test_suggestions_sort_no_cells(spark):
    rows = spark.range(0, 500, 1, 7).select(
        F.lit("f").alias("file_name"), F.lit("p").alias("file_path"), F.lit(0).cast("long").alias("block_start"),
        (499 - F.col("id")).alias("row_id"),
        F.when(F.col("id") < 496, F.concat(F.lit("v"), (499 - F.col("id")).cast("string"))).alias("c0"),
        F.lit(None).cast("string").alias("c1"),
    )
    found = profile.profile_suggestions(spark, rows.union(rows), ["odd one", "odd two"])
    assert [(r["column"], r["samples"]) for r in found.orderBy("place").collect()] == [
        ("odd one", "v4, v4, v5"), ("odd two", "?"),
    ]
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text and "MapInArrow" in text
