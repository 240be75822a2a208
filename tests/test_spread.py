from pyspark.sql import functions as F

from workload import event_view


def test_no_task_gets_more_rows_than_the_bound(spark, monkeypatch):
    monkeypatch.setattr(event_view, "TASK_ROWS", 20)
    wide = event_view.spread(spark.range(0, 1000, 1, 1))
    sizes = wide.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 50 and max(r["count"] for r in sizes) <= 40
    assert wide.distinct().count() == 1000
