import pytest
from pyspark.sql import functions as F

from textwarden.operators import metrics


def test_snapshot_of_several_batches_without_nulls(spark):
    """A task reads its rows in several batches of columns that are marked as free of NULL."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        i = F.col("id")
        rows = spark.range(0, 95, 1, 2).select(
            i.alias("ts"), F.lit("BLOCKED").alias("action"), F.when(i % 2 == 0, "A").otherwise("B").alias("threat_category"), F.lit(403).alias("status"),
            i.alias("waf_us"), i.alias("guard_us"), i.alias("proxy_us"),
        )
        snap = metrics.snapshot(rows, ["ts"], ["action"], limit=3).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (snap["total"], snap["blocked"], snap["threat_breakdown"], snap["status_breakdown"]) == (95, 95, {"A": 48, "B": 47}, {403: 95})
    assert [e["ts"] for e in snap["recent_events"]] == [92, 93, 94] and snap["avg_waf_ms"] == pytest.approx(0.047)
