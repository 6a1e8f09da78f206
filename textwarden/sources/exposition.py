"""Metrics in the text exposition format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric suffix, label name, type, help text, in output order.
METRICS = (
    ("requests_total", "", "counter", "Total number of HTTP requests processed"),
    ("requests_by_action_total", "action", "counter", "Total number of requests categorized by action (ALLOWED, BLOCKED, MASKED)"),
    ("threats_detected_total", "threat", "counter", "Total number of security threats detected by category"),
    ("http_responses_total", "code", "counter", "Total number of HTTP responses by status code"),
    ("latency_seconds_average", "component", "gauge", "Average inspection latency in seconds"),
)


def exposition_lines(metrics: DataFrame, prefix: str = "textwarden") -> DataFrame:
    """Long-form metrics (metric, label, value) to numbered text lines, HELP and TYPE first in each family."""
    order = F.create_map(*[F.lit(x) for n, (name, *_) in enumerate(METRICS) for x in (name, n)])
    labels = F.create_map(*[F.lit(x) for name, label, *_ in METRICS for x in (name, label)])
    name = F.concat(F.lit(f"{prefix}_"), F.col("metric"))
    label = labels[F.col("metric")]
    labelled = F.when(label == "", name).otherwise(F.concat(name, F.lit("{"), label, F.lit('="'), F.col("label"), F.lit('"}')))
    number = F.when(F.col("metric") == METRICS[-1][0], F.format_string("%.6f", F.col("value"))).otherwise(
        F.col("value").cast("bigint").cast("string")
    )
    samples = metrics.select(
        order[F.col("metric")].alias("family"), F.lit(2).alias("part"), F.col("label").alias("key"),
        F.concat_ws(" ", labelled, number).alias("line"),
    )
    heads = [
        (n, part, "", f"# {word} {prefix}_{metric} {text}")
        for n, (metric, _, kind, help_text) in enumerate(METRICS)
        for part, word, text in ((0, "HELP", help_text), (1, "TYPE", kind))
    ]
    spark = metrics.sparkSession
    return samples.unionByName(spark.createDataFrame(heads, "family int, part int, key string, line string"))


def write_exposition(metrics: DataFrame, path: str, prefix: str = "textwarden") -> None:
    lines = exposition_lines(metrics, prefix).orderBy("family", "part", "key")
    lines.select("line").coalesce(1).write.mode("overwrite").text(path)
