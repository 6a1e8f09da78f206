"""Tables between the steps of an operator, components of links, and ranks, all held by Spark."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden.session import shared_folder


def keep(df: DataFrame, purpose: str) -> DataFrame:
    """Write a step's rows to the shared folder and read them from there: later steps neither recompute nor lose them."""
    path = shared_folder(df.sparkSession, f"llm-{purpose}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: int = 1 << 21) -> Iterator[None]:
    """Arrow batches of about ``size`` bytes at most for the steps that run inside: a batch stands in the executor and in its Python task at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{size}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other and nothing hangs on it, or it is such a root: then each star is a component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("root")).unionByName(edges.select(F.col("b"), F.lit(0), F.lit(1)).toDF("node", "hangs", "root"))
    torn = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("root").alias("root")).where("hangs > 1 or hangs = 1 and root = 1")
    return torn.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b) but the roots: root is the smallest node that links reach.

    Alternating stars: each node hands its larger, then its smaller neighbours over to its smallest one, until every
    node hangs on its root. The rows never exceed the links, groups are minima only, and hub rows are joined, not gathered.
    """
    now = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    while not _is_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = keep(small.unionByName(small_least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def keys_of(*columns: str) -> list[Column]:
    """Sorting columns under which null comes last."""
    return [F.col(c).asc_nulls_last() for c in columns]


def rank_from_zero(df: DataFrame, by: str, name: str) -> DataFrame:
    """Place of each row in the order of ``by`` (null last), without one task that sees all rows.

    Rows are dealt by ranges; the ranges' counts, one row for each partition, give the offsets.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = keep(df.repartitionByRange(n, *keys_of(by)).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range").orderBy(*keys_of(by))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return dealt.withColumn("_row", F.row_number().over(inside)).join(offsets, "_range").withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_range", "_row", "_before")
