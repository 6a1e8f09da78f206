"""Labelled corpora and recorded bypass baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CASE = "struct<id:string,prompt:string,expected_attack:boolean>"
_ENTRY = "struct<max_bypasses:int,total:int,known:array<string>>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON document {"categories": {name: [case]}} to rows of category, id, prompt, expected_attack."""
    schema = f"categories map<string,array<{_CASE}>>"
    categories = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("categories").alias("category", "cases"))
    return categories.select("category", F.explode("cases").alias("case")).select("category", "case.*")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """JSON document {harness: {max_bypasses, total, known}} to one row per known bypass (NULL for none)."""
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(F.explode(F.from_json("value", "map<string,variant>")).alias("harness", "_entry"))
    typed = entries.select("harness", F.try_variant_get("_entry", "$", _ENTRY).alias("entry")).where("entry is not null")
    return typed.select("harness", "entry.max_bypasses", "entry.total", F.explode_outer("entry.known").alias("name"))
