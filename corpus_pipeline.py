"""A training corpus in five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden.llm import decontaminate, jaccard, language, mixing, sharding
from textwarden.llm.queries import language_model
from textwarden.llm.tables import keep

#: SQL can't express the classifier or the rounding; the stages are tested against plain versions.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject."""
    return language.identify(docs, language_model(docs), keep_rejected=False).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id (null last), then the smallest hash.

    Rows are told apart by id and text, so another text under a losing id stays, and of repeated rows one stays, also without an id.
    Texts without words, null or empty, link with nothing and all stay. An empty table gives an empty one.
    """
    named = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", "text").alias("name"))
    found = jaccard.jaccard_components(named.select("name", "row.text"), id_col="name").where("n_shingles > 0").select("name", F.col("component_id").alias("group")).distinct()
    first = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.col("name"), F.xxhash64("row"), F.spark_partition_id())
    grouped = named.join(found, "name", "left")
    ranked = grouped.where("group is not null").withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(first))).where("place = 1")
    return ranked.select("row.*").unionByName(grouped.where("group is null").select("row.*"))


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that benchmark items share with them; mostly contaminated ones go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", remove_benchmarks),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus after all stages; every stage is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = keep(docs, name) if place < len(STAGES) - 1 else docs
    return docs
