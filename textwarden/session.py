"""Session settings and the shared folder for data that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Recording the call site of every column expression costs more than building it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "textwarden", master: str | None = None, **settings: str) -> SparkSession:
    """Session with the settings the jobs are made for; ``master`` is for local runs, clusters set their own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in (SETTINGS | settings).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """New folder under spark.checkpoint.dir, which all executors reach.

    Where that is unset, a local session gets a folder of this machine; a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="textwarden-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Rows written to the shared folder and read from there, for steps that are read several times and cost more than a copy."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_TASKS_PER_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """Spread an input of few partitions over several tasks per core before per-row work that takes long.

    A small table in one file is one task however many cores there are, and with hardly more partitions than cores, or with
    partitions of unequal row groups, most cores wait for the last ones. Inputs with several partitions per core stay as they are.
    """
    tasks = _TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= tasks:
        return df
    return df.repartition(tasks)
