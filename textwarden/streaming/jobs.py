"""Streaming guard, windowed metrics, recent events, audit chains and duplicate removal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textwarden import fixed_values as fv
from textwarden.functions.digest import payload_tail
from textwarden.operators import metrics, prompts, requests
from textwarden.operators.pii import mask_turns


def guard_stream(stream: DataFrame, text: str, deep: bool = True) -> DataFrame:
    """Guard decision per row of a stream; the same projection as in batch."""
    return prompts.decide(stream, text, deep=deep)


def scan_stream(stream: DataFrame, **surfaces) -> DataFrame:
    return requests.scan_requests(stream, **surfaces)


def mask_stream(stream: DataFrame, text: str = "text") -> DataFrame:
    return mask_turns(stream, text)


def windowed_metrics(
    outcomes: DataFrame, ts: str, width: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes", *by: str
) -> DataFrame:
    """Counters and latencies per tumbling or sliding window; late rows count until the watermark passes."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    grouped = outcomes.withWatermark(ts, lateness).groupBy(window, *by)
    return grouped.agg(*metrics.counter_columns(), *metrics.latency_columns())


def drop_repeated_traces(stream: DataFrame, trace: str, ts: str, within: str = "10 minutes") -> DataFrame:
    """Keep the first of equal trace ids that arrive within the watermark."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([trace])


def keep_recent(path: str, order: list[str], limit: int = fv.RECENT_EVENTS):
    """foreachBatch function that keeps the latest notable events as one small table per batch under ``path``.

    A batch merges the table of the batch before it and writes its own, so a repeated batch rewrites the same table.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        latest = batch
        if batch_id > 0:
            earlier = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={batch_id - 1}")
            latest = batch.unionByName(earlier)
        recent = metrics.recent_events(latest, order, limit)
        recent.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return merge


class _ChainState(StatefulProcessor):
    """Tip hash and record count of one chain; emits linked records and a checkpoint after every interval."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("tip", T.StringType()), T.StructField("count", T.LongType())])
        self._state = handle.getValueState("tip", schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        tip, count = self._state.get() if self._state.exists() else (fv.GENESIS_HASH, 0)
        (chain,) = key
        arrived = pd.concat(list(rows)).sort_values(["ts_ns", "event_id"])
        out = []
        for event_id, tail in zip(arrived["event_id"], arrived["payload_tail"]):
            previous, count = tip, count + 1
            tip = hashlib.sha256(f"prev:{previous}|{tail}".encode()).hexdigest()
            out.append((chain, "RECORD", int(event_id), count, previous, tip))
            if count % fv.CHECKPOINT_INTERVAL == 0:
                mark = hashlib.sha256(f"checkpoint:v1|count:{count}|tip:{tip}".encode()).hexdigest()
                out.append((chain, "CHECKPOINT", None, count, tip, mark))
        self._state.update((tip, count))
        frame = pd.DataFrame(out, columns=["chain_id", "kind", "event_id", "record_no", "prev_record_hash", "record_hash"])
        yield frame.astype({"event_id": "Int64"})

    def close(self) -> None:
        pass


def chain_stream(events: DataFrame) -> DataFrame:
    """Link a stream of audit events (event_id, chain_id and the audit columns) into one chain per chain_id.

    State is one row per chain. Chains are spread over writers and rotated (see ``operators.audit.assign_chains``),
    so a batch brings each chain few rows. Rows of one batch are linked in event order.
    """
    versioned = events.withColumn("checkpoint_version", F.lit(1))
    tailed = versioned.select(
        "event_id", "chain_id", "ts_ns", payload_tail({name: F.col(name) for name in versioned.columns}).alias("payload_tail")
    )
    schema = "chain_id string, kind string, event_id bigint, record_no bigint, prev_record_hash string, record_hash string"
    return tailed.groupBy("chain_id").transformWithStateInPandas(
        statefulProcessor=_ChainState(), outputStructType=schema, outputMode="Append", timeMode="None"
    )
