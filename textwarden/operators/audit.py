"""Tamper-evident audit chains: assign events to chains, build them, and verify logs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textwarden import fixed_values as fv
from textwarden.functions.digest import checkpoint_hash, payload_tail, record_hash
from textwarden.operators.sequence import BLOCK_ROWS, with_preceding

EVENT_COLUMNS = (
    "ts_ns", "trace_id", "client_id", "client_ip", "route", "action", "threat_category", "severity", "confidence",
    "reason", "matched_rule",
)


def audit_category(threat: Column) -> Column:
    """Audit label, with its standard code, of a detector's threat type; unknown types stay as they are."""
    labels = F.create_map(*[F.lit(item) for pair in fv.AUDIT_CATEGORY.items() for item in pair])
    return F.coalesce(F.try_element_at(labels, threat), threat)


def assign_chains(events: DataFrame, event_id: str, ts_ns: str, writers: int = 64, rotation_seconds: int = 3600) -> DataFrame:
    """Add ``chain_id``: one log file per writer and rotation period.

    Hashing is sequential inside a chain, so chains must be short and even. Events spread over the writers by their
    own id, whatever client or route they belong to, and a new file starts every rotation period.
    """
    period = F.call_function("div", F.call_function("div", F.col(ts_ns), F.lit(1_000_000_000)), F.lit(rotation_seconds))
    writer = F.pmod(F.col(event_id), F.lit(writers))
    return events.withColumn("chain_id", F.concat_ws("-", period.cast("string"), writer.cast("string")))


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash sorted records one after another; a new chain starts from the genesis hash."""
    chain, tip, count = None, fv.GENESIS_HASH, 0
    for batch in batches:
        previous, hashes, numbers = [], [], []
        for name, tail in zip(batch["chain_id"], batch["_tail"]):
            if name != chain:
                chain, tip, count = name, fv.GENESIS_HASH, 0
            previous.append(tip)
            tip = hashlib.sha256(f"prev:{tip}|{tail}".encode()).hexdigest()
            count += 1
            hashes.append(tip)
            numbers.append(count)
        yield batch.drop(columns="_tail").assign(record_no=numbers, prev_record_hash=previous, record_hash=hashes)


def build_chains(events: DataFrame, order: list[str]) -> DataFrame:
    """Link the events of every ``chain_id`` in the given order; adds record_no, prev_record_hash, record_hash.

    One shuffle by chain and a sort inside partitions; the hashes then stream through, one batch at a time, so memory
    does not depend on the length of a chain.
    """
    versioned = events.withColumn("checkpoint_version", F.lit(1))
    tailed = versioned.withColumn("_tail", payload_tail({name: F.col(name) for name in versioned.columns}))
    sorted_events = tailed.repartition("chain_id").sortWithinPartitions("chain_id", *order)
    schema = T.StructType(
        [
            *versioned.schema.fields,
            T.StructField("record_no", T.LongType()),
            T.StructField("prev_record_hash", T.StringType()),
            T.StructField("record_hash", T.StringType()),
        ]
    )
    return sorted_events.mapInPandas(_link, schema)


def checkpoints(chains: DataFrame, interval: int = fv.CHECKPOINT_INTERVAL, closing: bool = True) -> DataFrame:
    """Checkpoint rows of built chains: after every ``interval`` records, and one when a chain closes."""
    periodic = chains.where(F.col("record_no") % interval == 0).select(
        "chain_id", F.col("record_no").alias("record_count"), F.col("record_hash").alias("tip_hash"), F.lit(0).alias("closing")
    )
    rows = periodic
    if closing:
        rows = rows.unionByName(
            chain_tips(chains).select("chain_id", "record_count", "tip_hash", F.lit(1).alias("closing"))
        )
    return rows.withColumn("checkpoint_hash", checkpoint_hash(F.col("record_count"), F.col("tip_hash")))


def chain_tips(chains: DataFrame, order: str = "record_no") -> DataFrame:
    """Latest hash and record count per chain; this is what an append needs to go on."""
    return chains.groupBy("chain_id").agg(
        F.max_by("record_hash", order).alias("tip_hash"), F.count("*").alias("record_count")
    )


def check_lines(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Judge every parsed line of the logs: adds record_index and reason (NULL when the line is in order).

    Expects the columns of ``sources.audit_log.parse_lines``. The content hash of a record needs its own row only;
    the link and the checkpoint need the record before it, found block by block.
    """
    is_record = F.col("kind") == "RECORD"
    judged = with_preceding(lines, "chain_id", "line_no", is_record, F.col("record.record_hash"), block_rows)
    expected = F.coalesce("last_before", F.lit(fv.GENESIS_HASH))
    record, mark = F.col("record"), F.col("checkpoint")
    index = F.col("n_before").cast("string")
    computed = record_hash({name: record[name] for name in (*EVENT_COLUMNS, "checkpoint_version", "prev_record_hash")})
    blank_previous = F.coalesce(record["prev_record_hash"], F.lit(""))
    blank_hash = F.coalesce(record["record_hash"], F.lit(""))
    commitment = (
        (F.coalesce(mark["record_count"], F.lit(0)) == F.col("n_before"))
        & (F.coalesce(mark["tip_hash"], F.lit("")) == expected)
        & (F.coalesce(mark["checkpoint_hash"], F.lit(""))
           == checkpoint_hash(F.coalesce(mark["record_count"], F.lit(0)), F.coalesce(mark["tip_hash"], F.lit(""))))
    )
    reason = (
        F.when(F.col("kind") == "CORRUPT", F.concat(F.lit("corrupted JSON on record "), index))
        .when((F.col("kind") == "CHECKPOINT") & ~commitment, "invalid audit checkpoint commitment")
        .when(
            is_record & (blank_previous != expected),
            F.concat(F.lit("hash link mismatch at record "), index, F.lit(": expected prev_hash "), expected,
                     F.lit(", found "), blank_previous),
        )
        .when(
            is_record & (blank_hash != computed),
            F.concat(F.lit("payload tampering at record "), index, F.lit(": expected hash "), blank_hash,
                     F.lit(", computed "), computed),
        )
    )
    return judged.withColumns({"record_index": F.col("n_before"), "reason": reason}).drop("n_before", "last_before")


def verify_chains(lines: DataFrame, require_terminal_checkpoint: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One verdict per chain: valid, total_records, broken_at_index, reason.

    The first broken line decides; records before it count as verified. Logs that use checkpoints must end in one.
    """
    judged = check_lines(lines, block_rows)
    broken_line = F.when(F.col("reason").isNotNull(), F.col("line_no"))
    summary = judged.groupBy("chain_id").agg(
        F.min_by(F.struct("record_index", "reason"), broken_line).alias("_first"),
        F.count_if(F.col("kind") == "RECORD").alias("_records"),
        F.max_by("kind", "line_no").alias("_last_kind"),
        F.coalesce(F.max(F.when(F.col("kind") == "RECORD", F.col("record.checkpoint_version"))), F.lit(0)).alias("_version"),
    )
    broken = F.col("_first").isNotNull()
    truncated = (
        F.lit(require_terminal_checkpoint) & (F.col("_version") > 0) & (F.col("_last_kind") != "CHECKPOINT")
    )
    total = F.when(broken, F.col("_first.record_index")).otherwise(F.col("_records"))
    return summary.select(
        "chain_id",
        (~broken & ~truncated).alias("valid"),
        total.alias("total_records"),
        F.when(broken | truncated, total).alias("broken_at_index"),
        F.when(broken, F.col("_first.reason")).when(truncated, "missing terminal audit checkpoint").alias("reason"),
    )
