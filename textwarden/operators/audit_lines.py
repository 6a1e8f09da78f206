"""Audit logs written in one pass: records and checkpoints come out of the same hashing, and a log that exists goes on from its tips."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden import fixed_values as fv
from textwarden.functions.digest import payload_tail
from textwarden.sources import audit_log

# A line's number leaves room for the checkpoints after a record, as in ``audit_log.record_lines``.
_STEP = 4


def _emit(interval: int, closing: bool):
    """Lines of sorted events: each record, a checkpoint after every ``interval`` of a chain, one where it ends."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, tip, count = None, fv.GENESIS_HASH, 0

        def mark(last: int) -> tuple[str, int, str]:
            digest = hashlib.sha256(f"checkpoint:v1|count:{count}|tip:{tip}".encode()).hexdigest()
            line = f'{{"type":"{audit_log.CHECKPOINT}","record_count":{count},"tip_hash":"{tip}","checkpoint_hash":"{digest}"}}'
            return chain, count * _STEP + 1 + last, line

        for batch in batches:
            out = []
            for name, seed, before, body, tail in zip(batch["chain_id"], batch["_tip"], batch["_count"], batch["_body"], batch["_tail"]):
                if name != chain:
                    if chain is not None and closing:
                        out.append(mark(1))
                    chain, tip, count = name, seed, int(before)
                previous, count = tip, count + 1
                tip = hashlib.sha256(f"prev:{previous}|{tail}".encode()).hexdigest()
                out.append((chain, count * _STEP, f'{body[:-1]},"prev_record_hash":"{previous}","record_hash":"{tip}"}}'))
                if count % interval == 0:
                    out.append(mark(0))
            yield pd.DataFrame(out, columns=["chain_id", "line_no", "value"])
        if chain is not None and closing:
            yield pd.DataFrame([mark(1)], columns=["chain_id", "line_no", "value"])

    return work


def link_lines(
    events: DataFrame, order: list[str], tips: DataFrame | None = None, interval: int = fv.CHECKPOINT_INTERVAL, closing: bool = True
) -> DataFrame:
    """(chain_id, line_no, value): log lines of events, linked per ``chain_id`` in the given order.

    ``tips`` (chain_id, tip_hash, record_count) are what chains go on from; others start at the genesis hash. One shuffle by
    chain and a sort inside partitions, then records and checkpoints stream out together, each record hashed once.
    """
    versioned = events.withColumn("checkpoint_version", F.lit(1))
    seeded = versioned.withColumns({"_tip": F.lit(fv.GENESIS_HASH), "_count": F.lit(0).cast("long")})
    if tips is not None:
        known = tips.select("chain_id", F.col("tip_hash").alias("_known_tip"), F.col("record_count").alias("_known_count"))
        seeded = versioned.join(known, "chain_id", "left").withColumns(
            {"_tip": F.coalesce("_known_tip", F.lit(fv.GENESIS_HASH)), "_count": F.coalesce("_known_count", F.lit(0)).cast("long")}
        )
    lines = seeded.select(
        "chain_id", *order, "_tip", "_count", audit_log.record_body(versioned.columns).alias("_body"),
        payload_tail({name: F.col(name) for name in versioned.columns}).alias("_tail"),
    )
    ordered = lines.repartition("chain_id").sortWithinPartitions("chain_id", *order).select("chain_id", "_tip", "_count", "_body", "_tail")
    return ordered.mapInPandas(_emit(interval, closing), "chain_id string, line_no long, value string")


def append_log(spark: SparkSession, events: DataFrame, order: list[str], path: str, interval: int = fv.CHECKPOINT_INTERVAL, closing: bool = True) -> None:
    """Append events to the logs under ``path``: their chains go on from the tips that the files hold.

    Each append is one more part of a chain's folder, and parts are read in order; it becomes visible as a whole when its job commits.
    Recovery reads the logs once, as one row per chain; it neither verifies nor rewrites them.
    """
    parsed = audit_log.parse_lines(audit_log.read_log(spark, path))
    tips = audit_log.recover_tips(parsed)
    last = audit_log.read_log(spark, path).agg(F.max(F.shiftright("line_no", audit_log.PART_BITS))).first()[0]
    audit_log.write_log(link_lines(events, order, tips, interval, closing), path, 0 if last is None else last + 1)
