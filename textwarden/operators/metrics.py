"""Counters, breakdowns, latencies and recent events over request outcomes.

Expects columns status, action, threat_category and waf_us, guard_us, proxy_us (whole microseconds).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textwarden import fixed_values as fv

COMPONENTS = ("waf", "guard", "proxy")


def counter_columns() -> list[Column]:
    action = F.upper("action")
    return [
        F.count("*").alias("total"),
        *[F.count_if(action == name.upper()).alias(name) for name in ("allowed", "blocked", "masked")],
    ]


def counters(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(*counter_columns())


def _is_threat() -> Column:
    return ~F.coalesce(F.col("threat_category"), F.lit("")).isin("", "NONE")


def threat_breakdown(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(_is_threat()).groupBy("threat_category").agg(F.count("*").alias("n"))


def threat_severity_rollup(outcomes: DataFrame) -> DataFrame:
    """Threats by category and severity with subtotals; level 0 is the pair, 1 the category, 3 the total."""
    return (
        outcomes.where(_is_threat())
        .rollup("threat_category", "severity")
        .agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))
    )


def status_breakdown(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status").agg(F.count("*").alias("n"))


def latency_columns() -> list[Column]:
    return [
        F.coalesce(F.sum(f"{name}_us") / F.count("*") / 1000.0, F.lit(0.0)).alias(f"avg_{name}_ms") for name in COMPONENTS
    ]


def latency_averages(outcomes: DataFrame) -> DataFrame:
    """Average milliseconds per component; zero when there are no requests."""
    return outcomes.agg(*latency_columns())


def notable(outcomes: DataFrame) -> DataFrame:
    """Outcomes that belong into the event feed: blocked, masked or with a threat."""
    threat = F.coalesce(F.col("threat_category"), F.lit("")) != "NONE"
    return outcomes.where(F.col("action").isin("BLOCKED", "MASKED") | threat)


def recent_events(outcomes: DataFrame, order: list[str], limit: int = fv.RECENT_EVENTS) -> DataFrame:
    """The latest notable outcomes, oldest first; a top-k, so every task keeps at most ``limit`` rows."""
    latest = notable(outcomes).orderBy(*[F.desc(name) for name in order]).limit(limit)
    return latest.orderBy(*order)


_KEYS = ("action", "threat_category", "status")
_SUMS = ("n", *[f"{name}_us" for name in COMPONENTS])


def _merge(order: list[str], events: list[str], limit: int):
    """Merge rows of counts and events of one task: a row for each group of counts, and the newest events."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = newest = schema = None
        for batch in batches:
            schema = pa.schema([field.with_nullable(True) for field in batch.schema])
            # Sums may be NULL where the input is not, so the batches' own marks cannot hold for what is merged.
            rows = pa.Table.from_batches([batch]).cast(schema)
            counted = rows.filter(pc.greater(rows["n"], 0)).select([*_KEYS, *_SUMS])
            counts = counted if counts is None else pa.concat_tables([counts, counted])
            summed = counts.group_by(list(_KEYS), use_threads=False).aggregate([(name, "sum") for name in _SUMS])
            counts = summed.select([*_KEYS, *[f"{name}_sum" for name in _SUMS]]).rename_columns([*_KEYS, *_SUMS])
            shown = rows.filter(rows["_notable"]).select(["_notable", *events])
            newest = shown if newest is None else pa.concat_tables([newest, shown])
            if newest.num_rows > limit:
                newest = newest.take(pc.select_k_unstable(newest, limit, [(name, "descending") for name in order]))
        if counts is not None:
            merged = pa.concat_tables([counts, newest], promote_options="default")
            yield from merged.select(schema.names).cast(schema).combine_chunks().to_batches()

    return work


def _summed(entries: str, field: str, keep) -> Column:
    """Map from the values of a field to their summed counts, sorted by key, over the few rows of a merged snapshot; NULL is no key."""
    rows = F.filter(entries, lambda row: row[field].isNotNull() & keep(row[field]))
    total = lambda key: F.aggregate(F.filter(rows, lambda row: row[field] == key), F.lit(0).cast("bigint"), lambda n, row: n + row["n"])
    keys = F.array_sort(F.array_distinct(F.transform(rows, lambda row: row[field])))
    return F.map_from_entries(F.transform(keys, lambda key: F.struct(key.alias("key"), total(key).alias("n"))))


def snapshot(outcomes: DataFrame, order: list[str], event_columns: list[str], limit: int = fv.RECENT_EVENTS, fan_in: int = 64) -> DataFrame:
    """One row with counters, averages, breakdown maps and the recent events, from one pass over the outcomes and without a sort.

    Every task keeps counts by action, threat and status, and its newest ``limit`` events; these states, which don't grow with the rows, are merged
    by ``fan_in`` tasks and then by one. Rows without a status or threat count, but have no place in the maps; no rows give zeros and empty maps.
    """
    names = list(dict.fromkeys([*order, *event_columns]))
    events = [f"_event_{name}" for name in names]
    threat = F.coalesce(F.col("threat_category"), F.lit("")) != "NONE"
    notable_row = F.coalesce(F.col("action").isin("BLOCKED", "MASKED"), F.lit(False)) | threat
    state = outcomes.select(
        *_KEYS, F.lit(1).cast("bigint").alias("n"), *[F.col(name).cast("bigint").alias(name) for name in _SUMS[1:]], notable_row.alias("_notable"),
        *[F.when(notable_row, F.col(name)).alias(event) for name, event in zip(names, events, strict=True)],
    )
    merge = _merge([f"_event_{name}" for name in order], events, limit)
    schema = T.StructType([T.StructField(field.name, field.dataType) for field in state.schema])
    merged = state.mapInArrow(merge, schema)
    for tasks in (fan_in, 1):
        merged = merged.repartition(tasks).mapInArrow(merge, schema)
    action = F.upper("action")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")
    event = F.struct(*[F.col(f"_event_{name}").alias(name) for name in (*order, *event_columns)])
    row = merged.agg(
        total(F.lit(True)).alias("total"), *[total(action == name.upper()).alias(name) for name in ("allowed", "blocked", "masked")],
        *[F.coalesce(F.sum(f"{name}_us") / F.sum("n") / 1000.0, F.lit(0.0)).alias(f"avg_{name}_ms") for name in COMPONENTS],
        F.collect_list(F.when(F.col("n") > 0, F.struct("threat_category", "status", "n"))).alias("_counts"),
        F.array_sort(F.collect_list(F.when(F.col("_notable"), event))).alias("recent_events"),
    )
    return row.select(
        "total", "allowed", "blocked", "masked", *[f"avg_{name}_ms" for name in COMPONENTS],
        _summed("_counts", "threat_category", lambda name: ~name.isin("", "NONE")).alias("threat_breakdown"),
        _summed("_counts", "status", lambda status: F.lit(True)).alias("status_breakdown"), "recent_events",
    )


def long_form(outcomes: DataFrame) -> DataFrame:
    """Metrics as rows of metric, label, value, for the text exposition."""
    totals = outcomes.agg(*counter_columns(), *latency_columns())
    value = lambda name: F.col(name).cast("double")
    stacked = F.array(
        F.struct(F.lit("requests_total").alias("metric"), F.lit("").alias("label"), value("total").alias("value")),
        *[
            F.struct(F.lit("requests_by_action_total").alias("metric"), F.lit(name.upper()).alias("label"), value(name).alias("value"))
            for name in ("allowed", "blocked", "masked")
        ],
        *[
            F.struct(F.lit("latency_seconds_average").alias("metric"), F.lit(name).alias("label"), (value(f"avg_{name}_ms") / 1000).alias("value"))
            for name in COMPONENTS
        ],
    )
    rows = totals.select(F.inline(stacked))
    threats = threat_breakdown(outcomes).select(
        F.lit("threats_detected_total").alias("metric"), F.col("threat_category").alias("label"), value("n").alias("value")
    )
    statuses = status_breakdown(outcomes).select(
        F.lit("http_responses_total").alias("metric"), F.col("status").cast("string").alias("label"), value("n").alias("value")
    )
    return rows.unionByName(threats).unionByName(statuses)


def rate_breaches(
    outcomes: DataFrame, key: str, ts: str, quotas: DataFrame | None = None, per_minute: int = fv.DEFAULT_RATE_PER_MINUTE,
    burst: int = fv.DEFAULT_BURST,
) -> DataFrame:
    """Keys with more requests in a minute than their quota plus burst; quotas is (key, rate_limit)."""
    counted = outcomes.groupBy(key, F.date_trunc("minute", F.col(ts)).alias("minute")).agg(F.count("*").alias("n"))
    if quotas is not None:
        counted = counted.join(quotas.select(key, "rate_limit"), key, "left")
    limit = F.coalesce(F.col("rate_limit"), F.lit(per_minute)) if quotas is not None else F.lit(per_minute)
    return counted.withColumn("allowed", limit + F.lit(burst)).where(F.col("n") > F.col("allowed")).select(key, "minute", "n", "allowed")
