"""Token buckets over request logs: which requests a rate limiter with one bucket per client lets through.

A bucket holds ``burst`` tokens at most and starts full. ``rate`` tokens come in a period, one at each tick of a clock that
starts at the epoch; a request takes a token or, where there is none, is refused and takes nothing. Levels are whole
numbers, so a refill by g and n requests are ``x -> max(min(x + g, burst) - n, 0)``, and any run of them comes to
``x -> min(high, max(low, x + shift))``. That makes the running level a composition of three numbers:

1. requests of one client and tick are counted before anything is shuffled;
2. ticks are dealt in blocks, and each block becomes one summary row;
3. the level at the start of each block follows from the summaries, one row for each block;
4. each block is walked from that level, and requests take the tokens of their tick in order.

A client behind a third of all requests is as many tasks as it has blocks. Every walk streams through sorted rows with a
few numbers of state, so neither a client nor a block is held in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden import fixed_values as fv
from textwarden.functions.digest import epoch_micros

BLOCK_TICKS = 4096
_BATCH = 16_384
_SUMMARY = pa.schema([("key", pa.string()), *[(name, pa.int64()) for name in ("block", "first", "last", "shift", "low", "high", "burst")]])
_CARRY = pa.schema([("key", pa.string()), ("block", pa.int64()), ("tick", pa.int64()), ("burst", pa.int64()), ("level", pa.int64())])
_LEVEL = pa.schema([("key", pa.string()), ("tick", pa.int64()), ("level", pa.int64())])


def client_key(*candidates: Column) -> Column:
    """The first of the candidates that says something, such as an identity's subject and then the client's address."""
    return F.coalesce(*[F.when(candidate != "", candidate) for candidate in candidates])


def _summaries(rows: Iterable[tuple]) -> Iterator[tuple]:
    now = None
    for key, block, tick, n, burst in rows:
        if (key, block) != now:
            if now is not None:
                yield *now, first, last, shift, low, high, size  # noqa: F821
            now, first, last, shift, low, high, size = (key, block), tick, tick, 0, 0, burst, burst
        gained = tick - last
        shift += gained - n
        low, high = (max(min(edge + gained, size) - n, 0) for edge in (low, high))
        last = tick
    if now is not None:
        yield *now, first, last, shift, low, high, size


def _carries(rows: Iterable[tuple]) -> Iterator[tuple]:
    now, level, before = object(), 0, 0
    for key, block, first, last, shift, low, high, burst in rows:
        level = burst if key != now else min(burst, level + first - before)
        yield key, block, first, burst, level
        now, before, level = key, last, min(high, max(low, level + shift))


def _levels(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Level before the requests of each tick. A block's carry comes first and has no requests."""
    level = last = 0
    for key, tick, n, burst, carried in rows:
        if carried is not None:
            level, last = carried, tick
            continue
        level, last = min(burst, level + tick - last), tick
        yield key, tick, level
        level = max(level - n, 0)


def _streamed(walk: Callable[[Iterable[tuple]], Iterator[tuple]], schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = walk(row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        while taken := list(islice(rows, _BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*taken), schema.types)], schema=schema)

    return work


def token_bucket(
    requests: DataFrame, key: Column, ts: str, order: str, rate: Column | int = fv.DEFAULT_RATE_PER_MINUTE,
    burst: Column | int = fv.DEFAULT_BURST, period_seconds: int = 60, block_ticks: int = BLOCK_TICKS,
) -> DataFrame:
    """Add ``admitted`` (a token was there) and ``tokens_left`` (after the request) to every request.

    ``rate`` and ``burst`` may differ by key, not within one; limits by route take the route into the key. NULL limits are the
    defaults, negative ones 0. Requests of one time take tokens in the order of ``order``. Requests without a
    key share one bucket; without a time they are in none and get NULL. Repeated rows are requests of their own.
    """
    kept = requests.columns

    def limit(value: Column | int, default: int) -> Column:
        return F.greatest(F.coalesce(value if isinstance(value, Column) else F.lit(value), F.lit(default)).cast("bigint"), F.lit(0))

    whole = F.lit(period_seconds * 1_000_000)
    micros = epoch_micros(F.col(ts))
    rest = F.pmod(micros, whole)
    div = lambda a, b: F.call_function("div", a, b)
    df = requests.withColumns({"_key": F.coalesce(key, F.lit("")), "_rate": limit(rate, fv.DEFAULT_RATE_PER_MINUTE), "_burst": limit(burst, fv.DEFAULT_BURST)})
    df = df.withColumn("_tick", div(micros - rest, whole) * F.col("_rate") + div(rest * F.col("_rate"), whole))

    ticks = df.where("_tick is not null").groupBy(F.col("_key").alias("key"), F.col("_tick").alias("tick")).agg(F.count("*").alias("n"), F.max("_burst").alias("burst"))
    ticks = ticks.select("key", div(F.col("tick") - F.pmod("tick", F.lit(block_ticks)), F.lit(block_ticks)).alias("block"), "tick", "n", "burst")
    blocks = ticks.repartition("key", "block").sortWithinPartitions("key", "block", "tick")
    summaries = blocks.mapInArrow(_streamed(_summaries, _SUMMARY), "key string, block long, first long, last long, shift long, low long, high long, burst long")
    starts = summaries.repartition("key").sortWithinPartitions("key", "block")
    carries = starts.mapInArrow(_streamed(_carries, _CARRY), "key string, block long, tick long, burst long, level long")
    marked = ticks.unionByName(carries, allowMissingColumns=True).repartition("key", "block")
    marked = marked.sortWithinPartitions("key", "block", "tick", F.col("level").asc_nulls_last()).select("key", "tick", "n", "burst", "level")
    levels = marked.mapInArrow(_streamed(_levels, _LEVEL), "key string, tick long, level long")

    found = df.join(levels.select(F.col("key").alias("_key"), F.col("tick").alias("_tick"), F.col("level").alias("_level")), ["_key", "_tick"], "left")
    place = F.row_number().over(Window.partitionBy("_key", "_tick").orderBy(ts, order))
    return found.withColumn("_place", place).select(
        *kept, (F.col("_place") <= F.col("_level")).alias("admitted"), F.greatest(F.col("_level") - F.col("_place"), F.when(F.col("_level").isNotNull(), F.lit(0))).alias("tokens_left")
    )
