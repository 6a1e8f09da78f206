import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textwarden.operators import buckets

START = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def simulated(rows, rate, burst, period):
    """One request after another: (id, admitted, tokens left)."""
    levels, clock, out = {}, {}, []
    for number, key, at in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        key = key or ""
        micros = (at - START) // dt.timedelta(microseconds=1)
        tick = micros * rate // (period * 1_000_000)
        level = burst if key not in levels else min(burst, levels[key] + tick - clock[key])
        out.append((number, level > 0, max(level - 1, 0)))
        levels[key], clock[key] = max(level - 1, 0), tick
    return sorted(out + [(r[0], None, None) for r in rows if r[2] is None])


@pytest.mark.parametrize("rate,burst,block", [(7, 3, 4), (60, 1, 4096), (1, 10, 2), (600, 0, 8)])
def test_buckets_equal_one_request_after_another(spark, rate, burst, block):
    rng = random.Random(rate)
    day = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
    rows = [(i, rng.choice(["hot"] * 5 + ["a", "b", None]), day + dt.timedelta(seconds=rng.randrange(1200), microseconds=rng.randrange(3))) for i in range(600)]
    rows += [(600 + i, "hot", day + dt.timedelta(seconds=77)) for i in range(20)]  # many at one time
    rows += [(700, "old", dt.datetime(1969, 12, 31, 23, 59, 58, tzinfo=dt.timezone.utc)), (701, "old", START), (702, "hot", None)]
    df = spark.createDataFrame(rows, "id long, client string, at timestamp").withColumn("level", F.lit("kept"))
    judged = buckets.token_bucket(df, F.col("client"), "at", "id", rate, burst, block_ticks=block)
    assert judged.columns == ["id", "client", "at", "level", "admitted", "tokens_left"]
    got = sorted((r.id, r.admitted, r.tokens_left) for r in judged.collect())
    assert got == simulated(rows, rate, burst, 60)


def test_buckets_take_limits_by_key_and_an_empty_log(spark):
    at = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
    rows = [(i, "ab"[i % 2], at) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, client string, at timestamp")
    burst = F.when(F.col("client") == "a", 4).otherwise(2)
    admitted = defaultdict(int)
    for r in buckets.token_bucket(df, F.col("client"), "at", "id", 60, burst).where("admitted").collect():
        admitted[r.client] += 1
    assert admitted == {"a": 4, "b": 2}
    assert buckets.token_bucket(df.limit(0), F.col("client"), "at", "id").count() == 0


def test_clients_fall_back_to_their_address(spark):
    df = spark.createDataFrame([("u", "1.2.3.4"), (None, "1.2.3.4"), ("", "5.6.7.8"), (None, None)], "subject string, ip string")
    assert [r[0] for r in df.select(buckets.client_key(F.col("subject"), F.col("ip"))).collect()] == ["u", "1.2.3.4", "5.6.7.8", None]
