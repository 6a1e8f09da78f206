import hashlib
import json

import pytest
from pyspark.sql import functions as F

from textwarden import fixed_values as fv
from textwarden.functions.digest import nanos_rfc3339, rfc3339_nanos
from textwarden.operators import audit
from textwarden.operators.sequence import with_preceding
from textwarden.sources import audit_log

NAMES = "event_id bigint, chain_id string, ts_ns bigint, trace_id string, client_id string, client_ip string, route string, action string, threat_category string, severity string, confidence double, reason string, matched_rule string"


def events(spark, n=5, chain="a"):
    rows = [(i, chain, 1_700_000_000_123_456_700 + i, f"t{i}", "c" if i % 2 else "", "1.1.1.1", "/v1", "ALLOWED", "NONE", "LOW", 0.95, "", "") for i in range(n)]
    return spark.createDataFrame(rows, NAMES)


def lines(spark, n=5):
    return audit_log.log_lines(audit.build_chains(events(spark, n), ["ts_ns"]))


def verdict(df, strict=True, block=65_536):
    (row,) = audit.verify_chains(audit_log.parse_lines(df), strict, block).collect()
    return row["valid"], row["total_records"], row["broken_at_index"], row["reason"]


def test_hash_follows_the_payload_format(spark):
    row = audit.build_chains(events(spark, 1), ["ts_ns"]).first()
    payload = f"prev:{fv.GENESIS_HASH}|ts:1700000000123456700|trace:t0|client:|ip:1.1.1.1|route:/v1|act:ALLOWED|threat:NONE|sev:LOW|conf:0.9500|reason:|rule:|checkpoint_version:1"
    assert row["record_hash"] == hashlib.sha256(payload.encode()).hexdigest()


@pytest.mark.parametrize("block", [2, 8, 65_536])
def test_verification(spark, block):
    good = lines(spark)
    assert verdict(good, block=block) == (True, 5, None, None)
    tampered = good.withColumn("value", F.when(F.contains("value", F.lit('"t2"')), F.replace("value", F.lit("ALLOWED"), F.lit("BLOCKED"))).otherwise(F.col("value")))
    valid, total, broken, reason = verdict(tampered, block=block)
    assert (valid, total, broken) == (False, 2, 2) and reason.startswith("payload tampering at record 2")
    valid, _, broken, reason = verdict(good.where(~F.contains("value", F.lit('"t2"'))), block=block)
    assert (valid, broken) == (False, 2) and reason.startswith("hash link mismatch at record 2")
    cut = good.where("line_no < 16")
    assert verdict(cut, block=block) == (False, 3, 3, "missing terminal audit checkpoint")
    assert verdict(cut, strict=False, block=block) == (True, 3, None, None)
    corrupt = good.withColumn("value", F.when(F.contains("value", F.lit('"t3"')), F.lit("{broken")).otherwise(F.col("value")))
    assert verdict(corrupt, block=block)[1:3] == (3, 3)
    forged = good.withColumn("value", F.when(F.contains("value", F.lit("CHECKPOINT")), F.replace("value", F.lit('"record_count":5'), F.lit('"record_count":6'))).otherwise(F.col("value")))
    assert verdict(forged, block=block)[3] == "invalid audit checkpoint commitment"


def test_legacy_log_needs_no_checkpoint(spark):
    payload = f"prev:{fv.GENESIS_HASH}|ts:1700000000000000000|trace:x|client:|ip:|route:/v1|act:ALLOWED|threat:NONE|sev:LOW|conf:0.0000|reason:|rule:"
    record = {"timestamp": "2023-11-14T22:13:20Z", "trace_id": "x", "client_ip": "", "route": "/v1", "action": "ALLOWED", "threat_category": "NONE", "severity": "LOW", "confidence": 0, "prev_record_hash": fv.GENESIS_HASH, "record_hash": hashlib.sha256(payload.encode()).hexdigest()}
    df = spark.createDataFrame([("a", 1, json.dumps(record))], "chain_id string, line_no bigint, value string")
    assert verdict(df) == (True, 1, None, None)


def test_interval_checkpoints_and_round_trip(spark, tmp_path):
    chains = audit.build_chains(events(spark, 2050), ["ts_ns"])
    marks = audit.checkpoints(chains).orderBy("record_count", "closing").collect()
    assert [(m["record_count"], m["closing"]) for m in marks] == [(1024, 0), (2048, 0), (2050, 1)]
    path = str(tmp_path / "log")
    audit_log.write_log(audit_log.log_lines(chains), path)
    read = audit_log.read_log(spark, path)
    assert verdict(read.select("chain_id", "line_no", "value"), block=100) == (True, 2050, None, None)
    tip = audit_log.recover_tips(audit_log.parse_lines(read)).first()
    assert (tip["tip_hash"], tip["record_count"]) == (marks[-1]["tip_hash"], 2050)


def test_nanoseconds(spark):
    stamps = {"2024-01-01T00:00:00.123456789Z": 1704067200123456789, "2024-01-01T07:00:00+07:00": 1704067200000000000, "2024-02-29T12:30:45.5-01:30": 1709215245500000000}
    df = spark.createDataFrame([(s,) for s in stamps], "s string").withColumn("n", rfc3339_nanos(F.col("s")))
    assert {r["s"]: r["n"] for r in df.collect()} == stamps
    assert df.withColumn("n", F.col("n")).select(nanos_rfc3339(F.col("n")).alias("o")).first()["o"] == "2024-01-01T00:00:00.123456789Z"


def test_blocks_give_the_plain_running_state(spark):
    df = spark.range(500).select(F.lit("s").alias("k"), (F.col("id") * 3).alias("n"), (F.col("id") % 7 == 0).alias("f"), F.col("id").cast("string").alias("v"))
    small = with_preceding(df, "k", "n", F.col("f"), F.col("v"), 10).select("n", "n_before", "last_before").collect()
    large = with_preceding(df, "k", "n", F.col("f"), F.col("v"), 10_000).select("n", "n_before", "last_before").collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, large))
