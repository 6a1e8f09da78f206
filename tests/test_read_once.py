from datetime import datetime, timedelta

from textwarden.operators import routing, vault
from textwarden.plans import queries


def _plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_addresses_are_parsed_once(spark):
    log = spark.createDataFrame([(1, "10.0.0.9:1", "fd00:1::7, 198.51.100.2"), (None, "[fd00:1::5]:443", "203.0.113.1"), (3, None, None)], "id long, remote string, forwarded string")
    found = routing.client_ip_by_table(log, "id", "remote", "forwarded", spark.createDataFrame([("10.0.0.0/24",), ("fd00:1::/32",)], "network string"))
    assert "Python" not in _plan(found) and "_ipv6" not in _plan(found)
    assert {(r["id"], r["client_ip"]) for r in found.collect()} == {(1, "198.51.100.2"), (None, "[fd00:1::5]:443"), (3, None)}


def test_values_are_looked_for_once(spark):
    turns = spark.createDataFrame([(1, 0, "ring 089-555-0101"), (1, 1, "089-555-0101 or kay@mail.example.org"), (2, 0, None)], "conv_id long, turn long, text string")
    masked, entries = vault.mask_reversibly(turns)
    assert "regexp_extract_all" not in _plan(masked) and "regexp_extract_all" not in _plan(entries)
    assert [r["masked"] for r in masked.orderBy("conv_id", "turn").collect()] == ["ring <PHONE_1>", "<PHONE_1> or <EMAIL_1>", ""]


def test_truncated_logs_are_hashed_once(spark, tmp_path):
    rows = [(n, datetime(2024, 1, 1) + timedelta(hours=n), n % 5, "click", float(n)) for n in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    verdicts = queries.QUERIES["audit_truncated"](spark, str(tmp_path))
    assert "MapInPandas" not in _plan(verdicts)
    assert {(r["mode"], r["valid"]) for r in verdicts.collect()} >= {("strict", False), ("lenient", True)}
