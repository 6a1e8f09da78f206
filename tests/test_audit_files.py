from pyspark.sql import functions as F

from textwarden.operators import audit, audit_lines
from textwarden.sources import audit_log

ORDER = ["ts_ns", "event_id"]


def events(spark, rows):
    """(event_id, chain) with the other audit columns made of them."""
    df = spark.createDataFrame(rows, "event_id long, chain_id string")
    text = F.concat(F.lit('say "é" \\ '), F.col("event_id").cast("string"))
    return df.select(
        "event_id", "chain_id", (F.col("event_id") * 1_000_000_007).alias("ts_ns"), F.concat(F.lit("t-"), F.col("event_id").cast("string")).alias("trace_id"),
        F.when(F.col("event_id") % 3 > 0, text).alias("client_id"), F.lit("10.0.0.1").alias("client_ip"), text.alias("route"), F.lit("ALLOWED").alias("action"),
        F.lit("NONE").alias("threat_category"), F.lit("LOW").alias("severity"), (F.col("event_id") / 7).alias("confidence"),
        F.when(F.col("event_id") % 2 == 0, text).otherwise("").alias("reason"), F.lit("").alias("matched_rule"),
    ).repartition(3)


def lines_of(df):
    return sorted((r.chain_id, r.line_no, r.value) for r in df.collect())


def test_one_pass_writes_what_building_and_marking_write(spark):
    rows = [(i, f"c{i % 3}") for i in range(50)] + [(100, "single")]
    df = events(spark, rows)
    built = audit.build_chains(df, ORDER)
    want = audit_log.record_lines(built).unionByName(audit_log.checkpoint_lines(audit.checkpoints(built, interval=4)))
    got = audit_lines.link_lines(df, ORDER, interval=4)
    assert lines_of(got) == lines_of(want)
    assert audit_lines.link_lines(df.where("false"), ORDER).count() == 0
    verdicts = audit.verify_chains(audit_log.parse_lines(got)).collect()
    assert len(verdicts) == 4 and all(r.valid for r in verdicts) and sum(r.total_records for r in verdicts) == 51


def test_appending_goes_on_from_the_files(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(i, f"c{i % 3}") for i in range(60)]
    audit_log.write_log(audit_lines.link_lines(events(spark, rows[:20]), ORDER, interval=4), path, 0)
    audit_lines.append_log(spark, events(spark, rows[20:21] + [(200, "new")]), ORDER, path, interval=4)
    audit_lines.append_log(spark, events(spark, rows[21:60]), ORDER, path, interval=4)
    parsed = audit_log.parse_lines(audit_log.read_log(spark, path))
    verdicts = {r.chain_id: r for r in audit.verify_chains(parsed, block_rows=1 << 20).collect()}
    assert {c: r.total_records for c, r in verdicts.items()} == {"c0": 20, "c1": 20, "c2": 20, "new": 1} and all(r.valid for r in verdicts.values())
    whole = audit.chain_tips(audit.build_chains(events(spark, [*rows, (200, "new")]), ORDER))
    assert sorted(map(tuple, audit_log.recover_tips(parsed).collect())) == sorted(map(tuple, whole.collect()))


def test_changed_files_are_found(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(i, f"c{i % 2}") for i in range(30)]
    lines = audit_lines.link_lines(events(spark, rows), ORDER, interval=4)
    changed = lines.withColumn("value", F.when(F.contains("value", F.lit('"trace_id":"t-7"')), F.replace("value", F.lit("ALLOWED"), F.lit("BLOCKED"))).otherwise(F.col("value")))
    audit_log.write_log(changed, path, 0)
    audit_lines.append_log(spark, events(spark, [(50, "c1")]), ORDER, path)
    verdicts = {r.chain_id: r for r in audit.verify_chains(audit_log.parse_lines(audit_log.read_log(spark, path))).collect()}
    assert verdicts["c0"].valid and not verdicts["c1"].valid and verdicts["c1"].broken_at_index == 3
    assert verdicts["c1"].reason.startswith("payload tampering")
