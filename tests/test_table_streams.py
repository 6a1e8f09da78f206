import datetime

from textwarden.plans import queries


def _whole_and_split(frame, tmp_path, name):
    """The table once as one file and once as a folder of files."""
    frame.coalesce(1).write.parquet(str(tmp_path / "whole"))
    (part,) = (tmp_path / "whole").glob("part-*.parquet")
    (tmp_path / "one").mkdir()
    part.rename(tmp_path / "one" / f"{name}.parquet")
    frame.repartition(3).write.parquet(str(tmp_path / "many" / f"{name}.parquet"))
    return str(tmp_path / "one"), str(tmp_path / "many")


def test_table_streams_read_a_file_and_a_folder(spark, tmp_path):
    turns = spark.createDataFrame([(c, t, "assistant", f"fine {c} {t}") for c in range(4) for t in range(3)], "conv_id long, turn long, role string, text string")
    for folder in _whole_and_split(turns, tmp_path, "conversations"):
        for text in ("stream_guard", "stream_canary", "stream_vault"):
            assert queries.QUERIES[text](spark, folder).count() == (12 if text != "stream_canary" else queries.QUERIES["canary_chunks"](spark, folder).count())


def test_event_streams_read_a_folder(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [(n, start + datetime.timedelta(hours=n), n % 3, "click", 1.5, "{}") for n in range(30)],
        "event_id long, ts timestamp, user_id long, event_type string, value double, payload string",
    )
    one, many = (queries.QUERIES["stream_metrics"](spark, folder).orderBy("start_s").collect() for folder in _whole_and_split(events, tmp_path, "events"))
    assert one == many and sum(row["total"] for row in many) == 30
