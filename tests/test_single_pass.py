import pytest
from pyspark.sql import functions as F

from textwarden.functions import text as tx
from textwarden.operators import evaluation, routing
from textwarden.plans import queries
from textwarden.session import spread


def _plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_overall_scores_read_the_cases_once(spark):
    cases = spark.range(0, 40, 1, 2).select((F.col("id") % 4).alias("g"), (F.col("id") % 2 == 0).alias("a"), (F.col("id") % 3 == 0).alias("d"))
    overall = evaluation.score_overall(cases, "g", "a", "d")
    assert _plan(overall).count("Range (") == 1
    rows = {r["average"]: r for r in overall.collect()}
    cells = evaluation.with_scores(cases.agg(*evaluation._cell_counts(F.col("a"), F.col("d")))).first()
    by_group = evaluation.score_by_category(cases, "g", "a", "d").collect()
    assert (rows["micro"]["cases"], rows["macro"]["cases"]) == (40, 40)
    assert rows["micro"]["f1"] == pytest.approx(cells["f1"]) and rows["macro"]["f1"] == pytest.approx(sum(r["f1"] for r in by_group) / 4)
    empty = {r["average"]: r for r in evaluation.score_overall(cases.where("false"), "g", "a", "d").collect()}
    assert empty["micro"]["cases"] == 0 and empty["macro"]["cases"] is None and empty["macro"]["f1"] is None


def test_ratchets_scan_the_texts_once(spark, tmp_path):
    documents = spark.createDataFrame([(n, f"plain words {n}", "en" if n % 2 else "es", "s", 10) for n in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    documents.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    assert "RLIKE" not in _plan(queries.QUERIES["ratchet_cases"](spark, str(tmp_path)))


def test_replay_checks_only_requests_that_are_open(spark):
    log = spark.createDataFrame(
        [(1, "/none", {}, "", "b", "p", "r", 200, "ok")],
        "event_id long, path string, headers map<string,array<string>>, query string, body string, prompt string, response string, upstream_status int, body_status string",
    )
    keys = spark.createDataFrame([], "key_hash string, id string, tenant_id string, roles array<string>, rate_limit int")
    plan = _plan(routing.replay(log, (routing.Route("a", "/a", prompt_injection=True),), keys))
    assert "_asked" in plan and "_waf_body" in plan


def test_small_inputs_are_several_tasks_per_core(spark):
    assert spread(spark.range(0, 100, 1, 5)).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_guards_of_stages_lose_no_match(texts):
    cases = {
        "a|_b": "alb", "vv uu VV": "w w VV", "| alone": "| alone", "x3 11": "xe i", "İGNORE ıgnore": None, "ſYSTEM shhow": "system show",
        "aan FORGET bb": "aan forget bb",
    }
    rows = texts(*cases).select("text", tx.deleet(F.col("text")).alias("d"), tx.squeeze_keywords(F.col("text")).alias("s")).collect()
    got = {r["text"]: r for r in rows}
    assert [got[t]["d"] for t in list(cases)[:4]] == list(cases.values())[:4]
    assert got["İGNORE ıgnore"]["s"] == "ignore ignore"
    assert [got[t]["s"] for t in list(cases)[5:]] == list(cases.values())[5:]
