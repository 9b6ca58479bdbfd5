"""Verification records, failures against all sources, second attempts, responses; figures of traces and evaluations."""

import datetime as dt

import pytest
from paperloom.operators import retrieval, traces, verify
from paperloom.plans import answer
from pyspark.sql import functions as F

ANSWERS = [
    (1, "g", "제1조에 따라 100만원을 지급한다. 이 경우 처리합니다. 기한은 30일이다."), (2, "g", "제2조에 따라 처리한다."), (3, "g", "제9조에 따라 처리한다."), (4, "g", "130만원을 지급한다."), (5, "g", "5만원을 지급한다."),
    (6, "g", "7회 검토한다."), (7, "g", ""), (8, "g", None), (9, None, "제1조에 따른다."), (10, "g", "별표 3과 제1조 제2항을 본다."), (11, "g", "3년 안에"),
]
SOURCES = [(1, "g", "제1조 보험금은 100만원이다."), (2, "g", "기한은 30일로 한다."), (3, "h", "제2조"), (4, "g", None), (5, "g", "")]


@pytest.fixture
def tables(spark):
    answers = spark.createDataFrame(ANSWERS, "id long, grp string, content string")
    sources = spark.createDataFrame(SOURCES, "id long, grp string, content string")
    return answers, sources, verify.unsupported(answers, sources, ["grp"], "id", "id")


def test_records(tables):
    answers, sources, wrong = tables
    by = {r["answer_id"]: r for r in verify.records(answers, wrong, sources, ["grp"], "id", "id").collect()}
    assert len(by) == len(ANSWERS)
    one = by[1]
    assert (one["risk_level"], one["claims_count"], one["verifiable_claims_count"], one["supported_claims_count"], one["groundedness"], one["warnings"]) == ("pass", 3, 2, 1, 0.5, [])
    assert [by[i]["risk_level"] for i in (2, 4, 6, 7, 8, 9)] == ["hard_fail", "soft_fail", "warn", "pass", "pass", "hard_fail"]
    assert by[7]["claims_count"] == 0 and by[8]["groundedness"] is None
    assert by[10]["warnings"] == [verify.WARNINGS[0] + "제1조 제2항", verify.WARNINGS[1] + "별표 3"] and by[4]["warnings"] == [verify.WARNINGS[2] + "130만원"]


def test_failures(tables):
    answers, sources, wrong = tables
    near = verify.near_facts(answers, wrong, sources, ["grp"], "id", "id")
    rows = verify.verdicts(answers, wrong, "id").join(near, "answer_id")
    kind = lambda judge=None: {r["answer_id"]: r["k"] for r in rows.select("answer_id", verify.failure_of(F.size("missing_references"), F.col("near_reference"), F.col("near_number"), judge).alias("k")).collect()}
    got = kind()
    assert {i: got[i] for i in (2, 3, 4, 5, 6, 9, 10, 11)} == {2: "generation_error", 3: "retrieval_gap", 4: "unit_error", 5: "minor", 6: "minor", 9: "retrieval_gap", 10: "generation_error", 11: "minor"}
    judged = kind(F.col("answer_id") == 5)
    assert judged[5] == "semantic_mismatch" and judged[6] == "minor" and judged[2] == "generation_error"


def test_failures_against_a_loop(spark):
    numbers = [1, 2, 3, 5, 7, 9.5, 10, 15, 19.9, 20, 30, 39, 41, 80, 1000, 100_000]
    answers = spark.createDataFrame([(i, "g", f"{n * 10:.0f}일") for i, n in enumerate(numbers)], "id long, grp string, content string")
    sources = spark.createDataFrame([(1, "g", "200일과 9999원"), (2, "g", "70일")], "id long, grp string, content string")
    wrong = verify.unsupported(answers, sources, ["grp"], "id", "id")
    got = {r["answer_id"] for r in verify.near_facts(answers, wrong, sources, ["grp"], "id", "id").where("near_number").collect()}
    expect = {i for i, n in enumerate(numbers) if (v := float(f"{n * 10:.0f}")) not in (200, 70) and any(abs(v - k) < 0.5 * max(v, k) for k in (200, 70))}
    assert got == expect and expect


def test_own_source_does_not_count(spark):
    answers = spark.createDataFrame([(1, 5, "g", "제4조에 따른다")], "id long, own long, grp string, content string")
    sources = spark.createDataFrame([(5, "g", "제4조 제5조"), (6, "g", "제7조")], "id long, grp string, content string")
    wrong = verify.unsupported(answers, sources, ["grp"], "id", "id", own="own")
    assert not verify.near_facts(answers, wrong, sources, ["grp"], "id", "id", own="own").first()["near_reference"]
    more = sources.unionByName(spark.createDataFrame([(7, "g", "제5조")], sources.schema))
    assert verify.near_facts(answers, wrong, more, ["grp"], "id", "id", own="own").first()["near_reference"]


def test_second_attempt_and_responses(spark, tables):
    rows = [(1, "hard_fail", "generation_error"), (2, "soft_fail", "unit_error"), (3, "hard_fail", "retrieval_gap"), (4, "soft_fail", "minor"), (5, "warn", "minor"), (6, "pass", None), (7, "soft_fail", "semantic_mismatch")]
    answers = spark.createDataFrame([(i, "q", "c", "확인되지 않음" if i == 6 else "a", r, f, "h") for i, r, f in rows], "query_id long, query string, context string, answer string, risk_level string, failure_type string, hint string")
    seen = answer.second_attempt(answers, lambda q, c, h: F.concat(q, c, h), lambda df: df.select("query_id", F.when(F.col("query_id") == 1, "pass").otherwise("hard_fail").alias("risk_level")))
    by = {r["query_id"]: r for r in seen.collect()}
    assert [by[i]["action_taken"] for i in range(1, 8)] == ["regenerate", "regenerate", "escalate", "pass", None, None, "escalate"]
    assert (by[1]["answer"], by[1]["improved"], by[1]["before_risk"], by[1]["risk_level"]) == ("qch", True, "hard_fail", "pass") and by[2]["improved"] is False and by[3]["answer"] == "a" and not by[5]["invoked"]
    chunks = spark.createDataFrame([(7, "d", "s", 1, 2, "text", "body", ["p.png"]), (8, "d", "s", None, None, "text", "b", [])], "id long, document_id string, service_code string, start_page int, end_page int, chunk_type string, content string, image_paths array<string>")
    hits = spark.createDataFrame([(1, 8, 0.123456, 2), (1, 7, 0.9, 1)], "query_id long, row_id long, score double, rank int")
    sources = retrieval.source_rows(hits, chunks, hits)
    first = sources.where("rank = 1").first()
    assert first["chunk_id"] == "7" and first["image_paths"] == ["p.png"] and sources.where("rank = 2").first()["image_paths"] is None and sources.where("rank = 2").first()["rerank_score"] == 0.1235
    claims = spark.createDataFrame([(1, 1, "둘", [9]), (1, 0, "하나", [7, 8]), (1, 2, "셋", [])], "answer_id long, claim_no int, claim string, source_ids array<long>")
    cited = verify.citations(claims)
    assert [c["claim"] for c in cited.first()["citations"]] == ["하나", "둘"]
    records = spark.createDataFrame([(i, 0.5, ["w"] if i == 2 else []) for i in range(1, 8)], "answer_id long, groundedness double, warnings array<string>")
    out = {r["query_id"]: r for r in answer.responses(seen, sources, cited, records).collect()}
    assert [s["chunk_id"] for s in out[1]["sources"]] == ["7", "8"] and out[1]["verification"] is None and out[2]["verification"]["warnings"] == ["w"] and out[3]["escalation_required"] and out[3]["verification"]["risk_level"] == "hard_fail"
    assert out[6]["is_refusal"] and not out[1]["is_refusal"] and out[6]["citations"] is None


def test_critic_effect_and_coverage(spark):
    schema = "critic struct<invoked:boolean,action_taken:string,before_risk:string,after_risk:string,regenerate_improved:boolean>, verification struct<claims_count:int,verifiable_claims_count:int,supported_claims_count:int>"
    rows = [((True, "regenerate", "hard_fail", "pass", True), (4, 2, 1)), ((True, "regenerate", "hard_fail", "pass", True), (2, None, None)), ((True, "regenerate", "soft_fail", "soft_fail", False), (0, 5, 5)), ((True, "pass", "soft_fail", "soft_fail", None), None), ((True, "pass", None, None, None), (3, 2, 2)), ((False, None, None, None, None), None), (None, None)]
    df = spark.createDataFrame(rows, schema)
    got = {tuple(r) for r in traces.critic_effect(df).collect()}
    assert got == {("regenerate", "hard_fail", "pass", 2, 2), ("regenerate", "soft_fail", "soft_fail", 1, 0), ("pass", "soft_fail", None, 1, 0)}
    assert tuple(traces.claim_coverage(df).first()) == (3, 3.0, 75.0)
    assert tuple(traces.claim_coverage(df.limit(0)).first()) == (0, None, None)


def test_evaluation_and_durations(spark):
    rows = [(i, f"q{i}", 100.0 * i, "확인되지 않음" if i == 3 else "a", "x" if i < 8 else None, "y" if i % 2 else "x", i % 3) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "question_no int, question string, elapsed_ms double, answer string, expected_type string, predicted_type string, crag_retries int")
    r = traces.evaluation_stats(df).first()
    assert (r["questions"], r["mean_ms"], r["least_ms"], r["most_ms"], r["labelled"], r["right"], r["retried"], r["unanswered"]) == (10, 550.0, 100.0, 1000.0, 7, 3, 7, 1) and r["accuracy"] == 0.429
    assert [w["question_no"] for w in r["wrong"]] == [1, 3, 5, 7]
    log = spark.createDataFrame([("a", "new", dt.datetime(2025, 3, 1, 0, 0)), ("a", "done", dt.datetime(2025, 3, 1, 0, 1, 30)), ("b", "new", dt.datetime(2025, 3, 1))], "document_id string, status_code string, created_at timestamp_ntz")
    assert {(x["document_id"], x["status"], x["seconds"]) for x in traces.status_durations(log, ["document_id"]).collect()} == {("a", "new", 90.0), ("a", "done", None), ("b", "new", None)}


def test_toc_titles(spark):
    from paperloom.functions import layout

    titles = {"목 차": True, "Table of  Contents": True, "CONTENTS": True, "약관 가이드 ····15": True, "하나 · 둘 · 셋 · 12": True, "이용 … … 3": True, "하나 · 둘": False, "본문": False, None: False, "목차의 뜻": False}
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", layout.is_toc_title(F.col("t")).alias("x")).collect()} == titles
