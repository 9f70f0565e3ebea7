"""Model stages: every post answered once whatever fails, answers checked, reports and insights through one plug-in."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumlens.operators import classify, synthesis
from quorumlens.operators.buckets import Buckets

POSTS = "account_id string, post_id long, caption string, coauthor_handle string"


@pytest.fixture
def answers(spark, tmp_path):
    return Buckets(spark, str(tmp_path / "answers"), T.StructType.fromDDL(classify.ANSWER), ["post_id"], 4)


def good(x, **other):
    return {"post_id": x["id"], "category": "product", "confidence": 1, "rationale": x["caption"], **other}


def test_every_third_call_fails_and_every_post_is_answered_once(spark, tmp_path, answers):
    posts = spark.createDataFrame([(f"a{i % 3}", i, None if i % 7 == 0 else f"c{i}", None) for i in range(300)] + [("a0", 0, "again", None), (None, 900, "c", None), ("a1", None, "c", None)], POSTS)
    log = tmp_path / "calls"

    def model(sent):
        with open(log, "a") as f:  # calls of all workers
            f.write(f"{len(sent)} {','.join(x['id'] for x in sent)}\n")
        if len(log.read_text().splitlines()) % 3 == 0:
            raise ConnectionError("third call")
        return [good(x) for x in sent]

    assert classify.answer_all(posts, model, answers, rounds=20) == 0
    rows = answers.read().collect()
    assert sorted(int(r["post_id"]) for r in rows) == [*range(300), 900]
    calls = [line.split() for line in log.read_text().splitlines()]
    assert max(int(n) for n, _ in calls) == 40 and len(calls) > 9
    # a later run asks for what is new only
    more = posts.unionByName(spark.createDataFrame([("a9", 1000, "new", None)], POSTS))
    os.unlink(log)
    log.write_text("")
    assert classify.answer_all(more, model, answers, rounds=20) == 0
    assert log.read_text().splitlines() == ["1 1000"] and answers.read().count() == 302


def test_answers_outside_the_contract_are_asked_again_and_left_in_the_end(spark, answers):
    posts = spark.createDataFrame([("a", i, "c", "co") for i in range(8)], POSTS)
    bad = {"1": {"category": "nice"}, "2": {"confidence": 1.5}, "3": {"confidence": True}, "4": {"rationale": None}, "5": {"post_id": "99"}}

    def model(sent):
        return [good(x, **bad.get(x["id"], {})) for x in sent if x["id"] != "6"] + ["no answer", good({"id": "0", "caption": "twice"}, category="other")]

    rows = {r["post_id"]: (r["category"], r["problem"]) for r in classify.asked(posts, model).collect()}
    assert rows == {"0": ("product", None), "7": ("product", None), "1": (None, "no such category"), "2": (None, "confidence out of range"), "3": (None, "confidence out of range"), "4": (None, "no rationale"), "5": (None, "passed over"), "6": (None, "passed over")}
    assert classify.answer_all(posts, model, answers, rounds=2) == 6
    assert sorted(r["post_id"] for r in answers.read().collect()) == ["0", "7"]
    assert classify.answer_all(posts, lambda sent: [good(x, category="other") for x in sent], answers) == 0
    assert {r["post_id"]: r["category"] for r in answers.read().collect()} == {str(i): "product" if i in (0, 7) else "other" for i in range(8)}


def test_nothing_to_ask(spark, answers):
    assert classify.answer_all(spark.createDataFrame([], POSTS), lambda sent: 1 / 0, answers) == 0 and answers.read().count() == 0


def test_large_accounts_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(classify, "NUMBERED", 200)
    posts = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("few").alias("account_id"), F.col("id").alias("post_id"))
    chunks = classify.chunked(posts).groupBy("account_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("post_id")).collect()
    assert sum(r["n"] for r in chunks) == 1000 and max(r["n"] for r in chunks) <= 40
    assert sorted((r["chunk"], r["n"]) for r in chunks if r["account_id"] == "few") == [(0, 40), (1, 40), (2, 20)]


METRICS = "analysis_id int, platform string, company string, handle string, followers long, engagement_rate double, posts_per_week double, low_sample_warning string"


def metrics(spark):
    return spark.createDataFrame([(1, "p", "Co", "b", 1234567, 0.0123, 2.5, None), (1, "p", "Co", "a", 10, 0.5, 7.0, "low"), (1, "q", "Co", "c", 0, 0.0, 0.0, None)], METRICS)


def test_documents_hold_every_metric(spark):
    docs = {r["platform"]: json.loads(r["document"]) for r in synthesis.documents(metrics(spark), context=["company"]).collect()}
    assert docs["p"]["company"] == "Co" and [a["handle"] for a in docs["p"]["accounts"]] == ["a", "b"]
    assert docs["q"]["accounts"] == [{"handle": "c", "followers": 0, "engagement_rate": 0.0, "posts_per_week": 0.0, "low_sample_warning": None}]


def test_the_rules_through_the_stage_are_the_rules(spark):
    rows = metrics(spark).drop("company")
    found = synthesis.accepted(synthesis.produced(synthesis.documents(rows), synthesis.insights_by_rule, synthesis.SIZES))
    want = synthesis.platform_insights(rows)
    assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("change, problem", [
    (lambda a: a, None), (lambda a: [a], "not an object"), (lambda a: {**a, "explanations": "x"}, "explanations: not a list"), (lambda a: {**a, "explanations": ["x", " "]}, "explanations: not all texts"),
    (lambda a: {**a, "explanations": ["x", 1]}, "explanations: not all texts"), (lambda a: {**a, "explanations": ["x"]}, "explanations: 1 entries, 2 to 5 asked for"), (lambda a: {**a, "more": 1}, None), (lambda a: a["none"], "KeyError: 'none'"),
])
def test_answers_are_checked(spark, change, problem):
    def model(document):
        return change(synthesis.insights_by_rule(document))

    rows = synthesis.produced(synthesis.documents(metrics(spark).drop("company")), model, synthesis.SIZES).collect()
    assert len(rows) == 2 and {r["problem"] for r in rows} == {problem} and all((r["explanations"] is None) == (problem is not None) for r in rows)


def test_a_second_call_may_mend_the_first(spark, tmp_path):
    seen = tmp_path / "seen"

    def model(document):
        key = f"{seen}-{document['platform']}"
        if not os.path.exists(key):
            open(key, "w").close()
            raise TimeoutError
        return synthesis.insights_by_rule(document)

    rows = synthesis.produced(synthesis.documents(metrics(spark)), model, synthesis.SIZES)
    assert synthesis.rejected(rows).count() == 0


def test_reports_with_a_plan(spark):
    phase = {"actions": ["do"], "success_metrics": ["measure", "again"]}
    report = {**{n: ["x"] * low for n, (low, _) in synthesis.REPORT_SIZES.items()}, "plan": {"day30": phase, "day60": phase, "day90": phase}}
    docs = synthesis.documents(metrics(spark), by=["analysis_id"], context=["company"])
    row = synthesis.accepted(synthesis.produced(docs, lambda d: report, synthesis.FULL_REPORT)).first()
    assert row["plan_day60_success_metrics"] == ["measure", "again"] and row["key_findings"] == ["x"] * 3
    short = synthesis.produced(docs, lambda d: {**report, "plan": {"day30": phase, "day60": phase}}, synthesis.FULL_REPORT)
    assert [r["problem"] for r in synthesis.rejected(short, ["analysis_id"]).collect()] == ["plan.day90.actions: not a list"]
