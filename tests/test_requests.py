"""Requests: a body is parsed once, whatever looks at it, and a small file of them isn't one task."""

import pytest
from pyspark.sql import functions as F

from quorumlens.functions.scalar import blank, js_trim
from quorumlens.operators import requests
from quorumlens.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("make", [requests.validate, lambda r: requests.analyses(r, "2026-01-01 00:00:00"), lambda r: requests.handles(r.where(requests.problem().isNull()))])
def test_a_body_is_parsed_once(spark, make):
    bodies = spark.createDataFrame([(1, "{}")], "request_id long, body string")
    plan = make(requests.parse(bodies))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") + plan.count("jsontostructs") == 1


def test_blank_is_what_trimming_leaves_empty(spark):
    texts = ["", " ", "\n", "a\n", "  ﻿", " x ", "\r\n\t\x0b", "\n\na", "​", None]
    rows = spark.createDataFrame([(x,) for x in texts], "s string").select("s", blank(F.col("s")).alias("b"), F.coalesce(js_trim(F.col("s")) == "", F.lit(True)).alias("want")).collect()
    assert [r["b"] for r in rows] == [r["want"] for r in rows] and {r["b"] for r in rows} == {True, False}


@pytest.mark.parametrize("name", ["snk1_new_analyses", "snk2_new_accounts", "flt14_request_validation"])
def test_requests_of_one_file_are_dealt_out(spark, name):
    assert plans.QUERIES[name](spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
