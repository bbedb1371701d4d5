"""Scalar rules on edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from siftwise.functions import confidence, parsing, prompts


def applied(spark, rule, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw string")
    return [r["out"] for r in df.select("i", rule(F.col("raw")).alias("out")).orderBy("i").collect()]


def test_parse_yes_no(spark):
    got = applied(spark, parsing.parse_yes_no, ["", "  Yes.", "no\nyes", "Well, yes", "Nothing", "maybe", "It is no.", None])
    assert got == ["UNKNOWN", "Yes", "No", "Yes", "No", "UNKNOWN", "No", "UNKNOWN"]


def test_parse_3way(spark):
    got = applied(spark, parsing.parse_3way, ["True", "FALSE.", "unsure", "I think true", "Uncertain", None, "\ntrue"])
    assert got == ["Yes", "No", "Unsure", "Yes", "UNKNOWN", "UNKNOWN", "Yes"]


def test_parse_zero_shot(spark):
    got = applied(spark, parsing.parse_zero_shot, ["reason\nYes.", "yes because", "Answer: No", "none", "", None])
    assert got == ["Yes", "Yes", "No", "No", "PARSE_FAIL", "PARSE_FAIL"]


def test_json_field(spark):
    rule = lambda c: parsing.json_field(c, "lesson")
    got = applied(spark, rule, ['{"lesson": "a"}', 'so {"lesson": " b "} then', '```json\n{"lesson": "c"}\n```', '```json\n{"lesson": "d"}', "{}", "[1]", None])
    assert got == ["a", "b", "c", "d", None, None, None]


def scanned(spark, content):
    schema = "content array<struct<token string, logprob double, top array<struct<token string, logprob double>>>>"
    return spark.createDataFrame([(content,)], schema).select(confidence.scan(F.col("content")).alias("x")).first()["x"]


def test_scan(spark):
    first = scanned(spark, [("True", -0.1, [("True", -0.1), ("False", -2.0), ("uns", -3.0)])])
    assert (first["yes"], first["no"], first["unsure"]) == (-0.1, -2.0, -3.0)
    later = scanned(spark, [("Hm", -0.1, []), ("x", -0.2, [(" false", -1.0), ("False", -0.5)])])
    assert (later["yes"], later["no"], later["unsure"]) == (-100.0, -0.5, -100.0)
    assert scanned(spark, [("Hm", -0.1, [])]) is None


def features(spark, yes, no, unsure, verdict="Yes"):
    df = spark.createDataFrame([(yes, no, unsure)], "y double, n double, u double")
    return df.select(confidence.features_3way(F.col("y"), F.col("n"), F.col("u"), F.lit(verdict)).alias("f")).first()["f"]


def test_features_3way(spark):
    tie = features(spark, -1.0, -1.0, -5.0)
    assert tie["prediction"] == "Yes" and tie["margin"] == 0 and tie["entropy_2way"] == pytest.approx(math.log(2))
    assert features(spark, -5.0, -1.0, -1.0)["prediction"] == "No"
    alone = features(spark, None, None, None, "Unsure")
    assert (alone["prediction"], alone["confidence"], alone["p_unsure"], alone["entropy_3way"]) == ("Unsure", 1.0, 1.0, pytest.approx(math.log(3)))
    sure = features(spark, -0.1, None, None)
    assert sure["p_yes"] == 1 and sure["entropy_3way"] == 0


def test_features_2way_and_collector(spark):
    df = spark.createDataFrame([(-0.5, -1.5), (None, None), (-0.2, None)], "y double, n double")
    two = [r["f"] for r in df.select(confidence.features_2way(F.col("y"), F.col("n"), F.lit("No")).alias("f")).collect()]
    assert two[0]["prediction"] == "Yes" and two[0]["p_yes"] == pytest.approx(1 / (1 + math.exp(-1)))
    assert (two[1]["prediction"], two[1]["confidence"], two[1]["p_yes"]) == ("No", 1.0, 0.5)
    many = [r["f"] for r in df.select(confidence.collector_features(F.col("y"), F.col("n"), F.lit(None).cast("double"), F.lit("No")).alias("f")).collect()]
    assert many[1]["p_true"] == pytest.approx(1 / 3) and many[2]["p_true"] == 1 and many[2]["entropy"] == 0
    # the share of the verdict read from the text, though another is larger; the largest where there is no verdict
    share = 1 / (1 + math.exp(1))
    assert many[0]["confidence"] == pytest.approx(share) and many[2]["confidence"] == 0
    other = df.select(confidence.collector_features(F.col("y"), F.col("n"), F.lit(None).cast("double"), F.lit("PARSE_FAIL")).alias("f")).first()["f"]
    assert other["confidence"] == pytest.approx(1 - share)


def test_tokens_of_verdicts(spark):
    tokens = ["Yes", " t", "FALSE", "Un", "unsure", "true}", "trueish", "no."]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    got = [tuple(r) for r in df.select(confidence.class_of(F.col("t")), confidence.class_of(F.col("t"), False)).collect()]
    assert got == [("yes", "yes"), ("yes", "yes"), ("no", "no"), ("unsure", None), ("unsure", None), (None, None), (None, None), (None, None)]
    assert confidence.plain_content([{"token": "a", "logprob": None, "top_logprobs": [{"token": "b", "logprob": -1}]}]) == [{"token": "a", "logprob": -100.0, "top": [{"token": "b", "logprob": -1.0}]}]


def test_agreement(spark):
    df = spark.createDataFrame([("Yes", "Yes"), ("Yes", "No"), ("Unsure", "No"), ("Yes", "UNKNOWN"), (None, "Yes")], "a string, b string")
    assert [r[0] for r in df.select(confidence.agreement(F.col("a"), F.col("b"))).collect()] == [1, 0, 0, 0, None]


def test_prompts(spark):
    df = spark.createDataFrame([("c", "t{}" * 3, ["one"])], "c string, t string, lessons array<string>")
    none = F.array().cast("array<struct<text:string,label:string>>")
    got = df.select(prompts.chat(F.col("c"), F.col("t"), F.col("lessons"), none, "three").alias("m"), prompts.instruction(F.lit("a{"), F.col("t"), F.lit("}")).alias("i"), prompts.verify(F.array(F.lit("d")), F.col("c"), F.col("t"), F.lit("No"), longest=2).alias("v")).first()
    assert [m["role"] for m in got["m"]] == ["system", "user"] and got["m"][0]["content"].endswith("1. one")
    assert got["i"] == "a{t{{}}t{{}}t{{}}}" and "Document: {}\n" in got["v"]
