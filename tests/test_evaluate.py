import math

import pytest
from pyspark.sql import functions as F

from flowtide.operators import evaluate

MATRIX = [[90, 5, 5], [6, 51, 3], [4, 4, 32]]
CLASSES = ["BENIGN", "ATTACK1", "ATTACK2"]


def long_matrix(spark):
    return spark.createDataFrame([(a, p, n) for a, line in zip(CLASSES, MATRIX) for p, n in zip(CLASSES, line)],
                                 "actual string, predicted string, n bigint")


def profile_rows(spark, scores):
    return spark.createDataFrame(list(zip(CLASSES, *scores)),
                                 "class string, precision double, recall double, f1 double, support bigint")


def test_detection_rates_of_a_stored_report(spark):
    report = profile_rows(spark, [(.95, .90, .88), (.90, .85, .80), (.92, .87, .84), (100, 60, 40)])
    r = evaluate.detection_rates(report).first()
    assert r["attack_detection_rate"] == pytest.approx(.825) and r["false_negative_rate"] == pytest.approx(.175)
    assert r["false_positive_rate"] == pytest.approx(.10)


def test_report_and_totals(spark):
    long = long_matrix(spark)
    report = {r["class"]: r for r in evaluate.class_report(long).collect()}
    assert report["BENIGN"]["recall"] == pytest.approx(.90) and report["BENIGN"]["precision"] == pytest.approx(.90)
    assert report["ATTACK2"]["recall"] == pytest.approx(.80) and report["ATTACK1"]["support"] == 60
    total = evaluate.overall(long).first()
    s, c = 200, 173
    t, p = [100, 60, 40], [100, 60, 40]
    mcc = (c * s - sum(a * b for a, b in zip(t, p))) / math.sqrt(
        (s * s - sum(x * x for x in p)) * (s * s - sum(x * x for x in t)))
    assert total["accuracy"] == pytest.approx(c / s) and total["mcc"] == pytest.approx(mcc)


def test_metric_winners_and_lower_is_better(spark):
    def row(acc, mcc, f1, fnr):
        return spark.createDataFrame([(acc, mcc, f1, fnr)], ["accuracy", "mcc", "f1_weighted", "false_negative_rate"])
    got = {r.metric: r.winner for r in evaluate.compare_metrics(
        row(.89, .55, .90, .2), row(.87, .70, .80, .1), ["accuracy", "mcc", "f1_weighted", "false_negative_rate"],
        "A", "B").collect()}
    assert got == {"accuracy": "A", "mcc": "B", "f1_weighted": "A", "false_negative_rate": "B"}


def test_ties_between_classes(spark):
    a = spark.createDataFrame([("x", .5), ("y", .9), ("only", 1.0)], ["class", "f1"])
    b = spark.createDataFrame([("x", .5005), ("y", .8)], ["class", "f1"])
    assert {r["class"]: r.winner for r in evaluate.compare_classes(a, b).collect()} == {"x": "tie", "y": "a"}


@pytest.mark.parametrize("rows, expected", [
    ([(0, .1), (1, .9), (0, .4), (1, .4)], 0.875), ([(0, .1), (0, .9)], None), ([(1, .2), (0, .2)], 0.5)])
def test_auc(spark, rows, expected):
    df = spark.createDataFrame(rows, ["actual", "score"])
    assert evaluate.roc_auc(df, "score", slices=3).first()[0] == expected


def test_binary_metrics_with_empty_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], ["actual", "predicted"])
    row = evaluate.binary_metrics(evaluate.binary_matrix(df)).first().asDict()
    assert (row["tn"], row["accuracy"], row["precision"], row["recall"], row["mcc"]) == (2, 1.0, 0.0, 0.0, 0.0)


def test_quality_bands(spark):
    report = profile_rows(spark, [(1., 1., 1.), (1.0, .9, .3), (1., .9, .4), (5, 5, 1)])
    got = {r["class"]: (r.status, r.weak, r.strong) for r in evaluate.quality(report).collect()}
    assert got == {"BENIGN": ("PERFECT", False, True), "ATTACK1": ("Good", False, False),
                   "ATTACK2": ("Poor", False, False)}


def test_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, None)], "a double, b double, c double")
    got = {r["column"]: r["is_constant"] for r in evaluate.constant_columns(df, ["a", "b", "c"]).collect()}
    assert got == {"a": True, "b": False, "c": True}


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_split_is_exact_and_repeatable(spark, buckets):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id < 700 THEN 'a' WHEN id < 999 THEN 'b' ELSE 'c' END AS label")
    first = evaluate.exact_split(df, "label", ["id"], buckets=buckets)
    sizes = {r.label: r.n for r in first.filter("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"a": 140, "b": 60}
    assert first.count() == 1000
    again = evaluate.exact_split(df.repartition(5), "label", ["id"], buckets=buckets)
    assert first.filter("is_test").select("id").exceptAll(again.filter("is_test").select("id")).count() == 0


def test_split_of_repeats_null_classes_and_plan(spark):
    """Repeated identities straddle the cut; a null class is a class; wide rows of a plain split aren't shuffled."""
    rows = spark.range(1000).selectExpr("id div 40 AS id", "CASE WHEN id % 2 = 0 THEN NULL ELSE 'b' END AS label", "repeat('x', 50) AS wide")
    out = evaluate.exact_split(rows, "label", ["id"], buckets=16)
    sizes = {r.label: (r.n, r.t) for r in out.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert sizes == {None: (500, 100), "b": (500, 100)} and out.columns == [*rows.columns, "is_test"]
    alone = spark.range(1000).selectExpr("id", "id % 3 AS label", "repeat('x', 50) AS wide")
    plan = evaluate.exact_split(alone, "label", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
