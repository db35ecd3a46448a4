import math

import pytest
from pyspark.sql import functions as F

from flowtide.operators import align, decide
from flowtide.functions import scalars
from flowtide.schemas import col

INF = float("inf")


def values(df, names):
    row = df.first()
    return [row[n] for n in names]


def test_separators_and_case(spark):
    df = spark.createDataFrame([(100.0, 1.0, 80.0)], ["flow_duration", "SYN Flag Count", "destination-port"])
    names = ["Destination Port", "Flow Duration", "SYN Flag Count"]
    assert values(align.align(df, names), names) == [80.0, 100.0, 1.0]


def test_missing_features_are_reported(spark):
    df = spark.createDataFrame([(50.0,)], ["Flow Duration"])
    names = ["Flow Duration", "Missing A", "Missing B"]
    out = align.align(df, names)
    assert values(out, names) == [50.0, 0.0, 0.0]
    assert out.first()["missing_features"] == ["Missing A", "Missing B"]


def test_abbreviations(spark):
    df = spark.createDataFrame([(10.0, 1400.0, 400.0, 512.0, 256.0, 14000.0, 5000.0, 100.0, 3.0, 12000.0)], [
        "Tot Fwd Pkts", "Fwd Pkt Len Max", "Fwd Pkt Len Mean", "Fwd Seg Size Avg", "Bwd Seg Size Avg",
        "Tot Len Fwd Pkts", "Flow Byts/s", "Flow Pkts/s", "SYN Flag Count", "Flow Duration"])
    names = ["Total Fwd Packets", "Fwd Packet Length Max", "Fwd Packet Length Mean", "Avg Fwd Segment Size",
             "Avg Bwd Segment Size", "Total Length of Fwd Packets", "Flow Bytes/s", "Flow Packets/s",
             "SYN Flag Count"]
    assert values(align.align(df, names), names) == [10, 1400, 400, 512, 256, 14000, 5000, 100, 3]


@pytest.mark.parametrize("a, expected", [(math.nan, 0.0), (None, 0.0), (INF, 0.0), (-INF, 0.0), (7.0, 7.0)])
def test_invalid_values_are_filled(spark, a, expected):
    df = spark.createDataFrame([(a, 5.0)], "A double, B double")
    assert values(align.align(df, ["A", "B"]), ["A", "B"]) == [expected, 5.0]


def test_second_candidate_fills_a_null_cell(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 2.0)], "flow_duration double, `Flow Duration` double")
    assert [r[0] for r in align.align(df, ["Flow Duration"]).select(col("Flow Duration")).collect()] == [1.0, 2.0]


@pytest.mark.parametrize("present, accepted", [(1, 0), (4, 1)])
def test_coverage_guard(spark, present, accepted):
    names = ["Flow Duration", "SYN Flag Count", "Flow Bytes/s", "Idle Max", "Active Max"]
    df = spark.createDataFrame([tuple([1.0] * present)], names[:present])
    ok, bad = align.covered(align.align(df, names), 0.6)
    assert (ok.count(), bad.count()) == (accepted, 1 - accepted)


def test_empty_requirement_is_covered(spark):
    out = align.align(spark.createDataFrame([(1.0,)], ["A"]), [], ["A"])
    assert align.covered(out, 0.9)[0].count() == 1


def test_sanitize_and_training_clean(spark):
    df = spark.createDataFrame([(INF, 1, "a"), (math.nan, None, None), (2.0, 3, "c")], "x double, n int, t string")
    assert [(r.x, r.n) for r in align.sanitize(df).collect()] == [(0.0, 1), (0.0, 0), (2.0, 3)]
    assert align.drop_unusable(df).count() == 1


@pytest.mark.parametrize("p, threshold, expected", [
    ([.40, .60], 0.5, 1), ([.40, .60], 0.9, 0), ([.55, .10, .35], 0.5, 0), ([.10, .05, .05, .80], 0.5, 3),
    ([.10, .05, .05, .80], 0.95, 0), ([.45, .30, .25], 0.5, 1)])
def test_decision_threshold(spark, p, threshold, expected):
    df = spark.createDataFrame([(p,)], "p array<double>")
    assert df.select(decide.decide_class(F.col("p"), threshold)).first()[0] == expected


@pytest.mark.parametrize("confidence, malicious, expected", [
    (0.90, True, "CRITICAL"), (0.8999, True, "HIGH"), (0.70, True, "HIGH"), (0.40, True, "MEDIUM"),
    (0.3999, True, "LOW"), (0.99, False, "")])
def test_severity(spark, confidence, malicious, expected):
    df = spark.createDataFrame([(confidence, malicious)], ["c", "m"])
    assert df.select(decide.severity_of(F.col("c"), F.col("m"))).first()[0] == expected


def test_fixed_numbers_follow_binary_values(spark):
    samples = [0.125, 0.375, 66.25, 0.15, 2.675, -0.5, 1e-9, 12345.00005, 99999999.99995, 1.005, -3.14159, 0.0]
    df = spark.createDataFrame([(x,) for x in samples], ["x"])
    for digits in (1, 2, 4):
        got = [r[0] for r in df.select(scalars.fixed(F.col("x"), digits)).collect()]
        assert got == [f"{x:.{digits}f}" for x in samples]


def test_addresses(spark):
    cases = {"10.0.0.1": True, " 1.2.3.4 ": True, "256.1.1.1": False, "01.2.3.4": False, "::1": True,
             "2001:db8::g": False, "": False, "fe80::1%eth0": True, "abc": False}
    df = spark.createDataFrame([(k,) for k in cases], ["ip"])
    got = {r[0]: r[1] for r in df.select("ip", scalars.is_ip_address(F.col("ip"))).collect()}
    assert got == cases


def test_chat_ids_and_subnets(spark):
    df = spark.createDataFrame([("-100", "192.168.5.77", "255.255.252.0"), ("1-2", "x", "255.0.0.0")],
                               ["chat", "ip", "mask"])
    rows = df.select(scalars.is_chat_id(F.col("chat")), scalars.network_address(F.col("ip"), F.col("mask")),
                     scalars.broadcast_address(F.col("ip"), F.col("mask"))).collect()
    assert tuple(rows[0]) == (True, "192.168.4.0", "192.168.7.255") and rows[1][0] is False


def test_json_alignment(spark):
    df = spark.createDataFrame([(1, '{"flow_duration": 7, "SYN Flag Cnt": 2}'), (2, "not json"), (3, "{}")],
                               "id int, j string")
    out = align.align_json(df, "j", ["Flow Duration", "SYN Flag Count"], ["id"]).orderBy("id").collect()
    assert [(r["Flow Duration"], r["SYN Flag Count"], len(r["missing_features"])) for r in out] == [
        (7.0, 2.0, 0), (0.0, 0.0, 2), (0.0, 0.0, 2)]


def test_json_values_that_are_no_numbers_leave_the_others(spark):
    from flowtide.operators.align import align_json
    df = spark.createDataFrame([(1, '{"Flow Duration": 5, "note": "x", "tot_fwd_pkts": 2}')], "id long, j string")
    row = align_json(df, "j", ["Flow Duration", "Total Fwd Packets"], ["id"]).first()
    assert (row["Flow Duration"], row["Total Fwd Packets"], row["coverage"]) == (5.0, 2.0, 1.0)


def test_frame_form_takes_one_column(spark):
    from flowtide.operators.align import align
    df = spark.createDataFrame([(1.0, None)], "flow_duration double, `Flow Duration` double")
    assert align(df, ["Flow Duration"], report="frame").first()["Flow Duration"] == 0.0
    assert align(df, ["Flow Duration"]).first()["Flow Duration"] == 1.0
