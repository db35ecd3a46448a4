import math

import pytest
from pyspark.sql import functions as F

from flowtide.operators import macro
from flowtide.schemas import col

BASE = "src_ip string, dst_ip string, src_port int, dst_port int, protocol int"


def flows(spark, columns, rows):
    ddl = BASE + "".join(f", `{c}` double" for c in columns)
    return spark.createDataFrame([("1.1.1.1", "2.2.2.2", 1000 + i, 80, 6, *r) for i, r in enumerate(rows)], ddl)


def one(df, name):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0][name]


def test_rotating_ports_collapse(spark):
    m = macro.assemble(flows(spark, ["Flow Duration"], [(1.0,), (2.0,), (3.0,)]))
    assert one(m, "Flow Duration") == 6.0 and one(m, "member_count") == 3


def test_rate_uses_durations(spark):
    m = macro.assemble(flows(spark, ["Flow Duration", "Flow Bytes/s"], [(3.0, 10.0), (1.0, 40.0)]))
    assert one(m, "Flow Bytes/s") == 17.5
    z = macro.assemble(flows(spark, ["Flow Duration", "Flow Bytes/s"], [(0.0, 10.0), (0.0, 40.0)]))
    assert one(z, "Flow Bytes/s") == 0.0


def test_extremes(spark):
    m = macro.assemble(flows(spark, ["Flow IAT Min", "Flow IAT Max"], [(4.0, 4.0), (9.0, 9.0)]))
    assert (one(m, "Flow IAT Min"), one(m, "Flow IAT Max")) == (4.0, 9.0)


def test_weighted_mean_and_std(spark):
    rows = [(1.0, 10.0, 10.0), (3.0, 20.0, 20.0)]
    m = macro.assemble(flows(spark, ["Total Fwd Packets", "Flow IAT Mean", "Flow IAT Std"], rows))
    assert one(m, "Flow IAT Mean") == 17.5
    assert one(m, "Flow IAT Std") == pytest.approx(math.sqrt(18.75), abs=1e-6)


def test_std_of_one_light_member_is_zero(spark):
    m = macro.assemble(flows(spark, ["Flow IAT Std"], [(5.0,)]), min_members=1)
    assert one(m, "Flow IAT Std") == 0.0


def test_non_finite_counts_as_zero_and_absent_is_skipped(spark):
    m = macro.assemble(flows(spark, ["Total Fwd Packets", "Flow IAT Mean"], [(math.inf, None), (2.0, 8.0)]))
    assert one(m, "Total Fwd Packets") == 2.0 and one(m, "Flow IAT Mean") == 8.0


def test_lone_member_is_untouched(spark):
    row = (0.12345678, 1 / 3, 2 / 3, 5.5555555)
    names = ["Flow Duration", "Flow Bytes/s", "Flow IAT Std", "Flow IAT Mean"]
    m = macro.assemble(flows(spark, names, [row]))
    assert [one(m, n) for n in names] == list(row)


def test_identity_feature_of_first_member(spark):
    f = flows(spark, ["Destination Port", "Flow Duration"], [(443.0, 2.0), (80.0, 1.0)])
    m = macro.assemble(f, features=["Destination Port", "Flow Duration"], order_by=["src_port"])
    assert one(m, "Destination Port") == 443.0


def test_std_keeps_digits_far_from_zero(spark):
    base = 1.2e8
    m = macro.assemble(flows(spark, ["Flow IAT Std"], [(base,), (base + 0.25,)]), min_members=1)
    assert one(m, "Flow IAT Std") == pytest.approx(0.125, abs=1e-6)


@pytest.mark.parametrize("hot_rows", [100, 5_000_000])
def test_hot_key_keeps_every_row(spark, hot_rows):
    """One key with 10 000 members next to many small ones, through the hot and the cold path."""
    f = (spark.range(12_000).selectExpr(
        "CASE WHEN id < 10000 THEN 'hot' ELSE concat('k', id % 500) END AS src_ip", "'d' AS dst_ip",
        "CAST(id AS INT) AS src_port", "80 AS dst_port", "6 AS protocol", "CAST(id % 7 AS DOUBLE) AS `Flow IAT Std`",
        "CAST(1 + id % 3 AS DOUBLE) AS `Total Fwd Packets`"))
    m = macro.assemble(f)
    rows = macro.attribute(f, m.select(*macro.DEFAULT_KEY, "member_count"), hot_rows=hot_rows)
    assert rows.count() == 12_000 and rows.select("src_port").distinct().count() == 12_000
    assert rows.filter("member_count IS NULL").count() == 0
    hot = m.filter("src_ip = 'hot'").first()
    ids = range(10_000)
    w = [1 + i % 3 for i in ids]
    mean = sum(a * (i % 7) for a, i in zip(w, ids)) / sum(w)
    std = math.sqrt(sum(a * ((i % 7) - mean) ** 2 for a, i in zip(w, ids)) / sum(w))
    assert hot["member_count"] == 10_000 and hot["Flow IAT Std"] == pytest.approx(std, abs=1e-5)


def test_sums_are_preserved(spark):
    f = spark.range(500).selectExpr("concat('s', id % 9) AS src_ip", "'d' AS dst_ip", "1 AS src_port",
                                    "80 AS dst_port", "6 AS protocol", "CAST(id AS DOUBLE) AS `Flow Duration`")
    assert macro.assemble(f).agg(F.sum(col("Flow Duration"))).first()[0] == sum(range(500))


def test_null_key_members_form_one_group(spark):
    rows = [(None, "a", 10.0, 5.0), (None, "a", 100.0, 5.0), ("x", "a", 1.0, 5.0), ("x", "a", 1.0, 7.0)]
    flows = spark.createDataFrame(rows, "src_ip string, dst_ip string, `Packet Length Std` double, v double")
    key = ("src_ip", "dst_ip")
    for hot in (5_000_000, 1):
        units = macro.assemble(flows, key=key, features=["Packet Length Std", "v"])
        assert {r.src_ip: r.member_count for r in units.collect()} == {None: 2, "x": 2}
        assert all(r["Packet Length Std"] is not None for r in units.collect())
        back = macro.attribute(flows, units.select(*key, "member_count"), key, hot_rows=hot).collect()
        assert len(back) == 4 and all(r.member_count == 2 for r in back)
