import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowtide.operators import alerts, macro
from flowtide.plans.audit import Reputation
from flowtide.plans.models import FlowModel, rule_scorer
from flowtide.schemas import col
from flowtide.session import scratch_path
from flowtide.streaming import flow_state, live, packets, windows
from flowtide.streaming.alert_table import AlertTable

T0 = dt.datetime(2024, 1, 1)


def staged(spark, df, order, parts, label):
    """Write ``df`` as ordered files so a stream reads it in ``parts`` micro-batches."""
    path = scratch_path(spark, label)
    total = df.count()
    numbered = df.withColumn("_p", (F.col(order) * parts / total).cast("int"))
    for i in range(parts):
        numbered.filter(F.col("_p") == i).drop("_p").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def alert_rows(spark, n=400):
    return spark.range(n).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('ip', id % 7) END AS source_ip", "'DDoS' AS threat_type",
        "timestamp_micros(1704067200000000 + id * 45000000 + CASE WHEN id > 200 THEN 3600000000 ELSE 0 END)"
        " AS created_at")


ALERTS = ["source_ip", "threat_type", "detection_id", "occurrences", "first_seen", "last_seen"]


def rows_of(df, names):
    return sorted(tuple(r) for r in df.select(*names).collect())


@pytest.mark.parametrize("settle", [None, 20])
def test_alert_table_equals_batch(spark, settle):
    """Four batches in order, the third one processed twice: alerts and events are those of one pass."""
    df = alert_rows(spark)
    table = AlertTable(scratch_path(spark, "alerts"), 5, buckets=4, settle_minutes=settle)
    assert table.read(spark).count() == 0
    for batch in (0, 1, 2, 2, 3):
        table.update(df.filter(F.col("id").between(batch * 100, batch * 100 + 99)), batch)
    assert rows_of(table.read(spark), ALERTS) == rows_of(alerts.alerts(df, 5), ALERTS)
    names = ["source_ip", "kind", "occurrence", "alert_id", "id"]
    got = rows_of(table.events(spark), names)
    assert got == rows_of(alerts.alert_events(df, 5), names) and len(got) > 20
    if settle:
        assert spark.read.parquet(f"{table.root}/settled").count() > 0
    table.vacuum(spark, keep=1)
    assert rows_of(table.read(spark), ALERTS) == rows_of(alerts.alerts(df, 5), ALERTS)


def test_alert_table_takes_parts_in_any_order(spark):
    df = alert_rows(spark)
    table = AlertTable(scratch_path(spark, "alerts"), 5, buckets=4)
    for batch in range(3):
        table.update(df.filter(F.col("id") % 3 == 2 - batch), batch)
    assert rows_of(table.read(spark), ALERTS) == rows_of(alerts.alerts(df, 5), ALERTS)


def test_an_unfinished_batch_stays_unseen(spark, monkeypatch):
    df = alert_rows(spark)
    table = AlertTable(scratch_path(spark, "alerts"), 5, buckets=4)
    table.update(df.filter("id < 200"), 0)
    before = rows_of(table.read(spark), ALERTS)
    monkeypatch.setattr(AlertTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        table.update(df.filter("id >= 200"), 1)
    assert rows_of(table.read(spark), ALERTS) == before
    monkeypatch.undo()
    table.update(df.filter("id >= 200"), 1)
    assert rows_of(table.read(spark), ALERTS) == rows_of(alerts.alerts(df, 5), ALERTS)


def test_a_flood_shuffles_few_rows(spark):
    """The rank filter stands below the shuffle: a task sends at most as many rows of a key and slot as levels need."""
    plan = alerts.alert_events(alert_rows(spark), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")


def test_streamed_spread_far_from_zero(spark):
    df = spark.range(200).selectExpr(
        "id", "concat('s', id % 2) AS src_ip", "timestamp_micros(1704067200000000 + id * 1000000) AS ts",
        "1e8 + id % 5 * 0.5 AS `Flow IAT Std`", "CAST(1 + id % 3 AS DOUBLE) AS `Total Fwd Packets`", "CAST(id AS DOUBLE) AS `Destination Port`")
    features = ["Flow IAT Std", "Total Fwd Packets", "Destination Port"]
    tail = spark.range(1).selectExpr("200 AS id", "'z' AS src_ip", "timestamp'2024-01-02' AS ts", "0D AS `Flow IAT Std`", "1D AS `Total Fwd Packets`", "0D AS `Destination Port`")
    out = live.drain(windows.macro_stream(staged(spark, df.union(tail), "id", 5, "far-in"), "ts", features, ["src_ip"]), "far")
    batch = macro.assemble(df, ["src_ip"], features, order_by=["ts"])
    names = ["src_ip", "member_count", *features]
    got, want = (sorted(tuple(r) for r in f.select(*[col(n) for n in names]).collect()) for f in (out, batch))
    assert got == want and [r[4] for r in got] == [0.0, 1.0]
    for src, _, spread, *_ in got:
        ids = [i for i in range(200) if i % 2 == int(src[1])]
        w = [1 + i % 3 for i in ids]
        mean = sum(a * (i % 5) * 0.5 for a, i in zip(w, ids)) / sum(w)
        assert abs(spread - (sum(a * ((i % 5) * 0.5 - mean) ** 2 for a, i in zip(w, ids)) / sum(w)) ** 0.5) < 1e-6


def test_alert_windows_equal_batch(spark):
    df = alert_rows(spark)
    out = live.drain(windows.alert_stream(staged(spark, df, "id", 3, "alerts-win"), 5, "1 minute"), "w")
    last = df.agg(F.max("created_at")).first()[0] - dt.timedelta(minutes=6)
    batch = alerts.alerts(df, 5).filter(F.col("last_seen") <= F.lit(last))
    names = ["source_ip", "detection_id", "occurrences", "first_seen", "last_seen"]
    assert sorted(map(tuple, out.select(*names).collect())) == sorted(map(tuple, batch.select(*names).collect()))


def test_macro_windows_equal_batch(spark):
    df = spark.range(300).selectExpr(
        "id", "concat('s', id % 4) AS src_ip", "'d' AS dst_ip", "CAST(id AS INT) AS src_port", "80 AS dst_port",
        "6 AS protocol", "timestamp_micros(1704067200000000 + id * 2000000 + (id div 50) * 40000000) AS ts",
        "CAST(id % 11 AS DOUBLE) AS `Flow IAT Std`", "CAST(id AS DOUBLE) AS `Flow Duration`")
    features = ["Flow IAT Std", "Flow Duration"]
    out = live.drain(windows.macro_stream(staged(spark, df, "id", 3, "macro-in"), "ts", features), "macro")
    tagged = macro.group_windows(df, "ts", 10)
    batch = macro.assemble(tagged, [*macro.DEFAULT_KEY, "window_start"], features)
    names = ["src_ip", "window_start", "member_count", "Flow Duration"]
    got = {tuple(r) for r in out.select(*[col(n) for n in names]).collect()}
    want = {tuple(r) for r in batch.select(*[col(n) for n in names]).collect()}
    assert got <= want and len(want - got) <= 4 and len(got) > 10
    spread = {(r.src_ip, r.window_start): r["Flow IAT Std"] for r in batch.collect()}
    assert all(abs(spread[r.src_ip, r.window_start] - r["Flow IAT Std"]) < 1e-5 for r in out.collect())


def test_duplicates_are_dropped(spark):
    df = alert_rows(spark, 60)
    stream = staged(spark, df.union(df).withColumn("id", F.col("id")), "id", 1, "dup-in")
    assert live.drain(windows.without_duplicates(stream, ["id"], "created_at", "1 hour"), "dup").count() == 60


def test_live_pipeline(spark):
    flows = spark.range(90).selectExpr(
        "id AS flow_id", "timestamp_micros(1704067200000000 + id * 1000000) AS created_at",
        "concat('10.0.0.', id % 5) AS `Src IP`", "CAST(id % 3 AS DOUBLE) AS `SYN Flag Count`",
        "CASE WHEN id = 7 THEN double('Infinity') ELSE 1D END AS `Flow Duration`")
    model = FlowModel("m", ["SYN Flag Count", "Flow Duration"], ["BENIGN", "SYN Flood"],
                      rule_scorer("array(1 - `SYN Flag Count` / 2, `SYN Flag Count` / 2)"))
    ips = lambda *v: spark.createDataFrame([(x, None) for x in v], "ip_address string, reason string")
    job = live.LivePipeline(model, scratch_path(spark, "live-test"), Reputation(ips("10.0.0.1"), ips("10.0.0.2")))
    stream = staged(spark, flows, "flow_id", 3, "live-in")
    job.start_raw(stream, once=True).awaitTermination()
    query = job.start(stream, once=True)
    query.awaitTermination()
    rows = spark.read.parquet(job.path("detections"))
    assert rows.count() == 90 and rows.select("batch_id").distinct().count() == 3
    assert spark.read.parquet(job.path("raw")).filter("`Flow Duration` = double('Infinity')").count() == 1
    cleaned = spark.read.parquet(job.path("cleaned"))
    assert cleaned.count() == 90 and cleaned.filter("prediction IS NULL").count() == 0
    assert spark.read.parquet(job.path("logs")).filter("source = 'CAPTURE'").count() == 90
    assert rows.filter("is_blacklisted AND severity <> 'CRITICAL'").count() == 0
    total = job.alerts(spark).agg(F.sum("occurrences")).first()[0]
    assert total == rows.filter("NOT is_whitelisted AND (is_blacklisted OR prediction <> 0)").count()
    assert [r.created_at for r in job.recent(spark, 2).collect()] == [T0 + dt.timedelta(seconds=s) for s in (89, 88)]
    assert live.progress(query)["input_rows"] == 90 and not live.progress(query)["is_running"]
    # A replayed batch replaces itself.
    job.process(flows.filter("flow_id < 30"), 0)
    assert spark.read.parquet(job.path("detections")).count() == 90


def test_late_rows_are_stored_apart(spark):
    rows = spark.range(40).selectExpr(
        "id AS flow_id", "timestamp_micros(1704067200000000 + CASE WHEN id = 35 THEN 0 ELSE id * 60000000 END) "
        "AS created_at", "'1.1.1.1' AS `Src IP`", "1D AS `SYN Flag Count`")
    model = FlowModel("m", ["SYN Flag Count"], ["BENIGN", "SYN Flood"], rule_scorer("array(0.5D, 0.5D)"))
    job = live.LivePipeline(model, scratch_path(spark, "late-test"), late_after_seconds=120)
    job.start(staged(spark, rows, "flow_id", 4, "late-in"), once=True).awaitTermination()
    assert [r.flow_id for r in spark.read.parquet(job.path("late")).collect()] == [35]
    assert spark.read.parquet(job.path("detections")).count() == 39


def test_late_rows_are_set_aside(spark):
    batch = alert_rows(spark, 10)
    on_time, late = live.late_rows(batch, "created_at", F.lit(T0 + dt.timedelta(seconds=100)))
    assert (on_time.count(), late.count()) == (7, 3)


def packet_rows(spark, rows):
    return spark.createDataFrame(
        [(i, T0 + dt.timedelta(seconds=t), s, d, sp, dp, 6, n, 20, flags, 100 + i)
         for i, (t, s, sp, d, dp, n, flags) in enumerate(rows)],
        "packet_no bigint, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, "
        "payload_len int, header_len int, tcp_flags int, window int")


TALK = [(0, "b", 5, "a", 80, 10, 2), (1, "a", 80, "b", 5, 0, 18), (3, "b", 5, "a", 80, 30, 24),
        (20, "b", 5, "a", 80, 7, 16)]


def test_two_directions_make_one_flow(spark):
    got = packets.flows(packet_rows(spark, TALK), slices=2).orderBy("flow_start").collect()
    assert len(got) == 2
    f = got[0]
    assert (f.src_ip, f.dst_ip, f.dst_port) == ("b", "a", 80)
    assert (f["Total Fwd Packets"], f["Total Backward Packets"], f["Flow Duration"]) == (2.0, 1.0, 3e6)
    assert (f["Flow IAT Max"], f["Flow IAT Min"], f["Fwd IAT Total"], f["Bwd IAT Total"]) == (2e6, 1e6, 3e6, 0.0)
    assert (f["SYN Flag Count"], f["PSH Flag Count"], f["Fwd PSH Flags"]) == (2.0, 1.0, 1.0)
    assert (f["Init_Win_bytes_forward"], f["Init_Win_bytes_backward"]) == (100.0, 101.0)
    assert f["Flow Bytes/s"] == pytest.approx(40 / 3) and f["Active Max"] == 3e6 and f["Idle Max"] == 0.0


def some_packets(spark):
    """Connections of many flows: pauses on both sides of both limits, ties, replies, a first packet from either side."""
    return spark.range(600).selectExpr(
        "id AS packet_no", "id % 5 AS c", "pmod(xxhash64(id), 3) = 0 AS reply", "pmod(xxhash64(id, 1), 8) AS step").selectExpr(
        "packet_no", "timestamp_micros(1704067200000000 + packet_no * 700000 + (packet_no div 60) * 15000000 - (packet_no % 7 = 0)::int * 700000) AS ts",
        "CASE WHEN reply THEN '9.9.9.9' ELSE concat('1.0.0.', c) END AS src_ip", "CASE WHEN reply THEN concat('1.0.0.', c) ELSE '9.9.9.9' END AS dst_ip",
        "IF(reply, 80, 5000) AS src_port", "IF(reply, 5000, 80) AS dst_port", "6 AS protocol", "CAST(step * 13 AS INT) AS payload_len",
        "CAST(20 + step AS INT) AS header_len", "CAST(pmod(xxhash64(packet_no, 2), 256) AS INT) AS tcp_flags", "CAST(packet_no AS INT) AS window")


@pytest.mark.parametrize("parts", [1, 6])
def test_flow_stream_equals_batch_on_all_measures(spark, parts):
    df = some_packets(spark)
    # The last packet only moves the watermark past all others.
    end = packet_rows(spark, [(100_000, "x", 1, "y", 2, 1, 0)]).withColumn("packet_no", F.lit(600).cast("long"))
    stream = staged(spark, df.unionByName(end), "packet_no", parts, "pk")
    out = live.drain(flow_state.flow_stream(stream, idle=9, activity=3.6), "pk-out")
    batch = packets.flows(df, idle=9, activity=3.6, slices=3)
    assert sorted(out.columns) == sorted(batch.columns)
    key = ("src_ip", "dst_ip", "flow_start")
    got, want = ({tuple(r[k] for k in key): r.asDict() for r in f.collect()} for f in (out, batch))
    assert got.keys() == want.keys() and len(got) > 30
    for flow, row in want.items():
        for name, value in row.items():
            assert got[flow][name] == (pytest.approx(value, rel=1e-9, abs=1e-6) if isinstance(value, float) else value), (flow, name)
    assert any(r["Active Std"] > 0 for r in want.values()) and any(r["Idle Max"] > 0 for r in want.values())


def test_flow_stream_closes_idle_flows(spark):
    rows = TALK + [(200, "x", 1, "y", 2, 1, 0)]
    out = live.drain(flow_state.flow_stream(staged(spark, packet_rows(spark, rows), "packet_no", 2, "pk")), "pk-out")
    got = sorted((r.flow_start, r["Total Fwd Packets"] + r["Total Backward Packets"], r["Total Length of Fwd Packets"]) for r in out.collect())
    assert got == [(T0, 3, 40), (T0 + dt.timedelta(seconds=20), 1, 7)]


@pytest.mark.parametrize("buckets", [1, 3])
def test_flow_stream_keeps_the_connections_of_a_bucket_apart(spark, buckets):
    df = some_packets(spark)
    end = packet_rows(spark, [(100_000, "x", 1, "y", 2, 1, 0)]).withColumn("packet_no", F.lit(600).cast("long"))
    out = live.drain(flow_state.flow_stream(staged(spark, df.unionByName(end), "packet_no", 4, "pk"), idle=9, activity=3.6, buckets=buckets), "pk-out")
    shown = lambda f: sorted((r.src_ip, r.dst_ip, r.flow_start, r["Total Fwd Packets"], r["Fwd IAT Max"], r["Init_Win_bytes_backward"],
                              r["Idle Max"], r["Active Max"]) for r in f.collect())
    assert shown(out) == shown(packets.flows(df, idle=9, activity=3.6, slices=3))


def test_a_bucket_is_one_call_a_batch_for_all_its_connections():
    import pandas as pd

    class State:
        exists, hasTimedOut, get = False, False, None
        def getCurrentWatermarkMs(self): return 100_000  # noqa: E704
        def remove(self): self.exists = False  # noqa: E704

    frame = pd.DataFrame({"connection": [f"c{i % 50}" for i in range(100)], "us": range(100), "no": range(100), "from_a": True,
                          "size": 1, "header": 20, "flags": 0, "window": 7})
    out = list(flow_state._advance(1_000_000, 500_000)((0,), iter([frame]), State()))
    assert len(out) == 1 and len(out[0]) == 50 and set(out[0]["Flow Duration"]) == {50.0}


def test_a_silent_flow_ends_while_the_next_packet_waits(spark):
    rows = [(0, "b", 5, "a", 80, 10, 2), (15, "x", 1, "y", 2, 1, 0), (200, "b", 5, "a", 80, 7, 16)]
    out = live.drain(flow_state.flow_stream(staged(spark, packet_rows(spark, rows), "packet_no", 2, "pk")), "pk-out")
    assert sorted(r.src_ip for r in out.collect()) == ["b", "x"]
