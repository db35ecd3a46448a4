import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowtide.operators import alerts, outbox, reputation
from flowtide.operators.skew import Slices, lookup

T0 = dt.datetime(2024, 1, 1)
EVENTS = "id long, source_ip string, threat_type string, created_at timestamp"


def events(spark, minutes, ip="9.9.9.9", kind="DDoS"):
    return spark.createDataFrame(
        [(i, ip, kind, T0 + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)], EVENTS)


def brute_sessions(rows, window):
    """Plain walk over sorted events: (first id, occurrences) per alert, and the counters."""
    out, counters = {}, {}
    for ip, kind, ts, i in sorted(rows):
        chain = out.setdefault((ip, kind), [])
        if chain and ts - chain[-1][2] <= window:
            chain[-1][1] += 1
            chain[-1][2] = ts
        else:
            chain.append([i, 1, ts])
        counters[i] = chain[-1][1]
    return out, counters


def test_pause_of_exactly_the_window_continues(spark):
    got = alerts.alerts(events(spark, [0, 10, 20, 30.001]), 10).orderBy("detection_id").collect()
    assert [(r.detection_id, r.occurrences) for r in got] == [(0, 3), (3, 1)]


def test_escalations_and_new(spark):
    got = alerts.alert_events(events(spark, range(30)), 10).orderBy("occurrence").collect()
    assert [(r.kind, r.occurrence, r.id) for r in got] == [
        ("NEW", 1, 0), ("ESCALATION", 5, 4), ("ESCALATION", 10, 9), ("ESCALATION", 25, 24)]
    assert {r.alert_id for r in got} == {0}


def test_flood_in_one_instant(spark):
    """5 000 events of one key at one time: counters stay exact and the alert is one."""
    flood = spark.range(5000).selectExpr("id", "'9.9.9.9' AS source_ip", "'DDoS' AS threat_type",
                                         "timestamp'2024-01-01 00:00:00' AS created_at")
    assert [r.occurrences for r in alerts.alerts(flood, 10).collect()] == [5000]
    fired = alerts.alert_events(flood, 10).orderBy("occurrence").collect()
    assert [(r.occurrence, r.id) for r in fired] == [(1, 0), (5, 4), (10, 9), (25, 24), (50, 49), (100, 99)]
    numbered = alerts.numbered_events(flood, 10, slices=5)
    assert numbered.filter("occurrence <> id + 1").count() == 0 and numbered.count() == 5000


def test_random_events_match_a_plain_walk(spark):
    import random
    rng = random.Random(7)
    rows = [(f"ip{rng.choice([0, 0, 0, 1, 2])}", rng.choice(["A", "B"]),
             T0 + dt.timedelta(seconds=rng.randrange(0, 40_000, 30)), i) for i in range(600)]
    df = spark.createDataFrame([(i, ip, k, ts) for ip, k, ts, i in rows], EVENTS)
    chains, counters = brute_sessions(rows, dt.timedelta(minutes=3))
    expected = sorted((ip, k, c[0], c[1]) for (ip, k), cs in chains.items() for c in cs)
    got = sorted((r.source_ip, r.threat_type, r.detection_id, r.occurrences) for r in alerts.alerts(df, 3).collect())
    assert got == expected
    numbered = {r.id: r.occurrence for r in alerts.numbered_events(df, 3, slices=4).collect()}
    assert numbered == counters


POLICY = [  # whitelisted, protected, blacklisted, prediction -> action, threat type
    (True, False, True, 2, "suppressed_whitelist"), (False, True, True, 2, "suppressed_protected"),
    (False, False, True, 0, "forced"), (False, False, False, 0, "none"), (False, False, False, 1, "aggregate")]


@pytest.mark.parametrize("white, protected, black, prediction, action", POLICY)
def test_policy_order(spark, white, protected, black, prediction, action):
    df = spark.createDataFrame([(white, protected, black, prediction)],
                               ["is_whitelisted", "is_protected", "is_blacklisted", "prediction"])
    assert df.select(alerts.alert_action()).first()[0] == action


@pytest.mark.parametrize("prediction, label, black, expected", [
    (1, "DDoS", False, "DDoS"), (1, "", False, "Anomalous / Malicious Traffic"),
    (0, "BENIGN", True, "Blocked IP Attempting Access"), (1, "", True, "Blocked IP Attempting Access"),
    (2, "Bot", True, "Bot")])
def test_threat_type(spark, prediction, label, black, expected):
    df = spark.createDataFrame([(prediction, label, black)], ["prediction", "attack_type", "is_blacklisted"])
    assert df.select(alerts.threat_type()).first()[0] == expected


def test_fold_equals_one_pass(spark):
    df = events(spark, [0, 5, 14, 30, 39, 60])
    early, late = df.filter("id < 2"), df.filter("id >= 2")
    folded = alerts.fold_alerts(alerts.alerts(early, 10), alerts.alerts(late, 10), 10)
    names = ["detection_id", "occurrences", "first_seen", "last_seen"]
    assert sorted(map(tuple, folded.select(*names).collect())) == sorted(
        map(tuple, alerts.alerts(df, 10).select(*names).collect()))


@pytest.mark.parametrize("max_rows, hot_rows", [(1000, 5_000_000), (0, 50), (0, 5_000_000)])
def test_lookup_paths_agree(spark, max_rows, hot_rows):
    """Broadcast, hot and cold path give every row once, with nulls for unlisted and null keys."""
    big = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 10 = 1 THEN NULL ELSE concat('k', id % 40) END AS ip")
    dim = spark.createDataFrame([("hot", "h"), ("k4", "four"), ("unused", "u")], ["ip", "note"])
    got = lookup(big, dim, "ip", max_rows, hot_rows).select("id", "ip", "note").collect()
    assert len(got) == 3000 and len({r.id for r in got}) == 3000
    assert all(r.note == {"hot": "h", "k4": "four"}.get(r.ip) for r in got)


def test_lists_beyond_the_bound(spark):
    d = spark.range(200).selectExpr("id", "concat('10.0.0.', id % 4) AS source_ip")
    white = spark.createDataFrame([("10.0.0.1", None)], "ip_address string, reason string")
    black = spark.createDataFrame([("10.0.0.2", "bad"), ("10.0.0.1", "both")], "ip_address string, reason string")
    small = reputation.with_reputation(d, white, black)
    large = reputation.with_reputation(d, white, black, max_rows=0)
    order = sorted(small.columns)
    assert sorted(map(tuple, small.select(*order).collect()), key=str) == sorted(
        map(tuple, large.select(*order).collect()), key=str)


def test_address_on_both_lists_ends_blocked(spark):
    lists = {n: spark.createDataFrame([(x,) for x in v], "ip_address string")
             for n, v in {"now": ["a", "z"], "white": ["a", "b"], "black": ["b", "c"]}.items()}
    got = dict(map(tuple, reputation.reconcile(lists["now"], lists["white"], lists["black"]).collect()))
    assert got == {"a": "ALLOW", "b": "BLOCK", "c": "BLOCK", "z": "REMOVE"}


def test_list_import(spark):
    rows = [(1, " 1.1.1.1", "first"), (2, "1.1.1.1", "second"), (3, "bad", ""), (4, "::1", None), (5, "2.2.2.2", "x")]
    incoming = spark.createDataFrame(rows, "line int, ip_address string, reason string")
    existing = spark.createDataFrame([("2.2.2.2",)], "ip_address string")
    fresh, counts = reputation.import_list(incoming, existing, "line")
    assert sorted(map(tuple, fresh.collect())) == [("1.1.1.1", "first"), ("::1", "")]
    assert tuple(counts.first()) == (2, 3)


@pytest.mark.parametrize("rows, expected", [
    ([("1", True, "approved"), ("2", False, "approved"), ("3", True, "pending")], {"1"}),
    ([("2", False, "approved")], set()), ([], {"spare"})])
def test_recipients(spark, rows, expected):
    subs = spark.createDataFrame(rows, "chat_id string, is_active boolean, status string")
    assert {r[0] for r in outbox.recipients(subs, ["spare"]).collect()} == expected


def test_slices_of_one_group(spark):
    df = spark.range(1000).selectExpr("'g' AS g", "id", "id % 10 AS v")
    cut = Slices(df, ["g"], ["id"], "one-group", 6)
    assert cut.df.select("_slice").distinct().count() > 1
    assert cut.numbered("pos").filter("pos <> id + 1").count() == 0
    prev = cut.done(cut.previous(["v"]))
    assert prev.filter("id > 0 AND prev_v <> (id - 1) % 10").count() == 0
    assert prev.filter("prev_v IS NULL").count() == 1
    expected = {i: sum(j % 10 for j in range(i + 1)) for i in range(1000)}
    assert all(r.run == expected[r.id] for r in cut.running_sum("v", "run").collect())


def test_tagging_keeps_columns_named_like_internals(spark):
    from flowtide.operators.gaps import tag_sessions
    df = events(spark, [0, 1, 30]).withColumn("n", F.lit(7)).withColumn("slot", F.lit("s"))
    got = tag_sessions(df, ["source_ip"], "created_at", 600, "opened").orderBy("id").collect()
    assert [(r.n, r.slot, r.opened) for r in got] == [
        (7, "s", T0), (7, "s", T0), (7, "s", T0 + dt.timedelta(minutes=30))]
