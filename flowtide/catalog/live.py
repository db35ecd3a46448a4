"""Streaming queries, drained over the event table read as a stream."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from flowtide import driver_tables as dt
from flowtide.catalog import _shared as sh, files
from flowtide.catalog.ansi import sql
from flowtide.operators import alerts, reputation
from flowtide.plans.audit import Reputation
from flowtide.plans.models import FlowModel, rule_scorer
from flowtide.session import scratch_path
from flowtide.streaming import flow_state, live, windows
from flowtide.streaming.alert_table import AlertTable

W = dt.ALERT_WINDOW_MINUTES


def _events(spark, sf):
    schema = dt.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _detections(spark, sf):
    return dt.project_detections(_events(spark, sf))


def _alertable(spark, sf, detections=None):
    """Live detections with reputation. Lists are static, so their size can be checked."""
    reputed = reputation.with_reputation(_detections(spark, sf) if detections is None else detections, dt.whitelist(spark, sf),
                                         dt.blacklist(spark, sf), sh.protected(spark, sf))
    return alerts.alertable(reputed)


def _events_in_parts(spark, sf, parts: int = 4, ordered: bool = True):
    """(stream, feeds): the detections as a stream that grows by one part at a time, cut by event time, or by id."""
    path = scratch_path(spark, "events-in-parts")
    events = dt.table(spark, sf, "events")
    if ordered:
        bounds = events.select(F.percentile_approx("ts", [(i + 1) / parts for i in range(parts - 1)]).alias("b")).first()["b"]
        part = sum(((F.col("ts") > F.lit(b)).cast("int") for b in bounds), F.lit(0))
    else:
        part = F.col("event_id") % parts
    feeds = [lambda i=i: events.filter(part == i).write.mode("append").parquet(path) for i in range(parts)]
    feeds[0]()
    stream = spark.readStream.schema(events.schema).parquet(path)
    return dt.project_detections(stream), [lambda: None, *feeds[1:]]


def _ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def minute_volume(spark, sf):
    d = _detections(spark, sf)
    out = windows.tumbling_counts(d, "created_at", "5 minutes", "1 minute", "attack_type")
    return _ntz(live.drain(out, "tumbling"), "window_start")


def rate(spark, sf):
    out = windows.sliding_rate(_detections(spark, sf), "created_at", "1 minute")
    return _ntz(live.drain(out, "sliding"), "window_start")


def deduplicated(spark, sf):
    """Repeats of a user's event type within an hour-wide watermark id are dropped by id."""
    d = _detections(spark, sf)
    once = windows.without_duplicates(d, ["id"], "created_at", "1 hour")
    return live.drain(once.select("id", "source_ip"), "dedup")


def macros(spark, sf):
    d = _detections(spark, sf).select(
        F.col("source_ip").alias("src_ip"), "created_at", F.col("value").alias("Flow Duration"),
        (F.col("k") * 1.0).alias("Fwd IAT Mean"), F.col("value").alias("Fwd IAT Std"))
    out = windows.macro_stream(d, "created_at", ["Flow Duration", "Fwd IAT Mean", "Fwd IAT Std"], ["src_ip"],
                               "1 hour", "1 minute", min_members=1)
    got = _ntz(live.drain(out, "macro"), "window_start")
    return got.select("src_ip", "window_start", "member_count",
                      sh.rounded(F.col("`Flow Duration`")).alias("dur"),
                      sh.rounded(F.col("`Fwd IAT Mean`")).alias("iat"),
                      sh.rounded(F.col("`Fwd IAT Std`"), 3).alias("spread"))


def macros_far_from_zero(spark, sf):
    """Gap windows over several micro-batches, with spreads of a few units around 1e8."""
    events, feeds = _events_in_parts(spark, sf)
    shown = events.select(
        F.col("source_ip").alias("src_ip"), "created_at", (F.col("k") % 3 + 1.0).alias("Total Fwd Packets"),
        (F.lit(1e8) + F.col("k") % 5 * 0.25).alias("Fwd IAT Std"))
    out = windows.macro_stream(shown, "created_at", ["Total Fwd Packets", "Fwd IAT Std"], ["src_ip"], "1 hour", "1 minute",
                               min_members=1)
    got = _ntz(live.drain(out, "macro-far", feeds), "window_start")
    return got.select("src_ip", "window_start", "member_count", sh.rounded(F.col("`Fwd IAT Std`"), 3).alias("spread"))


def packet_flow_stream(spark, sf):
    """Flows of a packet stream in three parts, as soon as they have been silent for the idle limit."""
    events, feeds = _events_in_parts(spark, sf, 3)
    out = flow_state.flow_stream(files.packets_of(events), idle=files.IDLE, activity=3600, delay="1 minute")
    return files.shown_flows(_ntz(live.drain(out, "packet-flows", feeds), "flow_start"))


def alert_table(spark, sf):
    out = windows.alert_stream(_alertable(spark, sf), W, "1 minute")
    return _ntz(live.drain(out, "alerts"), "first_seen", "last_seen")


def alert_transitions(spark, sf):
    """Events of a stream in two parts, the second counted on from the stored alerts."""
    detections, feeds = _events_in_parts(spark, sf, 2)
    table = AlertTable(scratch_path(spark, "alert-table"), W, buckets=8)
    live.drain_batches(_alertable(spark, sf, detections), "transitions", table.update, feeds)
    return table.events(spark).select("source_ip", "threat_type", "kind", "occurrence", "alert_id", "id")


def alert_upsert(spark, sf):
    """The table after three parts that interleave in time, the last one processed twice."""
    detections, feeds = _events_in_parts(spark, sf, 3, ordered=False)
    table = AlertTable(scratch_path(spark, "alert-table"), W, buckets=8)

    def process(batch, batch_id):
        for _ in range(2 if batch_id == 2 else 1):
            table.update(batch, batch_id)
    live.drain_batches(_alertable(spark, sf, detections), "upsert", process, feeds)
    return _ntz(table.read(spark), "first_seen", "last_seen").select(
        "source_ip", "threat_type", "detection_id", "occurrences", "first_seen", "last_seen")


def pipeline(spark, sf):
    """The whole live job on the event stream: verdict counts by severity and log level."""
    e = _events(spark, sf).select(
        F.col("event_id").alias("flow_id"), F.col("ts").alias("created_at"), dt.user_ip("user_id").alias("Src IP"),
        F.col("value").alias("Flow Duration"), (F.col("user_id") % 10).cast("double").alias("SYN Flag Count"))
    model = FlowModel("rule", ["Flow Duration", "SYN Flag Count"], ["BENIGN", "DDoS"],
                      rule_scorer("array(1 - least(`Flow Duration` / 100, 1D), least(`Flow Duration` / 100, 1D))"))
    job = live.LivePipeline(model, scratch_path(spark, "live"), Reputation(
        dt.whitelist(spark, sf), dt.blacklist(spark, sf), sh.protected(spark, sf)), window_minutes=W)
    job.start(e, once=True).awaitTermination()
    detections = spark.read.parquet(job.path("detections"))
    logs = spark.read.parquet(job.path("logs"))
    by_severity = detections.groupBy(F.col("severity").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    by_level = logs.groupBy(F.col("level").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    opened = job.alerts(spark).agg(F.sum("occurrences").alias("n")).select(F.lit("alerted").alias("item"), "n")
    return by_severity.union(by_level).union(opened)


def live_tables(spark, sf):
    """The live job in two parts with its listener: what it counted, and the rows and bytes of its tables. Raw rows are kept by a
    query of their own; rows older than an hour before the newest event of earlier parts are set aside."""
    events, feeds = _events_in_parts(spark, sf, 2, ordered=False)
    flows = events.select(F.col("id").alias("flow_id"), "created_at", F.col("source_ip").alias("Src IP"), F.col("value").alias("Flow Duration"),
                          (F.col("user_id") % 10).cast("double").alias("SYN Flag Count"), F.col("k").cast("double").alias("Total Fwd Packets"))
    model = FlowModel("rule", ["Flow Duration", "SYN Flag Count"], ["BENIGN", "DDoS"],
                      rule_scorer("array(1 - least(`Flow Duration` / 100, 1D), least(`Flow Duration` / 100, 1D))"))
    job = live.LivePipeline(model, scratch_path(spark, "live-tables"), late_after_seconds=3600)
    seen = live.Progress("live-raw")
    spark.streams.addListener(seen)
    try:
        for feed in feeds:
            feed()
            job.start_raw(flows, once=True).awaitTermination()
            job.start(flows, once=True).awaitTermination()
        counted = _when_counted(seen, dt.table(spark, sf, "events").count())
    finally:
        spark.streams.removeListener(seen)
    rows = {t: spark.read.parquet(job.path(t)).count() for t in ("raw", "cleaned", "detections", "late")}
    sizes = job.stored_bytes(spark)
    facts = {**{f"{t}_rows": n for t, n in rows.items()}, "flows": counted["flows"], "packets": counted["packets"], "batches": counted["batches"],
             "tables_with_bytes": sum(sizes[t] > 0 for t in rows), "newest": job.recent(spark, 50).count(), "errors": int(counted["last_error"] is not None)}
    return spark.createDataFrame(list(facts.items()), "item string, n long")


def _when_counted(seen, rows: int, seconds: int = 30):
    """The listener's counters, once its events have caught up with the query."""
    for _ in range(seconds * 10):
        if seen.counters().get("input_rows", 0) >= rows and not seen.is_running:
            break
        time.sleep(0.1)
    return seen.counters()


# Append mode emits a window once the watermark (latest event minus the delay) has passed its end.
_MARK = "(SELECT max(ts) - INTERVAL 1 MINUTE FROM events)"

ENTRIES = {
    "stream_tumbling_volume": (minute_volume, sql("det", f"""
        SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS window_start, attack_type, count(*) AS n
        FROM det GROUP BY 1, 2 HAVING window_start + INTERVAL 5 MINUTE <= {_MARK}""")),
    "stream_sliding_rate": (rate, sql("det", f"""
        SELECT bucket - b * INTERVAL 10 SECOND AS window_start, count(*) AS n
        FROM (SELECT time_bucket(INTERVAL 10 SECOND, created_at) AS bucket FROM det), range(6) r(b) GROUP BY 1
        HAVING window_start + INTERVAL 1 MINUTE <= {_MARK}""")),
    "stream_deduplicate": (deduplicated, sql("det", "SELECT DISTINCT id, source_ip FROM det")),
    "stream_macro_windows": (macros, sql("det", f"""
        SELECT source_ip AS src_ip, min(created_at) AS window_start, count(*) AS member_count,
          round(sum(value) + 1e-7, 4) AS dur, round(avg(k) + 1e-7, 4) AS iat,
          round(CASE WHEN count(*) <= 1 THEN 0 ELSE stddev_pop(value) END + 1e-7, 3) AS spread
        FROM (SELECT *, sum(opens) OVER (PARTITION BY source_ip ORDER BY created_at, id) AS session
          FROM (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY source_ip
            ORDER BY created_at, id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM det))
        GROUP BY source_ip, session HAVING max(created_at) + INTERVAL 1 HOUR <= {_MARK}""")),
    "stream_macro_far_values": (macros_far_from_zero, sql("det", f"""
        SELECT source_ip AS src_ip, min(created_at) AS window_start, count(*) AS member_count,
          round(round(CASE WHEN sum(w) <= 1 THEN 0 ELSE sqrt(sum(w * (x - centre) ** 2) / sum(w)) END, 6) + 1e-7, 3) AS spread
        FROM (SELECT *, sum(x * w) OVER (PARTITION BY source_ip, session) / sum(w) OVER (PARTITION BY source_ip, session) AS centre
          FROM (SELECT *, k % 3 + 1.0 AS w, 1e8 + k % 5 * 0.25 AS x, sum(opens) OVER (PARTITION BY source_ip ORDER BY created_at, id) AS session
            FROM (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY source_ip
              ORDER BY created_at, id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM det)))
        GROUP BY source_ip, session HAVING max(created_at) + INTERVAL 1 HOUR <= {_MARK}""")),
    "stream_live_tables": (live_tables, sql("det", """
        SELECT item, CAST(n AS BIGINT) AS n FROM (
          SELECT 'raw_rows' AS item, count(*) AS n FROM det UNION ALL SELECT 'flows', count(*) FROM det
          UNION ALL SELECT 'cleaned_rows', count(*) FROM det WHERE NOT late UNION ALL SELECT 'detections_rows', count(*) FROM det WHERE NOT late
          UNION ALL SELECT 'late_rows', count(*) FROM det WHERE late UNION ALL SELECT 'packets', sum(k) FROM det
          UNION ALL SELECT 'batches', 2 UNION ALL SELECT 'tables_with_bytes', 4
          UNION ALL SELECT 'newest', least(50, count(*)) FROM det WHERE NOT late UNION ALL SELECT 'errors', 0)"""
        .replace("FROM det", "FROM staged"), staged="""SELECT *, coalesce(created_at < edge - INTERVAL 1 HOUR, FALSE) AS late FROM (
          SELECT *, CASE WHEN id % 2 = 1 THEN (SELECT max(created_at) FROM det WHERE id % 2 = 0) END AS edge FROM det)""")),
    "stream_packet_flows": (packet_flow_stream, files.flow_sql(f"HAVING max(ts) + INTERVAL 6 HOUR < {_MARK}")),
    "stream_alerts": (alert_table, sql("alerts", f"""
        SELECT source_ip, threat_type, occurrences, first_seen, last_seen, detection_id FROM alerts
        WHERE last_seen + INTERVAL {W} MINUTE <= (SELECT max(created_at) - INTERVAL 1 MINUTE FROM alertable)""")),
    "stream_alert_transitions": (alert_transitions, sql("occ", """
        SELECT source_ip, threat_type, CASE WHEN occurrence = 1 THEN 'NEW' ELSE 'ESCALATION' END AS kind,
          occurrence, alert_id, id FROM occ WHERE occurrence IN (1, 5, 10, 25, 50, 100)""")),
    "stream_alert_upsert": (alert_upsert, sql("alerts", """
        SELECT source_ip, threat_type, detection_id, occurrences, first_seen, last_seen FROM alerts""")),
    "stream_live_pipeline": (pipeline, sql("rep", """
        SELECT CASE WHEN is_blacklisted AND NOT is_protected THEN 'CRITICAL' WHEN c < 0.5 THEN ''
            WHEN c >= 0.9 THEN 'CRITICAL' WHEN c >= 0.7 THEN 'HIGH' ELSE 'MEDIUM' END AS item, count(*) AS n
        FROM v GROUP BY 1 UNION ALL
        SELECT CASE WHEN c >= 0.5 THEN 'WARNING' ELSE 'INFO' END, count(*) FROM v GROUP BY 1 UNION ALL
        SELECT 'alerted', count(*) FROM v WHERE NOT is_whitelisted AND NOT is_protected
          AND (is_blacklisted OR c >= 0.5)""", v="SELECT *, least(value / 100, 1) AS c FROM rep")),
}
