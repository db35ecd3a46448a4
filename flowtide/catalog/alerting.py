"""Alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide import driver_tables as dt
from flowtide.catalog import _shared as sh
from flowtide.catalog.ansi import sql
from flowtide.operators import alerts, outbox
from flowtide.operators.decide import severity_of
from flowtide.operators.registry import resolve_model_name

W = dt.ALERT_WINDOW_MINUTES
_ALERT_COLS = ["source_ip", "threat_type", "detection_id", "occurrences", "first_seen", "last_seen",
               "is_acknowledged"]


def policy(spark, sf):
    return (sh.reputed(spark, sf).withColumn("alert_action", alerts.alert_action())
            .groupBy("alert_action").agg(F.count(F.lit(1)).alias("n")))


def threat_types(spark, sf):
    return sh.alertable(spark, sf).select("id", "source_ip", "threat_type", "alert_action")


def sessions(spark, sf):
    return sh.stored_alerts(spark, sf).select(*_ALERT_COLS)


def transitions(spark, sf):
    return alerts.alert_events(sh.alertable(spark, sf), W).select(
        "id", "alert_id", "source_ip", "threat_type", "kind", "occurrence", "created_at")


def counters(spark, sf):
    return alerts.numbered_events(sh.alertable(spark, sf), W).select(
        "id", "source_ip", "threat_type", "occurrence")


def latest(spark, sf):
    return alerts.latest_per_key(sh.stored_alerts(spark, sf)).select(*_ALERT_COLS)


def active_lookup(spark, sf):
    probes = (dt.detections(spark, sf).filter("prediction <> 0")
              .groupBy("source_ip", F.col("attack_type").alias("threat_type"))
              .agg(F.min("created_at").alias("at")))
    probes = probes.withColumn("at", F.col("at") + F.expr("INTERVAL 29 DAYS"))
    return alerts.open_alert(sh.stored_alerts(spark, sf), probes, W).select(
        "source_ip", "threat_type", "detection_id", "occurrences")


def recent(spark, sf):
    return (sh.stored_alerts(spark, sf).orderBy(F.desc("last_seen"), F.desc("detection_id")).limit(10)
            .select("detection_id", "source_ip", "threat_type", "occurrences", "last_seen",
                    F.when(F.col("is_acknowledged"), "Acknowledged").otherwise("Active").alias("status")))


def unacknowledged(spark, sf):
    return (sh.stored_alerts(spark, sf).orderBy(F.desc("last_seen"), F.desc("detection_id")).limit(300)
            .filter("NOT is_acknowledged").select("detection_id", "source_ip", "occurrences"))


def active_count(spark, sf):
    return sh.stored_alerts(spark, sf).agg(F.count_if(~F.col("is_acknowledged")).alias("active"))


def with_detection(spark, sf):
    opened = dt.detections(spark, sf).select(
        F.col("id").alias("detection_id"), "destination_ip", "confidence", "model_id")
    joined = sh.stored_alerts(spark, sf).join(opened, "detection_id", "left")
    return resolve_model_name(joined, dt.models(spark, sf), prefix="Model ID: ").select(
        "detection_id", "threat_type", "destination_ip", "confidence", F.col("model_name").alias("model"))


def upsert(spark, sf):
    """Alerts of the first half of the month folded with those of the second half."""
    events = sh.alertable(spark, sf)
    early = alerts.alerts(events.filter("created_at < timestamp_ntz'2024-01-15 00:00:00'"), W)
    late = alerts.alerts(events.filter("created_at >= timestamp_ntz'2024-01-15 00:00:00'"), W)
    return alerts.fold_alerts(early, late, W).select(*[c for c in _ALERT_COLS if c != "is_acknowledged"])


def top_attackers(spark, sf):
    """Which sources attacked, how often, when last, and who escalated."""
    a = sh.stored_alerts(spark, sf)
    return (a.groupBy("source_ip").agg(
        F.count(F.lit(1)).alias("alerts"), F.sum("occurrences").alias("events"),
        F.max("last_seen").alias("last_seen"),
        F.count_if(F.col("occurrences") >= 5).alias("escalated"))
        .orderBy(F.desc("events"), "source_ip").limit(25))


def recipients(spark, sf):
    return outbox.recipients(dt.subscribers(spark, sf), ["fallback"])


def outgoing(spark, sf):
    events = alerts.alert_events(_graded(spark, sf), W)
    return outbox.compose(events, outbox.recipients(dt.subscribers(spark, sf), ["fallback"])).select(
        "alert_id", "id", "kind", "chat_id", "occurrence", "severity", "message")


def _graded(spark, sf):
    named = resolve_model_name(sh.alertable(spark, sf), dt.models(spark, sf))
    severity = F.when(F.col("is_blacklisted"), "CRITICAL").otherwise(
        severity_of(F.col("confidence"), F.col("prediction") != 0))
    reason = F.when(F.col("is_blacklisted"), F.coalesce("block_reason", F.lit("listed <no reason>")))
    return named.withColumns({"severity": severity, "reason": reason})


_MESSAGE = """
SELECT o.alert_id, o.id, o.kind, r.chat_id, o.occurrence, o.severity,
  concat_ws(chr(10),
    CASE kind WHEN 'NEW' THEN '🚨 <b>Flow analytics THREAT DETECTED</b>'
      ELSE '📈 <b>Flow analytics THREAT ESCALATION</b>' END, '',
    '┌ ' || CASE severity WHEN 'CRITICAL' THEN '🔴' WHEN 'HIGH' THEN '🟠' WHEN 'MEDIUM' THEN '🟡' ELSE '🟢' END
      || ' <b>Severity:</b> <code>' || severity || '</code>',
    '├ <b>Alert ID:</b> <code>#' || alert_id || '</code>',
    CASE kind WHEN 'ESCALATION' THEN '├ <b>Occurrences:</b> <code>' || occurrence || '</code>' END,
    '├ <b>Timestamp:</b> <code>' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || '</code>',
    '├ <b>Threat Type:</b> <code>' || threat_type || '</code>',
    '├ <b>Source IP:</b> <code>' || source_ip || '</code>',
    '├ <b>Destination IP:</b> <code>' || destination_ip || '</code>',
    '├ <b>Inference Model:</b> <code>' || model_name || '</code>',
    '├ <b>Confidence:</b> <code>' || printf('%.2f%%', confidence * 100.0) || '</code>',
    '├ <b>Source Type:</b> <code>' || upper(source_type) || '</code>',
    '├ <b>Reason:</b> ' || replace(replace(replace(reason, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
    '└──────────────────────────────', '',
    CASE WHEN kind = 'NEW' THEN '⚠️ <b>Recommended Actions:</b>'
      ELSE '⚠️ This threat has been observed <b>' || occurrence || ' times</b>. Consider escalating response.' END,
    CASE WHEN kind = 'NEW' THEN CASE WHEN severity = 'CRITICAL' THEN
      '  1) <b>Immediate containment</b> — isolate source host' || chr(10) ||
      '  2) Block IP at perimeter firewall' || chr(10) || '  3) Capture full packet trace for forensics'
      WHEN severity IN ('HIGH', 'MEDIUM') THEN
      '  1) Investigate source IP activity logs' || chr(10) || '  2) Monitor lateral movement attempts'
      || chr(10) || '  3) Review related alerts in dashboard'
      ELSE '  1) Review alert in Flow analytics dashboard' || chr(10) ||
      '  2) Cross-reference with threat intelligence feeds' END END) AS message
FROM (SELECT occ.*, CASE WHEN occurrence = 1 THEN 'NEW' ELSE 'ESCALATION' END AS kind,
    coalesce(m.name, 'unresolved_model_' || model_id) AS model_name,
    CASE WHEN is_blacklisted THEN coalesce(block_reason, 'listed <no reason>') END AS reason,
    CASE WHEN is_blacklisted THEN 'CRITICAL' WHEN confidence >= 0.9 THEN 'CRITICAL'
      WHEN confidence >= 0.7 THEN 'HIGH' WHEN confidence >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity
  FROM occ LEFT JOIN models m ON occ.model_id = m.id WHERE occurrence IN (1, 5, 10, 25, 50, 100)) o
CROSS JOIN (SELECT chat_id FROM subs WHERE is_active AND status = 'approved') r"""

_HALF = f"""
SELECT source_ip, threat_type, min(alert_id) AS detection_id, count(*) AS occurrences,
  min(created_at) AS first_seen, max(created_at) AS last_seen
FROM occ GROUP BY source_ip, threat_type, session"""

ENTRIES = {
    "alert_policy": (policy, sql("rep", """
        SELECT CASE WHEN is_whitelisted THEN 'suppressed_whitelist'
          WHEN is_protected THEN 'suppressed_protected' WHEN is_blacklisted THEN 'forced'
          WHEN prediction = 0 THEN 'none' ELSE 'aggregate' END AS alert_action, count(*) AS n
        FROM rep GROUP BY 1""")),
    "alert_threat_type": (threat_types, sql(
        "alertable", "SELECT id, source_ip, threat_type, alert_action FROM alertable")),
    "alert_sessions": (sessions, sql("alerts", f"SELECT {', '.join(_ALERT_COLS)} FROM alerts")),
    "alert_transitions": (transitions, sql("occ", """
        SELECT id, alert_id, source_ip, threat_type,
          CASE WHEN occurrence = 1 THEN 'NEW' ELSE 'ESCALATION' END AS kind, occurrence, created_at
        FROM occ WHERE occurrence IN (1, 5, 10, 25, 50, 100)""")),
    "alert_occurrence_counter": (counters, sql(
        "occ", "SELECT id, source_ip, threat_type, occurrence FROM occ")),
    "alert_latest_per_key": (latest, sql("alerts", f"""
        SELECT {', '.join(_ALERT_COLS)} FROM (SELECT *, row_number() OVER (PARTITION BY source_ip,
          threat_type ORDER BY last_seen DESC, detection_id DESC) AS rn FROM alerts) WHERE rn = 1""")),
    "alert_active_lookup": (active_lookup, sql("alerts", f"""
        SELECT p.source_ip, p.threat_type, a.detection_id, a.occurrences FROM (
          SELECT source_ip, attack_type AS threat_type, min(created_at) + INTERVAL 29 DAY AS at
          FROM det WHERE prediction <> 0 GROUP BY 1, 2) p
        LEFT JOIN LATERAL (SELECT detection_id, occurrences FROM alerts a
          WHERE a.source_ip = p.source_ip AND a.threat_type = p.threat_type
            AND a.last_seen >= p.at - INTERVAL {W} MINUTE
          ORDER BY last_seen DESC, detection_id DESC LIMIT 1) a ON TRUE""")),
    "alert_recent": (recent, sql("alerts", """
        SELECT detection_id, source_ip, threat_type, occurrences, last_seen,
          CASE WHEN is_acknowledged THEN 'Acknowledged' ELSE 'Active' END AS status
        FROM alerts ORDER BY last_seen DESC, detection_id DESC LIMIT 10""")),
    "alert_unacknowledged": (unacknowledged, sql("alerts", """
        SELECT detection_id, source_ip, occurrences FROM (SELECT * FROM alerts
          ORDER BY last_seen DESC, detection_id DESC LIMIT 300) WHERE NOT is_acknowledged""")),
    "alert_active_count": (active_count, sql(
        "alerts", "SELECT count(*) FILTER (WHERE NOT is_acknowledged) AS active FROM alerts")),
    "alert_with_detection": (with_detection, sql("alerts models", """
        SELECT a.detection_id, a.threat_type, d.destination_ip, d.confidence,
          coalesce(m.name, 'Model ID: ' || d.model_id) AS model
        FROM alerts a LEFT JOIN det d ON a.detection_id = d.id LEFT JOIN models m ON d.model_id = m.id""")),
    "alert_upsert": (upsert, sql("occ", _HALF)),
    "alert_top_attackers": (top_attackers, sql("alerts", """
        SELECT source_ip, count(*) AS alerts, CAST(sum(occurrences) AS BIGINT) AS events,
          max(last_seen) AS last_seen, count(*) FILTER (WHERE occurrences >= 5) AS escalated
        FROM alerts GROUP BY source_ip ORDER BY events DESC, source_ip LIMIT 25""")),
    "outbox_recipients": (recipients, sql(
        "subs", "SELECT chat_id FROM subs WHERE is_active AND status = 'approved'")),
    "outbox_messages": (outgoing, sql("occ models subs", _MESSAGE)),
}
