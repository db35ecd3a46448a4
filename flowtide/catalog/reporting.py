"""Dashboard, log, metric and registry queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from flowtide import driver_tables as dt
from flowtide.catalog import _shared as sh
from flowtide.catalog.ansi import AT, sql
from flowtide.functions.scalars import bytes_to_kb
from flowtide.operators import metrics, registry, reports


def _ntz(column: str):
    return F.col(column).cast("timestamp_ntz").alias(column)


def recent_detections(spark, sf):
    return reports.recent(dt.detections(spark, sf), 50).select("id", "source_ip", "prediction")


def recent_attacks(spark, sf):
    return reports.recent(dt.detections(spark, sf), 50, only_attacks=True).select("id", "attack_type")


def activity(spark, sf):
    return reports.activity(dt.detections(spark, sf), dt.as_of())


def count_since(spark, sf):
    start = dt.as_of() - F.expr("INTERVAL 6 DAYS")
    return (reports.since(dt.detections(spark, sf), start).groupBy("attack_type")
            .agg(F.count(F.lit(1)).alias("n")))


def rolling(spark, sf):
    return reports.rolling_rate(dt.detections(spark, sf)).select(_ntz("window_start"), "n")


def traffic_timeline(spark, sf, limit=None):
    return reports.traffic_timeline(dt.detections(spark, sf), limit).select(_ntz("bucket"), "state", "volume")


def attack_timeline(spark, sf, limit=None):
    return reports.attack_timeline(dt.detections(spark, sf), limit).select(_ntz("bucket"), "attack", "n")


def histogram(spark, sf, limit=None):
    return reports.confidence_histogram(reports.newest_attacks(dt.detections(spark, sf), limit))


def distribution(spark, sf, limit=None):
    d = reports.attack_distribution(reports.newest_attacks(dt.detections(spark, sf), limit))
    return d.withColumn("share", sh.rounded(F.col("share")))


def attack_counts(spark, sf):
    return dt.detections(spark, sf).groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"))


def live_ratio(spark, sf, limit=None):
    return reports.live_ratio(dt.detections(spark, sf), limit).withColumn("ratio", sh.rounded(F.col("ratio")))


def log_search(spark, sf):
    return reports.search_logs(dt.logs(spark, sf), "SYSTEM", "ERROR", "portSCAN").select(
        "id", "message", "created_at")


def firewall_audit(spark, sf):
    return reports.search_logs(dt.logs(spark, sf), "SYSTEM", text="[FIREWALL]", limit=100).select(
        "id", "level", "message")


def text_search(spark, sf):
    """The same substring search over whole document texts."""
    docs = dt.table(spark, sf, "documents").withColumnRenamed("text", "message")
    return reports.filter_logs(docs, text="the").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def log_counts(spark, sf):
    return reports.log_counts(dt.logs(spark, sf))


def error_count(spark, sf):
    return reports.error_count(dt.logs(spark, sf))


def sources_by_count(spark, sf):
    return reports.sources_by_count(dt.logs(spark, sf))


def log_markers(spark, sf):
    lines = dt.logs(spark, sf).select(F.concat_ws(" ", "created_at", F.concat(F.lit("|"), F.lit(" ")), "level",
                                                  F.lit("|"), "message").alias("value"))
    return reports.marker_counts(lines)


def table_counts(spark, sf):
    return (reports.table_count(dt.whitelist(spark, sf), "whitelist")
            .union(reports.table_count(dt.blacklist(spark, sf), "blacklist"))
            .union(reports.table_count(dt.subscribers(spark, sf), "subscribers")))


def throughput(spark, sf):
    out = metrics.throughput(dt.metrics(spark, sf))
    return out.select("id", "network_sent_bytes_delta", "network_recv_bytes_delta",
                      sh.rounded(bytes_to_kb(F.col("network_sent_bytes_delta"))).alias("sent_kb"))


def metric_history(spark, sf):
    return metrics.newest_ascending(dt.metrics(spark, sf), 60).select("id", "cpu_percent", "created_at")


def metric_bands(spark, sf):
    m = dt.metrics(spark, sf)
    return m.select(metrics.band(F.col("cpu_percent")).alias("cpu"),
                    metrics.band(F.col("ram_percent")).alias("ram"),
                    metrics.band(F.col("disk_percent")).alias("disk")).groupBy("cpu", "ram", "disk").agg(
        F.count(F.lit(1)).alias("n"))


def retention(spark, sf):
    kept, pruned = metrics.retain(dt.metrics(spark, sf), dt.as_of(), 240)
    return (kept.agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("oldest"))
            .withColumn("pruned", pruned.scalar()))


def stability(spark, sf):
    out = metrics.stability(dt.metrics(spark, sf), "cpu_percent", "ram_percent")
    return out.select("cycles", "start_value", "end_value", sh.rounded(F.col("mean_duration")).alias("mean_duration"),
                      sh.rounded(F.col("growth")).alias("growth"),
                      sh.rounded(F.col("growth_per_hour"), 6).alias("growth_per_hour"), "leak_suspected")


def registry_status(spark, sf):
    return registry.status(dt.models(spark, sf), sh.stored_alerts(spark, sf))


def model_activate(spark, sf):
    return registry.activate(dt.models(spark, sf), 7, exclusive=True).select("id", "is_active")


def model_add_active(spark, sf):
    changed = registry.activate(dt.models(spark, sf), 8, exclusive=False)
    return registry.active(registry.deactivate(changed, 2)).select("id", "name")


def model_macro(spark, sf):
    fallback = registry.macro_model(dt.models(spark, sf), 99).select(F.lit("fallback").alias("kind"), "id")
    chosen = registry.macro_model(dt.models(spark, sf), 3).select(F.lit("configured").alias("kind"), "id")
    return fallback.union(chosen)


def model_register(spark, sf):
    regions = dt.table(spark, sf, "region").select(
        F.col("r_name").alias("name"), F.concat(F.lit("models/"), "r_name").alias("file_path"),
        F.lit(False).alias("is_active"))
    return registry.newest_first(registry.register(dt.models(spark, sf), regions)).select("id", "name", "is_active")


def list_edit(spark, sf):
    out = registry.edit(dt.blacklist(spark, sf), "id", 3, reason=F.lit("edited"))
    return registry.delete(out, "id", 7).select("id", "ip_address", "reason")


def point_lookup(spark, sf):
    by_ip = registry.by_key(dt.whitelist(spark, sf), "ip_address", "10.0.0.20").select(
        F.lit("ip").alias("kind"), "id")
    by_name = registry.by_key(dt.models(spark, sf), "name", "NATION_4").select(F.lit("name"), "id")
    by_chat = registry.by_key(dt.subscribers(spark, sf), "status", "pending").select(F.lit("status"), "id")
    return by_ip.union(by_name).union(by_chat)


_ALL_ATTACKS = "SELECT * FROM det WHERE prediction <> 0"
_ATT = "SELECT * FROM det WHERE prediction <> 0 ORDER BY created_at DESC, id DESC LIMIT 2000"

ENTRIES = {
    "recent_detections": (recent_detections, sql("det", """
        SELECT id, source_ip, prediction FROM det ORDER BY created_at DESC, id DESC LIMIT 50""")),
    "recent_attacks": (recent_attacks, sql("det", """SELECT id, attack_type FROM det WHERE prediction <> 0
        ORDER BY created_at DESC, id DESC LIMIT 50""")),
    "activity_counts": (activity, sql("det", f"""
        SELECT count(*) FILTER (WHERE created_at >= {AT} - INTERVAL 24 HOUR) AS flows_24h,
          count(*) FILTER (WHERE created_at >= {AT} - INTERVAL 24 HOUR AND prediction <> 0) AS attacks_24h,
          count(*) FILTER (WHERE created_at >= {AT} - INTERVAL 1 MINUTE) AS per_minute FROM det""")),
    "count_since": (count_since, sql("det", f"""SELECT attack_type, count(*) AS n FROM det
        WHERE created_at >= {AT} - INTERVAL 6 DAY GROUP BY 1""")),
    "rolling_rate": (rolling, sql("det", """
        SELECT bucket - b * INTERVAL 10 SECOND AS window_start, count(*) AS n
        FROM (SELECT time_bucket(INTERVAL 10 SECOND, created_at) AS bucket FROM det), range(6) r(b) GROUP BY 1""")),
    "traffic_timeline": (traffic_timeline, sql("det", """
        SELECT date_trunc('minute', created_at) AS bucket, CASE WHEN prediction = 0 THEN 'Normal'
          ELSE 'Attack (' || attack_type || ')' END AS state, count(*) AS volume
        FROM det GROUP BY 1, 2""")),
    "attack_timeline": (attack_timeline, sql("det", """
        SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS bucket, attack_type AS attack, count(*) AS n
        FROM att GROUP BY 1, 2""", att=_ALL_ATTACKS)),
    "confidence_histogram": (histogram, sql("det", """
        SELECT CAST(least(floor((confidence - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS n
        FROM att, (SELECT min(confidence) AS lo, max(confidence) AS hi FROM att) GROUP BY 1""", att=_ALL_ATTACKS)),
    "attack_distribution": (distribution, sql("det", """
        SELECT attack_type AS attack, count(*) AS n,
          round(count(*) * 100.0 / (SELECT count(*) FROM att) + 1e-7, 4) AS share FROM att GROUP BY 1""", att=_ALL_ATTACKS)),
    "live_threat_ratio": (live_ratio, sql("det", """
        SELECT count(*) AS flows, count(*) FILTER (WHERE prediction <> 0) AS threats,
          round(count(*) FILTER (WHERE prediction <> 0) * 100.0 / count(*) + 1e-7, 4) AS ratio
        FROM det""")),
    "attack_counts": (attack_counts, sql("det", "SELECT attack_type, count(*) AS n FROM det GROUP BY 1")),
    "newest_traffic_timeline": (partial(traffic_timeline, limit=200), sql("det", """
        SELECT date_trunc('minute', created_at) AS bucket, CASE WHEN prediction = 0 THEN 'Normal'
          ELSE 'Attack (' || attack_type || ')' END AS state, count(*) AS volume
        FROM (SELECT * FROM det ORDER BY created_at DESC, id DESC LIMIT 200) GROUP BY 1, 2""")),
    "newest_attack_timeline": (partial(attack_timeline, limit=2000), sql("det", """
        SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS bucket, attack_type AS attack, count(*) AS n
        FROM att GROUP BY 1, 2""", att=_ATT)),
    "newest_confidence_histogram": (partial(histogram, limit=2000), sql("det", """
        SELECT CAST(least(floor((confidence - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS n
        FROM att, (SELECT min(confidence) AS lo, max(confidence) AS hi FROM att) GROUP BY 1""", att=_ATT)),
    "newest_attack_distribution": (partial(distribution, limit=2000), sql("det", """
        SELECT attack_type AS attack, count(*) AS n,
          round(count(*) * 100.0 / (SELECT count(*) FROM att) + 1e-7, 4) AS share FROM att GROUP BY 1""", att=_ATT)),
    "newest_threat_ratio": (partial(live_ratio, limit=200), sql("det", """
        SELECT count(*) AS flows, count(*) FILTER (WHERE prediction <> 0) AS threats,
          round(count(*) FILTER (WHERE prediction <> 0) * 100.0 / count(*) + 1e-7, 4) AS ratio
        FROM (SELECT * FROM det ORDER BY created_at DESC, id DESC LIMIT 200)""")),
    "log_search": (log_search, sql("logs", """
        SELECT id, message, created_at FROM logs WHERE source = 'SYSTEM' AND level = 'ERROR'
          AND message ILIKE '%portSCAN%' ORDER BY created_at DESC, id DESC LIMIT 200""")),
    "firewall_audit": (firewall_audit, sql("logs", """
        SELECT id, level, message FROM logs WHERE source = 'SYSTEM' AND message ILIKE '%[FIREWALL]%'
        ORDER BY created_at DESC, id DESC LIMIT 100""")),
    "text_search": (text_search, "SELECT lang, count(*) AS n FROM documents WHERE text ILIKE '%the%' GROUP BY 1"),
    "log_counts": (log_counts, sql("logs", """
        SELECT level, source, count(*) AS n FROM logs GROUP BY GROUPING SETS ((level), (source), ())""")),
    "log_error_count": (error_count, sql(
        "logs", "SELECT count(*) FILTER (WHERE level IN ('ERROR', 'CRITICAL')) AS errors FROM logs")),
    "log_sources_by_count": (sources_by_count, sql(
        "logs", "SELECT source, count(*) AS n FROM logs GROUP BY 1")),
    "log_text_markers": (log_markers, sql("logs", """
        SELECT 0::BIGINT + count(*) FILTER (WHERE level = 'ERROR') AS errors,
          count(*) FILTER (WHERE level = 'CRITICAL') AS criticals, 0::BIGINT AS tracebacks FROM logs""")),
    "table_counts": (table_counts, sql("white black subs", """
        SELECT 'whitelist' AS item, count(*) AS n FROM white UNION ALL SELECT 'blacklist', count(*) FROM black
        UNION ALL SELECT 'subscribers', count(*) FROM subs""")),
    "metric_throughput": (throughput, sql("metrics", """
        SELECT id, sent AS network_sent_bytes_delta, recv AS network_recv_bytes_delta,
          round(sent / 1024.0 + 1e-7, 4) AS sent_kb FROM (SELECT id,
          coalesce(greatest(0, network_sent_bytes - lag(network_sent_bytes) OVER w), 0) AS sent,
          coalesce(greatest(0, network_recv_bytes - lag(network_recv_bytes) OVER w), 0) AS recv
        FROM metrics WINDOW w AS (ORDER BY created_at, id))""")),
    "metric_history": (metric_history, sql("metrics", """
        SELECT id, cpu_percent, created_at FROM metrics ORDER BY created_at DESC, id DESC LIMIT 60""")),
    "metric_bands": (metric_bands, sql("metrics", """
        SELECT CASE WHEN cpu_percent < 80 THEN 'normal' WHEN cpu_percent < 95 THEN 'inverse' ELSE 'off' END AS cpu,
          CASE WHEN ram_percent < 80 THEN 'normal' WHEN ram_percent < 95 THEN 'inverse' ELSE 'off' END AS ram,
          CASE WHEN disk_percent < 80 THEN 'normal' WHEN disk_percent < 95 THEN 'inverse' ELSE 'off' END AS disk,
          count(*) AS n FROM metrics GROUP BY 1, 2, 3""")),
    "metric_retention": (retention, sql("metrics", f"""
        SELECT count(*) AS n, min(created_at) AS oldest, (SELECT count(*) FROM metrics
          WHERE created_at < {AT} - INTERVAL 240 HOUR) AS pruned
        FROM metrics WHERE created_at >= {AT} - INTERVAL 240 HOUR""")),
    "run_stability": (stability, sql("metrics", """
        SELECT cycles, start_value, end_value, mean_duration, round(growth + 1e-7, 4) AS growth,
          round(growth / hours + 1e-7, 6) AS growth_per_hour, growth > 50 AS leak_suspected FROM (
          SELECT count(*) AS cycles, arg_min(cpu_percent, (created_at, id)) AS start_value,
            arg_max(cpu_percent, (created_at, id)) AS end_value,
            round(avg(ram_percent) + 1e-7, 4) AS mean_duration,
            end_value - start_value AS growth,
            (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 3.6e9 AS hours FROM metrics)""")),
    "registry_status": (registry_status, sql("alerts models", """
        SELECT 'models' AS item, count(*) AS total, count(*) FILTER (WHERE is_active) AS active FROM models
        UNION ALL SELECT 'alerts', count(*), count(*) FILTER (WHERE NOT is_acknowledged) FROM alerts""")),
    "model_activate_exclusive": (model_activate, sql("models", "SELECT id, id = 7 AS is_active FROM models")),
    "model_active_list": (model_add_active, sql("models", """
        SELECT id, name FROM models WHERE (is_active OR id = 8) AND id <> 2""")),
    "model_macro_choice": (model_macro, sql("models", """
        SELECT 'fallback' AS kind, max(id) AS id FROM models WHERE lower(name || ' ' || file_path) LIKE '%macro%'
        UNION ALL SELECT 'configured', 3""")),
    "model_register": (model_register, sql("models", """
        SELECT id, name, is_active FROM models UNION ALL
        SELECT (SELECT max(id) FROM models) + row_number() OVER (ORDER BY r_name), r_name, FALSE FROM region""")),
    "list_edit_delete": (list_edit, sql("black", """
        SELECT id, ip_address, CASE WHEN id = 3 THEN 'edited' ELSE reason END AS reason FROM black WHERE id <> 7""")),
    "point_lookups": (point_lookup, sql("white models subs", """
        SELECT 'ip' AS kind, id FROM white WHERE ip_address = '10.0.0.20' UNION ALL
        SELECT 'name', id FROM models WHERE name = 'NATION_4' UNION ALL
        SELECT 'status', id FROM subs WHERE status = 'pending'""")),
}
