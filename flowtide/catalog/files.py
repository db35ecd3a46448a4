"""File round trips and packet queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide import driver_tables as dt
from flowtide.catalog._shared import rounded
from flowtide.catalog.ansi import sql
from flowtide.operators import reports, reputation
from flowtide.plans.audit import MacroSettings, audit
from flowtide.plans.models import FlowModel, pandas_scorer, rule_scorer
from flowtide.schemas import DETECTIONS, col, conform
from flowtide.session import scratch_path
from flowtide.sources import readers, sinks
from flowtide.streaming import packets

IDLE = 6 * 3600


def _flow_csv(spark, sf):
    """Line items written as a flow CSV with padded titles and a broken cell per seventh row."""
    path = scratch_path(spark, "flows-csv")
    f = dt.flows(spark, sf).select(
        F.col("src_ip").alias(" Source IP"), F.col("dst_ip").alias("Destination IP "),
        F.col("src_port").alias("Source Port"), F.col("dst_port").alias("Destination Port"),
        F.col("protocol").alias("Protocol"),
        F.when(F.col("l_orderkey") % 7 == 0, "broken").otherwise(col("Flow Duration").cast("string"))
        .alias("Flow Duration"), col("Total Fwd Packets"), F.col("l_linenumber").alias("SYN Flag Cnt"),
        F.when(F.col("dst_port") == 22, "SSH-Patator").otherwise("BENIGN").alias("Label"))
    sinks.export_csv(f, path)
    return path


def csv_scan(spark, sf):
    f = readers.read_flows(spark, _flow_csv(spark, sf))
    return f.groupBy("src_ip", "dst_port", "protocol").agg(
        F.count(F.lit(1)).alias("flows"), F.count("Flow Duration").alias("durations"),
        F.sum("SYN Flag Cnt").cast("long").alias("syn"))


def labelled_scan(spark, sf):
    """The same file twice under two folders, plus a missing one that is left out."""
    path = _flow_csv(spark, sf)
    merged = readers.read_labelled(spark, [path, f"{path}-absent", path])
    return merged.groupBy("Label").agg(F.count(F.lit(1)).alias("n"), F.count("Flow Duration").alias("durations"))


def labelled_rejects(spark, sf):
    """What a scan of labelled files leaves out, by reason, next to what it keeps: the counts add up to the files."""
    flows, path = dt.flows(spark, sf), scratch_path(spark, "labelled")
    line = F.concat_ws(",", "l_linenumber", col("Flow Duration").cast("string"), F.when(F.col("dst_port") == 22, "SSH-Patator").otherwise("BENIGN"))
    # Every fifth order has a cell too many, every seventh one too few.
    cut = F.when(F.col("l_orderkey") % 5 == 0, F.concat(line, F.lit(",extra"))).when(
        F.col("l_orderkey") % 7 == 0, F.col("l_linenumber").cast("string")).otherwise(line)
    labelled = flows.select(cut.alias("SYN Flag Count,Flow Duration, Label"))
    labelled.write.csv(f"{path}/a", header=True, quote="\x00", sep="\x01")
    flows.filter("dst_port = 80").select("l_orderkey", "l_linenumber").write.csv(f"{path}/b", header=True)
    rows, rejects = readers.scan_labelled(spark, [f"{path}/a", f"{path}/b", f"{path}/absent"])
    return (rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
            .union(rows.groupBy(F.lit("kept").alias("reason")).agg(F.count("Flow Duration").alias("n"))))


def label_pool(spark, sf):
    f = dt.flows(spark, sf).withColumn("Label", F.when(F.col("dst_port") == 22, " SSH-Patator").otherwise("BENIGN"))
    order = ["l_orderkey", "l_linenumber", "src_port", "src_ip", "dst_ip", "Flow Duration", "Average Packet Size"]
    return readers.label_pool(f, ["SSH-Patator"], order, 500).select(
        "l_orderkey", "l_linenumber", col("Flow Duration").alias("dur"))


def _model(name="rule"):
    share = "least(coalesce(`SYN Flag Count`, 0D) / 7, 1D)"
    return FlowModel(name, ["Flow Duration", "Total Fwd Packets", "SYN Flag Count", "Idle Max"],
                     ["BENIGN", "SYN Flood"], rule_scorer(f"array(1 - {share}, {share})"), 5)


def csv_audit(spark, sf):
    """The batch audit of a CSV file: every row judged, graded and explained."""
    out = audit(readers.read_flows(spark, _flow_csv(spark, sf)), _model())
    return out.rows.groupBy("prediction", "attack_type", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("missing_features") == 2).alias("two_missing"),
        F.min(F.length("attack_reason") > 0).alias("explained"))


def csv_audit_macro(spark, sf):
    """The audit in macro mode: aggregates judged, verdicts joined back to member rows."""
    flows = readers.read_flows(spark, _flow_csv(spark, sf))
    out = audit(flows, _model(), macro_settings=MacroSettings())
    return out.summary.select("total_rows", "attack_rows", "attack_units", "normal_rows", "normal_reference")


def pandas_audit(spark, sf):
    """A foreign model scoring Arrow batches."""
    features = ["Flow Duration", "SYN Flag Count"]
    model = FlowModel("foreign", features, ["BENIGN", "DDoS"], pandas_scorer(features, _half_rule))
    return audit(dt.flows(spark, sf), model).rows.groupBy("prediction", "severity").agg(F.count(F.lit(1)).alias("n"))


def _half_rule(batch):
    hot = (batch["Flow Duration"] > 25).astype(float) * 0.75 + 0.125
    return list(zip(1 - hot, hot))


def detection_sink(spark, sf):
    path = scratch_path(spark, "detections")
    rows = conform(dt.detections(spark, sf), DETECTIONS)
    sinks.append_by_day(rows, path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def ip_list_roundtrip(spark, sf):
    """Export the blacklist as CSV, then import it into the whitelist."""
    path = scratch_path(spark, "blacklist-csv")
    entries = dt.blacklist(spark, sf).withColumn("created_at", dt.as_of())
    sinks.export_csv(sinks.ip_list_export(entries), path)
    fresh, _ = reputation.import_list(readers.read_csv(spark, path), dt.whitelist(spark, sf), "added_at")
    return fresh


def log_export(spark, sf):
    path = scratch_path(spark, "logs-csv")
    sinks.export_csv(sinks.log_export(dt.logs(spark, sf), level="ERROR"), path)
    return readers.read_csv(spark, path).groupBy("source", "level").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"))


def log_file_scan(spark, sf):
    path = scratch_path(spark, "log-text")
    dt.logs(spark, sf).select(F.concat(F.date_format("created_at", "HH:mm:ss"), F.lit(" | "), F.col("level"),
                                       F.lit(" | "), F.col("message"))).write.text(path)
    return reports.marker_counts(readers.read_log_lines(spark, path))


def evaluation_document(spark, sf):
    """Metrics stored as a JSON document and read back as tidy rows."""
    from flowtide.operators import evaluate
    from flowtide.schemas import FLOW_CLASSES
    names = F.array(*[F.lit(c) for c in FLOW_CLASSES[:10]])
    named = dt.labelled(spark, sf).select(F.get(names, F.col("actual")).alias("actual"),
                                          F.get(names, F.col("pred_b")).alias("predicted"))
    long = evaluate.confusion(named, classes=FLOW_CLASSES[:10])
    path = scratch_path(spark, "evaluation")
    readers.write_json(spark, {"b": readers.evaluation_payload(long, FLOW_CLASSES[:10])}, path)
    stored = readers.read_json(spark, path)["b"]
    return readers.report_frame(spark, stored["report"], "b").select(
        "class", rounded(F.col("f1"), 6).alias("f1"), F.col("support").cast("long").alias("support"))


def packets_of(d):
    """Events as packets between a user and one of five servers; every third one is a reply."""
    reply = F.col("id") % 3 == 2
    user, server = F.col("source_ip"), F.concat(F.lit("172.16.0."), F.col("k") % 5)
    return d.select(
        F.col("id").alias("packet_no"), F.col("created_at").alias("ts"),
        F.when(reply, server).otherwise(user).alias("src_ip"), F.when(reply, user).otherwise(server).alias("dst_ip"),
        F.when(reply, 443).otherwise(F.lit(50000)).alias("src_port"),
        F.when(reply, 50000).otherwise(F.lit(443)).alias("dst_port"), F.lit(6).alias("protocol"),
        F.floor("value").cast("int").alias("payload_len"), F.lit(20).alias("header_len"),
        (F.col("k") % 64).alias("tcp_flags"), (F.col("k") * 100).alias("window"))


def packet_flows(spark, sf):
    return shown_flows(packets.flows(packets_of(dt.detections(spark, sf)), idle=IDLE, activity=3600))


def shown_flows(f):
    r = lambda name, alias: rounded(col(name)).alias(alias)
    return f.select("src_ip", "dst_ip", F.col("flow_start"), r("Flow Duration", "duration"),
                    r("Total Fwd Packets", "fwd"), r("Total Backward Packets", "bwd"),
                    r("Total Length of Fwd Packets", "fwd_bytes"), r("Packet Length Std", "len_std"),
                    r("Flow IAT Max", "iat_max"), r("Flow IAT Min", "iat_min"), r("Fwd IAT Total", "fwd_iat"),
                    r("Bwd IAT Max", "bwd_iat_max"), r("SYN Flag Count", "syn"),
                    r("Init_Win_bytes_forward", "init_win"), r("Idle Max", "idle_max"), r("Active Max", "active_max"))


def flow_sql(having: str = "") -> str:
    """Flows of the packets above, in plain SQL."""
    return sql("det", f"""
        SELECT arg_min(src_ip, (ts, packet_no)) AS src_ip, arg_min(dst_ip, (ts, packet_no)) AS dst_ip,
          min(ts) AS flow_start, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) AS duration,
          CAST(count(*) FILTER (WHERE fwd) AS DOUBLE) AS fwd, CAST(count(*) FILTER (WHERE NOT fwd) AS DOUBLE) AS bwd,
          CAST(coalesce(sum(payload) FILTER (WHERE fwd), 0) AS DOUBLE) AS fwd_bytes,
          round(coalesce(stddev_samp(payload), 0) + 1e-7, 4) AS len_std,
          CAST(coalesce(max(gap), 0) AS DOUBLE) AS iat_max, CAST(coalesce(min(gap), 0) AS DOUBLE) AS iat_min,
          CAST(coalesce(sum(same) FILTER (WHERE fwd), 0) AS DOUBLE) AS fwd_iat,
          CAST(coalesce(max(same) FILTER (WHERE NOT fwd), 0) AS DOUBLE) AS bwd_iat_max,
          CAST(count(*) FILTER (WHERE (k % 64) & 2 <> 0) AS DOUBLE) AS syn,
          CAST(coalesce(arg_min(k * 100, (ts, packet_no)) FILTER (WHERE fwd), 0) AS DOUBLE) AS init_win,
          CAST(coalesce(max(gap) FILTER (WHERE gap > 3600000000), 0) AS DOUBLE) AS idle_max,
          any_value(active) AS active_max
        FROM d JOIN (SELECT usr, srv, flow, CAST(coalesce(max(len) FILTER (WHERE len > 0), 0) AS DOUBLE) AS active
          FROM (SELECT usr, srv, flow, period, epoch_us(max(ts)) - epoch_us(min(ts)) AS len FROM (
            SELECT *, sum(CASE WHEN gap > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY usr, srv, flow
              ORDER BY ts, packet_no) AS period FROM d) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) a
          USING (usr, srv, flow)
        GROUP BY usr, srv, flow {having}""",
        p="""SELECT id AS packet_no, created_at AS ts, source_ip AS usr, '172.16.0.' || (k % 5) AS srv, k,
               CAST(floor(value) AS INTEGER) AS payload, id % 3 = 2 AS reply,
               CASE WHEN id % 3 = 2 THEN '172.16.0.' || (k % 5) ELSE source_ip END AS src_ip,
               CASE WHEN id % 3 = 2 THEN source_ip ELSE '172.16.0.' || (k % 5) END AS dst_ip FROM det""",
        f="""SELECT *, sum(opens) OVER (PARTITION BY usr, srv ORDER BY ts, packet_no) AS flow FROM (
               SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY usr, srv ORDER BY ts, packet_no)
                 <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM p)""",
        d="""SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY usr, srv, flow ORDER BY ts, packet_no))
               AS gap, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY usr, srv, flow, reply
               ORDER BY ts, packet_no)) AS same,
               reply = first_value(reply) OVER (PARTITION BY usr, srv, flow ORDER BY ts, packet_no) AS fwd FROM f""")


_ROW = "SELECT *, l_orderkey % 7 = 0 AS broken FROM flows"
_UNIT = """SELECT src_ip, dst_ip, dst_port, protocol, count(*) AS n,
  CASE WHEN least(sum(l_linenumber) / 7, 1.0) >= 0.5 THEN 1 ELSE 0 END AS prediction
  FROM flows GROUP BY 1, 2, 3, 4"""

ENTRIES = {
    "csv_flow_scan": (csv_scan, sql("flows", """
        SELECT src_ip, dst_port, protocol, count(*) AS flows, count(*) FILTER (WHERE NOT broken) AS durations,
          CAST(sum(l_linenumber) AS BIGINT) AS syn FROM r GROUP BY 1, 2, 3""", r=_ROW)),
    "labelled_folder_scan": (labelled_scan, sql("flows", """
        SELECT CASE WHEN dst_port = 22 THEN 'SSH-Patator' ELSE 'BENIGN' END AS Label, 2 * count(*) AS n,
          2 * count(*) FILTER (WHERE NOT broken) AS durations FROM r GROUP BY 1""", r=_ROW)),
    "labelled_rejects": (labelled_rejects, sql("flows", """
        SELECT 'missing' AS reason, CAST(1 AS BIGINT) AS n UNION ALL
        SELECT 'no column Label', count(*) FROM flows WHERE dst_port = 80 UNION ALL
        SELECT 'does not fit the header', count(*) FROM flows WHERE l_orderkey % 5 = 0 OR l_orderkey % 7 = 0 UNION ALL
        SELECT 'kept', count(*) FROM flows WHERE l_orderkey % 5 <> 0 AND l_orderkey % 7 <> 0""")),
    "label_pool": (label_pool, sql("flows", """
        SELECT l_orderkey, l_linenumber, dur FROM flows WHERE dst_port = 22
        ORDER BY l_orderkey, l_linenumber, src_port, src_ip, dst_ip, dur, aps LIMIT 500""")),
    "csv_audit": (csv_audit, sql("flows", """
        SELECT CASE WHEN c >= 0.5 THEN 1 ELSE 0 END AS prediction,
          CASE WHEN c >= 0.5 THEN 'SYN Flood' ELSE 'BENIGN' END AS attack_type,
          CASE WHEN c < 0.5 THEN '' WHEN c >= 0.9 THEN 'CRITICAL' WHEN c >= 0.7 THEN 'HIGH' ELSE 'MEDIUM' END
            AS severity, count(*) AS n, count(*) FILTER (WHERE broken) AS two_missing, TRUE AS explained
        FROM (SELECT *, least(l_linenumber / 7, 1.0) AS c FROM r) GROUP BY 1, 2, 3""", r=_ROW)),
    "csv_audit_macro": (csv_audit_macro, sql("flows", """
        SELECT CAST(sum(n) AS BIGINT) AS total_rows,
          CAST(coalesce(sum(n) FILTER (WHERE prediction = 1), 0) AS BIGINT) AS attack_rows,
          count(*) FILTER (WHERE prediction = 1) AS attack_units,
          CAST(coalesce(sum(n) FILTER (WHERE prediction = 0), 0) AS BIGINT) AS normal_rows,
          CAST(sum(n) AS BIGINT) - count(*) FILTER (WHERE prediction = 1) AS normal_reference FROM u""", u=_UNIT)),
    "foreign_model_audit": (pandas_audit, sql("flows", """
        SELECT CASE WHEN dur > 25 THEN 1 ELSE 0 END AS prediction,
          CASE WHEN dur > 25 THEN 'HIGH' ELSE '' END AS severity, count(*) AS n FROM flows GROUP BY 1, 2""")),
    "detection_sink": (detection_sink, sql("det", """
        SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM det GROUP BY 1""")),
    "ip_list_roundtrip": (ip_list_roundtrip, sql("white black", """
        SELECT ip_address, coalesce(reason, '') AS reason FROM black
        WHERE ip_address NOT IN (SELECT ip_address FROM white)""")),
    "log_export": (log_export, sql("logs", """
        SELECT source, level, count(*) AS n, min(strftime(created_at, '%Y-%m-%d %H:%M:%S')) AS first
        FROM logs WHERE level = 'ERROR' GROUP BY 1, 2""")),
    "log_file_scan": (log_file_scan, sql("logs", """
        SELECT 2 * count(*) FILTER (WHERE level = 'ERROR') AS errors,
          2 * count(*) FILTER (WHERE level = 'CRITICAL') AS criticals, 0::BIGINT AS tracebacks FROM logs""")),
    "evaluation_document": (evaluation_document, sql("lab", """
        SELECT (['BENIGN', 'Bot', 'DDoS', 'DoS GoldenEye', 'DoS Hulk', 'DoS Slowhttptest', 'DoS slowloris',
          'FTP-Patator', 'Heartbleed', 'Infiltration'])[c + 1] AS class,
          round(coalesce(2 * count(*) FILTER (WHERE actual = c AND pred_b = c) / nullif(count(*) FILTER
            (WHERE actual = c) + count(*) FILTER (WHERE pred_b = c), 0), 0) + 1e-7, 6) AS f1,
          count(*) FILTER (WHERE actual = c) AS support
        FROM lab, range(10) r(c) GROUP BY c""")),
    "packet_flows": (packet_flows, flow_sql()),
}
