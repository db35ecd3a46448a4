"""Verdict, severity, reason and status queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide import driver_tables as dt
from flowtide.catalog import _shared as sh
from flowtide.catalog.ansi import sql
from flowtide.functions import scalars
from flowtide.operators import decide
from flowtide.operators.align import safe_int
from flowtide.operators.registry import resolve_model_name


def severity(spark, sf):
    d = dt.detections(spark, sf)
    grade = decide.severity_of(F.col("confidence"), F.col("prediction") != 0)
    custom = decide.severity_of(F.col("confidence"), F.col("prediction") != 0, 0.8, 0.5, 0.1)
    return d.select("id", grade.alias("severity"), custom.alias("custom_severity"))


def severity_override(spark, sf):
    named = resolve_model_name(sh.reputed(spark, sf), dt.models(spark, sf))
    graded = decide.add_grading(named, analysis=F.lit("values withheld"))
    return graded.select("id", "severity", "attack_reason", "model_name")


def threshold(spark, sf):
    p = dt.labelled(spark, sf)
    out = decide.add_verdict(p, ["BENIGN", "DDoS", "PortScan"])
    strict = decide.decide_class(F.col("probability"), 0.75)
    return out.select("vec_id", "prediction", sh.rounded(F.col("confidence"), 6).alias("confidence"),
                      "attack_type", strict.alias("strict_prediction"))


def single_score(spark, sf):
    p = F.col("probability")[1]
    cls, conf = decide.decide_score(p, 0.5)
    return dt.labelled(spark, sf).select("vec_id", cls.alias("prediction"),
                                         sh.rounded(conf, 6).alias("confidence"))


def class_label(spark, sf):
    labels = decide.class_label(F.col("actual"), ["BENIGN", "Bot", "DDoS", "PortScan"])
    return dt.labelled(spark, sf).select("vec_id", labels.alias("attack_type"))


def statuses(spark, sf):
    args = F.col("is_whitelisted"), F.col("is_blacklisted")
    return sh.reputed(spark, sf).select(
        "id", decide.display_status(F.col("prediction"), *args).alias("status"),
        decide.display_label(F.col("prediction"), F.col("attack_type"), *args).alias("label"),
        decide.dashboard_state(F.col("prediction"), F.col("attack_type")).alias("state"),
        scalars.percent(F.col("confidence")).alias("shown"))


def protocols(spark, sf):
    named = scalars.protocol_name(F.col("protocol")).alias("protocol_name")
    return dt.flows(spark, sf).groupBy(named).agg(F.count(F.lit(1)).alias("flows"))


def top_features(spark, sf):
    """The five largest features of every flow, as text and as its leading entry."""
    ranked = decide.ranked_features(dt.FLOW_FEATURES, 5)
    return (dt.flows(spark, sf).withColumn("_r", ranked)
            .select("l_orderkey", "l_linenumber", "src_port",
                    decide.feature_text(F.slice("_r", 1, 3)).alias("top"),
                    F.get("_r", F.lit(0))["name"].alias("first_name"),
                    F.get("_r", F.lit(4))["name"].alias("fifth_name")))


def json_roundtrip(spark, sf):
    """Encode two features as JSON, decode, and rank from the decoded map."""
    encoded = dt.flows(spark, sf).select(
        "l_orderkey", scalars.features_to_json(["Flow Duration", "Total Fwd Packets"]).alias("raw_features"))
    bag = scalars.json_features(F.col("raw_features"))
    return encoded.select("l_orderkey", F.coalesce(decide.feature_text(decide.ranked_map(bag, 1)),
                                                   F.lit("-")).alias("top"))


def feature_details(spark, sf):
    """Features of the five newest attacks, one row each, largest first."""
    newest = (dt.detections(spark, sf).filter("prediction <> 0")
              .orderBy(F.desc("created_at"), F.desc("id")).limit(5)
              .withColumn("Value", F.col("value")).withColumn("Bucket", F.col("k").cast("double")))
    return (newest.select("id", F.posexplode(decide.ranked_features(["Value", "Bucket"])).alias("rank", "f"))
            .select("id", "rank", F.col("f.name").alias("feature"), F.col("f.value").alias("value")))


def audit_log(spark, sf):
    return decide.audit_log(dt.detections(spark, sf))


def model_names(spark, sf):
    return resolve_model_name(dt.detections(spark, sf), dt.models(spark, sf)).groupBy("model_name").agg(
        F.count(F.lit(1)).alias("n"))


def summary(spark, sf):
    return decide.summarize(dt.detections(spark, sf)).withColumn(
        "threat_density", sh.rounded(F.col("threat_density")))


def unscored(spark, sf):
    """Detections with a model id of 20 or more lose their verdict and fall back to benign."""
    d = dt.detections(spark, sf)
    lost = F.col("model_id") >= 20
    blank = d.select("id", *[F.when(~lost, F.col(c)).alias(c)
                             for c in ("prediction", "confidence", "attack_type")],
                     F.when(~lost, "scored").alias("attack_reason"))
    return decide.fill_unscored(blank)


def escaping(spark, sf):
    pages = dt.table(spark, sf, "pages")
    return pages.select("page_id", F.md5(scalars.escape_display(F.col("html"))).alias("display"),
                        F.md5(scalars.escape_message(F.col("html"))).alias("message"))


def times(spark, sf):
    return dt.detections(spark, sf).select(
        "id", scalars.utc_text(F.col("created_at")).alias("text"),
        scalars.utc_text(scalars.minutes_before(F.col("created_at"), 5)).alias("five_minutes_ago"),
        scalars.utc_text(scalars.hours_before(F.col("created_at"), 24)).alias("day_ago"))


def addresses(spark, sf):
    subnet = dt.subnets(spark, sf)
    address, mask = F.col("address"), F.lit("255.255.240.0")
    return subnet.select(
        "address", scalars.pack_ipv4(address).alias("packed"),
        scalars.network_address(address, mask).alias("network"),
        scalars.broadcast_address(address, mask).alias("broadcast"),
        scalars.is_ip_address(address).alias("valid"))


def text_validity(spark, sf):
    """Validity tests over whole message texts and over derived addresses."""
    c = dt.table(spark, sf, "conversations")
    return c.select("conv_id", "turn",
                    scalars.is_ip_address(F.col("text"), ipv6=False).alias("is_v4"),
                    scalars.is_chat_id(F.concat(F.lit("-"), F.col("conv_id"))).alias("is_chat"),
                    scalars.is_chat_id(F.col("role")).alias("role_is_chat"),
                    safe_int(F.col("role")).alias("role_number"))


def name_repair(spark, sf):
    d = dt.table(spark, sf, "documents")
    return d.select("doc_id", F.length(scalars.slash_names(F.col("text"))).alias("n"),
                    scalars.slash_names(F.concat(F.lit("Web Attack � "), F.col("lang"))).alias("repaired"))


_REASON = """
SELECT r.id, coalesce(m.name, 'unresolved_model_' || r.model_id) AS model_name,
  CASE WHEN is_blacklisted AND NOT is_protected THEN 'CRITICAL' WHEN prediction = 0 THEN ''
    WHEN confidence >= 0.9 THEN 'CRITICAL' WHEN confidence >= 0.7 THEN 'HIGH'
    WHEN confidence >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN is_blacklisted AND NOT is_protected THEN 'Blacklisted source ' || source_ip
      || ' BLOCKED (reason: ' || coalesce(block_reason, 'listed in blacklist') || '). '
      || CASE WHEN prediction <> 0 THEN 'Model classified traffic as ' || attack_type || ' with '
        || printf('%.1f%%', confidence * 100.0) || ' confidence — values withheld'
        ELSE 'Model classified traffic as benign.' END
    WHEN is_whitelisted THEN 'Whitelisted admin test traffic from ' || source_ip
      || ' — model classified as ' || CASE WHEN prediction <> 0 THEN attack_type || ' with '
        || printf('%.1f%%', confidence * 100.0) || ' confidence but trusted.' ELSE 'benign.' END
    WHEN prediction <> 0 THEN 'ML model (' || coalesce(m.name, 'unresolved_model_' || r.model_id)
      || ') classified as ' || attack_type || ' with ' || printf('%.1f%%', confidence * 100.0)
      || ' confidence — values withheld'
    ELSE 'Traffic classified as benign by ML model — no attack pattern detected above threshold' END
    AS attack_reason
FROM rep r LEFT JOIN models m ON r.model_id = m.id"""

_RANKED = """SELECT l_orderkey, l_linenumber, src_port, list_sort([
  {'o': -abs(dur), 'i': 0, 'n': 'Flow Duration', 'v': dur},
  {'o': -abs(fwd), 'i': 1, 'n': 'Total Fwd Packets', 'v': fwd},
  {'o': -abs(bps), 'i': 2, 'n': 'Flow Bytes/s', 'v': bps},
  {'o': -abs(plmin), 'i': 3, 'n': 'Fwd Packet Length Min', 'v': plmin},
  {'o': -abs(plstd), 'i': 4, 'n': 'Fwd Packet Length Std', 'v': plstd},
  {'o': -abs(iatmax), 'i': 5, 'n': 'Flow IAT Max', 'v': iatmax},
  {'o': -abs(iatmean), 'i': 6, 'n': 'Flow IAT Mean', 'v': iatmean},
  {'o': -abs(syn), 'i': 7, 'n': 'SYN Flag Count', 'v': syn},
  {'o': -abs(aps), 'i': 8, 'n': 'Average Packet Size', 'v': aps}]) AS r FROM flows"""


def _entry(i: int) -> str:
    return f"r[{i}].n || '=' || printf('%.4f', r[{i}].v)"


_ESC = "replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

ENTRIES = {
    "severity_bands": (severity, sql("det", """
        SELECT id, CASE WHEN prediction = 0 THEN '' WHEN confidence >= 0.9 THEN 'CRITICAL'
          WHEN confidence >= 0.7 THEN 'HIGH' WHEN confidence >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
          CASE WHEN prediction = 0 THEN '' WHEN confidence >= 0.8 THEN 'CRITICAL'
          WHEN confidence >= 0.5 THEN 'HIGH' WHEN confidence >= 0.1 THEN 'MEDIUM' ELSE 'LOW' END
          AS custom_severity FROM det""")),
    "detection_grading": (severity_override, sql("rep models", _REASON)),
    "decision_threshold": (threshold, sql("lab", """
        SELECT vec_id, CASE WHEN 1 - probability[1] < 0.5 THEN 0 WHEN probability[2] >= probability[3]
            THEN 1 ELSE 2 END AS prediction, round(list_max(probability) + 1e-7, 6) AS confidence,
          CASE WHEN 1 - probability[1] < 0.5 THEN 'BENIGN' WHEN probability[2] >= probability[3]
            THEN 'DDoS' ELSE 'PortScan' END AS attack_type,
          CASE WHEN 1 - probability[1] < 0.75 THEN 0 WHEN probability[2] >= probability[3]
            THEN 1 ELSE 2 END AS strict_prediction FROM lab""")),
    "decision_single_score": (single_score, sql("lab", """
        SELECT vec_id, CASE WHEN probability[2] >= 0.5 THEN 1 ELSE 0 END AS prediction,
          round(greatest(probability[2], 1 - probability[2]) + 1e-7, 6) AS confidence FROM lab""")),
    "class_label": (class_label, sql("lab", """
        SELECT vec_id, coalesce((['BENIGN', 'Bot', 'DDoS', 'PortScan'])[actual + 1], '') AS attack_type
        FROM lab""")),
    "display_status": (statuses, sql("rep", """
        SELECT id, CASE WHEN is_blacklisted THEN 'Blocked' WHEN is_whitelisted THEN 'Admin Test'
            WHEN prediction = 0 THEN 'Normal' ELSE 'Attack' END AS status,
          CASE WHEN is_blacklisted THEN 'Blocked IP Attempting Access'
            WHEN is_whitelisted THEN 'Admin Test Traffic (Whitelisted)'
            WHEN prediction = 0 THEN 'Benign' ELSE 'Attack (' || attack_type || ')' END AS label,
          CASE WHEN prediction = 0 THEN 'Normal' ELSE 'Attack (' || attack_type || ')' END AS state,
          printf('%.1f%%', confidence * 100.0) AS shown FROM rep""")),
    "protocol_names": (protocols, sql("flows", """
        SELECT CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'Other' END AS protocol_name,
          count(*) AS flows FROM flows GROUP BY 1""")),
    "top_features": (top_features, sql("flows", f"""
        SELECT l_orderkey, l_linenumber, src_port, {_entry(1)} || ', ' || {_entry(2)} || ', ' || {_entry(3)}
          AS top, r[1].n AS first_name, r[5].n AS fifth_name FROM ranked""", ranked=_RANKED)),
    "feature_json": (json_roundtrip, sql("flows", """
        SELECT l_orderkey, CASE WHEN dur >= fwd THEN 'Flow Duration=' || printf('%.4f', dur)
          ELSE 'Total Fwd Packets=' || printf('%.4f', fwd) END AS top FROM flows""")),
    "feature_details": (feature_details, sql("det", """
        SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY -abs(value), i) - 1 AS INTEGER) AS rank,
          feature, value FROM (
          SELECT id, 0 AS i, 'Value' AS feature, value FROM newest
          UNION ALL SELECT id, 1, 'Bucket', CAST(k AS DOUBLE) FROM newest)""",
          newest="SELECT * FROM det WHERE prediction <> 0 ORDER BY created_at DESC, id DESC LIMIT 5")),
    "audit_log": (audit_log, sql("det", """
        SELECT CASE WHEN source_type IN ('live', 'pcap') THEN 'CAPTURE' ELSE 'PREDICTION' END AS source,
          CASE WHEN prediction <> 0 THEN 'WARNING' ELSE 'INFO' END AS level,
          'Execution Tail Complete: VectorSource=''' || source_type || ''' -> Class=' || prediction || ' ('
          || attack_type || ') (Confidence=' || printf('%.2f%%', confidence * 100.0) || ') | Src='
          || source_ip || ' -> Dst=' || destination_ip AS message, created_at FROM det""")),
    "model_names": (model_names, sql("det models", """
        SELECT coalesce(m.name, 'unresolved_model_' || d.model_id) AS model_name, count(*) AS n
        FROM det d LEFT JOIN models m ON d.model_id = m.id GROUP BY 1""")),
    "analysis_summary": (summary, sql("det", """
        SELECT count(*) AS total_rows, count(*) FILTER (WHERE prediction <> 0) AS attack_rows,
          count(*) FILTER (WHERE prediction <> 0) AS attack_units,
          count(*) FILTER (WHERE prediction = 0) AS normal_rows,
          count(*) FILTER (WHERE prediction = 0) AS normal_reference,
          round(count(*) FILTER (WHERE prediction <> 0) * 100.0 / count(*) + 1e-7, 4) AS threat_density
        FROM det""")),
    "unscored_rows": (unscored, sql("det", """
        SELECT id, CASE WHEN model_id >= 20 THEN 0 ELSE prediction END AS prediction,
          CASE WHEN model_id >= 20 THEN 0.0::DOUBLE ELSE confidence END AS confidence,
          CASE WHEN model_id >= 20 THEN 'BENIGN' ELSE attack_type END AS attack_type,
          CASE WHEN model_id >= 20 THEN 'Inference unavailable — row treated as benign' ELSE 'scored' END
          AS attack_reason FROM det""")),
    "html_escape": (escaping, f"""
        SELECT page_id, md5({_ESC}) AS message,
          md5(replace(replace({_ESC}, '"', '&quot;'), '''', '&#x27;')) AS display FROM pages"""),
    "utc_texts": (times, sql("det", """
        SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS text,
          strftime(created_at - INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS five_minutes_ago,
          strftime(created_at - INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS day_ago FROM det""")),
    "ipv4_math": (addresses, """
        SELECT '10.0.' || a || '.' || b AS address, 167772160 + a * 256 + b AS packed,
          '10.0.' || (a & 240) || '.0' AS network, '10.0.' || (a | 15) || '.255' AS broadcast, TRUE AS valid
        FROM (SELECT s_nationkey % 4 AS a, s_suppkey % 256 AS b FROM supplier)"""),
    "text_validity": (text_validity, r"""
        SELECT conv_id, turn, regexp_full_match(trim(text),
          '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])')
          AS is_v4, TRUE AS is_chat, FALSE AS role_is_chat, 0 AS role_number FROM conversations"""),
    "class_name_repair": (name_repair, """
        SELECT doc_id, CAST(length(replace(text, chr(65533), '/')) AS INTEGER) AS n,
          'Web Attack / ' || lang AS repaired FROM documents"""),
}
