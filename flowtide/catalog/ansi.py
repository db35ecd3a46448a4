"""Common table expressions that project the test tables in plain SQL."""

from __future__ import annotations

from flowtide.driver_tables import ALERT_WINDOW_MINUTES, AS_OF

_CTE = {
    "det": """
      SELECT event_id AS id, user_id % 30 AS model_id,
        '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS source_ip,
        '192.168.0.' || k AS destination_ip,
        CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2
          WHEN 'purchase' THEN 3 ELSE 4 END AS prediction,
        least(value / 100, 1.0) AS confidence,
        CASE event_type WHEN 'view' THEN 'BENIGN' WHEN 'click' THEN 'PortScan' WHEN 'error' THEN 'DDoS'
          WHEN 'purchase' THEN 'DoS Hulk' ELSE 'SSH-Patator' END AS attack_type,
        CASE k % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'pcap' ELSE 'csv' END AS source_type,
        ts AS created_at, k, user_id, value
      FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)""",
    "white": """
      SELECT c_custkey AS id, '10.0.' || (c_custkey // 256) || '.' || (c_custkey % 256) AS ip_address,
        'trusted ' || lower(c_mktsegment) AS reason FROM customer WHERE c_custkey % 10 = 0""",
    "black": """
      SELECT c_custkey AS id, '10.0.' || (c_custkey // 256) || '.' || (c_custkey % 256) AS ip_address,
        CASE WHEN c_custkey % 4 <> 1 THEN 'abuse by ' || c_name END AS reason
      FROM customer WHERE c_custkey % 10 IN (3, 7) OR c_custkey % 30 = 0""",
    "prot": """
      SELECT '10.0.' || (s_suppkey // 256) || '.' || (s_suppkey % 256) AS ip_address
        FROM supplier WHERE s_suppkey % 25 = 4
      UNION SELECT '10.0.' || (s_nationkey % 4) || '.0' FROM supplier
      UNION SELECT '10.0.' || (s_nationkey % 4) || '.255' FROM supplier""",
    "models": """
      SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name,
        'models/' || CASE WHEN n_nationkey % 9 = 5 THEN 'macro_' ELSE 'flow_' END || n_nationkey AS file_path,
        n_regionkey % 2 = 0 AS is_active FROM nation""",
    "flows": """
      SELECT l_orderkey, l_linenumber, '10.1.0.' || (l_suppkey % 50) AS src_ip,
        '10.2.0.' || (l_partkey % 16) AS dst_ip, CAST(1024 + l_orderkey % 60000 AS INTEGER) AS src_port,
        CASE l_returnflag WHEN 'A' THEN 80 WHEN 'N' THEN 443 ELSE 22 END AS dst_port,
        CASE l_linestatus WHEN 'O' THEN 6 ELSE 17 END AS protocol,
        l_quantity AS dur, CAST(l_linenumber AS DOUBLE) AS fwd, l_extendedprice / l_quantity AS bps,
        l_discount * 100 AS plmin, l_discount AS plstd, l_tax AS iatmax, l_extendedprice / 10 AS iatmean,
        CAST(l_linenumber % 3 AS DOUBLE) AS syn, l_extendedprice AS aps FROM lineitem""",
    "rep": """
      SELECT d.*, w.ip_address IS NOT NULL AS is_whitelisted, b.ip_address IS NOT NULL AS is_blacklisted,
        b.reason AS block_reason, p.ip_address IS NOT NULL AS is_protected
      FROM det d LEFT JOIN white w ON d.source_ip = w.ip_address
      LEFT JOIN black b ON d.source_ip = b.ip_address LEFT JOIN prot p ON d.source_ip = p.ip_address""",
    "alertable": """
      SELECT *, CASE WHEN is_blacklisted AND prediction = 0 THEN 'Blocked IP Attempting Access'
          ELSE attack_type END AS threat_type,
        CASE WHEN is_blacklisted THEN 'forced' ELSE 'aggregate' END AS alert_action
      FROM rep WHERE NOT is_whitelisted AND NOT is_protected AND (is_blacklisted OR prediction <> 0)""",
    "numbered": f"""
      SELECT *, sum(opens) OVER (PARTITION BY source_ip, threat_type ORDER BY created_at, id) AS session
      FROM (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY source_ip, threat_type
        ORDER BY created_at, id) <= INTERVAL {ALERT_WINDOW_MINUTES} MINUTE THEN 0 ELSE 1 END AS opens
        FROM alertable)""",
    "occ": """
      SELECT *, row_number() OVER (PARTITION BY source_ip, threat_type, session ORDER BY created_at, id)
        AS occurrence, first_value(id) OVER (PARTITION BY source_ip, threat_type, session
        ORDER BY created_at, id) AS alert_id FROM numbered""",
    "alerts": """
      SELECT source_ip, threat_type, min(alert_id) AS detection_id, count(*) AS occurrences,
        min(created_at) AS first_seen, max(created_at) AS last_seen,
        min(alert_id) % 6 = 0 AS is_acknowledged
      FROM occ GROUP BY source_ip, threat_type, session""",
    "logs": """
      SELECT id, CASE k % 5 WHEN 0 THEN 'PREDICTION' WHEN 1 THEN 'SYSTEM' WHEN 2 THEN 'CAPTURE'
          WHEN 3 THEN 'USER' ELSE 'ERROR' END AS source,
        CASE (k // 5) % 5 WHEN 0 THEN 'DEBUG' WHEN 1 THEN 'INFO' WHEN 2 THEN 'WARNING'
          WHEN 3 THEN 'ERROR' ELSE 'CRITICAL' END AS level,
        CASE WHEN id % 7 = 0 THEN '[FIREWALL] ' ELSE '' END || attack_type || ' from ' || source_ip
          AS message, created_at FROM det""",
    "metrics": """
      SELECT id, value % 100 AS cpu_percent, (value * 3) % 100 AS ram_percent,
        (value * 7) % 100 AS disk_percent,
        CAST((hour(created_at) * 3600 + minute(created_at) * 60 + second(created_at)) * 1000 + k AS BIGINT)
          AS network_sent_bytes,
        CAST((hour(created_at) * 3600 + minute(created_at) * 60 + second(created_at)) * 500 + k * 2 AS BIGINT)
          AS network_recv_bytes, k AS active_threads, created_at FROM det""",
    "lab": """
      SELECT *, [raw[1] / (raw[1] + raw[2] + raw[3]), raw[2] / (raw[1] + raw[2] + raw[3]),
        raw[3] / (raw[1] + raw[2] + raw[3])] AS probability FROM (
        SELECT vec_id, label AS actual, CAST((vec_id * 7) % 10 AS INTEGER) AS pred_a,
          CAST((vec_id * 3 + label) % 10 AS INTEGER) AS pred_b,
          [abs(CAST(embedding[1] AS DOUBLE)) + 0.01, abs(CAST(embedding[2] AS DOUBLE)) + 0.01,
           abs(CAST(embedding[3] AS DOUBLE)) + 0.01] AS raw FROM embeddings)""",
    "subs": """
      SELECT CAST(n_nationkey AS BIGINT) AS id,
        CASE WHEN n_nationkey % 4 = 3 THEN '-100' ELSE '77' END || n_nationkey AS chat_id,
        n_name AS label, n_nationkey % 5 <> 0 AS is_active,
        CASE WHEN n_regionkey = 2 THEN 'pending' ELSE 'approved' END AS status FROM nation""",
}
_NEEDS = {"rep": ("det", "white", "black", "prot"), "alertable": ("rep",), "numbered": ("alertable",),
          "occ": ("numbered",), "alerts": ("occ",), "logs": ("det",), "metrics": ("det",)}


def _closure(name: str, seen: list[str]) -> None:
    for need in _NEEDS.get(name, ()):
        _closure(need, seen)
    if name not in seen:
        seen.append(name)


def sql(tables: str, body: str, **extra: str) -> str:
    """``WITH`` the named projections (space separated), then the body."""
    seen: list[str] = []
    for name in tables.split():
        _closure(name, seen)
    parts = [f"{name} AS ({_CTE[name]})" for name in seen]
    parts += [f"{name} AS ({text})" for name, text in extra.items()]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return head + body


AT = f"TIMESTAMP '{AS_OF}'"
