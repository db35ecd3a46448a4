"""Table schemas, the model feature contract and schema conformance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# --- Fixed values: the ordered feature contract of the per-flow classifiers. ---
FEATURES: tuple[str, ...] = (
    "Destination Port", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Fwd Packet Length Max",
    "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean",
    "Bwd Packet Length Std", "Flow Bytes/s", "Flow Packets/s", "Flow IAT Mean", "Flow IAT Std",
    "Flow IAT Max", "Flow IAT Min", "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max",
    "Fwd IAT Min", "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Fwd URG Flags", "Fwd Header Length", "Bwd Header Length", "Fwd Packets/s",
    "Bwd Packets/s", "Min Packet Length", "Max Packet Length", "Packet Length Mean",
    "Packet Length Std", "Packet Length Variance", "FIN Flag Count", "SYN Flag Count",
    "RST Flag Count", "PSH Flag Count", "ACK Flag Count", "URG Flag Count", "CWE Flag Count",
    "ECE Flag Count", "Down/Up Ratio", "Average Packet Size", "Avg Fwd Segment Size",
    "Avg Bwd Segment Size", "Fwd Header Length.1", "Subflow Fwd Packets", "Subflow Fwd Bytes",
    "Subflow Bwd Packets", "Subflow Bwd Bytes", "Init_Win_bytes_forward",
    "Init_Win_bytes_backward", "act_data_pkt_fwd", "min_seg_size_forward", "Active Mean",
    "Active Std", "Active Max", "Active Min", "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
)

# --- Fixed values: label spaces; index 0 is always the benign class. ---
FLOW_CLASSES: tuple[str, ...] = (
    "BENIGN", "Bot", "DDoS", "DoS GoldenEye", "DoS Hulk", "DoS Slowhttptest", "DoS slowloris",
    "FTP-Patator", "Heartbleed", "Infiltration", "PortScan", "SSH-Patator",
    "Web Attack / Brute Force", "Web Attack / Sql Injection", "Web Attack / XSS",
)
MACRO_CLASSES: tuple[str, ...] = (
    "BENIGN", "DDoS", "DoS Hulk", "DoS Slowhttptest", "PortScan", "SSH-Patator", "SYN Flood",
)

# --- Fixed values: attack class -> reporting category. ---
ATTACK_CATEGORIES: dict[str, tuple[str, ...]] = {
    "DoS": ("DDoS", "DoS GoldenEye", "DoS Hulk", "DoS Slowhttptest", "DoS slowloris"),
    "Brute Force": ("FTP-Patator", "SSH-Patator"),
    "Web Attacks": ("Web Attack / Brute Force", "Web Attack / Sql Injection", "Web Attack / XSS"),
    "Reconnaissance": ("PortScan", "Bot"),
    "Advanced Threats": ("Infiltration", "Heartbleed"),
}

# --- Fixed values: feature category -> name fragments (case-insensitive substring match). ---
FEATURE_CATEGORIES: dict[str, tuple[str, ...]] = {
    "Flow Statistics": ("Flow Duration", "Flow Bytes/s", "Flow Packets/s", "Flow IAT"),
    "Forward Packets": ("Fwd Packet Length", "Fwd IAT", "Fwd PSH", "Fwd Header", "Fwd Packets/s",
                        "Fwd Segment"),
    "Backward Packets": ("Bwd Packet Length", "Bwd IAT", "Bwd Header", "Bwd Packets/s",
                         "Bwd Segment"),
    "Packet Statistics": ("Min Packet Length", "Max Packet Length", "Packet Length Mean",
                          "Packet Length Std", "Packet Length Variance", "Average Packet Size"),
    "TCP Flags": ("FIN Flag", "SYN Flag", "RST Flag", "PSH Flag", "ACK Flag", "URG Flag",
                  "CWR Flag", "ECE Flag"),
    "Subflow": ("Subflow Fwd", "Subflow Bwd"),
    "Window Sizes": ("Init_Win_bytes",),
    "Active/Idle": ("Active Mean", "Active Std", "Active Max", "Active Min", "Idle Mean",
                    "Idle Std", "Idle Max", "Idle Min"),
}

# --- Fixed values: enumerations of the log table and the subscriber registry. ---
LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
LOG_SOURCES = ("PREDICTION", "SYSTEM", "CAPTURE", "USER", "ERROR")
SUBSCRIBER_STATES = ("pending", "approved")

IDENTITY_COLUMNS = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")


_TYPES = {"BIGINT": T.LongType, "INT": T.IntegerType, "DOUBLE": T.DoubleType, "STRING": T.StringType,
          "BOOLEAN": T.BooleanType, "TIMESTAMP": T.TimestampType}


def _table(columns: str) -> T.StructType:
    """Schema from ``name TYPE, ...``; needs no session, so importing stays cheap anywhere."""
    pairs = [c.rsplit(" ", 1) for c in columns.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]()) for name, kind in pairs])


DETECTIONS = _table(
    "id BIGINT, model_id BIGINT, source_ip STRING, destination_ip STRING, prediction INT, "
    "confidence DOUBLE, source_type STRING, raw_features STRING, severity STRING, "
    "attack_type STRING, attack_reason STRING, is_whitelisted BOOLEAN, is_blacklisted BOOLEAN, "
    "created_at TIMESTAMP")
ALERTS = _table(
    "id BIGINT, source_ip STRING, threat_type STRING, detection_id BIGINT, occurrences INT, "
    "first_seen TIMESTAMP, last_seen TIMESTAMP, is_acknowledged BOOLEAN, telegram_sent BOOLEAN")
LOGS = _table(
    "id BIGINT, source STRING, level STRING, message STRING, metadata STRING, created_at TIMESTAMP")
IP_LIST = _table("id BIGINT, ip_address STRING, reason STRING, created_at TIMESTAMP")
SYSTEM_METRICS = _table(
    "id BIGINT, cpu_percent DOUBLE, ram_percent DOUBLE, disk_percent DOUBLE, "
    "network_sent_bytes BIGINT, network_recv_bytes BIGINT, active_threads INT, created_at TIMESTAMP")
MODELS = _table(
    "id BIGINT, name STRING, file_path STRING, model_type STRING, version STRING, "
    "features_count INT, is_active BOOLEAN, created_at TIMESTAMP, metadata STRING")
SUBSCRIBERS = _table(
    "id BIGINT, chat_id STRING, label STRING, is_active BOOLEAN, status STRING, created_at TIMESTAMP")
SETTINGS = _table("key STRING, value STRING, updated_at TIMESTAMP")
LABELLED_FLOWS = _table(", ".join(f"{name} DOUBLE" for name in FEATURES) + ", Label STRING")

# Values taken by columns that older files lack.
COLUMN_DEFAULTS = {
    "severity": "", "attack_type": "", "attack_reason": "", "is_whitelisted": False,
    "is_blacklisted": False, "occurrences": 1, "is_acknowledged": False, "telegram_sent": False,
    "is_active": True, "status": "approved", "label": "", "version": "1.0",
}


def col(name: str):
    """Column by exact name, safe for names holding dots or slashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Project ``df`` onto ``schema``: absent columns appear with their default, types are
    cast without failing, extra columns are dropped."""
    defaults = {**COLUMN_DEFAULTS, **(defaults or {})}
    present = set(df.columns)
    out = []
    for field in schema.fields:
        if field.name in present:
            value = col(field.name).try_cast(field.dataType)
        else:
            value = F.lit(defaults.get(field.name)).cast(field.dataType)
        out.append(value.alias(field.name))
    return df.select(*out)
