"""Macro-flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide import driver_tables as dt
from flowtide.catalog._shared import rounded
from flowtide.catalog.ansi import sql
from flowtide.operators import decide, macro
from flowtide.schemas import col

KEY = list(macro.DEFAULT_KEY)
_NAMES = {"Flow Duration": "dur", "Total Fwd Packets": "fwd", "Flow Bytes/s": "bps",
          "Fwd Packet Length Min": "plmin", "Fwd Packet Length Std": "plstd", "Flow IAT Max": "iatmax",
          "Flow IAT Mean": "iatmean", "SYN Flag Count": "syn", "Average Packet Size": "aps"}


def _macros(spark, sf, **options):
    return macro.assemble(dt.flows(spark, sf), features=dt.FLOW_FEATURES, **options)


def _shown(df, keys):
    return df.select(*keys, "member_count", *[rounded(col(f)).alias(n) for f, n in _NAMES.items()])


def assemble(spark, sf):
    return _shown(_macros(spark, sf), KEY)


def assemble_packets(spark, sf):
    return _shown(_macros(spark, sf, weighting="packets", min_members=1), KEY)


def assemble_by_source(spark, sf):
    """A custom key: source only."""
    return _shown(_macros(spark, sf, key=["src_ip"]), ["src_ip"])


def _scored(spark, sf):
    """A rule stands in for a model here: heavy SYN share with many members is an attack."""
    return _macros(spark, sf).withColumn(
        "prediction", F.when(F.col("`SYN Flag Count`") > F.col("member_count"), 1).otherwise(0)
    ).select(*KEY, "member_count", "prediction")


def attribution(spark, sf):
    rows = macro.attribute(dt.flows(spark, sf), _scored(spark, sf), KEY)
    return rows.select("l_orderkey", "l_linenumber", "src_port", *KEY, "member_count", "prediction")


def summary(spark, sf):
    units = _scored(spark, sf)
    rows = macro.attribute(dt.flows(spark, sf), units, KEY)
    return decide.summarize(rows, units).withColumn("threat_density", rounded(F.col("threat_density")))


def gap_windows(spark, sf):
    """Events as single-packet flows, split where a user pauses more than an hour."""
    d = dt.detections(spark, sf).select(
        F.col("source_ip").alias("src_ip"), "created_at",
        F.col("value").alias("Flow Duration"), (F.col("k") * 1.0).alias("Fwd IAT Mean"))
    tagged = macro.group_windows(d, "created_at", 3600, ["src_ip"])
    out = macro.assemble(tagged, ["src_ip", "window_start"], ["Flow Duration", "Fwd IAT Mean"],
                         min_members=1)
    return out.select("src_ip", "window_start", "member_count",
                      rounded(F.col("Flow Duration")).alias("dur"),
                      rounded(F.col("Fwd IAT Mean")).alias("iat"))


_HARD = ["Flow Duration", "Flow IAT Std", "Flow IAT Mean", "Total Fwd Packets", "Destination Port"]


def _hard_flows(spark, sf):
    """Flows with null key members, members that aren't finite, spread around 1e8, and a port that isn't a key."""
    at = "l_orderkey % 7"
    return dt.flows(spark, sf).selectExpr(
        "l_orderkey", "l_linenumber", f"CASE WHEN {at} = 0 THEN NULL ELSE src_ip END AS src_ip",
        f"CASE WHEN {at} = 1 THEN NULL ELSE protocol END AS protocol",
        f"CASE WHEN {at} = 2 THEN double('Infinity') WHEN {at} = 3 THEN double('NaN') ELSE `Flow Duration` END AS `Flow Duration`",
        "1e8 + l_orderkey % 5 * 0.25 AS `Flow IAT Std`",
        f"CASE WHEN {at} = 4 THEN NULL ELSE `Flow IAT Mean` END AS `Flow IAT Mean`", "`Total Fwd Packets`",
        "CAST(l_linenumber * 100 + l_orderkey % 3 AS DOUBLE) AS `Destination Port`")


def null_keys(spark, sf):
    """Null key members group like values; the port is that of the first member by order and line."""
    out = macro.assemble(_hard_flows(spark, sf), ["src_ip", "protocol"], _HARD, order_by=["l_orderkey", "l_linenumber"])
    return out.select("src_ip", "protocol", "member_count", rounded(col("Flow Duration")).alias("dur"),
                      rounded(col("Flow IAT Std")).alias("spread"), rounded(col("Flow IAT Mean"), 3).alias("iat"),
                      col("Destination Port").alias("port"))


def null_key_members(spark, sf):
    """Every flow of a null key gets its macro-flow's size back."""
    rows = _hard_flows(spark, sf)
    units = macro.assemble(rows, ["src_ip", "protocol"], ["Total Fwd Packets"])
    back = macro.attribute(rows.select("l_orderkey", "l_linenumber", "src_ip", "protocol"),
                           units.select("src_ip", "protocol", "member_count"), ["src_ip", "protocol"])
    return back.select("l_orderkey", "l_linenumber", "src_ip", "protocol", "member_count")


_HARD_SQL = """
  SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE src_ip END AS src_ip,
    CASE WHEN l_orderkey % 7 = 1 THEN NULL ELSE protocol END AS protocol,
    CASE WHEN l_orderkey % 7 IN (2, 3) THEN 0 ELSE dur END AS dur, 1e8 + l_orderkey % 5 * 0.25 AS spread,
    CASE WHEN l_orderkey % 7 = 4 THEN NULL ELSE iatmean END AS iat, fwd AS w,
    CAST(l_linenumber * 100 + l_orderkey % 3 AS DOUBLE) AS port FROM flows"""


def _assemble_sql(keys: str, weight: str, lone: bool) -> str:
    names = ["src_ip", "dst_ip", "dst_port", "protocol"] if keys == "all" else [keys]
    k = ", ".join(names)
    on = " AND ".join(f"f.{n} = m.{n}" for n in names)
    raw = (lambda agg, c: f"CASE WHEN count(*) = 1 THEN max(f.{c}) ELSE {agg} END") if lone else (
        lambda agg, c: agg)
    spread = ("CASE WHEN sum(w) <= 1 THEN 0 ELSE sqrt(sum(w * (f.plstd - m.centre) ** 2) / sum(w)) END")
    r = lambda e: f"round(round({e}, 6) + 1e-7, 4)"
    return sql("flows", f"""
      SELECT {', '.join('f.' + n for n in names)}, count(*) AS member_count, {r('sum(dur)')} AS dur,
        {r('sum(fwd)')} AS fwd, {r(raw('sum(bps * dur) / sum(dur)', 'bps'))} AS bps,
        {r('min(plmin)')} AS plmin, {r(raw(spread, 'plstd'))} AS plstd, {r('max(iatmax)')} AS iatmax,
        {r(raw('sum(iatmean * w) / sum(w)', 'iatmean'))} AS iatmean, {r('sum(syn)')} AS syn,
        {r(raw('sum(aps * w) / sum(w)', 'aps'))} AS aps
      FROM wf f JOIN centres m ON {on} GROUP BY {', '.join('f.' + n for n in names)}""",
               wf=f"SELECT *, {weight} AS w FROM flows",
               centres=f"SELECT {k}, sum(plstd * w) / sum(w) AS centre FROM wf GROUP BY {k}")


_UNITS = """SELECT src_ip, dst_ip, dst_port, protocol, count(*) AS member_count,
  CASE WHEN sum(syn) > count(*) THEN 1 ELSE 0 END AS prediction FROM flows
  GROUP BY src_ip, dst_ip, dst_port, protocol"""

ENTRIES = {
    "macro_assemble": (assemble, _assemble_sql("all", "fwd + aps", True)),
    "macro_assemble_packet_weight": (assemble_packets, _assemble_sql("all", "fwd", False)),
    "macro_assemble_custom_key": (assemble_by_source, _assemble_sql("src_ip", "fwd + aps", True)),
    "macro_null_key": (null_keys, sql("flows", """
        SELECT h.src_ip, h.protocol, count(*) AS member_count, round(round(sum(dur), 6) + 1e-7, 4) AS dur,
          round(round(CASE WHEN count(*) = 1 THEN max(spread) WHEN sum(w) <= 1 THEN 0
            ELSE sqrt(sum(w * (spread - m.centre) ** 2) / sum(w)) END, 6) + 1e-7, 4) AS spread,
          round(round(CASE WHEN count(*) = 1 THEN max(iat) ELSE sum(iat * w) / sum(w) FILTER (iat IS NOT NULL) END, 6) + 1e-7, 3) AS iat,
          first(port ORDER BY l_orderkey, l_linenumber) AS port
        FROM hard h JOIN centres m ON h.src_ip IS NOT DISTINCT FROM m.src_ip AND h.protocol IS NOT DISTINCT FROM m.protocol
        GROUP BY h.src_ip, h.protocol""", hard=_HARD_SQL,
        centres="SELECT src_ip, protocol, sum(spread * w) / sum(w) AS centre FROM hard GROUP BY src_ip, protocol")),
    "macro_null_key_members": (null_key_members, sql("flows", """
        SELECT l_orderkey, l_linenumber, src_ip, protocol, count(*) OVER (PARTITION BY src_ip, protocol) AS member_count
        FROM hard""", hard=_HARD_SQL)),
    "macro_attribution": (attribution, sql("flows", """
        SELECT l_orderkey, l_linenumber, src_port, f.src_ip, f.dst_ip, f.dst_port, f.protocol,
          member_count, prediction
        FROM flows f JOIN units u ON f.src_ip = u.src_ip AND f.dst_ip = u.dst_ip
          AND f.dst_port = u.dst_port AND f.protocol = u.protocol""", units=_UNITS)),
    "macro_summary": (summary, sql("flows", """
        SELECT total_rows, attack_rows, attack_units, total_rows - attack_rows AS normal_rows,
          total_rows - attack_units AS normal_reference,
          round(attack_units * 100.0 / total_rows + 1e-7, 4) AS threat_density
        FROM (SELECT count(*) AS total_rows FROM flows),
          (SELECT count(*) FILTER (WHERE prediction = 1) AS attack_units,
             CAST(coalesce(sum(member_count) FILTER (WHERE prediction = 1), 0) AS BIGINT) AS attack_rows
           FROM units)""", units=_UNITS)),
    "macro_gap_windows": (gap_windows, sql("det", """
        SELECT source_ip AS src_ip, min(created_at) AS window_start, count(*) AS member_count,
          round(sum(value) + 1e-7, 4) AS dur, round(sum(k * 1.0) / count(*) + 1e-7, 4) AS iat
        FROM (SELECT *, sum(opens) OVER (PARTITION BY source_ip ORDER BY created_at, id) AS session
          FROM (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY source_ip
            ORDER BY created_at, id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM det))
        GROUP BY source_ip, session""")),
}
