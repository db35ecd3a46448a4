"""Flow preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from flowtide import driver_tables as dt
from flowtide.catalog._shared import rounded
from flowtide.catalog.ansi import sql
from flowtide.operators import align, decide
from flowtide.schemas import col, conform

REQUIRED = ["Flow Duration", "Total Fwd Packets", "Flow Bytes/s", "SYN Flag Count", "Fwd Header Length.1",
            "Missing A"]
KEEP = ["l_orderkey", "l_linenumber"]


def _variant(spark, sf):
    """Line items under exporter spellings, with null, NaN and infinite cells."""
    return dt.table(spark, sf, "lineitem").selectExpr(
        *KEEP, "CASE WHEN l_linenumber <> 3 THEN l_quantity END AS flow_duration",
        "CASE WHEN l_linenumber = 4 THEN double('NaN') ELSE l_extendedprice END AS tot_fwd_pkts",
        "CASE WHEN l_linenumber = 5 THEN double('Infinity') ELSE l_tax END AS flow_byts_s",
        "l_discount AS `SYN Flag Cnt`", "l_suppkey AS fwd_header_len", "l_returnflag AS note")


_PLAIN = ["dur", "fwd", "bps", "syn", "hdr", "missing_a"]


def aligned(spark, sf):
    out = align.align(_variant(spark, sf), REQUIRED, KEEP)
    return out.select(*KEEP, *[col(r).alias(p) for r, p in zip(REQUIRED, _PLAIN)],
                      F.array_join("missing_features", "|").alias("missing"),
                      rounded(F.col("coverage")).alias("coverage"))


def aligned_frame(spark, sf):
    out = align.align(_variant(spark, sf), REQUIRED, KEEP, report="frame")
    return out.groupBy(F.array_join("missing_features", "|").alias("missing")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(col("Flow Duration") == 0, 1).otherwise(0)).alias("zeros"))


def coverage(spark, sf):
    """Rows accepted and rejected at a coverage of 0.8."""
    ok, bad = align.covered(align.align(_variant(spark, sf), REQUIRED, KEEP), 0.8)
    return ok.agg(F.count(F.lit(1)).alias("accepted")).withColumn("rejected", bad.agg(F.count(F.lit(1))).scalar())


def identity(spark, sf):
    """Identity columns found by title or fragment; ports coerced from text."""
    o = dt.table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderkey % 5 <> 0 THEN concat('  10.9.', o_custkey % 200, '.1 ') END AS `Client Source IP`",
        "o_orderpriority AS ` Dst Port`", "CAST(o_custkey + 0.75 AS STRING) AS `Source Port`",
        "o_totalprice AS `Flow Duration`", "o_orderstatus AS Label", "o_orderkey AS `Flow Tag`")
    f = align.flows_from_frame(o)
    return f.select("src_ip", "dst_ip", "src_port", "dst_port", "protocol", col("Flow Duration").alias("dur"),
                    col("Flow Tag").cast("bigint").alias("tag"), F.lit(len(f.columns)).alias("width"))


def sanitized(spark, sf):
    out = align.sanitize(_variant(spark, sf))
    return out.select(*KEEP, "flow_duration", "tot_fwd_pkts", "flow_byts_s", "note")


def cleaned(spark, sf):
    v = _variant(spark, sf)
    kept = align.drop_unusable(v)
    unique = kept.dropDuplicates()
    return (v.agg(F.count(F.lit(1)).alias("total"))
            .withColumn("kept", kept.agg(F.count(F.lit(1))).scalar())
            .withColumn("unique_rows", unique.agg(F.count(F.lit(1))).scalar()))


def duplicates(spark, sf):
    """Full-row duplicates among (order, line) pairs and how many were removed."""
    pairs = dt.table(spark, sf, "lineitem").select(*KEEP)
    unique = pairs.dropDuplicates()
    return (unique.agg(F.count(F.lit(1)).alias("kept"))
            .withColumn("removed", pairs.agg(F.count(F.lit(1))).scalar() - F.col("kept")))


def json_scored(spark, sf):
    """Feature objects as JSON text: the events' props plus a value, aligned and judged."""
    e = dt.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit('{"Flow-Duration": '), "value", F.lit(', "tot_fwd_pkts": '),
                             F.get_json_object("props", "$.k"), F.lit("}")).alias("payload"))
    a = align.align_json(e, "payload", ["Flow Duration", "Total Fwd Packets", "SYN Flag Count"], ["event_id"])
    p = F.when(col("Flow Duration") > 50, 0.9).otherwise(0.2)
    cls, conf = decide.decide_score(p)
    return a.select("event_id", col("Flow Duration").alias("dur"), col("Total Fwd Packets").alias("fwd"),
                    F.size("missing_features").alias("missing"), cls.alias("prediction"), conf.alias("confidence"),
                    F.when(cls != 0, "ATTACK").otherwise("BENIGN").alias("verdict"))


def schema_evolution(spark, sf):
    target = T.StructType.fromDDL("c_custkey BIGINT, c_nationkey STRING, severity STRING, is_active BOOLEAN, "
                                  "occurrences INT, note STRING")
    return conform(dt.table(spark, sf, "customer"), target)


def union_pools(spark, sf):
    """Pools of different width are merged by name."""
    c = dt.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    s = dt.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    u = c.unionByName(s, allowMissingColumns=True)
    return u.agg(F.count(F.lit(1)).alias("n"), F.count("balance").alias("balances"), F.count("name").alias("names"))


def row_cap(spark, sf):
    """A capped audit: the cap is exact and leaves everything when 0."""
    f = dt.table(spark, sf, "orders")
    capped = align.flows_from_frame(f, max_rows=1000).agg(F.count(F.lit(1)).alias("capped"))
    return capped.withColumn("uncapped", align.flows_from_frame(f, max_rows=0).agg(F.count(F.lit(1))).scalar())


def common_classes(spark, sf):
    """Classes two reports share."""
    a = dt.table(spark, sf, "customer").select("c_nationkey")
    b = dt.table(spark, sf, "supplier").filter("s_suppkey < 20").select("s_nationkey")
    return a.intersect(b)


_VAR = """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS flow_duration,
  CASE WHEN l_linenumber = 4 THEN 'NaN'::DOUBLE ELSE l_extendedprice END AS tot_fwd_pkts,
  CASE WHEN l_linenumber = 5 THEN 'Infinity'::DOUBLE ELSE l_tax END AS flow_byts_s,
  l_discount AS syn, l_suppkey AS hdr, l_returnflag AS note FROM lineitem"""
_MISSING = """concat_ws('|', CASE WHEN l_linenumber = 3 THEN 'Flow Duration' END,
  CASE WHEN l_linenumber = 4 THEN 'Total Fwd Packets' END, 'Missing A')"""

ENTRIES = {
    "align_rows": (aligned, sql("", f"""
        SELECT l_orderkey, l_linenumber, coalesce(flow_duration, 0) AS dur,
          CASE WHEN l_linenumber = 4 THEN 0 ELSE tot_fwd_pkts END AS fwd,
          CASE WHEN l_linenumber = 5 THEN 0 ELSE flow_byts_s END AS bps, syn, CAST(hdr AS DOUBLE) AS hdr,
          0.0::DOUBLE AS missing_a, {_MISSING} AS missing,
          round(1 - CASE WHEN l_linenumber IN (3, 4) THEN 2 ELSE 1 END / 6.0::DOUBLE + 1e-7, 4) AS coverage
        FROM v""", v=_VAR)),
    "align_frame": (aligned_frame, sql("", """
        SELECT 'Missing A' AS missing, count(*) AS n, count(*) FILTER (WHERE l_linenumber = 3
          OR l_quantity = 0) AS zeros FROM lineitem""")),
    "coverage_guard": (coverage, """
        SELECT count(*) FILTER (WHERE l_linenumber NOT IN (3, 4)) AS accepted,
          count(*) FILTER (WHERE l_linenumber IN (3, 4)) AS rejected FROM lineitem"""),
    "identity_columns": (identity, """
        SELECT CASE WHEN o_orderkey % 5 <> 0 THEN '10.9.' || (o_custkey % 200) || '.1' ELSE 'Unknown' END AS src_ip,
          'Unknown' AS dst_ip, CAST(o_custkey AS INTEGER) AS src_port, 0 AS dst_port, 0 AS protocol,
          o_totalprice AS dur, o_orderkey AS tag, 9 AS width FROM orders"""),
    "sanitize_batch": (sanitized, sql("", """
        SELECT l_orderkey, l_linenumber, coalesce(flow_duration, 0) AS flow_duration,
          CASE WHEN l_linenumber = 4 THEN 0 ELSE tot_fwd_pkts END AS tot_fwd_pkts,
          CASE WHEN l_linenumber = 5 THEN 0 ELSE flow_byts_s END AS flow_byts_s, note FROM v""", v=_VAR)),
    "training_clean": (cleaned, sql("", """
        SELECT (SELECT count(*) FROM lineitem) AS total, count(*) AS kept,
          count(DISTINCT (l_orderkey, l_linenumber, flow_duration, tot_fwd_pkts, flow_byts_s, syn, hdr, note))
            AS unique_rows
        FROM v WHERE l_linenumber NOT IN (3, 4, 5)""", v=_VAR)),
    "duplicate_rows": (duplicates, """
        SELECT count(DISTINCT (l_orderkey, l_linenumber)) AS kept,
          count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS removed FROM lineitem"""),
    "json_scoring": (json_scored, sql("det", """
        SELECT id AS event_id, value AS dur, CAST(k AS DOUBLE) AS fwd, 1 AS missing,
          CASE WHEN value > 50 THEN 1 ELSE 0 END AS prediction,
          CASE WHEN value > 50 THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence,
          CASE WHEN value > 50 THEN 'ATTACK' ELSE 'BENIGN' END AS verdict FROM det""")),
    "schema_evolution": (schema_evolution, """
        SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey, '' AS severity, TRUE AS is_active,
          1 AS occurrences, CAST(NULL AS VARCHAR) AS note FROM customer"""),
    "union_pools": (union_pools, """
        SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n,
          (SELECT count(c_acctbal) FROM customer) AS balances, (SELECT count(s_name) FROM supplier) AS names"""),
    "row_cap": (row_cap, "SELECT least(count(*), 1000) AS capped, count(*) AS uncapped FROM orders"),
    "common_classes": (common_classes, """
        SELECT DISTINCT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier
        WHERE s_suppkey < 20"""),
}
