"""Windowed streaming queries: macro-flows, alerts, rates, duplicate protection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowtide.operators.macro import DEFAULT_KEY, MacroPlan
from flowtide.schemas import col


def merge_locally(spark: SparkSession) -> None:
    """Let session windows merge inside a task before the shuffle, which tames hot keys."""
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def without_duplicates(stream: DataFrame, ids: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Drop repeats of a flow id arriving within the watermark."""
    return _event_time(stream, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(ids))


def tumbling_counts(stream: DataFrame, ts: str, width: str, delay: str, *by: str) -> DataFrame:
    """Rows per tumbling window and group."""
    grouped = _event_time(stream, ts).withWatermark(ts, delay).groupBy(F.window(ts, width), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), *by, "n")


def sliding_rate(stream: DataFrame, ts: str, delay: str, width: str = "1 minute",
                 step: str = "10 seconds") -> DataFrame:
    """Rows of the last minute, every ten seconds."""
    grouped = _event_time(stream, ts).withWatermark(ts, delay).groupBy(F.window(ts, width, step))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), "n")


def macro_stream(stream: DataFrame, ts: str, features: Sequence[str], key: Sequence[str] = DEFAULT_KEY,
                 gap: str = "10 seconds", delay: str = "10 seconds", min_members: int = 2,
                 weighting: str = "reference", order_by: Sequence[str] = ()) -> DataFrame:
    """Macro-flows over gap windows: a key pausing longer than the gap closes its macro-flow.

    The reducers are those of the batch form, so values far from zero keep their spread here too: the window's state
    holds the same mergeable moments, whatever micro-batches the members come in.
    """
    merge_locally(stream.sparkSession)
    plan = MacroPlan(features, min_members, weighting, order_by or [ts])
    members = plan.with_inputs(_event_time(stream, ts)).withWatermark(ts, delay)
    grouped = members.groupBy(*[col(k) for k in key], F.session_window(ts, gap).alias("_win")).agg(*plan.reducers())
    return plan.finish([*key, "window_start"], grouped.withColumn("window_start", F.col("_win.start")))


def alert_stream(stream: DataFrame, window_minutes: float, delay: str) -> DataFrame:
    """Closed alerts per source and threat; a pause of exactly the window continues the alert."""
    merge_locally(stream.sparkSession)
    gap = f"{int(window_minutes * 60)} seconds"
    timed = _event_time(stream, "created_at").withWatermark("created_at", delay)
    return timed.groupBy("source_ip", "threat_type", F.session_window("created_at", gap).alias("_w")).agg(
        F.count(F.lit(1)).alias("occurrences"), F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
        F.min_by("id", F.struct("created_at", "id")).alias("detection_id")).drop("_w")
