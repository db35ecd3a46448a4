"""Notification outbox: who is told, and what. Delivery is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.functions.messages import escalation_message, threat_message
from flowtide.functions.scalars import is_chat_id
from flowtide.operators.decide import severity_of


def recipients(subscribers: DataFrame, fallback: Sequence[str] = ()) -> DataFrame:
    """Approved, active chats. The fallback list applies only while nobody is registered."""
    ready = (subscribers.filter((F.col("is_active")) & (F.col("status") == "approved"))
             .select("chat_id").distinct())
    if not fallback:
        return ready
    registered = subscribers.agg(F.count(F.lit(1)))
    chats = F.array(*[F.lit(c) for c in fallback])
    spare = (registered.toDF("n").filter(F.col("n") == 0)
             .select(F.explode(chats).alias("chat_id")))
    return ready.union(spare)


def valid_chats(subscribers: DataFrame) -> DataFrame:
    return subscribers.filter(is_chat_id(F.col("chat_id")))


def severity_shown() -> Column:
    """Severity stored with the detection, else the confidence band."""
    stored = F.upper(F.when(F.col("severity") != "", F.col("severity")))
    return F.coalesce(stored, severity_of(F.col("confidence"), F.lit(True)))


def compose(events: DataFrame, chats: DataFrame, product: str = "Flow analytics") -> DataFrame:
    """One row per event and recipient, with the text.

    ``events`` carries kind (NEW or ESCALATION), alert_id, occurrence, source_ip, threat_type,
    destination_ip, model_name, confidence, source_type, severity, reason and created_at. The
    text is built once per event; each event then meets the recipients through a lane number,
    so fan-out is spread evenly over the shuffle whatever the alert keys look like.
    """
    lane_count = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texted = events.withColumn("event_time", F.col("created_at")).withColumn("severity", severity_shown())
    message = (F.when(F.col("kind") == "NEW", threat_message(F.col("severity"), product))
               .otherwise(escalation_message(F.col("severity"), product)))
    lanes = chats.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lane_count - 1))))
    return (texted.withColumn("message", message)
            .withColumn("_lane", F.pmod(F.xxhash64("id", "kind"), F.lit(lane_count)).cast("int"))
            .join(lanes, "_lane").drop("_lane", "event_time"))
