"""Alerts: policy, threat type, gap sessions, escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide.operators.decide import BENIGN, BLOCKED_THREAT, DEFAULT_THREAT
from flowtide.operators.gaps import slot_of, with_sessions
from flowtide.operators.skew import Slices, attach

# --- Fixed values: occurrence counts that escalate, and the default window. ---
ESCALATION_LEVELS = (5, 10, 25, 50, 100)
WINDOW_MINUTES = 10

KEY = ["source_ip", "threat_type"]


def alert_action() -> Column:
    """What a detection does: trusted and protected sources never alert, listed sources always
    do, benign traffic does not, the rest aggregates."""
    return (F.when(F.col("is_whitelisted"), "suppressed_whitelist")
            .when(F.col("is_protected"), "suppressed_protected")
            .when(F.col("is_blacklisted"), "forced")
            .when(F.col("prediction") == BENIGN, "none")
            .otherwise("aggregate"))


def threat_type() -> Column:
    """Class name of an attack or the default; a listed source without a specific class is a
    blocked address attempting access."""
    named = (F.col("prediction") != BENIGN) & (F.col("attack_type") != "")
    base = F.when(named, F.col("attack_type")).otherwise(DEFAULT_THREAT)
    generic = (F.col("prediction") == BENIGN) | (base == DEFAULT_THREAT)
    return F.when(F.col("is_blacklisted") & generic, BLOCKED_THREAT).otherwise(base)


def alertable(detections: DataFrame) -> DataFrame:
    """Detections that feed alerts, with their threat type."""
    return (detections.withColumn("alert_action", alert_action())
            .filter(F.col("alert_action").isin("forced", "aggregate"))
            .withColumn("threat_type", threat_type())
            .withColumn("source_ip", F.coalesce("source_ip", F.lit("unknown"))))


def _slots(events: DataFrame, window_minutes: float) -> DataFrame:
    slot = slot_of(F.col("created_at"), window_minutes * 60).alias("slot")
    return events.groupBy(*KEY, slot).agg(
        F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
        F.min(F.struct("created_at", "id")).alias("opening"))


def alerts(events: DataFrame, window_minutes: float = WINDOW_MINUTES,
           acknowledged: DataFrame | None = None) -> DataFrame:
    """One row per alert: an event within the window of the previous one of its source and
    threat joins the alert, a longer pause opens a new one.

    ``events`` needs source_ip, threat_type, created_at, id. ``acknowledged`` optionally lists
    detection ids whose alert an operator has acknowledged; such alerts still absorb events.
    """
    sessions = with_sessions(_slots(events, window_minutes), KEY, window_minutes * 60)
    out = sessions.groupBy(*KEY, "session").agg(
        F.min("opening").getField("id").alias("detection_id"), F.sum("n").alias("occurrences"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).drop("session")
    if acknowledged is None:
        return out.withColumn("is_acknowledged", F.lit(False))
    marks = acknowledged.select("detection_id").distinct().withColumn("_ack", F.lit(True))
    return (out.join(marks, "detection_id", "left")
            .withColumn("is_acknowledged", F.coalesce("_ack", F.lit(False))).drop("_ack"))


def alert_events(events: DataFrame, window_minutes: float = WINDOW_MINUTES,
                 levels: tuple[int, ...] = ESCALATION_LEVELS, known: DataFrame | None = None) -> DataFrame:
    """NEW and ESCALATION events with the detection that caused them.

    ``known`` holds the newest alert of each key from before these events; events within the window of it go on
    counting. Only the first ``max(levels)`` events of a slot can matter. The rank filter lets Spark drop
    the rest before the shuffle, so a flood never travels.
    """
    deepest = max(levels)
    slotted = events.withColumn("slot", slot_of(F.col("created_at"), window_minutes * 60))
    ranked = (slotted.withColumn("_rn", F.row_number().over(
        Window.partitionBy(*KEY, "slot").orderBy("created_at", "id")))
        .filter(F.col("_rn") <= deepest))
    slots = _slots(events, window_minutes)
    if known is not None:
        # A known alert stands before all slots, with its last event and all its occurrences.
        slots = slots.unionByName(known.select(
            *KEY, F.lit(-(1 << 63)).cast("long").alias("slot"), F.col("occurrences").alias("n"), F.col("last_seen").alias("first_seen"), "last_seen",
            F.struct(F.col("first_seen").alias("created_at"), F.col("detection_id").alias("id")).alias("opening")))
    sessions = with_sessions(slots, KEY, window_minutes * 60)
    # The opening detection of the first slot identifies the alert.
    opened = sessions.withColumn("alert_id", F.first("opening").over(
        Window.partitionBy(*KEY, "session").orderBy("slot")).getField("id"))
    relevant = opened.filter(F.col("prior") < deepest).select(*KEY, "slot", "prior", "alert_id")
    counted = (ranked.join(relevant, [*KEY, "slot"])
               .withColumn("occurrence", (F.col("prior") + F.col("_rn")).cast("long")))
    kind = (F.when(F.col("occurrence") == 1, "NEW")
            .when(F.col("occurrence").isin(*levels), "ESCALATION"))
    return (counted.withColumn("kind", kind).filter(F.col("kind").isNotNull())
            .drop("_rn", "prior", "slot"))


def numbered_events(events: DataFrame, window_minutes: float = WINDOW_MINUTES,
                    slices: int | None = None) -> DataFrame:
    """Every event with its occurrence number inside its alert, exact for any key size.

    Events are range-sliced by (key, time, id), so positions within the key come from slice
    sizes; the first position of each alert comes from the slot table.
    """
    cut = Slices(events, KEY, ["created_at", "id"], "alert-events", slices)
    placed = cut.numbered("_pos").withColumn("slot", slot_of(F.col("created_at"), window_minutes * 60))
    sessions = with_sessions(_slots(cut.df, window_minutes), KEY, window_minutes * 60)
    by_key = Window.partitionBy(*KEY).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    before = (sessions.withColumn("_before", F.coalesce(F.sum("n").over(by_key), F.lit(0)))
              .withColumn("_skip", F.col("_before") - F.col("prior"))
              .select(*KEY, "slot", "n", "_skip", "session"))
    return (attach(placed, before, [*KEY, "slot"], "n")
            .withColumn("occurrence", (F.col("_pos") - F.col("_skip")).cast("long"))
            .drop("_pos", "_skip", "slot", "n"))


def latest_per_key(stored: DataFrame) -> DataFrame:
    """Most recently seen alert of every key."""
    rest = [c for c in stored.columns if c not in KEY]
    newest = F.max_by(F.struct(*rest), F.struct("last_seen", "detection_id")).alias("_a")
    return stored.groupBy(*KEY).agg(newest).select(*KEY, *[F.col(f"_a.{c}").alias(c) for c in rest])


def open_alert(stored: DataFrame, probes: DataFrame, window_minutes: float = WINDOW_MINUTES) -> DataFrame:
    """For each probe (source_ip, threat_type, at): the latest stored alert seen no earlier than
    ``at`` minus the window. If any alert of the key qualifies, its newest one does, so one
    pre-aggregated row per key is joined."""
    rest = [c for c in stored.columns if c not in KEY]
    newest = stored.groupBy(*KEY).agg(
        F.max_by(F.struct(*rest), F.struct("last_seen", "detection_id")).alias("_a"))
    joined = probes.join(newest, KEY, "left")
    edge = F.col("at") - F.make_dt_interval(secs=F.lit(float(window_minutes * 60)))
    active = F.when(F.col("_a.last_seen") >= edge, F.col("_a"))
    return (joined.withColumn("_a", active)
            .select(*KEY, "at", *[F.col(f"_a.{c}").alias(c) for c in rest]))


def fold_alerts(stored: DataFrame, fresh: DataFrame, window_minutes: float = WINDOW_MINUTES) -> DataFrame:
    """Upsert: merge newly aggregated alerts into stored ones. Both are alert rows; rows of a key
    within the window of one another become one alert."""
    both = stored.unionByName(fresh, allowMissingColumns=True)
    gap = int(window_minutes * 60 * 1_000_000)
    by_key = Window.partitionBy(*KEY).orderBy("first_seen", "detection_id")
    reached = F.max("last_seen").over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    pause = F.unix_micros(F.col("first_seen").cast("timestamp")) - F.unix_micros(reached.cast("timestamp"))
    tagged = both.withColumn("_new", F.when(pause <= gap, 0).otherwise(1)).withColumn(
        "_session", F.sum("_new").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    return tagged.groupBy(*KEY, "_session").agg(
        F.min_by("detection_id", F.struct("first_seen", "detection_id")).alias("detection_id"),
        F.sum("occurrences").alias("occurrences"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.bool_or("is_acknowledged").alias("is_acknowledged")).drop("_session")
