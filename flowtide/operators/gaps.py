"""Gap sessions in two levels: slots no wider than the gap, then slots into sessions.

Two events of one slot are never further apart than the gap, so they always share a session.
Slot rows come from a map-side combined aggregate; per key there are at most
(time span / gap) of them however many events the key has. That makes hot keys harmless.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide.operators.skew import HOT_ROWS, attach
from flowtide.schemas import col


def micros(ts: Column) -> Column:
    """Microseconds since the epoch (session zone UTC for zone-less input)."""
    return F.unix_micros(ts.cast("timestamp"))


def slot_of(ts: Column, gap_seconds: float) -> Column:
    """Slot number; a slot spans exactly one gap."""
    return F.floor(micros(ts) / F.lit(int(gap_seconds * 1_000_000))).cast("long")


def with_sessions(slots: DataFrame, keys: Sequence[str], gap_seconds: float,
                  n: str = "n", first: str = "first_seen", last: str = "last_seen",
                  slot: str = "slot") -> DataFrame:
    """Number the sessions of slot rows and add the events of earlier slots of the session
    (``prior``). A pause of exactly the gap still continues the session."""
    gap = int(gap_seconds * 1_000_000)
    by_key = Window.partitionBy(*[col(k) for k in keys]).orderBy(slot)
    pause = micros(F.col(first)) - micros(F.lag(last).over(by_key))
    flagged = slots.withColumn("_new", F.when(pause <= gap, F.lit(0)).otherwise(F.lit(1)))
    numbered = flagged.withColumn("session", F.sum("_new").over(
        by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    in_session = (Window.partitionBy(*[col(k) for k in keys], "session").orderBy(slot)
                  .rowsBetween(Window.unboundedPreceding, -1))
    return (numbered.withColumn("prior", F.coalesce(F.sum(n).over(in_session), F.lit(0)))
            .drop("_new"))


def tag_sessions(events: DataFrame, keys: list[str], ts: str, gap_seconds: float,
                 name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the start time of the session each event belongs to."""
    slotted = events.withColumn("_slot", slot_of(col(ts), gap_seconds))
    slots = slotted.groupBy(*[col(k) for k in keys], "_slot").agg(
        F.count(F.lit(1)).alias("_n"), F.min(col(ts)).alias("_first"), F.max(col(ts)).alias("_last"))
    sessions = with_sessions(slots, keys, gap_seconds, "_n", "_first", "_last", "_slot")
    starts = sessions.withColumn(name, F.min("_first").over(
        Window.partitionBy(*[col(k) for k in keys], "session")))
    tagged = attach(slotted, starts.select(*[col(k) for k in keys], "_slot", "_n", name),
                    [*keys, "_slot"], "_n", hot_rows)
    return tagged.drop("_n", "_slot")
