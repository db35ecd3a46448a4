"""System metric series: counter deltas, gauges, retention, stability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.operators.skew import Slices

COUNTERS = ("network_sent_bytes", "network_recv_bytes")


def throughput(metrics: DataFrame, counters: Sequence[str] = COUNTERS,
               group: Sequence[str] = (), slices: int | None = None) -> DataFrame:
    """Counter increase since the previous sample, never negative (a restart counts as 0).

    One host's series is a single ordered group, so it is cut into range slices and each slice
    takes its first predecessor from the slice before.
    """
    cut = Slices(metrics, list(group), ["created_at", "id"], "metric-series", slices)
    paired = cut.done(cut.previous(list(counters)))
    return paired.withColumns({
        c + "_delta": F.coalesce(F.greatest(F.lit(0), F.col(c) - F.col("prev_" + c)), F.lit(0))
        for c in counters}).drop(*["prev_" + c for c in counters])


def newest_ascending(metrics: DataFrame, limit: int = 60) -> DataFrame:
    """The newest samples, oldest of them first."""
    return (metrics.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
            .orderBy("created_at", "id"))


def band(gauge: Column) -> Column:
    """Utilization band of a percentage."""
    return F.when(gauge < 80, "normal").when(gauge < 95, "inverse").otherwise("off")


def retain(metrics: DataFrame, as_of: Column, hours: int) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row with the number pruned)."""
    fresh = F.col("created_at") >= as_of - F.make_dt_interval(hours=F.lit(hours))
    return metrics.filter(fresh), metrics.agg(F.count_if(~fresh).alias("pruned"))


def stability(cycles: DataFrame, value: str = "memory_mb", duration: str = "total_ms",
              time: str = "created_at", tie: str = "id", leak_over: float = 50.0) -> DataFrame:
    """Cycles, first and last value, growth, growth per hour, mean duration and a leak flag."""
    order = F.struct(time, tie)
    ends = cycles.agg(
        F.count(F.lit(1)).alias("cycles"), F.min_by(value, order).alias("start_value"),
        F.max_by(value, order).alias("end_value"), F.avg(duration).alias("mean_duration"),
        (F.unix_micros(F.max(time).cast("timestamp")) - F.unix_micros(F.min(time).cast("timestamp")))
        .alias("_span"))
    growth = F.when(F.col("cycles") >= 2, F.col("end_value") - F.col("start_value")).otherwise(F.lit(0.0))
    hours = F.col("_span") / 3.6e9
    return (ends.withColumn("growth", growth)
            .withColumn("growth_per_hour", F.coalesce(F.try_divide(F.col("growth"), hours), F.lit(0.0)))
            .withColumn("leak_suspected", F.col("growth") > leak_over).drop("_span"))
