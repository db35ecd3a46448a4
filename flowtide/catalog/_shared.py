"""Frames reused by several registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowtide import driver_tables as dt
from flowtide.operators import alerts, reputation


def rounded(value: Column, digits: int = 4) -> Column:
    """Rounding that does not flip on exact halves; the SQL side nudges the same way."""
    return F.round(value + F.lit(1e-7), digits)


def protected(spark: SparkSession, sf: str) -> DataFrame:
    return reputation.protected_set(dt.configured_protected(spark, sf), dt.subnets(spark, sf))


def reputed(spark: SparkSession, sf: str) -> DataFrame:
    return reputation.with_reputation(dt.detections(spark, sf), dt.whitelist(spark, sf),
                                      dt.blacklist(spark, sf), protected(spark, sf))


def alertable(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.alertable(reputed(spark, sf))


def stored_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts; those opened by a detection id divisible by 6 count as acknowledged."""
    events = alertable(spark, sf)
    acknowledged = events.filter("id % 6 = 0").select(F.col("id").alias("detection_id"))
    return alerts.alerts(events, dt.ALERT_WINDOW_MINUTES, acknowledged)
