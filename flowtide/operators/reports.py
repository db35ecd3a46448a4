"""Reports over detections, alerts and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.operators.decide import attack_label, dashboard_state
from flowtide.operators.reputation import contains_text

ATTACK = "prediction <> 0"


def recent(df: DataFrame, limit: int | None, only_attacks: bool = False, time: str = "created_at",
           tie: str = "id") -> DataFrame:
    """Newest rows first; equal times by descending id. Without a limit all rows, in no order."""
    if only_attacks:
        df = df.filter(ATTACK)
    if limit is None:
        return df
    return df.orderBy(F.desc(time), F.desc(tie)).limit(limit)


def since(df: DataFrame, start: Column, time: str = "created_at") -> DataFrame:
    return df.filter(F.col(time) >= start)


def activity(detections: DataFrame, as_of: Column) -> DataFrame:
    """Flows and attacks of the last 24 hours and the last minute, in one scan."""
    day = F.col("created_at") >= as_of - F.expr("INTERVAL 24 HOURS")
    minute = F.col("created_at") >= as_of - F.expr("INTERVAL 1 MINUTE")
    attack = F.col("prediction") != 0
    return detections.filter(day | minute).agg(
        F.count_if(day).alias("flows_24h"), F.count_if(day & attack).alias("attacks_24h"),
        F.count_if(minute).alias("per_minute"))


def rolling_rate(detections: DataFrame, seconds: int = 60, step: int = 10) -> DataFrame:
    """Detections per sliding window. Events are first counted per step, so each event is not
    copied into every window it falls in; only the step counts are."""
    steps = detections.groupBy(F.window(F.col("created_at").cast("timestamp"), f"{step} seconds")
                               .getField("start").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    back = F.explode(F.sequence(F.lit(0), F.lit(seconds // step - 1))).alias("_b")
    spread = steps.select("n", "at", back)
    start = (F.unix_micros("at") - F.col("_b") * step * 1_000_000)
    return (spread.groupBy(F.timestamp_micros(start).alias("window_start"))
            .agg(F.sum("n").alias("n")))


def traffic_timeline(detections: DataFrame, limit: int | None = None) -> DataFrame:
    """Volume per minute and state, over all detections or the newest ``limit``."""
    state = dashboard_state(F.col("prediction"), F.col("attack_type"))
    return (recent(detections, limit)
            .groupBy(F.date_trunc("minute", "created_at").alias("bucket"), state.alias("state"))
            .agg(F.count(F.lit(1)).alias("volume")))


def newest_attacks(detections: DataFrame, limit: int | None = None) -> DataFrame:
    label = attack_label(F.col("prediction"), F.col("attack_type"))
    return recent(detections, limit, only_attacks=True).withColumn("attack", label)


def attack_timeline(detections: DataFrame, limit: int | None = None) -> DataFrame:
    """Attacks per five minutes and type, over all or the newest ``limit``."""
    bucket = F.window(F.col("created_at").cast("timestamp"), "5 minutes").getField("start")
    return (newest_attacks(detections, limit).groupBy(bucket.alias("bucket"), "attack")
            .agg(F.count(F.lit(1)).alias("n")))


def confidence_histogram(attacks: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width bins between the smallest and largest confidence; the top edge is inclusive."""
    edges = attacks.agg(F.struct(F.min("confidence").alias("lo"), F.max("confidence").alias("hi")))
    edge = edges.scalar()
    width = edge["hi"] - edge["lo"]
    position = F.floor((F.col("confidence") - edge["lo"]) / width * bins)
    bin_no = F.when(width > 0, F.least(position, F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return attacks.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def attack_distribution(attacks: DataFrame, column: str = "attack") -> DataFrame:
    """Count and share per type, most frequent first."""
    counts = attacks.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = attacks.agg(F.count(F.lit(1))).scalar()
    return (counts.withColumn("share", F.col("n") * 100.0 / total)
            .orderBy(F.desc("n"), column))


def live_ratio(flows: DataFrame, limit: int | None = None) -> DataFrame:
    """Flows, threats and threat ratio, over all results or the newest ``limit``."""
    return (recent(flows, limit).agg(F.count(F.lit(1)).alias("flows"),
                                     F.count_if(F.col("prediction") != 0).alias("threats"))
            .withColumn("ratio", F.coalesce(F.try_divide(F.col("threats") * 100.0, F.col("flows")),
                                            F.lit(0.0))))


def search_logs(logs: DataFrame, source: str | None = None, level: str | None = None,
                text: str | None = None, limit: int = 200) -> DataFrame:
    """Newest log rows matching every given condition."""
    return recent(filter_logs(logs, source, level, text), limit)


def filter_logs(logs: DataFrame, source: str | None = None, level: str | None = None,
                text: str | None = None) -> DataFrame:
    if source:
        logs = logs.filter(F.col("source") == source)
    if level:
        logs = logs.filter(F.col("level") == level)
    if text:
        logs = logs.filter(contains_text("message", text))
    return logs


def log_counts(logs: DataFrame) -> DataFrame:
    """Totals by level, by source and overall, from one scan."""
    return logs.groupingSets([["level"], ["source"], []], "level", "source").agg(
        F.count(F.lit(1)).alias("n"))


def error_count(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count_if(F.col("level").isin("ERROR", "CRITICAL")).alias("errors"))


def sources_by_count(logs: DataFrame) -> DataFrame:
    return logs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


def table_count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")


def marker_counts(lines: DataFrame, text: str = "value") -> DataFrame:
    """Error, critical and traceback markers in application log text. The two spellings of a
    level are added, as a line may carry both."""
    def hits(literal: str) -> Column:
        removed = F.length(F.replace(F.col(text), F.lit(literal), F.lit("")))
        return ((F.length(F.col(text)) - removed) / len(literal)).cast("long")

    return lines.agg(
        F.coalesce(F.sum(hits("| ERROR") + hits(" ERROR ")), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(hits("| CRITICAL") + hits(" CRITICAL ")), F.lit(0)).alias("criticals"),
        F.coalesce(F.sum(hits("Traceback (most recent call last)")), F.lit(0)).alias("tracebacks"))
