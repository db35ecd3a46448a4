"""Packets to bidirectional flows with idle expiry, in batch and as a stream.

The feature formulas follow the published definitions of bidirectional flow meters: the sender of
a flow's first packet defines the forward direction, times are microseconds, standard deviations
are sample deviations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.operators.gaps import micros, tag_sessions
from flowtide.operators.skew import Slices, attach

# --- Fixed values: seconds of silence ending a flow, and ending an active period. ---
IDLE_SECONDS = 10
ACTIVITY_SECONDS = 5
# --- Fixed values: TCP flag bits. ---
FLAGS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32, "ECE": 64, "CWE": 128}

CONNECTION = ["a_ip", "a_port", "b_ip", "b_port", "protocol"]
FLOW = [*CONNECTION, "flow_start"]


def with_connection(packets: DataFrame) -> DataFrame:
    """Direction-free connection key: the smaller endpoint first."""
    here = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    there = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    low, high = F.least(here, there), F.greatest(here, there)
    return packets.withColumns({
        "a_ip": low["ip"], "a_port": low["port"], "b_ip": high["ip"], "b_port": high["port"],
        "from_a": here == low})


def _stats(value: Column, when: Column | None, prefix: str, mean: str, std: str, high: str, low: str):
    v = value if when is None else F.when(when, value)
    zero = F.lit(0.0)
    return [F.coalesce(F.avg(v), zero).alias(prefix + mean), F.coalesce(F.stddev_samp(v), zero).alias(prefix + std),
            F.coalesce(F.max(v).cast("double"), zero).alias(prefix + high),
            F.coalesce(F.min(v).cast("double"), zero).alias(prefix + low)]


def flows(packets: DataFrame, ts: str = "ts", order: Sequence[str] = ("packet_no",), idle: float = IDLE_SECONDS,
          activity: float = ACTIVITY_SECONDS, slices: int | None = None) -> DataFrame:
    """Bidirectional flows with the flow-meter features that packets can give.

    ``order`` breaks ties between packets of one instant and must make packets unique together
    with the time. Flow boundaries come from slot aggregates; inter-arrival times from range
    slices over (flow, time); so an elephant flow is spread over many tasks.
    """
    keyed = with_connection(packets)
    tagged = tag_sessions(keyed, CONNECTION, ts, idle, "flow_start")
    sequence = [ts, *order]
    cut = Slices(tagged, FLOW, sequence, "packets", slices)
    endpoints = F.struct("src_ip", "src_port", "dst_ip", "dst_port")
    heads = cut.df.groupBy(*FLOW).agg(
        F.min_by(endpoints, F.struct(*sequence)).alias("first"), F.count(F.lit(1)).alias("packets"))
    paced = cut.previous([ts], "prev_")
    paced = cut.done(cut.previous([ts], "same_", ["from_a"], paced))
    # Forward is the direction of the flow's first packet.
    directed = attach(paced, heads, FLOW, "packets").withColumn(
        "fwd", (F.col("src_ip") == F.col("first.src_ip")) & (F.col("src_port") == F.col("first.src_port")))
    gap = micros(F.col(ts)) - micros(F.col("prev_" + ts))
    same = micros(F.col(ts)) - micros(F.col("same_" + ts))
    ready = directed.withColumns({"_gap": gap, "_same": same})
    fwd, bwd, every = F.col("fwd"), ~F.col("fwd"), F.lit(True)
    size, header = F.col("payload_len"), F.col("header_len")

    def total(value: Column, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("double")

    aggs = [
        F.first("first").alias("first"), F.count(F.lit(1)).alias("n"),
        (micros(F.max(ts)) - micros(F.min(ts))).cast("double").alias("Flow Duration"),
        F.count_if(fwd).cast("double").alias("Total Fwd Packets"),
        F.count_if(bwd).cast("double").alias("Total Backward Packets"),
        total(size, fwd).alias("Total Length of Fwd Packets"), total(size, bwd).alias("Total Length of Bwd Packets"),
        *_stats(size, fwd, "Fwd Packet Length ", "Mean", "Std", "Max", "Min"),
        *_stats(size, bwd, "Bwd Packet Length ", "Mean", "Std", "Max", "Min"),
        F.coalesce(F.max(size).cast("double"), F.lit(0.0)).alias("Max Packet Length"),
        F.coalesce(F.min(size).cast("double"), F.lit(0.0)).alias("Min Packet Length"),
        F.avg(size).alias("Packet Length Mean"), F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("Packet Length Std"),
        F.coalesce(F.var_samp(size), F.lit(0.0)).alias("Packet Length Variance"),
        *_stats(F.col("_gap"), None, "Flow IAT ", "Mean", "Std", "Max", "Min"),
        *_stats(F.col("_same"), fwd, "Fwd IAT ", "Mean", "Std", "Max", "Min"), total(F.col("_same"), fwd).alias("Fwd IAT Total"),
        *_stats(F.col("_same"), bwd, "Bwd IAT ", "Mean", "Std", "Max", "Min"), total(F.col("_same"), bwd).alias("Bwd IAT Total"),
        total(header, fwd).alias("Fwd Header Length"), total(header, bwd).alias("Bwd Header Length"),
        *[F.count_if(F.col("tcp_flags").bitwiseAND(F.lit(bit)) != 0).cast("double").alias(f"{name} Flag Count")
          for name, bit in FLAGS.items()],
        F.count_if(fwd & (F.col("tcp_flags").bitwiseAND(F.lit(8)) != 0)).cast("double").alias("Fwd PSH Flags"),
        F.count_if(fwd & (F.col("tcp_flags").bitwiseAND(F.lit(32)) != 0)).cast("double").alias("Fwd URG Flags"),
        F.coalesce(F.min_by(F.when(fwd, F.col("window")), F.when(fwd, F.struct(*sequence))), F.lit(0))
        .cast("double").alias("Init_Win_bytes_forward"),
        F.coalesce(F.min_by(F.when(bwd, F.col("window")), F.when(bwd, F.struct(*sequence))), F.lit(0))
        .cast("double").alias("Init_Win_bytes_backward"),
        F.count_if(fwd & (size > 0)).cast("double").alias("act_data_pkt_fwd"),
        F.coalesce(F.min(F.when(fwd, header)).cast("double"), F.lit(0.0)).alias("min_seg_size_forward"),
        *_stats(F.when(F.col("_gap") > int(activity * 1e6), F.col("_gap")), every, "Idle ", "Mean", "Std", "Max", "Min"),
    ]
    grouped = ready.groupBy(*FLOW).agg(*aggs)
    active = _active(cut.df.drop("_slice"), ts, activity)
    return derived(grouped.join(active, FLOW, "left"))


def _active(tagged: DataFrame, ts: str, activity: float) -> DataFrame:
    """Durations of the periods of a flow without a pause longer than the activity limit."""
    periods = (tag_sessions(tagged, FLOW, ts, activity, "period").groupBy(*FLOW, "period")
               .agg((micros(F.max(ts)) - micros(F.min(ts))).alias("len")).filter("len > 0"))
    return periods.groupBy(*FLOW).agg(*_stats(F.col("len"), None, "Active ", "Mean", "Std", "Max", "Min"))


def derived(grouped: DataFrame) -> DataFrame:
    """Rates, ratios and repeated measures that follow from a flow's aggregates."""
    c = F.col
    seconds = c("Flow Duration") / 1e6
    payload = c("Total Length of Fwd Packets") + c("Total Length of Bwd Packets")

    def per(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.when(bottom > 0, top / bottom), F.lit(0.0))

    out = grouped.withColumns({
        "Flow Bytes/s": per(payload, seconds), "Flow Packets/s": per(c("n"), seconds),
        "Fwd Packets/s": per(c("Total Fwd Packets"), seconds),
        "Bwd Packets/s": per(c("Total Backward Packets"), seconds),
        "Down/Up Ratio": per(c("Total Backward Packets"), c("Total Fwd Packets")),
        "Average Packet Size": per(payload, c("n")),
        "Avg Fwd Segment Size": c("Fwd Packet Length Mean"), "Avg Bwd Segment Size": c("Bwd Packet Length Mean"),
        "Subflow Fwd Packets": c("Total Fwd Packets"), "Subflow Bwd Packets": c("Total Backward Packets"),
        "Subflow Fwd Bytes": c("Total Length of Fwd Packets"), "Subflow Bwd Bytes": c("Total Length of Bwd Packets"),
        **{f"Active {s}": F.coalesce(f"Active {s}", F.lit(0.0)) for s in ("Mean", "Std", "Max", "Min")},
        "src_ip": c("first.src_ip"), "dst_ip": c("first.dst_ip"), "src_port": c("first.src_port"),
        "dst_port": c("first.dst_port"), "Destination Port": c("first.dst_port").cast("double")})
    return out.drop("a_ip", "a_port", "b_ip", "b_port", "first", "n")
