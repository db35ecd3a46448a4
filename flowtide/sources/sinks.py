"""Append-only sinks, exports and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowtide.functions.scalars import utc_text
from flowtide.operators.reports import filter_logs


def append_by_day(df: DataFrame, path: str, time: str = "created_at") -> None:
    """Append rows partitioned by event day. Rebalancing merges small days into few files and splits
    a day that holds most of the rows over several writers."""
    df.withColumn("day", F.to_date(time)).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int, fmt: str = "parquet") -> None:
    """One micro-batch in its own folder, so a replayed batch replaces itself."""
    df.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch_id}")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def ip_list_export(entries: DataFrame) -> DataFrame:
    """address, reason (empty for none) and the time it was added."""
    return entries.select("ip_address", F.coalesce("reason", F.lit("")).alias("reason"),
                          F.col("created_at").alias("added_at"))


def log_export(logs: DataFrame, source: str | None = None, level: str | None = None,
               text: str | None = None) -> DataFrame:
    return filter_logs(logs, source, level, text).select(
        utc_text(F.col("created_at")).alias("timestamp"), "source", "level", "message")


def purge(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Leave an empty table of the given schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file or of the files of a folder, without hidden ones."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    entries = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return [(e.getPath().toString(), e.getLen()) for e in entries if e.isFile() and not e.getPath().getName().startswith(("_", "."))]


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a folder; 0 where it is missing."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(folder).getLength() if files.exists(folder) else 0
