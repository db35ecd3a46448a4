"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.session import scratch_path  # noqa: F401

#: Words as the exact operators see them: ASCII letters and digits, and everything beyond ASCII.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of a few numbers each; some 100 MB as a broadcast table.
BROADCAST_ROWS = 2_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The ASCII characters that are neither letters nor digits.
_SIGNS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and read it back.

    Cuts lineage, survives lost executors and freezes row numbers. Columns stay prunable.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, label: str) -> DataFrame:
    """``df`` (numbers only, so of a known width), stored, and broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    df = stored(df, label)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def numbered(df: DataFrame, label: str) -> DataFrame:
    """(rid, row): every row once, under a unique number. ``row`` keeps all columns, whatever their names."""
    return stored(df.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[df[c] for c in df.columns]).alias("row")), label)


def unpacked(df: DataFrame) -> DataFrame:
    """The user's columns back from ``row``."""
    return df.select("row.*")


def lower_words(text: Column) -> Column:
    """The words of ``text``, A-Z lower-cased; null has none. Signs become spaces and capitals small letters in one pass,
    and one cut at the spaces follows: much cheaper than a regular expression and a lambda for every word."""
    plain = F.translate(text, _SIGNS + _UPPER, " " * len(_SIGNS) + _UPPER.lower())
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
