"""Joins and orderings that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide.schemas import col
from flowtide.session import durable

# A key with more rows than this is "hot". N rows hold at most N / HOT_ROWS hot keys, which
# bounds every broadcast of hot keys (1e12 rows: 200 000 keys).
HOT_ROWS = 5_000_000
# Dimensions up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join in which a null key member equals a null key member, as it does in a grouping."""
    renamed = right.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                           *[col(c) for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= col(k).eqNullSafe(F.col(f"__k{i}"))
    return left.join(renamed, same, how).drop(*[f"__k{i}" for i in range(len(keys))])


def attach(big: DataFrame, per_key: DataFrame, keys: Sequence[str], count_col: str,
           hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left-join one row per key onto ``big`` without sending a hot key to one task.

    ``count_col`` of ``per_key`` is the number of rows of ``big`` under the key. A hot key is split: its entry is
    repeated once per ``hot_rows`` rows, and its rows are dealt over these copies by a broadcast of the few hot keys.
    ``big`` is read and shuffled once. Null key members match like values, as in the grouping that made ``per_key``.
    Columns of ``per_key`` other than the keys are added.
    """
    keys = list(keys)
    values = [c for c in per_key.columns if c not in keys]
    # One struct keeps both uses on the same aggregate, so its shuffle is reused.
    packed = per_key.select(*[col(k) for k in keys], F.struct(*[col(v) for v in values]).alias("__v"))
    count = F.coalesce(F.col(f"__v.`{count_col}`"), F.lit(0))
    parts = F.greatest(F.ceil(count / F.lit(hot_rows)), F.lit(1))
    hot = F.broadcast(packed.filter(count > hot_rows).select(*[col(k) for k in keys], parts.alias("__parts")))
    # Rows are dealt by their number in the task, so that copies of one row spread as well.
    dealt = F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(F.col("__row")), F.col("__parts"))).otherwise(F.lit(0))
    numbered = big.withColumn("__row", F.monotonically_increasing_id())
    salted = null_safe_join(numbered, hot, keys).withColumn("__salt", dealt.cast("long"))
    copies = packed.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
    return null_safe_join(salted, copies, [*keys, "__salt"]).select(
        *[col(c) for c in big.columns], *[F.col(f"__v.`{v}`").alias(v) for v in values])


def is_bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Size check in front of a broadcast: reads at most ``max_rows + 1`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup(big: DataFrame, dimension: DataFrame, key: str, max_rows: int = BROADCAST_ROWS,
           hot_rows: int = HOT_ROWS, bound_on: DataFrame | None = None) -> DataFrame:
    """Left-join a dimension that is unique on ``key``: broadcast when its size was checked,
    otherwise shuffled with hot keys split off. ``bound_on`` names a cheaper frame with at least
    as many rows to check instead."""
    if is_bounded(dimension if bound_on is None else bound_on, max_rows):
        return big.join(F.broadcast(dimension), key, "left")
    if big.isStreaming:
        return big.join(dimension, key, "left")
    counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    per_key = counts.join(dimension, key, "left")
    null_key = big.filter(col(key).isNull())
    extra = [c for c in dimension.columns if c != key]
    for name in extra:
        null_key = null_key.withColumn(name, F.lit(None).cast(dimension.schema[name].dataType))
    known = attach(big.filter(col(key).isNotNull()), per_key, [key], "_n", hot_rows).drop("_n")
    return known.unionByName(null_key)


class Slices:
    """Rows cut into ordered, evenly sized slices, stored durably.

    Range partitioning over the full order splits even a single huge group, because the order
    ends in a unique column. The slice number is written with the rows, so later steps may be
    recomputed after an executor loss without moving rows between slices.
    """

    def __init__(self, df: DataFrame, group: Sequence[str], order: Sequence[str], label: str,
                 slices: int | None = None):
        self.group, self.order = list(group), list(order)
        by = [col(c) for c in (*self.group, *self.order)]
        ranged = df.repartitionByRange(slices, *by) if slices else df.repartitionByRange(*by)
        self.df = durable(ranged.withColumn("_slice", F.spark_partition_id()), label)

    def _within(self, keys: Sequence[str]):
        return Window.partitionBy("_slice", *keys).orderBy(*[col(c) for c in self.order])

    def _carried(self, keys: Sequence[str], summary: Column, fold) -> DataFrame:
        """Per slice and group, ``fold`` over the summaries of all earlier slices as ``_before``.
        The window sees one row per slice, so it is bounded by the number of slices."""
        earlier = (Window.partitionBy(*[col(g) for g in keys]).orderBy("_slice")
                   .rowsBetween(Window.unboundedPreceding, -1))
        per_slice = self.df.groupBy("_slice", *keys).agg(summary.alias("_s"))
        return per_slice.withColumn("_before", fold("_s").over(earlier)).drop("_s")

    def numbered(self, name: str) -> DataFrame:
        """1-based position inside the group."""
        carry = self._carried(self.group, F.count(F.lit(1)), F.sum)
        rows = self.df.withColumn("_rn", F.row_number().over(self._within(self.group)))
        position = F.coalesce("_before", F.lit(0)) + F.col("_rn")
        return (rows.join(carry, ["_slice", *self.group], "left")
                .withColumn(name, position.cast("long")).drop("_rn", "_before", "_slice"))

    def previous(self, columns: Sequence[str], prefix: str = "prev_", within: Sequence[str] = (),
                 rows: DataFrame | None = None) -> DataFrame:
        """Add the values of the preceding row of the group (null for the first). ``within``
        narrows the group further without slicing again. ``rows`` may be an earlier result of
        this method; the slice number stays until ``done``."""
        keys = [*self.group, *within]
        packed = F.struct(*[col(c) for c in columns])
        last = F.max_by(packed, F.struct(*[col(c) for c in self.order]))
        carry = self._carried(keys, last, lambda c: F.last(c, ignorenulls=True))
        base = self.df if rows is None else rows
        lagged = base.withColumn("_lag", F.lag(packed).over(self._within(keys)))
        joined = (lagged.join(carry, ["_slice", *keys], "left")
                  .withColumn("_p", F.coalesce("_lag", "_before")))
        return joined.select(*[col(c) for c in base.columns],
                             *[F.col(f"_p.`{c}`").alias(prefix + c) for c in columns])

    def running_sum(self, column: str, name: str) -> DataFrame:
        """Inclusive running total inside the group."""
        carry = self._carried(self.group, F.sum(col(column)), F.sum)
        upto = self._within(self.group).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = self.df.withColumn("_run", F.sum(col(column)).over(upto))
        return (rows.join(carry, ["_slice", *self.group], "left")
                .withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_run"))
                .drop("_run", "_before", "_slice"))

    @staticmethod
    def done(rows: DataFrame) -> DataFrame:
        return rows.drop("_slice")
