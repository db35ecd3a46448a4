"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only, no sort over rows.

* **Targets.** A source's target is its weight's share of all words, at most ``MOST`` times the source; what is cut off
  is shared again by weight until no target is above that. Both are one number: targets are min(MOST * size, rate *
  weight) for the rate at which they add up to all words. The rate is found by sums over the sources alone.
* **Copies.** floor(target / size) whole copies of every document, and a subset for the budget that remains.
* **Subset.** Each row has a fixed random place (60 bits of a hash of its id and text, then 60 bits of its row number
  for rows that agree in both). Words are summed by source and the first 12 bits of the place; a running total over
  these 4 096 sums finds the bucket in which the budget ends. Only this bucket's rows are kept, summed by the next 12
  bits, and so on until it holds one row. The place found is the source's threshold: rows before it are in.
* **Nested budgets.** What the budget lacks then is smaller than the row at the threshold. A further threshold over
  the rows that are not in and fit that gap fills it, ``FILLS`` times in all. The last gap is closed by the row at the
  threshold where that comes nearer to the target.

Thresholds stay a table with one row per source. Rows meet them by a broadcast whose size is checked, or by a join
that splits hot sources (``skew.lookup``). Row data never moves: the final choice is a filter.

Defined results: null text has size 0; rows of size 0 are taken 0 times. A null source is a source of its own, last in
order. Repeated rows are taken each on its own; which of several rows with equal id and text is in doesn't change the
result. An empty table gives no rows. Columns other than doc_id, text and source pass through untouched.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.common import stored
from flowtide.operators.skew import Slices, lookup

WEIGHTS = (1, 2, 3)
MOST, FILLS = 3, 3
DIGIT, DIGITS = 12, 5
BITS = DIGIT * DIGITS
#: Words: maximal runs of anything but blanks and the control characters U+0009 to U+000D.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def _place(*parts: Column) -> Column:
    """60 bits of a strong hash, as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, BITS // 4), 16, 10).cast("long")


def described(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(rid, key, size, place, tie, row) of every row, stored: all that later passes read. ``key`` is the source, never
    null; ``row`` holds the columns of ``carry``."""
    carried = F.struct(*[docs[c] for c in carry]) if carry else F.lit(None).cast("string")
    slim = docs.select(carried.alias("row"), F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"),
                       F.col("source").cast("string").alias("source"))
    return stored(slim.select(
        "rid", F.coalesce(F.concat(F.lit("="), "source"), F.lit("~")).alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(SPACED_WORD)), F.lit(0)).cast("long").alias("size"),
        _place(F.coalesce("id", F.lit("")), F.coalesce("text", F.lit(""))).alias("place"),
        _place(F.col("rid").cast("string")).alias("tie"), "row"), "mix-rows")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, source_size, weight, target) from (key, source_size): '=' before a source and '~' for null keep their order."""
    # Positions over all sources without one task that holds them all.
    place = Slices(sizes, [], ["key"], "mix-sources").numbered("at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("at") - 1) % len(weights) + 1).cast("int"))
    rows = stored(place.select("key", "source_size", weight.alias("weight")), "mix-weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    rate, seen = 0.0, None
    while True:
        full = F.col("source_size") * most <= F.lit(rate) * F.col("weight")
        n, cut, free = rows.agg(F.count_if(full), F.sum(F.when(full, F.col("source_size") * most)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == seen or not free:
            return rows.withColumn("target", F.least((F.col("source_size") * most).cast("double"), F.lit(rate) * F.col("weight")) if free
                                   else (F.col("source_size") * most).cast("double"))
        seen, rate = n, (total - (cut or 0)) / free


def _digit(level: int) -> Column:
    """12 bits of the place, then of the tie, from the highest on."""
    column, at = ("place", level) if level < DIGITS else ("tie", level - DIGITS)
    return F.shiftright(F.col(column), BITS - DIGIT * (at + 1)).bitwiseAND((1 << DIGIT) - 1)


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, before, at_place, at_tie, at_size) of the first row of each source, by (place, tie), at which the sum of
    ``size`` exceeds ``budget``; ``before`` is the sum of all earlier rows. Sources that never exceed it are left out.

    ``rows`` has (key, size, place, tie), ``budgets`` (key, budget)."""
    before = budgets.select("key", "budget", F.lit(0).cast("long").alias("before"))
    for level in range(2 * DIGITS):
        sums = rows.groupBy("key", _digit(level).alias("digit")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        upto = Window.partitionBy("key").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # At most 4 096 sums a source.
        running = (sums.withColumn("upto", F.sum("words").over(upto)).join(before, "key")
                   .filter((F.col("before") + F.col("upto") > F.col("budget")) & (F.col("before") + F.col("upto") - F.col("words") <= F.col("budget"))))
        found = stored(running.select("key", "digit", "budget", (F.col("before") + F.col("upto") - F.col("words")).alias("before"), "rows"), "mix-buckets")
        before = found.select("key", "budget", "before")
        rows = stored(lookup(rows, found.select("key", F.col("digit").alias("boundary")), "key")
                      .filter(F.col("boundary") == _digit(level)).select("key", "size", "place", "tie"), "mix-boundary")
        if not found.filter("rows > 1").limit(1).count():
            break
    # Two rows share a place and a tie only if two row numbers share 60 bits of their hash; then the first stands for both.
    last = rows.groupBy("key").agg(F.min(F.struct("place", "tie", "size")).alias("r"))
    return before.join(last, "key").select("key", "before", F.col("r.place").alias("at_place"), F.col("r.tie").alias("at_tie"), F.col("r.size").alias("at_size"))


def _ahead(k: int) -> Column:
    """The row comes before the threshold of fill ``k``; sources without one are in whole."""
    place, tie = F.col(f"place_{k}"), F.col(f"tie_{k}")
    return place.isNull() | (F.col("place") < place) | ((F.col("place") == place) & (F.col("tie") < tie))


def _chosen(k: int) -> Column:
    """In by one of the first ``k`` fills: fits the gap of that fill and comes before its threshold."""
    return reduce(lambda a, b: a | b, [(F.col("size") <= F.col(f"gap_{i}")) & _ahead(i) for i in range(k)], F.lit(False))


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: key, source_size, target, copies, and per fill gap_k, place_k, tie_k; ``closing`` is the last
    fill whose threshold row is taken too, where that comes nearer."""
    sizes = stored(rows.groupBy("key").agg(F.sum("size").alias("source_size")), "mix-sizes")
    size = F.col("source_size")
    copies = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    known = targets(sizes, weights, most).withColumn("copies", copies).withColumn("gap_0", F.col("target") - F.col("copies") * size)
    known = stored(known, "mix-targets")
    for k in range(FILLS):
        free = lookup(rows.filter("size > 0"), known, "key").filter((F.col("size") <= F.col(f"gap_{k}")) & ~_chosen(k)) if k else rows.filter("size > 0")
        found = thresholds(free.select("key", "size", "place", "tie"), known.select("key", F.col(f"gap_{k}").alias("budget")))
        in_all = free.groupBy("key").agg(F.sum("size").alias("all_free")) if k else sizes.select("key", F.col("source_size").alias("all_free"))
        filled = F.when(F.col("at_place").isNotNull(), F.col("before")).otherwise(F.coalesce("all_free", F.lit(0)))
        known = stored(known.join(found, "key", "left").join(in_all, "key", "left").select(
            *known.columns, F.col("at_place").alias(f"place_{k}"), F.col("at_tie").alias(f"tie_{k}"), F.col("at_size").alias(f"size_{k}"),
            (F.col(f"gap_{k}") - filled).alias(f"gap_{k + 1}")), "mix-fill")
    # A threshold row as the closing one: the last gap shrinks to its distance from the row's size, for the best of the fills.
    over = [F.when(F.col(f"place_{k}").isNotNull(), F.abs(F.col(f"gap_{FILLS}") - F.col(f"size_{k}"))) for k in range(FILLS)]
    best = F.least(*over) if FILLS > 1 else over[0]
    closing = F.when(best < F.col(f"gap_{FILLS}"), reduce(lambda rest, k: F.when(over[k] == best, F.lit(k)).otherwise(rest), reversed(range(FILLS)), F.lit(None).cast("int")))
    return stored(known.withColumn("closing", closing), "mix-plan")


def _at(k: int) -> Column:
    return (F.col("closing") == k) & (F.col("place") == F.col(f"place_{k}")) & (F.col("tie") == F.col(f"tie_{k}"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, carry: Sequence[str] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): the columns of ``carry``, then rid, key, size, source_size, target and
    copies, how often the mix takes the row. ``rid`` is the row's ``monotonically_increasing_id``."""
    rows = described(docs, carry)
    known = plan(rows, weights, most)
    taken = _chosen(FILLS) | reduce(lambda a, b: a | b, [F.coalesce(_at(k), F.lit(False)) for k in range(FILLS)])
    own = [F.col(f"row.`{c}`").alias(c) for c in carry]
    return lookup(rows, known, "key").select(
        *own, "rid", "key", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.col("copies") + taken.cast("long")).otherwise(0).alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: every column of ``docs``, a row taken n times standing n times. ``docs`` must read alike twice
    (stored tables do)."""
    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    often = mix(docs, weights, most).filter("copies > 0").select("rid", "copies")
    return own.join(often, "rid").select("row", F.explode(F.expr("sequence(1, copies)")).alias("copy")).select("row.*")
