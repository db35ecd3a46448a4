"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

The index holds a posting (row, position) for every occurrence of a word that the test set uses (no other word is
ever looked up), and one end posting per document, whose position is its length. A test window (ten consecutive words,
or a shorter item) occurs at ``start`` in a row exactly if, for each of its offsets o, the list of its o-th word,
shifted by o, holds (row, start). Windows with a word the corpus lacks are dropped at once; the others intersect the
list of their rarest word with that of the second rarest, and only what survives meets the lists of the other words.
``slop`` lets every word but the rarest stand that many places away (proximity matches).

Defined results: null texts have no words; items without words take no part; items without an id hit like others and
count together as one item, which the list of ids leaves out; equal items and repeated rows count each on its own. Empty tables give empty or clean results. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.common import lower_words, stored

SPAN = 10
#: A test vocabulary of at most so many words is broadcast; a larger one is joined by shuffling the words.
BROADCAST_TERMS = 500_000
_END = -1


def test_windows(items: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """(wid, words) of the distinct windows, and (wid, item_id) of the items that hold them."""
    split = items.select(F.col("item_id").cast("string").alias("item_id"), lower_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - span + 1, F.lit(1)))
    held = split.select("item_id", F.explode(starts).alias("s"), "w").select("item_id", F.slice("w", F.col("s"), span).alias("words")).distinct()
    windows = stored(held.select("words").distinct().select(F.monotonically_increasing_id().alias("wid"), "words"), "test-windows")
    return windows, held.join(windows, "words").select("wid", "item_id")


def build_index(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, rid, pos, doc_id) postings of ``docs`` (rid, doc_id, text), and (term, word) of the test vocabulary.

    ``doc_id`` is only set in end postings (term -1)."""
    terms = windows.select(F.explode("words").alias("word")).distinct().select(F.monotonically_increasing_id().alias("term"), "word")
    terms = stored(terms.union(docs.sparkSession.createDataFrame([(_END, "")], "term long, word string")), "test-terms")
    known = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
    split = docs.select("rid", "doc_id", F.concat(lower_words(F.col("text")), F.array(F.lit(""))).alias("w"))
    each = split.select("rid", "doc_id", F.posexplode("w").alias("pos", "word"))
    postings = each.join(known, "word").select("term", "rid", "pos", F.when(F.col("term") == _END, F.col("doc_id")).alias("doc_id"))
    return stored(postings, "postings"), terms


def occurrences(postings: DataFrame, terms: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """(rid, wid, start, length) of every occurrence of a window."""
    lists = postings.filter(F.col("term") != _END).select("term", "rid", "pos")
    counts = stored(lists.groupBy("term").count(), "term-counts")
    placed = windows.select("wid", F.size("words").alias("length"), F.posexplode("words").alias("off", "word")).join(terms, "word").join(counts, "term", "left")
    placed = placed.select("wid", "length", "off", "term", "count", F.min(F.coalesce("count", F.lit(0))).over(Window.partitionBy("wid")).alias("rarest"),
                           F.row_number().over(Window.partitionBy("wid").orderBy("count", "off")).alias("rank")).filter("rarest > 0")
    placed = stored(placed.drop("rarest", "count"), "placed-terms")
    near = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))

    def meet(found: DataFrame, ranks: str) -> DataFrame:
        """Keep what the lists of these ranks hold too."""
        more = placed.filter(ranks).select("wid", "off", "term")
        asked = found.join(more, "wid").select("rid", "wid", "start", "length", "off", "term", (F.col("start") + F.col("off")).alias("pos"))
        if slop:
            asked = asked.withColumn("d", near).withColumn("pos", F.col("pos") + F.col("d"))
        some = lists.join(more.select("term").distinct(), "term", "left_semi")
        met = asked.join(some, ["term", "rid", "pos"])
        wanted = more.groupBy("wid").agg(F.count("*").alias("wanted"))
        full = met.groupBy("rid", "wid", "start", "length").agg(F.count_distinct("off").alias("n") if slop else F.count("*").alias("n")).join(wanted, "wid").filter("n = wanted")
        # A window without such ranks has met all it had.
        return full.select("rid", "wid", "start", "length").union(found.join(wanted, "wid", "left_anti").select("rid", "wid", "start", "length"))

    first = placed.filter("rank = 1").join(lists, "term").select("rid", "wid", (F.col("pos") - F.col("off")).alias("start"), "length").filter(F.col("start") >= -slop)
    return meet(stored(meet(first, "rank = 2"), "candidates"), "rank > 2")


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """rid, doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs`` (rid, doc_id, text).

    ``rid`` must be unique; ``docs`` is read once.
    """
    windows, held = test_windows(items, span)
    postings, terms = build_index(docs, windows)
    found = stored(occurrences(postings, terms, windows), "occurrences")
    # Words under any occurrence: by start, each adds what lies beyond the furthest end so far.
    ends = F.col("start") + F.col("length")
    before = F.coalesce(F.max(ends).over(Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = found.groupBy("rid", "start").agg(F.max("length").alias("length"))
    hits = spans.select("rid", F.greatest(ends - F.greatest(before, F.col("start")), F.lit(0)).alias("new")).groupBy("rid").agg(F.sum("new").alias("n_hit"))
    named = found.select("rid", "wid").distinct().join(held, "wid").select("rid", "item_id").distinct().groupBy("rid").agg(
        F.sort_array(F.collect_list("item_id")).alias("ids"), F.count(F.lit(1)).alias("n_items"))
    ends_only = postings.filter(F.col("term") == _END).select("rid", "doc_id", F.col("pos").cast("long").alias("n_words"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return ends_only.join(hits, "rid", "left").join(named, "rid", "left").select(
        "rid", "doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))
