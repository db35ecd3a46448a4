"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of 0.8 or more.

1. One pass over whole texts gives each document the digest of its shingle set and 40 band keys of 6 MinHash values.
   A pair at exactly 0.8 misses all bands with probability 5e-6, at 0.85 with 3e-9.
2. Documents with equal sets form a class; only its representative goes on, so copies are never paired.
3. The representatives' band keys are range-partitioned by (key, row number) and sorted, so a bucket of any size is
   spread like other rows and travels once. Each key of a bucket is linked to the first one in its partition, and the
   ends of partitions to those of others; components of these links are the candidate groups.
4. Each group's texts travel once. Inside a group (large ones in pairs of blocks, several tasks each) pairs compare
   their MinHash values ``STEP`` at a time. With a uniform prior on the similarity, m agreements in n give it the
   posterior Beta(m+1, n-m+1); pairs whose probability of reaching the threshold falls below ``TOLERANCE`` are
   dropped. The rest are verified on the shingle sets themselves.
5. Links are counted per document and joined into classes; pairs are never written out.

Defined results: words are runs of ASCII letters, digits and other characters beyond ASCII, A-Z lower-cased. One to
four words form one shingle. Documents without words (null, empty, only signs) have no links and are a class each.
Repeated rows are documents like any other. A class is named by its least doc_id (null where all are null).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from flowtide.llm.common import WORD_PATTERN, partitions, small, stored
from flowtide.llm.components import components

SHINGLE, THRESHOLD, BANDS, ROWS, STEP, TOLERANCE = 5, 0.8, 40, 6, 24, 1e-6
#: Documents and text bytes per block of a large group.
BLOCK_ROWS, BLOCK_BYTES = 1500, 6_000_000
_WORDS = re.compile(WORD_PATTERN)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)
_KEYED = "rid long, doc_id long, digest string, bytes long, bands array<long>"


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = _WORDS.findall((text or "").translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.array([xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in words], np.uint64)
    width = min(size, len(words))
    value = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + len(value)]
    value ^= value >> np.uint64(32)
    return np.unique(value * np.uint64(0xD6E8FEB86659FD93))


def minhashes(codes: np.ndarray) -> np.ndarray:
    """BANDS x ROWS MinHash values, cut to 32 bits; hashes are taken in slices, so memory stays small for long texts."""
    least = np.full(_SEEDS.shape[1], np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(codes), 2048):
        part = codes[at:at + 2048, None] * _SEEDS[0] + _SEEDS[1]
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


@cache
def least_matches(n: int) -> int:
    """Fewest agreements in n at which P(similarity >= THRESHOLD) is TOLERANCE or more; that probability is
    P(Binomial(n+1, THRESHOLD) <= m)."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * THRESHOLD ** m * (1 - THRESHOLD) ** (n + 1 - m)
        if total >= TOLERANCE:
            return m
    return n + 1


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part, rows = batch.slice(at, 512), []
            for rid, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("rid", "doc_id", "text")), strict=True):
                codes = shingles(text)
                if not len(codes):
                    rows.append((rid, doc_id, None, 0, []))
                    continue
                bands = minhashes(codes).reshape(BANDS, ROWS).astype(np.uint64)
                key = np.arange(1, BANDS + 1, dtype=np.uint64)
                for k in range(ROWS):
                    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + bands[:, k]
                rows.append((rid, doc_id, hashlib.blake2b(codes.tobytes(), digest_size=16).hexdigest(), len(text.encode("utf-8", "replace")), key.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["rid", "doc_id", "digest", "bytes", "bands"])


class _Forest(dict):
    def root(self, a: int) -> int:
        while (b := self.setdefault(a, a)) != a:
            self[a] = self[b]
            a = b
        return a


def join_block(left: list[np.ndarray], right: list[np.ndarray] | None) -> list[tuple[int, np.ndarray]]:
    """Per left set the right sets (from i+1 on, where ``right`` is None) that reach the threshold."""
    other = left if right is None else right
    signs, others = np.array([minhashes(c) for c in left]), None
    others = signs if right is None else np.array([minhashes(c) for c in right])
    sizes = np.array([len(c) for c in other])
    flat = np.concatenate(other)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    found = []
    for i, codes in enumerate(left):
        alive = np.arange(i + 1 if right is None else 0, len(other))
        # Sizes alone bound the similarity.
        alive = alive[np.minimum(sizes[alive], len(codes)) >= THRESHOLD * np.maximum(sizes[alive], len(codes))]
        same = np.zeros(len(alive), np.int64)
        for at in range(0, signs.shape[1], STEP):
            if not len(alive):
                break
            same += (others[alive, at:at + STEP] == signs[i, at:at + STEP]).sum(axis=1)
            keep = same >= least_matches(at + STEP)
            alive, same = alive[keep], same[keep]
        if not len(alive):
            continue
        picked = np.concatenate([flat[ends[j]:ends[j + 1]] for j in alive])
        at = np.minimum(np.searchsorted(codes, picked), len(codes) - 1)
        starts = np.concatenate([[0], np.cumsum(sizes[alive])[:-1]])
        shared = np.add.reduceat((codes[at] == picked).astype(np.int64), starts)
        hit = alive[shared >= THRESHOLD * (len(codes) + sizes[alive] - shared) - 1e-9]
        if len(hit):
            found.append((i, hit))
    return found


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (root, i, j): links per document, and the roots of a spanning forest of the block's links."""
    key, rows = None, []

    def flush():
        sides = [[r for r in rows if r[2] == b] for b in ((key[1], key[2]) if key[1] != key[2] else (key[1],))]
        if not all(sides):
            return
        sets = [[shingles(r[3]) for r in side] for side in sides]
        links: dict[int, int] = {}
        forest = _Forest()
        for i, hit in join_block(sets[0], sets[1] if len(sides) > 1 else None):
            a, to = sides[0][i], sides[-1]
            for j in hit:
                b = to[j]
                links[a[0]] = links.get(a[0], 0) + b[1]
                links[b[0]] = links.get(b[0], 0) + a[1]
                x, y = forest.root(a[0]), forest.root(b[0])
                forest[max(x, y)] = min(x, y)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(links, pa.int64()), pa.array(links.values(), pa.int64()), pa.array([forest.root(k) for k in links], pa.int64())], ["rid", "links", "root"])

    for batch in batches:
        for *k, rid, copies, block, text in zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "rid", "copies", "block", "text")), strict=True):
            if k != key:
                if rows:
                    yield from flush()
                key, rows = k, []
            rows.append((rid, copies, block, text))
    if rows:
        yield from flush()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, rid) in order: links (a, b) of every row to the first of its band, and the partition's first and last
    band with that first row (a is null), as their buckets may go on in other partitions."""
    band = head = None
    first, any_rows = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        bands, rids = (batch.column(c).to_numpy() for c in ("band", "rid"))
        new = np.append(band is None or bands[0] != band, bands[1:] != bands[:-1])
        at = np.maximum.accumulate(np.where(new, np.arange(len(bands)), -1))
        heads = np.where(at < 0, rids[0] if head is None else head, rids[at])
        if not any_rows:
            first, any_rows = (bands[0], rids[0]), True
        band, head = bands[-1], heads[-1]
        on = ~new
        yield pa.RecordBatch.from_arrays([pa.array(rids[on]), pa.array(heads[on]), pa.nulls(int(on.sum()), pa.int64())], ["a", "b", "band"])
    if any_rows:
        ends = [first] if first[0] == band else [first, (band, head)]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(ends), pa.int64()), pa.array([int(r) for _, r in ends], pa.int64()), pa.array([int(b) for b, _ in ends], pa.int64())], ["a", "b", "band"])


def bucket_links(members: DataFrame) -> DataFrame:
    """(a, b): links that join the rows of ``members`` (rid, band) with an equal band. Two rows a partition are grouped."""
    count = max(partitions(members.sparkSession), 1)
    dealt = members.select("band", "rid").repartitionByRange(count, "band", "rid").sortWithinPartitions("band", "rid")
    found = stored(dealt.mapInArrow(_linked, "a long, b long, band long"), "join-buckets")
    ends = found.filter("a is null").select("band", F.col("b").alias("a"))
    least = ends.groupBy("band").agg(F.min("a").alias("b"))
    return found.filter("a is not null").select("a", "b").union(ends.join(least, "band").filter("a <> b").select("a", "b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, class_id, first_rid, n_links) for every row of ``docs`` (rid, doc_id, text), rid being unique.

    ``n_links`` counts the other documents at 0.8 or more, copies included. ``first_rid`` is the row of the class with
    the least (doc_id, rid), null ids last.
    """
    spark = docs.sparkSession
    docs = docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = stored(docs.mapInArrow(_keyed, _KEYED), "join-keys")
    heads = stored(keyed.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("rid").alias("head"), F.count("*").alias("copies")), "join-heads")
    members = keyed.join(heads, keyed["rid"] == heads["head"]).select("rid", F.explode("bands").alias("band"))
    edges = bucket_links(members)
    groups = components(edges)
    grouped = keyed.join(heads, keyed["rid"] == heads["head"]).select("rid", "copies", "bytes").join(groups, F.col("rid") == F.col("node")).select("rid", "copies", "bytes", "root")
    grouped = stored(grouped, "join-groups")
    blocks = grouped.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("n"))
    dealt = grouped.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("n")).cast("int"))
    dealt = dealt.select("rid", "copies", "root", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o")).select(
        "rid", "copies", "root", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    # Few texts have a partner, so where the list of those that do is small, the others don't travel.
    texts = docs.join(small(dealt, "join-dealt"), "rid").select("root", "i", "j", "rid", "copies", "block", "text")
    count = max(partitions(spark), 1)
    joined = stored(texts.repartition(count, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_joined, "rid long, links long, root long"), "join-links")
    links = joined.groupBy("rid").agg(F.sum("links").alias("links"))
    classes = components(joined.filter("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")))
    solved = links.join(classes, F.col("rid") == F.col("node")).select(F.col("rid").alias("head"), "links", "root")
    named = keyed.select("rid", "doc_id", "digest").join(heads.join(solved, "head", "left"), "digest", "left").select(
        "rid", "doc_id", F.coalesce("root", "head", "rid").alias("root"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = stored(named, "join-named")
    first = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"].alias("first_rid"))
    return named.join(first, "root").select("rid", "doc_id", "class_id", "first_rid", "n_links")
