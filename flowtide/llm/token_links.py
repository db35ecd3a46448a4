"""Alignment of two tokenizers over the bytes of each text, by sparse token-byte incidence products.

A text, with one space before it, is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B, which adds
that space itself). Every tokenization is an incidence matrix of tokens by bytes in compressed rows (``Incidence``):

* ``row_product(A, B transposed)`` holds one entry per pair of tokens that share bytes, with their number: the links.
* Offsets where tokens of both end cut the text into groups. Incidence matrices of tokens by groups give the
  shared-group links as the same product; ``group_links`` walks it row by row.

A piece of A never runs from a visible character into a space (its pattern) and no piece of B holds a space mark
behind another character (checked on the vocabulary), so both tokenizations end wherever a space follows a visible
character. The matrices are block diagonal over these chunks, and a task multiplies each distinct chunk once, in one
product per slice of documents, as long as its store of blocks (``BLOCKS`` chunks or ``BLOCK_BYTES``) lasts.

Corpus-wide counts: a document is stored with its distinct id pairs and how many links hold each. Pairs are summed per
task before the shuffle. Counts go back to documents in blocks of at most ``BROADCAST_PAIRS`` id pairs, dealt by hash
and measured before they are broadcast; the number of blocks is bounded by the vocabularies, not by the corpus.

Defined results: null and empty texts, and texts that either side doesn't spell byte for byte, have no tokens: zeros
and an empty ``groups_sha256``. Rows count each on their own, repeated ones too. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import stored

SLICE_DOCS, SLICE_CHARS = 256, 4 << 20
BLOCKS, BLOCK_BYTES = 200_000, 32 << 20
BROADCAST_PAIRS = 1_000_000
_CUT = re.compile(r"(?<=\S)(?= )")
_ENCODED = ("rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, "
            "codes array<long>, held array<long>")
_TYPES = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
_NAMES = [c.split()[0] for c in _ENCODED.split(", ")]


class Incidence:
    """Rows by columns, compressed: the columns of row i are ``indices[starts[i]:starts[i + 1]]``."""

    def __init__(self, starts: np.ndarray, indices: np.ndarray, columns: int):
        self.starts, self.indices, self.columns = starts, indices, columns

    @classmethod
    def of_runs(cls, ends: np.ndarray) -> Incidence:
        """Tokens that tile the bytes: token i covers everything from the end of token i - 1 to ``ends[i]``."""
        size = int(ends[-1]) if len(ends) else 0
        return cls(np.concatenate([[0], ends]).astype(np.int64), np.arange(size, dtype=np.int64), size)

    @classmethod
    def of_members(cls, column: np.ndarray, columns: int) -> Incidence:
        """One entry per row, in ``column``."""
        return cls(np.arange(len(column) + 1, dtype=np.int64), column.astype(np.int64), columns)

    def transposed(self) -> Incidence:
        order = np.argsort(self.indices, kind="stable")
        rows = np.repeat(np.arange(len(self.starts) - 1, dtype=np.int64), np.diff(self.starts))
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.columns))])
        return Incidence(starts.astype(np.int64), rows[order], len(self.starts) - 1)

    def rows(self, first: int, last: int) -> Incidence:
        a, b = self.starts[first], self.starts[last]
        return Incidence(self.starts[first:last + 1] - a, self.indices[a:b], self.columns)


def gathered(starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, ... of every i, ``widths[i]`` of them, one after the other."""
    ends = np.cumsum(widths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) + np.repeat(starts - ends + widths, widths)


def row_product(left: Incidence, right: Incidence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of left times right, ordered: each entry (i, k) adds row k of ``right`` to row i."""
    row = np.repeat(np.arange(len(left.starts) - 1, dtype=np.int64), np.diff(left.starts))
    widths = np.diff(right.starts)[left.indices]
    column = right.indices[gathered(right.starts[:-1][left.indices], widths)]
    cells, value = np.unique(np.repeat(row, widths) * max(1, right.columns) + column, return_counts=True)
    return cells // max(1, right.columns), cells % max(1, right.columns), value


def byte_links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A position, B position, shared bytes) of every pair that overlaps."""
    return row_product(Incidence.of_runs(ends_a), Incidence.of_runs(ends_b).transposed())


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every A and of every B token: groups end where tokens of both end."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)


def group_links(group_a: np.ndarray, group_b: np.ndarray, step: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(A positions, B positions) of all pairs of one group, ``step`` rows of A at a time."""
    columns = int(max(group_a.max(initial=-1), group_b.max(initial=-1))) + 1
    left, right = Incidence.of_members(group_a, columns), Incidence.of_members(group_b, columns).transposed()
    for first in range(0, len(group_a), step):
        a, b, _ = row_product(left.rows(first, min(first + step, len(group_a))), right)
        yield a + first, b


class Pair:
    """Both vocabularies, made from the bytes of their files. Special tokens inside texts are plain text."""

    def __init__(self, ranks: bytes, pattern: str, model: bytes):
        import sentencepiece
        import tiktoken
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, io.BytesIO(ranks))}
        self.a = tiktoken.Encoding("links", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            self.size_a[rank] = len(token)
        self.size_b = np.array([len(p) for p in self.bytes_b], np.int64)
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.space = next((i for i, p in enumerate(pieces) if p == "▁"), None)

    def chunks(self, text: str) -> list[str]:
        """Parts of space + text, each starting with a space, that both sides encode on their own."""
        return _CUT.split(" " + text) if self.cuts and self.space is not None else [" " + text]

    def encode_b(self, chunks: list[str]) -> list[list[int]]:
        """B adds the first space of each chunk itself, unless nothing follows it."""
        return [ids if len(chunk) > 1 else [self.space] for chunk, ids in zip(chunks, self.b.encode([c[1:] for c in chunks], num_threads=1), strict=True)]


class Pool:
    """A growing array of numbers."""

    def __init__(self, size: int = 1024):
        self.data, self.n = np.zeros(size, np.int64), 0

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(need, len(self.data)), np.int64)])
        self.data[self.n:need] = values
        self.n = need


class Blocks:
    """The diagonal blocks met so far: per distinct chunk its sizes, its link codes and its group text."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.known: dict[str, int] = {}
        self.bytes = 0
        self.texts: list[str] = []
        self.sizes = [Pool() for _ in range(6)]  # A tokens, B tokens, groups, links, shared-group links, spelt alike
        self.starts, self.codes = Pool(), Pool()

    def full(self) -> bool:
        return len(self.known) > BLOCKS or self.bytes > BLOCK_BYTES

    def learn(self, chunks: list[str]) -> None:
        """One block-diagonal product for all new chunks."""
        pair = self.pair
        ids_a = [pair.a.encode_ordinary(c) for c in chunks]
        ids_b = pair.encode_b(chunks)
        alike = np.array([b"".join([pair.bytes_b[i] for i in ids]) == c.encode() for c, ids in zip(chunks, ids_b, strict=True)], bool)
        for k in np.flatnonzero(~alike):
            ids_a[k], ids_b[k] = [], []
        count_a, count_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
        a = np.array([i for x in ids_a for i in x], np.int64)
        b = np.array([i for x in ids_b for i in x], np.int64)
        ends_a, ends_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
        pos_a, pos_b, _ = byte_links(ends_a, ends_b)
        group_a, group_b = groups_of(ends_a, ends_b)
        chunk_a = np.repeat(np.arange(len(chunks)), count_a)
        links = np.bincount(chunk_a[pos_a], minlength=len(chunks))
        n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        first = np.cumsum(in_a) - in_a
        group_chunk = chunk_a[first] if n_groups else first
        groups = np.bincount(group_chunk, minlength=len(chunks))
        shared = np.bincount(group_chunk, weights=in_a * in_b, minlength=len(chunks)).astype(np.int64)
        self.starts.add(self.codes.n + np.cumsum(links) - links)
        self.codes.add(a[pos_a] * len(pair.size_b) + b[pos_b])
        for pool, values in zip(self.sizes, (count_a, count_b, groups, links, shared, alike), strict=True):
            pool.add(values)
        self._describe(chunks, a.tolist(), b.tolist(), in_a.tolist(), in_b.tolist(), groups.tolist())

    def _describe(self, chunks: list[str], a: list[int], b: list[int], in_a: list[int], in_b: list[int], groups: list[int]) -> None:
        text_a, text_b = list(map(str, a)), list(map(str, b))
        g = i = j = 0
        for chunk, n in zip(chunks, groups, strict=True):
            parts = []
            for g in range(g, g + n):
                parts.append(",".join(text_a[i:i + in_a[g]]) + "|" + ",".join(text_b[j:j + in_b[g]]))
                i, j = i + in_a[g], j + in_b[g]
            g += 1 if n else 0
            self.known[chunk] = len(self.texts)
            self.texts.append(";".join(parts))
            self.bytes += len(chunk)

    def row(self, index: np.ndarray) -> tuple:
        """(tokens of A, of B, groups, links, shared-group links, digest, codes, held) of the chunks of one text."""
        if not len(index) or not self.sizes[5].data[index].all():
            return 0, 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        totals = [int(pool.data[index].sum()) for pool in self.sizes[:5]]
        digest = hashlib.sha256(";".join([self.texts[i] for i in index.tolist()]).encode()).hexdigest()
        chunk, times = np.unique(index, return_counts=True)
        widths = self.sizes[3].data[chunk]
        codes, where = np.unique(self.codes.data[gathered(self.starts.data[chunk], widths)], return_inverse=True)
        held = np.bincount(where, weights=np.repeat(times, widths)).astype(np.int64)
        return *totals, digest, codes, held


def _slices(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """Few documents at a time; a very long one stands alone."""
    rows, chars = [], 0
    for row in zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id", "text")), strict=True):
        if rows and (len(rows) == SLICE_DOCS or chars + len(row[2] or "") > SLICE_CHARS):
            yield rows
            rows, chars = [], 0
        rows.append(row)
        chars += len(row[2] or "")
    if rows:
        yield rows


def _parts(chunks: list[str], chars: int = 1 << 19) -> Iterator[list[str]]:
    """At most ``chars`` at a time, which bounds a product's arrays; a longer chunk stands alone."""
    first = held = 0
    for k, chunk in enumerate(chunks):
        if k > first and held + len(chunk) > chars:
            yield chunks[first:k]
            first, held = k, 0
        held += len(chunk)
    if first < len(chunks):
        yield chunks[first:]


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), pa.int64()))


def _encode(ranks, pattern: str, model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(ranks.value, pattern, model.value)
        blocks = Blocks(pair)
        for batch in batches:
            for rows in _slices(batch):
                texts = [pair.chunks(text) if text else [] for *_, text in rows]
                if blocks.full():
                    blocks = Blocks(pair)
                new = list(dict.fromkeys(c for chunks in texts for c in chunks if c not in blocks.known))
                for part in _parts(new):
                    blocks.learn(part)
                known = blocks.known
                done = [(rid, doc_id, *blocks.row(np.array([known[c] for c in chunks], np.int64)))
                        for (rid, doc_id, _), chunks in zip(rows, texts, strict=True)]
                columns = list(zip(*done, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:8], _TYPES, strict=False)]
                                                 + [_lists(c) for c in columns[8:]], _NAMES)
    return task


def _file(spark, path: str):
    """A vocabulary file's bytes for the tasks; executors need not have the file. Its size doesn't grow with the data."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encoded(docs: DataFrame, ranks_path: str, pattern: str, model_path: str) -> DataFrame:
    """(rid, doc_id, n_a, n_b, n_groups, n_links, n_group_links, groups_sha256, codes, held) of every row, stored.

    ``codes`` are the distinct id pairs (A id * size of B + B id) and ``held`` the number of links of each."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(texts.mapInArrow(_encode(_file(spark, ranks_path), pattern, _file(spark, model_path)), _ENCODED), "token-links")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select("rid", F.explode(F.arrays_zip("codes", "held")).alias("p")).select("rid", "p.codes", "p.held")


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(code, total, best): in how many links of the corpus a pair stands, and whether no pair of its B id stands in more."""
    totals = stored(_pairs(rows).groupBy("codes").agg(F.sum("held").alias("total")), "pair-totals")
    most = totals.groupBy((F.col("codes") % size_b).alias("b")).agg(F.max("total").alias("most"))
    return stored(totals.withColumn("b", F.col("codes") % size_b).join(most, "b")
                  .select(F.col("codes").alias("code"), "total", (F.col("total") == F.col("most")).alias("best")), "pair-counts")


def _blocks(counts: DataFrame, limit: int) -> int:
    """So many blocks that the largest holds at most ``limit`` pairs."""
    n = max(1, -(-counts.count() // limit))
    while n > 1 and counts.groupBy(F.pmod(F.xxhash64("code"), F.lit(n))).count().agg(F.max("count")).first()[0] > limit:
        n += n // 4 + 1
    return n


def align(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, limit: int = BROADCAST_PAIRS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256,
    n_group_links. A link counts as best if its id pair stands in the most links among the pairs of its B id."""
    import sentencepiece
    rows = encoded(docs, ranks_path, pattern, model_path)
    size_b = sentencepiece.SentencePieceProcessor(model_file=model_path).get_piece_size()
    counts = pair_counts(rows, size_b)
    n = _blocks(counts, limit)
    parts = None
    for k in range(n):
        own = F.pmod(F.xxhash64("code"), F.lit(n)) == k
        pairs = _pairs(rows).withColumnRenamed("codes", "code").filter(own)
        part = (pairs.join(F.broadcast(counts.filter(own)), "code").groupBy("rid")
                .agg(F.sum(F.col("held") * F.col("total")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("held")).otherwise(0)).alias("n_best")))
        parts = part if parts is None else parts.union(part)
    sums = parts.groupBy("rid").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return rows.join(sums, "rid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256", "n_group_links")


def _link_rows(ranks, pattern: str, model, shared: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(ranks.value, pattern, model.value)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                chunks = pair.chunks(text) if text else []
                a = np.array([i for c in chunks for i in pair.a.encode_ordinary(c)], np.int64)
                b = np.array([i for ids in (pair.encode_b(chunks) if chunks else []) for i in ids], np.int64)
                if not len(b) or b"".join([pair.bytes_b[i] for i in b.tolist()]) != (" " + text).encode():
                    continue
                ends_a, ends_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
                for at_a, at_b in (group_links(*groups_of(ends_a, ends_b)) if shared else [byte_links(ends_a, ends_b)[:2]]):
                    bytes_shared = np.maximum(0, np.minimum(ends_a[at_a], ends_b[at_b])
                                              - np.maximum(ends_a[at_a] - pair.size_a[a[at_a]], ends_b[at_b] - pair.size_b[b[at_b]]))
                    columns = [np.full(len(at_a), 0 if doc_id is None else doc_id), at_a, a[at_a], at_b, b[at_b], bytes_shared]
                    arrays = [pa.array(c, pa.int64()) for c in columns]
                    if doc_id is None:
                        arrays[0] = pa.nulls(len(at_a), pa.int64())
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "a_at", "a_id", "b_at", "b_id", "shared_bytes"])
    return task


def links(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, shared_groups: bool = False) -> DataFrame:
    """One row per link: doc_id, a_at, a_id, b_at, b_id, shared_bytes. ``shared_groups`` gives all pairs of a group
    instead of those that overlap."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_link_rows(_file(spark, ranks_path), pattern, _file(spark, model_path), shared_groups),
                            "doc_id long, a_at long, a_id long, b_at long, b_id long, shared_bytes long")
