"""Packing by lexical retrieval: documents become full windows, each filled with its seed's BM25 neighbours.

1. Every text is tokenized once, whole; id 0 ends a document. Full windows are cut from its start: they need no
   neighbours. The rest (fewer ids than a window) is stored with a lexical signature, the least hash of its ids.
2. Rests are range-partitioned by (signature, row number). The order ends in a unique number, so copies of one text
   spread over partitions like any other rows, while related rests mostly meet.
3. A task cuts its partition into shards of ``SHARD`` rests and builds a BM25 inverted index per shard. The first
   unused rest seeds a window; its ``QUERY_TERMS`` weightiest ids are looked up, and unused neighbours are placed by
   falling score, whole where they fit. The best that doesn't fit fills the gap, and what it has left seeds the next
   window. Only the last window of a task can stay short.

Defined results: null texts count as empty; an empty document is the single id 0. Repeated rows are packed each on
its own. Tied neighbours go by position in the shard. An empty table gives no pieces. Other columns aren't read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import stored

WINDOW, SHARD, QUERY_TERMS, NEIGHBOURS = 1024, 4096, 16, 32
K1, B = 1.2, 0.75
_RESTS = 1 << 62
_TOKENS = "doc_id long, rid long, doc_tokens long, crcs array<long>, first_sequence long, signature int, rest binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoder(ranks_path: str, pattern: str, added: dict[str, int] | None = None):
    """The vocabulary as byte-pair ranks, which gives the ids of its JSON form several times faster. The strings of
    ``added`` tokens become their ids; without them all text is ordinary text."""
    import tiktoken
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added or {})


def _tokenize(ranks_path: str, pattern: str, window: int, added: dict[str, int]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        vocabulary = encoder(ranks_path, pattern, added)
        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for doc_id, rid, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "rid", "text")), strict=True):
                    text = text or ""
                    ids = vocabulary.encode(text, allowed_special="all") if any(t in text for t in added) else vocabulary.encode_ordinary(text)
                    ids.append(0)
                    ids = np.array(ids, "<u4")
                    full = len(ids) // window
                    rest = ids[full * window:]
                    crcs = [zlib.crc32(ids[k * window:(k + 1) * window].tobytes()) for k in range(full)]
                    mixed = (rest * np.uint32(2654435761)) ^ np.uint32(0x5BD1E995)
                    rows.append((doc_id, rid, len(ids), crcs, sequence, int(mixed.min() >> np.uint32(1)) if len(rest) else None, rest.astype("<u2").tobytes()))
                    sequence += full
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                    pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.binary()), strict=True)],
                    ["doc_id", "rid", "doc_tokens", "crcs", "first_sequence", "signature", "rest"])
    return task


class Shard:
    """BM25 index over the id lists of one shard (16-bit ids, so that posting lists come out of a radix sort)."""

    def __init__(self, rests: list[np.ndarray]):
        self.n = len(rests)
        sizes = np.array([len(r) for r in rests], np.int64)
        terms = np.concatenate([np.sort(r) for r in rests]).astype(np.uint16)
        self.doc_starts = np.concatenate([[0], np.cumsum(sizes)])
        first = np.ones(len(terms), bool)
        first[1:] = terms[1:] != terms[:-1]
        first[self.doc_starts[:-1][sizes > 0]] = True
        at = np.flatnonzero(first)
        tf = np.diff(np.append(at, len(terms)))
        docs = np.searchsorted(self.doc_starts, at, "right") - 1
        self.own = terms[at]
        self.doc_starts = np.searchsorted(at, self.doc_starts)
        df = np.bincount(self.own, minlength=65536)
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(1.0, sizes.mean()))
        self.own_weights = idf[self.own] * tf * (K1 + 1) / (tf + norm[docs])
        order = np.argsort(self.own, kind="stable")
        self.docs, self.weights = docs[order], self.own_weights[order]
        self.starts = np.concatenate([[0], np.cumsum(df)])

    def neighbours(self, seed: int, unused: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Unused members by falling score, ties by position; those that share no looked-up term are left out."""
        a, b = self.doc_starts[seed], self.doc_starts[seed + 1]
        heavy = np.argsort(-self.own_weights[a:b], kind="stable")[:QUERY_TERMS]
        lists = [slice(self.starts[t], self.starts[t + 1]) for t in self.own[a:b][heavy].tolist()]
        scores = np.bincount(np.concatenate([self.docs[x] for x in lists]), np.concatenate([self.weights[x] for x in lists]), self.n) * unused
        top = np.argpartition(-scores, k)[:k] if k < self.n else np.arange(self.n)
        top = top[scores[top] > 0]
        return top[np.lexsort((top, -scores[top]))]


def pack_shard(lengths: list[int], index: Shard, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (member, from, count). The last one may be short."""
    unused = np.ones(index.n, bool)
    windows: list[list[tuple[int, int, int]]] = []
    nxt, seed, taken = 0, None, 0
    while True:
        if seed is None:
            while nxt < index.n and not unused[nxt]:
                nxt += 1
            if nxt == index.n:
                return windows
            seed, taken = nxt, 0
        unused[seed] = False
        room = window - (lengths[seed] - taken)
        row = [(seed, taken, lengths[seed] - taken)]
        windows.append(row)
        origin, seed = seed, None
        while room:
            near, cut = index.neighbours(origin, unused), None
            for m in near:
                if lengths[m] <= room:
                    unused[m] = False
                    row.append((int(m), 0, lengths[m]))
                    room -= lengths[m]
                elif cut is None:
                    cut = int(m)
                if not room:
                    break
            if not room:
                break
            if cut is None:
                if len(near):
                    continue
                while nxt < index.n and not unused[nxt]:
                    nxt += 1
                if nxt == index.n:
                    break
                cut = nxt
            unused[cut] = False
            take = min(room, lengths[cut])
            row.append((cut, 0, take))
            room -= take
            if take < lengths[cut]:
                seed, taken = cut, take


def _pack(window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        sequence = _RESTS + (TaskContext.get().partitionId() << 40)
        held: list[tuple] = []

        def flush(rows: list[tuple], last: bool):
            """Pieces of all windows; a short one goes back as rests for the next shard unless it is the last."""
            nonlocal sequence
            ids = [np.frombuffer(r[3], "<u2") for r in rows]
            windows = pack_shard([len(x) for x in ids], Shard(ids), window)
            back, out = [], []
            for w in windows:
                if not last and sum(n for *_, n in w) < window and w is windows[-1]:
                    back = [(*rows[m][:2], rows[m][2] + at, ids[m][at:at + n].tobytes()) for m, at, n in w]
                    break
                offset = 0
                for m, at, n in w:
                    out.append((rows[m][0], rows[m][2] + at, n, zlib.crc32(ids[m][at:at + n].astype("<u4").tobytes()), rows[m][1], sequence, offset))
                    offset += n
                sequence += 1
            return back, pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(7)], [c.split()[0] for c in _PIECES.split(", ")])

        for batch in batches:
            for doc_id, tokens, rest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "rest")), strict=True):
                held.append((doc_id, tokens, tokens - len(rest) // 2, rest))
                if len(held) >= SHARD:
                    held, out = flush(held, False)
                    yield out
        if held:
            yield flush(held, True)[1]
    return task


def pack(docs: DataFrame, ranks_path: str, pattern: str, added: dict[str, int] | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``added`` are the tokens whose strings are tokens in texts too, with their ids. The vocabulary must have at most 65 536 ids.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), "text")
    tokens = stored(texts.mapInArrow(_tokenize(ranks_path, pattern, window, added or {}), _TOKENS), "packing-tokens")
    whole = tokens.select("doc_id", "doc_tokens", "first_sequence", F.posexplode("crcs").alias("k", "ids_crc32")).select(
        "doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = tokens.filter(F.octet_length("rest") > 0).select("doc_id", "rid", "doc_tokens", "signature", "rest")
    tasks = max(1, min(20_000, -(-rests.count() // SHARD)))
    packed = rests.repartitionByRange(tasks, "signature", "rid").sortWithinPartitions("signature", "rid").mapInArrow(_pack(window), _PIECES)
    return whole.unionByName(packed)
