"""Exact top-k search by an impact-ordered index that is read score-at-a-time.

A vector's components are its impacts. Every block of candidate rows is indexed by quantised impact: segment s of the
block holds, over all dimensions, the postings whose absolute impact falls into the s-th highest of ``LEVELS``
geometric steps. A query block reads the segments in descending impact and adds each posting's share to its
accumulators. Whatever a row still has in unread segments can move a score by at most |query| * |unread part of the
row| (Cauchy-Schwarz), so after each segment every accumulator is an interval. Rows whose upper end lies below the k-th
best lower end are out, which is the proof; reading ends once so few rows are left that rescoring them costs less than
the next segment, or no segment is left. The rest are rescored exactly in integers.

Candidate blocks and query blocks meet by block number, so a task holds one of each whatever their total; each pair
yields at most k rows per query, and a window per query keeps the k best.

Defined results: vectors that are null or hold null or non-finite components take no part, as query or candidate.
Vectors of different length compare over the shorter's components. Repeated ids are rows of their own, each with its
own k best; a query only leaves out its own row, so its twins are found. Ties go to the smaller vec_id. With no candidates a query has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.common import stored

SCALE, CANDIDATES, QUERIES, LEVELS = 1024, 2048, 512, 4
_PACKED = "block long, rids binary, ids binary, data binary, width int"
_FOUND = "q_rid long, query_id long, vec_id long, score long"


def _pack(rows_per_block: int):
    """Rows of a partition as blocks: ids and a matrix of integers, padded with 0 to the block's widest vector."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        rids: list[int] = []
        ids: list[int] = []
        rows: list[np.ndarray] = []

        def block():
            width = max(map(len, rows))
            data = np.zeros((len(rows), width), np.int64)
            for i, r in enumerate(rows):
                data[i, :len(r)] = r
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.array(rids, "<i8").tobytes()], pa.binary()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                                               pa.array([data.tobytes()], pa.binary()), pa.array([width], pa.int32())], ["block", "rids", "ids", "data", "width"])
        for batch in batches:
            for r, i, v in zip(*(batch.column(c).to_pylist() for c in ("rid", "vec_id", "v")), strict=True):
                rids.append(r)
                ids.append(i)
                rows.append(np.array(v, np.int64))
                if len(ids) == rows_per_block:
                    yield block()
                    number += 1
                    rids, ids, rows = [], [], []
        if ids:
            yield block()
    return task


class ImpactIndex:
    """Segments of one candidate block, by descending quantised impact."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, data: np.ndarray):
        self.rids, self.ids, self.data = rids, ids, data
        values = data.astype(np.float64)
        size = np.abs(values)
        top = max(1.0, size.max(initial=0.0))
        bounds = [top / 2 ** (s + 1) for s in range(LEVELS - 1)] + [-1.0]
        self.segments, self.unread = [], []
        left = size <= top
        for bound in bounds:
            here = left & (size > bound)
            left &= ~here
            self.segments.append(np.where(here, values, 0.0))
            self.unread.append(np.sqrt((np.where(left, values, 0.0) ** 2).sum(axis=1)))

    def search(self, query_rids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Row numbers and exact scores of each query's possible k best."""
        asked = queries.astype(np.float64)
        norms = np.sqrt((asked ** 2).sum(axis=1))
        sums = np.zeros((len(queries), len(self.ids)))
        alive = self.rids[None, :] != query_rids[:, None]
        reading = np.ones(len(queries), bool)
        for segment, unread in zip(self.segments, self.unread, strict=True):
            on = np.flatnonzero(reading)
            if not len(on):
                break
            sums[on] += asked[on] @ segment.T
            # A margin for rounding in the sums.
            slack = norms[on, None] * unread[None, :] * (1 + 1e-9) + 1e-9 * (1 + np.abs(sums[on]))
            low = np.where(alive[on], sums[on] - slack, -np.inf)
            if low.shape[1] > k:
                proof = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
                alive[on] &= sums[on] + slack >= proof[:, None]
            reading[on] = alive[on].sum(axis=1) > 2 * k
        rows, scores = [], []
        for q in range(len(queries)):
            at = np.flatnonzero(alive[q])
            score = self.data[at] @ queries[q]
            best = np.lexsort((self.ids[at], -score))[:k]
            rows.append(at[best])
            scores.append(score[best])
        return rows, scores


def _search(k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in batches:
            for r in batch.to_pylist():
                rids, ids, asked, asked_ids = (np.frombuffer(r[c], "<i8") for c in ("rids", "ids", "q_rids", "q_ids"))
                width = min(r["width"], r["q_width"])
                if last != (r["block"], width):
                    last, index = (r["block"], width), ImpactIndex(rids, ids, np.frombuffer(r["data"], np.int64).reshape(len(ids), -1)[:, :width])
                rows, scores = index.search(asked, np.frombuffer(r["q_data"], np.int64).reshape(len(asked), -1)[:, :width], k)
                each = [len(x) for x in rows]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, each)), pa.array(np.repeat(asked_ids, each)), pa.array(ids[np.concatenate(rows)]), pa.array(np.concatenate(scores))], ["q_rid", "query_id", "vec_id", "score"])
    return task


def quantised(embedding: Column) -> Column:
    """floor(1024 * x) per component."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE))


def usable(embedding: Column) -> Column:
    """No null and no non-finite component. An empty vector is usable: its products are 0."""
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score for ``vectors`` (vec_id, embedding); ``is_query`` marks the query rows."""
    rows = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"), is_query.alias("asks"))
    # Written once: a row keeps its number as query and as candidate.
    rows = stored(rows, "vectors")
    candidates = stored(rows.select("rid", "vec_id", "v").mapInArrow(_pack(CANDIDATES), _PACKED), "candidate-blocks")
    asked = rows.filter("asks").select("rid", "vec_id", "v")
    blocks = max(1, -(-asked.count() // QUERIES))
    queries = stored(asked.repartition(blocks, "rid").mapInArrow(_pack(QUERIES), _PACKED), "query-blocks").select(
        F.col("block").alias("q_block"), F.col("rids").alias("q_rids"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("width").alias("q_width"))
    # Block numbers only; every candidate block meets every query block, one row per pair, in the candidate block's task.
    numbers = [r.q_block for r in queries.select("q_block").collect()]
    pairs = candidates.select("block", F.explode(F.array(*map(F.lit, numbers)).cast("array<long>")).alias("q_block"))
    met = pairs.join(queries, "q_block").join(candidates, "block")
    found = met.select("block", "rids", "ids", "data", "width", "q_rids", "q_ids", "q_data", "q_width").mapInArrow(_search(k), _FOUND)
    rank = F.row_number().over(Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
