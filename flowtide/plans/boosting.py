"""Boosted trees for several classes under one softmax, grown from gradient histograms.

Features are cut into bins at approximate quantiles once. A round grows one tree per class, level by level: every task
adds up its rows' gradients by (class, node, feature, bin), the sums of all tasks meet in a vector sum that combines
map-side, and the best cut of every node is read from them, as are the leaves of the last cuts. Rows never move; what reaches the driver is the size of the
trees, not of the data. Margins are stored every ``STORED_ROUNDS`` rounds, so a pass applies few trees again; the frame that
they replace is removed. Where the rows are few (``ONE_TASK_CELLS``), one task grows the rounds that follow from the same
sums, over all rows: a job for each level would cost more than the level.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowtide.session import durable, remove_folder
from flowtide.sources.readers import read_json, write_json

BINS, STORED_ROUNDS = 32, 8
#: So many rows x features x classes are left to one task, some 100 s of it for 150 rounds of depth 6.
ONE_TASK_CELLS = 16_000_000
#: Added to the sum of second derivatives of a node; the least such sum of a child.
SMOOTHING, LEAST_CHILD = 1.0, 1.0
#: Bins, margins of the stored rounds (none before the first are stored), class, weight, and a number drawn by.
_ROWS = {"x": "binary", "m": "binary", "y": "int", "w": "double", "u": "long"}
_SUMS = "tree int, node int, v array<double>"
_TREES = "round int, tree int, feature binary, cut binary, value binary"


@dataclass
class Tree:
    """Nodes in heap order: children of i are 2i + 1 and 2i + 2. ``feature`` is -1 at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1, np.int16), np.zeros(size, np.int16), np.zeros(size))

    def nodes(self, x: np.ndarray, levels: int) -> np.ndarray:
        """The node every row has reached after ``levels`` cuts, or the leaf it stopped at."""
        cells, starts, at = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x), np.int64)
        feature = np.maximum(self.feature, 0).astype(np.int64)
        # A leaf is its own child on both sides.
        ids = np.arange(len(self.feature))
        left, step = np.where(self.feature >= 0, 2 * ids + 1, ids), (self.feature >= 0).astype(np.int64)
        for _ in range(levels):
            right = cells.take(starts + feature.take(at)) > self.cut.take(at)
            at = left.take(at) + step.take(at) * right
        return at


def _levels(tree: Tree) -> int:
    return (len(tree.feature) + 1).bit_length() - 2


@dataclass
class BoostedTrees:
    """Cut points per feature and, per round, one tree per class."""

    cuts: list[list[float]]
    classes: int
    rounds: list[list[Tree]] = field(default_factory=list)

    def binned(self, values: np.ndarray) -> np.ndarray:
        """Bin numbers: a value equal to a cut point stays below it."""
        return np.stack([np.searchsorted(c, values[:, i], "left") for i, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def add_margins(self, x: np.ndarray, margins: np.ndarray) -> np.ndarray:
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                margins[:, k] += tree.value[tree.nodes(x, _levels(tree))]
        return margins

    def predict(self, values: np.ndarray) -> np.ndarray:
        return softmax(self.add_margins(self.binned(values), np.zeros((len(values), self.classes))))

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` to a frame with the inputs x0, x1, ..."""
        names = [f"x{i}" for i in range(len(self.cuts))]

        @F.arrow_udf("array<double>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                values = [v.to_numpy(zero_copy_only=False).astype(np.float64) for v in batch.flatten()]
                p = self.predict(np.stack(values, axis=1))
                yield pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * np.int32(self.classes), p.ravel())
        return df.withColumn("probability", run(F.struct(*names)))

    def save(self, spark: SparkSession, path: str) -> None:
        rounds = [[[t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in trees] for trees in self.rounds]
        write_json(spark, {"cuts": self.cuts, "classes": self.classes, "rounds": rounds}, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        stored = read_json(spark, path)
        rounds = [[Tree(np.array(f, np.int16), np.array(c, np.int16), np.array(v)) for f, c, v in trees] for trees in stored["rounds"]]
        return cls(stored["cuts"], stored["classes"], rounds)


def softmax(margins: np.ndarray) -> np.ndarray:
    odds = np.exp(margins - margins.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def cut_points(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Approximate quantiles of all features in one pass, without repeats."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    row = df.agg(*[F.percentile_approx(f, shares, 10 * bins).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [sorted({float(v) for v in row[i] or []}) for i in range(len(features))]


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """Values of one width as a matrix, a row each, without a copy."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(kind).reshape(len(column), -1)


def _binary(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    matrix = np.ascontiguousarray(matrix)
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix[:1].nbytes)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends), pa.py_buffer(matrix)])


def _margins(batch: pa.RecordBatch, classes: int) -> np.ndarray:
    return _matrix(batch.column("m"), np.float64).copy() if "m" in batch.schema.names else np.zeros((batch.num_rows, classes))


def _schema(names: Sequence[str]) -> str:
    return ", ".join(f"{c} {_ROWS[c]}" for c in names)


def _pack(model: BoostedTrees, rest: Sequence[str]):
    features = len(model.cuts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(features)], axis=1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([_binary(model.binned(values)), *(batch.column(c) for c in rest)], ["x", *rest])
    return task


def _store_margins(model: BoostedTrees, first: int, rest: Sequence[str]):
    recent = BoostedTrees([], model.classes, model.rounds[first:])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = recent.add_margins(_matrix(batch.column("x"), np.uint8), _margins(batch, recent.classes))
            yield pa.RecordBatch.from_arrays([batch.column("x"), _binary(m), *(batch.column(c) for c in rest)], ["x", "m", *rest])
    return task


def _drawn(w: np.ndarray, batch: pa.RecordBatch, part: float, salt: int) -> np.ndarray:
    """Weights of a round: zero for rows that it does not draw."""
    if part >= 1:
        return w
    u = batch.column("u").to_numpy(zero_copy_only=False)
    drawn = ((u.astype(np.uint64) ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)) / float(1 << 53) < part
    return np.where(drawn, w, 0.0)


def _add_sums(total: np.ndarray, seen: np.ndarray, growing: list[Tree], level: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, p: np.ndarray) -> None:
    """Add gradients and second derivatives of rows to ``total`` by (class, node of the level, feature, bin)."""
    _, width, features, bins, _ = total.shape
    cells = x + np.arange(features) * bins
    for k, tree in enumerate(growing):
        node = tree.nodes(x, level) - (width - 1)
        open_rows = (node >= 0) & (w > 0)
        at, weight, chance = node[open_rows], w[open_rows], p[open_rows, k]
        g = weight * (chance - (y[open_rows] == k))
        h = weight * np.maximum(2 * chance * (1 - chance), 1e-16)
        seen[k, np.unique(at)] = True
        cell = (cells[open_rows] + (at * (features * bins))[:, None]).ravel()
        for i, values in enumerate((g, h)):
            total[k, ..., i] += np.bincount(cell, np.repeat(values, features), width * features * bins).reshape(width, features, bins)


def _sums(model: BoostedTrees, first: int, growing: list[Tree], level: int, bins: int, part: float, salt: int):
    """Per task: gradient and second derivative by (class, node of the level, feature, bin)."""
    features, classes = len(model.cuts), model.classes
    # Rounds in the stored margins stay with the driver.
    recent = BoostedTrees([], classes, model.rounds[first:])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes, 2 ** level, features, bins, 2))
        seen = np.zeros((classes, 2 ** level), bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, (y, w) = _matrix(batch.column("x"), np.uint8), (batch.column(c).to_numpy(zero_copy_only=False) for c in "yw")
            p = softmax(recent.add_margins(x, _margins(batch, classes)))
            _add_sums(total, seen, growing, level, x, y, _drawn(w, batch, part, salt), p)
        trees, nodes = np.nonzero(seen)
        if len(trees):
            values = [total[k, n].ravel() for k, n in zip(trees, nodes, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(trees, pa.int32()), pa.array(nodes, pa.int32()), pa.array(values, pa.list_(pa.float64()))],
                                             ["tree", "node", "v"])
    return task


def _salt(seed: int, number: int) -> int:
    return seed * 1_000_003 + number


def _grow_rest(model: BoostedTrees, first: int, rounds: int, depth: int, rate: float, bins: int, part: float, seed: int):
    """One task for all rows: the rounds that ``model`` lacks, level by level as the passes grow them."""
    features, classes, begin = len(model.cuts), model.classes, len(model.rounds)
    recent = BoostedTrees([], classes, model.rounds[first:])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for batch in batches:
            if batch.num_rows:
                x, (y, w) = _matrix(batch.column("x"), np.uint8), (batch.column(c).to_numpy(zero_copy_only=False) for c in "yw")
                blocks.append((batch, x, y, w, recent.add_margins(x, _margins(batch, classes))))
        for number in range(begin, rounds):
            growing = [Tree.empty(depth) for _ in range(classes)]
            drawn = [(x, y, _drawn(w, batch, part, _salt(seed, number)), softmax(m)) for batch, x, y, w, m in blocks]
            for level in range(max(depth, 1)):
                total = np.zeros((classes, 2 ** level, features, bins, 2))
                seen = np.zeros((classes, 2 ** level), bool)
                for x, y, w, p in drawn:
                    _add_sums(total, seen, growing, level, x, y, w, p)
                if not _extend(growing, level, depth, rate, ((k, n, total[k, n]) for k, n in zip(*np.nonzero(seen), strict=True))):
                    break
            for _, x, _, _, m in blocks:
                BoostedTrees([], classes, [growing]).add_margins(x, m)
            columns = [[number] * classes, list(range(classes)), *([getattr(t, c).tobytes() for t in growing] for c in ("feature", "cut", "value"))]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["round", "tree", "feature", "cut", "value"])
    return task


def _cut(sums: np.ndarray) -> tuple[int, int]:
    """(feature, bin) of the best cut of a node's sums [feature, bin, 2], or (-1, 0)."""
    upto = sums.cumsum(axis=1)
    g, h = upto[..., 0], upto[..., 1]
    all_g, all_h = g[:, -1:], h[:, -1:]
    gain = g ** 2 / (h + SMOOTHING) + (all_g - g) ** 2 / (all_h - h + SMOOTHING) - all_g ** 2 / (all_h + SMOOTHING)
    gain[(h < LEAST_CHILD) | (all_h - h < LEAST_CHILD)] = 0
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    return (int(f), int(b)) if gain[f, b] > 1e-9 else (-1, 0)


def _leaf(sums: np.ndarray, rate: float) -> float:
    """The value of a leaf whose rows' sums by bin these are."""
    g, h = sums.sum(axis=0)
    return -rate * g / (h + SMOOTHING)


def _replace(rows: DataFrame, later: DataFrame) -> DataFrame:
    """Store ``later``, then remove the stored ``rows`` that it was made from."""
    folders = {f.rsplit("/", 1)[0] for f in rows.inputFiles()}
    stored = durable(later, "boosting-rows")
    for folder in folders:
        remove_folder(rows.sparkSession, folder)
    return stored


def _extend(growing: list[Tree], level: int, depth: int, rate: float, found: Iterable[tuple[int, int, np.ndarray]]) -> bool:
    """Cut the nodes of a level by their sums [feature, bin, 2]; whether any was cut."""
    grown = False
    for k, n, sums in found:
        tree, node = growing[k], 2 ** level - 1 + n
        tree.value[node] = _leaf(sums[0], rate)
        if level < depth:
            f, b = tree.feature[node], tree.cut[node] = _cut(sums)
            if f >= 0:
                grown = True
                tree.value[2 * node + 1], tree.value[2 * node + 2] = _leaf(sums[f, :b + 1], rate), _leaf(sums[f, b + 1:], rate)
    return grown


def train(df: DataFrame, features: Sequence[str], classes: int, rounds: int = 150, depth: int = 6, rate: float = 0.1, seed: int = 42,
          subsample: float = 1.0, bins: int = BINS, weight: str | None = None) -> BoostedTrees:
    """Fit on ``df`` (the features and ``y``, a class number)."""
    model = BoostedTrees(cut_points(df, features, bins), classes)
    inputs = df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col("y").cast("int").alias("y"),
                       (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.xxhash64(F.lit(seed), *features, "y").alias("u"))
    # Passes read only what they need.
    rest = ["y", "w", "u"] if subsample < 1 else ["y", "w"]
    packed = inputs.drop(*{"u"}.difference(rest)).mapInArrow(_pack(model, rest), _schema(["x", *rest]))
    rows, first = durable(packed, "boosting-rows"), 0
    while len(model.rounds) < rounds:
        number, growing = len(model.rounds), [Tree.empty(depth) for _ in range(classes)]
        # The leaves below the last cuts have their sums from the bins on either side, so no pass is made for them.
        for level in range(max(depth, 1)):
            partial = rows.mapInArrow(_sums(model, first, growing, level, bins, subsample, _salt(seed, number)), _SUMS)
            found = partial.groupBy("tree", "node").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select("tree", "node", vector_to_array("v").alias("v"))
            # At most one row per class and node of the level.
            if not _extend(growing, level, depth, rate, ((r["tree"], r["node"], np.array(r["v"]).reshape(len(features), bins, 2)) for r in found.collect())):
                break
        model.rounds.append(growing)
        if len(model.rounds) - first == STORED_ROUNDS and len(model.rounds) < rounds:
            if first == 0 and 0 < rows.count() * len(features) * classes <= ONE_TASK_CELLS:
                grow = _grow_rest(model, first, rounds, depth, rate, bins, subsample, seed)
                # One row per tree.
                trees = {(r["round"], r["tree"]): Tree(np.frombuffer(r["feature"], np.int16), np.frombuffer(r["cut"], np.int16), np.frombuffer(r["value"]))
                         for r in rows.coalesce(1).mapInArrow(grow, _TREES).collect()}
                model.rounds += [[trees[n, k] for k in range(classes)] for n in range(len(model.rounds), rounds)]
            else:
                rows = _replace(rows, rows.mapInArrow(_store_margins(model, first, rest), _schema(["x", "m", *rest])))
                first = len(model.rounds)
    return model
