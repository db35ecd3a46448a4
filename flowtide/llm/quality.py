"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

A document is described by ``STATISTICS`` of its whole text. Standardised statistics go through D random cosines,
whose inner products approximate a Gaussian kernel. Each task sums its rows' normal equations into one (D+1)x(D+2)
block; Spark adds the blocks row by row, so the driver solves a system whose size does not depend on the input.
A held-back fifth of the learning rows gives a 256-bin reliability curve, made monotone by pooling and interpolated.

Defined results: null and empty texts have the statistics of an empty text and get a score like any other. Labels
that are null, or whose document is missing, are left out; several labels of one document are averaged. Without two
classes to learn from, every score is the share of label 1 (0.5 without labels). Extra columns pass through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.llm.common import partitions, stored

STATISTICS = ("log_chars", "log_words", "word_length", "upper", "digits", "stops", "symbols", "beyond_ascii", "spaces",
              "lines", "distinct_words", "repeated_lines", "top_word", "bars", "marked_words", "repeated_pairs",
              "sentence_words", "short_words", "capital_words", "entropy")
BINS = 256
#: Rows used for fitting at most; a hash of the row decides, so the sample spreads over the whole table.
FIT_ROWS = 400_000


def statistics_of(text: str | None) -> list[float]:
    text = text or ""
    coded = text.encode("utf-8", "replace")
    raw = np.bincount(np.frombuffer(coded, np.uint8), minlength=256).tolist()
    size, words, lines = max(1, len(coded)), text.split(), text.split("\n")
    n = max(1, len(words))
    upper, lower = sum(raw[65:91]), sum(raw[97:123])
    stops, ends = raw[33] + raw[44] + raw[46] + raw[58] + raw[59] + raw[63], raw[33] + raw[46] + raw[63]
    symbols = sum(raw[33:48]) + sum(raw[58:65]) + sum(raw[91:97]) + sum(raw[123:127]) - stops
    counts = Counter(words)
    repeated = sum(len(k) * (c - 1) for k, c in Counter(lines).items() if c > 1) if len(set(lines)) < len(lines) else 0
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1  # noqa: B905
    lengths = list(map(len, words))
    shares = [c / size for c in raw if c]
    # Per distinct word, weighted by how often it stands.
    marked = sum(c for w, c in counts.items() if not w[-1].isalnum())
    return [
        math.log1p(len(text)), math.log1p(len(words)), sum(lengths) / n, upper / max(1, upper + lower),
        sum(raw[48:58]) / size, stops / n, symbols / n, sum(raw[128:]) / size, (raw[32] + raw[9]) / size, raw[10] / n,
        len(counts) / n, repeated / max(1, len(text)), max(counts.values(), default=0) / n, raw[124] / n, marked / n,
        1 - pairs / max(1, len(words) - 1), math.log1p(len(words) / (1 + ends)),
        (lengths.count(1) + lengths.count(2) + lengths.count(3)) / n, sum(c for w, c in counts.items() if w.isupper()) / n,
        -sum(p * math.log(p) for p in shares),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics(texts: pd.Series) -> pd.Series:
    return texts.map(statistics_of)


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never used."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass
class QualityModel:
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray | None
    knots: tuple[np.ndarray, np.ndarray]
    base: float
    directions: np.ndarray
    phases: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        at, to = self.knots
        return np.interp(self.raw(x), at, to)

    def score(self, x: Column) -> Column:
        """Probability of label 1 for a column of statistics."""
        @F.pandas_udf(T.DoubleType())
        def scored(rows: pd.Series) -> pd.Series:
            return pd.Series(self.probability(np.array(rows.tolist(), float).reshape(len(rows), -1)))
        return scored(x)


def _normal_rows(model: QualityModel):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("x").to_pylist(), float)
            z = model.cosines(x)
            block = z.T @ np.hstack([z, np.asarray(batch.column("y"), float)[:, None]])
            total = block if total is None else total + block
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])
    return task


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, v in zip(batch.column("i").to_pylist(), batch.column("v").to_pylist(), strict=True):
            total[i] = total[i] + np.array(v) if i in total else np.array(v)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["i", "v"])


def _pooled(bins: list) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over (score, label sum, count), in order of the score."""
    blocks: list[list[float]] = []
    for at, hits, n in sorted(bins):
        blocks.append([at * n, hits, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each document, computed once and kept."""
    return stored(docs.select("doc_id", statistics("text").alias("x")), "quality-statistics")


def fit(described: DataFrame, labels: DataFrame, size: int = 384, width: float = 4.0, ridge: float = 1e-3, seed: int = 7,
        fit_rows: int = FIT_ROWS) -> QualityModel:
    """Learn from ``labels`` (doc_id, quality) of the ``described`` documents that are not held out.

    Means and deviations cover all documents. At most about ``fit_rows`` labelled rows enter the fit.
    """
    rng = np.random.default_rng(seed)
    marks = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").cast("double").alias("y"))
    dims = range(len(STATISTICS))
    moments = described.agg(*[f(F.col("x")[i]).alias(f"{name}{i}") for i in dims for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in dims])
    std = np.array([moments[f"s{i}"] or 0.0 for i in dims])
    std[std < 1e-9] = 1.0
    model = QualityModel(mean, std, None, (np.array([0.0]), np.array([0.5])), 0.5,
                         rng.normal(0, 1 / width, (len(STATISTICS), size)), rng.uniform(0, 2 * math.pi, size))
    known = stored(described.join(marks, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).alias("h")), "quality-labelled")
    count, positive = known.agg(F.count("*"), F.sum("y")).first()
    if not count or positive in (0.0, float(count)):
        model.base = positive / count if count else 0.5
        return model
    sample = known.filter(F.col("h") < min(1_000_000, math.ceil(1_000_000 * fit_rows / count)))
    learn, calibrate = sample.filter("h % 5 <> 0"), sample.filter("h % 5 = 0")
    blocks = learn.mapInArrow(_normal_rows(model), "i int, v array<double>")
    rows = blocks.repartition(min(64, partitions(described.sparkSession)), "i").mapInArrow(_add_rows, "i int, v array<double>").collect()
    if not rows:
        model.base = positive / count
        return model
    system = np.array([r.v for r in sorted(rows, key=lambda r: r.i)])
    gram, target = system[:, :-1], system[:, -1]
    model.weights = np.linalg.solve(gram + np.eye(len(gram)) * (ridge * np.trace(gram) / len(gram)), target)

    @F.pandas_udf(T.DoubleType())
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series(model.raw(np.array(x.tolist(), float).reshape(len(x), -1)))
    bins = (calibrate.select(raw("x").alias("raw"), "y").withColumn("bin", F.floor(F.least(F.greatest(F.col("raw"), F.lit(-0.5)), F.lit(1.5)) * (BINS / 2)))
            .groupBy("bin").agg(F.avg("raw"), F.sum("y"), F.count("*")).collect())
    model.knots = _pooled([tuple(b)[1:] for b in bins]) if bins else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def scores(described: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every described document."""
    scored = described.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The documents that the classifier keeps, unchanged."""
    return docs.filter(model.score(statistics(docs["text"])) >= 0.5)
