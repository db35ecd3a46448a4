"""Models as scorers: anything that adds a probability array to aligned features."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from flowtide.schemas import col

Scorer = Callable[[DataFrame], DataFrame]


@dataclass
class FlowModel:
    """A classifier: its ordered features, its classes (benign first) and how it scores."""

    name: str
    features: Sequence[str]
    classes: Sequence[str]
    scorer: Scorer
    model_id: int = 0
    threshold: float = 0.5
    extra: dict = field(default_factory=dict)

    def score(self, aligned: DataFrame) -> DataFrame:
        """Add ``probability`` (array of double)."""
        return self.scorer(aligned)


def ml_scorer(model: PipelineModel, probability: str = "probability",
              raw: str | None = None) -> Scorer:
    """Score with a fitted Spark ML pipeline. One-versus-rest models give margins only; those are
    turned into shares that add up to one."""
    def score(df: DataFrame) -> DataFrame:
        before = df.columns
        out = model.transform(df)
        if probability in out.columns:
            p = vector_to_array(F.col(probability))
        else:
            margins = vector_to_array(F.col(raw or "rawPrediction"))
            odds = F.transform(margins, lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(m * -2.0)))
            total = F.aggregate(odds, F.lit(0.0), lambda acc, x: acc + x)
            p = F.transform(odds, lambda x: x / total)
        return out.select(*[col(c) for c in before], p.alias("probability"))

    return score


def pandas_scorer(features: Sequence[str], predict: Callable[[pd.DataFrame], "object"]) -> Scorer:
    """Score with a foreign model. ``predict`` maps a frame of features to a matrix of
    probabilities; Arrow batches keep Python off the per-row path."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            batch.columns = list(features)
            yield pd.Series(list(map(list, predict(batch))))

    def score(df: DataFrame) -> DataFrame:
        return df.withColumn("probability", run(F.struct(*[col(f) for f in features])))

    return score


def rule_scorer(expression: str) -> Scorer:
    """Score with a SQL expression giving an array of probabilities."""
    return lambda df: df.withColumn("probability", F.expr(expression))
