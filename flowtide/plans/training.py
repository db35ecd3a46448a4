"""Training and comparison of classifiers on labelled flows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from flowtide.operators import align, evaluate, macro
from flowtide.operators.skew import Slices
from flowtide.plans import boosting
from flowtide.plans.boosting import BoostedTrees
from flowtide.plans.models import FlowModel, ml_scorer
from flowtide.schemas import col
from flowtide.session import durable
from flowtide.sources.readers import evaluation_payload, read_sidecar, write_json, write_sidecar

LABEL, BOOSTED = "Label", "boosted"
# Spark trees stop at this depth; the reference forests grow without a limit.
MAX_TREE_DEPTH = 30
SHALLOW = 8


@dataclass
class Cleaned:
    rows: DataFrame
    features: list[str]
    constant: list[str]


def clean(df: DataFrame, label: str = LABEL) -> Cleaned:
    """Drop rows with null or non-finite cells, constant columns and full-row duplicates."""
    usable = align.drop_unusable(df)
    features = [c for c in df.columns if c != label]
    flags = evaluate.constant_columns(usable, features).filter("is_constant").collect()
    constant = {r["column"] for r in flags}
    kept = [f for f in features if f not in constant]
    rows = usable.select(*[col(f) for f in kept], col(label)).dropDuplicates()
    return Cleaned(rows, kept, sorted(constant))


def label_classes(df: DataFrame, label: str = LABEL) -> list[str]:
    """Class vocabulary in sorted order, which puts BENIGN first."""
    return [r[0] for r in df.select(col(label)).distinct().orderBy(label).collect()]


def encode(df: DataFrame, classes: Sequence[str], label: str = LABEL, out: str = "y") -> DataFrame:
    names = F.array(*[F.lit(c) for c in classes])
    return df.withColumn(out, (F.array_position(names, col(label)) - 1).cast("double"))


def fit_scaler(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature; a constant feature scales by 1."""
    row = df.agg(*[F.struct(F.avg(col(f)).alias("m"), F.stddev_pop(col(f)).alias("s")).alias(f"c{i}")
                   for i, f in enumerate(features)]).first()
    return {f: (row[i]["m"] or 0.0, row[i]["s"] or 1.0) for i, f in enumerate(features)}


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f: (col(f) - F.lit(m)) / F.lit(s) for f, (m, s) in scaler.items()})


def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """(y, weight) with weight = n / (classes * n_class)."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    both = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return counts.select(y, (both["n"] / (both["k"] * F.col("n"))).alias("weight"))


def weighted(df: DataFrame, y: str = "y") -> DataFrame:
    """Attach class weights through a literal map: there are only as many as classes."""
    pairs = [F.lit(float(x)) for r in class_weights(df, y).collect() for x in (r[y], r["weight"])]
    return df.withColumn("weight", F.create_map(*pairs)[F.col(y)])


def _assembler(features: Sequence[str]) -> VectorAssembler:
    # Positional aliases keep names with dots and slashes away from the assembler.
    return VectorAssembler(inputCols=[f"x{i}" for i in range(len(features))], outputCol="features")


def positional(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Training columns only: inputs x0.., the target and its weight when there is one."""
    extra = [c for c in ("y", "weight") if c in df.columns]
    return df.select(*[col(f).alias(f"x{i}") for i, f in enumerate(features)], *extra)


def spread(df: DataFrame) -> DataFrame:
    """At least a partition per core, for rows that are read tens of times."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def train_forest(df: DataFrame, features: Sequence[str], trees: int = 150, depth: int = MAX_TREE_DEPTH,
                 seed: int = 42, balanced: bool = True) -> PipelineModel:
    # Each level is a pass over the rows: deep trees keep every row's node instead of walking down to it again. The trees are the same.
    forest = RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=depth > SHALLOW,
                                    **({"weightCol": "weight"} if balanced else {}))
    data = positional(weighted(df) if balanced else df, features)
    return Pipeline(stages=[_assembler(features), forest]).fit(data)


def train_boosted(df: DataFrame, features: Sequence[str], rounds: int = 150, depth: int = 6,
                  rate: float = 0.1, seed: int = 42, subsample: float = 1.0, classes: int | None = None) -> BoostedTrees:
    """Boosted trees under one softmax over all classes."""
    plain = positional(df, features)
    if classes is None:
        classes = int(plain.agg(F.max("y")).first()[0]) + 1
    return boosting.train(plain, [f"x{i}" for i in range(len(features))], classes, rounds, depth, rate, seed, subsample)


def as_flow_model(name: str, fitted: PipelineModel | BoostedTrees, features: Sequence[str], classes: Sequence[str],
                  scaler: dict[str, tuple[float, float]] | None = None, model_id: int = 0,
                  threshold: float = 0.5) -> FlowModel:
    """Wrap a fitted pipeline so raw aligned features can be scored: scaling happens inside."""
    run = fitted.score if isinstance(fitted, BoostedTrees) else ml_scorer(fitted)

    def score(df: DataFrame) -> DataFrame:
        inputs = []
        for i, f in enumerate(features):
            m, s = scaler[f] if scaler else (0.0, 1.0)
            inputs.append(((col(f) - F.lit(m)) / F.lit(s) if scaler else col(f)).alias(f"x{i}"))
        # Learners stumble over dots in names, so the row travels under plain ones.
        names = df.columns
        plain = df.select(*[col(c).alias(f"k{i}") for i, c in enumerate(names)], *inputs)
        return run(plain).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "probability")

    return FlowModel(name, list(features), list(classes), score, model_id, threshold,
                     {"fitted": fitted, "scaler": scaler or {}})


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    features: list[str]
    classes: list[str]
    scaler: dict[str, tuple[float, float]]


def prepare(df: DataFrame, label: str = LABEL, test_share: float = 0.2, seed: int = 42) -> Prepared:
    """Clean, encode, split by class and fit the scaler on the training part.

    The split rows are stored once: every learner and the evaluation read them again.
    """
    cleaned = clean(df, label)
    # Cleaning drops repeated rows, which shuffles; the vocabulary and the split read the result.
    rows = durable(cleaned.rows, "cleaned")
    classes = label_classes(rows, label)
    identity = [f"`{f}`" for f in cleaned.features]
    split = durable(evaluate.exact_split(encode(rows, classes, label), "y", identity, test_share, seed), "split")
    train, test = split.filter("is_test = false"), split.filter("is_test")
    return Prepared(train, test, cleaned.features, classes, fit_scaler(train, cleaned.features))


def predictions(model: FlowModel, test: DataFrame) -> DataFrame:
    """(actual, predicted) class names by the strongest probability."""
    names = F.array(*[F.lit(c) for c in model.classes])
    best = F.array_position(F.col("probability"), F.array_max("probability")) - 1
    return model.score(test).select(F.get(names, F.col("y").cast("int")).alias("actual"),
                                    F.get(names, best.cast("int")).alias("predicted"))


def _matrices(models: dict[str, FlowModel], test: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Long confusion matrices tagged by model. They are stored: each model scores the rows once, however many reports are read."""
    matrices = None
    for key, model in models.items():
        long = evaluate.confusion(predictions(model, test), classes=classes).withColumn("model", F.lit(key))
        matrices = long if matrices is None else matrices.unionByName(long)
    return durable(matrices.coalesce(1), "matrices")


def train_and_compare(df: DataFrame, out: str | None = None, trees: int = 150, rounds: int = 150,
                      forest_depth: int = MAX_TREE_DEPTH, boost_depth: int = 6, label: str = LABEL,
                      seed: int = 42) -> tuple[Prepared, dict[str, FlowModel], DataFrame]:
    """Fit a forest and boosted trees, evaluate both on the held-out part.

    Returns the prepared data, the models and long confusion matrices tagged by model. With
    ``out`` the models, their sidecars and the metrics document are stored there.
    """
    p = prepare(df, label, seed=seed)
    scaled = scale(p.train, p.scaler)
    fitted = {"random_forest": train_forest(spread(scaled), p.features, trees, forest_depth, seed),
              "boosted": train_boosted(scaled, p.features, rounds, boost_depth, seed=seed)}
    models = {k: as_flow_model(k, m, p.features, p.classes, p.scaler) for k, m in fitted.items()}
    matrices = _matrices(models, p.test, p.classes)
    if out:
        spark, payload = df.sparkSession, {"classes": p.classes}
        for key, model in models.items():
            save_model(spark, model, f"{out}/{key}", key)
            payload[key] = evaluation_payload(matrices.filter(F.col("model") == key), p.classes)
        write_json(spark, payload, f"{out}/evaluation")
    return p, models, matrices


def save_model(spark, model: FlowModel, path: str, model_type: str, version: str = "1.0") -> None:
    fitted = model.extra["fitted"]
    if isinstance(fitted, BoostedTrees):
        fitted.save(spark, f"{path}/model")
        model_type = BOOSTED
    else:
        fitted.write().overwrite().save(f"{path}/model")
    write_sidecar(spark, f"{path}/sidecar", model.features, model_type, version, model.classes,
                  {f: list(v) for f, v in model.extra["scaler"].items()})


def load_model(spark, path: str, name: str, model_id: int = 0, threshold: float = 0.5) -> FlowModel:
    meta = read_sidecar(spark, f"{path}/sidecar")
    scaler = {f: tuple(v) for f, v in (meta.get("scaler") or {}).items()}
    boosted = meta.get("model_type") == BOOSTED
    fitted = BoostedTrees.load(spark, f"{path}/model") if boosted else PipelineModel.load(f"{path}/model")
    return as_flow_model(name, fitted, meta["feature_names"], meta["classes"], scaler or None, model_id, threshold)


def evaluate_registered(model: FlowModel, labelled: DataFrame, label: str = LABEL,
                        auc_score: str = "attack") -> DataFrame:
    """Binary quality of a model on a labelled set (label 0 is benign): one row of metrics.

    ``auc_score`` is ``attack`` for P(attack) or ``confidence`` for the largest probability.
    """
    from flowtide.operators.decide import add_verdict
    if label not in labelled.columns:
        raise ValueError(f"label column {label} is missing")
    keyed = labelled.withColumn("_actual", align.safe_int(col(label))).drop(label)
    aligned = align.align(keyed, model.features, ["_actual"], report="frame")
    scored = add_verdict(model.score(aligned), model.classes, threshold=model.threshold)
    score = F.col("confidence") if auc_score == "confidence" else 1.0 - F.col("probability")[0]
    judged = durable(scored.select(F.col("_actual").alias("actual"), F.col("prediction").alias("predicted"),
                                   score.alias("score")), "judged")
    metrics = evaluate.binary_metrics(evaluate.binary_matrix(judged))
    return metrics.withColumn("roc_auc", evaluate.roc_auc(judged, "score").scalar()).withColumns(
        {"model_name": F.lit(model.name), "features_count": F.lit(len(model.features))})


# --- macro training windows ------------------------------------------------------------------

# --- Fixed values: (cumulative share, smallest, largest) window sizes; None is the class maximum. ---
BENIGN_SIZES = ((0.85, 1, 1), (0.95, 2, 4), (1.0, 5, 12))
ATTACK_SIZES = ((0.15, 1, 1), (0.40, 2, 5), (0.75, 6, 30), (1.0, 31, None))
FIRST_SIZES = ((0.40, 1, 1), (0.70, 2, 5), (0.90, 6, 30), (1.0, 31, None))
LARGEST_WINDOW = {"SYN Flood": 200}
DEFAULT_LARGEST = 60


def _uniform(*parts) -> F.Column:
    """Reproducible value in [0, 1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _size(sizes, largest: F.Column, seed: int, *parts) -> F.Column:
    u, v = _uniform(F.lit(seed), F.lit("mix"), *parts), _uniform(F.lit(seed), F.lit("size"), *parts)
    out = None
    for share, low, high in reversed(sizes):
        top = largest if high is None else F.lit(high)
        drawn = (F.lit(low) + F.floor(v * (top - low + 1))).cast("int")
        out = drawn if out is None else F.when(u < share, drawn).otherwise(out)
    return out


def macro_windows(pool: DataFrame, features: Sequence[str], identity: Sequence[str], label: str = LABEL,
                  per_class: int = 800, seed: int = 42, benign: str = "BENIGN",
                  attack_sizes=ATTACK_SIZES, benign_sizes=BENIGN_SIZES,
                  largest: dict[str, int] | None = None) -> DataFrame:
    """Macro training rows: per class, windows of member flows drawn without replacement inside a
    window and reduced like live macro-flows. Adds ``window`` and ``member_count``.

    Member j of a window of n comes from the j-th of n equal stretches of the numbered pool, at
    a hashed offset, so members differ and the draw is reproducible. Positions are uniform, so
    the join has no hot key.
    """
    numbered = Slices(pool, [label], list(identity), "macro-pool").numbered("_pos")
    numbered = durable(numbered, "macro-pool-numbered")
    sizes = numbered.groupBy(label).agg(F.max("_pos").alias("_n"))  # one row per class
    largest = {**LARGEST_WINDOW, **(largest or {})}
    limits = F.create_map(*[F.lit(x) for pair in largest.items() for x in pair])
    top = F.coalesce(limits[col(label)], F.lit(DEFAULT_LARGEST))
    windows = sizes.select(col(label), "_n", F.explode(F.sequence(F.lit(0), F.lit(per_class - 1))).alias("window"))
    drawn = F.when(col(label) == benign, _size(benign_sizes, top, seed, col(label), F.col("window"))).otherwise(
        _size(attack_sizes, top, seed, col(label), F.col("window")))
    windows = windows.withColumn("_size", F.least(drawn, F.col("_n")).cast("int"))
    members = windows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_size") - 1)))
    low = F.floor(F.col("_j") * F.col("_n") / F.col("_size"))
    high = F.floor((F.col("_j") + 1) * F.col("_n") / F.col("_size"))
    offset = F.floor(_uniform(F.lit(seed), F.lit("pos"), col(label), "window", "_j") * (high - low))
    picks = members.select(col(label), "window", (low + offset + 1).cast("long").alias("_pos"))
    joined = picks.join(numbered, [label, "_pos"])
    return macro.assemble(joined, [label, "window"], list(features), min_members=1)


def train_macro(windows: DataFrame, features: Sequence[str], trees: int = 300, rounds: int = 300,
                forest_depth: int = MAX_TREE_DEPTH, boost_depth: int = 7, label: str = LABEL,
                seed: int = 42) -> tuple[dict[str, FlowModel], DataFrame]:
    """Macro classifiers on sampled windows and their held-out confusion matrices."""
    classes = label_classes(windows, label)
    filled = windows.na.fill(0.0)
    split = durable(evaluate.exact_split(encode(filled, classes, label), "y", [f"`{label}`", "window"], 0.2, seed),
                    "macro-split")
    train, test = split.filter("is_test = false"), split.filter("is_test")
    scaler = fit_scaler(train, features)
    scaled = scale(train, scaler)
    fitted = {"macro_forest": train_forest(scaled, features, trees, forest_depth, seed),
              "macro_boosted": train_boosted(scaled, features, rounds, boost_depth, seed=seed, subsample=0.9)}
    models = {k: as_flow_model(k, m, features, classes, scaler) for k, m in fitted.items()}
    return models, _matrices(models, test, classes)
