"""Model quality from labelled predictions: matrices, reports, AUC, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtide.operators.skew import Slices
from flowtide.schemas import ATTACK_CATEGORIES, FEATURE_CATEGORIES


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient with 0 for an empty denominator."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def binary_matrix(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """tn, fp, fn, tp with every class but 0 collapsed to attack."""
    a, p = F.col(actual) != 0, F.col(predicted) != 0
    return df.agg(F.count_if(~a & ~p).alias("tn"), F.count_if(~a & p).alias("fp"),
                  F.count_if(a & ~p).alias("fn"), F.count_if(a & p).alias("tp"))


def binary_metrics(matrix: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    under = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return matrix.withColumns({
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": precision, "recall": recall,
        "f1": _ratio(tp * 2, tp * 2 + fp + fn), "fpr": _ratio(fp, tn + fp), "fnr": _ratio(fn, tp + fn),
        "mcc": _ratio(tp * tn - fp * fn, under)})


def roc_auc(df: DataFrame, score: str, actual: str = "actual", slices: int | None = None) -> DataFrame:
    """Exact area under the ROC curve; null when only one class occurs.

    Equal scores are first counted together. The distinct scores are range-sliced, so the
    running count of negatives needs no single ordered partition. A tie counts one half.
    """
    attack = F.col(actual) != 0
    counts = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(attack).alias("pos"), F.count_if(~attack).alias("neg"))
    cumulative = Slices(counts, [], ["score"], "auc", slices).running_sum("neg", "neg_upto")
    wins = (F.col("pos").cast("double")
            * (F.col("neg_upto") - F.col("neg") + F.col("neg") / F.lit(2.0)))
    return (cumulative.agg(F.sum(wins).alias("_w"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
            .select(F.try_divide(F.col("_w"), F.col("_p").cast("double") * F.col("_n")).alias("roc_auc")))


def confusion(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
              classes: Sequence | None = None) -> DataFrame:
    """Long confusion matrix (actual, predicted, n); with ``classes`` empty cells appear as 0."""
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    if classes is None:
        return counts
    spark = df.sparkSession
    kind = df.schema[actual].dataType
    names = F.array(*[F.lit(c).cast(kind) for c in classes])
    grid = (spark.range(1).select(F.explode(names).alias("actual"))
            .select("actual", F.explode(names).alias("predicted")))
    return (grid.join(counts, ["actual", "predicted"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0))))


def pivot_confusion(long: DataFrame, classes: Sequence) -> DataFrame:
    """One row per actual class, one column per predicted class."""
    return long.groupBy("actual").pivot("predicted", list(classes)).agg(F.sum("n")).na.fill(0)


def class_report(long: DataFrame) -> DataFrame:
    """precision, recall, f1 and support per class, from a long confusion matrix. Works on at
    most classes-squared rows, whatever the size of the predictions."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    by_actual = long.groupBy(F.col("actual").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    by_predicted = long.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("claimed"))
    both = by_actual.join(by_predicted, "class", "full_outer").na.fill(0)
    precision = _ratio(F.col("hits"), F.col("claimed"))
    recall = _ratio(F.col("hits"), F.col("support"))
    f1 = _ratio(F.col("hits") * 2, F.col("claimed") + F.col("support"))
    return both.select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
                       F.col("support").cast("long").alias("support"))


def report_averages(report: DataFrame) -> DataFrame:
    """Macro and weighted averages of a class report, one row each."""
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    row = report.agg(
        *[F.avg(n).alias(f"m_{n}") for n in names],
        *[_ratio(F.sum(F.col(n) * F.col("support")), total).alias(f"w_{n}") for n in names],
        total.alias("support"))
    kinds = F.array(
        F.struct(F.lit("macro avg").alias("average"), *[F.col(f"m_{n}").alias(n) for n in names]),
        F.struct(F.lit("weighted avg").alias("average"), *[F.col(f"w_{n}").alias(n) for n in names]))
    return row.select(F.explode(kinds).alias("k"), "support").select("k.*", "support")


def overall(long: DataFrame) -> DataFrame:
    """Accuracy and multiclass Matthews correlation from a long confusion matrix."""
    n = F.col("n").cast("double")
    hit = F.when(F.col("actual") == F.col("predicted"), n).otherwise(0.0)
    both = F.explode(F.array(
        F.struct(F.col("actual").alias("class"), n.alias("t"), F.lit(0.0).alias("p"), hit.alias("c")),
        F.struct(F.col("predicted").alias("class"), F.lit(0.0).alias("t"), n.alias("p"),
                 F.lit(0.0).alias("c"))))
    marginals = long.select(both.alias("e")).groupBy("e.class").agg(
        F.sum("e.t").alias("t"), F.sum("e.p").alias("p"), F.sum("e.c").alias("c"))
    sums = marginals.agg(F.sum("c").alias("c"), F.sum("t").alias("s"),
                         F.sum(F.col("p") * F.col("t")).alias("pt"),
                         F.sum(F.col("p") * F.col("p")).alias("pp"),
                         F.sum(F.col("t") * F.col("t")).alias("tt"))
    c, s = F.col("c"), F.col("s")
    under = F.sqrt(s * s - F.col("pp")) * F.sqrt(s * s - F.col("tt"))
    return sums.select(_ratio(c, s).alias("accuracy"), _ratio(c * s - F.col("pt"), under).alias("mcc"))


def detection_rates(report: DataFrame, benign="BENIGN") -> DataFrame:
    """Benign recall, mean recall over attack classes, and the two error rates."""
    is_benign = F.col("class") == benign
    rates = report.agg(
        F.coalesce(F.max(F.when(is_benign, F.col("recall"))), F.lit(0.0)).alias("benign_detection_rate"),
        F.coalesce(F.avg(F.when(~is_benign, F.col("recall"))), F.lit(0.0)).alias("attack_detection_rate"))
    return rates.withColumns({"false_positive_rate": 1.0 - F.col("benign_detection_rate"),
                              "false_negative_rate": 1.0 - F.col("attack_detection_rate")})


def quality(report: DataFrame) -> DataFrame:
    """Status per class and whether the class counts as weak or strong; weakest first."""
    r = F.col("recall")
    status = (F.when(r == 1.0, "PERFECT").when(r >= 0.9, "Good").when(r >= 0.5, "Weak")
              .otherwise("Poor"))
    return report.withColumns({"status": status, "weak": (r < 0.5) & (F.col("support") >= 2),
                               "strong": r >= 0.95}).orderBy("f1", "class")


def matrix_recall(long: DataFrame) -> DataFrame:
    """Correct and total per actual class; recall is null for an empty class."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    return (long.groupBy("actual").agg(F.sum(hit).alias("correct"), F.sum("n").alias("total"))
            .withColumn("recall", F.try_divide(F.col("correct").cast("double"), F.col("total"))))


def category_rollup(reports: DataFrame, categories: dict[str, Sequence[str]] | None = None,
                    totals: bool = False) -> DataFrame:
    """Average F1 and recall per attack category and model (``reports`` carries ``model``)."""
    pairs = [(cls, cat) for cat, names in (categories or ATTACK_CATEGORIES).items() for cls in names]
    mapping = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    tagged = reports.withColumn("category", mapping[F.col("class")]).filter("category IS NOT NULL")
    grouped = (tagged.rollup if totals else tagged.groupBy)("category", "model")
    return grouped.agg(F.avg("f1").alias("avg_f1"), F.avg("recall").alias("avg_recall"),
                       F.count(F.lit(1)).alias("classes"))


def compare_classes(a: DataFrame, b: DataFrame, tie: float = 0.001) -> DataFrame:
    """Classes both reports know: difference in F1 and the winner (``a``, ``b`` or ``tie``)."""
    left = a.select("class", F.col("f1").alias("f1_a"))
    right = b.select("class", F.col("f1").alias("f1_b"))
    delta = F.col("f1_a") - F.col("f1_b")
    winner = F.when(F.abs(delta) < tie, "tie").when(delta > 0, "a").otherwise("b")
    return left.join(right, "class").withColumns({"delta": delta, "winner": winner})


def winner_lists(comparison: DataFrame) -> DataFrame:
    """Class names won by each side. One row per class, so the lists stay short."""
    return comparison.groupBy("winner").agg(
        F.array_sort(F.collect_list(F.col("class").cast("string"))).alias("classes"))


def compare_metrics(a: DataFrame, b: DataFrame, metrics: Sequence[str], name_a: str, name_b: str,
                    lower_is_better: Sequence[str] = ("false_negative_rate", "false_positive_rate")
                    ) -> DataFrame:
    """Winner per metric of two one-row profiles. Error rates are won by the smaller value."""
    def tall(df: DataFrame, out: str) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(out))
                            for m in metrics])
        return df.select(F.explode(entries).alias("e")).select("e.*")

    diff = F.col("a") - F.col("b")
    signed = F.when(F.col("metric").isin(*lower_is_better), -diff).otherwise(diff)
    winner = F.when(signed > 0, name_a).when(signed < 0, name_b).otherwise("Tied")
    return tall(a, "a").join(tall(b, "b"), "metric").withColumn("winner", winner)


def profile(long: DataFrame, benign="BENIGN") -> DataFrame:
    """One row: accuracy, mcc, weighted and macro F1, detection rates, sample count."""
    report = class_report(long)
    wide = report_averages(report).groupBy().pivot("average", ["macro avg", "weighted avg"]).agg(
        F.first("f1"))
    return (overall(long)
            .withColumn("f1_macro", wide.select(F.col("`macro avg`")).scalar())
            .withColumn("f1_weighted", wide.select(F.col("`weighted avg`")).scalar())
            .withColumn("_r", detection_rates(report, benign).select(F.struct("*")).scalar())
            .withColumn("samples", long.agg(F.sum("n")).scalar())
            .select("accuracy", "mcc", "f1_macro", "f1_weighted", "_r.*", "samples"))


def support(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class and the imbalance ratio of the largest to the smallest class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    ratio = counts.agg(F.max("n").cast("double") / F.min("n")).scalar()
    return counts.withColumn("imbalance", ratio).orderBy(F.desc("n"), label)


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, is_constant): at most one distinct non-null value, from min and max alone."""
    from flowtide.schemas import col
    edges = df.agg(*[F.struct(F.min(col(c)).cast("string").alias("lo"),
                              F.max(col(c)).cast("string").alias("hi")).alias(f"e{i}")
                     for i, c in enumerate(columns)])
    entries = F.array(*[F.struct(F.lit(c).alias("column"),
                                 (F.col(f"e{i}.lo").eqNullSafe(F.col(f"e{i}.hi"))).alias("is_constant"))
                        for i, c in enumerate(columns)])
    return edges.select(F.explode(entries).alias("e")).select("e.*")


def feature_categories(features: DataFrame, column: str = "feature") -> DataFrame:
    """Features per category by case-insensitive name fragment, with the first three names."""
    arrays = F.array(*[F.struct(F.lit(cat).alias("category"),
                                F.array(*[F.lit(k.lower()) for k in keys]).alias("keys"))
                       for cat, keys in FEATURE_CATEGORIES.items()])
    tagged = features.select(F.col(column).alias("feature"), F.explode(arrays).alias("c")).filter(
        F.exists("c.keys", lambda k: F.lower("feature").contains(k)))
    named = tagged.select("c.category", "feature").distinct()
    rank = F.row_number().over(Window.partitionBy("category").orderBy("feature"))
    first = (named.withColumn("_r", rank).filter("_r <= 3").groupBy("category")
             .agg(F.array_sort(F.collect_list("feature")).alias("examples")))
    return named.groupBy("category").agg(F.count(F.lit(1)).alias("n")).join(first, "category")


def exact_split(df: DataFrame, label: str, identity: Sequence[str], share: float = 0.2,
                seed: int = 42, buckets: int = 1 << 16) -> DataFrame:
    """Add ``is_test``: exactly round(share * n) rows of every class, chosen by a seeded hash.

    Rows stand in the order of (bucket, hash). Counts per class and bucket, combined map-side, name the bucket that
    holds each class's cut; only the hashes of that bucket are shuffled, to find the hash at the cut. Every row is
    then decided where it is, by a broadcast of one row per class. Rows that share the hash at the cut, which are
    repeats of one identity, are ranked among themselves if only some of them are wanted.
    """
    from flowtide.operators.skew import is_bounded, null_safe_join
    from flowtide.session import durable
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *identity)).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)))
    sizes = hashed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    by_class = Window.partitionBy(label)
    upto = F.sum("_n").over(by_class.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    quota = F.floor(F.sum("_n").over(by_class) * share + 0.5)
    cuts = (sizes.withColumns({"_upto": upto, "_quota": quota})
            .filter((F.col("_quota") <= F.col("_upto")) & (F.col("_quota") > F.col("_upto") - F.col("_n")))
            .select(label, F.col("_b").alias("_cut"), (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_rest")))
    cuts = durable(cuts, "split-cuts")

    def met(rows: DataFrame, classes: DataFrame) -> DataFrame:
        return null_safe_join(rows, F.broadcast(classes) if is_bounded(classes) else classes, [label])

    edge = met(hashed.select(label, "_h", "_b"), cuts).filter(F.col("_b") == F.col("_cut")).groupBy(label, "_h", "_rest").agg(
        F.count(F.lit(1)).alias("_n"))
    reached = F.sum("_n").over(Window.partitionBy(label).orderBy("_h").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at_cut = (edge.withColumn("_upto", reached).filter((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_n") < F.col("_rest")))
              .select(label, F.col("_h").alias("_last"), (F.col("_rest") - F.col("_upto") + F.col("_n")).alias("_take"), F.col("_n").alias("_of")))
    cuts = durable(null_safe_join(cuts, at_cut, [label]), "split-cuts")
    tagged = met(hashed, cuts)
    at = F.coalesce((F.col("_b") == F.col("_cut")) & (F.col("_h") == F.col("_last")), F.lit(False))
    below = F.coalesce((F.col("_b") < F.col("_cut")) | ((F.col("_b") == F.col("_cut")) & (F.col("_h") < F.col("_last"))), F.lit(False))
    extra = ["_h", "_b", "_cut", "_rest", "_last", "_take", "_of"]
    if not cuts.filter("_take < _of").limit(1).count():
        return tagged.withColumn("is_test", below | at).drop(*extra)
    some = at & (F.col("_take") < F.col("_of"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*identity))
    ranked = tagged.filter(some).withColumn("is_test", rank <= F.col("_take"))
    return tagged.filter(~some).withColumn("is_test", below | at).unionByName(ranked).drop(*extra)
