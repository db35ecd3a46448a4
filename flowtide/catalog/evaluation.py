"""Model quality queries over labelled predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide import driver_tables as dt
from flowtide.catalog._shared import rounded
from flowtide.catalog.ansi import sql
from flowtide.operators import decide, evaluate
from flowtide.schemas import ATTACK_CATEGORIES, FLOW_CLASSES

TEN = list(range(10))


def _long(spark, sf, pred="pred_a", classes=None):
    return evaluate.confusion(dt.labelled(spark, sf), "actual", pred, classes)


def _moderation(spark, sf):
    """labels: quality plays the truth, toxic the verdict, hashed text length the score."""
    lab = dt.table(spark, sf, "labels").join(
        dt.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return lab.select(F.col("quality").alias("actual"), F.col("toxic").alias("predicted"),
                      (F.col("n_chars") % 100).alias("score"))


def binary(spark, sf):
    out = evaluate.binary_metrics(evaluate.binary_matrix(_moderation(spark, sf)))
    return out.select("tn", "fp", "fn", "tp", *[rounded(F.col(c), 6).alias(c) for c in (
        "accuracy", "precision", "recall", "f1", "fpr", "fnr", "mcc")])


def auc(spark, sf):
    return evaluate.roc_auc(_moderation(spark, sf), "score").select(
        rounded(F.col("roc_auc"), 6).alias("roc_auc"))


def auc_probability(spark, sf):
    """P(attack) as score, and the largest probability as the alternative."""
    scored = dt.labelled(spark, sf).select(
        "actual", (1.0 - F.col("probability")[0]).alias("p_attack"),
        decide.confidence_of(F.col("probability")).alias("p_max"))
    a = evaluate.roc_auc(scored, "p_attack").select(F.lit("p_attack").alias("score"), "roc_auc")
    b = evaluate.roc_auc(scored, "p_max").select(F.lit("p_max"), "roc_auc")
    return a.union(b).withColumn("roc_auc", rounded(F.col("roc_auc"), 6))


def confusion(spark, sf):
    return _long(spark, sf, classes=TEN)


def confusion_wide(spark, sf):
    wide = evaluate.pivot_confusion(_long(spark, sf, classes=TEN), TEN)
    return wide.toDF("actual", *[f"p{i}" for i in TEN])


def report(spark, sf):
    r = evaluate.class_report(_long(spark, sf))
    return r.select("class", *[rounded(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def averages(spark, sf):
    a = evaluate.report_averages(evaluate.class_report(_long(spark, sf)))
    return a.select("average", *[rounded(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def overall(spark, sf):
    o = evaluate.overall(_long(spark, sf))
    return o.select(rounded(F.col("accuracy"), 6).alias("accuracy"), rounded(F.col("mcc"), 6).alias("mcc"))


def rates(spark, sf):
    r = evaluate.detection_rates(evaluate.class_report(_long(spark, sf, "pred_b")), benign=0)
    return r.select(*[rounded(F.col(c), 6).alias(c) for c in r.columns])


def quality(spark, sf):
    q = evaluate.quality(evaluate.class_report(_long(spark, sf, "pred_b")))
    return q.select("class", "status", "weak", "strong", "support")


def matrix_recall(spark, sf):
    out = evaluate.matrix_recall(_long(spark, sf, classes=[*TEN, 10]))
    return out.withColumn("recall", rounded(F.col("recall"), 6))


def comparison(spark, sf):
    out = evaluate.compare_classes(evaluate.class_report(_long(spark, sf)),
                                   evaluate.class_report(_long(spark, sf, "pred_b")))
    return out.select("class", *[rounded(F.col(c), 6).alias(c) for c in ("f1_a", "f1_b", "delta")], "winner")


def class_wins(spark, sf):
    out = evaluate.winner_lists(evaluate.compare_classes(
        evaluate.class_report(_long(spark, sf)), evaluate.class_report(_long(spark, sf, "pred_b"))))
    return out.select("winner", F.array_join("classes", ",").alias("classes"))


def metric_winners(spark, sf):
    names = ["accuracy", "mcc", "f1_weighted", "attack_detection_rate", "false_negative_rate"]
    a, b = (evaluate.profile(_long(spark, sf, p), benign=0) for p in ("pred_a", "pred_b"))
    out = evaluate.compare_metrics(a, b, names, "model a", "model b")
    return out.select("metric", rounded(F.col("a"), 6).alias("a"), rounded(F.col("b"), 6).alias("b"), "winner")


def _named_reports(spark, sf):
    """Reports with class names; labels 0-9 take the first ten names of the label space."""
    names = F.array(*[F.lit(c) for c in FLOW_CLASSES])
    both = [evaluate.class_report(_long(spark, sf, p)).withColumn("model", F.lit(m))
            for p, m in (("pred_a", "a"), ("pred_b", "b"))]
    return both[0].union(both[1]).withColumn("class", F.get(names, F.col("class")))


def categories(spark, sf):
    out = evaluate.category_rollup(_named_reports(spark, sf), totals=True)
    return out.select("category", "model", rounded(F.col("avg_f1"), 6).alias("avg_f1"),
                      rounded(F.col("avg_recall"), 6).alias("avg_recall"), "classes")


def class_support(spark, sf):
    out = evaluate.support(dt.table(spark, sf, "embeddings"))
    return out.withColumn("imbalance", rounded(F.col("imbalance"), 6))


def constants(spark, sf):
    f = dt.flows(spark, sf).withColumn("fixed", F.lit(1.0))
    return evaluate.constant_columns(f, [*dt.FLOW_FEATURES, "fixed"])


def feature_groups(spark, sf):
    """Categories of the part names, which stand in for feature names."""
    parts = dt.table(spark, sf, "part").select(
        F.concat(F.element_at(F.array(F.lit("Fwd IAT "), F.lit("SYN Flag "), F.lit("Idle Max "), F.lit("Other ")),
                              (F.col("p_partkey") % 4 + 1).cast("int")), "p_name").alias("feature"))
    out = evaluate.feature_categories(parts)
    return out.select("category", "n", F.array_join("examples", "|").alias("examples"))


def split(spark, sf):
    e = dt.table(spark, sf, "embeddings").select("vec_id", "label")
    out = evaluate.exact_split(e, "label", ["vec_id"])
    return out.groupBy("label").agg(F.count_if("is_test").alias("test"), F.count(F.lit(1)).alias("total"))


_R = "round({} + 1e-7, 6)"


def _report_cte(pred: str, name: str) -> dict[str, str]:
    return {f"cm_{name}": f"SELECT actual, {pred} AS predicted, count(*) AS n FROM lab GROUP BY 1, 2",
            f"rep_{name}": f"""SELECT class, coalesce(hits / nullif(claimed, 0), 0) AS precision,
              coalesce(hits / nullif(support, 0), 0) AS recall,
              coalesce(2 * hits / nullif(claimed + support, 0), 0) AS f1, support
            FROM (SELECT coalesce(a.actual, p.predicted) AS class, coalesce(hits, 0) AS hits,
                coalesce(support, 0) AS support, coalesce(claimed, 0) AS claimed
              FROM (SELECT actual, CAST(sum(n) AS BIGINT) AS support,
                  CAST(coalesce(sum(n) FILTER (WHERE actual = predicted), 0) AS BIGINT) AS hits
                FROM cm_{name} GROUP BY actual) a
              FULL JOIN (SELECT predicted, CAST(sum(n) AS BIGINT) AS claimed FROM cm_{name} GROUP BY predicted) p
                ON a.actual = p.predicted)"""}


_A, _B = _report_cte("pred_a", "a"), _report_cte("pred_b", "b")
_COMPARE = """SELECT class, a.f1 AS f1_a, b.f1 AS f1_b, a.f1 - b.f1 AS delta,
  CASE WHEN abs(a.f1 - b.f1) < 0.001 THEN 'tie' WHEN a.f1 > b.f1 THEN 'a' ELSE 'b' END AS winner
  FROM rep_a a JOIN rep_b b USING (class)"""


def _overall_cte(name: str) -> str:
    return f"""SELECT c / s AS accuracy, coalesce((c * s - pt) / nullif(sqrt(s * s - pp) * sqrt(s * s - tt), 0), 0)
      AS mcc FROM (SELECT (SELECT sum(n) FROM cm_{name} WHERE actual = predicted)::DOUBLE AS c,
        (SELECT sum(n) FROM cm_{name})::DOUBLE AS s, sum(t * p)::DOUBLE AS pt, sum(p * p)::DOUBLE AS pp,
        sum(t * t)::DOUBLE AS tt
      FROM (SELECT coalesce(x.c, y.c) AS c, coalesce(t, 0) AS t, coalesce(p, 0) AS p
        FROM (SELECT actual AS c, sum(n) AS t FROM cm_{name} GROUP BY 1) x
        FULL JOIN (SELECT predicted AS c, sum(n) AS p FROM cm_{name} GROUP BY 1) y ON x.c = y.c))"""


def _profile_rows(name: str) -> str:
    return f"""SELECT 'accuracy' AS metric, accuracy AS v FROM ov_{name} UNION ALL SELECT 'mcc', mcc FROM ov_{name}
      UNION ALL SELECT 'f1_weighted', sum(f1 * support) / sum(support) FROM rep_{name}
      UNION ALL SELECT 'attack_detection_rate', avg(recall) FROM rep_{name} WHERE class <> 0
      UNION ALL SELECT 'false_negative_rate', 1 - avg(recall) FROM rep_{name} WHERE class <> 0"""


def _auc_sql(source: str, score: str) -> str:
    return f"""SELECT {_R.format('(sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos))')} AS roc_auc
      FROM (SELECT actual <> 0 AS pos, rank() OVER (ORDER BY {score})
        + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS r FROM {source})"""


_MOD = """SELECT quality AS actual, toxic AS predicted, n_chars % 100 AS score
  FROM labels JOIN documents USING (doc_id)"""
_CASES = " ".join(f"WHEN '{c}' THEN '{cat}'" for cat, names in ATTACK_CATEGORIES.items() for c in names)
_NAMES = ", ".join(f"'{c}'" for c in FLOW_CLASSES)

ENTRIES = {
    "binary_evaluation": (binary, sql("", f"""
        SELECT tn, fp, fn, tp, {_R.format('(tp + tn) / (tp + tn + fp + fn)')} AS accuracy,
          {_R.format('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision,
          {_R.format('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall,
          {_R.format('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1,
          {_R.format('coalesce(fp / nullif(tn + fp, 0), 0)')} AS fpr,
          {_R.format('coalesce(fn / nullif(tp + fn, 0), 0)')} AS fnr,
          {_R.format('coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)')} AS mcc
        FROM (SELECT count(*) FILTER (WHERE actual = 0 AND predicted = 0) AS tn,
          count(*) FILTER (WHERE actual = 0 AND predicted <> 0) AS fp,
          count(*) FILTER (WHERE actual <> 0 AND predicted = 0) AS fn,
          count(*) FILTER (WHERE actual <> 0 AND predicted <> 0) AS tp FROM m)""", m=_MOD)),
    "roc_auc": (auc, sql("", _auc_sql("m", "score"), m=_MOD)),
    "roc_auc_probability": (auc_probability, sql("lab", f"""
        SELECT 'p_attack' AS score, * FROM ({_auc_sql('(SELECT actual, 1 - probability[1] AS s FROM lab)', 's')})
        UNION ALL SELECT 'p_max', * FROM ({_auc_sql('(SELECT actual, list_max(probability) AS s FROM lab)', 's')})""")),
    "confusion_matrix": (confusion, sql("lab", """
        SELECT CAST(a.c AS INTEGER) AS actual, CAST(p.c AS INTEGER) AS predicted, count(vec_id) AS n
        FROM range(10) a(c) CROSS JOIN range(10) p(c) LEFT JOIN lab ON actual = a.c AND pred_a = p.c
        GROUP BY 1, 2""")),
    "confusion_matrix_wide": (confusion_wide, sql("lab", f"""
        SELECT actual, {', '.join(f'count(*) FILTER (WHERE pred_a = {i}) AS p{i}' for i in TEN)}
        FROM lab GROUP BY 1""")),
    "classification_report": (report, sql("lab", f"""
        SELECT class, {_R.format('precision')} AS precision, {_R.format('recall')} AS recall,
          {_R.format('f1')} AS f1, support FROM rep_a""", **_A)),
    "report_averages": (averages, sql("lab", f"""
        SELECT 'macro avg' AS average, {_R.format('avg(precision)')} AS precision,
          {_R.format('avg(recall)')} AS recall, {_R.format('avg(f1)')} AS f1,
          CAST(sum(support) AS BIGINT) AS support FROM rep_a
        UNION ALL SELECT 'weighted avg', {_R.format('sum(precision * support) / sum(support)')},
          {_R.format('sum(recall * support) / sum(support)')}, {_R.format('sum(f1 * support) / sum(support)')},
          CAST(sum(support) AS BIGINT) FROM rep_a""", **_A)),
    "accuracy_mcc": (overall, sql("lab", f"""
        SELECT {_R.format('accuracy')} AS accuracy, {_R.format('mcc')} AS mcc FROM ov_a""",
        **_A, ov_a=_overall_cte("a"))),
    "detection_rates": (rates, sql("lab", f"""
        SELECT {_R.format('b')} AS benign_detection_rate, {_R.format('a')} AS attack_detection_rate,
          {_R.format('1 - b')} AS false_positive_rate, {_R.format('1 - a')} AS false_negative_rate
        FROM (SELECT max(recall) FILTER (WHERE class = 0) AS b, avg(recall) FILTER (WHERE class <> 0) AS a
          FROM rep_b)""", **_B)),
    "class_quality": (quality, sql("lab", """
        SELECT class, CASE WHEN recall = 1 THEN 'PERFECT' WHEN recall >= 0.9 THEN 'Good'
            WHEN recall >= 0.5 THEN 'Weak' ELSE 'Poor' END AS status,
          recall < 0.5 AND support >= 2 AS weak, recall >= 0.95 AS strong, support FROM rep_b""", **_B)),
    "matrix_recall": (matrix_recall, sql("lab", f"""
        SELECT CAST(c AS INTEGER) AS actual, count(*) FILTER (WHERE actual = pred_a) AS correct,
          count(actual) AS total,
          {_R.format('count(*) FILTER (WHERE actual = pred_a) / nullif(count(actual), 0)')} AS recall
        FROM range(11) r(c) LEFT JOIN lab ON actual = c GROUP BY 1""")),
    "model_class_comparison": (comparison, sql("lab", f"""
        SELECT class, {_R.format('f1_a')} AS f1_a, {_R.format('f1_b')} AS f1_b, {_R.format('delta')} AS delta,
          winner FROM cmp""", **_A, **_B, cmp=_COMPARE)),
    "model_class_wins": (class_wins, sql("lab", """
        SELECT winner, string_agg(CAST(class AS VARCHAR), ',' ORDER BY class) AS classes FROM cmp GROUP BY 1""",
        **_A, **_B, cmp=_COMPARE)),
    "model_metric_winners": (metric_winners, sql("lab", f"""
        SELECT metric, {_R.format('a.v')} AS a, {_R.format('b.v')} AS b,
          CASE WHEN a.v = b.v THEN 'Tied' WHEN (a.v > b.v) = (metric <> 'false_negative_rate') THEN 'model a'
            ELSE 'model b' END AS winner FROM pa a JOIN pb b USING (metric)""",
        **_A, **_B, ov_a=_overall_cte("a"), ov_b=_overall_cte("b"), pa=_profile_rows("a"), pb=_profile_rows("b"))),
    "attack_categories": (categories, sql("lab", f"""
        SELECT category, model, {_R.format('avg(f1)')} AS avg_f1, {_R.format('avg(recall)')} AS avg_recall,
          count(*) AS classes FROM (SELECT model, f1, recall,
            CASE ([{_NAMES}])[class + 1] {_CASES} END AS category
          FROM (SELECT 'a' AS model, * FROM rep_a UNION ALL SELECT 'b', * FROM rep_b))
        WHERE category IS NOT NULL GROUP BY ROLLUP (category, model)""", **_A, **_B)),
    "class_support": (class_support, f"""
        SELECT label, n, {_R.format('(max(n) OVER ()) / (min(n) OVER ())')} AS imbalance
        FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)"""),
    "constant_columns": (constants, sql("flows", "\nUNION ALL ".join(
        f"SELECT '{n}' AS column, count(DISTINCT {c}) <= 1 AS is_constant FROM flows" for n, c in (
            ("Flow Duration", "dur"), ("Total Fwd Packets", "fwd"), ("Flow Bytes/s", "bps"),
            ("Fwd Packet Length Min", "plmin"), ("Fwd Packet Length Std", "plstd"), ("Flow IAT Max", "iatmax"),
            ("Flow IAT Mean", "iatmean"), ("SYN Flag Count", "syn"), ("Average Packet Size", "aps"),
            ("fixed", "1.0"))))),
    "feature_categories": (feature_groups, """
        WITH f AS (SELECT (['Fwd IAT ', 'SYN Flag ', 'Idle Max '])[CAST(p_partkey % 4 AS INTEGER) + 1] || p_name
            AS feature, (['Forward Packets', 'TCP Flags', 'Active/Idle'])[CAST(p_partkey % 4 AS INTEGER) + 1]
            AS category FROM part WHERE p_partkey % 4 < 3)
        SELECT category, count(DISTINCT feature) AS n, (SELECT string_agg(feature, '|' ORDER BY feature) FROM (
            SELECT DISTINCT feature FROM f g WHERE g.category = f.category ORDER BY feature LIMIT 3)) AS examples
        FROM f GROUP BY category"""),
    "stratified_split": (split, """
        SELECT label, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS test, count(*) AS total
        FROM embeddings GROUP BY label"""),
}
