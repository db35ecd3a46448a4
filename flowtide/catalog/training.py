"""Training queries. The comparison trains whole models; the other learners run with few, shallow trees, sizes are parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide import driver_tables as dt
from flowtide.catalog._shared import rounded
from flowtide.catalog.ansi import sql
from flowtide.operators import evaluate
from flowtide.plans import training
from flowtide.schemas import col
from flowtide.session import scratch_path

FEATURES = ["Flow Duration", "Total Fwd Packets", "Flow Bytes/s", "Fwd Packet Length Std", "Flow IAT Max",
            "SYN Flag Count", "Average Packet Size"]


def _labelled(spark, sf):
    """Flows labelled by port, with a rule tying the label to the features."""
    f = dt.flows(spark, sf)
    label = (F.when(col("Flow Duration") > 40, "DDoS").when(col("Flow IAT Max") > 0.06, "PortScan")
             .otherwise("BENIGN"))
    return f.select("l_orderkey", "l_linenumber", *[col(c) for c in FEATURES], label.alias("Label"))


def encoded(spark, sf):
    f = _labelled(spark, sf)
    return training.encode(f, training.label_classes(f)).groupBy("Label", F.col("y").cast("int").alias("y")).agg(
        F.count(F.lit(1)).alias("n"))


def weights(spark, sf):
    f = _labelled(spark, sf)
    w = training.class_weights(training.encode(f, training.label_classes(f)))
    return w.select(F.col("y").cast("int").alias("y"), rounded(F.col("weight"), 6).alias("weight"))


def scaled(spark, sf):
    f = _labelled(spark, sf)
    out = training.scale(f, training.fit_scaler(f, FEATURES))
    return out.select("l_orderkey", "l_linenumber", "Label", rounded(col("Flow Duration")).alias("dur"),
                      rounded(col("Flow IAT Max")).alias("iat"))


def cleaned(spark, sf):
    """Constant column dropped, duplicates removed, over whole flows."""
    f = _labelled(spark, sf).drop("l_orderkey", "l_linenumber").withColumn("Constant", F.lit(3.0))
    c = training.clean(f)
    return c.rows.agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"features": F.lit(len(c.features)), "dropped": F.lit("|".join(c.constant))})


def compare(spark, sf):
    """Both learners at their full size on the held-out part: per-class reports."""
    f = _labelled(spark, sf).drop("l_orderkey", "l_linenumber")
    _, _, matrices = training.train_and_compare(f, scratch_path(spark, "models"))
    reports = None
    for name in ("random_forest", "boosted"):
        r = evaluate.class_report(matrices.filter(F.col("model") == name)).withColumn("model", F.lit(name))
        reports = r if reports is None else reports.union(r)
    return reports


def compare_checks(spark, sf):
    """What the reports must hold whatever the trees: held-out rows per class, and quality beyond doubt."""
    out = compare(spark, sf).filter("class IN ('BENIGN', 'DDoS', 'PortScan')")
    return out.select("model", "class", F.col("support").cast("long").alias("support"), (F.col("f1") > 0.8).alias("good"))


def registered(spark, sf):
    """Train, store, load and evaluate a stored forest on all flows."""
    f = _labelled(spark, sf).drop("l_orderkey", "l_linenumber")
    p = training.prepare(f)
    fitted = training.train_forest(training.scale(p.train, p.scaler), p.features, trees=5, depth=4)
    path = scratch_path(spark, "registered")
    training.save_model(spark, training.as_flow_model("forest", fitted, p.features, p.classes, p.scaler), path,
                        "random_forest")
    model = training.load_model(spark, path, "forest", 1)
    binary = f.withColumn("Label", F.when(F.col("Label") == "BENIGN", 0).otherwise(1))
    return training.evaluate_registered(model, binary)


def windows(spark, sf):
    """Macro training windows sampled from the labelled flows."""
    f = _labelled(spark, sf).withColumn("row_key", F.xxhash64("l_orderkey", "l_linenumber", *[col(c) for c in FEATURES]))
    return training.macro_windows(f, FEATURES, ["row_key", "l_orderkey", "l_linenumber"], per_class=200)


def macro_models(spark, sf):
    _, matrices = training.train_macro(windows(spark, sf), FEATURES, trees=5, rounds=2, forest_depth=4, boost_depth=2)
    return matrices


_LAB = """SELECT *, CASE WHEN dur > 40 THEN 'DDoS' WHEN iatmax > 0.06 THEN 'PortScan' ELSE 'BENIGN' END AS Label
  FROM flows"""
_CODE = "CASE Label WHEN 'BENIGN' THEN 0 WHEN 'DDoS' THEN 1 ELSE 2 END"

ENTRIES = {
    "label_encoding": (encoded, sql("flows", f"SELECT Label, {_CODE} AS y, count(*) AS n FROM f GROUP BY 1, 2", f=_LAB)),
    "class_weights": (weights, sql("flows", f"""
        SELECT {_CODE} AS y, round((SELECT count(*) FROM f) / (3 * count(*)) + 1e-7, 6) AS weight
        FROM f GROUP BY 1""", f=_LAB)),
    "standard_scaling": (scaled, sql("flows", """
        SELECT l_orderkey, l_linenumber, Label, round((dur - m1) / s1 + 1e-7, 4) AS dur,
          round((iatmax - m2) / s2 + 1e-7, 4) AS iat
        FROM f, (SELECT avg(dur) AS m1, stddev_pop(dur) AS s1, avg(iatmax) AS m2, stddev_pop(iatmax) AS s2
          FROM f)""", f=_LAB)),
    "training_clean_pipeline": (cleaned, sql("flows", """
        SELECT count(DISTINCT (dur, fwd, bps, plstd, iatmax, syn, aps)) AS n, 7 AS features, 'Constant' AS dropped
        FROM f""", f=_LAB)),
    "train_and_compare": (compare, None),
    "training_supports": (compare_checks, sql("flows", """
        SELECT model, Label AS class, CAST(floor(count(DISTINCT (dur, fwd, bps, plstd, iatmax, syn, aps)) * 0.2 + 0.5) AS BIGINT) AS support, TRUE AS good
        FROM f, (VALUES ('random_forest'), ('boosted')) m(model) GROUP BY ALL""", f=_LAB)),
    "registered_model_evaluation": (registered, None),
    "macro_training_windows": (windows, None),
    "macro_training": (macro_models, None),
}
