"""From probabilities to verdicts: class, confidence, severity, reason, status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.functions.scalars import fixed, percent
from flowtide.schemas import col

BENIGN = 0
CRITICAL, HIGH, MEDIUM = 0.90, 0.70, 0.40
DECISION_THRESHOLD = 0.5
DEFAULT_THREAT = "Anomalous / Malicious Traffic"
BLOCKED_THREAT = "Blocked IP Attempting Access"
CAPTURE_CHANNELS = ("live", "pcap")


def decide_class(p: Column, threshold: float = DECISION_THRESHOLD) -> Column:
    """Class index from an array of class probabilities (index 0 is benign).

    Two classes: attack when P(attack) reaches the threshold. More classes: benign when
    1 - P(benign) stays below it, else the strongest attack class, the first on a tie.
    """
    attacks = F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))
    strongest = F.array_position(attacks, F.array_max(attacks)).cast("int")
    binary = F.when(p.getItem(1) >= threshold, 1).otherwise(0)
    several = F.when(F.lit(1.0) - p.getItem(0) < threshold, 0).otherwise(strongest)
    return F.when(F.size(p) == 2, binary).otherwise(several)


def confidence_of(p: Column | None) -> Column:
    """Largest class probability; a model without probabilities is certain."""
    return F.lit(1.0) if p is None else F.array_max(p)


def decide_score(p: Column, threshold: float = DECISION_THRESHOLD) -> tuple[Column, Column]:
    """(class, confidence) of a single attack score."""
    return F.when(p >= threshold, 1).otherwise(0), F.greatest(p, F.lit(1.0) - p)


def severity_of(confidence: Column, malicious: Column, critical: float = CRITICAL,
                high: float = HIGH, medium: float = MEDIUM) -> Column:
    return (F.when(~malicious, "")
            .when(confidence >= critical, "CRITICAL")
            .when(confidence >= high, "HIGH")
            .when(confidence >= medium, "MEDIUM")
            .otherwise("LOW"))


def class_label(prediction: Column, classes: Sequence[str]) -> Column:
    """Class name by index; empty when out of range."""
    names = F.array(*[F.lit(c) for c in classes]) if classes else F.array().cast("array<string>")
    in_range = (prediction >= 0) & (prediction < len(classes))
    return F.coalesce(F.when(in_range, F.get(names, prediction)), F.lit(""))


def ranked_features(names: Sequence[str], k: int | None = None) -> Column:
    """Array of (name, value) ordered by absolute value; ties keep the given order."""
    entries = F.array(*[
        F.struct((-F.abs(F.coalesce(col(n), F.lit(0.0)))).alias("o"), F.lit(i).alias("i"),
                 F.lit(n).alias("name"), F.coalesce(col(n), F.lit(0.0)).alias("value"))
        for i, n in enumerate(names)])
    ordered = F.sort_array(entries)
    return ordered if k is None else F.slice(ordered, 1, k)


def ranked_map(bag: Column, k: int | None = None) -> Column:
    """Same for a map column, in the map's own order on ties."""
    entries = F.map_entries(bag)
    indexed = F.transform(entries, lambda e, i: F.struct(
        (-F.abs(e["value"])).alias("o"), i.alias("i"), e["key"].alias("name"),
        e["value"].alias("value")))
    ordered = F.sort_array(indexed)
    return ordered if k is None else F.slice(ordered, 1, k)


def feature_text(ranked: Column) -> Column:
    """``name=1.0000, name=...``"""
    return F.array_join(F.transform(
        ranked, lambda e: F.concat(e["name"], F.lit("="), fixed(e["value"], 4))), ", ")


def feature_analysis(prediction: Column, names: Sequence[str]) -> Column:
    return (F.when(prediction == BENIGN, "no anomalous patterns detected")
            .otherwise(F.concat(F.lit("key contributing features: "),
                                feature_text(ranked_features(names, 5)))))


def attack_reason(prediction: Column, attack_type: Column, confidence: Column, source_ip: Column,
                  blocked: Column, whitelisted: Column, block_reason: Column,
                  model_name: Column, analysis: Column) -> Column:
    """Six texts: blocked, trusted or plain source, each with an attack or benign verdict."""
    attack = prediction != BENIGN
    sure = percent(confidence, 1)
    ip = F.coalesce(source_ip, F.lit("None"))
    why = F.coalesce(F.when(block_reason != "", block_reason), F.lit("listed in blacklist"))
    blocked_head = F.concat(F.lit("Blacklisted source "), ip, F.lit(" BLOCKED (reason: "), why,
                            F.lit("). "))
    trusted_head = F.concat(F.lit("Whitelisted admin test traffic from "), ip,
                            F.lit(" — model classified as "))
    return (
        F.when(blocked & attack, F.concat(
            blocked_head, F.lit("Model classified traffic as "), attack_type, F.lit(" with "), sure,
            F.lit(" confidence — "), analysis))
        .when(blocked, F.concat(blocked_head, F.lit("Model classified traffic as benign.")))
        .when(whitelisted & attack, F.concat(
            trusted_head, attack_type, F.lit(" with "), sure, F.lit(" confidence but trusted.")))
        .when(whitelisted, F.concat(trusted_head, F.lit("benign.")))
        .when(attack, F.concat(
            F.lit("ML model ("), model_name, F.lit(") classified as "), attack_type,
            F.lit(" with "), sure, F.lit(" confidence — "), analysis))
        .otherwise(F.lit("Traffic classified as benign by ML model — "
                         "no attack pattern detected above threshold")))


def add_verdict(df: DataFrame, classes: Sequence[str], probability: str = "probability",
                threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """Add prediction, confidence and attack_type from a probability array or vector column."""
    p = col(probability)
    if df.schema[probability].dataType.typeName() != "array":
        from pyspark.ml.functions import vector_to_array
        p = vector_to_array(p)
    df = df.withColumn("_p", p)
    df = df.withColumn("prediction", decide_class(F.col("_p"), threshold))
    return (df.withColumn("confidence", confidence_of(F.col("_p")))
            .withColumn("attack_type", class_label(F.col("prediction"), classes)).drop("_p"))


def add_grading(df: DataFrame, feature_names: Sequence[str] = (), analysis: Column | None = None,
                model_name: str = "model_name") -> DataFrame:
    """Add severity and attack_reason. Reputation flags default to false when absent."""
    for flag in ("is_whitelisted", "is_blacklisted", "is_protected"):
        if flag not in df.columns:
            df = df.withColumn(flag, F.lit(False))
    if "block_reason" not in df.columns:
        df = df.withColumn("block_reason", F.lit(None).cast("string"))
    prediction, confidence = F.col("prediction"), F.col("confidence")
    blocked = F.col("is_blacklisted") & ~F.col("is_protected")
    severity = (F.when(blocked, "CRITICAL")
                .otherwise(severity_of(confidence, prediction != BENIGN)))
    if analysis is None:
        analysis = feature_analysis(prediction, feature_names)
    reason = attack_reason(prediction, F.col("attack_type"), confidence, F.col("source_ip"), blocked,
                           F.col("is_whitelisted"), F.col("block_reason"), F.col(model_name), analysis)
    return df.withColumns({"severity": severity, "attack_reason": reason})


def display_status(prediction: Column, whitelisted: Column, blacklisted: Column) -> Column:
    return (F.when(blacklisted, "Blocked").when(whitelisted, "Admin Test")
            .when(prediction == BENIGN, "Normal").otherwise("Attack"))


def display_label(prediction: Column, attack_type: Column, whitelisted: Column,
                  blacklisted: Column) -> Column:
    name = F.coalesce(F.when(attack_type != "", attack_type),
                      F.concat(F.lit("Class "), prediction.cast("string")))
    return (F.when(blacklisted, BLOCKED_THREAT)
            .when(whitelisted, "Admin Test Traffic (Whitelisted)")
            .when(prediction == BENIGN, "Benign")
            .otherwise(F.concat(F.lit("Attack ("), name, F.lit(")"))))


def dashboard_state(prediction: Column, attack_type: Column) -> Column:
    name = F.coalesce(F.when(attack_type != "", attack_type), F.lit("Unknown"))
    return (F.when(prediction == BENIGN, "Normal")
            .otherwise(F.concat(F.lit("Attack ("), name, F.lit(")"))))


def attack_label(prediction: Column, attack_type: Column) -> Column:
    return F.coalesce(F.when(attack_type != "", attack_type),
                      F.concat(F.lit("Class "), prediction.cast("string")))


def fill_unscored(df: DataFrame) -> DataFrame:
    """Rows without a verdict (their macro-flow was rejected) count as benign."""
    return df.withColumns({
        "attack_type": F.when(F.col("prediction").isNull(), "BENIGN").otherwise(F.col("attack_type")),
        "confidence": F.coalesce("confidence", F.lit(0.0)),
        "attack_reason": F.when(F.col("prediction").isNull(),
                                "Inference unavailable — row treated as benign")
                          .otherwise(F.col("attack_reason")) if "attack_reason" in df.columns
                          else F.lit(None).cast("string"),
        "prediction": F.coalesce("prediction", F.lit(BENIGN)),
    })


def audit_log(detections: DataFrame) -> DataFrame:
    """One log row per detection: WARNING for attacks, INFO otherwise."""
    attack = F.col("prediction") != BENIGN
    channel = F.when(F.col("source_type").isin(*CAPTURE_CHANNELS), "CAPTURE").otherwise("PREDICTION")
    none = F.lit("None")
    message = F.concat(
        F.lit("Execution Tail Complete: VectorSource='"), F.col("source_type"), F.lit("' -> Class="),
        F.col("prediction").cast("string"), F.lit(" ("), F.col("attack_type"), F.lit(") (Confidence="),
        percent(F.col("confidence"), 2), F.lit(") | Src="), F.coalesce("source_ip", none),
        F.lit(" -> Dst="), F.coalesce("destination_ip", none))
    return detections.select(
        channel.alias("source"), F.when(attack, "WARNING").otherwise("INFO").alias("level"),
        message.alias("message"), F.col("created_at"))


def summarize(scored: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Rows, attacks, normals and threat density. With macro ``units`` the reference figure
    (rows minus attack units) and the row-wise figure are both given."""
    attack = F.col("prediction") != BENIGN
    rows = scored.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(attack).alias("attack_rows"))
    if units is None:
        rows = rows.withColumn("attack_units", F.col("attack_rows"))
    else:
        per_unit = units.agg(F.count_if(attack).alias("attack_units"))
        rows = rows.withColumn("attack_units", per_unit.scalar())
    return rows.withColumns({
        "normal_rows": F.col("total_rows") - F.col("attack_rows"),
        "normal_reference": F.col("total_rows") - F.col("attack_units"),
        "threat_density": F.coalesce(
            F.try_divide(F.col("attack_units") * 100.0, F.col("total_rows")), F.lit(0.0)),
    })
