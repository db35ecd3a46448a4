"""The decision pipeline: flows in, verdicts, detections and alerts out, as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from flowtide.functions.scalars import features_to_json
from flowtide.operators import align, decide, macro, reputation
from flowtide.operators.skew import null_safe_join
from flowtide.plans.models import FlowModel
from flowtide.schemas import IDENTITY_COLUMNS, col


@dataclass
class Reputation:
    """IP lists used when integration is on (live traffic); file audits run without."""

    whitelist: DataFrame | None = None
    blacklist: DataFrame | None = None
    protected: DataFrame | None = None


@dataclass
class MacroSettings:
    key: Sequence[str] = macro.DEFAULT_KEY
    min_members: int = 2
    weighting: str = "reference"
    order_by: Sequence[str] = ()


@dataclass
class AuditResult:
    """Lazily planned outputs. ``rows`` has one row per input flow, ``units`` one per scored unit
    (equal to rows without macro assembly), ``rejected`` the units lacking features."""

    rows: DataFrame
    units: DataFrame
    rejected: DataFrame
    summary: DataFrame


VERDICT = ["prediction", "confidence", "attack_type", "severity", "attack_reason", "is_whitelisted",
           "is_blacklisted", "missing_features"]


def detect(flows: DataFrame, model: FlowModel, source_type: str, keep: Sequence[str] = (),
           lists: Reputation | None = None, min_coverage: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(scored, rejected): align, check coverage, score, label, look up reputation, grade.

    Aligned features feed both the model and the reason text, so nothing is resolved twice.
    """
    carried = [*keep, *[c for c in IDENTITY_COLUMNS if c in flows.columns and c not in keep]]
    aligned = align.align(flows, model.features, carried)
    accepted, rejected = align.covered(aligned, min_coverage)
    scored = decide.add_verdict(model.score(accepted), model.classes, threshold=model.threshold)
    scored = (scored.withColumnRenamed("src_ip", "source_ip").withColumnRenamed("dst_ip", "destination_ip")
              .withColumns({"model_name": F.lit(model.name), "model_id": F.lit(model.model_id).cast("long"),
                            "source_type": F.lit(source_type)}))
    lists = lists or Reputation()
    scored = reputation.with_reputation(scored, lists.whitelist, lists.blacklist, lists.protected)
    return decide.add_grading(scored, model.features), rejected


def audit(flows: DataFrame, model: FlowModel, source_type: str = "csv", keep: Sequence[str] = (),
          lists: Reputation | None = None, min_coverage: float = 0.5,
          macro_model: FlowModel | None = None, macro_settings: MacroSettings | None = None) -> AuditResult:
    """Audit flows per row, or per macro-flow when macro settings are given.

    In macro mode the macro model (or ``model`` when there is none) judges each aggregate and its
    verdict is joined back to every member; members of rejected aggregates count as benign.
    """
    if macro_settings is None:
        scored, rejected = detect(flows, model, source_type, keep, lists, min_coverage)
        summary = decide.summarize(scored).withColumn(
            "total_rows", flows.agg(F.count(F.lit(1))).scalar())
        return AuditResult(scored, scored, rejected, summary)
    s = macro_settings
    features = macro.macro_features(flows, s.key, [*keep, *s.order_by])
    units = macro.assemble(flows, s.key, features, s.min_members, s.weighting, s.order_by)
    scored, rejected = detect(units, macro_model or model, source_type, ["member_count"], lists, min_coverage)
    renamed = {"src_ip": "source_ip", "dst_ip": "destination_ip"}
    verdicts = scored.select(*[F.col(renamed.get(k, k)).alias(k) for k in s.key], "member_count", *VERDICT)
    sizes = units.select(*[col(k) for k in s.key], "member_count")
    per_key = null_safe_join(sizes, verdicts.drop("member_count"), list(s.key))
    rows = decide.fill_unscored(macro.attribute(flows, per_key, s.key))
    return AuditResult(rows, scored, rejected, decide.summarize(rows, scored))


def detection_rows(scored: DataFrame, features: Sequence[str], id_col: str, time_col: str) -> DataFrame:
    """Scored units in the shape of the detections table."""
    return scored.select(
        F.col(id_col).cast("long").alias("id"), "model_id", "source_ip", "destination_ip", "prediction",
        "confidence", "source_type", features_to_json(list(features)).alias("raw_features"), "severity",
        "attack_type", "attack_reason", "is_whitelisted", "is_blacklisted", "is_protected", "block_reason",
        "model_name", F.col(time_col).alias("created_at"))
