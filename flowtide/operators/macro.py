"""Macro-flow assembly: many small flows of one key become one aggregate flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowtide.functions import naming
from flowtide.operators.align import is_finite
from flowtide.operators.gaps import tag_sessions
from flowtide.operators.skew import HOT_ROWS, attach
from flowtide.schemas import IDENTITY_COLUMNS, col

DEFAULT_KEY = ("src_ip", "dst_ip", "dst_port", "protocol")


class MacroPlan:
    """Aggregation expressions for a set of features, built once on the driver."""

    def __init__(self, features: Sequence[str], min_members: int = 2,
                 weighting: str = "reference", order_by: Sequence[str] = ()):
        self.features = list(features)
        self.min_members = min_members
        self.roles = {f: naming.role_of(f) for f in self.features}
        self.order_by = list(order_by)
        # Without an order the first member is the first one read.
        self._reads = "identity" in self.roles.values() and not self.order_by
        if self._reads:
            self.order_by = ["_at"]
        self._weight_inputs = naming.packet_weight_features(self.features, weighting)
        self._duration_input = naming.duration_feature(self.features)

    def _clean(self, name: str) -> Column:
        """Absent stays null; non-finite counts as 0."""
        c = col(name)
        return F.when(c.isNotNull(), F.when(is_finite(c), c).otherwise(F.lit(0.0)))

    def with_inputs(self, flows: DataFrame) -> DataFrame:
        """Add the member's weight ``_w`` and duration ``_d``; clean numeric features."""
        zero = F.lit(0.0)
        total = zero
        for name in self._weight_inputs:
            total = total + F.coalesce(self._clean(name), zero)
        duration = (F.coalesce(self._clean(self._duration_input), zero)
                    if self._duration_input else zero)
        cleaned = {f: self._clean(f) for f in self.features if self.roles[f] != "identity"}
        if self._reads:
            cleaned["_at"] = F.monotonically_increasing_id()
        return flows.withColumns({"_w": F.when(total > 0, total).otherwise(F.lit(1.0)),
                                  "_d": duration, **cleaned})

    def reducers(self) -> list[Column]:
        """One expression list covering every role; all of it combines map-side.

        STD keeps moments that merge without losing digits: the plain mean u of x, and the co-moments of x with the
        weight w and with w * x, which Spark updates and merges around running means. From these follow
        sum w (x - u) and sum w (x - u)^2, so nothing of the size of x^2 is ever subtracted.
        """
        aggs = [F.count(F.lit(1)).alias("member_count")]
        for f in self.features:
            c, role = col(f), self.roles[f]
            present_w = F.when(c.isNotNull(), F.col("_w"))
            if role == "identity":
                aggs.append(F.min_by(c, F.struct(*[col(o) for o in self.order_by])).alias(f))
                continue
            if role == "sum":
                value = F.sum(c)
            elif role == "rate":
                span = F.sum(F.when(c.isNotNull(), F.col("_d")))
                # A group without the feature stays null, one without duration gives 0.
                value = F.when(span > 0, F.sum(c * F.col("_d")) / span).when(span <= 0, F.lit(0.0))
            elif role == "max":
                value = F.max(c)
            elif role == "min":
                value = F.min(c)
            elif role == "mean":
                value = F.sum(c * F.col("_w")) / F.sum(present_w)
            if role == "std":
                aggs += [F.sum(present_w).alias(f"_W:{f}"), F.count(c).alias(f"_n:{f}"), F.avg(c).alias(f"_u:{f}"),
                         F.covar_pop(c, F.col("_w")).alias(f"_cw:{f}"), F.covar_pop(c, F.col("_w") * c).alias(f"_cx:{f}")]
            else:
                aggs.append(value.alias(f))
            if role in ("rate", "mean", "std") and self.min_members > 1:
                aggs.append(F.max(c).alias(f"_1:{f}"))
        return aggs

    def _spread(self, f: str) -> Column:
        """Weighted sum of squared distances from the weighted mean u + d, where d = sum w (x - u) / sum w."""
        n, off = col(f"_n:{f}"), col(f"_n:{f}") * col(f"_cw:{f}")
        around = n * col(f"_cx:{f}") - col(f"_u:{f}") * off
        return around - off * off / col(f"_W:{f}")

    def finish(self, keys: Sequence[str], grouped: DataFrame) -> DataFrame:
        """Round to 6 digits; a lone member below the threshold passes through untouched."""
        lone = (F.col("member_count") == 1) & F.lit(self.min_members > 1)
        out = []
        for f in self.features:
            role = self.roles[f]
            if role == "identity":
                out.append(col(f))
                continue
            if role == "std":
                weight = col(f"_W:{f}")
                value = (F.when(weight <= 1.0, F.lit(0.0))
                         .when(weight > 1.0, F.sqrt(F.greatest(F.lit(0.0), self._spread(f) / weight))))
            else:
                value = col(f)
            raw = col(f"_1:{f}") if role in ("rate", "mean", "std") and self.min_members > 1 else value
            out.append(F.when(lone, raw).otherwise(F.round(value, 6)).alias(f))
        return grouped.select(*[col(k) for k in keys], "member_count", *out)


def macro_features(flows: DataFrame, key: Sequence[str], exclude: Sequence[str] = ()) -> list[str]:
    skip = set(IDENTITY_COLUMNS) | set(key) | set(exclude)
    return [f.name for f in flows.schema.fields
            if f.name not in skip and f.dataType.typeName() in
            ("double", "float", "integer", "long", "short", "byte", "decimal")]


def assemble(flows: DataFrame, key: Sequence[str] = DEFAULT_KEY,
             features: Sequence[str] | None = None, min_members: int = 2,
             weighting: str = "reference", order_by: Sequence[str] = ()) -> DataFrame:
    """One row per key: ``key..., member_count, features...``.

    ``src_port`` is left out of the default key so rotating source ports collapse. All reducers combine map-side, so
    the source is read once and a flood key costs one partial row per task. An identity feature, such as a port, takes
    the value of the first member by ``order_by``, or of the first one read.
    """
    key = list(key)
    if features is None:
        features = macro_features(flows, key, order_by)
    plan = MacroPlan([f for f in features if f not in key], min_members, weighting, order_by)
    return plan.finish(key, plan.with_inputs(flows).groupBy(*[col(k) for k in key]).agg(*plan.reducers()))


def attribute(flows: DataFrame, verdicts: DataFrame, key: Sequence[str] = DEFAULT_KEY,
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """Give every member flow the verdict of its macro-flow; every flow row is kept.

    ``verdicts`` is unique on the key and carries ``member_count``.
    """
    return attach(flows, verdicts, key, "member_count", hot_rows)


def group_windows(flows: DataFrame, ts: str, gap_seconds: float,
                  key: Sequence[str] = DEFAULT_KEY) -> DataFrame:
    """Tag flows with ``window_start`` so that macro-flows split where a key pauses longer than
    the gap. Slots no wider than the gap are merged first, so windows see slots, not rows."""
    return tag_sessions(flows, list(key), ts, gap_seconds, "window_start")
