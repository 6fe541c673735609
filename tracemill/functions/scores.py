"""Composite suspicion score as a column expression (M6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.predicates import lookup

# --- fixed values: weights, severity weights and bands of the composite --------
WEIGHTS = {"rule": 0.40, "anomaly": 0.35, "correlation": 0.25}
SEVERITY_WEIGHTS = {"Low": 0.25, "Medium": 0.5, "High": 0.75, "Critical": 1.0}
EVIDENCE_DIVISOR = 5.0
BANDS = (
    (0.75, "Potentially suspicious - high priority"),
    (0.55, "Anomalous - review"),
    (0.35, "Low interest"),
)
LOWEST_BAND = "Informational"
FORMULA_VERSION = "fusion_v1"
# --------------------------------------------------------------------------------


def css_band(css: Column) -> Column:
    out = F.when(css >= BANDS[0][0], BANDS[0][1])
    for cutoff, label in BANDS[1:]:
        out = out.when(css >= cutoff, label)
    return out.otherwise(LOWEST_BAND)


def suspicion(severity: Column, anomaly: Column, distinct_evidence: Column) -> Column:
    """Struct of the three components, their contributions, total and band."""
    weight = lookup(severity, SEVERITY_WEIGHTS)
    rule = F.when(weight.isNotNull(), F.lit(0.5) + F.lit(0.5) * weight).otherwise(F.lit(0.0))
    anom = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(anomaly, F.lit(0.0))))
    corr = F.least(distinct_evidence.cast("double") / F.lit(EVIDENCE_DIVISOR), F.lit(1.0))
    parts = {
        "rule": (rule, WEIGHTS["rule"]),
        "anomaly": (anom, WEIGHTS["anomaly"]),
        "correlation": (corr, WEIGHTS["correlation"]),
    }
    total = sum((v * F.lit(w) for v, w in parts.values()), F.lit(0.0))
    css = F.round(F.least(F.lit(1.0), total), 4)
    return F.struct(
        F.lit(FORMULA_VERSION).alias("formula_version"),
        *[
            F.struct(
                F.round(v, 4).alias("value"),
                F.round(v * F.lit(w), 4).alias("contribution"),
                F.lit(w).alias("weight"),
            ).alias(name)
            for name, (v, w) in parts.items()
        ],
        css.alias("total"),
        css_band(css).alias("band"),
    )
