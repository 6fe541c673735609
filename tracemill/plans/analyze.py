"""Analysis run over all cases: windows, scores, rules, composite, findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import predicates as P
from tracemill.functions.scores import suspicion
from tracemill.operators.ranking import order_index
from tracemill.operators import anomaly, rules
from tracemill.operators.features import feature_windows
from tracemill.schema import AnomalyParams, RuleParams
from tracemill.session import parquet_stage, reliable_checkpoint


@dataclass(frozen=True)
class Analysis:
    """Outputs of one analysis run; every table spans all cases."""

    events: DataFrame          # events with anomaly_score, is_anomalous
    windows: DataFrame         # scored windows
    findings: DataFrame        # rule and ML findings, one row each
    finding_events: DataFrame  # (case_id, finding_uid, kind, id, event_uid, evidence_id, timestamp)
    stats: DataFrame           # one row per case


def _number(df: DataFrame, prefix: str, order: list, bounded: bool) -> DataFrame:
    """Sequential uid inside a case; caps bound a case's rows (70 rule, 10 ML), otherwise they are ranked by ranges."""
    if bounded:
        numbered = df.withColumn("_number", F.row_number().over(Window.partitionBy("case_id").orderBy(*order)))
    else:
        numbered = order_index(df, ["case_id"], order, "_number").rows
    return numbered.withColumn("finding_uid", P.uid(prefix, F.col("_number"))).drop("_number")


def analyze(
    events: DataFrame,
    rule_params: RuleParams = RuleParams(),
    anomaly_params: AnomalyParams = AnomalyParams(),
    scored: DataFrame | None = None,
) -> Analysis:
    """Findings of all cases. ``scored`` replaces the forest's window scores."""
    if scored is None:
        windows = feature_windows(events, anomaly_params.window_minutes)
        scored = anomaly.score_windows(windows, anomaly_params)
    scored = reliable_checkpoint(scored)
    # The events are read once more, for this stage; rules, anchors, members and counts read its columns.
    marked = parquet_stage(anomaly.annotate_events(events, scored, anomaly_params))
    events = marked.drop("anomaly_score", "is_anomalous")
    found = rules.run_rules(events, rule_params)
    key = [*rules.SCOPE, "rule_id"]

    scores = marked.select("case_id", "id", "anomaly_score")
    anchor = (
        found.finding_events.join(scores, ["case_id", "id"])
        .groupBy(*key)
        .agg(F.round(F.avg("anomaly_score"), 6).alias("anchor_score"))
    )
    css = suspicion(F.col("severity"), F.col("anchor_score"), F.col("distinct_evidence"))
    rule_rows = found.findings.join(anchor, key, "left").withColumn("components", css)
    rule_rows = _number(
        rule_rows, "RFND-",
        [F.asc_nulls_first("timestamp_start"), F.asc("rule_id"), F.asc("scope_a"), F.asc("scope_b")],
        bounded=rule_params.max_findings_per_rule is not None,
    ).withColumn("kind", F.lit("rule"))

    flagged = anomaly.ml_windows(scored, anomaly_params)
    inside = anomaly.ml_window_events(events, flagged, anomaly_params)
    support = inside.groupBy("case_id", "ml_rank").agg(
        F.count("*").alias("event_count"), F.count_distinct("evidence_id").alias("distinct_evidence")
    )
    ml_uid = P.uid("MFND-", F.col("ml_rank"))
    ml_rows = (
        flagged.drop("event_count", "distinct_evidence").join(support, ["case_id", "ml_rank"])
        .withColumns(
            {
                "finding_uid": ml_uid,
                "kind": F.lit("ml"),
                "timestamp_start": F.col("window_start"),
                "timestamp_end": F.col("window_end"),
                "reasons": F.array().cast("array<string>"),
                "anchor_score": F.round("score", 6),
                "components": suspicion(
                    F.lit(None).cast("string"), F.col("score"), F.col("distinct_evidence")
                ),
            }
        )
    )
    shape = [
        "case_id", "finding_uid", "kind", "rule_id", "scope_a", "scope_b", "title", "severity",
        "confidence", "event_count", "distinct_evidence", "timestamp_start", "timestamp_end",
        "explanation", "reasons", "anchor_score", "components",
    ]
    findings = (
        rule_rows.select(*shape)
        .unionByName(ml_rows.select(*[c for c in shape if c in ml_rows.columns]), allowMissingColumns=True)
        .withColumn("css", F.col("components.total"))
        .withColumn("css_band", F.col("components.band"))
        .withColumn("status", F.lit("New"))
    )
    findings = reliable_checkpoint(findings)
    finding_events = (
        found.finding_events.join(findings.filter("kind = 'rule'").select(*key, "finding_uid", "kind"), key)
        .select("case_id", "finding_uid", "kind", "id", "event_uid", "evidence_id", "timestamp")
        .unionByName(
            inside.select(
                "case_id", ml_uid.alias("finding_uid"), F.lit("ml").alias("kind"),
                "id", "event_uid", "evidence_id", "timestamp",
            )
        )
    )
    return Analysis(marked, scored, findings, finding_events, run_stats(events, scored, findings))


def run_stats(events: DataFrame, scored: DataFrame, findings: DataFrame) -> DataFrame:
    """M7: one row per case that was analysed."""
    considered = events.groupBy("case_id").agg(F.count("*").alias("events_considered"))
    windows = scored.groupBy("case_id").agg(
        F.count("*").alias("windows_total"),
        F.count_if("flagged").alias("windows_flagged"),
        F.max("abstained").alias("abstained"),
    )
    counted = findings.groupBy("case_id").agg(
        F.count_if(F.col("kind") == "rule").alias("rule_findings"),
        F.count_if(F.col("kind") == "ml").alias("ml_findings"),
    )
    out = considered.join(windows, "case_id", "left").join(counted, "case_id", "left")
    return out.select(
        "case_id", "events_considered",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("windows_total", "windows_flagged")],
        F.coalesce("abstained", F.lit(True)).alias("abstained"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rule_findings", "ml_findings")],
    )


def finding_order():
    """Severity first, then newest, then uid."""
    return [F.desc(P.severity_rank(F.col("severity"))), F.desc("finding_uid")]


def model_diagnostics(stats: DataFrame, p: AnomalyParams = AnomalyParams()) -> DataFrame:
    """The run statistics of a case with the settings they were made with."""
    return stats.select(
        "*",
        F.lit("isolation_forest").alias("model_name"),
        F.lit(p.seed).alias("random_state"),
        F.lit(p.n_estimators).alias("n_estimators"),
        F.lit(p.threshold).alias("threshold_value"),
        F.lit(p.z_sigmas).alias("z_sigmas"),
        F.lit(p.min_windows).alias("min_windows"),
        F.when(F.col("abstained"), anomaly.abstain_reason(p)).alias("abstain_reason"),
    )
