"""Reconstructed timeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import predicates as P
from tracemill.operators.ranking import stored_first_or_all
from tracemill.operators.slices import near_any
from tracemill.schema import ViewParams
from tracemill.session import parquet_stage, small_side

LINKS_SHOWN = 3
_ENTRY = [
    "case_id", "timestamp", "id", "event_uid", "source_type", "event_type", "user", "host", "process", "file_path", "action",
    "anomaly_score", "is_anomalous", "evidence_id",
]


@dataclass(frozen=True)
class Timeline:
    entries: DataFrame  # capped entries with reasons
    totals: DataFrame   # per case: total, truncated, undated events


def link_ends(links: DataFrame) -> DataFrame:
    """Both ends of every link: (case_id, id, link_rank, correlation_uid, type, band, other_uid)."""
    pick = [
        F.struct(F.col(f"event_{x}_id").alias("id"), F.col(f"event_{y}_uid").alias("other_uid"))
        for x, y in (("a", "b"), ("b", "a"))
    ]
    return links.select(
        "case_id", "link_rank", "correlation_uid", "correlation_type", "band",
        F.explode(F.array(*pick)).alias("e"),
    ).select("case_id", "link_rank", "correlation_uid", "correlation_type", "band", "e.id", "e.other_uid")


def flagged_events(events: DataFrame, finding_events: DataFrame, links: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """Events with rule_seen, ml_seen, linked flags; ``linked`` (case_id, id) names the linked events, else the ends of ``links`` are."""
    tags = finding_events.groupBy("case_id", "id").agg(
        F.max(F.col("kind") == "rule").alias("rule_seen"), F.max(F.col("kind") == "ml").alias("ml_seen")
    )
    ends = link_ends(links) if linked is None else linked
    linked = small_side(ends.select("case_id", "id", F.lit(True).alias("linked")).distinct())
    base = events if "is_anomalous" in events.columns else events.withColumns(
        {"is_anomalous": F.lit(False), "anomaly_score": F.lit(None).cast("double")}
    )
    return (
        base.join(tags, ["case_id", "id"], "left")
        .join(linked, ["case_id", "id"], "left")
        .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("rule_seen", "ml_seen", "linked")})
    )


def with_context(flagged: DataFrame, context_minutes: int) -> DataFrame:
    """Adds ``tagged`` and ``context``; drops events that are neither."""
    dated = flagged.filter(F.col("timestamp").isNotNull()).withColumns(
        {
            "us": P.micros(F.col("timestamp")),
            "tagged": F.col("rule_seen") | F.col("ml_seen") | F.col("is_anomalous") | F.col("linked"),
        }
    )
    marks = dated.filter("tagged").select("case_id", "us")
    near = near_any(dated, marks, ["case_id"], "us", context_minutes * 60_000_000, "near")
    return near.withColumn("context", ~F.col("tagged") & F.col("near")).filter(
        F.col("tagged") | F.col("context")
    ).drop("near")


def over(cap: int | None):
    """A limit to compare with; without one nothing is above it."""
    return F.lit(cap if cap is not None else 2**62)


def significance():
    return (
        F.when(F.col("rule_seen"), "SUSPICIOUS")
        .when(F.col("ml_seen") | F.col("is_anomalous"), "NOTABLE")
        .otherwise("NORMAL")
    )


def timeline(
    events: DataFrame, findings: DataFrame, finding_events: DataFrame, links: DataFrame,
    p: ViewParams = ViewParams(), linked: DataFrame | None = None,
) -> Timeline:
    """First ``timeline_max`` entries per case in time order (all where it is None), with their reasons.

    ``linked`` names all linked events where ``links`` has only those of the entries shown.
    """
    # Ranked, and counted for the totals.
    all_entries = parquet_stage(
        with_context(flagged_events(events, finding_events, links, linked), p.context_minutes).select(*_ENTRY, "us", "rule_seen", "ml_seen", "tagged", "context"))
    totals = (
        events.groupBy("case_id").agg(F.count_if(F.col("timestamp").isNull()).alias("undated_events"))
        .join(all_entries.groupBy("case_id").agg(F.count("*").alias("total")), "case_id", "left")
        .select(
            "case_id", F.coalesce("total", F.lit(0)).alias("total"),
            (F.coalesce("total", F.lit(0)) > over(p.timeline_max)).alias("truncated"), "undated_events",
        )
    )
    kept = stored_first_or_all(all_entries, ["case_id"], [F.asc("us"), F.asc("id")], p.timeline_max, rank="position")
    ids = kept.filter("tagged").select("case_id", "id")
    say = F.when(
        F.col("kind") == "rule",
        F.concat(F.lit("Rule "), "rule_id", F.lit(" triggered: "), "title", F.lit(" ("), "severity",
                 F.lit(" severity)")),
    ).otherwise(
        F.concat(F.lit("ML finding "), "finding_uid", F.lit(": "), "title", F.lit(" (anomaly score "),
                 F.format_string("%.3f", "anchor_score"), F.lit(")"))
    )
    # An event is in few findings: at most one of each rule and scope, and one window.
    tags = (
        finding_events.join(ids, ["case_id", "id"])
        .join(findings.select("case_id", "finding_uid", "rule_id", "title", "severity", "anchor_score"),
              ["case_id", "finding_uid"])
        .groupBy("case_id", "id")
        .agg(F.sort_array(F.collect_list(F.struct(
            (F.col("kind") == "ml").alias("ml"), "finding_uid", say.alias("why")))).alias("tags"))
    )
    ends = link_ends(links).join(ids, ["case_id", "id"])
    top_links = (
        ends.withColumn("n", F.row_number().over(Window.partitionBy("case_id", "id").orderBy("link_rank")))
        .filter(F.col("n") <= LINKS_SHOWN)
        .groupBy("case_id", "id")
        .agg(F.sort_array(F.collect_list(F.struct(
            "link_rank", "correlation_uid",
            F.concat(F.lit("Correlation "), "correlation_uid", F.lit(" ("), "correlation_type",
                     F.lit(") with "), "other_uid", F.lit(" — "), "band", F.lit(" confidence")).alias("why"),
        ))).alias("ends"))
    )
    none = F.array().cast("array<string>")
    score_text = F.concat(
        F.lit("Flagged as anomalous in its event window (anomaly score "),
        F.format_string("%.3f", "anomaly_score"), F.lit(")"),
    )
    notable = ~F.col("rule_seen") & ~F.col("ml_seen") & F.col("is_anomalous")
    alone = F.array_compact(F.array(
        F.when(notable & F.col("anomaly_score").isNotNull(), score_text),
        F.when(~F.col("rule_seen") & ~F.col("ml_seen") & ~F.col("is_anomalous"),
               "Linked to other case events by correlation only"),
    ))
    reasons = F.when(
        F.col("context"),
        F.array(F.lit(f"Context: within ±{p.context_minutes} minutes of a flagged event")),
    ).otherwise(
        F.concat(
            F.coalesce(F.transform("tags", lambda t: t["why"]), none), alone,
            F.coalesce(F.transform("ends", lambda e: e["why"]), none),
        )
    )
    entries = (
        kept.join(tags, ["case_id", "id"], "left").join(top_links, ["case_id", "id"], "left")
        .select(
            "case_id", "position", "timestamp", "id", "event_uid", "source_type", "event_type", "user",
            "host", "process", "file_path", "action", "anomaly_score", "is_anomalous",
            significance().alias("significance"),
            reasons.alias("reasons"),
            F.coalesce(F.transform("tags", lambda t: t["finding_uid"]), none).alias("finding_ids"),
            F.coalesce(F.transform("ends", lambda e: e["correlation_uid"]), none).alias("correlation_ids"),
            "evidence_id", "context",
        )
    )
    return Timeline(entries, totals)


def timeline_notes(totals: DataFrame, events: DataFrame, p: ViewParams = ViewParams()) -> DataFrame:
    """The note under a case's timeline."""
    seen = events.groupBy("case_id").agg(F.count("*").alias("events"))
    base = (
        F.when(F.coalesce("events", F.lit(0)) == 0, "No normalized forensic events available for correlation.")
        .when(F.col("total") == 0, "No flagged, correlated, or contextual events yet. Run automated analysis and "
              "correlation to reconstruct this timeline.")
        .when(F.col("truncated"), F.concat(F.lit(f"Showing the first {p.timeline_max} of "),
              F.col("total").cast("string"), F.lit(" entries (TIMELINE_MAX_ENTRIES).")))
    )
    undated = F.when(
        (F.col("undated_events") > 0) & (F.col("total") > 0),
        F.concat(F.col("undated_events").cast("string"), F.lit(" event(s) without a recorded timestamp were excluded.")),
    )
    return totals.join(seen, "case_id", "left").withColumn(
        "note", F.nullif(F.concat_ws(" ", base, undated), F.lit(""))
    ).drop("events")
