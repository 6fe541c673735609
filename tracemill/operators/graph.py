"""Three-layer evidence graph with node and edge caps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import predicates as P
from tracemill.operators.ranking import first_or_all, stored_first_or_all
from tracemill.operators.timeline import flagged_events, over
from tracemill.schema import ViewParams


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    totals: DataFrame  # per case: node and edge counts before the caps, truncated


def graph(
    events: DataFrame, evidence: DataFrame, findings: DataFrame, finding_events: DataFrame,
    links: DataFrame | Callable[[DataFrame], DataFrame], p: ViewParams = ViewParams(), linked: DataFrame | None = None,
) -> Graph:
    """Evidence, then findings, then events by priority, within the caps; a cap of None leaves nothing out.

    With ``linked``, the (case_id, id) of all linked events, ``links`` is a
    function that finds the links among given events: those of the shown nodes.
    """
    flagged = flagged_events(events, finding_events, links, linked)
    tagged = F.col("rule_seen") | F.col("ml_seen")
    rank = (
        F.when(F.col("rule_seen"), 0).when(tagged | F.col("is_anomalous"), 1)
        .when(F.col("linked"), 2).otherwise(3)
    )
    none = F.lit(None).cast("string")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    label = F.concat_ws(
        " · ", F.coalesce(filled("event_type"), F.col("source_type")),
        *[filled(c) for c in ("user", "host", "process", "file_path")],
    )
    late = F.lit(2**62)
    event_nodes = flagged.select(
        "case_id", F.col("event_uid").alias("node_id"), F.lit("event").alias("node_type"),
        F.when(label != "", label).otherwise(F.col("event_uid")).alias("label"),
        F.coalesce(F.replace(F.col("timestamp").cast("string"), F.lit(" "), F.lit("T")), F.lit("no timestamp")).alias("detail"),
        none.alias("severity"),
        F.when(F.col("rule_seen"), "SUSPICIOUS").when(tagged | F.col("is_anomalous"), "NOTABLE")
        .alias("significance"),
        F.lit(2).alias("layer"), rank.alias("o1"),
        F.coalesce(P.micros(F.col("timestamp")), late).alias("o2"),
        F.lpad(F.col("id").cast("string"), 20, "0").alias("o3"), F.col("id"),
    )
    evidence_nodes = evidence.select(
        "case_id", F.col("evidence_id").alias("node_id"), F.lit("evidence").alias("node_type"),
        F.col("original_filename").alias("label"),
        F.concat("evidence_type", F.lit(" · "), F.col("file_size").cast("string"),
                 F.lit(" bytes · SHA-256 "), F.substring("sha256", 1, 16), F.lit("…")).alias("detail"),
        none.alias("severity"), none.alias("significance"),
        F.lit(0).alias("layer"), F.lit(0).alias("o1"), F.lit(0).cast("long").alias("o2"),
        F.col("evidence_id").alias("o3"),
    )
    finding_nodes = findings.select(
        "case_id", F.col("finding_uid").alias("node_id"), F.lit("finding").alias("node_type"),
        F.concat(F.coalesce("rule_id", F.lit("isolation_forest")), F.lit(": "), "title").alias("label"),
        F.col("status").alias("detail"), "severity", none.alias("significance"),
        F.lit(1).alias("layer"), F.when(F.col("kind") == "rule", 0).otherwise(1).alias("o1"),
        F.lit(0).cast("long").alias("o2"), F.col("finding_uid").alias("o3"),
    )
    candidates = evidence_nodes.unionByName(finding_nodes).unionByName(event_nodes, allowMissingColumns=True)
    order = [F.asc("layer"), F.asc("o1"), F.asc("o2"), F.asc("o3")]
    nodes = stored_first_or_all(candidates, ["case_id"], order, p.graph_max_nodes, rank="node_rank")
    # The node cap bounds every later join input.
    shown = nodes.filter("node_type = 'event'").select("case_id", "id", F.col("node_id").alias("event_uid"))
    finding_rank = nodes.filter("node_type = 'finding'").select(
        "case_id", F.col("node_id").alias("finding_uid"), F.col("node_rank").cast("long").alias("o1"))
    evidence_shown = nodes.filter("node_type = 'evidence'").select("case_id", F.col("node_id").alias("evidence_id"))
    at = P.micros(F.col("timestamp"))
    none_d = F.lit(None).cast("double")
    triggered = (
        finding_events.join(shown.select("case_id", "id"), ["case_id", "id"], "left_semi")
        .join(finding_rank, ["case_id", "finding_uid"])
        .select("case_id", F.col("finding_uid").alias("source"), F.col("event_uid").alias("target"),
                F.lit("triggered").alias("relation"), F.lit("triggered").alias("label"),
                none.alias("correlation_type"), none_d.alias("confidence"),
                F.lit(0).alias("part"), "o1", at.alias("o2"), F.col("id").alias("o3"))
    )
    shown_events = events.join(shown.select("case_id", "id"), ["case_id", "id"], "left_semi")
    contains = shown_events.join(evidence_shown, ["case_id", "evidence_id"]).select(
        "case_id", F.col("evidence_id").alias("source"), F.col("event_uid").alias("target"),
        F.lit("contains").alias("relation"), F.lit("contains").alias("label"),
        none.alias("correlation_type"), none_d.alias("confidence"),
        F.lit(1).alias("part"), F.coalesce(at, late).alias("o1"), F.col("id").alias("o2"),
        F.lit(0).cast("long").alias("o3"),
    )
    found = links if linked is None else links(shown_events)
    correlated = (
        found.join(shown.select("case_id", F.col("id").alias("event_a_id")), ["case_id", "event_a_id"], "left_semi")
        .join(shown.select("case_id", F.col("id").alias("event_b_id")), ["case_id", "event_b_id"], "left_semi")
        .select("case_id", F.col("event_a_uid").alias("source"), F.col("event_b_uid").alias("target"),
                F.lit("correlated").alias("relation"),
                F.concat("correlation_type", F.lit(" · "), "band").alias("label"),
                "correlation_type", "confidence", F.lit(2).alias("part"),
                F.col("link_rank").cast("long").alias("o1"), F.lit(0).cast("long").alias("o2"),
                F.lit(0).cast("long").alias("o3"))
    )
    all_edges = triggered.unionByName(contains).unionByName(correlated).dropDuplicates(
        ["case_id", "source", "target", "relation"]
    )
    edges = first_or_all(
        all_edges, ["case_id"], [F.asc("part"), F.asc("o1"), F.asc("o2"), F.asc("o3")],
        p.graph_max_edges, rank="edge_rank",
    )
    node_totals = candidates.groupBy("case_id").agg(F.count("*").alias("nodes_total"))
    edge_totals = all_edges.groupBy("case_id").agg(F.count("*").alias("edges_total"))
    totals = node_totals.join(edge_totals, "case_id", "left").select(
        "case_id", "nodes_total", F.coalesce("edges_total", F.lit(0)).alias("edges_total"),
        ((F.col("nodes_total") > over(p.graph_max_nodes))
         | (F.coalesce("edges_total", F.lit(0)) > over(p.graph_max_edges))).alias("truncated"),
    )
    return Graph(
        nodes.select("case_id", "node_rank", "node_id", "node_type", "label", "detail", "severity", "significance"),
        edges.select("case_id", "edge_rank", "source", "target", "relation", "label", "correlation_type", "confidence"),
        totals,
    )


def table_rows(g: Graph) -> DataFrame:
    """Edges with readable ends."""
    labels = g.nodes.select("case_id", "node_id", "label")
    return (
        g.edges.select("case_id", "edge_rank", "relation", "source", "target")
        .join(labels.select("case_id", F.col("node_id").alias("source"), F.col("label").alias("source_label")),
              ["case_id", "source"])
        .join(labels.select("case_id", F.col("node_id").alias("target"), F.col("label").alias("target_label")),
              ["case_id", "target"])
        .select("case_id", "edge_rank", "source_label", "relation", "target_label")
    )
