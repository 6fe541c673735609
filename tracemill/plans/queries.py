"""Registered queries over the benchmark tables, one per operator."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import adapter
from tracemill.functions import predicates as P
from tracemill.functions.network import external_ip
from tracemill.functions.scores import suspicion
from tracemill.operators import anomaly, graph, groups, links, rules, search, timeline
from tracemill.operators.duplicates import fingerprint, mark_duplicates
from tracemill.operators.features import feature_windows
from tracemill.operators.slices import top_k_per_group
from tracemill.plans import analyze as analyze_plan
from tracemill.plans.analyze import Analysis, analyze
from tracemill.schema import AnomalyParams, LinkParams, RuleParams, ViewParams
from tracemill.session import reliable_checkpoint

# Windows widened to the density of the benchmark events; everything else default.
RULE_PARAMS = RuleParams(
    auth001_min_failures=2, auth001_window_minutes=1440, auth003_window_seconds=3600,
    file001_min_modifications=3, file001_window_minutes=1440,
    file002_min_renames=2, file002_window_minutes=2880, net001_window_minutes=240,
)
LINK_PARAMS = LinkParams()
VIEW_PARAMS = ViewParams()

_stages: dict = {}


def stage(spark: SparkSession, sf_dir: str, name: str, build):
    """A stage's tables, written once per session and table folder and then re-read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stages:
        _stages[key] = build()
    return _stages[key]


def surrogate_scores(events: DataFrame) -> DataFrame:
    """Windows scored by a plain formula in place of the forest, so SQL can repeat it."""
    windows = reliable_checkpoint(feature_windows(events, 5))  # the gate reads them twice
    raw = -(F.col("event_count") * F.col("event_count") + 3 * F.col("distinct_users")
            + F.col("high_severity_count")).cast("double")
    return anomaly.gate(windows.withColumn("raw_score", raw))


def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    def build():
        ev = adapter.events(spark, sf_dir)
        out = analyze(ev, RULE_PARAMS, scored=surrogate_scores(ev))
        return Analysis(
            out.events, out.windows, out.findings,
            reliable_checkpoint(out.finding_events), reliable_checkpoint(out.stats),
        )

    return stage(spark, sf_dir, "analysis", build)


def found_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(
        spark, sf_dir, "links",
        lambda: reliable_checkpoint(links.links(adapter.events(spark, sf_dir), LINK_PARAMS)),
    )


def found_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def build():
        lk = found_links(spark, sf_dir)
        a = analysis(spark, sf_dir)
        tags = a.finding_events.join(
            a.findings.select("case_id", "finding_uid", "severity"), ["case_id", "finding_uid"]
        )
        g, m = groups.groups(a.events, lk, groups.link_components(lk), tags, LINK_PARAMS)
        return g, reliable_checkpoint(m)

    return stage(spark, sf_dir, "groups", build)


# --- all links of a case, whatever the cap of a run -------------------------------------

ALL_LINKS = replace(LINK_PARAMS, max_links=None)


def link_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "link totals", lambda: reliable_checkpoint(links.link_totals(adapter.events(spark, sf_dir), ALL_LINKS)))


def all_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, id, component) of every linked event."""
    return stage(spark, sf_dir, "all components", lambda: reliable_checkpoint(
        groups.session_components(links.dated_events(adapter.events(spark, sf_dir)), ALL_LINKS.window_seconds)))


def groups_of_all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every group with all its members and links."""
    def build():
        a, parts = analysis(spark, sf_dir), all_components(spark, sf_dir)
        tags = a.finding_events.join(a.findings.select("case_id", "finding_uid", "severity"), ["case_id", "finding_uid"])
        counts = links.component_links(adapter.events(spark, sf_dir), parts, ALL_LINKS)
        return groups.groups(a.events, found_links(spark, sf_dir), parts, tags, replace(ALL_LINKS, max_groups=None, max_members=None), counts)

    return stage(spark, sf_dir, "groups of all", build)


def timeline_of_all(spark: SparkSession, sf_dir: str) -> timeline.Timeline:
    """The timeline by all links. Entries shown show the links that the first linked events of a case open, as many as there are entries, so
    none of theirs is missing: an earlier end of such a link is a linked event and thus an entry itself."""
    def build():
        a, ev = analysis(spark, sf_dir), adapter.events(spark, sf_dir)
        linked = all_components(spark, sf_dir)
        dated = links.dated_events(ev).join(linked.select("case_id", "id").distinct(), ["case_id", "id"]).select("case_id", "id", "us").distinct()
        first = top_k_per_group(dated, ["case_id"], [F.asc("us"), F.asc("id")], VIEW_PARAMS.timeline_max)
        return timeline.timeline(a.events, a.findings, a.finding_events, reliable_checkpoint(links.links(ev, ALL_LINKS, first)), VIEW_PARAMS, linked)

    return stage(spark, sf_dir, "timeline of all", build)


def graph_of_all(spark: SparkSession, sf_dir: str) -> graph.Graph:
    """The graph by all links; those drawn are found among the shown events."""
    def build():
        a = analysis(spark, sf_dir)
        return graph.graph(a.events, adapter.evidence(spark, sf_dir), a.findings, a.finding_events,
                           lambda shown: links.links(shown, ALL_LINKS), VIEW_PARAMS, all_components(spark, sf_dir))

    return stage(spark, sf_dir, "graph of all", build)


# --- events and predicates ---------------------------------------------------------


def events_search(spark, d):
    hits = search.search_events(
        adapter.events(spark, d), source_type="authentication", severity="High", host="ws-0"
    )
    return hits.select("id", "event_uid", "case_id", "timestamp", "user", "host", "source_ip")


def events_page(spark, d):
    return search.newest_events(adapter.events(spark, d), limit=100, offset=50).select(
        "id", "event_uid", "case_id", "timestamp"
    )


def external_sources(spark, d):
    ev = adapter.events(spark, d)
    return (
        ev.withColumn("external", external_ip(F.col("source_ip")))
        .groupBy("case_id", "source_ip", "external")
        .agg(F.count("*").alias("events"))
    )


def severity_profile(spark, d):
    ev = adapter.events(spark, d)
    return ev.groupBy("case_id", "severity").agg(
        F.count("*").alias("events"),
        F.round(F.max(P.rule_confidence(F.col("severity"))), 2).alias("confidence"),
        F.max(P.severity_rank(F.col("severity"))).alias("severity_rank"),
    )


def command_indicators(spark, d):
    ev = adapter.events(spark, d).filter(F.col("source_type") == "process")
    line = F.try_element_at("metadata", F.lit("command_line"))
    return (
        ev.select("case_id", F.explode(P.command_tokens(line)).alias("token"))
        .groupBy("case_id", "token").agg(F.count("*").alias("events"))
    )


def dup_mark(spark, d):
    ev = adapter.events(spark, d)
    keyed = ev.withColumn(
        "dedupe_hash",
        fingerprint([F.col("user"), F.col("action"), F.to_date("timestamp")]),
    )
    out = mark_duplicates(keyed, ["case_id", "evidence_id"], "row_index", "event_uid")
    return out.select("id", "event_uid", "evidence_id", "duplicate_of")


# --- windows and scores -------------------------------------------------------------


def _windows(minutes):
    return lambda spark, d: feature_windows(adapter.events(spark, d), minutes)


def window_gate(spark, d):
    return surrogate_scores(adapter.events(spark, d)).select(
        "case_id", "window_start", F.round("score", 6).alias("score"), "flagged", "abstained"
    )


def event_scores(spark, d):
    ev = adapter.events(spark, d)
    return anomaly.annotate_events(ev, surrogate_scores(ev)).select(
        "id", "case_id", "anomaly_score", "is_anomalous"
    )


def iforest(spark, d):
    windows = feature_windows(adapter.events(spark, d), 5)
    return anomaly.score_windows(windows).select(
        "case_id", "window_start", "raw_score", "score", "flagged"
    )


def css_scores(spark, d):
    ev = adapter.events(spark, d)
    base = ev.groupBy("case_id", "user").agg(
        F.max(P.severity_rank(F.col("severity"))).alias("worst"),
        F.count("*").alias("n"),
        F.count_distinct("evidence_id").alias("distinct_evidence"),
    )
    sev = P.severity_of_rank(F.col("worst"))
    css = suspicion(sev, (F.col("n") % 101) / F.lit(100.0), F.col("distinct_evidence"))
    return base.withColumn("c", css).select(
        "case_id", "user", sev.alias("severity"), "distinct_evidence",
        F.col("c.total").alias("css"), F.col("c.band").alias("band"),
    )


# --- rules ----------------------------------------------------------------------------


def _rule(rule_id):
    def run(spark, d):
        found = rules.candidates(adapter.events(spark, d), RULE_PARAMS, (rule_id,))
        return found.select("case_id", "rule_id", "scope_a", "scope_b", "severity", "n", "start_us", "end_us")

    return run


def rule_union_capped(spark, d):
    found = rules.candidates(adapter.events(spark, d), RULE_PARAMS)
    return rules.cap_candidates(found, RULE_PARAMS).select(
        "case_id", "rule_id", "scope_a", "scope_b", "severity", "n", "rule_rank"
    )


def finding_list(spark, d):
    return analysis(spark, d).findings.select(
        "case_id", "finding_uid", "kind", "rule_id", "severity", "event_count", "distinct_evidence",
        "timestamp_start", "timestamp_end", F.round("css", 3).alias("css"),
    )


def finding_members(spark, d):
    return analysis(spark, d).finding_events.select("case_id", "finding_uid", "kind", "id")


def finding_texts(spark, d):
    return analysis(spark, d).findings.filter(F.col("rule_id").isin("AUTH-001", "PROC-001", "FILE-002")).select(
        "case_id", "finding_uid", "explanation", F.array_join("reasons", " ").alias("reasons")
    )


def analysis_stats(spark, d):
    return analysis(spark, d).stats


def top_findings(spark, d):
    return search.ranked_findings(analysis(spark, d).findings, 10).select(
        "case_id", "position", "finding_uid", "severity"
    )


# --- links, groups, timeline, graph -----------------------------------------------------


def complete_analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    """Every finding of every rule and window, ranked and numbered."""
    def build():
        ev = adapter.events(spark, sf_dir)
        out = analyze(ev, replace(RULE_PARAMS, max_findings_per_rule=None), AnomalyParams(max_findings=None), scored=surrogate_scores(ev))
        return Analysis(out.events, out.windows, out.findings, reliable_checkpoint(out.finding_events), out.stats)

    return stage(spark, sf_dir, "complete analysis", build)


def complete_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def build():
        lk, a = found_links(spark, sf_dir), analysis(spark, sf_dir)
        tags = a.finding_events.join(a.findings.select("case_id", "finding_uid", "severity"), ["case_id", "finding_uid"])
        return groups.groups(a.events, lk, groups.link_components(lk), tags, replace(LINK_PARAMS, max_groups=None, max_members=None))

    return stage(spark, sf_dir, "complete groups", build)


def complete_graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    def build():
        a = analysis(spark, sf_dir)
        return graph.graph(a.events, adapter.evidence(spark, sf_dir), a.findings, a.finding_events, found_links(spark, sf_dir),
                           replace(VIEW_PARAMS, graph_max_nodes=None, graph_max_edges=None))

    return stage(spark, sf_dir, "complete graph", build)


def findings_complete(spark, d):
    return complete_analysis(spark, d).findings.select(
        "case_id", "finding_uid", "kind", "rule_id", "severity", "event_count", "distinct_evidence", "timestamp_start", "timestamp_end",
        F.round("css", 3).alias("css"))


def finding_members_complete(spark, d):
    return complete_analysis(spark, d).finding_events.select("case_id", "finding_uid", "kind", "id")


def groups_complete(spark, d):
    return complete_groups(spark, d)[0].select("case_id", "group_uid", "component", "kind", "title", "severity", "members", "link_count", "time_start", "time_end")


def group_members_complete(spark, d):
    return complete_groups(spark, d)[1].select("case_id", "group_uid", "position", "event_uid")


def complete_timeline(spark: SparkSession, sf_dir: str) -> timeline.Timeline:
    def build():
        a = analysis(spark, sf_dir)
        return timeline.timeline(a.events, a.findings, a.finding_events, found_links(spark, sf_dir), replace(VIEW_PARAMS, timeline_max=None))

    return stage(spark, sf_dir, "complete timeline", build)


def timeline_complete(spark, d):
    return complete_timeline(spark, d).entries.select("case_id", "position", "event_uid", "significance", "context", F.size("finding_ids").alias("findings"),
                                F.array_join("correlation_ids", ",").alias("correlation_ids"))


def graph_nodes_complete(spark, d):
    return complete_graph(spark, d).nodes.select("case_id", "node_rank", "node_id", "node_type", "severity", "significance")


def graph_edges_complete(spark, d):
    return complete_graph(spark, d).edges.select("case_id", "edge_rank", "source", "target", "relation")


def event_pages(spark, d):
    return search.event_pages(adapter.events(spark, d), limit=100, offset=50).select("case_id", "position", "total", "event_uid", "timestamp")


def finding_pages(spark, d):
    found = complete_analysis(spark, d).findings
    return search.finding_pages(found, limit=20, offset=5, kind="rule", status="New").select("case_id", "position", "total", "finding_uid", "severity")


def link_pages(spark, d):
    return search.link_pages(found_links(spark, d), limit=200, offset=10, min_confidence=0.5).select("case_id", "position", "total", "correlation_uid", "band")


def group_pages(spark, d):
    return search.group_pages(complete_groups(spark, d)[0], limit=50, offset=1, kind="cross_source").select("case_id", "position", "total", "group_uid", "title")


def rule_catalogue(spark, d):
    """The catalogue with what each rule found in each case."""
    found = complete_analysis(spark, d).findings.filter("kind = 'rule'").groupBy("case_id", "rule_id").agg(F.count("*").alias("findings"))
    listed = rules.rule_catalogue(spark, RULE_PARAMS).select("position", "rule_id", "title", "report_severity", "enabled", F.size("config").alias("settings"))
    return found.join(listed, "rule_id")


def link_list(spark, d):
    return found_links(spark, d).select(
        "case_id", "link_rank", "correlation_uid", "correlation_type", "event_a_id", "event_b_id",
        "time_delta_seconds", "confidence", "band",
        F.array_join("evidence_ids", ",").alias("evidence_ids"),
    )


def link_stats(spark, d):
    return links.link_stats(adapter.events(spark, d), found_links(spark, d), LINK_PARAMS)


def link_counts(spark, d):
    """All links of a case by type and band, whatever the cap of a run."""
    return links.link_counts(adapter.events(spark, d), LINK_PARAMS)


def components(spark, d):
    return groups.link_components(found_links(spark, d))


def session_components(spark, d):
    return groups.session_components(links.dated_events(adapter.events(spark, d)))


def group_list(spark, d):
    g, _ = found_groups(spark, d)
    return g.select(
        "case_id", "group_uid", "component", "kind", "title", "severity", "members", "link_count",
        "time_start", "time_end", F.array_join("evidence_ids", ",").alias("evidence_ids"),
    )


def group_members(spark, d):
    return found_groups(spark, d)[1].select("case_id", "group_uid", "position", "event_uid")


def _timeline(spark, d):
    def build():
        a = analysis(spark, d)
        return timeline.timeline(a.events, a.findings, a.finding_events, found_links(spark, d), VIEW_PARAMS)

    return stage(spark, d, "timeline", build)


def timeline_entries(spark, d):
    return _timeline(spark, d).entries.select(
        "case_id", "position", "event_uid", "significance", "context",
        F.size("finding_ids").alias("findings"), F.array_join("correlation_ids", ",").alias("correlation_ids"),
    )


def timeline_totals(spark, d):
    return _timeline(spark, d).totals


def context_events(spark, d):
    """J7 with a wider radius, uncapped."""
    a = analysis(spark, d)
    flagged = timeline.flagged_events(a.events, a.finding_events, found_links(spark, d))
    return timeline.with_context(flagged, 20).select("case_id", "id", "tagged", "context")


def _graph(spark, d):
    def build():
        a = analysis(spark, d)
        return graph.graph(
            a.events, adapter.evidence(spark, d), a.findings, a.finding_events, found_links(spark, d),
            VIEW_PARAMS,
        )

    return stage(spark, d, "graph", build)


def graph_nodes(spark, d):
    return _graph(spark, d).nodes.select("case_id", "node_rank", "node_id", "node_type", "severity", "significance")


def graph_edges(spark, d):
    return _graph(spark, d).edges.select("case_id", "edge_rank", "source", "target", "relation")


def trace(spark, d):
    a = analysis(spark, d)
    raw = adapter.raw_records(spark, d)
    out = search.trace(a.findings, a.finding_events, a.events, raw, adapter.evidence(spark, d))
    return out.select(
        "case_id", "finding_uid", "event_uid", "timestamp", "evidence_id", "row_index", "content",
        "original_filename",
    )


def finding_index(spark, d):
    a = analysis(spark, d)
    return search.finding_index(a.findings, a.finding_events).select(
        "case_id", "event_uid", "finding_uid", "kind", "rule_id", "severity", "status")


def links_strong(spark, d):
    """Links of one type and band, from the newest run of a case."""
    lk = found_links(spark, d).withColumn("run_uid", F.lit("RUN-1"))
    runs = lk.select("case_id", "run_uid", F.lit("Completed").alias("status")).distinct()
    hits = search.filter_links(search.of_run(lk, runs), correlation_type="CORR-002", band="High")
    return hits.select("case_id", "correlation_uid", "event_a_uid", "event_b_uid")


def timeline_notes(spark, d):
    return timeline.timeline_notes(_timeline(spark, d).totals, analysis(spark, d).events, VIEW_PARAMS).select("case_id", "note")


def model_diagnostics(spark, d):
    return analyze_plan.model_diagnostics(analysis(spark, d).stats).select("case_id", "windows_total", "windows_flagged", "n_estimators", "abstain_reason")


QUERIES = {
    "finding_index": finding_index,
    "links_strong": links_strong,
    "timeline_notes": timeline_notes,
    "model_diagnostics": model_diagnostics,
    "events_search": events_search,
    "events_page": events_page,
    "external_sources": external_sources,
    "severity_profile": severity_profile,
    "command_indicators": command_indicators,
    "dup_mark": dup_mark,
    "feature_windows_5m": _windows(5),
    "feature_windows_10m": _windows(10),
    "window_gate": window_gate,
    "event_scores": event_scores,
    "iforest": iforest,
    "css_scores": css_scores,
    "auth001": _rule("AUTH-001"),
    "auth002": _rule("AUTH-002"),
    "auth003": _rule("AUTH-003"),
    "proc001": _rule("PROC-001"),
    "file001": _rule("FILE-001"),
    "file002": _rule("FILE-002"),
    "net001": _rule("NET-001"),
    "rule_union_capped": rule_union_capped,
    "findings": finding_list,
    "finding_members": finding_members,
    "finding_texts": finding_texts,
    "analysis_stats": analysis_stats,
    "top_findings": top_findings,
    "links": link_list,
    "link_stats": link_stats, "link_counts": link_counts,
    "components": components,
    "session_components": session_components,
    "groups": group_list,
    "group_members": group_members,
    "timeline": timeline_entries,
    "timeline_totals": timeline_totals,
    "context_events": context_events,
    "graph_nodes": graph_nodes, "findings_complete": findings_complete, "finding_members_complete": finding_members_complete,
    "groups_complete": groups_complete, "group_members_complete": group_members_complete, "timeline_complete": timeline_complete,
    "graph_nodes_complete": graph_nodes_complete, "graph_edges_complete": graph_edges_complete, "event_pages": event_pages,
    "finding_pages": finding_pages, "link_pages": link_pages, "group_pages": group_pages, "rule_catalogue": rule_catalogue,
    "graph_edges": graph_edges,
    "trace": trace,
}
