"""Case reports and workspace snapshots as one row per case."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import wording as W
from tracemill.functions import predicates as P
from tracemill.operators import rollups, search
from tracemill.operators.hash_tree import HashTree, hash_tree
from tracemill.operators.slices import top_k_per_group
from tracemill.schema import FINDING_STATUSES
from tracemill.session import small_side

MAX_LISTED, MAX_TRACED, MAX_GRAPH_ROWS, MAX_TRACE_EVENTS = 200, 50, 50, 200

# Fixed value: section order of a report.
SECTIONS = (
    "case_information", "executive_summary", "evidence_inventory", "evidence_integrity", "processing",
    "key_findings", "traceability", "correlations", "activity_groups", "timeline", "graph",
    "machine_learning", "review", "conclusion", "limitations",
)


@dataclass(frozen=True)
class ReportTables:
    """Inputs of a report; every table spans all cases."""

    cases: DataFrame
    evidence: DataFrame
    checks: DataFrame
    runs: DataFrame
    events: DataFrame
    findings: DataFrame
    finding_events: DataFrame
    raw_records: DataFrame
    links: DataFrame
    groups: DataFrame
    entries: DataFrame
    entry_totals: DataFrame
    nodes: DataFrame
    edges: DataFrame
    edge_rows: DataFrame
    graph_totals: DataFrame
    stats: DataFrame
    notes: DataFrame
    synthetic: DataFrame
    link_totals: DataFrame | None = None  # (case_id, links): all links of a case, where ``links`` has only the first ones


def _link_total(t: ReportTables, name: str) -> DataFrame:
    """(case_id, ``name``) of the cases that have links."""
    if t.link_totals is None:
        return rollups.count_by_case(t.links, name)
    return t.link_totals.filter("links > 0").select("case_id", F.col("links").alias(name))


def _listed(df: DataFrame, order: list[Column], limit: int, item: Column, name: str) -> DataFrame:
    """The first ``limit`` rows of a case as one ordered array; bounded by the section's cap."""
    top = top_k_per_group(df, ["case_id"], order, limit, rank="_pos")
    return top.groupBy("case_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", item.alias("item")))), lambda x: x["item"]).alias(name)
    )


def _zero(c: str) -> Column:
    return F.coalesce(c, F.lit(0))


def _integrity_result() -> Column:
    return F.when(F.col("latest") == "VERIFIED", "INTEGRITY VERIFIED").when(
        F.col("latest").isNotNull(), "INTEGRITY MISMATCH").otherwise("NOT VERIFIED")


def evidence_section(t: ReportTables) -> DataFrame:
    item = F.struct("evidence_id", "original_filename", "evidence_type", "file_size", "sha256", "record_count", "status")
    return _listed(t.evidence, [F.asc("evidence_id")], MAX_LISTED, item, "items")


def integrity_section(t: ReportTables) -> DataFrame:
    """Status by precedence no check, mismatch, all verified, not verified."""
    joined = t.evidence.select("case_id", "evidence_id", "original_filename").join(
        rollups.latest_integrity(t.checks).select("case_id", "evidence_id", "latest", "checked_at"),
        ["case_id", "evidence_id"], "left")
    joined = joined.withColumn("result", _integrity_result())
    counts = joined.groupBy("case_id").agg(
        F.count("*").alias("checked_items"),
        F.count_if(F.col("latest") == "VERIFIED").alias("verified_items"),
        F.count_if(F.col("result") == "INTEGRITY MISMATCH").alias("mismatch_items"),
        F.count_if(F.col("latest").isNull()).alias("unverified_items"),
    )
    status = (
        F.when(F.col("unverified_items") == F.col("checked_items"), "NO CHECK AVAILABLE")
        .when(F.col("mismatch_items") > 0, "INTEGRITY MISMATCH")
        .when(F.col("verified_items") == F.col("checked_items"), "INTEGRITY VERIFIED")
        .otherwise("NOT VERIFIED")
    )
    items = _listed(joined, [F.asc("evidence_id")], MAX_LISTED,
                    F.struct("evidence_id", "original_filename", "result", "checked_at"), "items")
    return counts.withColumn("status", status).join(items, "case_id", "left")


def processing_section(t: ReportTables) -> DataFrame:
    item = F.struct("evidence_id", "parser", "status", "records_received", "records_normalized", "records_rejected",
                    "duplicates_detected", "error")
    shown = top_k_per_group(t.runs, ["case_id"], [F.desc("evidence_id")], MAX_LISTED, rank="_pos")
    return shown.groupBy("case_id").agg(
        F.count("*").alias("run_count"),
        *[F.sum(c).alias(c) for c in ("records_received", "records_normalized", "records_rejected")],
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", item.alias("item")))), lambda x: x["item"]).alias("runs"),
    )


def findings_section(t: ReportTables) -> DataFrame:
    item = F.struct("finding_uid", "kind", "title", "severity", "status", "rule_id", "confidence", "css",
                    "event_count", F.col("distinct_evidence").alias("evidence_count"))
    listed = _listed(t.findings, [F.desc("finding_uid")], MAX_LISTED, item, "findings")
    return rollups.review_summary(t.findings).join(listed, "case_id", "left")


def trace_section(t: ReportTables) -> DataFrame:
    """The newest findings with the first events of each down to the file hash.

    Findings and events are cut to what is shown before the chain is joined.
    """
    rows = small_side(top_k_per_group(
        t.findings.select("case_id", "finding_uid"), ["case_id"], [F.desc("finding_uid")], MAX_TRACED, rank="_f"))
    shown = top_k_per_group(
        t.finding_events.join(rows, ["case_id", "finding_uid"]).drop("_f"), ["case_id", "finding_uid"],
        [F.asc("timestamp"), F.asc("id")], MAX_TRACE_EVENTS, rank="_e")
    newest = t.findings.join(rows, ["case_id", "finding_uid"])
    chains = search.trace(newest, shown, t.events, t.raw_records, t.evidence).join(rows, ["case_id", "finding_uid"])
    chains = top_k_per_group(
        chains, ["case_id", "finding_uid"], [F.asc_nulls_last("timestamp"), F.asc("event_uid")], MAX_TRACE_EVENTS, rank="_e")
    step = F.struct("_e", F.struct("event_uid", "timestamp", "row_index", "content", "evidence_id",
                                   "original_filename", "sha256").alias("item"))
    per = chains.groupBy("case_id", "finding_uid", "_f").agg(
        F.first("reason").alias("reason"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("event_uid").isNotNull(), step))), lambda x: x["item"]).alias("linked_events"))
    note = F.when(F.size("linked_events") == 0, W.TRACE_UNAVAILABLE)
    return per.groupBy("case_id").agg(
        F.count("*").alias("traced_findings"),
        F.sort_array(F.collect_list(F.struct("_f", F.struct("finding_uid", "reason", note.alias("note"), "linked_events").alias("t")))).alias("x"),
    ).select("case_id", "traced_findings", F.array(*[F.lit(s) for s in W.TRACE_STEPS]).alias("ladder"),
             F.transform("x", lambda v: v["t"]).alias("traces"))


def report_items(t: ReportTables) -> DataFrame:
    """(case_id, section, item_key, item): every evidence file, integrity result, traced event and review note.

    The complete long form of the lists whose first rows a report shows: one
    row per item with its fields as JSON, so no row grows with its case.
    """
    def rows(df: DataFrame, section: str, key: Column, *fields: str) -> DataFrame:
        return df.select("case_id", F.lit(section).alias("section"), key.cast("string").alias("item_key"),
                         F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("item"))

    checked = t.evidence.select("case_id", "evidence_id", "original_filename").join(
        rollups.latest_integrity(t.checks).select("case_id", "evidence_id", "latest"), ["case_id", "evidence_id"], "left"
    ).withColumn("result", _integrity_result())
    traced = search.trace(t.findings, t.finding_events, t.events, t.raw_records, t.evidence).filter("event_uid is not null")
    return (
        rows(t.evidence, "evidence_inventory", F.col("evidence_id"),
             "original_filename", "evidence_type", "file_size", "sha256", "record_count", "status")
        .unionByName(rows(checked, "evidence_integrity", F.col("evidence_id"), "original_filename", "result"))
        .unionByName(rows(traced, "traceability", F.concat_ws("/", "finding_uid", "event_uid"),
                          "row_index", "content", "evidence_id", "original_filename", "sha256"))
        .unionByName(rows(t.notes, "review", F.col("note_id"), "finding_uid", "author", "body"))
    )


def report_lists(t: ReportTables) -> DataFrame:
    """(case_id, section, item_key, item): every run, finding, link, group, timeline entry and relation.

    With ``report_items`` the complete long form of a report, one row per item;
    complete as far as the given tables are.
    """
    def rows(df: DataFrame, section: str, key: Column, **fields: Column | str) -> DataFrame:
        item = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in fields.items()])
        return df.select("case_id", F.lit(section).alias("section"), key.cast("string").alias("item_key"),
                         F.to_json(item, {"ignoreNullFields": "false"}).alias("item"))

    def same(*names: str) -> dict[str, str]:
        return {c: c for c in names}

    def seconds(c: str) -> Column:
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")

    return (
        rows(t.runs, "processing", F.col("evidence_id"), **same("parser", "status", "records_received", "records_parsed",
             "records_normalized", "records_rejected", "duplicates_detected"))
        .unionByName(rows(t.findings, "key_findings", F.col("finding_uid"), **same("kind", "rule_id", "title", "severity", "status", "confidence"),
                          css=F.round("css", 3), event_count="event_count", evidence_count="distinct_evidence",
                          first_seen=seconds("timestamp_start"), last_seen=seconds("timestamp_end")))
        .unionByName(rows(t.links, "correlations", F.col("correlation_uid"), **same("correlation_type", "event_a_uid", "event_b_uid",
                          "time_delta_seconds", "confidence", "band"), evidence_ids=F.array_join("evidence_ids", ",")))
        .unionByName(rows(t.groups, "activity_groups", F.col("group_uid"), **same("kind", "title", "severity"), event_count="members",
                          correlation_count="link_count", first_seen=seconds("time_start"), last_seen=seconds("time_end")))
        .unionByName(rows(t.entries, "timeline", F.col("position"), **same("event_uid", "significance", "context"), findings=F.size("finding_ids")))
        .unionByName(rows(t.edges, "graph", F.col("edge_rank"), **same("source", "relation", "target")))
    )


def sealed_reports(items: DataFrame, cases: DataFrame, previous: DataFrame, generated_at: str) -> tuple[DataFrame, HashTree]:
    """C19 without a wide row: (one header per case with the digest of all its items, the tree that proves single items).

    ``items`` are rows of (case_id, section, item_key, item), stored beside the
    headers. Reports are numbered after ``previous``. A case without items has
    none and the digest of an empty text; items of unknown cases are sealed nowhere.
    """
    tree = hash_tree(items, ["case_id"], ["section", "item_key"], ["section", "item_key", "item"])
    headers = report_register(cases, previous).join(tree.roots, "case_id", "left").select(
        "case_id", "report_uid", F.lit(W.REPORT_TITLE).alias("title"), F.lit(W.REPORT_VERSION).alias("version"),
        F.lit("Generated").alias("status"), F.lit(generated_at).cast("timestamp_ntz").alias("generated_at"),
        _zero("items").alias("items"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("digest"))
    return headers, tree


def check_seals(headers: DataFrame, items: DataFrame) -> DataFrame:
    """(case_id, report_uid, items, found, intact): whether stored items still give the digest of their header."""
    roots = hash_tree(items, ["case_id"], ["section", "item_key"], ["section", "item_key", "item"]).roots.select(
        "case_id", F.col("items").alias("found"), F.col("digest").alias("now"))
    return headers.join(roots, "case_id", "left").select(
        "case_id", "report_uid", "items", _zero("found").alias("found"),
        (F.col("digest") == F.coalesce("now", F.sha2(F.lit(""), 256))).alias("intact"))


def links_section(t: ReportTables) -> DataFrame:
    item = F.struct("correlation_uid", "correlation_type", "event_a_uid", "event_b_uid", "time_delta_seconds",
                    "confidence", "reason", "evidence_ids")
    total = _link_total(t, "total")
    listed = _listed(t.links, [F.asc("link_rank")], MAX_LISTED, item, "correlations")
    return total.join(listed, "case_id").withColumn("truncated", F.col("total") > MAX_LISTED)


def groups_section(t: ReportTables) -> DataFrame:
    item = F.struct("group_uid", "kind", "title", "severity", "explanation", "time_start", "time_end",
                    F.col("members").alias("event_count"), F.col("link_count").alias("correlation_count"), "evidence_ids")
    total = rollups.count_by_case(t.groups, "total")
    return total.join(_listed(t.groups, [F.asc("group_rank")], MAX_LISTED, item, "groups"), "case_id")


def timeline_section(t: ReportTables) -> DataFrame:
    item = F.struct("timestamp", "event_uid", "source_type", "event_type", "user", "host", "significance", "reasons",
                    "finding_ids", "correlation_ids", "evidence_id", "context")
    listed = _listed(t.entries, [F.asc("position")], 500, item, "entries")
    return t.entry_totals.join(listed, "case_id", "left")


def graph_section(t: ReportTables) -> DataFrame:
    """Node and relation counts and the first readable edges."""
    nodes = rollups.breakdown(t.nodes, "node_type", ("evidence", "finding", "event"), ["case_id"])
    edges = rollups.breakdown(t.edges, "relation", ("contains", "triggered", "correlated"), ["case_id"])
    rows = _listed(t.edge_rows, [F.asc("edge_rank")], MAX_GRAPH_ROWS,
                   F.struct("source_label", "relation", "target_label"), "table_rows")
    return t.graph_totals.select("case_id", "truncated").join(nodes, "case_id", "left").join(
        edges, "case_id", "left").join(rows, "case_id", "left")


def ml_section(t: ReportTables) -> DataFrame:
    """Statement by the latest run of a case."""
    statement = (
        F.when(F.col("windows_total").isNull(), W.NO_ANALYSIS).when(F.col("abstained"), W.ML_STATEMENT_ABSTAINED)
        .when(F.col("ml_findings") > 0, W.ML_STATEMENT).otherwise(W.ML_STATEMENT_NO_FINDINGS)
    )
    return t.cases.select("case_id").join(t.stats, "case_id", "left").withColumn("statement", statement)


def review_section(t: ReportTables) -> DataFrame:
    counts = rollups.breakdown(t.findings, "status", FINDING_STATUSES, ["case_id"])
    notes = _listed(t.notes, [F.asc("created_at"), F.asc("note_id")], MAX_LISTED,
                    F.struct("finding_uid", "author", "body", "created_at"), "notes")
    return counts.join(notes, "case_id", "full")


def conclusion_section(t: ReportTables) -> DataFrame:
    """C18."""
    counts = (
        t.cases.select("case_id")
        .join(rollups.count_by_case(t.evidence, "files"), "case_id", "left")
        .join(rollups.count_by_case(t.events, "events"), "case_id", "left")
        .join(t.findings.groupBy("case_id").agg(F.count("*").alias("found"), F.max(
            P.severity_rank(F.col("severity"))).alias("worst")), "case_id", "left")
        .join(_link_total(t, "link_total"), "case_id", "left")
    )
    statement = (
        F.when(_zero("files") == 0, W.NO_ANALYSIS)
        .when((_zero("events") == 0) & (_zero("found") == 0), W.CONCLUSION_INSUFFICIENT)
        .when(_zero("found") == 0, W.CONCLUSION_NO_FINDINGS)
        .when(_zero("link_total") > 0, W.CONCLUSION_WITH_CORRELATION)
        .otherwise(W.CONCLUSION_NO_CORRELATION)
    )
    return counts.select("case_id", statement.alias("statement"), F.array_compact(
        F.array(F.when(_zero("worst") >= 3, W.HIGH_SEVERITY_NOTE))).alias("notes"))


def summary_section(t: ReportTables) -> DataFrame:
    """Counts and sentences."""
    counts = (
        t.cases.select("case_id")
        .join(rollups.count_by_case(t.evidence, "evidence_files"), "case_id", "left")
        .join(rollups.count_by_case(t.events, "events"), "case_id", "left")
        .join(rollups.review_summary(t.findings).select("case_id", F.col("total").alias("findings"), "high_severity"), "case_id", "left")
        .join(_link_total(t, "correlations"), "case_id", "left")
        .join(rollups.count_by_case(t.groups, "activity_groups"), "case_id", "left")
    )
    names = ("evidence_files", "events", "findings", "high_severity", "correlations", "activity_groups")
    counts = counts.withColumns({c: _zero(c) for c in names})
    text = F.format_string(
        "%d evidence file(s) yielded %d normalized event(s), %d finding(s) (%d high severity), %d correlation(s) "
        "and %d activity group(s).", *names)
    return counts.withColumn("summary", text)


def report_sections(t: ReportTables) -> DataFrame:
    """(case_id, one struct per section)."""
    header = t.cases.join(t.synthetic.select("case_id", F.lit(True).alias("is_synthetic")), "case_id", "left")
    notices = F.array(*[F.lit(x) for x in W.LIMITATIONS])
    made = {
        "executive_summary": summary_section(t), "evidence_inventory": evidence_section(t),
        "evidence_integrity": integrity_section(t), "processing": processing_section(t),
        "key_findings": findings_section(t), "traceability": trace_section(t), "correlations": links_section(t),
        "activity_groups": groups_section(t), "timeline": timeline_section(t), "graph": graph_section(t),
        "machine_learning": ml_section(t), "review": review_section(t), "conclusion": conclusion_section(t),
    }
    label = F.when(F.col("is_synthetic"), W.SYNTHETIC_LABEL)
    out = header.select(
        "case_id",
        F.struct("case_id", "title", "description", "status", "severity", "created_at", "last_activity").alias("case_information"),
        F.struct(notices.alias("notices"), label.alias("synthetic")).alias("limitations"),
    )
    for name, df in made.items():
        packed = df.select("case_id", F.struct(*[c for c in df.columns if c != "case_id"]).alias(name))
        out = out.join(packed, "case_id", "left")
    return out.select("case_id", *SECTIONS)


def report_register(cases: DataFrame, previous: DataFrame) -> DataFrame:
    """(case_id, report_uid) of the next report of each case, numbered after ``previous``; no report is built."""
    last = previous.groupBy("case_id").agg(F.max(F.substring("report_uid", 5, 20).try_cast("int")).alias("last"))
    return cases.select("case_id").join(last, "case_id", "left").select("case_id", P.uid("RPT-", F.coalesce("last", F.lit(0)) + 1).alias("report_uid"))


def snapshots(t: ReportTables, previous: DataFrame, generated_at: str) -> DataFrame:
    """One immutable snapshot row per case, numbered after ``previous``."""
    body = F.to_json(F.struct(*SECTIONS), {"ignoreNullFields": "false"})
    return report_sections(t).join(report_register(t.cases, previous), "case_id").select(
        "case_id", "report_uid",
        F.lit(W.REPORT_TITLE).alias("title"), F.lit(W.REPORT_VERSION).alias("version"),
        F.lit("Generated").alias("status"), F.lit(generated_at).cast("timestamp_ntz").alias("generated_at"),
        body.alias("report_json"), F.sha2(body, 256).alias("content_sha256"),
    )


def workspaces(t: ReportTables) -> DataFrame:
    """C20: headline of every case with its roll-ups and capped previews."""
    headline = (
        rollups.case_headers(t.cases, t.evidence, t.findings)
        .join(rollups.processing_rollup(t.cases, t.runs).select("case_id", F.col("label").alias("processing_status")), "case_id", "left")
        .join(rollups.integrity_headline(t.evidence, t.checks).select("case_id", "integrity_status"), "case_id", "left")
        .join(t.events.groupBy("case_id").agg(F.count("*").alias("event_count"), F.count_if("is_anomalous").alias("anomalous_event_count")), "case_id", "left")
        .join(rollups.review_summary(t.findings).select("case_id", "high_severity", "open_items"), "case_id", "left")
        .join(rollups.count_by_case(t.links, "correlation_count"), "case_id", "left")
        .join(rollups.count_by_case(t.groups, "activity_group_count"), "case_id", "left")
        .join(rollups.evidence_rollup(t.evidence, t.checks).select(
            "case_id", "verified", "mismatch", "unverified", "total_bytes"), "case_id", "left")
    )
    queue = rollups.review_queue(t.findings)
    shown = queue.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(
        F.struct("position", "finding_uid", "severity", "title", "status"))), lambda x: x["finding_uid"]).alias("review_queue"))
    first_links = _listed(t.links, [F.asc("link_rank")], 100, F.col("correlation_uid"), "link_preview")
    numbers = ("event_count", "anomalous_event_count", "high_severity", "open_items", "correlation_count",
               "activity_group_count", "verified", "mismatch", "unverified", "total_bytes")
    unverified = F.coalesce("integrity_status", F.lit(W.INTEGRITY_LABELS[0]))
    nothing = F.array().cast("array<string>")
    return headline.withColumns({c: _zero(c) for c in numbers}).withColumn("integrity_status", unverified).join(
        shown, "case_id", "left").join(first_links, "case_id", "left").withColumns(
        {c: F.coalesce(c, nothing) for c in ("review_queue", "link_preview")})
