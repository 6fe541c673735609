"""Registered case-work queries: reviews, notes, custody, roll-ups, answers, reports, classifier."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill import adapter
from tracemill.operators import casework, graph, rollups, search
from tracemill.operators.features import feature_windows
from tracemill.plans import assistant, classifier, report
from tracemill.plans import queries as Q
from tracemill.plans.ingest_queries import csv_run
from tracemill.schema import FINDING_KINDS, FINDING_STATUSES, INTEGRITY_RESULTS, PROCESSING_STATUSES, RUN_STATUSES, SEVERITIES
from tracemill.session import parquet_stage, reliable_checkpoint, shared_folder
from tracemill.sources.commits import CommitLog
from tracemill.sources.evidence_files import split_new
from tracemill.sources.sinks import pinned_evidence, rebuildable

# --- inputs derived from the benchmark tables ----------------------------------------

TALK = """SELECT conv_id, turn, role, text, conv_id * 100 + turn AS n,
 'CASE-2024-' || lpad(CAST((conv_id + turn) % 4 + 1 AS STRING), 3, '0') AS case_id,
 'RFND-' || lpad(CAST(conv_id * 7 % 60 + 1 AS STRING), 6, '0') AS finding_uid FROM {source}"""


def talk(spark, d) -> DataFrame:
    return spark.sql(TALK, source=adapter.read(spark, d, "conversations"))


def review_actions(spark, d) -> DataFrame:
    wanted = F.array(*[F.lit(s) for s in ("Under Review", "Confirmed", "Under Review", "Dismissed", "New")])
    pick = ((F.col("conv_id") * 3 + F.col("turn") * 2) % 5 + 1).cast("int")
    return talk(spark, d).select(
        "case_id", "finding_uid", F.col("n").alias("seq"), F.element_at(wanted, pick).alias("to_status"),
        F.col("role").alias("author"), F.col("text").alias("note"))


def note_rows(spark, d) -> DataFrame:
    k = F.col("n") % 6
    return talk(spark, d).select(
        "case_id", F.col("n").alias("note_id"),
        F.when(k == 0, None).when(k == 1, "XX-1").when(k == 2, "RFND-999999").otherwise(F.col("finding_uid")).alias("finding_uid"),
        F.when(F.col("n") % 10 == 3, "  ").when(F.col("n") % 10 == 4, F.repeat("text", 30)).otherwise(F.concat(F.lit(" "), "text", F.lit("\n"))).alias("body"),
        F.when(F.col("role") == "system", "").otherwise(F.col("role")).alias("author"),
        F.timestamp_add("MINUTE", F.col("n"), F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")).alias("created_at"))


def checks(spark, d) -> DataFrame:
    """One integrity check per login event; files of other sources stay unchecked."""
    ev = adapter.events(spark, d).filter(F.col("source_type").isin("authentication", "process"))
    bad = (F.col("id") % 101 == 0) & (F.col("case_id") == "CASE-2024-001")
    return ev.select("case_id", "evidence_id", F.col("id").alias("check_id"), F.col("timestamp").alias("checked_at"),
                     F.when(bad, "MISMATCH").otherwise("VERIFIED").alias("result"))


def questions(spark, d) -> DataFrame:
    forms = ("{t}", "Why was {f} flagged?", "Where does {f} come from? {t}", "Which evidence supports {f}", "what happened around 10:30",
             "Show EVT-000{e}", "Which host was involved in the same host links?", "Explain COR-000001", "list the activity groups",
             "Did the ML abstain?", "Is the evidence integrity verified?", "processing status please", "what needs review",
             "give me an overview", "what can you do", "important findings")
    fill = lambda s: F.replace(F.replace(F.replace(F.lit(s), F.lit("{t}"), F.col("text")), F.lit("{f}"), F.lower("finding_uid")),
                               F.lit("{e}"), F.lpad((F.col("n") % 900 + 1).cast("string"), 3, "0"))
    forms = F.array(*[fill(s) for s in forms])
    return talk(spark, d).select("case_id", F.col("n").alias("question_id"), F.get(forms, (F.col("n") % 16).cast("int")).alias("question"))


# --- queries ----------------------------------------------------------------------------


def review_fold(spark, d):
    return casework.fold_reviews(review_actions(spark, d), Q.analysis(spark, d).findings)[0].select(
        "case_id", "finding_uid", "seq", "from_status", "to_status", "accepted", "reject_code")


def review_status(spark, d):
    return casework.fold_reviews(review_actions(spark, d), Q.analysis(spark, d).findings)[1]


def notes_load(spark, d):
    return casework.load_notes(note_rows(spark, d), Q.analysis(spark, d).findings).select(
        "case_id", "note_id", "finding_uid", "author", F.length("body").alias("length"), "reject_reason")


def notes_newest(spark, d):
    good = casework.load_notes(note_rows(spark, d), Q.analysis(spark, d).findings).filter("reject_reason is null")
    return search.page_per_case(good, [F.desc("created_at"), F.desc("note_id")], 20).select("case_id", "position", "note_id")


def _custody(spark, d) -> DataFrame:
    actor, at = F.lit("system").alias("actor"), F.lit("2024-02-01").cast("timestamp_ntz").alias("at")
    ck = checks(spark, d).withColumns({"computed_hash": F.lit("c"), "expected_hash": F.lit("e"), "actor": F.lit("system"), "at": F.col("checked_at")})
    up = adapter.evidence(spark, d).select("*", actor, F.col("uploaded_at").alias("at"))
    done = casework.fold_reviews(review_actions(spark, d), Q.analysis(spark, d).findings)[0].filter("accepted").select("*", F.col("author").alias("actor"), at)
    return casework.custody_log(
        uploads=up, checks=ck, runs=csv_run(spark, d).runs.select("*", actor, at),
        analyses=Q.analysis(spark, d).stats.select("*", actor, at), reviews=done)


def custody_log(spark, d):
    return _custody(spark, d).groupBy("case_id", "action").agg(F.count("*").alias("entries"))


def synthetic_cases(spark, d):
    mark = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("x SYNTHETIC / DEMONSTRATION DATA "), "url")).otherwise(F.col("url"))
    raw = adapter.read(spark, d, "pages").select(
        F.concat(F.lit("CASE-2024-"), F.lpad((F.col("page_id") % 3 + 1).cast("string"), 3, "0")).alias("case_id"), mark.alias("content"))
    return casework.synthetic_cases(adapter.cases(spark, d), adapter.evidence(spark, d), raw)


def corpus_match(spark, d):
    ev = adapter.evidence(spark, d)
    number = F.substring("evidence_id", 4, 4).cast("int")
    corpora = ev.filter(F.col("case_id") != "CASE-2024-004").select(
        "sha256", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), number % 3 + 1).alias("scenario"), (number % 3).alias("position"))
    return casework.match_corpora(ev, corpora)


def evidence_append(spark, d):
    """Half of the manifest is known already."""
    ev = adapter.evidence(spark, d)
    known = ev.filter(F.substring("evidence_id", 4, 4).cast("int") % 2 == 0)
    fresh, conflict = split_new(ev, known)
    return fresh.select("case_id", "evidence_id", F.lit("append").alias("outcome")).unionByName(
        conflict.select("case_id", "evidence_id", F.lit("conflict").alias("outcome")))


def history_pins(spark, d):
    _, members = Q.found_groups(spark, d)
    return pinned_evidence(adapter.events(spark, d), Q.found_links(spark, d), Q.analysis(spark, d).finding_events, members)


def committed_events(spark, d):
    """All events in one commit, every second evidence replaced by its critical events in the next unless pinned, both given twice."""
    events = adapter.events(spark, d).select("case_id", "evidence_id", "id", "severity")
    log = CommitLog(spark, f"{shared_folder(spark)}/logs/{uuid.uuid4().hex}")
    even = events.filter(F.substring("evidence_id", 4, 4).cast("int") % 2 == 0)
    pinned = even.filter(F.col("case_id") == "CASE-2024-003").select("case_id", "evidence_id").distinct()
    free = rebuildable(even, pinned)
    runs = lambda df: df.groupBy("case_id", "evidence_id").agg(F.count("*").alias("rows"))
    for key in ("first", "first", "second", "second"):
        df = events if key == "first" else free.filter(F.col("severity") == "Critical")
        log.commit(key, {"events": df}, {"runs": runs(events if key == "first" else free)}, None if key == "first" else free)
    now = log.current("events", events.schema).groupBy("case_id", "evidence_id", "commit").agg(F.count("*").alias("events"), F.sum("id").alias("ids"))
    seen = log.history("runs", runs(events).schema).groupBy("case_id", "evidence_id").agg(F.count("*").alias("runs"), F.sum("rows").alias("rows"))
    return seen.join(now, ["case_id", "evidence_id"], "left")


def latest_checks(spark, d):
    return rollups.latest_integrity(checks(spark, d)).select("case_id", "evidence_id", "checks", "verified", "mismatch", "latest")


def integrity_headline(spark, d):
    return rollups.integrity_headline(adapter.evidence(spark, d), checks(spark, d))


def evidence_rollup(spark, d):
    return rollups.evidence_rollup(adapter.evidence(spark, d), checks(spark, d))


def review_queue(spark, d):
    return rollups.review_queue(Q.analysis(spark, d).findings).select("case_id", "position", "finding_uid", "severity")


def review_summary(spark, d):
    return rollups.review_summary(Q.analysis(spark, d).findings)


def finding_breakdown(spark, d):
    f = Q.analysis(spark, d).findings
    return rollups.breakdowns(f, {"severity": SEVERITIES, "status": FINDING_STATUSES, "kind": FINDING_KINDS})


def status_breakdown(spark, d):
    """Runs, custody and integrity checks by status."""
    done = F.lit("Completed")
    tables = [
        (Q.analysis(spark, d).stats, "analysis_runs", done, RUN_STATUSES), (link_runs(spark, d), "correlation_runs", done, RUN_STATUSES),
        (csv_run(spark, d).runs, "processing_runs", F.col("status"), PROCESSING_STATUSES), (_custody(spark, d), "custody", F.col("action"), None),
        (checks(spark, d), "integrity", F.col("result"), INTEGRITY_RESULTS)]
    return reduce(DataFrame.unionByName, [
        rollups.breakdowns(df.select(value.alias(name)), {name: words}) for df, name, value, words in tables])


def link_runs(spark, d) -> DataFrame:
    """One linking run per case that has events."""
    return adapter.cases(spark, d).join(adapter.events(spark, d).select("case_id").distinct(), "case_id", "left_semi")


def case_headers(spark, d):
    return rollups.case_headers(adapter.cases(spark, d), adapter.evidence(spark, d), Q.analysis(spark, d).findings).select(
        "case_id", "title", "status", "severity", "evidence_count", "finding_count")


def totals(spark, d):
    a = Q.analysis(spark, d)
    return rollups.totals({
        "cases": adapter.cases(spark, d), "evidence": adapter.evidence(spark, d), "events": a.events, "findings": a.findings,
        "finding_events": a.finding_events, "links": Q.found_links(spark, d), "groups": Q.found_groups(spark, d)[0],
        "integrity_checks": checks(spark, d), "notes": note_rows(spark, d), "runs": csv_run(spark, d).runs})


def _reports(spark, d) -> DataFrame:
    return report.report_register(adapter.cases(spark, d), spark.createDataFrame([], "case_id string, report_uid string"))


def dashboard_totals(spark, d):
    """A10: rows of every table, and what processing read and kept."""
    a, runs = Q.analysis(spark, d), csv_run(spark, d).runs
    counts = rollups.totals({
        "cases": adapter.cases(spark, d), "evidence": adapter.evidence(spark, d), "raw_records": adapter.raw_records(spark, d), "forensic_events": a.events,
        "processing_runs": runs, "analysis_runs": a.stats, "correlation_runs": link_runs(spark, d), "correlations": Q.found_links(spark, d),
        "investigation_groups": Q.found_groups(spark, d)[0], "integrity_checks": checks(spark, d), "custody_events": _custody(spark, d),
        "rule_findings": a.findings.filter("kind = 'rule'"), "ml_findings": a.findings.filter("kind = 'ml'"), "assistant_queries": questions(spark, d),
        "investigation_reports": _reports(spark, d),
        "investigator_notes": casework.load_notes(note_rows(spark, d), a.findings).filter("reject_reason is null")})
    return counts.unionByName(rollups.sums(runs, ("records_received", "records_normalized", "records_rejected", "duplicates_detected")))


def kpis(spark, d):
    a = Q.analysis(spark, d)
    return rollups.case_kpis(
        adapter.cases(spark, d), adapter.evidence(spark, d), a.events, csv_run(spark, d).runs, a.findings,
        Q.found_links(spark, d), Q.found_groups(spark, d)[0], checks(spark, d), _custody(spark, d), questions(spark, d),
        _reports(spark, d))


def ml_rollup(spark, d):
    runs = Q.analysis(spark, d).stats.withColumns({"stage": F.lit("Analyze"), "status": F.lit("Completed")})
    return rollups.ml_rollup(runs)


def run_resolution(spark, d):
    """Days as runs; a day with an odd count did not complete."""
    ev = adapter.events(spark, d)
    runs = ev.groupBy("case_id", F.date_format("timestamp", "yyyyMMdd").alias("run_uid")).agg(F.count("*").alias("n"))
    return search.resolve_run(runs.withColumn("status", F.when(F.col("n") % 2 == 1, "Failed").otherwise("Completed")))


def intent_classify(spark, d):
    return assistant.classify(questions(spark, d)).select("question_id", "intent", "finding_ref", "event_ref", "correlation_ref", "time_ref")


def _case_tables(spark, d) -> assistant.CaseTables:
    a = Q.analysis(spark, d)
    return assistant.CaseTables(
        adapter.cases(spark, d), adapter.evidence(spark, d), a.findings, a.finding_events, a.events, Q._timeline(spark, d).entries,
        Q.found_links(spark, d), Q.found_groups(spark, d)[0], a.stats, checks(spark, d), csv_run(spark, d).runs)


def _answers(spark, d) -> DataFrame:
    return Q.stage(spark, d, "answers", lambda: reliable_checkpoint(
        assistant.answers(assistant.classify(questions(spark, d)), _case_tables(spark, d))))


def answer_batch(spark, d):
    return _answers(spark, d).select("case_id", "question_id", "intent", "confidence", "answer", "sources")


def answer_confidence(spark, d):
    return _answers(spark, d).groupBy("intent", "confidence").agg(F.count("*").alias("questions"))


def answer_history(spark, d):
    log = _answers(spark, d).withColumn("asked_at", F.col("question_id"))
    return assistant.history(log, 10).select("case_id", "position", "question_id", "intent")


def _report_tables(spark, d, all_links: bool = False) -> report.ReportTables:
    """``all_links``: totals, groups, timeline and graph by all links of a case, of which ``links`` lists the first ones."""
    a = Q.analysis(spark, d)
    tl, g = (Q.timeline_of_all, Q.graph_of_all) if all_links else (Q._timeline, Q._graph)
    tl, g = tl(spark, d), g(spark, d)
    ev, cases = adapter.evidence(spark, d), adapter.cases(spark, d)
    notes = casework.load_notes(note_rows(spark, d), a.findings).filter("reject_reason is null")
    synthetic = casework.synthetic_cases(cases, ev, adapter.raw_records(spark, d))
    return report.ReportTables(
        cases, ev, checks(spark, d), csv_run(spark, d).runs, a.events, a.findings, a.finding_events, adapter.raw_records(spark, d),
        Q.found_links(spark, d),
        (Q.groups_of_all if all_links else Q.found_groups)(spark, d)[0], tl.entries, tl.totals, g.nodes, g.edges, graph.table_rows(g), g.totals,
        a.stats, notes, synthetic, Q.link_totals(spark, d) if all_links else None)


def report_snapshot(spark, d):
    none = spark.createDataFrame([], "case_id string, report_uid string")
    return Q.stage(spark, d, "reports", lambda: reliable_checkpoint(
        report.snapshots(_report_tables(spark, d, all_links=True), none, "2024-03-01 00:00:00")))


def report_summary(spark, d):
    return report.summary_section(_report_tables(spark, d, all_links=True))


def report_conclusion(spark, d):
    return report.conclusion_section(_report_tables(spark, d)).select("case_id", "statement", F.array_join("notes", " ").alias("notes"))


def report_integrity(spark, d):
    return report.integrity_section(_report_tables(spark, d)).select(
        "case_id", "status", "checked_items", "verified_items", "mismatch_items", "unverified_items")


def report_trace(spark, d):
    rows = report.trace_section(_report_tables(spark, d)).select("case_id", "traced_findings", F.explode("traces").alias("t"))
    return rows.select("case_id", "traced_findings", "t.finding_uid", F.size("t.linked_events").alias("linked_events"))


def report_items(spark, d):
    return report.report_items(_report_tables(spark, d))


def _whole_report(spark, d) -> report.ReportTables:
    """The tables of a report with groups, timeline and graph complete."""
    return replace(_report_tables(spark, d), groups=Q.complete_groups(spark, d)[0], entries=Q.complete_timeline(spark, d).entries,
                   edges=Q.complete_graph(spark, d).edges)


def report_lists(spark, d):
    return report.report_lists(_whole_report(spark, d))


def _sealed(spark, d) -> tuple[DataFrame, DataFrame]:
    """Headers and stored items of the long reports."""
    def build():
        t = _whole_report(spark, d)
        items = parquet_stage(report.report_items(t).unionByName(report.report_lists(t)))
        return report.sealed_reports(items, t.cases, spark.createDataFrame([], "case_id string, report_uid string"), "2024-03-01 00:00:00")[0], items

    return Q.stage(spark, d, "sealed reports", build)


def report_seals(spark, d):
    """Digest of every long report."""
    return _sealed(spark, d)[0].select("case_id", "report_uid", "items", "digest")


def report_seal_check(spark, d):
    """Long reports of which the first case lost its review notes and the second had a status changed."""
    headers, items = _sealed(spark, d)
    lost = (F.col("case_id") == "CASE-2024-001") & (F.col("section") == "review")
    edited = F.when((F.col("case_id") == "CASE-2024-002") & (F.col("section") == "key_findings"), F.replace("item", F.lit("New"), F.lit("Confirmed")))
    return report.check_seals(headers, items.filter(~lost).withColumn("item", F.coalesce(edited, "item")))


def report_graph(spark, d):
    return report.graph_section(_report_tables(spark, d)).drop("table_rows")


def workspace(spark, d):
    return report.workspaces(_report_tables(spark, d)).select(
        "case_id", "processing_status", "integrity_status", "evidence_count", "event_count", "anomalous_event_count", "finding_count",
        "high_severity", "open_items", "correlation_count", "activity_group_count", "verified", "mismatch", "unverified", "total_bytes",
        F.element_at("review_queue", 1).alias("next_review"), F.size("link_preview").alias("links_shown"))


def labelled_windows(spark, d) -> DataFrame:
    """M8 on the event cases: two scenario anchors inside the month, one benign case."""
    windows = feature_windows(adapter.events(spark, d), 10)
    plan = adapter.cases(spark, d).select(
        "case_id",
        F.when(F.col("case_id") == "CASE-2024-001", "benign").when(F.col("case_id") == "CASE-2024-002", "compromise").otherwise("ransomware_like").alias("label"),
        F.when(F.col("case_id") == "CASE-2024-001", "2099-01-01 00:00:00").when(F.col("case_id") == "CASE-2024-002", "2024-01-10 12:00:00")
        .otherwise("2024-01-20 00:00:00").cast("timestamp_ntz").alias("anchor"))
    return classifier.label_windows(windows, plan)


def segment_labels(spark, d):
    return labelled_windows(spark, d).groupBy("case_id", "label").agg(F.count("*").alias("windows"))


def segment_features(spark, d):
    cols = classifier.feature_columns()
    return labelled_windows(spark, d).select("case_id", "window_start", *[F.round(c, 6).alias(n) for n, c in cols.items()])


def segment_guard(spark, d):
    return classifier.guard(labelled_windows(spark, d)).withColumn("baseline_accuracy", F.round("baseline_accuracy", 6))


def segment_split(spark, d):
    parts = classifier.stratified_parts(labelled_windows(spark, d), 4)
    return parts.groupBy("label", "part").agg(F.count("*").alias("windows"))


def _trained(spark, d):
    return Q.stage(spark, d, "classifier", lambda: classifier.evaluate(labelled_windows(spark, d)))


def segment_classifier(spark, d):
    return classifier.results_view(_trained(spark, d).predictions)


def segment_metrics(spark, d):
    return _trained(spark, d).metrics


def segment_confusion(spark, d):
    return _trained(spark, d).confusion


def segment_folds(spark, d):
    return classifier.fold_summary(_trained(spark, d).folds)


QUERIES = {
    "review_fold": review_fold, "review_status": review_status, "notes_load": notes_load, "notes_newest": notes_newest,
    "custody_log": custody_log, "synthetic_cases": synthetic_cases, "corpus_match": corpus_match, "evidence_append": evidence_append,
    "history_pins": history_pins, "committed_events": committed_events, "latest_checks": latest_checks, "integrity_headline": integrity_headline,
    "evidence_rollup": evidence_rollup, "review_queue": review_queue, "review_summary": review_summary,
    "finding_breakdown": finding_breakdown, "status_breakdown": status_breakdown, "case_headers": case_headers,
    "dashboard_totals": dashboard_totals, "totals": totals, "kpis": kpis, "ml_rollup": ml_rollup,
    "run_resolution": run_resolution, "intent_classify": intent_classify, "answer_batch": answer_batch,
    "answer_confidence": answer_confidence, "answer_history": answer_history, "report_snapshot": report_snapshot,
    "report_summary": report_summary, "report_conclusion": report_conclusion, "report_integrity": report_integrity,
    "report_trace": report_trace, "report_items": report_items, "report_lists": report_lists,
    "report_seals": report_seals, "report_seal_check": report_seal_check, "report_graph": report_graph, "workspace": workspace, "segment_labels": segment_labels,
    "segment_features": segment_features, "segment_guard": segment_guard, "segment_split": segment_split,
    "segment_classifier": segment_classifier, "segment_metrics": segment_metrics,
    "segment_confusion": segment_confusion, "segment_folds": segment_folds,
}

