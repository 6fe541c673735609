"""Batch question answering over case tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import predicates as P
from tracemill.operators import rollups
from tracemill.operators.slices import top_k_per_group
from tracemill.schema import ViewParams
from tracemill.session import reliable_checkpoint
from tracemill.wording import ANSWER_EMPTY_CASE, ANSWER_INSUFFICIENT, ANSWER_UNSUPPORTED

# --- fixed values: identifiers and keyword rules, first match wins ------------------
REFERENCES = {
    "finding_ref": r"\b(rfnd-\d{6}|mfnd-\d{6})\b",
    "event_ref": r"\b(evt-\d{5,7})\b",
    "correlation_ref": r"\b(cor-\d{6})\b",
    "group_ref": r"\b(grp-\d{6})\b",
    "time_ref": r"\b(\d{1,2}:\d{2})\b",
}
TRACE_WORDS = ("trace", "where does", "come from", "provenance", "backing")
KEYWORDS = (
    ("REVIEW_QUEUE", (
        "need review", "needs review", "pending review", "to review", "unreviewed", "unresolved", "outstanding",
        "still new", "need to be reviewed", "need investigator review", "needs investigator review",
        "must be reviewed", "require review", "requires review", "awaiting review")),
    ("ML_EXPLANATION", (
        "abstain", "abstention", "machine learning", "model flag", "anomaly", "statistical", "did the ml")),
    ("INTEGRITY_STATUS", (
        "integrity", "sha-256", "sha256", "sha 256", "hash", "unchanged", "not modified", "tamper", "verified",
        "verification", " verify")),
    ("PROCESSING_STATUS", (
        "processing", "parse", "normaliz", "accepted records", "rejected", "duplicate", "ingest", "run status",
        "end-to-end")),
    ("CORRELATION_SUMMARY", (
        "correlat", "related activity", "related events", "same host", "same user", "same source ip",
        "involved the same", "link to each other", "related to each other", "which user", "what user",
        "which host", "which source ip", "account was involved", "who was involved", "what was involved")),
    ("GROUP_SUMMARY", ("activity group", "groups", "cluster", "grouping")),
    ("TIMELINE_CONTEXT", (
        "timeline", "what happened", "what occurred", "around ", "before the", "precede", "followed",
        "sequence of", "context around")),
    ("TOP_FINDINGS", (
        "suspicious", "finding", "detected", "alert", "threat", "important", "abnormal", "anomalous activity",
        "what was flagged")),
    ("CASE_SUMMARY", (
        "summary", "overview", "about this case", "describe", "describe the case", "status of the case",
        "what is this case", "case status")),
    ("CAPABILITIES", (
        "what can you", "what do you do", "how can you help", "capabilit", "what questions", "help me")),
)
CAPABILITY_TOPICS = (
    "case summary", "suspicious findings", "finding explanations", "evidence support", "timeline activity",
    "correlations", "investigation groups", "ML anomaly reasoning", "evidence integrity", "processing status",
    "investigator review status",
)
NO_LINKS = "No correlations have been produced yet. Run the correlation stage over the processed evidence."
NO_GROUPS = "No investigation groups have been produced yet. Run the correlation stage over the processed evidence."
NO_ANALYSIS_RUN = "No automated analysis has been run yet for this case."
NO_REVIEW = "No findings have been produced yet, so nothing requires review."
# -------------------------------------------------------------------------------------


def _has(text: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def classify(questions: DataFrame, question: str = "question") -> DataFrame:
    """Adds ``intent`` and the recognised references (upper case)."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), r"(?U)\s+", " "))
    out = questions.withColumn("_text", text)
    refs = {
        name: F.upper(F.nullif(F.regexp_extract("_text", pattern, 1), F.lit("")))
        for name, pattern in REFERENCES.items()
    }
    out = out.withColumns(refs)
    t = F.col("_text")
    finding = F.col("finding_ref").isNotNull()
    intent = (
        F.when(t == "", "UNKNOWN")
        .when(F.col("event_ref").isNotNull(), "TIMELINE_CONTEXT")
        .when(finding & _has(t, *TRACE_WORDS), "FINDING_TRACE")
        .when(finding & _has(t, "evidence", "support"), "EVIDENCE_SUPPORT")
        .when(finding, "FINDING_EXPLANATION")
        .when(_has(t, "why was") & _has(t, "finding"), "FINDING_EXPLANATION")
        .when(_has(t, "evidence") & _has(t, "support"), "EVIDENCE_SUPPORT")
    )
    also = {
        "ML_EXPLANATION": t.rlike(r"\bml\b"),
        "CORRELATION_SUMMARY": F.col("correlation_ref").isNotNull(),
        "TIMELINE_CONTEXT": F.col("time_ref").isNotNull(),
    }
    for name, words in KEYWORDS:
        test = _has(t, *words)
        intent = intent.when(test | also[name] if name in also else test, name)
    return out.withColumn("intent", intent.otherwise("UNKNOWN")).drop("_text")


@dataclass(frozen=True)
class CaseTables:
    """What answers are built from; every table spans all cases."""

    cases: DataFrame
    evidence: DataFrame
    findings: DataFrame
    finding_events: DataFrame
    events: DataFrame
    entries: DataFrame
    links: DataFrame
    groups: DataFrame
    stats: DataFrame
    checks: DataFrame
    runs: DataFrame


def _say(*parts) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("")) for x in parts])


def _facts(df: DataFrame, intent: str, ref: Column, part: int, order: Column, line: Column,
           kind: Column | None = None, source: Column | None = None, solid: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        "case_id", F.lit(intent).alias("intent"), ref.alias("ref"), F.lit(part).alias("part"),
        order.cast("string").alias("ord"), line.alias("line"),
        (none if kind is None else kind).alias("source_type"), (none if source is None else source).alias("source_id"),
        (F.lit(part > 0) if solid is None else solid).alias("solid"),
    )


def _heading(c: str = "") -> Column:
    col = lambda n: F.col(f"{c}{n}")
    return F.when(col("kind") == "ml", _say("ML finding ", col("finding_uid"), " (severity ", col("severity"), ") - ", col("title"))).otherwise(
        _say("Finding ", col("finding_uid"), " (rule ", col("rule_id"), ", severity ", col("severity"), ") - ", col("title")))


def _evidence_line() -> Column:
    return _say(F.col("evidence_id"), ": ", F.col("original_filename"), " (", F.col("evidence_type"), "; ",
                F.coalesce(F.col("record_count").cast("string"), F.lit("?")), " records)")


def facts(t: CaseTables, p: ViewParams = ViewParams()) -> DataFrame:
    """Fact lines per (case, intent, ref); lists hold ``top_n`` rows.

    ``ref`` is '' for questions without an identifier.
    """
    top, blank = p.top_n, F.lit("")
    parts = []
    headers = rollups.case_headers(t.cases, t.evidence, t.findings)
    parts.append(_facts(headers, "CASE_SUMMARY", blank, 0, F.lit("0"), _say(
        "Case ", F.col("case_id"), ": ", F.col("title"), ". Status: ", F.col("status"), "; overall severity: ",
        F.col("severity"), ". Contains ", F.col("evidence_count"), " evidence file(s) and ", F.col("finding_count"),
        " finding(s) from the automated analysis."), F.lit("case"), F.col("case_id")))
    first_files = top_k_per_group(t.evidence, ["case_id"], [F.asc("evidence_id")], top)
    parts.append(_facts(first_files, "CASE_SUMMARY", blank, 1, F.lpad(F.col("rank").cast("string"), 6, "0"), _evidence_line(),
                        F.lit("evidence"), F.col("evidence_id")))

    worst_first = [F.desc(P.severity_rank(F.col("severity"))), F.asc("finding_uid")]
    important = top_k_per_group(t.findings, ["case_id"], worst_first, top)
    parts.append(_facts(important, "TOP_FINDINGS", blank, 0, F.lpad(F.col("rank").cast("string"), 6, "0"), _heading(),
                        F.lit("finding"), F.col("finding_uid")))

    # The finding of a question without an id is the most severe, newest one.
    best = top_k_per_group(
        t.findings, ["case_id"], [F.desc(P.severity_rank(F.col("severity"))), F.desc("finding_uid")], 1,
    ).select("case_id", "finding_uid", F.lit("").alias("ref"))
    named = t.findings.select("case_id", "finding_uid", F.col("finding_uid").alias("ref")).unionByName(best)
    about = t.findings.join(named, ["case_id", "finding_uid"])
    rows = t.finding_events.join(
        t.events.select("case_id", "id", "source_type", "event_type"), ["case_id", "id"])
    shown = top_k_per_group(rows, ["case_id", "finding_uid"], [F.asc("timestamp"), F.asc("id")], top)
    shown = shown.join(named, ["case_id", "finding_uid"])
    event_line = _say(F.col("event_uid"), ": ", F.col("source_type"), "/", F.col("event_type"))
    pad = F.lpad(F.col("rank").cast("string"), 6, "0")
    files = t.finding_events.select("case_id", "finding_uid", "evidence_id").distinct().join(
        t.evidence.select("case_id", "evidence_id", "original_filename", "evidence_type", "record_count"),
        ["case_id", "evidence_id"])
    files = top_k_per_group(files, ["case_id", "finding_uid"], [F.asc("evidence_id")], top)
    files = files.join(named, ["case_id", "finding_uid"])
    for intent in ("FINDING_EXPLANATION", "FINDING_TRACE", "EVIDENCE_SUPPORT"):
        parts.append(_facts(about, intent, F.col("ref"), 0, F.lit("0"), _heading(), F.lit("finding"), F.col("finding_uid")))
        parts.append(_facts(shown, intent, F.col("ref"), 2, pad, event_line, F.lit("event"), F.col("event_uid")))
    parts.append(_facts(about, "FINDING_EXPLANATION", F.col("ref"), 1, F.lit("0"), _say("Why: ", F.col("explanation"))))
    parts.append(_facts(about.filter("kind = 'rule'"), "FINDING_EXPLANATION", F.col("ref"), 1, F.lit("1"),
                        _say("Reason(s): ", F.array_join("reasons", "; "))))
    for intent in ("FINDING_TRACE", "EVIDENCE_SUPPORT"):
        parts.append(_facts(files, intent, F.col("ref"), 3, F.col("evidence_id"), _evidence_line(),
                            F.lit("evidence"), F.col("evidence_id")))

    when = P.stamp("timestamp")
    who = F.concat_ws("@", "user", "host")
    entry_line = _say(when, " - ", F.col("event_uid"), " [", F.col("source_type"), "/", F.col("event_type"), "]",
                      F.when(who != "", F.concat(F.lit(" ("), who, F.lit(")"))).otherwise(""))
    entries = t.entries.withColumn("line", entry_line).withColumn(
        "flagged", (F.size("finding_ids") > 0) | (F.size("correlation_ids") > 0) | F.col("is_anomalous"))
    flagged = top_k_per_group(entries, ["case_id"], [F.desc("flagged"), F.asc("position")], top)
    any_flag = flagged.groupBy("case_id").agg(F.max("flagged").alias("any_flag"))
    flagged = flagged.join(any_flag, "case_id").filter(F.col("flagged") | ~F.col("any_flag"))
    around = entries.withColumn("at", F.explode(F.sequence(F.lit(-2), F.lit(2)))).select(
        "case_id", (F.col("position") + F.col("at")).alias("center"), "position", "line", "event_uid")
    centers = entries.select("case_id", F.col("position").alias("center"), F.col("event_uid").alias("ref"))
    around = around.join(centers, ["case_id", "center"])
    minute = entries.withColumn("ref", P.clock("timestamp"))
    minute = top_k_per_group(minute, ["case_id", "ref"], [F.asc("position")], top)
    order = F.lpad(F.col("position").cast("string"), 6, "0")
    for df, ref in ((flagged, blank), (around, F.col("ref")), (minute, F.col("ref"))):
        parts.append(_facts(df, "TIMELINE_CONTEXT", ref, 0, order, F.col("line"), F.lit("event"), F.col("event_uid")))

    link_line = _say(F.col("correlation_uid"), ": ", F.col("event_a_uid"), " <-> ", F.col("event_b_uid"), " (",
                     F.col("correlation_type"), ", band ", F.col("band"), ") reason: ", F.col("reason"))
    first_links = t.links.filter(F.col("link_rank") <= top)
    for df, ref in ((first_links, blank), (t.links, F.col("correlation_uid"))):
        parts.append(_facts(df, "CORRELATION_SUMMARY", ref, 0, F.col("correlation_uid"), link_line,
                            F.lit("correlation"), F.col("correlation_uid")))
    group_line = _say(F.col("group_uid"), ": ", F.col("title"), " (", F.col("kind"), ", severity ", F.col("severity"),
                      ") ", F.col("explanation"), " members: ", F.col("members"), " events, ", F.col("link_count"), " correlations")
    for df, ref in ((t.groups.filter(F.col("group_rank") <= top), blank), (t.groups, F.col("group_uid"))):
        parts.append(_facts(df, "GROUP_SUMMARY", ref, 0, F.col("group_uid"), group_line, F.lit("group"), F.col("group_uid")))

    parts.append(_facts(t.stats, "ML_EXPLANATION", blank, 0, F.lit("0"), _say(
        "The latest automated analysis produced ", F.col("rule_findings"), " rule finding(s) and ",
        F.col("ml_findings"), " ML finding(s).",
        F.when(F.col("abstained"), " The ML anomaly detector abstained for this run - no ML finding was created.").otherwise(""))))
    ml = t.findings.filter("kind = 'ml'")
    parts.append(_facts(ml, "ML_EXPLANATION", blank, 1, F.col("finding_uid"), _say(
        F.col("finding_uid"), " - ", F.col("title"), " (score ", F.format_string("%.3f", "anchor_score"), ")"),
        F.lit("finding"), F.col("finding_uid")))

    newest = [F.desc("finding_uid")]
    waiting = top_k_per_group(t.findings.filter("status = 'New'"), ["case_id"], newest, top)
    counts = rollups.breakdown(t.findings, "status", ("New", "Under Review", "Confirmed", "Dismissed"), ["case_id"])
    parts.append(_facts(counts, "REVIEW_QUEUE", blank, 0, F.lit("0"), _say(
        F.col("status_new"), " finding(s) still need investigator review. Review status distribution: Confirmed=",
        F.col("status_confirmed"), ", Dismissed=", F.col("status_dismissed"), ", New=", F.col("status_new"),
        ", Under Review=", F.col("status_under_review"), ".")))
    parts.append(_facts(waiting, "REVIEW_QUEUE", blank, 1, F.lpad(F.col("rank").cast("string"), 6, "0"), _say(
        F.col("finding_uid"), " (", F.col("severity"), ") - ", F.col("title"), " [", F.col("status"), "]"),
        F.lit("finding"), F.col("finding_uid")))

    latest = t.evidence.select("case_id", "evidence_id", "original_filename").join(
        rollups.latest_integrity(t.checks).select("case_id", "evidence_id", "latest"), ["case_id", "evidence_id"], "left")
    state = F.when(F.col("latest") == "VERIFIED", "verified").when(F.col("latest").isNull(), "pending").otherwise("MISMATCH")
    latest = latest.withColumn("state", state)
    summed = latest.groupBy("case_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("verified", "pending", "MISMATCH")])
    parts.append(_facts(summed, "INTEGRITY_STATUS", blank, 0, F.lit("0"), _say(
        "Evidence integrity verification (SHA-256): verified: ", F.col("verified"), " file(s), pending verification: ",
        F.col("pending"), " file(s), hashes that did not match: ", F.col("MISMATCH"), " file(s)")))
    each = top_k_per_group(latest, ["case_id", "state"], [F.asc("evidence_id")], top)
    parts.append(_facts(each, "INTEGRITY_STATUS", blank, 1,
                        F.concat(F.when(F.col("state") == "verified", "0").when(F.col("state") == "MISMATCH", "1").otherwise("2"), F.col("evidence_id")),
                        _say(F.col("state"), " ", F.col("evidence_id"), ": ", F.col("original_filename")),
                        F.when(F.col("state") == "verified", "evidence"),
                        F.when(F.col("state") == "verified", F.col("evidence_id")), F.col("state") != "pending"))

    done = rollups.processing_rollup(t.cases, t.runs)
    by_status = t.runs.groupBy("case_id", "status").agg(F.count("*").alias("n")).groupBy("case_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat("status", F.lit("="), F.col("n").cast("string")))), ", ").alias("by_status"))
    done = done.join(by_status, "case_id", "left")
    parts.append(_facts(done, "PROCESSING_STATUS", blank, 0, F.lit("0"), _say(
        "Processing runs: ", F.col("runs"), " (", F.col("by_status"), "); ", F.col("records_parsed"), " records parsed, ",
        F.col("records_normalized"), " normalized, ", F.col("records_rejected"), " rejected, ",
        F.col("duplicates_detected"), " duplicates detected.",
        F.when(F.col("runs") == 0, " No evidence has been processed yet for this case.").otherwise(""))))
    ran = done.filter("runs > 0").select("case_id")
    parts.append(_facts(first_files.join(ran, "case_id", "left_semi"), "PROCESSING_STATUS", blank, 1, F.lpad(F.col("rank").cast("string"), 6, "0"),
                        _evidence_line(), F.lit("evidence"), F.col("evidence_id")))
    return reduce(DataFrame.unionByName, parts)


_FIXED = {
    "CAPABILITIES": ("I can currently answer questions about: " + ", ".join(CAPABILITY_TOPICS), "HIGH"),
    "UNKNOWN": (ANSWER_UNSUPPORTED, "LOW"),
}
_EMPTY = {"CORRELATION_SUMMARY": NO_LINKS, "GROUP_SUMMARY": NO_GROUPS, "REVIEW_QUEUE": NO_REVIEW, "ML_EXPLANATION": NO_ANALYSIS_RUN}


def answers(classified: DataFrame, t: CaseTables, p: ViewParams = ViewParams()) -> DataFrame:
    """One answer per question: fact lines, sources and confidence.

    Facts are folded to one row per (case, intent, ref) first; the questions
    then meet them in one equi join, however many questions there are.
    """
    lines = reliable_checkpoint(facts(t, p))
    line = F.struct("part", "ord", "line")
    source = F.struct("part", "ord", "source_type", "source_id")
    folded = lines.groupBy("case_id", "intent", "ref").agg(
        F.sort_array(F.collect_list(line)).alias("ls"),
        F.sort_array(F.collect_list(F.when(F.col("source_id").isNotNull(), source))).alias("ss"),
        F.max("solid").alias("solid"),
    ).select(
        "case_id", "intent", "ref", "solid",
        F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("body"),
        F.slice(F.array_distinct(F.transform("ss", lambda x: F.concat(x["source_type"], F.lit(":"), x["source_id"]))), 1, p.top_n).alias("sources"),
    )
    has_files = t.evidence.groupBy("case_id").agg(F.count("*").alias("files"))
    wants = F.coalesce(
        F.when(F.col("intent") == "TIMELINE_CONTEXT", F.coalesce("event_ref", F.when(
            F.col("time_ref").isNotNull(), F.lpad("time_ref", 5, "0")))),
        F.when(F.col("intent").isin("FINDING_EXPLANATION", "FINDING_TRACE", "EVIDENCE_SUPPORT"), F.col("finding_ref")),
        F.when(F.col("intent") == "CORRELATION_SUMMARY", F.col("correlation_ref")),
        F.when(F.col("intent") == "GROUP_SUMMARY", F.col("group_ref")),
        F.lit(""),
    )
    # A timeline question whose anchor is unknown falls back to the flagged entries.
    known = folded.select("case_id", "intent", F.col("ref").alias("wanted"), F.lit(True).alias("known"))
    asked = (
        classified.withColumn("wanted", wants).join(known, ["case_id", "intent", "wanted"], "left")
        .withColumn("ref", F.when((F.col("intent") == "TIMELINE_CONTEXT") & F.col("known").isNull(), "").otherwise(F.col("wanted")))
        .join(has_files, "case_id", "left")
        .join(folded, ["case_id", "intent", "ref"], "left")
    )
    empty = F.coalesce("files", F.lit(0)) == 0
    fixed = F.col("intent").isin(*_FIXED)
    missing = F.coalesce(P.lookup(F.col("intent"), _EMPTY), F.lit(ANSWER_INSUFFICIENT))
    body = (
        F.when(fixed, P.lookup(F.col("intent"), {k: v[0] for k, v in _FIXED.items()}))
        .when(empty, ANSWER_EMPTY_CASE)
        .otherwise(F.coalesce("body", missing))
    )
    thin = F.col("intent").isin("ML_EXPLANATION", "REVIEW_QUEUE", "INTEGRITY_STATUS", "FINDING_EXPLANATION",
                                "FINDING_TRACE", "EVIDENCE_SUPPORT", "CASE_SUMMARY", "PROCESSING_STATUS")
    confidence = (
        F.when(fixed, P.lookup(F.col("intent"), {k: v[1] for k, v in _FIXED.items()}))
        .when(empty | F.col("body").isNull(), "LOW")
        .when(thin & ~F.col("solid"), "MEDIUM")
        .otherwise("HIGH")
    )
    none = F.array().cast("array<string>")
    return asked.withColumns(
        {
            "answer": body,
            "confidence": confidence,
            "sources": F.when(fixed | empty, none).otherwise(F.coalesce("sources", none)),
        }
    ).drop("wanted", "known", "files", "body", "solid")


def history(log: DataFrame, limit: int = 100) -> DataFrame:
    """Newest questions per case."""
    return top_k_per_group(log, ["case_id"], [F.desc("asked_at"), F.desc("question_id")], limit,
                           rank="position")
