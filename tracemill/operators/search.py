"""Event, finding, link and group lists with filters and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import predicates as P
from tracemill.operators.ranking import MAX_PAGE, order_index
from tracemill.operators.slices import top_k_per_group
from tracemill.session import small_side


def search_events(
    events: DataFrame, *, case_id: str | None = None, source_type: str | None = None,
    event_type: str | None = None, severity: str | None = None, user: str | None = None,
    host: str | None = None, evidence_id: str | None = None, start=None, end=None,
) -> DataFrame:
    """Filters only; each lands in the scan as a pushed predicate where it can."""
    out = events
    equal = {"case_id": case_id, "source_type": source_type, "event_type": event_type,
             "severity": severity, "evidence_id": evidence_id}
    for name, value in equal.items():
        if value is not None:
            out = out.filter(F.col(name) == value)
    for name, value in (("user", user), ("host", host)):
        if value:
            out = out.filter(F.contains(F.lower(name), F.lit(value.lower())))
    if start is not None:
        out = out.filter(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.filter(F.col("timestamp") <= F.lit(end).cast("timestamp_ntz"))
    return out


def page(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """One page; runs as a top-k, not a full sort."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    return df.orderBy(*order).offset(offset).limit(limit)


def newest_events(events: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(events, [F.desc_nulls_last("timestamp"), F.desc("id")], limit, offset)


def page_per_case(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first page of every case at once."""
    return top_k_per_group(df, ["case_id"], order, limit, rank="position")


def event_detail(events: DataFrame, raw_records: DataFrame, evidence: DataFrame) -> DataFrame:
    """Event with its raw record and evidence file."""
    raw = raw_records.select("case_id", "evidence_id", "row_index", "content")
    ev = evidence.select("case_id", "evidence_id", "original_filename", "sha256")
    return events.join(raw, ["case_id", "evidence_id", "row_index"], "left").join(
        ev, ["case_id", "evidence_id"], "left"
    )


def trace(
    findings: DataFrame, finding_events: DataFrame, events: DataFrame, raw_records: DataFrame,
    evidence: DataFrame,
) -> DataFrame:
    """One row per step chain finding → reason → event → raw record → file → hash."""
    head = findings.select(
        "case_id", "finding_uid", "kind", "title", "severity", "status",
        F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array("explanation")).alias("reason"),
    )
    head = small_side(head)
    rows = finding_events.select("case_id", "finding_uid", "id").join(head, ["case_id", "finding_uid"])
    detail = events.select(
        "case_id", "id", "event_uid", "timestamp", "source_type", "event_type", "user", "host", "action",
        "evidence_id", "row_index",
    )
    chains = event_detail(rows.join(detail, ["case_id", "id"]), raw_records, evidence)
    alone = head.join(
        finding_events.select("case_id", "finding_uid").distinct(), ["case_id", "finding_uid"], "left_anti"
    )
    return chains.unionByName(alone, allowMissingColumns=True)


def filter_findings(
    findings: DataFrame, *, kind: str | None = None, severity: str | None = None,
    status: str | None = None, run_uid: str | None = None,
) -> DataFrame:
    out = findings
    for name, value in (("kind", kind), ("severity", severity), ("status", status), ("run_uid", run_uid)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out


def ranked_findings(findings: DataFrame, limit: int) -> DataFrame:
    """O3: most severe first per case, newest uid first among equals."""
    order = [F.desc(P.severity_rank(F.col("severity"))), F.desc("finding_uid")]
    return page_per_case(findings, order, limit)


def latest_per_key(df: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """One row per key, the greatest by ``newest``; a mergeable maximum (no map columns)."""
    rest = [c for c in df.columns if c not in keys and c not in newest]
    best = df.groupBy(*keys).agg(F.max(F.struct(*newest, *rest)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in (*newest, *rest)])


def resolve_run(runs: DataFrame) -> DataFrame:
    """Per case the newest completed run, else the newest one."""
    done = (F.col("status") == "Completed").cast("int").alias("done")
    return latest_per_key(runs.withColumn("done", done), ["case_id"], ["done", "run_uid"]).drop("done")


def of_run(df: DataFrame, runs: DataFrame, run_uid: str | None = None) -> DataFrame:
    """Rows of one run, by default of each case's newest completed run."""
    if run_uid is not None:
        return df.filter(F.col("run_uid") == run_uid)
    return df.join(small_side(resolve_run(runs).select("case_id", "run_uid")), ["case_id", "run_uid"], "left_semi")


def filter_groups(groups: DataFrame, *, kind: str | None = None) -> DataFrame:
    return groups if kind is None else groups.filter(F.col("kind") == kind)


def paged(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """O1: a page of every case with its ``position`` and the case's ``total``."""
    return order_index(df, ["case_id"], order, "position").page(limit, offset)


def event_pages(events: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return paged(events, [F.desc_nulls_last("timestamp"), F.desc("id")], limit, offset)


def finding_pages(findings: DataFrame, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    """Filtered findings, newest uid first."""
    return paged(filter_findings(findings, **filters), [F.desc("finding_uid")], limit, offset)


def link_pages(links: DataFrame, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    return paged(filter_links(links, **filters), [F.asc("correlation_uid")], limit, offset)


def group_pages(groups: DataFrame, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    return paged(filter_groups(groups, **filters), [F.asc("group_uid")], limit, offset)


def filter_links(
    links: DataFrame, *, correlation_type: str | None = None, band: str | None = None,
    min_confidence: float | None = None, event_uid: str | None = None,
) -> DataFrame:
    out = links
    for name, value in (("correlation_type", correlation_type), ("band", band)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    if min_confidence is not None:
        out = out.filter(F.col("confidence") >= min_confidence)
    if event_uid is not None:
        out = out.filter((F.col("event_a_uid") == event_uid) | (F.col("event_b_uid") == event_uid))
    return out


def finding_index(findings: DataFrame, finding_events: DataFrame) -> DataFrame:
    """One row per (event, finding) with what a view says about the finding.

    Pass one run's findings, or every run's to repeat tags on re-analysis.
    """
    tags = small_side(findings.select(
        "case_id", "finding_uid", "rule_id", "title", "severity", "status",
        F.when(F.col("kind") == "ml", F.col("anchor_score")).otherwise(F.col("css")).alias("score"),
    ))
    return finding_events.select("case_id", "finding_uid", "kind", "id", "event_uid").join(
        tags, ["case_id", "finding_uid"]
    )
