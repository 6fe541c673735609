"""Counts per case, global totals, breakdowns and workspace roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import predicates as P
from tracemill.operators.search import latest_per_key
from tracemill.operators.slices import top_k_per_group
from tracemill.wording import INTEGRITY_LABELS, PROCESSING_LABELS

OPEN_STATUSES = ("New", "Under Review")


def count_by_case(df: DataFrame, name: str, where: Column | None = None) -> DataFrame:
    """One mergeable count per case."""
    amount = F.count("*") if where is None else F.count_if(where)
    return df.groupBy("case_id").agg(amount.alias(name))


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """A10: (metric, value) rows, one scan-level aggregate per table."""
    parts = [
        df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def breakdown(df: DataFrame, column: str, vocabulary: tuple[str, ...], keys: list[str] | None = None) -> DataFrame:
    """Counts per value of a closed vocabulary, absent values as 0.

    With ``keys`` the result is one row per key with the vocabulary spread by
    conditional counts; without, one row per value.
    """
    if keys:
        cols = [
            F.count_if(F.col(column) == v).alias(f"{column}_{v.lower().replace(' ', '_')}") for v in vocabulary
        ]
        return df.groupBy(*keys).agg(*cols)
    words = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(vocabulary)], "value string, position int")
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return words.join(counted, "value", "left").select(
        F.lit(column).alias("breakdown"), "value", "position", F.coalesce("n", F.lit(0)).alias("n")
    )


def breakdowns(df: DataFrame, vocabularies: dict[str, tuple[str, ...] | None]) -> DataFrame:
    """(breakdown, value, position, n) for several columns in one scan, by grouping sets.

    Values of a vocabulary that do not occur count 0; others are left out.
    Without a vocabulary (``None``) the occurring values are listed, null too,
    and have no position.
    """
    columns = list(vocabularies)
    bit = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
    of_set = lambda c: F.col("_set") == (1 << len(columns)) - 1 - bit[c]
    grouped = df.select(*columns).groupingSets([[c] for c in columns], *columns).agg(F.grouping_id().alias("_set"), F.count("*").alias("n"))
    counted = grouped.select(
        F.coalesce(*[F.when(of_set(c), F.lit(c)) for c in columns]).alias("breakdown"),
        F.coalesce(*[F.when(of_set(c), F.col(c)) for c in columns]).alias("value"), "n")
    listed = [(c, v, i) for c, words in vocabularies.items() for i, v in enumerate(words or ())]
    words = df.sparkSession.createDataFrame(listed, "breakdown string, value string, position int")
    filled = words.join(counted, ["breakdown", "value"], "left").select("breakdown", "value", "position", F.coalesce("n", F.lit(0)).alias("n"))
    free = [c for c, v in vocabularies.items() if v is None]
    if not free:
        return filled
    return filled.unionByName(counted.filter(F.col("breakdown").isin(*free)).select("breakdown", "value", F.lit(None).cast("int").alias("position"), "n"))


def sums(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(metric, value) rows: the sums of columns over all rows, 0 for an empty table."""
    row = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in columns])
    return row.unpivot([], list(columns), "metric", "value")


def latest_integrity(checks: DataFrame) -> DataFrame:
    """Newest check per evidence with its check counts."""
    counts = checks.groupBy("case_id", "evidence_id").agg(
        F.count("*").alias("checks"),
        F.count_if(F.col("result") == "VERIFIED").alias("verified"),
        F.count_if(F.col("result") == "MISMATCH").alias("mismatch"),
    )
    newest = latest_per_key(
        checks.select("case_id", "evidence_id", "checked_at", "check_id", F.col("result").alias("latest")),
        ["case_id", "evidence_id"], ["checked_at", "check_id"],
    )
    return counts.join(newest.select("case_id", "evidence_id", "latest", "checked_at"), ["case_id", "evidence_id"])


def integrity_by_case(checks: DataFrame) -> DataFrame:
    """Check totals and results per case."""
    return checks.groupBy("case_id").agg(
        F.count("*").alias("integrity_checks"),
        F.count_if(F.col("result") == "VERIFIED").alias("integrity_verified"),
        F.count_if(F.col("result") == "MISMATCH").alias("integrity_mismatch"),
    )


def case_kpis(
    cases: DataFrame, evidence: DataFrame, events: DataFrame, runs: DataFrame, findings: DataFrame,
    links: DataFrame, groups: DataFrame, checks: DataFrame, custody: DataFrame, queries: DataFrame,
    reports: DataFrame, synthetic: DataFrame | None = None,
) -> DataFrame:
    """Pre-aggregated counts joined to the case dimension, zero filled."""
    parts = [
        count_by_case(evidence, "evidence_count"),
        events.groupBy("case_id").agg(
            F.count("*").alias("event_count"), F.count_if("is_anomalous").alias("anomalous_event_count")
        ),
        runs.groupBy("case_id").agg(
            F.count("*").alias("processing_runs"),
            F.sum("records_normalized").alias("records_normalized"),
            F.sum("records_rejected").alias("records_rejected"),
        ),
        findings.groupBy("case_id").agg(
            F.count_if(F.col("kind") == "rule").alias("rule_findings"),
            F.count_if(F.col("kind") == "ml").alias("ml_findings"),
            F.count_if(F.col("status") == "Confirmed").alias("confirmed_findings"),
        ),
        count_by_case(links, "correlations"),
        count_by_case(groups, "activity_groups"),
        integrity_by_case(checks),
        count_by_case(custody, "custody_events"),
        count_by_case(queries, "assistant_queries"),
        count_by_case(reports, "reports"),
    ]
    base = cases.select("case_id", "title", "status", "severity")
    out = reduce(lambda left, right: left.join(right, "case_id", "left"), parts, base)
    numbers = [c for c in out.columns if c not in base.columns]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})
    if synthetic is not None:
        out = out.join(synthetic.select("case_id", F.lit(True).alias("synthetic")), "case_id", "left").withColumn(
            "synthetic", F.coalesce("synthetic", F.lit(False))
        )
    return out


def ml_rollup(runs: DataFrame) -> DataFrame:
    """Over completed analysis runs."""
    done = runs.filter((F.col("stage") == "Analyze") & (F.col("status") == "Completed"))
    return done.agg(
        F.count("*").alias("completed_runs"),
        F.coalesce(F.sum("windows_total"), F.lit(0)).alias("windows_total"),
        F.coalesce(F.sum("windows_flagged"), F.lit(0)).alias("windows_flagged"),
        F.count_if("abstained").alias("abstained_runs"),
    )


def evidence_rollup(evidence: DataFrame, checks: DataFrame) -> DataFrame:
    """Evidence counts and bytes per case with the latest integrity result."""
    joined = evidence.join(latest_integrity(checks).select("case_id", "evidence_id", "latest"),
                           ["case_id", "evidence_id"], "left")
    known = F.coalesce("latest", F.lit("none"))
    return joined.groupBy("case_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "Processed").alias("processed"),
        F.count_if(known == "VERIFIED").alias("verified"),
        F.count_if(known == "MISMATCH").alias("mismatch"),
        F.count_if(~known.isin("VERIFIED", "MISMATCH")).alias("unverified"),
        F.count_if(F.col("status") == "Error").alias("failed"),
        F.sum("file_size").alias("total_bytes"),
    )


def processing_rollup(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """Sums over runs and one label per case, worst status first."""
    none, failed, partial, busy, completed = PROCESSING_LABELS
    status = F.col("status")
    per_case = runs.groupBy("case_id").agg(
        F.count("*").alias("runs"),
        F.count_distinct("evidence_id").alias("evidence_processed"),
        *[F.sum(c).alias(c) for c in ("records_received", "records_parsed", "records_normalized",
                                      "records_rejected", "duplicates_detected")],
        F.bool_or(status == "Failed").alias("any_failed"),
        F.bool_or(status == "Partial").alias("any_partial"),
        F.bool_or(status.isin("Pending", "Processing")).alias("any_busy"),
    )
    label = (
        F.when(F.col("runs").isNull(), none).when(F.col("any_failed"), failed).when(F.col("any_partial"), partial)
        .when(F.col("any_busy"), busy).otherwise(completed)
    )
    out = cases.select("case_id").join(per_case, "case_id", "left").withColumn("label", label)
    numbers = ("runs", "evidence_processed", "records_received", "records_parsed", "records_normalized",
               "records_rejected", "duplicates_detected")
    return out.select("case_id", "label", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])


def review_summary(findings: DataFrame) -> DataFrame:
    """Totals by severity and status."""
    return findings.groupBy("case_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("severity").isin("Critical", "High")).alias("high_severity"),
        F.count_if(F.col("status").isin(*OPEN_STATUSES)).alias("open_items"),
        F.count_if(F.col("kind") == "rule").alias("rule_findings"),
        F.count_if(F.col("kind") == "ml").alias("ml_findings"),
    )


def review_queue(findings: DataFrame, limit: int = 50) -> DataFrame:
    """Open findings, most severe first, then by uid (creation order)."""
    open_items = findings.filter(F.col("status").isin(*OPEN_STATUSES))
    order = [F.desc(P.severity_rank(F.col("severity"))), F.asc("finding_uid")]
    return top_k_per_group(open_items, ["case_id"], order, limit, rank="position")


def integrity_headline(evidence: DataFrame, checks: DataFrame) -> DataFrame:
    """Any recorded mismatch wins; otherwise by how many latest results are good."""
    unverified, mismatch, partial, verified = INTEGRITY_LABELS
    joined = evidence.select("case_id", "evidence_id").join(latest_integrity(checks), ["case_id", "evidence_id"], "left")
    per_case = joined.groupBy("case_id").agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("checks"), F.lit(0)).alias("checks"),
        F.coalesce(F.sum("mismatch"), F.lit(0)).alias("mismatches"),
        F.count_if(F.col("latest") == "VERIFIED").alias("good"),
    )
    label = (
        F.when(F.col("checks") == 0, unverified).when(F.col("mismatches") > 0, mismatch)
        .when(F.col("good") < F.col("files"), partial).otherwise(verified)
    )
    return per_case.select("case_id", "files", "checks", label.alias("integrity_status"))


def case_headers(cases: DataFrame, evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """A20."""
    return (
        cases.join(count_by_case(evidence, "evidence_count"), "case_id", "left")
        .join(count_by_case(findings, "finding_count"), "case_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("evidence_count", "finding_count")})
    )
