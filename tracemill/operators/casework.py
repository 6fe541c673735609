"""Integrity checks, custody, reviews, notes, markers and corpus matching
(C1, C3-C5, P24, J11, J12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.timestamps import strip
from tracemill.operators.slices import slice_of
from tracemill.wording import SYNTHETIC_LABEL

MAX_NOTE, MAX_AUTHOR = 4000, 127
_SEQ_SLICE = 10_000


def verify_integrity(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Recomputed against recorded hash, for every file of the batch.

    Content is hashed in the scan and does not travel through the join.
    """
    hashed = files.select("case_id", "evidence_id", F.sha2("content", 256).alias("computed_hash"))
    expected = manifest.select("case_id", "evidence_id", F.col("sha256").alias("expected_hash"))
    same = F.col("computed_hash") == F.col("expected_hash")
    return hashed.join(expected, ["case_id", "evidence_id"]).withColumn(
        "result", F.when(same, "VERIFIED").otherwise("MISMATCH")
    )


def custody_log(
    uploads: DataFrame | None = None, checks: DataFrame | None = None, runs: DataFrame | None = None,
    analyses: DataFrame | None = None, reviews: DataFrame | None = None, reports: DataFrame | None = None,
) -> DataFrame:
    """Custody entries derived from what the other operators produced.

    Details are JSON text. Timestamps and actors come from the given rows.
    """
    none = F.lit(None).cast("string")
    parts = []

    def entry(df, action, evidence, *details):
        parts.append(df.select(
            "case_id", evidence.alias("evidence_id"), action.alias("action"), "actor", F.col("at"),
            F.to_json(F.struct(*details)).alias("details"),
        ))

    if uploads is not None:
        entry(uploads, F.lit("Evidence Added"), F.col("evidence_id"), "original_filename", "file_size")
        entry(uploads, F.lit("Hash Generated"), F.col("evidence_id"), "sha256")
    if checks is not None:
        good = F.col("result") == "VERIFIED"
        entry(checks, F.when(good, "Integrity Verified").otherwise("Integrity Mismatch"), F.col("evidence_id"),
              "computed_hash", "expected_hash", "result")
    if runs is not None:
        entry(runs, F.lit("Analysis Started"), F.col("evidence_id"), F.lit("process").alias("stage"))
        entry(runs, F.lit("Analysis Completed"), F.col("evidence_id"), "status", "records_received",
              "records_normalized", "records_rejected", "duplicates_detected")
    if analyses is not None:
        entry(analyses, F.lit("Automated Analysis Started"), none, F.col("events_considered").alias("events"))
        entry(analyses, F.lit("Automated Analysis Completed"), none, "rule_findings", "ml_findings",
              "windows_total", "windows_flagged")
    if reviews is not None:
        entry(reviews, F.lit("Investigator Reviewed"), none, "finding_uid", "from_status", "to_status", "note")
    if reports is not None:
        entry(reports, F.lit("Report Generated"), none, "report_uid")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fold_reviews(actions: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C4: (decided actions, final status per finding).

    ``actions``: case_id, finding_uid, seq (bigint order), to_status, author, note.
    A new finding can only go under review; afterwards it moves freely between
    the three other statuses and never back. So nothing counts before the first
    review request, and from then on the state before an action is simply the
    previous request: a lookup to the row before, done per slice of ``seq``
    with the last row of earlier slices carried over.
    """
    key = ["case_id", "finding_uid"]
    moves = F.col("to_status").isin("Under Review", "Confirmed", "Dismissed")
    known = findings.select(*key)
    sliced = actions.withColumn("slice", slice_of(F.col("seq"), _SEQ_SLICE))
    # One row per (finding, slice): everything an action needs from outside its slice.
    per_slice = sliced.groupBy(*key, "slice").agg(
        F.min(F.when(F.col("to_status") == "Under Review", F.col("seq"))).alias("first_here"),
        F.max(F.when(moves, F.struct("seq", "to_status"))).alias("last_move"),
    )
    first = per_slice.groupBy(*key).agg(F.min("first_here").alias("first_seq"))
    reached = F.coalesce(F.col("last_move.seq") >= F.col("first_seq"), F.lit(False))
    earlier = Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    outside = (
        per_slice.join(first, key)
        .join(known.withColumn("known", F.lit(True)), key, "left")
        .withColumn("last_status", F.when(reached, F.col("last_move.to_status")))
        .withColumn("carried", F.last("last_status", ignorenulls=True).over(earlier))
        .drop("first_here", "last_move")
    )
    rows = sliced.join(outside, [*key, "slice"]).withColumn(
        "counts", F.coalesce((F.col("seq") >= F.col("first_seq")) & moves, F.lit(False))
    )
    effect = F.when(F.col("counts"), F.col("to_status"))
    inside = Window.partitionBy(*key, "slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last(effect, ignorenulls=True).over(inside), F.col("carried"), F.lit("New"))
    decided = rows.withColumn("from_status", before).withColumn(
        "reject_code",
        F.when(F.col("known").isNull(), "FINDING_NOT_FOUND")
        .when(F.col("to_status") == F.col("from_status"), "FINDING_STATUS_UNCHANGED")
        .when(~F.col("counts"), "FINDING_STATUS_TRANSITION"),
    ).withColumns({
        "accepted": F.col("reject_code").isNull(),
        "from_status": F.when(F.col("known"), F.col("from_status")),
    })
    final = outside.filter("last_status is not null").groupBy(*key).agg(
        F.max(F.struct("slice", "last_status")).alias("f")
    )
    statuses = known.join(final, key, "left").select(
        *key, F.coalesce("f.last_status", F.lit("New")).alias("status")
    )
    extra = [c for c in ("author", "note") if c in actions.columns]
    return decided.select(*key, "seq", "from_status", "to_status", "accepted", "reject_code", *extra), statuses


def load_notes(notes: DataFrame, findings: DataFrame) -> DataFrame:
    """Trimmed notes with ``reject_reason``; accepted ones have none.

    A pinned finding must exist in the same case.
    """
    pins = findings.select("case_id", "finding_uid", F.lit(True).alias("pin_ok"))
    body = F.coalesce(strip(F.col("body")), F.lit(""))
    author = strip(F.coalesce("author", F.lit("investigator")))
    pin = F.nullif(F.col("finding_uid"), F.lit(""))
    reason = (
        F.when(F.col("body") == "", "Note body must not be empty.")
        .when(F.length("body") > MAX_NOTE, f"Note body exceeds the {MAX_NOTE} character limit.")
        .when(F.length("author") > MAX_AUTHOR, f"Note author exceeds the {MAX_AUTHOR} character limit.")
        .when(F.col("finding_uid").isNotNull() & ~F.col("finding_uid").rlike("^(RFND|MFND)-"),
              "finding_uid must be a RFND- or MFND- finding identifier.")
        .when(F.col("finding_uid").isNotNull() & F.col("pin_ok").isNull(),
              F.concat(F.lit("Finding "), "finding_uid", F.lit(" does not exist in this case.")))
    )
    return (
        notes.withColumns({"body": body, "finding_uid": pin})
        .withColumn("author", F.when(author == "", "investigator").otherwise(author))
        .join(pins, ["case_id", "finding_uid"], "left")
        .withColumn("reject_reason", reason)
        .drop("pin_ok")
    )


def synthetic_cases(cases: DataFrame, evidence: DataFrame, raw_records: DataFrame) -> DataFrame:
    """Cases flagged or carrying the exact marker in any of three texts."""
    has = lambda c: F.contains(F.coalesce(F.col(c), F.lit("")), F.lit(SYNTHETIC_LABEL))
    signals = [
        cases.filter(F.col("demo") | has("description")).select("case_id"),
        evidence.filter(has("source")).select("case_id"),
        raw_records.filter(has("content")).select("case_id"),
    ]
    out = signals[0]
    for more in signals[1:]:
        out = out.unionByName(more)
    return out.distinct()


def match_corpora(evidence: DataFrame, corpora: DataFrame) -> DataFrame:
    """Scenario of each case whose evidence hash is a known corpus file.

    ``corpora``: sha256, scenario, position. The first scenario in order wins.
    """
    return (
        evidence.select("case_id", "sha256").join(corpora, "sha256")
        .groupBy("case_id").agg(F.min(F.struct("position", "scenario")).alias("m"))
        .select("case_id", F.col("m.scenario").alias("scenario"))
    )
