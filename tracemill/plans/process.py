"""Processing run: evidence files to raw records, events and accounting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import predicates as P, records as R
from tracemill.operators.duplicates import fingerprint, mark_duplicates
from tracemill.schema import IngestParams
from tracemill.session import parquet_stage, reliable_checkpoint
from tracemill.sources.decode import PART, Decoded, decode

KEY = ["case_id", "evidence_id"]
@dataclass(frozen=True)
class Processed:
    raw_records: DataFrame  # every record, rejects with their reason
    events: DataFrame       # accepted records in the common schema
    runs: DataFrame         # one accounting row per evidence file
    members: DataFrame      # archive member inventory


def read_records(decoded: Decoded, p: IngestParams = IngestParams()) -> DataFrame:
    """One row per record, mapped to the common schema or carrying a reject reason."""
    typed = decoded.parts.select(
        *PART, "member_path", "parser",
        R.detect_source(
            F.col("columns"),
            F.when(F.col("member_path").isNull(), F.col("declared_type")).otherwise(
                R.name_hint(F.col("member_path"))
            ),
        ).alias("source_type"),
    )
    rows = decoded.records.filter(F.col("row_index") <= p.max_records).join(typed, PART)
    mapped = F.when(
        F.col("parse_error").isNull(),
        R.map_record(R.canonical_fields(F.col("entries")), F.col("source_type")),
    )
    return rows.select(
        *KEY, "member_path", "row_index", F.col("raw").alias("content"), "parse_error", "parser", mapped.alias("m"),
    ).withColumn("reject_reason", F.coalesce("parse_error", "m.reject_reason"))


def file_errors(parts: DataFrame) -> DataFrame:
    """One row per evidence file; ``error`` when it (or an archive member) cannot be read."""
    unknown = (F.size("columns") > 0) & F.col("reject").isNull() & R.detect_source(F.col("columns"), F.lit("")).isNull()
    error = F.coalesce("error", F.when(unknown, F.lit(R.NO_TIMESTAMP)))
    return parts.groupBy(*KEY).agg(
        F.max(error).alias("error"),
        F.sort_array(F.collect_set("parser")).alias("parsers"),
        F.max("member_path").isNotNull().alias("archive"),
        F.flatten(F.collect_set("warnings")).alias("notes"),
        F.sum("n").alias("found"),
    )


def process(
    files: DataFrame, p: IngestParams = IngestParams(), last_ids: DataFrame | None = None
) -> Processed:
    """All evidence files of all cases in one job.

    ``last_ids`` (case_id, last_id) continues the numbering of earlier runs.

    ``files`` has case_id, evidence_id, filename, declared_type, content and
    recorded_sha256. Per-file steps stay bounded by the admission size and the
    record cap; numbering inside a case only sums per-file counts.
    """
    decoded = decode(files, p)
    errors = reliable_checkpoint(file_errors(decoded.parts))
    good = errors.filter("error is null").select(*KEY)
    rows = parquet_stage(read_records(Decoded(decoded.parts.join(good, KEY, "left_semi"), decoded.records), p))

    accepted = rows.filter("reject_reason is null")
    per_file = accepted.groupBy(*KEY).agg(F.count("*").alias("n"))
    before = Window.partitionBy("case_id").orderBy("evidence_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_file.select(*KEY, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    if last_ids is not None:
        offsets = offsets.join(last_ids, "case_id", "left").select(
            *KEY, (F.col("offset") + F.coalesce("last_id", F.lit(0))).alias("offset")
        )
    in_file = Window.partitionBy(*KEY).orderBy("row_index")
    member = F.when(
        F.col("member_path").isNotNull(),
        F.create_map(
            F.lit("member_path"), F.col("member_path"),
            F.lit("member_parser"), F.concat("parser", F.lit("/"), "m.source_type"),
        ),
    ).otherwise(F.create_map().cast("map<string,string>"))
    numbered = accepted.withColumn("n", F.row_number().over(in_file)).join(offsets, KEY)
    shaped = numbered.select(
        (F.col("offset") + F.col("n")).alias("id"),
        P.uid("EVT-", F.col("offset") + F.col("n")).alias("event_uid"),
        *KEY, "row_index",
        *[F.col(f"m.{c}").alias(c) for c in (
            "timestamp", "tz_note", "source_type", "event_type", "user", "host", "source_ip", "destination_ip",
            "process", "file_path", "action", "severity")],
        F.map_concat(F.col("m.metadata"), F.map_filter(member, lambda k, v: v.isNotNull())).alias("metadata"),
    ).withColumn("dedupe_hash", fingerprint())
    shaped = parquet_stage(shaped)  # copies are looked for, marked and counted
    events = mark_duplicates(shaped, KEY, "row_index", "event_uid")

    counts = rows.groupBy(*KEY).agg(
        F.count("*").alias("records_received"),
        F.count_if(F.col("parse_error").isNull()).alias("records_parsed"),
        F.count_if(F.col("reject_reason").isNull()).alias("records_normalized"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("records_rejected"),
        F.min("m.source_type").alias("source_type"),
    )
    copies = events.groupBy(*KEY).agg(F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicates_detected"))
    names = ("records_received", "records_parsed", "records_normalized", "records_rejected", "duplicates_detected", "dropped")
    joined = (
        errors.join(counts, KEY, "left").join(copies, KEY, "left")
        .withColumn("dropped", F.greatest(F.col("found") - p.max_records, F.lit(0)))
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
    )
    truncated = F.col("dropped") > 0
    status = (
        F.when(F.col("error").isNotNull(), "Failed")
        .when((F.col("records_rejected") > 0) | (F.col("records_received") == 0) | truncated, "Partial")
        .otherwise("Completed")
    )
    notes = F.array_compact(F.concat(
        F.coalesce("notes", F.array().cast("array<string>")),
        F.array(F.when(truncated, F.concat(
            F.lit(f"record limit of {p.max_records} reached; "), F.col("dropped").cast("string"),
            F.lit(" remaining records were not processed in this run")))),
    ))
    parser = F.concat(
        F.when(F.col("archive"), "zip").otherwise(F.get("parsers", F.lit(0))), F.lit("/"),
        F.coalesce("source_type", F.lit("generic")),
    )
    runs = joined.select(
        *KEY, F.when(F.col("error").isNull(), parser).alias("parser"), status.alias("status"),
        *names[:5], notes.alias("warnings"), "error",
    )
    members = decoded.parts.filter("member_path is not null").select(
        *KEY, "entry", "member_path", F.col("member_status").alias("status"), "detail", "parser", F.col("n").alias("records"))
    return Processed(
        rows.select(*KEY, "row_index", "member_path", "content", "reject_reason"), events, runs, members
    )


def rejected_view(raw_records: DataFrame, runs: DataFrame) -> DataFrame:
    """Rejected records with the parser of their run."""
    return raw_records.filter("reject_reason is not null").join(
        runs.select(*KEY, "parser", F.col("status").alias("run_status")), KEY, "left"
    )
