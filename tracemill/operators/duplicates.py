"""Duplicate marking (A3): later copies point at the first record, none is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields a record's fingerprint is made of, and the reason text.
FINGERPRINT_FIELDS = (
    "timestamp", "event_type", "user", "host", "action", "source_ip", "destination_ip", "process",
    "file_path",
)
DUPLICATE_REASON = (
    "identical timestamp and entity fields as an earlier record in this evidence file"
)


def fingerprint(columns: list[Column] | None = None) -> Column:
    cols = columns or [F.col(c) for c in FINGERPRINT_FIELDS]
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.sha2(F.concat_ws("|", *text), 256)


def mark_duplicates(
    records: DataFrame, scope: list[str], order: str, uid: str, hash_col: str = "dedupe_hash"
) -> DataFrame:
    """Adds ``duplicate_of`` and ``duplicate_reason``.

    The first record per (scope, fingerprint) is a mergeable minimum; only
    fingerprints seen twice are joined back, so a huge group of copies never
    meets in one task as a window would make it.
    """
    key = [*scope, hash_col]
    firsts = (
        records.groupBy(*key)
        .agg(F.count("*").alias("copies"), F.min(F.struct(order, uid)).alias("first"))
        .filter(F.col("copies") > 1)
        .select(*key, F.col(f"first.{uid}").alias("first_uid"))
    )
    later = F.col("first_uid").isNotNull() & (F.col("first_uid") != F.col(uid))
    return (
        records.drop("duplicate_of").join(firsts, key, "left")
        .withColumn("duplicate_of", F.when(later, F.col("first_uid")))
        .withColumn("duplicate_reason", F.when(later, F.lit(DUPLICATE_REASON)))
        .drop("first_uid")
    )
