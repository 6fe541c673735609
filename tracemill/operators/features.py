"""Activity windows with 18 counts (A1, A2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.schema import FEATURE_NAMES, SOURCE_TYPES

_DISTINCT = {
    "distinct_users": "user",
    "distinct_hosts": "host",
    "distinct_source_ips": "source_ip",
    "distinct_destination_ips": "destination_ip",
    "distinct_processes": "process",
    "distinct_file_paths": "file_path",
    "distinct_evidence": "evidence_id",
    "distinct_event_types": "event_type",
}


def window_start(ts: Column, minutes: int) -> Column:
    """Floor to the window counted from midnight, for any window length."""
    bucket = F.floor((F.hour(ts) * 60 + F.minute(ts)) / F.lit(minutes)) * F.lit(minutes)
    return F.timestamp_add("MINUTE", bucket, ts.cast("date").cast("timestamp_ntz"))


def feature_windows(events: DataFrame, minutes: int = 5) -> DataFrame:
    """One row per (case, window) that has a dated event.

    Exact distinct counts: Spark expands per counted column and combines
    (window, value) pairs map-side, so a hot window is never held whole.
    """
    ts = F.col("timestamp")
    dated = events.filter(ts.isNotNull()).withColumn("window_start", window_start(ts, minutes))
    aggs = [
        F.count_if(F.col("source_type") == s).alias(f"src_{s}") for s in SOURCE_TYPES
    ]
    aggs += [
        F.count_distinct(F.nullif(F.col(c), F.lit(""))).alias(name) for name, c in _DISTINCT.items()
    ]
    aggs += [
        F.count_if(F.col("severity").isin("High", "Critical")).alias("high_severity_count"),
        F.count_if(F.col("severity") == "Critical").alias("critical_severity_count"),
        F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicate_count"),
    ]
    out = dated.groupBy("case_id", "window_start").agg(F.count("*").alias("event_count"), *aggs)
    return out.select(
        "case_id",
        "window_start",
        F.timestamp_add("MINUTE", F.lit(minutes), F.col("window_start")).alias("window_end"),
        "event_count",
        *FEATURE_NAMES,
    )
