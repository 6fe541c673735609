"""Table schemas, closed vocabularies and tunable parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- fixed values: vocabularies that results are reported in -----------------
CASE_STATUSES = ("Draft", "Active", "Under Review", "Closed")
SEVERITIES = ("Low", "Medium", "High", "Critical")
SOURCE_TYPES = (
    "authentication", "process", "file_activity", "network", "browser", "system", "generic",
)
EVIDENCE_STATUSES = ("Uploaded", "Verified", "Processing", "Processed", "Analyzed", "Error")
INTEGRITY_RESULTS = ("VERIFIED", "MISMATCH")
CUSTODY_ACTIONS = (
    "Evidence Added", "Hash Generated", "Integrity Verified", "Integrity Mismatch",
    "Integrity Test", "Analysis Started", "Analysis Completed",
    "Automated Analysis Started", "Automated Analysis Completed",
    "Investigator Reviewed", "Report Generated",
)
FINDING_STATUSES = ("New", "Under Review", "Confirmed", "Dismissed")
RUN_STAGES = ("Process", "Analyze", "Correlate", "Report")
RUN_STATUSES = ("Pending", "Running", "Completed", "Failed")
PROCESSING_STATUSES = ("Pending", "Processing", "Completed", "Partial", "Failed")
CORRELATION_TYPES = ("CORR-001", "CORR-002", "CORR-003", "CORR-004", "CORR-005")
CONFIDENCE_BANDS = ("Low", "Medium", "High")
GROUP_KINDS = ("authentication", "process", "file_activity", "network", "cross_source")
SIGNIFICANCES = ("NORMAL", "NOTABLE", "SUSPICIOUS")
FINDING_KINDS = ("rule", "ml")
RULE_IDS = ("AUTH-001", "AUTH-002", "AUTH-003", "PROC-001", "FILE-001", "FILE-002", "NET-001")

FEATURE_NAMES = tuple(f"src_{s}" for s in SOURCE_TYPES) + (
    "distinct_users", "distinct_hosts", "distinct_source_ips", "distinct_destination_ips",
    "distinct_processes", "distinct_file_paths", "distinct_evidence", "distinct_event_types",
    "high_severity_count", "critical_severity_count", "duplicate_count",
)
SEGMENT_LABELS = ("benign", "compromise", "ransomware_like")
# -----------------------------------------------------------------------------

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("event_uid", T.StringType()),
        T.StructField("case_id", T.StringType()),
        T.StructField("evidence_id", T.StringType()),
        T.StructField("row_index", T.LongType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("tz_note", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("process", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("dedupe_hash", T.StringType()),
        T.StructField("duplicate_of", T.StringType()),
    ]
)

RAW_RECORD_SCHEMA = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("evidence_id", T.StringType()),
        T.StructField("row_index", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("reject_reason", T.StringType()),
    ]
)


@dataclass(frozen=True)
class RuleParams:
    """Thresholds of the seven detection rules; defaults are the published ones."""

    max_findings_per_rule: int | None = 10
    auth001_min_failures: int = 3
    auth001_window_minutes: int = 15
    auth002_min_external_logins: int = 3
    auth003_window_seconds: int = 60
    file001_min_modifications: int = 6
    file001_window_minutes: int = 15
    file001_high_min: int = 15
    file002_min_renames: int = 3
    file002_window_minutes: int = 10
    net001_min_connections: int = 2
    net001_window_minutes: int = 15
    disabled: frozenset = field(default_factory=frozenset)


@dataclass(frozen=True)
class AnomalyParams:
    """Window scoring: forest size, both gates and the abstention floor."""

    window_minutes: int = 5
    threshold: float = 0.72
    z_sigmas: float = 2.0
    min_windows: int = 8
    n_estimators: int = 200
    max_samples: int = 256
    seed: int = 42
    high_score: float = 0.9
    max_findings: int | None = 10


@dataclass(frozen=True)
class LinkParams:
    """Correlation window, additive weights and run caps."""

    window_seconds: int = 300
    weight_time: float = 0.25
    weight_host: float = 0.30
    weight_user: float = 0.30
    weight_ip: float = 0.15
    max_links: int | None = 5000
    max_groups: int | None = 50
    max_members: int | None = 200


@dataclass(frozen=True)
class ViewParams:
    """Caps of the timeline, graph, report and answer views."""

    context_minutes: int = 2
    timeline_max: int | None = 500
    graph_max_nodes: int | None = 200
    graph_max_edges: int | None = 500
    top_n: int = 10


@dataclass(frozen=True)
class IngestParams:
    """Admission and archive limits."""

    max_bytes: int = 25 * 1024 * 1024
    max_records: int = 200_000
    raw_chars: int = 64_000
    zip_max_members: int = 200
    zip_max_total: int = 100 * 1024 * 1024
    zip_max_member: int = 25 * 1024 * 1024
    zip_max_ratio: float = 200.0
