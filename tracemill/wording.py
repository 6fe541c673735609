"""Sentences that appear verbatim in results."""

CORRELATION_NOTE = (
    "Correlation indicates co-occurrence and shared context, not causation. "
    "Requires investigator validation."
)
ANOMALY_NOTE = (
    "The anomaly score indicates statistical deviation from this case's typical event patterns. "
    "It is not proof of malicious activity and requires investigator review."
)
SYNTHETIC_LABEL = "SYNTHETIC / DEMONSTRATION DATA"
SYNTHETIC_MARKERS = ("SYNTHETIC/DEMONSTRATION", "SYNTHETIC / DEMONSTRATION DATA")

PROCESSING_LABELS = ("Not processed", "Failed", "Partial", "In progress", "Completed")
INTEGRITY_LABELS = ("Unverified", "Mismatch", "Partially verified", "Verified")

CONCLUSION_NO_FINDINGS = (
    "No suspicious findings were recorded by the configured forensic analysis pipeline."
)
CONCLUSION_NO_CORRELATION = (
    "The investigation identified suspicious activity in the analyzed evidence, but no "
    "cross-source correlations were recorded."
)
CONCLUSION_WITH_CORRELATION = (
    "The investigation identified suspicious activity with supporting cross-source relationships "
    "in the analyzed evidence."
)
CONCLUSION_INSUFFICIENT = (
    "The available evidence does not support a definitive conclusion from the current prototype "
    "analysis."
)
HIGH_SEVERITY_NOTE = (
    "High-severity findings require investigator review and contextual interpretation."
)
NO_ANALYSIS = "No analysis result is currently available."
TRACE_UNAVAILABLE = "Trace unavailable for this finding."
ML_STATEMENT = (
    "The ML component identified statistically unusual activity relative to the configured "
    "detection strategy; these are statistical signals requiring investigator review, not proof "
    "of malicious activity."
)
ML_STATEMENT_ABSTAINED = (
    "Anomaly detection abstained for this case, so no ML conclusion was produced and no ML "
    "finding was created."
)
ML_STATEMENT_NO_FINDINGS = (
    "The ML component ran without abstaining, and no ML findings were recorded for this case."
)
LIMITATIONS = (
    "This is a research prototype, not a certified forensic or legal-admissibility system.",
    "SHA-256 verification only proves the current bytes match the recorded reference; it does not "
    "authenticate origin, collection, or custody.",
    "ML anomaly scores are statistical deviations from this case's typical event pattern; they are "
    "not proof of malicious activity.",
    "Composite Suspicion Scores are uncalibrated heuristic composites, not probabilities.",
    "All findings require investigator review and validation before any action is taken.",
    "This report reflects only the evidence ingested and processed in this case up to the "
    "generation time.",
)
REPORT_TITLE = "Digital Forensic Investigation Report"
REPORT_VERSION = "1.0"
TRACE_STEPS = (
    "Finding", "Reason", "Forensic Event", "Raw Record", "Evidence File", "Recorded SHA-256",
)

ANSWER_INSUFFICIENT = (
    "I could not find sufficient evidence in this case to answer that question."
)
ANSWER_UNSUPPORTED = (
    "This question is outside the currently supported investigation assistant capabilities."
)
ANSWER_EMPTY_CASE = "No forensic evidence is currently available for this case."
ANSWER_FOOTER = (
    "Answers are constructed only from processed case evidence. No generative model is enabled."
)

ALTERED_FILE = (
    "Evidence integrity mismatch — processing aborted because the stored file no longer matches its "
    "recorded SHA-256."
)
EMPTY_FILE = "evidence file is empty"
UNKNOWN_FORMAT = "unsupported evidence format; expected CSV, JSON, or a ZIP archive of those"
NO_COLUMNS = "evidence header could not be read; no usable column names found"
MALFORMED_JSON = "file appears to be JSON but could not be decoded"
EMPTY_ARCHIVE = "archive contains no readable evidence members"
UNKNOWN_MEMBER = "member format not recognised (expected CSV or JSON)"
MALFORMED_MEMBER = "member could not be parsed: malformed JSON"
NO_MEMBER_COLUMNS = "member header could not be read"
NOT_AN_OBJECT = "record is not a JSON object"
FALLBACK_NOTE = "file was not valid UTF-8; decoded using %s fallback"
