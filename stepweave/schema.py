"""Column names and fixed vocabulary of the core tables."""

from __future__ import annotations

#: A sequence: one prompt's chain of steps.
KEY = ("conversation_id", "session_epoch", "prompt_id", "agent_id")
START, END = "Start", "End"
LEVELS = ("class", "class/program", "class/program/ext")

# The closed vocabularies.
ACTIVITY_CLASSES = (
    "Inspection", "Search", "ChangeImplementation", "ArtifactEvaluation", "ScriptExecution", "EnvironmentConfiguration",
    "NetworkRetrieval", "Checkin", "Checkout", "Delegation", "Unknown",
)
PROCESS_TYPES = ("BugFix", "FeatureAddition", "Enhancement", "Investigation", "Documentation", "ReleaseManagement", "Unknown")
OUTCOMES = ("failure", "neutral", "success")
COUNTERS = (
    "annotation_rejected_credential", "annotation_rejected_no_edge", "annotation_rejected_too_long", "backfill_records_skipped",
    "capture_excluded", "capture_payload_malformed", "capture_store_busy", "class_unknown", "enrichment_unavailable",
    "guidance_below_support", "guidance_deadline_exceeded", "guidance_fallback_global", "guidance_over_budget", "guidance_served",
    "guidance_silent", "snapshot_unreadable", "snapshot_write_failed", "snapshot_written", "steps_duplicate", "steps_recorded",
)

# Defaults of the parameters.
TOP_TEMPLATES, SUPPORTING_KEPT, RESULT_CHARS, NOTE_CHARS = 5, 50, 2048, 500
CLEAN_WEIGHT, MIN_SUPPORT, LOOP_LENGTH, BACKOFF_ORDER, HOPS, RRF_K, BUDGET_CHARS = 4.0, 2, 3, 3, 1, 60, 1200
