"""Event schema and the fixed vocabularies of the trace model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "0.1"

EVENT_FIELDS = {
    "session_id": "string",
    "event_id": "string",
    "parent_event_id": "string",
    "event_type": "string",
    "caused_by": "string",
    "tool_name": "string",
    "tool_input": "string",
    "tool_output": "string",
    "timestamp": "string",
    "duration_ms": "double",
    "model": "string",
    "provider": "string",
    "agent": "string",
}

# Fixed values of the trace format (must match the recorded data).
EVENT_TYPES = ("tool_call", "reasoning", "context_update", "user_input")

TASK_TYPES = (
    "bug_fix",
    "feature_add",
    "refactor",
    "exploration",
    "debug_test",
    "doc_gen",
    "migration",
    "project_init",
    "review",
    "unknown",
)

TASK_SOURCES = (
    "real_work",
    "demo",
    "proxy",
    "routed_prompt_intervention",
    "superpowers_workflow_intervention",
    "controlled_prompt_morphology",
    "unknown",
)

DATA_ORIGINS = ("native", "controlled_benchmark", "external_trajectory", "unknown")

INTERVENTION_LANES = (
    "direct_prompt_native",
    "routed_prompt_intervention",
    "superpowers_workflow_intervention",
    "controlled_prompt_morphology",
)

INTERVENTION_SOURCES = (
    "routed_prompt_intervention",
    "superpowers_workflow_intervention",
    "controlled_prompt_morphology",
)

PROVENANCE_VALUES = (
    "explicit_sidecar",
    "annotation",
    "materialized",
    "inferred_from_runtime_adapter",
    "classified_from_explicit_metadata",
    "unknown",
)

METADATA_FIELDS = {
    "data_origin": "string",
    "runtime": "string",
    "model": "string",
    "task_type": "string",
    "task_source": "string",
    "repo_language": "string",
    "repo_size": "string",
    "success": "boolean",
    "duration": "double",
    "human_intervention": "boolean",
    "intervention_lane": "string",
    "trace_tags": "array<string>",
    "intervention_evidence_source": "string",
    "intervention_evidence_level": "string",
    "behavior_distribution_tag": "string",
    "bde_generated": "boolean",
    "experiment_id": "string",
    "control_group_id": "string",
}

EVENT_SCHEMA = T.StructType(
    [
        T.StructField(name, T.DoubleType() if dtype == "double" else T.StringType())
        for name, dtype in EVENT_FIELDS.items()
    ]
)


def conform_events(df: DataFrame) -> DataFrame:
    """Give a partial event table every field of the model, in order, with defaults."""
    cols = []
    for name, dtype in EVENT_FIELDS.items():
        col = F.col(name).cast(dtype) if name in df.columns else F.lit(None).cast(dtype)
        if name == "event_type":
            col = F.coalesce(col, F.lit("tool_call"))
        cols.append(col.alias(name))
    rest = [c for c in df.columns if c not in EVENT_FIELDS]
    return df.select(*cols, *rest)
