"""Before/after hook records of tool calls, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.ordering import running_last
from skein.sources.agents import kept_keys
from skein.sources.raw import finish, placed

# Arguments kept from hook payloads.
HOOK_INPUT_KEYS = (
    "command",
    "file_path",
    "pattern",
    "url",
    "query",
    "old_string",
    "new_string",
    "tool_slug",
    "arguments",
    "prompt",
)
OUTPUT_LIMIT = 500


def hook_input(name: str) -> Column:
    """Kept arguments of a hook record, as JSON text."""
    return F.coalesce(kept_keys(F.try_parse_json(name), HOOK_INPUT_KEYS), F.lit("{}"))


def hook_output(name: str) -> Column:
    """Start of the output, or of the whole result where it names none."""
    out = F.try_variant_get(F.try_parse_json(name), "$.output", "string")
    return F.substring(F.coalesce(out, name), 1, OUTPUT_LIMIT)


def hook_time(name: str) -> Column:
    return F.date_format(F.timestamp_millis(name), "yyyy-MM-dd'T'HH:mm:ss.SSS")


def pair_hooks(raw: DataFrame) -> DataFrame:
    """Completed calls: each after-record with the latest open before-record of its tool.

    ``raw`` has ``session_id``, ``line_no`` (arrival order), ``arrived_ms``,
    ``hook_event_name``, ``tool_name``, ``tool_input`` and ``tool_result`` (JSON text).
    A second before-record replaces an open one; an after-record without one is dropped.
    The parent is the last call completed when the before-record arrived.
    """
    df = raw.withColumn("at", F.col("line_no") + 1)
    is_pre = F.col("hook_event_name") == "PreToolUse"
    is_post = F.col("hook_event_name") == "PostToolUse"
    mark = F.struct(
        is_pre.alias("open"), F.col("line_no").alias("pre_line"), F.col("arrived_ms").alias("pre_ms")
    )
    df = running_last(
        df.filter(is_pre | is_post), {"before": mark}, ["session_id", "tool_name"], "at", inclusive=False
    )
    done = is_post & F.coalesce(F.col("before.open"), F.lit(False))
    new_id = F.concat(F.col("session_id"), F.lit(":"), F.col("line_no").cast("string"))
    df = df.withColumn("event_id", F.when(done, new_id))
    df = running_last(df, {"last_done": F.col("event_id")}, ["session_id"], "at", inclusive=False)
    pres = df.filter(is_pre).select(
        "session_id", F.col("line_no").alias("pre_line"), F.col("last_done").alias("parent_event_id")
    )
    events = (
        df.filter("event_id IS NOT NULL")
        .withColumn("pre_line", F.col("before.pre_line"))
        .join(pres, ["session_id", "pre_line"])
        .select(
            "session_id",
            "line_no",
            F.lit(0).alias("part"),
            "event_id",
            "parent_event_id",
            "tool_name",
            hook_input("tool_input").alias("tool_input"),
            hook_output("tool_result").alias("tool_output"),
            hook_time("arrived_ms").alias("timestamp"),
            (F.col("arrived_ms") - F.col("before.pre_ms")).cast("double").alias("duration_ms"),
            F.lit("claude-code").alias("agent"),
        )
    )
    return finish(placed(events))
