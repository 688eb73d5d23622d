"""Call durations, replay rows and attribution of sessions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.columns import input_preview
from skein.operators.ordering import top_rows


def timeline(events: DataFrame) -> DataFrame:
    """Events in order with a flag for calls beyond the session's mean plus two sigma."""
    limits = events.groupBy("session_id").agg(
        F.count("duration_ms").alias("_n"),
        F.avg("duration_ms").alias("_m"),
        F.stddev_pop("duration_ms").alias("_s"),
    )
    slow = (
        (F.col("_n") >= 3)
        & (F.col("duration_ms") != 0)
        & (F.col("duration_ms") > F.col("_m") + 2 * F.col("_s"))
    )
    return events.join(limits, "session_id").select(
        "session_id",
        "pos",
        "event_id",
        "tool_name",
        input_preview("tool_input").alias("input_preview"),
        "duration_ms",
        F.coalesce(slow, F.lit(False)).alias("anomaly"),
    )


def replay_rows(events: DataFrame) -> DataFrame:
    """Each event with its single local parent; a list of parents matches nothing."""
    by_id = events.groupBy("session_id", "event_id").agg(
        F.max_by(F.struct("tool_name", "tool_input"), "pos").alias("_p")
    )
    by_id = by_id.select(
        "session_id",
        F.col("event_id").alias("parent_event_id"),
        F.col("_p.tool_name").alias("parent_tool"),
        input_preview(F.col("_p.tool_input")).alias("parent_input"),
    )
    return events.join(by_id, ["session_id", "parent_event_id"], "left").select(
        "session_id",
        "pos",
        "event_id",
        "tool_name",
        input_preview("tool_input").alias("input_preview"),
        "duration_ms",
        "parent_tool",
        "parent_input",
        "caused_by",
    )


def replay_summary(events: DataFrame) -> DataFrame:
    """Calls and total seconds per session and tool."""
    return events.groupBy("session_id", "tool_name").agg(
        F.count("*").alias("calls"),
        (F.coalesce(F.sum("duration_ms"), F.lit(0.0)) / 1000).alias("total_s"),
    )


def duration_profile(events: DataFrame, top: int = 3) -> DataFrame:
    """Session average and maximum duration next to its slowest tools."""
    tools = events.groupBy("session_id", "tool_name").agg(
        F.count("*").alias("calls"),
        F.count("duration_ms").alias("_n"),
        F.sum("duration_ms").alias("_s"),
        F.max("duration_ms").alias("_x"),
    )
    session = tools.groupBy("session_id").agg(
        (F.sum("_s") / F.sum("_n")).alias("session_avg_ms"), F.max("_x").alias("session_max_ms")
    )
    means = tools.filter("_n > 0").select(
        "session_id", "tool_name", "calls", (F.col("_s") / F.col("_n")).alias("tool_avg_ms")
    )
    ranked = top_rows(means, ["session_id"], [F.desc("tool_avg_ms"), F.col("tool_name")], top)
    return ranked.join(session, "session_id")


def top_tools(events: DataFrame, top: int = 10) -> DataFrame:
    """Most used tools of each session."""
    counts = events.groupBy("session_id", "tool_name").agg(F.count("*").alias("calls"))
    return top_rows(counts, ["session_id"], [F.desc("calls"), F.col("tool_name")], top)


def slow_calls(events: DataFrame, factor: float = 3.0, floor_ms: float = 50.0) -> DataFrame:
    """Calls over ``factor`` times their tool's session average, if that is above the floor.

    Durations are compared in whole nanoseconds, so no sum depends on the order of rows.
    """
    ms = F.col("duration_ms").try_cast("decimal(20,6)")
    sums = events.groupBy("session_id", "tool_name").agg(F.sum(ms).cast("decimal(26,6)").alias("_s"), F.count(ms).cast("decimal(10,0)").alias("_n"))
    times, floor = F.lit(Decimal(str(factor))), F.lit(Decimal(str(floor_ms)))
    mean = (F.col("_s") * 1_000_000).cast("double") / (F.col("_n") * 1_000_000).cast("double")
    return (
        events.join(sums, ["session_id", "tool_name"])
        .filter((ms * F.col("_n") > times * F.col("_s")) & (F.col("_s") > floor * F.col("_n")))
        .select("session_id", "event_id", "tool_name", "duration_ms", mean.alias("tool_avg_ms"))
    )


def session_attribution(events: DataFrame) -> DataFrame:
    """Distinct models, providers and agents of each session."""
    def names(col: str):
        return F.array_join(F.sort_array(F.collect_set(F.nullif(col, F.lit("")))), ",").alias(f"{col}s")

    return events.groupBy("session_id").agg(names("model"), names("provider"), names("agent"))


def list_sessions(events: DataFrame) -> DataFrame:
    """Sessions with size, duration in whole seconds, agent and share of linked events."""
    label = F.coalesce(F.nullif("agent", F.lit("")), F.nullif("provider", F.lit("")))
    span = F.unix_micros(F.max_by("ts", "pos")) - F.unix_micros(F.min_by("ts", "pos"))
    linked = F.count_if(F.coalesce("parent_event_id", F.lit("")) != "")
    agg = events.groupBy("session_id").agg(
        F.count("*").alias("event_count"),
        (span / F.lit(1000000)).cast("bigint").alias("duration_s"),
        F.min_by(label, F.when(label.isNotNull(), F.col("pos"))).alias("_label"),
        F.max(F.lower("tool_name") == "thinking").alias("_thinks"),
        F.floor(linked * 100 / F.count("*")).alias("linked_pct"),
    )
    agent = F.coalesce("_label", F.when(F.col("_thinks"), "claude-code").otherwise("unknown"))
    return agg.withColumn("agent", agent).drop("_label", "_thinks")

