"""Local causal edges and the loop-free views on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SESSION = ("session_id",)


def node_index(events: DataFrame, scope: Sequence[str] = SESSION, pos: str = "pos") -> DataFrame:
    """One row per event id: first position, last recorded tool and timestamp."""
    return events.groupBy(*scope, "event_id").agg(
        F.min(pos).alias("pos"),
        F.max_by("tool_name", pos).alias("tool_name"),
        F.max_by("ts", pos).alias("ts"),
    )


def edges(
    events: DataFrame,
    scope: Sequence[str] = SESSION,
    pos: str = "pos",
    nodes: DataFrame | None = None,
) -> DataFrame:
    """Parent-child edges whose parent lies in the same scope, one per listed parent."""
    scope = list(scope)
    children = events.filter(F.size("parents") > 0).select(
        *scope,
        F.col("event_id").alias("child"),
        F.col(pos).alias("child_pos"),
        F.col("tool_name").alias("child_tool"),
        F.posexplode("parents").alias("parent_idx", "parent"),
    )
    known = node_index(events, scope, pos) if nodes is None else nodes
    parents = known.select(
        *scope,
        F.col("event_id").alias("parent"),
        F.col("pos").alias("parent_pos"),
        F.col("tool_name").alias("parent_tool"),
    )
    return children.join(parents, [*scope, "parent"]).select(
        *scope,
        "child",
        "child_pos",
        "child_tool",
        "parent",
        "parent_pos",
        "parent_tool",
        "parent_idx",
    )


def degrees(events: DataFrame, scope: Sequence[str] = SESSION, pos: str = "pos") -> DataFrame:
    """Every event with its number of local parents and local children."""
    scope = list(scope)
    ends = edges(events, scope, pos)
    marks = ends.select(
        *scope, F.col("child").alias("event_id"), F.lit(1).alias("up"), F.lit(0).alias("down")
    ).unionByName(
        ends.select(
            *scope, F.col("parent").alias("event_id"), F.lit(0).alias("up"), F.lit(1).alias("down")
        )
    )
    counts = marks.groupBy(*scope, "event_id").agg(
        F.sum("up").alias("in_degree"), F.sum("down").alias("fan_out")
    )
    return (
        events.select(*scope, "event_id", F.col(pos).alias("pos"), "tool_name", "ts")
        .join(counts, [*scope, "event_id"], "left")
        .fillna(0, ["in_degree", "fan_out"])
    )


def roots(events: DataFrame, scope: Sequence[str] = SESSION) -> DataFrame:
    """Events without a local parent."""
    ends = edges(events, scope).select(*scope, F.col("child").alias("event_id"))
    return events.join(ends, [*scope, "event_id"], "left_anti").select(
        *scope, "event_id", "tool_name"
    )


def leaves(events: DataFrame, scope: Sequence[str] = SESSION) -> DataFrame:
    """Events without a local child."""
    ends = edges(events, scope).select(*scope, F.col("parent").alias("event_id"))
    return events.join(ends, [*scope, "event_id"], "left_anti").select(
        *scope, "event_id", "tool_name"
    )


def fan_out(events: DataFrame, scope: Sequence[str] = SESSION) -> DataFrame:
    """Number of local children per event and the scope's average and maximum."""
    return degrees(events, scope).groupBy(*scope).agg(
        F.avg("fan_out").alias("fan_out_avg"), F.max("fan_out").alias("fan_out_max")
    )


def fan_out_distribution(events: DataFrame, scope: Sequence[str] = SESSION) -> DataFrame:
    """How many events have 0, 1, 2, ... local children."""
    return (
        degrees(events, scope)
        .groupBy(*scope, F.col("fan_out").alias("children"))
        .agg(F.count("*").alias("events"))
    )


def graph_edges(events: DataFrame, scope: Sequence[str] = SESSION) -> DataFrame:
    """Every listed parent of every event with the parent's tool, ``?`` when external."""
    scope = list(scope)
    listed = events.select(
        *scope,
        "event_id",
        "tool_name",
        F.posexplode_outer("parents").alias("parent_idx", "parent"),
    )
    known = node_index(events, scope).select(
        *scope, F.col("event_id").alias("parent"), F.col("tool_name").alias("parent_tool")
    )
    joined = listed.join(known, [*scope, "parent"], "left")
    return joined.select(
        *scope,
        "event_id",
        "tool_name",
        "parent_idx",
        "parent",
        F.when(F.col("parent").isNotNull(), F.coalesce("parent_tool", F.lit("?"))).alias(
            "parent_tool"
        ),
    )


def branch_starts(
    events: DataFrame, scope: Sequence[str] = SESSION, links: DataFrame | None = None
) -> DataFrame:
    """Roots plus the children of every event that has more than one child."""
    scope = list(scope)
    ends = edges(events, scope) if links is None else links
    forks = (
        ends.groupBy(*scope, "parent")
        .agg(F.count("*").alias("kids"))
        .filter("kids > 1")
        .drop("kids")
    )
    below = (
        ends.join(forks, [*scope, "parent"])
        .select(*scope, F.col("child").alias("event_id"), F.col("child_pos").alias("pos"))
        .distinct()
    )
    has_parent = ends.select(*scope, F.col("child").alias("event_id"))
    top = events.join(has_parent, [*scope, "event_id"], "left_anti").select(
        *scope, "event_id", "pos"
    )
    return top.unionByName(below)


def fan_in_points(events: DataFrame, scope: Sequence[str] = SESSION) -> DataFrame:
    """Events with at least two local parents; parent tools in listed order."""
    grouped = edges(events, scope).groupBy(*scope, "child", "child_pos", "child_tool").agg(
        F.count("*").alias("parent_count"),
        F.array_sort(F.collect_list(F.struct("parent_idx", "parent_tool"))).alias("_p"),
    )
    return grouped.filter("parent_count >= 2").select(
        *scope,
        F.col("child").alias("event_id"),
        F.col("child_tool").alias("tool_name"),
        "parent_count",
        F.concat_ws(",", F.col("_p.parent_tool")).alias("parent_tools"),
    )
