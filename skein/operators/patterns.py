"""Repeated structures: tool transitions, tool paths and their concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.edges import SESSION, edges
from skein.operators.graph import TraceGraph
from skein.operators.lineage import cut
from skein.operators.ordering import top_rows


def transitions(
    events: DataFrame,
    top_n: int | None = 15,
    scope: Sequence[str] = SESSION,
    pos: str = "pos",
    links: DataFrame | None = None,
) -> DataFrame:
    """Counts of (parent tool, child tool) per scope, most frequent first."""
    links = edges(events, scope, pos) if links is None else links
    counts = links.groupBy(
        *scope, F.col("parent_tool").alias("from_tool"), F.col("child_tool").alias("to_tool")
    ).agg(F.count("*").alias("count"))
    if top_n is None:
        return counts
    return top_rows(counts, scope, [F.desc("count"), F.col("from_tool"), F.col("to_tool")], top_n)


def corpus_transitions(events: DataFrame, top_n: int = 15) -> DataFrame:
    """Most frequent transitions over all sessions."""
    counts = edges(events).groupBy(
        F.col("parent_tool").alias("from_tool"), F.col("child_tool").alias("to_tool")
    ).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "from_tool", "to_tool").limit(top_n)


def write_transitions_csv(df: DataFrame, path: str) -> None:
    """Transition table as headed CSV files, one directory per call; a quote inside a value is doubled."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def entropy_of(counts: DataFrame, scope: Sequence[str], count: str = "count") -> DataFrame:
    """Shannon entropy in bits of counts per scope: log2(T) - sum(c*log2(c))/T."""
    c = F.col(count)
    total = F.sum(c)
    value = F.log2(total) - F.sum(c * F.log2(c)) / total
    return counts.groupBy(*scope).agg(
        F.greatest(value, F.lit(0.0)).alias("transition_entropy")
    )


def transition_entropy(
    events: DataFrame, scope: Sequence[str] = SESSION, pos: str = "pos", links: DataFrame | None = None
) -> DataFrame:
    """Entropy of the transition distribution; scopes without transitions give zero."""
    scopes = events.select(*scope).distinct()
    found = entropy_of(transitions(events, None, scope, pos, links), scope)
    return scopes.join(found, list(scope), "left").fillna(0.0, ["transition_entropy"])


def path_counts(
    events: DataFrame,
    min_length: int = 2,
    max_length: int = 5,
    scope: Sequence[str] = SESSION,
    pos: str = "pos",
    graph: TraceGraph | None = None,
) -> DataFrame:
    """Occurrences of every tool sequence along simple causal paths.

    Paths are not listed one by one: only the number of paths per (last event, tool
    sequence) is carried from length to length, block by block, or by joins where a scope
    is larger than a block. Scopes with a reference to a later event could revisit an
    event, so there the visited events are carried as well.
    """
    g = graph or TraceGraph(events, scope, pos)
    scope = g.scope
    forward = g.edges.filter("parent_pos >= child_pos").select(*scope).distinct()
    tangled = not forward.isEmpty()
    if not tangled and not g.large:
        return g.tool_paths(min_length, max_length)
    full = g.edges.select(*scope, "parent_pos", "child_pos", "parent_tool", "child_tool")
    parts = []
    if min_length <= 1:
        parts.append(
            g.nodes.groupBy(*scope, F.array("tool_name").alias("pattern")).agg(
                F.count("*").alias("occurrences")
            )
        )
    plain = full.join(forward, scope, "left_anti") if tangled else full
    steps = plain.groupBy(*scope, "parent_pos", "child_pos", "child_tool").agg(F.count("*").alias("m"))
    state = plain.groupBy(
        *scope, "child_pos", F.array("parent_tool", "child_tool").alias("pattern")
    ).agg(F.count("*").alias("n"))
    for length in range(2, max_length + 1):
        if length > 2:
            state = (
                state.withColumnRenamed("child_pos", "parent_pos")
                .join(steps, [*scope, "parent_pos"])
                .groupBy(
                    *scope,
                    "child_pos",
                    F.concat("pattern", F.array("child_tool")).alias("pattern"),
                )
                .agg(F.sum(F.col("n") * F.col("m")).alias("n"))
            )
        state = cut(state)
        if length >= min_length:
            parts.append(state.select(*scope, "pattern", F.col("n").alias("occurrences")))
    if tangled:
        parts += _simple_walks(full.join(forward, scope, "left_semi"), scope, min_length, max_length)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*scope, "pattern").agg(F.sum("occurrences").alias("occurrences"))


def _simple_walks(hard: DataFrame, scope: list[str], min_length: int, max_length: int) -> list[DataFrame]:
    """Paths that carry the events they passed, one table per length."""
    walk = hard.filter("parent_pos <> child_pos").select(
        *scope,
        "child_pos",
        F.array("parent_tool", "child_tool").alias("pattern"),
        F.array("parent_pos", "child_pos").alias("seen"),
    )
    onward = hard.select(
        *scope, "parent_pos", F.col("child_pos").alias("to_pos"), F.col("child_tool").alias("to_tool")
    )
    parts = []
    for length in range(2, max_length + 1):
        if length > 2:
            walk = (
                walk.withColumnRenamed("child_pos", "parent_pos")
                .join(onward, [*scope, "parent_pos"])
                .filter("NOT array_contains(seen, to_pos)")
                .select(
                    *scope,
                    F.col("to_pos").alias("child_pos"),
                    F.concat("pattern", F.array("to_tool")).alias("pattern"),
                    F.concat("seen", F.array("to_pos")).alias("seen"),
                )
            )
        walk = cut(walk)
        if length >= min_length:
            parts.append(walk.select(*scope, "pattern", F.lit(1).cast("bigint").alias("occurrences")))
    return parts


def repeated_paths(
    events: DataFrame,
    min_length: int = 2,
    max_length: int = 5,
    min_occurrences: int = 2,
    scope: Sequence[str] = SESSION,
) -> DataFrame:
    """Tool sequences along causal paths that occur at least ``min_occurrences`` times."""
    return (
        path_counts(events, min_length, max_length, scope)
        .filter(F.col("occurrences") >= min_occurrences)
        .select(
            *scope,
            F.concat_ws(">", "pattern").alias("pattern"),
            F.size("pattern").alias("length"),
            "occurrences",
        )
    )


def path_reuse_ratio(
    events: DataFrame,
    max_depth: int = 10,
    scope: Sequence[str] = SESSION,
    pos: str = "pos",
    graph: TraceGraph | None = None,
) -> DataFrame:
    """1 - distinct / total tool paths of 2 to ``max_depth`` events."""
    counted = path_counts(events, 2, max_depth, scope, pos, graph)
    per = counted.groupBy(*scope).agg(
        F.sum("occurrences").alias("total_paths"), F.count("*").alias("unique_paths")
    )
    return (
        events.select(*scope)
        .distinct()
        .join(per, list(scope), "left")
        .fillna(0, ["total_paths", "unique_paths"])
        .withColumn(
            "reuse_ratio",
            F.when(
                F.col("total_paths") > 0, 1.0 - F.col("unique_paths") / F.col("total_paths")
            ).otherwise(0.0),
        )
    )


def retry_density(
    events: DataFrame, scope: Sequence[str] = SESSION, pos: str = "pos", graph: TraceGraph | None = None
) -> DataFrame:
    """Mean of transition repetition, path reuse (5 events) and same-tool links."""
    g = graph or TraceGraph(events, scope, pos)
    scope = g.scope
    counts = transitions(events, None, scope, pos, g.edges)
    per = counts.groupBy(*scope).agg(
        (F.sum(F.col("count") - 1) / F.sum("count")).alias("transition_repetition"),
        (
            F.sum(F.when(F.col("from_tool") == F.col("to_tool"), F.col("count")).otherwise(0))
            / F.sum("count")
        ).alias("local_loop_density"),
    )
    reuse = path_reuse_ratio(events, 5, scope, pos, g).select(
        *scope, F.col("reuse_ratio").alias("path_reuse_ratio")
    )
    parts = ["transition_repetition", "path_reuse_ratio", "local_loop_density"]
    return (
        reuse.join(per, scope, "left")
        .fillna(0.0, parts)
        .withColumn("retry_density", sum((F.col(p) for p in parts), F.lit(0.0)) / 3)
        .select(*scope, "retry_density", *parts)
    )
