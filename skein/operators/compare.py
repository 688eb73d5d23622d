"""Comparison of sessions and per-session reports as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import TraceGraph
from skein.operators.lineage import cut
from skein.operators.ordering import top_rows
from skein.operators.patterns import retry_density, transitions
from skein.operators.structure import (
    branch_persistence,
    critical_path,
    find_roots,
    frontier_summary,
    session_stats,
    topology_class,
    topology_shape,
)
from skein.operators.windows import root_spawning_summary, topology_shift

DISTANCE_STATS = (
    "root_count",
    "leaf_count",
    "max_depth",
    "fan_out_avg",
    "fan_out_max",
    "link_ratio",
    "multi_parent_count",
)


def _sided(df: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Rows of ``df`` for one side of the session pairs (columns ``a`` and ``b``)."""
    return pairs.join(df, F.col(side) == F.col("session_id")).drop("session_id")


def topology_distance(stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean relative difference of seven structural measures for each pair."""
    def side(name: str) -> DataFrame:
        cols = [F.col(c).cast("double").alias(f"{name}_{c}") for c in DISTANCE_STATS]
        return stats.select(F.col("session_id").alias(name), *cols)

    def gap(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        return F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0))

    total = sum((gap(c) for c in DISTANCE_STATS), F.lit(0.0))
    return (
        pairs.join(side("a"), "a").join(side("b"), "b").select(
            "a", "b", (total / len(DISTANCE_STATS)).alias("distance")
        )
    )


def transition_divergence(events: DataFrame, pairs: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Total-variation distance of the transition distributions of each pair."""
    counts = transitions(events, None, links=links)
    key = ["a", "b", "from_tool", "to_tool"]
    left = _sided(counts, pairs, "a").withColumnRenamed("count", "na")
    right = _sided(counts, pairs, "b").withColumnRenamed("count", "nb")
    both = left.join(right, key, "full").fillna(0, ["na", "nb"])
    totals = both.groupBy("a", "b").agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    share = F.abs(F.col("na") / F.greatest("ta", F.lit(1)) - F.col("nb") / F.greatest("tb", F.lit(1)))
    found = both.join(totals, ["a", "b"]).groupBy("a", "b").agg(
        F.when((F.min("ta") == 0) | (F.min("tb") == 0), 1.0).otherwise(F.sum(share) / 2).alias("divergence")
    )
    return pairs.select("a", "b").join(found, ["a", "b"], "left").fillna(0.0, ["divergence"])


def branch_summary(events: DataFrame, graph: TraceGraph | None = None) -> DataFrame:
    """Number, size, lifespan and overlap of branches, and retry density, per session."""
    g = graph or TraceGraph(events)
    branches = (
        branch_persistence(events, graph=g)
        .groupBy("session_id")
        .agg(
            F.count("*").alias("branch_count"),
            F.avg("descendants").alias("avg_descendants"),
            F.max("lifespan").alias("max_lifespan"),
        )
    )
    front = frontier_summary(events, graph=g).select(
        "session_id", F.col("max_width").alias("frontier_max"), F.col("avg_width").alias("frontier_avg")
    )
    retry = retry_density(events, graph=g).select("session_id", "retry_density")
    return branches.join(front, "session_id", "right").join(retry, "session_id").fillna(
        0, ["branch_count", "avg_descendants", "max_lifespan"]
    )


def session_measures(events: DataFrame, window: int = 50, graph: TraceGraph | None = None) -> DataFrame:
    """Rows (session_id, metric, value) of everything sessions are compared by; fractions have four decimals."""
    g = graph or TraceGraph(events)
    wide = (
        topology_shape(session_stats(events, graph=g))
        .join(branch_summary(events, g), "session_id")
        .join(root_spawning_summary(events, window), "session_id")
    )
    names = [c for c in wide.columns if c != "session_id"]
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("metric"),
                (F.round(n, 4).cast("decimal(28,4)") if t == "double" else F.col(n)).cast("string").alias("value"),
            )
            for n, t in wide.dtypes
            if n in names
        ]
    )
    return wide.select("session_id", F.inline(entries))


def compare_sessions(
    events: DataFrame, pairs: DataFrame, top: int = 10, window: int = 50, graph: TraceGraph | None = None
) -> DataFrame:
    """Rows (a, b, metric, value_a, value_b, differs) for each pair of sessions.

    Measures, then the most frequent transitions of either side as ``x->y`` counts.
    """
    g = graph or TraceGraph(events)
    rows = session_measures(events, window, g)
    best = transitions(events, top, links=g.edges).select(
        "session_id",
        F.concat("from_tool", F.lit("->"), "to_tool").alias("metric"),
        F.col("count").cast("string").alias("value"),
    )
    rows = cut(rows.unionByName(best))
    left = _sided(rows, pairs, "a").withColumnRenamed("value", "value_a")
    right = _sided(rows, pairs, "b").withColumnRenamed("value", "value_b")
    return (
        left.join(right, ["a", "b", "metric"], "full")
        .fillna("0", ["value_a", "value_b"])
        .withColumn("differs", F.col("value_a") != F.col("value_b"))
    )


def session_report(
    events: DataFrame,
    metadata: DataFrame,
    window: int = 50,
    z_threshold: float = 2.0,
    top: int = 10,
    graph: TraceGraph | None = None,
) -> DataFrame:
    """Rows (session_id, section, ord, key, value) of every session's report."""
    g = graph or TraceGraph(events)
    stats = topology_class(session_stats(events, graph=g))

    def section(df: DataFrame, name: str, order: Column, key: Column, value: Column) -> DataFrame:
        return df.select(
            "session_id",
            F.lit(name).alias("section"),
            order.cast("bigint").alias("ord"),
            key.cast("string").alias("key"),
            value.cast("string").alias("value"),
        )

    def unpivot(df: DataFrame, name: str) -> DataFrame:
        cols = [c for c in df.columns if c != "session_id"]
        entries = F.array(
            *[
                F.struct(
                    F.lit(i).alias("o"),
                    F.lit(c).alias("k"),
                    (F.round(c, 4) if dict(df.dtypes)[c] == "double" else F.col(c)).cast("string").alias("v"),
                )
                for i, c in enumerate(cols)
            ]
        )
        rows = df.select("session_id", F.inline(entries)).filter("v IS NOT NULL")
        return section(rows, name, F.col("o"), F.col("k"), F.col("v"))

    roots = top_rows(
        find_roots(events, graph=g),
        ["session_id"],
        [F.desc("downstream_count"), F.col("event_id")],
        top,
    )
    shown = transitions(events, top, links=g.edges)
    drift = topology_shift(events, window, z_threshold)
    return (
        unpivot(metadata, "metadata")
        .unionByName(unpivot(stats, "stats"))
        .unionByName(section(roots, "roots", F.col("rank"), F.col("event_id"), F.col("downstream_count")))
        .unionByName(
            section(
                shown,
                "transitions",
                F.col("rank"),
                F.concat("from_tool", F.lit("->"), "to_tool"),
                F.col("count"),
            )
        )
        .unionByName(
            section(
                critical_path(events, graph=g), "critical_path", F.col("step"), F.col("event_id"), F.col("tool_name")
            )
        )
        .unionByName(section(drift, "drift", F.col("window"), F.col("metric"), F.round("z", 2)))
    )
