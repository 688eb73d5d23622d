"""Windows over a session's events and structural drift between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.graph import TraceGraph
from skein.operators.lineage import cut
from skein.operators.ordering import running_sum
from skein.operators.patterns import path_reuse_ratio, transition_entropy
from skein.operators.structure import branch_density, session_stats

BASELINE_WINDOWS = 3


def count_windows(events: DataFrame, size: int = 100, overlap: int = 0) -> DataFrame:
    """Copy each event into the windows of ``size`` events that cover it.

    Adds ``window`` (from 0) and the event's 1-based place ``wpos`` in it.
    """
    step = max(size - overlap, 1)
    idx = F.col("pos") - 1
    first = F.greatest(F.lit(0), F.floor((idx - size) / step) + 1)
    last = F.floor(idx / step)
    return (
        events.withColumn("window", F.explode(F.sequence(first, last)))
        .filter(F.col("pos") - 1 < F.col("window") * step + size)
        .withColumn("wpos", F.col("pos") - F.col("window") * step)
    )


def time_windows(events: DataFrame, size: int = 100, overlap: int = 0) -> DataFrame:
    """Copy each event into the time windows (seconds) that cover it.

    Windows start at the session's first event with a readable timestamp. Windows
    without events do not count towards ``window``.
    """
    if size < 1:
        return events.withColumn("window", F.lit(0).cast("bigint")).limit(0)
    step = max(size - overlap, 1) * 1_000_000
    width = size * 1_000_000
    timed = events.filter(F.col("ts").isNotNull())
    start = timed.groupBy("session_id").agg(
        F.min_by(F.unix_micros("ts"), "pos").alias("_t0"),
        F.max_by(F.unix_micros("ts"), "pos").alias("_t1"),
    )
    rel = F.unix_micros("ts") - F.col("_t0")
    placed = (
        timed.join(start, "session_id")
        .filter(rel >= 0)
        .withColumn(
            "_w",
            F.explode(
                F.sequence(
                    F.greatest(F.lit(0), F.floor((rel - width) / step) + 1), F.floor(rel / step)
                )
            ),
        )
        .filter((rel < F.col("_w") * step + width) & (F.col("_w") * step <= F.col("_t1") - F.col("_t0")))
        .drop("_t0", "_t1")
    )
    order = (
        placed.select("session_id", "_w")
        .distinct()
        .withColumn(
            "window",
            F.row_number().over(Window.partitionBy("session_id").orderBy("_w")).cast("bigint") - 1,
        )
    )
    return placed.join(order, ["session_id", "_w"]).drop("_w")


def root_spawning(events: DataFrame, size: int = 50, overlap: int = 0) -> DataFrame:
    """Events without any recorded parent per count window."""
    return (
        count_windows(events, size, overlap)
        .groupBy("session_id", "window")
        .agg(
            F.count_if(F.size("parents") == 0).alias("root_count"),
            F.count("*").alias("event_count"),
        )
    )


def root_spawning_summary(events: DataFrame, size: int = 50) -> DataFrame:
    return (
        root_spawning(events, size)
        .groupBy("session_id")
        .agg(
            F.count("*").alias("windows"),
            F.avg("root_count").alias("avg_roots"),
            F.max("root_count").alias("max_roots"),
        )
    )


def window_metrics(events: DataFrame, size: int = 50, overlap: int = 0) -> DataFrame:
    """Structural measures of every count window, links restricted to the window."""
    scope = ["session_id", "window"]
    cutup = cut(
        count_windows(events, size, overlap).select(
            *scope, "event_id", "wpos", "tool_name", "ts", "parents"
        )
    )
    g = TraceGraph(cutup, scope, "wpos")
    reuse = path_reuse_ratio(cutup, 10, scope, "wpos", g)
    measures = [
        session_stats(cutup, scope, g, "wpos").select(*scope, "event_count", "root_count", "max_depth", "avg_depth"),
        transition_entropy(cutup, scope, "wpos", g.edges),
        reuse.select(*scope, F.col("reuse_ratio").alias("path_reuse_ratio")),
        branch_density(cutup, scope, g, "wpos"),
    ]
    # Every table has one row per window. Written, they meet in one aggregate; a chain of joins
    # would hold the sorts and hash tables of all of them in the same task.
    rows = cut(measures[0])
    for table in measures[1:]:
        rows = rows.unionByName(cut(table), allowMissingColumns=True)
    names = [c for c in rows.columns if c not in scope]
    return rows.groupBy(*scope).agg(*[F.max(c).alias(c) for c in names]).filter("event_count IS NOT NULL")


SHIFT_METRICS = ("root_count", "transition_entropy", "path_reuse_ratio", "avg_branch_density")


def shift_scores(events: DataFrame, size: int = 50) -> DataFrame:
    """Per window and measure: z against the mean and spread of all earlier windows.

    Measures have four decimals, so their sums are whole numbers of ten-thousandths and a
    measure that never changed has a spread of exactly zero, which gives no z.
    """
    # Read twice: for the sums inside slices and for those of whole slices.
    metrics = cut(window_metrics(events, size))
    rows = metrics.select(
        "session_id",
        "window",
        "event_count",
        F.expr(
            "stack(4, 'root_count', cast(root_count as double), "
            "'transition_entropy', round(transition_entropy, 4), "
            "'path_reuse_ratio', round(path_reuse_ratio, 4), "
            "'avg_branch_density', round(avg_branch_density, 4)) as (metric, value)"
        ),
    ).withColumn("place", F.col("window") + 1)
    v = F.round(F.col("value") * 10_000).cast("decimal(38,0)")
    summed = running_sum(
        rows,
        {"_s": v, "_q": v * v},
        scope=["session_id", "metric"],
        pos="place",
        inclusive=False,
        dtype="decimal(38,0)",
    )
    n = F.col("window")
    apart = n * v - F.col("_s")
    spread = n * F.col("_q") - F.col("_s") * F.col("_s")
    return (
        summed.filter(F.col("window") >= BASELINE_WINDOWS)
        .withColumn("z", F.when(spread > 0, apart.cast("double") / F.sqrt(spread.cast("double"))))
        .select("session_id", "window", "event_count", "metric", "value", "z")
    )


def topology_shift(events: DataFrame, size: int = 50, z_threshold: float = 2.0) -> DataFrame:
    """Windows whose measures leave the range of the earlier windows."""
    begin = F.col("window") * size
    return (
        shift_scores(events, size)
        .filter(F.abs("z") >= z_threshold)
        .select(
            "session_id",
            "window",
            begin.alias("event_index_start"),
            (begin + F.col("event_count")).alias("event_index_end"),
            "metric",
            "z",
        )
    )
