"""Causal links inferred from the order of events, and their quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.columns import parse_parents
from skein.operators.edges import SESSION, edges
from skein.operators.graph import TraceGraph
from skein.operators.ordering import look_back, neighbours, running_sum
from skein.operators.structure import cycle_nodes, root_depths

# Tool names the temporal rules look at (lower case).
BARRIER_TOOLS = ("question", "invalid")
READ_TOOLS = (
    "read",
    "grep",
    "glob",
    "lsp_diagnostics",
    "lsp_symbols",
    "lsp_find_references",
    "lsp_goto_definition",
    "lsp_prepare_rename",
    "look_at",
    "session_read",
    "session_search",
    "session_list",
    "session_info",
    "webfetch",
    "websearch",
    "ast_grep_search",
)
WRITE_TOOLS = (
    "write",
    "edit",
    "bash",
    "interactive_bash",
    "skill_mcp",
    "ast_grep_replace",
    "lsp_rename",
)
SHELL_TOOLS = ("bash", "interactive_bash")
AGENT_TOOLS = ("task", "call_omo_agent")
MAX_READS = 5


def _barrier(tool: Column) -> Column:
    return F.lower(tool).isin(*BARRIER_TOOLS)


def detect_turns(events: DataFrame) -> DataFrame:
    """Add ``turn`` (from 0): a new one at each ``question`` but the first event's."""
    opens = ((F.col("tool_name") == "question") & (F.col("pos") > 1)).cast("int")
    return running_sum(events, {"turn": opens})


def link_sequential(events: DataFrame) -> DataFrame:
    """Add ``seq_parent``: the previous event of the turn unless either is a barrier."""
    return link_lookback(events).drop("_pid", "_ptool", "_pts")


def link_lookback(events: DataFrame) -> DataFrame:
    """``seq_parent`` next to the look-back columns it was decided from."""
    df = neighbours(
        events,
        {"_pid": ("event_id", 1), "_ptool": ("tool_name", 1), "_pts": ("timestamp", 1)},
    )
    ok = (
        F.col("_pid").isNotNull()
        & ~_barrier(F.col("tool_name"))
        & ~_barrier(F.col("_ptool"))
        & (F.coalesce("parent_event_id", F.lit("")) == "")
        & (F.col("_pts") <= F.col("timestamp"))
    )
    return df.withColumn("seq_parent", F.when(ok, F.col("_pid")))


def link_subtasks(df: DataFrame) -> DataFrame:
    """Add ``task_parent``: an agent call adopts the unlinked event right after it.

    Expects the look-back columns ``_pid`` and ``_ptool`` and ``seq_parent``. A following
    ``question`` opens a new turn and is not adopted.
    """
    ok = (
        F.col("_ptool").isin(*AGENT_TOOLS)
        & ~F.col("tool_name").isin(*AGENT_TOOLS)
        & (F.col("tool_name") != "question")
        & F.col("seq_parent").isNull()
        & (F.coalesce("parent_event_id", F.lit("")) == "")
    )
    return df.withColumn("task_parent", F.when(ok, F.col("_pid")))


def detect_fan_in(events: DataFrame, max_gap: int = 3) -> DataFrame:
    """Add ``fan_in``: ids of the reads a write depends on, nearest first.

    A read is missed after more than ``max_gap`` non-reads in a row, so the last
    ``5 * (max_gap + 1)`` events hold everything a write can reach.
    """
    tool = F.lower("tool_name")
    kind = F.when(_barrier(F.col("tool_name")), "b").when(tool.isin(*READ_TOOLS), "r").otherwise("o")
    item = F.struct(kind.alias("kind"), F.col("event_id").alias("id"))
    df = look_back(events, item, MAX_READS * (max_gap + 1), "_seen")

    def step(acc: Column, x: Column) -> Column:
        is_read = x["kind"] == "r"
        closed = acc["closed"] | (x["kind"] == "b") | (~is_read & (acc["gap"] >= max_gap))
        take = is_read & ~acc["closed"] & (F.size(acc["ids"]) < MAX_READS)
        return F.struct(
            F.when(take, F.concat(acc["ids"], F.array(x["id"]))).otherwise(acc["ids"]).alias("ids"),
            F.when(is_read, F.lit(0)).otherwise(acc["gap"] + 1).alias("gap"),
            closed.alias("closed"),
        )

    start = F.struct(
        F.expr("cast(array() as array<string>)").alias("ids"),
        F.lit(0).alias("gap"),
        F.lit(False).alias("closed"),
    )
    reads = F.aggregate(F.reverse("_seen"), start, step, lambda acc: acc["ids"])
    none = F.expr("cast(array() as array<string>)")
    df = df.withColumn("_reads", F.when(tool.isin(*WRITE_TOOLS), reads).otherwise(none))
    enough = (F.size("_reads") >= 2) | ((F.size("_reads") == 1) & tool.isin(*SHELL_TOOLS))
    return df.withColumn("fan_in", F.when(enough, F.col("_reads")).otherwise(none)).drop("_seen", "_reads")


def infer_relations(events: DataFrame, max_gap: int = 3) -> DataFrame:
    """Link unlinked events: sequence, reads behind a write, events after an agent call.

    All inferred parents precede their child, so the result needs no cycle breaking
    beyond what the recorded parents need (see ``break_cycles``).
    """
    df = link_subtasks(link_lookback(detect_fan_in(events, max_gap)))
    primary = F.coalesce(
        F.nullif("parent_event_id", F.lit("")), F.col("seq_parent"), F.col("task_parent")
    )
    df = df.withColumn("_primary", primary)
    extra = F.filter("fan_in", lambda p: F.coalesce(p != F.col("_primary"), F.lit(True)))
    joined = F.concat_ws(",", F.array(F.col("_primary")), extra)
    return (
        df.withColumn("parent_event_id", F.nullif(joined, F.lit("")))
        .withColumn("parents", parse_parents("parent_event_id"))
        .drop("_pid", "_ptool", "_pts", "_primary", "seq_parent", "task_parent", "fan_in")
    )


def causal_quality(events: DataFrame, graph: TraceGraph | None = None) -> DataFrame:
    """Link counts, depth below raw roots, cyclic events and the quality score."""
    g = graph or TraceGraph(events)
    keys = [*g.scope, "pos"]
    raw = F.coalesce("parent_event_id", F.lit(""))
    counts = events.groupBy(*g.scope).agg(
        F.count("*").alias("total_events"),
        F.count_if(raw != "").alias("linked_events"),
        F.count_if(raw == "").alias("root_events"),
        F.count_if(raw.contains(",")).alias("multi_parent_events"),
    )
    depth = (
        root_depths(g)
        .join(events.filter(raw == "").select(*keys), keys, "left_semi")
        .groupBy(*g.scope)
        .agg(F.max("depth").alias("max_depth"), F.avg("depth").alias("avg_chain_length"))
    )
    loops = cycle_nodes(events, g.scope, g).groupBy(*g.scope).agg(F.count("*").alias("cyclic_events"))
    out = (
        counts.join(depth, g.scope, "left")
        .join(loops, g.scope, "left")
        .fillna(0, ["max_depth", "cyclic_events"])
        .fillna(0.0, ["avg_chain_length"])
    )
    score = F.col("linked_events") / F.col("total_events") * 0.5 + F.least(
        F.lit(1.0), F.col("max_depth") / 20
    ) * 0.5
    return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def measure_fidelity(
    events: DataFrame, local_only: bool = True, scope: Sequence[str] = SESSION
) -> DataFrame:
    """Compare recorded links with links inferred from order alone, per session.

    Sessions without any recorded link have nothing to compare and give no row.
    """
    scope = list(scope)
    stripped = events.withColumn("parent_event_id", F.lit(None).cast("string")).withColumn(
        "parents", F.expr("cast(array() as array<string>)")
    )
    inferred = infer_relations(stripped)

    def pairs(df: DataFrame, flag: str) -> DataFrame:
        if local_only:
            out = edges(df, scope).select(*scope, "child", "parent")
        else:
            out = df.select(*scope, F.col("event_id").alias("child"), F.explode("parents").alias("parent"))
        return out.distinct().withColumn(flag, F.lit(1))

    both = pairs(events, "n").join(pairs(inferred, "i"), [*scope, "child", "parent"], "full")
    child = both.groupBy(*scope, "child").agg(
        F.count("n").alias("n"),
        F.count("i").alias("i"),
        F.count_if(F.col("n").isNotNull() & F.col("i").isNotNull()).alias("m"),
    )
    same = (F.col("n") == F.col("m")) & (F.col("i") == F.col("m"))
    per = child.groupBy(*scope).agg(
        F.count("*").alias("children_compared"),
        F.count_if(same).alias("_exact"),
        F.sum("n").alias("native_edges"),
        F.sum("i").alias("inferred_edges"),
        F.sum("m").alias("matched_edges"),
        F.count_if(F.col("n") > 1).alias("fan_in_native"),
        F.count_if(F.col("i") > 1).alias("fan_in_claimed"),
        F.count_if((F.col("n") > 1) & same).alias("fan_in_reproduced"),
    )
    size = (
        events.groupBy(*scope)
        .agg(
            F.count("*").alias("event_count"),
            F.max(F.coalesce("parent_event_id", F.lit("")) != "").alias("_native"),
        )
        .filter("_native")
        .drop("_native")
    )
    counts = [
        "children_compared",
        "_exact",
        "native_edges",
        "inferred_edges",
        "matched_edges",
        "fan_in_native",
        "fan_in_claimed",
        "fan_in_reproduced",
    ]
    df = size.join(per, scope, "left").fillna(0, counts)

    def ratio(a: Column, b: str) -> Column:
        return F.when(F.col(b) > 0, a / F.col(b)).otherwise(0.0)

    n, i, m = F.col("native_edges"), F.col("inferred_edges"), F.col("matched_edges")
    return (
        df.withColumn("child_exact_agreement", ratio(F.col("_exact"), "children_compared"))
        .withColumn("missed_edge_rate", ratio(n - m, "native_edges"))
        .withColumn("spurious_edge_rate", ratio(i - m, "inferred_edges"))
        .withColumn("edge_recall", ratio(m, "native_edges"))
        .withColumn("edge_precision", ratio(m, "inferred_edges"))
        .withColumn("edge_f1", F.when(n + i > 0, 2 * m / (n + i)).otherwise(0.0))
        .drop("_exact")
    )
