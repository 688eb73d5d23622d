"""Depth, roots, paths, components, trees and branches of causal graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.columns import input_preview
from skein.operators.edges import SESSION, branch_starts
from skein.operators.graph import TraceGraph
from skein.operators.lineage import cut
from skein.operators.ordering import running_sum


def graph_of(events: DataFrame, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None):
    return graph or TraceGraph(events, scope)


def _ids(g: TraceGraph) -> DataFrame:
    return g.nodes.select(*g.scope, "pos", "event_id", "tool_name", "ts")


def root_nodes(g: TraceGraph) -> DataFrame:
    below = g.edges.select(*g.scope, F.col("child_pos").alias("pos"))
    return g.nodes.join(below, [*g.scope, "pos"], "left_anti")


def node_depths(events, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None) -> DataFrame:
    """Longest path from any root, for events that sort topologically below a root."""
    g = graph_of(events, scope, graph)
    return (
        g.levels(g.nodes, g.down())
        .join(_ids(g), [*g.scope, "pos"])
        .select(*g.scope, "event_id", F.col("level").alias("depth"))
    )


def root_depths(g: TraceGraph) -> DataFrame:
    """Per root: longest path inside what that root alone reaches.

    Without cycles that is the root's height. Scopes with a cycle are redone per root,
    since an event behind the cycle of one root may be in order below another.
    """
    keys = [*g.scope, "pos"]
    tops = g.profile.filter("up = 0").select(*keys, F.col("height").alias("depth"))
    cyclic = g.profile.filter("level IS NULL").select(*g.scope)
    if cyclic.isEmpty():
        return tops
    cyclic = cut(cyclic.distinct())
    found = cut(
        g.closure(
            tops.join(cyclic, g.scope, "left_semi").select(*keys, F.col("pos").alias("start")),
            g.down(),
        )
    )
    inner = g.edges.join(
        found.select(*g.scope, "start", F.col("pos").alias("parent_pos")), [*g.scope, "parent_pos"]
    ).select(*g.scope, "start", "parent_pos", "child_pos")
    own = TraceGraph(
        None,
        [*g.scope, "start"],
        block_rows=g.block_rows,
        node_table=found.select(*g.scope, "start", "pos"),
        edge_table=cut(inner),
    )
    deep = (
        own.levels(own.nodes, own.down())
        .groupBy(*g.scope, F.col("start").alias("pos"))
        .agg(F.max("level").alias("depth"))
    )
    return tops.join(cyclic, g.scope, "left_anti").unionByName(deep.select(*keys, "depth"))


def find_roots(events, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None) -> DataFrame:
    """Roots with the number of distinct descendants and the depth below each."""
    g = graph_of(events, scope, graph)
    keys = [*g.scope, "pos"]
    tops = root_depths(g)
    down = g.reach(tops.select(*keys), g.down()).select(
        *g.scope, F.col("start").alias("pos"), (F.col("reached") - 1).alias("downstream_count")
    )
    shown = events.select(
        *keys, "event_id", "tool_name", input_preview("tool_input", 60).alias("tool_input_preview")
    )
    return (
        tops.join(down, keys)
        .join(shown, keys)
        .select(
            *g.scope,
            "event_id",
            "tool_name",
            "tool_input_preview",
            "downstream_count",
            F.col("depth").alias("max_subtree_depth"),
        )
    )


def session_stats(events, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None, pos: str = "pos"):
    """The twelve structural measures of each scope, unrounded."""
    g = graph or TraceGraph(events, scope, pos)
    scope = g.scope
    keys = [*scope, "pos"]
    basic = events.groupBy(*scope).agg(
        F.count("*").alias("event_count"),
        F.countDistinct("tool_name").alias("tool_count"),
        F.min_by("ts", pos).alias("_t0"),
        F.max_by("ts", pos).alias("_t1"),
    )
    span = (F.unix_micros("_t1") - F.unix_micros("_t0")) / F.lit(1e6)
    basic = basic.withColumn(
        "time_span_s", F.when(F.col("event_count") > 1, F.coalesce(span, F.lit(0.0))).otherwise(0.0)
    ).drop("_t0", "_t1")
    per_node = g.profile.select(*keys, "up", "out", "level", F.lit(None).cast("bigint").alias("depth"))
    per_root = root_depths(g).select(
        *keys,
        *[F.lit(None).cast("bigint").alias(c) for c in ("up", "out", "level")],
        "depth",
    )
    shape = per_node.unionByName(per_root).groupBy(*scope).agg(
        F.count_if(F.col("up") == 0).alias("root_count"),
        F.count_if(F.col("out") == 0).alias("leaf_count"),
        F.coalesce(F.max("level"), F.lit(0)).alias("max_depth"),
        F.coalesce(F.avg("level"), F.lit(0.0)).alias("avg_depth"),
        F.avg("out").alias("fan_out_avg"),
        F.max("out").alias("fan_out_max"),
        F.coalesce(F.avg(F.col("depth") + 1), F.lit(0.0)).alias("chain_length_avg"),
        F.avg((F.col("up") > 0).cast("int")).alias("link_ratio"),
        F.count_if(F.col("up") >= 2).alias("multi_parent_count"),
    )
    return basic.join(shape, scope).select(
        *scope,
        "event_count",
        "tool_count",
        "root_count",
        "leaf_count",
        "max_depth",
        "avg_depth",
        "fan_out_avg",
        "fan_out_max",
        "chain_length_avg",
        "link_ratio",
        "multi_parent_count",
        "time_span_s",
    )


def tool_freq(events: DataFrame, scope: Sequence[str] = SESSION) -> DataFrame:
    """How often each tool occurs in a scope."""
    return events.groupBy(*scope, "tool_name").agg(F.count("*").alias("uses"))


def topology_class(stats: DataFrame) -> DataFrame:
    """Structural phenotype; thresholds apply to measures rounded to two places."""
    n = F.col("event_count")
    ratio = F.when(n > 0, F.col("max_depth") / n).otherwise(0)
    fan, avg_depth = F.round("fan_out_avg", 2), F.round("avg_depth", 2)
    label = (
        F.when((F.col("root_count") <= 2) & (ratio > 0.3) & (fan < 1.5), "dominant_chain")
        .when((F.col("root_count") <= 3) & (F.col("fan_out_max") >= 4) & (fan >= 1.5), "fan_out_heavy")
        .when(
            (F.col("multi_parent_count") >= 3) & (F.col("multi_parent_count") / n > 0.05),
            "collapsed_repair",
        )
        .when((F.col("root_count") >= 5) & (avg_depth < 3), "multi_root_exploration")
        .otherwise("mixed")
    )
    return stats.withColumn("topology", label)


def topology_shape(stats: DataFrame) -> DataFrame:
    """Coarse label used in session comparison."""
    chain = (F.col("root_count") <= 2) & (F.col("max_depth") > F.col("event_count") * 0.3)
    forest = (F.col("root_count") > 10) & (F.round("chain_length_avg", 2) < 20)
    return stats.withColumn(
        "shape",
        F.when(chain, "dominant chain").when(forest, "exploratory forest").otherwise("mixed"),
    )


def branch_density(events, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None, pos: str = "pos"):
    """Fan-out relative to depth, average and maximum; zero where there is no depth."""
    g = graph or TraceGraph(events, scope, pos)
    agg = g.profile.groupBy(*g.scope).agg(
        F.avg("out").alias("fa"),
        F.max("out").alias("fm"),
        F.avg("level").alias("da"),
        F.max("level").alias("dm"),
    )
    return agg.select(
        *g.scope,
        F.when(F.col("da") > 0, F.col("fa") / F.col("da")).otherwise(0.0).alias("avg_branch_density"),
        F.when(F.col("dm") > 0, F.col("fm") / F.col("dm")).otherwise(0.0).alias("max_branch_density"),
    )


def critical_path(events, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None) -> DataFrame:
    """Longest root-to-leaf chain; earliest root and earliest child win ties.

    All sides have about a row per event, so they are merged: written tables of positions are
    so small on disk that the optimizer would send them whole through the driver.
    """
    g = graph_of(events, scope, graph)
    keys = [*g.scope, "pos"]
    placed = g.profile.filter("height IS NOT NULL")
    above = placed.select(*g.scope, F.col("pos").alias("src"), F.col("height").alias("hs"))
    under = placed.select(*g.scope, F.col("pos").alias("dst"), F.col("height").alias("hd"))
    nxt = (
        g.down()
        .join(above.hint("merge"), [*g.scope, "src"])
        .join(under.hint("merge"), [*g.scope, "dst"])
        .filter("hd = hs - 1")
        .groupBy(*g.scope, "src")
        .agg(F.min("dst").alias("dst"))
    )
    first = (
        placed.filter("up = 0")
        .groupBy(*g.scope)
        .agg(F.max(F.struct("height", (-F.col("pos")).alias("neg"))).alias("best"))
        .select(*g.scope, (-F.col("best.neg")).alias("pos"))
        .withColumn("start", F.col("pos"))
    )
    return (
        g.closure(first, nxt)
        .join(_ids(g).hint("merge"), keys)
        .select(*g.scope, F.col("dist").alias("step"), "event_id", "tool_name")
    )


def components(events, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None) -> DataFrame:
    """Weakly connected components: size and number of roots, named by earliest event."""
    g = graph_of(events, scope, graph)
    keys = [*g.scope, "pos"]
    tops = root_nodes(g).select(*keys, F.lit(1).alias("top"))
    names = _ids(g).select(*g.scope, F.col("pos").alias("label"), F.col("event_id").alias("component"))
    return (
        g.labels(g.down())
        .join(tops, keys, "left")
        .groupBy(*g.scope, "label")
        .agg(F.count("*").alias("size"), F.count("top").alias("root_count"))
        .join(names, [*g.scope, "label"])
        .select(*g.scope, "component", "size", "root_count")
    )


def component_members(events, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None) -> DataFrame:
    """Event to component, one row per event (a component may be too long for one row)."""
    g = graph_of(events, scope, graph)
    names = _ids(g).select(*g.scope, F.col("pos").alias("label"), F.col("event_id").alias("component"))
    return (
        g.labels(g.down())
        .join(names, [*g.scope, "label"])
        .join(_ids(g), [*g.scope, "pos"])
        .select(*g.scope, "component", "event_id")
    )


# -- first-parent trees ------------------------------------------------------


def first_parent(g: TraceGraph) -> DataFrame:
    """Tree edge of each event: its first listed parent that is local."""
    return g.edges.groupBy(*g.scope, "child_pos").agg(
        F.min_by("parent_pos", "parent_idx").alias("parent_pos"),
        F.min_by("parent_tool", "parent_idx").alias("parent_tool"),
        F.max("child_tool").alias("child_tool"),
    )


def build_tree(events, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None) -> DataFrame:
    """Depth, parent and order among siblings of each event in the first-parent tree."""
    g = graph_of(events, scope, graph)
    keys = [*g.scope, "pos"]
    tree = cut(first_parent(g))
    links = tree.select(*g.scope, F.col("parent_pos").alias("src"), F.col("child_pos").alias("dst"))
    depth = g.levels(g.nodes, links)
    placed = (
        depth.join(
            tree.select(*g.scope, F.col("child_pos").alias("pos"), "parent_pos"), keys, "left"
        )
        .withColumn("_root", F.col("parent_pos").isNull())
    )
    ordered = _sibling_order(placed, g.scope)
    parents = _ids(g).select(*g.scope, F.col("pos").alias("parent_pos"), F.col("event_id").alias("parent"))
    return (
        ordered.join(parents, [*g.scope, "parent_pos"], "left")
        .join(_ids(g), keys)
        .select(*g.scope, "event_id", "parent", F.col("level").alias("depth"), "sibling")
    )


def _sibling_order(placed: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Rank among the children of one parent, slice by slice of the position."""
    from skein.operators.ordering import SLICE_ROWS

    family = [*scope, "parent_pos"]
    cut_rows = placed.withColumn("_slice", F.floor((F.col("pos") - 1) / SLICE_ROWS)).withColumn(
        "parent_pos", F.coalesce("parent_pos", F.lit(-1))
    )
    local = cut_rows.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*family, "_slice").orderBy("pos"))
    )
    before = Window.partitionBy(*family).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    off = (
        cut_rows.groupBy(*family, "_slice")
        .agg(F.count("*").alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        local.join(off, [*family, "_slice"])
        .withColumn("sibling", F.col("_rn") + F.col("_off") - 1)
        .withColumn("parent_pos", F.nullif("parent_pos", F.lit(-1)))
        .drop("_slice", "_rn", "_off")
    )


def compress_tree(events, min_run: int = 3, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None):
    """Same-tool single-child chains of the tree as runs: one row per run or lone event.

    A run shorter than ``min_run`` is opened up again when its head hangs below an only
    child link or is a root; below a branching event it stays one row.
    """
    g = graph_of(events, scope, graph)
    keys = [*g.scope, "pos"]
    tree = cut(first_parent(g))
    kids = tree.groupBy(*g.scope, "parent_pos").agg(F.count("*").alias("kids"))
    marked = tree.join(kids, [*g.scope, "parent_pos"])
    merge = marked.filter("kids = 1 AND child_tool = parent_tool").select(
        *g.scope, F.col("parent_pos").alias("src"), F.col("child_pos").alias("dst")
    )
    links = tree.select(*g.scope, F.col("parent_pos").alias("src"), F.col("child_pos").alias("dst"))
    placed = g.levels(g.nodes, links).select(*keys)
    member = (
        g.labels(merge.join(placed.withColumnRenamed("pos", "dst"), [*g.scope, "dst"], "left_semi"))
        .join(placed, keys, "left_semi")
        .join(_ids(g).select(*keys, "event_id", "tool_name"), keys)
    )
    inner = merge.select(*g.scope, F.col("dst").alias("pos"), F.lit(1).alias("merged"))
    member = member.join(inner, keys, "left")
    runs = member.groupBy(*g.scope, "label").agg(
        F.count("*").alias("length"),
        F.min_by("pos", F.when(F.col("merged").isNull(), F.lit(0)).otherwise(1)).alias("head_pos"),
    )
    above = marked.select(*g.scope, F.col("child_pos").alias("head_pos"), F.col("kids").alias("siblings"))
    runs = runs.join(above, [*g.scope, "head_pos"], "left").withColumn(
        "keep",
        (F.col("length") == 1) | (F.col("length") >= min_run) | (F.coalesce("siblings", F.lit(1)) > 1),
    )
    full = member.join(runs, [*g.scope, "label"])
    return (
        full.withColumn("run_pos", F.when(F.col("keep"), F.col("head_pos")).otherwise(F.col("pos")))
        .groupBy(*g.scope, "run_pos")
        .agg(
            F.min_by("event_id", F.abs(F.col("pos") - F.col("run_pos"))).alias("run_id"),
            F.first("tool_name").alias("tool_name"),
            F.count("*").alias("run_length"),
        )
        .select(*g.scope, "run_id", "tool_name", "run_length")
    )


def causal_chain(events, targets: DataFrame, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None):
    """Walk from each target to its origin along the first listed parent.

    ``targets`` holds the scope columns and ``event_id``. Step 0 is the origin.
    """
    g = graph_of(events, scope, graph)
    keys = [*g.scope, "pos"]
    pointer = g.edges.filter("parent_idx = 0").select(
        *g.scope, F.col("child_pos").alias("src"), F.col("parent_pos").alias("dst")
    )
    seeds = g.nodes.join(targets, [*g.scope, "event_id"], "left_semi").select(
        *keys, F.col("pos").alias("start")
    )
    walked = cut(g.closure(seeds, pointer))
    length = walked.groupBy(*g.scope, "start").agg(F.max("dist").alias("last"))
    names = _ids(g).select(*g.scope, F.col("pos").alias("start"), F.col("event_id").alias("target"))
    return (
        walked.join(length, [*g.scope, "start"])
        .join(names, [*g.scope, "start"])
        .join(_ids(g), keys)
        .select(*g.scope, "target", (F.col("last") - F.col("dist")).alias("step"), "event_id", "tool_name")
    )


# -- reachability ------------------------------------------------------------


def descendants(events, starts: DataFrame, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None):
    """Pairs of start event and each event it leads to."""
    g = graph_of(events, scope, graph)
    return _reached(g, starts, g.down(), "descendant")


def ancestors(events, starts: DataFrame, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None):
    """Pairs of start event and each event it goes back to."""
    g = graph_of(events, scope, graph)
    return _reached(g, starts, g.up(), "ancestor")


def _reached(g: TraceGraph, starts: DataFrame, links: DataFrame, name: str) -> DataFrame:
    seeds = g.nodes.join(starts, [*g.scope, "event_id"], "left_semi").select(
        *g.scope, "pos", F.col("pos").alias("start")
    )
    heads = _ids(g).select(*g.scope, F.col("pos").alias("start"), F.col("event_id").alias("start_id"))
    ends = _ids(g).select(*g.scope, "pos", F.col("event_id").alias(name))
    return (
        g.closure(seeds, links)
        .filter("dist > 0")
        .join(heads, [*g.scope, "start"])
        .join(ends, [*g.scope, "pos"])
        .select(*g.scope, F.col("start_id").alias("start"), name, F.col("dist").alias("distance"))
    )


def branch_collapse_pairs(events, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None):
    """(event, root) rows for every event that at least two roots reach."""
    g = graph_of(events, scope, graph)
    many = _collapsed(g).select(*g.scope, "pos")
    tops = root_nodes(g).select(*g.scope, "pos", F.col("pos").alias("start"))
    heads = _ids(g).select(*g.scope, F.col("pos").alias("start"), F.col("event_id").alias("root_id"))
    return (
        g.closure(tops, g.down())
        .join(many, [*g.scope, "pos"], "left_semi")
        .join(heads, [*g.scope, "start"])
        .join(_ids(g), [*g.scope, "pos"])
        .select(*g.scope, "event_id", "root_id")
    )


def branch_collapse(events, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None):
    """Events that at least two roots reach, with the number of such roots."""
    g = graph_of(events, scope, graph)
    return (
        _collapsed(g)
        .join(_ids(g), [*g.scope, "pos"])
        .select(*g.scope, "event_id", "tool_name", F.col("seeds").alias("incoming_branches"))
    )


def _collapsed(g: TraceGraph) -> DataFrame:
    return g.arrivals(root_nodes(g).select(*g.scope, "pos"), g.down()).filter("seeds >= 2")


def collapsed_sessions(events, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None):
    """Scopes with a collapse point, without listing pairs.

    Some event lies below two roots exactly when its earliest and latest root differ.
    """
    g = graph_of(events, scope, graph)
    keys = [*g.scope, "pos"]
    tops = root_nodes(g).select(*keys, F.col("pos").alias("top"))
    marked = g.nodes.select(*keys).join(tops, keys, "left")
    return g.extent(g.down(), marked, "top").filter("early <> last").select(*g.scope).distinct()


def branch_persistence(events, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None):
    """Per branch start: time span of the start and its descendants, and their number."""
    g = graph_of(events, scope, graph)
    timed = TimedGraph(g)
    starts = branch_starts(events, g.scope, g.edges).select(*g.scope, "pos")
    names = _ids(g).select(*g.scope, F.col("pos").alias("start"), F.col("event_id").alias("branch_id"))
    return (
        timed.reach(starts)
        .join(names, [*g.scope, "start"])
        .select(
            *g.scope,
            "branch_id",
            F.coalesce((F.col("high") - F.col("low")) / F.lit(1e6), F.lit(0.0)).alias("lifespan"),
            (F.col("reached") - 1).alias("descendants"),
        )
    )


class TimedGraph:
    """A graph whose node value is the event time in microseconds."""

    def __init__(self, g: TraceGraph):
        self.g = g

    def reach(self, starts: DataFrame) -> DataFrame:
        g = self.g
        nodes = g.nodes
        try:
            g.nodes = nodes.withColumn("micros", F.unix_micros("ts"))
            return g.reach(starts, g.down(), "micros")
        finally:
            g.nodes = nodes


def frontier_width(events, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None):
    """Number of branches active at each event: from a branch's first to last member."""
    g = graph_of(events, scope, graph)
    keys = [*g.scope, "pos"]
    starts = branch_starts(events, g.scope, g.edges).select(*keys)
    spans = starts.join(g.extent(g.up()), keys)
    mark = F.array(
        F.struct(F.col("early").alias("pos"), F.lit(1).alias("d")),
        F.struct((F.col("last") + 1).alias("pos"), F.lit(-1).alias("d")),
    )
    steps = spans.select(*g.scope, F.inline(mark))
    steps = steps.groupBy(*keys).agg(F.sum("d").alias("d"))
    at = events.select(*g.scope, "pos", "event_id").join(steps, keys, "left").fillna(0, ["d"])
    return running_sum(at, {"width": F.col("d")}, g.scope).select(*g.scope, "event_id", "width")


def frontier_summary(events, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None):
    return (
        frontier_width(events, scope, graph)
        .groupBy(*scope)
        .agg(F.max("width").alias("max_width"), F.avg("width").alias("avg_width"))
    )


def cyclic_groups(g: TraceGraph, down: DataFrame) -> DataFrame:
    """Nodes on cycles of the ``down`` edges, with the group (scope, pos, colour) they form.

    Events that sort topologically in either direction are cleared first. What is left is
    coloured by the latest event leading to it; the events of a colour that lead back to
    the colour's own event form a group, and the rest goes round again.
    """
    keys = [*g.scope, "pos"]
    up = down.select(*g.scope, F.col("dst").alias("src"), F.col("src").alias("dst"))
    left = cut(
        g.nodes.select(*keys)
        .join(g.levels(g.nodes, down), keys, "left_anti")
        .join(g.levels(g.nodes, up), keys, "left_anti")
    )
    found = None
    while not left.isEmpty():
        links = cut(
            down.join(left.withColumnRenamed("pos", "src"), [*g.scope, "src"], "left_semi").join(
                left.withColumnRenamed("pos", "dst"), [*g.scope, "dst"], "left_semi"
            )
        )
        colour = cut(g.spread(left, F.col("pos"), links).withColumnRenamed("value", "colour"))
        at_src = colour.select(*g.scope, F.col("pos").alias("src"), F.col("colour").alias("cs"))
        at_dst = colour.select(*g.scope, F.col("pos").alias("dst"), F.col("colour").alias("cd"))
        same = (
            links.join(at_src, [*g.scope, "src"])
            .join(at_dst, [*g.scope, "dst"])
            .filter("cs = cd")
            .select(*g.scope, F.col("dst").alias("src"), F.col("src").alias("dst"))
        )
        back = g.spread(colour, F.when(F.col("pos") == F.col("colour"), 1), same)
        group = cut(back.filter("value = 1").select(*keys).join(colour, keys))
        loops = links.filter("src = dst").select(*g.scope, F.col("src").alias("colour"))
        big = group.groupBy(*g.scope, "colour").agg(F.count("*").alias("n")).filter("n > 1")
        real = big.select(*g.scope, "colour").unionByName(loops).distinct()
        cyclic = group.join(real, [*g.scope, "colour"], "left_semi")
        found = cyclic if found is None else found.unionByName(cyclic)
        left = cut(left.join(group, keys, "left_anti"))
    return found if found is not None else left.withColumn("colour", F.col("pos"))


def cycle_nodes(events, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None) -> DataFrame:
    """Events that lie on a causal cycle."""
    g = graph_of(events, scope, graph)
    return (
        cyclic_groups(g, g.down())
        .join(_ids(g), [*g.scope, "pos"])
        .select(*g.scope, "event_id", "tool_name")
    )


def closing_links(events, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None) -> DataFrame:
    """Parent references that :func:`break_cycles` drops: ``event_id, parent``."""
    g = graph_of(events, scope, graph)
    child = _ids(g).select(*g.scope, F.col("pos").alias("dst"), "event_id")
    parent = _ids(g).select(*g.scope, F.col("pos").alias("src"), F.col("event_id").alias("parent"))
    dropped = g.closing(g.down()).distinct()
    return dropped.join(child, [*g.scope, "dst"]).join(parent, [*g.scope, "src"]).select(*g.scope, "event_id", "parent")


def break_cycles(events, scope: Sequence[str] = SESSION, graph: TraceGraph | None = None) -> DataFrame:
    """Drop parent references that close a cycle, in event order.

    A scan over the events in order leaves no cycle through an event it has passed. So a
    reference falls exactly if the event leads to that parent over events from itself on,
    in the graph as it was. That is one pass of bits, whatever the number of cycles.
    """
    g = graph_of(events, scope, graph)
    dropped = cut(g.closing(g.down()).distinct())
    if dropped.isEmpty():
        return events
    names = _ids(g)
    lost = (
        dropped.join(
            names.select(*g.scope, F.col("pos").alias("src"), F.col("event_id").alias("parent")),
            [*g.scope, "src"],
        )
        .groupBy(*g.scope, F.col("dst").alias("pos"))
        .agg(F.collect_set("parent").alias("_lost"))
    )
    kept = events.join(lost, [*g.scope, "pos"], "left")
    parents = F.filter("parents", lambda p: ~F.array_contains("_lost", p))
    return (
        kept.withColumn("parents", F.when(F.col("_lost").isNull(), F.col("parents")).otherwise(parents))
        .withColumn(
            "parent_event_id",
            F.when(F.col("_lost").isNull(), F.col("parent_event_id")).otherwise(
                F.nullif(F.array_join("parents", ","), F.lit(""))
            ),
        )
        .drop("_lost")
        .select(*events.columns)
    )
