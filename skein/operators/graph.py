"""Causal graphs of all sessions at once, processed in bounded blocks.

A block is a bin of whole small scopes, or a position range of a large scope. Each
kernel call settles a block on its own; results that cross blocks are exchanged with
joins, round by round, until nothing changes. Scopes no larger than a block (the usual
case) take exactly one pass and no loop, also where others are larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from copy import copy
from functools import cached_property, wraps

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import kernels
from skein.operators.edges import SESSION, edges, node_index
from skein.operators.lineage import cut
from skein.operators.ordering import running_sum

BLOCK_ROWS = 1 << 16

# Executors need not have this package installed: kernels travel with the task.
cloudpickle.register_pickle_by_value(kernels)


def by_size(method: Callable) -> Callable:
    """Where a few scopes are larger than a block, only those take the way over blocks.

    The method runs once for the small scopes and once for the large ones; both results
    together are the result.
    """

    @wraps(method)
    def run(self, *args, **kwargs):
        if self.big is None:
            return method(self, *args, **kwargs)
        results = []
        for large in (False, True):
            half = copy(self)
            half.__dict__.pop("profile", None)
            half.large, half.big = large, None
            half.nodes, half.edges = (self.of_size(t, large) for t in (self.nodes, self.edges))
            own = [self.of_size(a, large) if isinstance(a, DataFrame) else a for a in args]
            named = {k: self.of_size(a, large) if isinstance(a, DataFrame) else a for k, a in kwargs.items()}
            results.append(method(half, *own, **named))
        return results[0].unionByName(results[1])

    return run


class TraceGraph:
    """Nodes and local edges of an event table, cut into blocks per scope."""

    def __init__(
        self,
        events: DataFrame,
        scope: Sequence[str] = SESSION,
        pos: str = "pos",
        block_rows: int | None = None,
        node_table: DataFrame | None = None,
        edge_table: DataFrame | None = None,
    ):
        self.scope = list(scope)
        self.block_rows = block_rows or BLOCK_ROWS
        self.nodes = node_table if node_table is not None else cut(node_index(events, scope, pos))
        self.edges = (
            edge_table if edge_table is not None else cut(edges(events, scope, pos, self.nodes))
        )
        size = self.nodes.agg(F.count("*").alias("n"), F.max("pos").alias("top")).first()
        self.large = (size["top"] or 0) > self.block_rows
        spark = self.nodes.sparkSession
        wanted = -(-(size["n"] or 0) // self.block_rows)
        self.bins = max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.big = None  # the large scopes, where there are small ones, too
        if self.large:
            sizes = cut(self.nodes.groupBy(*self.scope).agg((F.max("pos") > self.block_rows).alias("big")))
            if not sizes.filter(~F.col("big")).isEmpty():
                self.big = sizes.filter("big").select(*self.scope)

    def of_size(self, table: DataFrame, large: bool) -> DataFrame:
        """Rows of the large or of the small scopes."""
        return table.join(self.big, self.scope, "left_semi" if large else "left_anti")

    # -- block plumbing -------------------------------------------------------

    def part(self, pos: str) -> Column:
        block = F.floor((F.col(pos) - 1) / self.block_rows)
        return F.pmod(F.xxhash64(*self.scope, block), F.lit(self.bins)).cast("int")

    def _node_rows(self, nodes: DataFrame, value: Column | None = None, pending: Column | None = None):
        value = F.lit(kernels.NONE) if value is None else F.coalesce(value, F.lit(kernels.NONE))
        return nodes.select(
            *self.scope,
            self.part("pos").alias("part"),
            F.lit(0).alias("kind"),
            F.col("pos").cast("bigint").alias("a"),
            (F.lit(0) if pending is None else pending).cast("bigint").alias("b"),
            value.cast("bigint").alias("v"),
        )

    def _edge_rows(self, links: DataFrame) -> DataFrame:
        local = links if not self.large else links.filter(self.part("src") == self.part("dst"))
        return local.select(
            *self.scope,
            self.part("src").alias("part"),
            F.lit(1).alias("kind"),
            F.col("src").cast("bigint").alias("a"),
            F.col("dst").cast("bigint").alias("b"),
            F.lit(0).cast("bigint").alias("v"),
        )

    def _crossing(self, links: DataFrame) -> DataFrame:
        return links.filter(self.part("src") != self.part("dst"))

    def _run(
        self, rows: DataFrame, kernel: Callable, cols: Sequence[str], extra: str | None = None
    ) -> DataFrame:
        scope = self.scope

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = kernels.Block(pa.Table.from_batches(list(batches)), scope)
            result = kernel(block)
            yield from [result] if isinstance(result, pa.RecordBatch) else result

        types = dict(rows.dtypes)
        schema = ", ".join(
            [f"`{c}` {types[c]}" for c in scope]
            + ([extra] if extra else [])
            + [f"`{c}` bigint" for c in cols]
        )
        return rows.groupBy("part").applyInArrow(apply, schema)

    def down(self) -> DataFrame:
        """Edges as (src = parent, dst = child)."""
        return self.edges.select(
            *self.scope, F.col("parent_pos").alias("src"), F.col("child_pos").alias("dst")
        )

    def up(self) -> DataFrame:
        """Edges as (src = child, dst = parent)."""
        return self.edges.select(
            *self.scope, F.col("child_pos").alias("src"), F.col("parent_pos").alias("dst")
        )

    # -- fixpoints ------------------------------------------------------------

    @by_size
    def spread(self, nodes: DataFrame, value: Column, links: DataFrame) -> DataFrame:
        """Largest ``value`` among a node and all nodes leading to it along ``links``."""
        keys = [*self.scope, "pos"]
        rows = self._edge_rows(links)

        def settle(table: DataFrame, start: Column) -> DataFrame:
            return self._run(self._node_rows(table, start).unionByName(rows), kernels.spread, ["pos", "value"])

        out = settle(nodes, value)
        if not self.large:
            return out.withColumn("value", F.nullif("value", F.lit(kernels.NONE)))
        out = cut(out)
        crossing = cut(self._crossing(links))
        while True:
            arriving = (
                crossing.join(out.withColumnRenamed("pos", "src"), [*self.scope, "src"])
                .groupBy(*self.scope, F.col("dst").alias("pos"))
                .agg(F.max("value").alias("incoming"))
            )
            better = cut(arriving.join(out, keys).filter("incoming > value").select(*keys, "incoming"))
            if better.isEmpty():
                return out.withColumn("value", F.nullif("value", F.lit(kernels.NONE)))
            merged = out.join(better, keys, "left").withColumn(
                "value", F.coalesce("incoming", "value")
            )
            out = cut(settle(merged, F.col("value")))

    @by_size
    def levels(self, nodes: DataFrame, links: DataFrame) -> DataFrame:
        """Longest-path level below the nodes without incoming links.

        Nodes on or behind a cycle reachable from such a start have no level; cycles that
        no start reaches are ignored.
        """
        cols = ["pos", "value"]
        if not self.large:
            rows = self._node_rows(nodes).unionByName(self._edge_rows(links))
            return self._run(rows, kernels.levels, cols).withColumnRenamed("value", "level")
        keys = [*self.scope, "pos"]
        targets = links.select(*self.scope, F.col("dst").alias("pos")).distinct()
        starts = nodes.join(targets.withColumn("_t", F.lit(1)), keys, "left").withColumn(
            "_go", F.when(F.col("_t").isNull(), F.lit(1))
        )
        reached = cut(
            self.spread(starts, F.col("_go"), links).filter(F.col("value") == 1).select(*keys)
        )
        live = cut(links.join(reached.withColumnRenamed("pos", "src"), [*self.scope, "src"], "left_semi"))
        crossing = cut(self._crossing(live))
        done = None
        todo = reached
        while True:
            ends = crossing.select(*self.scope, "src", F.col("dst").alias("pos"))
            if done is None:
                ends = ends.withColumn("level", F.lit(None).cast("bigint"))
            else:
                ends = ends.join(
                    done.select(*self.scope, F.col("pos").alias("src"), "level"),
                    [*self.scope, "src"],
                    "left",
                )
            outside = ends.groupBy(*keys).agg(
                F.count_if(F.col("level").isNull()).alias("pending"),
                F.max(F.col("level") + 1).alias("base"),
            )
            inner = live
            if done is not None:
                settled = done.select(*self.scope, F.col("pos").alias("src"), "level")
                from_done = (
                    live.filter(self.part("src") == self.part("dst"))
                    .join(settled, [*self.scope, "src"])
                    .groupBy(*self.scope, F.col("dst").alias("pos"))
                    .agg(F.max(F.col("level") + 1).alias("inside"))
                )
                outside = outside.join(from_done, keys, "full").withColumn(
                    "base", F.greatest("base", "inside")
                )
                inner = live.join(settled, [*self.scope, "src"], "left_anti")
            rows = self._node_rows(
                todo.join(outside, keys, "left"),
                F.col("base"),
                F.coalesce(F.col("pending"), F.lit(0)),
            ).unionByName(
                self._edge_rows(
                    inner.join(todo.withColumnRenamed("pos", "dst"), [*self.scope, "dst"], "left_semi")
                )
            )
            fresh = cut(self._run(rows, kernels.levels, cols).withColumnRenamed("value", "level"))
            if fresh.isEmpty():
                return done if done is not None else fresh
            done = fresh if done is None else cut(done.unionByName(fresh))
            todo = cut(todo.join(fresh, keys, "left_anti"))

    @cached_property
    def profile(self) -> DataFrame:
        """Per node: ``up`` and ``out`` degree, ``level`` and ``height`` (null off the order)."""
        return self._profile()

    @by_size
    def _profile(self) -> DataFrame:
        keys = [*self.scope, "pos"]
        if not self.large:
            rows = self._node_rows(self.nodes).unionByName(self._edge_rows(self.down()))
            out = self._run(rows, kernels.profile, ["pos", "up", "out", "level", "height"])
            out = out.withColumn("level", F.nullif("level", F.lit(-1))).withColumn(
                "height", F.nullif("height", F.lit(-1))
            )
            return cut(out)
        level = self.levels(self.nodes, self.down())
        placed = level.select(*keys)
        inner = (
            self.up()
            .join(placed.withColumnRenamed("pos", "src"), [*self.scope, "src"], "left_semi")
            .join(placed.withColumnRenamed("pos", "dst"), [*self.scope, "dst"], "left_semi")
        )
        height = self.levels(placed, cut(inner)).withColumnRenamed("level", "height")
        up = self.down().groupBy(*self.scope, F.col("dst").alias("pos")).agg(F.count("*").alias("up"))
        out = self.down().groupBy(*self.scope, F.col("src").alias("pos")).agg(F.count("*").alias("out"))
        joined = self.nodes.select(*keys)
        for part in (up, out, level, height):
            joined = joined.join(part, keys, "left")
        return cut(joined.fillna(0, ["up", "out"]))

    @by_size
    def extent(self, links: DataFrame, nodes: DataFrame | None = None, value: str = "pos") -> DataFrame:
        """Least and greatest ``value`` among a node and all nodes leading to it."""
        nodes = self.nodes if nodes is None else nodes
        if not self.large:
            rows = self._node_rows(nodes, F.col(value)).unionByName(self._edge_rows(links))
            out = self._run(rows, kernels.extent, ["pos", "early", "last"])
            known = F.col("last") != kernels.NONE
            return out.withColumn("early", F.when(known, F.col("early"))).withColumn(
                "last", F.when(known, F.col("last"))
            )
        last = self.spread(nodes, F.col(value), links).withColumnRenamed("value", "last")
        early = self.spread(nodes, -F.col(value), links)
        early = early.select(*self.scope, "pos", (-F.col("value")).alias("early"))
        return last.join(early, [*self.scope, "pos"])

    def tool_paths(self, shortest: int, longest: int) -> DataFrame:
        """Occurrences of tool sequences, where edges lead forward and no scope is large."""
        tools = self.nodes.select(*self.scope, F.col("pos").alias("a"), "tool_name")
        rows = (
            self._node_rows(self.nodes)
            .join(tools, [*self.scope, "a"])
            .unionByName(self._edge_rows(self.down()).withColumn("tool_name", F.lit("")))
        )

        def kernel(block: kernels.Block) -> Iterator[pa.RecordBatch]:
            enc = block.table["tool_name"].combine_chunks().dictionary_encode()
            codes = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            return kernels.tool_paths(block, codes[block.rows], enc.dictionary, shortest, longest)

        return self._run(rows, kernel, ["occurrences"], "pattern array<string>")

    @by_size
    def closure(self, seeds: DataFrame, links: DataFrame) -> DataFrame:
        """Pairs (start, pos, dist): all nodes each seed reaches, itself included.

        ``seeds`` has the scope columns, ``start`` and ``pos``.
        """
        cols = ["start", "pos", "dist"]
        base = self._node_rows(self.nodes).unionByName(self._edge_rows(links))

        def settle(front: DataFrame) -> DataFrame:
            rows = front.select(
                *self.scope,
                self.part("pos").alias("part"),
                F.lit(2).alias("kind"),
                F.col("start").cast("bigint").alias("a"),
                F.col("pos").cast("bigint").alias("b"),
                F.col("dist").cast("bigint").alias("v"),
            )
            return self._run(base.unionByName(rows), kernels.pairs, cols)

        front = seeds.select(*self.scope, "start", "pos", F.lit(0).alias("dist"))
        found = settle(front)
        if not self.large:
            return found
        found = cut(found)
        crossing = cut(self._crossing(links))
        fresh = found
        while True:
            arriving = (
                fresh.join(crossing.withColumnRenamed("src", "pos"), [*self.scope, "pos"])
                .groupBy(*self.scope, "start", F.col("dst").alias("pos"))
                .agg((F.min("dist") + 1).alias("dist"))
            )
            front = cut(arriving.join(found.hint("merge"), [*self.scope, "start", "pos"], "left_anti"))
            if front.isEmpty():
                return found
            fresh = cut(
                settle(front).join(found.hint("merge"), [*self.scope, "start", "pos"], "left_anti")
            )
            found = cut(found.unionByName(fresh))

    def _seed_rows(self, seeds: DataFrame) -> DataFrame:
        return seeds.select(
            *self.scope,
            self.part("pos").alias("part"),
            F.lit(2).alias("kind"),
            F.col("pos").cast("bigint").alias("a"),
            F.col("pos").cast("bigint").alias("b"),
            F.lit(0).cast("bigint").alias("v"),
        )

    def flow(self, seeds: DataFrame, links: DataFrame, forward_only: bool = False) -> tuple[DataFrame, DataFrame]:
        """Which seeds lead to which node, 64 to a row: ``pos, word, mask``; and each seed's ``lane``.

        Bits pass through a block at once and cross blocks in rounds, with OR; a round is
        needed for each block border that a path crosses. ``forward_only`` keeps a seed's bit
        away from nodes before the seed.
        """
        keys = [*self.scope, "pos"]
        marked = self.nodes.select(*keys).join(seeds.select(*keys).distinct().withColumn("_s", F.lit(1)), keys, "left")
        upto = cut(running_sum(marked, {"upto": F.coalesce("_s", F.lit(0))}, self.scope))
        lanes = upto.filter("_s = 1").select(*keys, (F.col("upto") - 1).alias("lane"))
        base = self._node_rows(upto, F.col("upto")).unionByName(self._edge_rows(links))

        def settle(front: DataFrame) -> DataFrame:
            rows = front.select(
                *self.scope,
                self.part("pos").alias("part"),
                F.lit(2).alias("kind"),
                F.col("word").cast("bigint").alias("a"),
                F.col("pos").cast("bigint").alias("b"),
                F.col("mask").alias("v"),
            )
            return self._run(base.unionByName(rows), lambda b: kernels.masks(b, forward_only), ["pos", "word", "mask"])

        word = F.floor(F.col("lane") / 64)
        bit = F.expr("shiftleft(1L, cast(pmod(lane, 64) AS int))")
        front = lanes.select(*keys, word.alias("word"), bit.alias("mask"))
        front = front.groupBy(*keys, "word").agg(F.bit_or("mask").alias("mask"))
        found = fresh = cut(settle(front))
        crossing = cut(self._crossing(links))
        while True:
            arriving = (
                fresh.join(crossing.withColumnRenamed("src", "pos"), keys)
                .groupBy(*self.scope, F.col("dst").alias("pos"), "word")
                .agg(F.bit_or("mask").alias("mask"))
            )
            if forward_only:
                room = F.col("upto") - 64 * F.col("word")
                bits = F.when(room >= 64, F.lit(-1).cast("bigint")).when(room <= 0, 0).otherwise(F.expr("shiftleft(1L, cast(upto - 64 * word AS int)) - 1"))
                arriving = arriving.join(upto, keys).select(*keys, "word", F.col("mask").bitwiseAND(bits).alias("mask"))
            known = found.select(*keys, "word", F.col("mask").alias("_m"))
            new = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("_m", F.lit(0).cast("bigint"))))
            front = cut(arriving.join(known, [*keys, "word"], "left").select(*keys, "word", new.alias("mask")).filter("mask <> 0"))
            if front.isEmpty():
                return found, lanes
            fresh = settle(front).join(known, [*keys, "word"], "left").select(*keys, "word", new.alias("mask")).filter("mask <> 0")
            fresh = cut(fresh)
            found = cut(found.unionByName(fresh).groupBy(*keys, "word").agg(F.bit_or("mask").alias("mask")))

    @by_size
    def reach(self, seeds: DataFrame, links: DataFrame, value: str | None = None) -> DataFrame:
        """Per seed: distinct nodes reached (itself included), least and greatest value.

        Seeds travel as bits of a node's row, so no pair of seed and node is ever a row.
        """
        own = F.col(value) if value else F.lit(None).cast("bigint")
        if not self.large:
            rows = self._node_rows(self.nodes, own).unionByName(self._edge_rows(links)).unionByName(self._seed_rows(seeds))
            out = self._run(rows, kernels.reach, ["start", "reached", "low", "high"])
        else:
            found, lanes = self.flow(seeds, links)
            valued = found.join(self.nodes.select(*self.scope, "pos", own.alias("value")), [*self.scope, "pos"])
            scope, types = self.scope, dict(found.dtypes)
            schema = ", ".join(f"`{c}` {types[c]}" for c in scope) + ", word bigint, bit bigint, n bigint, low bigint, high bigint"
            sums = valued.select(*scope, "word", "mask", "value").mapInArrow(lambda batches: kernels.bit_sums(batches, scope), schema)
            sums = sums.groupBy(*scope, (F.col("word") * 64 + F.col("bit")).alias("lane")).agg(
                F.sum("n").alias("reached"), F.min("low").alias("low"), F.max("high").alias("high")
            )
            out = sums.join(lanes, [*scope, "lane"]).select(*scope, F.col("pos").alias("start"), "reached", "low", "high")
        empty = F.col("high") == kernels.NONE
        return out.withColumn("low", F.when(~empty, F.col("low"))).withColumn("high", F.when(~empty, F.col("high")))

    @by_size
    def arrivals(self, seeds: DataFrame, links: DataFrame) -> DataFrame:
        """Per node: the number of seeds that lead to it (itself included); no pair is a row."""
        if not self.large:
            rows = self._node_rows(self.nodes).unionByName(self._edge_rows(links)).unionByName(self._seed_rows(seeds))
            return self._run(rows, kernels.arrivals, ["pos", "seeds"])
        found, _ = self.flow(seeds, links)
        return found.groupBy(*self.scope, "pos").agg(F.sum(F.bit_count("mask")).cast("bigint").alias("seeds"))

    @by_size
    def closing(self, links: DataFrame) -> DataFrame:
        """Links (src, dst) to an earlier node or itself that close a cycle of nodes from ``dst`` on."""
        back = links.filter("src >= dst")
        seeds = back.select(*self.scope, F.col("dst").alias("pos")).distinct()
        if not self.large:
            rows = self._node_rows(self.nodes).unionByName(self._edge_rows(links)).unionByName(self._seed_rows(seeds))
            return self._run(rows, kernels.closing, ["src", "dst"])
        found, lanes = self.flow(cut(seeds), links, forward_only=True)
        at = back.join(lanes.withColumnRenamed("pos", "dst"), [*self.scope, "dst"]).withColumn("word", F.floor(F.col("lane") / 64))
        bits = found.withColumnRenamed("pos", "src")
        hit = F.expr("shiftright(mask, cast(pmod(lane, 64) AS int)) & 1") == 1
        return at.join(bits, [*self.scope, "src", "word"]).filter(hit).select(*self.scope, "src", "dst")

    @by_size
    def labels(self, links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
        """Smallest position in each node's weakly connected piece."""
        nodes = self.nodes if nodes is None else nodes
        rows = self._node_rows(nodes).unionByName(self._edge_rows(links))
        out = self._run(rows, kernels.labels, ["pos", "value"]).withColumnRenamed("value", "label")
        if not self.large:
            return out
        out = cut(out)
        own = out.select(*self.scope, F.col("pos").alias("_p"), "label")
        joined = (
            self._crossing(links)
            .join(own.select(*self.scope, F.col("_p").alias("src"), F.col("label").alias("a")), [*self.scope, "src"])
            .join(own.select(*self.scope, F.col("_p").alias("dst"), F.col("label").alias("b")), [*self.scope, "dst"])
            .filter("a <> b")
        )
        both = joined.select(*self.scope, "a", "b").unionByName(
            joined.select(*self.scope, F.col("b").alias("a"), F.col("a").alias("b"))
        )
        both = cut(both.distinct())
        piece = cut(both.select(*self.scope, "a").distinct().withColumn("to", F.col("a")))
        while True:
            near = (
                both.join(
                    piece.select(*self.scope, F.col("a").alias("b"), F.col("to").alias("_n")),
                    [*self.scope, "b"],
                )
                .groupBy(*self.scope, "a")
                .agg(F.min("_n").alias("_n"))
            )
            hooked = piece.join(near, [*self.scope, "a"]).select(
                *self.scope, "a", "to", F.least("to", "_n").alias("new")
            )
            hooked = cut(hooked)
            jump = hooked.select(*self.scope, F.col("a").alias("new"), F.col("new").alias("_j"))
            nxt = cut(
                hooked.join(jump, [*self.scope, "new"]).select(
                    *self.scope, "a", F.least("new", "_j").alias("to"), F.col("to").alias("old")
                )
            )
            if nxt.filter("to <> old").isEmpty():
                break
            piece = nxt.drop("old")
        final = piece.select(*self.scope, F.col("a").alias("label"), "to")
        return out.join(final, [*self.scope, "label"], "left").select(
            *self.scope, "pos", F.coalesce("to", "label").alias("label")
        )
