"""Array kernels for one block of a causal graph.

Spark decides what a block is, moves the rows and exchanges what crosses blocks (see
``graph.py``). A kernel receives the rows of one block as an Arrow table:

    kind 0: node   a = position, b = pending parents outside, v = start value
    kind 1: edge   a = source position, b = target position
    kind 2: seed   a = start position, b = node position, v = distance so far
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

NONE = np.iinfo(np.int64).min
PAIR_BUDGET = 4_000_000
#: Words of 64 seeds that pass a block together.
WORDS = 8


class Block:
    """Node and edge arrays of a block; nodes ordered by (scope, position)."""

    def __init__(self, table: pa.Table, scope: list[str]):
        codes = np.zeros(table.num_rows, dtype=np.int64)
        for name in scope:
            enc = table[name].combine_chunks().dictionary_encode()
            codes = codes * max(len(enc.dictionary), 1) + enc.indices.to_numpy(zero_copy_only=False)
        kind = table["kind"].to_numpy()
        a, b = table["a"].to_numpy(), table["b"].to_numpy()
        v = table["v"].to_numpy()
        self.table, self.scope = table, scope
        self.span = int(max(a.max(initial=0), b.max(initial=0))) + 1
        rows = np.flatnonzero(kind == 0)
        keys = codes[rows] * self.span + a[rows]
        order = np.argsort(keys, kind="stable")
        self.rows, self.keys = rows[order], keys[order]
        self.n = len(rows)
        self.pos, self.pending, self.value = a[self.rows], b[self.rows], v[self.rows]
        self.code = codes[self.rows]
        e = np.flatnonzero(kind == 1)
        self.src = np.searchsorted(self.keys, codes[e] * self.span + a[e])
        self.dst = np.searchsorted(self.keys, codes[e] * self.span + b[e])
        s = np.flatnonzero(kind == 2)
        self.seed_start, self.seed_dist = a[s], v[s]
        self.seed_node = np.searchsorted(self.keys, codes[s] * self.span + b[s])

    def out(self, idx: np.ndarray, **cols: np.ndarray) -> pa.RecordBatch:
        """Scope columns of the given nodes next to integer result columns."""
        keep = self.table.select(self.scope).take(pa.array(self.rows[idx]))
        arrays = [keep[c].combine_chunks() for c in self.scope]
        arrays += [pa.array(c, type=pa.int64()) for c in cols.values()]
        return pa.RecordBatch.from_arrays(arrays, names=[*self.scope, *cols])


class Adjacency:
    """Outgoing edges in compressed form; expands a whole frontier at once."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        order = np.argsort(src, kind="stable")
        self.dst = dst[order]
        self.start = np.searchsorted(src[order], np.arange(n + 1))

    def expand(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into ``nodes`` and target for every edge leaving the frontier."""
        first, count = self.start[nodes], self.start[nodes + 1] - self.start[nodes]
        total = int(count.sum())
        which = np.repeat(np.arange(len(nodes)), count)
        step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        return which, self.dst[first[which] + step]


def _levels(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Longest-path level, and which nodes sort topologically below the starts."""
    indeg = np.bincount(block.dst, minlength=block.n)
    starts = (indeg == 0) | (block.value >= 0) | (block.pending > 0)
    adj = Adjacency(block.n, block.src, block.dst)
    reached = starts.copy()
    front = np.flatnonzero(starts)
    while len(front):
        _, nxt = adj.expand(front)
        front = np.unique(nxt[~reached[nxt]])
        reached[front] = True
    live = reached[block.src]
    waiting = np.bincount(block.dst[live], minlength=block.n) + block.pending
    level = np.where(block.value >= 0, block.value, 0)
    return _sweep(adj, reached & (waiting == 0), waiting, level)


def _sweep(adj: Adjacency, done: np.ndarray, waiting: np.ndarray, level: np.ndarray):
    """Pass levels along edges; a node goes on once all its incoming edges arrived."""
    front = np.flatnonzero(done)
    while len(front):
        which, nxt = adj.expand(front)
        np.maximum.at(level, nxt, level[front[which]] + 1)
        np.subtract.at(waiting, nxt, 1)
        front = np.unique(nxt[(waiting[nxt] == 0) & ~done[nxt]])
        done[front] = True
    return level, done


def levels(block: Block) -> pa.RecordBatch:
    """Level of every node that has one."""
    level, done = _levels(block)
    idx = np.flatnonzero(done)
    return block.out(idx, pos=block.pos[idx], value=level[idx])


def profile(block: Block) -> pa.RecordBatch:
    """Degrees, level from the roots and height above the leaves of every node."""
    level, done = _levels(block)
    keep = done[block.src] & done[block.dst]
    src, dst = block.src[keep], block.dst[keep]
    waiting = np.bincount(src, minlength=block.n)
    height, _ = _sweep(
        Adjacency(block.n, dst, src),
        done & (waiting == 0),
        waiting,
        np.zeros(block.n, dtype=np.int64),
    )
    return block.out(
        np.arange(block.n),
        pos=block.pos,
        up=np.bincount(block.dst, minlength=block.n),
        out=np.bincount(block.src, minlength=block.n),
        level=np.where(done, level, -1),
        height=np.where(done, height, -1),
    )


def tool_paths(block: Block, tag: np.ndarray, names: pa.Array, shortest: int, longest: int):
    """Occurrences of every tool sequence along paths, for edges that only lead forward.

    Carries the number of paths per (last node, sequence); sequences are numbered per
    scope and length, each remembering its prefix.
    """
    adj = Adjacency(block.n, block.src, block.dst)
    wide = len(names)
    key, pattern = np.unique(block.code * wide + tag, return_inverse=True)
    owner = np.zeros(len(key), dtype=np.int64)
    owner[pattern] = np.arange(block.n)
    spelled = [[names[int(k % wide)].as_py()] for k in key]
    node, count = np.arange(block.n), np.ones(block.n, dtype=np.int64)
    for length in range(1, longest + 1):
        if length > 1:
            which, nxt = adj.expand(node)
            key, grown = np.unique(pattern[which] * wide + tag[nxt], return_inverse=True)
            spelled = [spelled[k // wide] + [names[int(k % wide)].as_py()] for k in key]
            owner_next = np.zeros(len(key), dtype=np.int64)
            owner_next[grown] = nxt
            state, place = np.unique(nxt * max(len(key), 1) + grown, return_inverse=True)
            total = np.zeros(len(state), dtype=np.int64)
            np.add.at(total, place, count[which])
            node, pattern = state // max(len(key), 1), state % max(len(key), 1)
            count, owner = total, owner_next
        if not len(node):
            return
        if length >= shortest:
            seen = np.zeros(len(spelled), dtype=np.int64)
            np.add.at(seen, pattern, count)
            batch = block.out(owner, occurrences=seen)
            words = pa.array(spelled, type=pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], words, batch.columns[-1]],
                names=[*block.scope, "pattern", "occurrences"],
            )


def spread(block: Block) -> pa.RecordBatch:
    """Largest start value among each node and everything that leads to it."""
    best = block.value.copy()
    adj = Adjacency(block.n, block.src, block.dst)
    front = np.flatnonzero(best != NONE)
    while len(front):
        which, nxt = adj.expand(front)
        cand = best[front[which]]
        better = cand > best[nxt]
        np.maximum.at(best, nxt[better], cand[better])
        front = np.unique(nxt[better])
    idx = np.arange(block.n)
    return block.out(idx, pos=block.pos, value=best)


def extent(block: Block) -> pa.RecordBatch:
    """Least and greatest start value among each node and everything that leads to it."""
    adj = Adjacency(block.n, block.src, block.dst)
    high = block.value.copy()
    low = np.where(high == NONE, np.iinfo(np.int64).max, high)
    front = np.flatnonzero(high != NONE)
    while len(front):
        which, nxt = adj.expand(front)
        a, b = low[front[which]], high[front[which]]
        better = (a < low[nxt]) | (b > high[nxt])
        np.minimum.at(low, nxt[better], a[better])
        np.maximum.at(high, nxt[better], b[better])
        front = np.unique(nxt[better])
    return block.out(np.arange(block.n), pos=block.pos, early=low, last=high)


def labels(block: Block) -> pa.RecordBatch:
    """Smallest position of the weakly connected piece each node lies in."""
    lab = np.arange(block.n)
    while True:
        a, b = lab[block.src], lab[block.dst]
        split = a != b
        if not split.any():
            break
        np.minimum.at(lab, np.maximum(a, b)[split], np.minimum(a, b)[split])
        while True:
            jump = lab[lab]
            if (jump == lab).all():
                break
            lab = jump
    idx = np.arange(block.n)
    return block.out(idx, pos=block.pos, value=block.pos[lab])


def flow(adj: Adjacency, mask: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """Pass bit rows along edges with OR until nothing changes; ``allowed`` bits may enter a node."""
    front = np.flatnonzero(mask.any(axis=1))
    while len(front):
        which, nxt = adj.expand(front)
        if not len(nxt):
            break
        order = np.argsort(nxt, kind="stable")
        nxt = nxt[order]
        first = np.flatnonzero(np.r_[True, nxt[1:] != nxt[:-1]])
        arriving = np.bitwise_or.reduceat(mask[front[which[order]]], first, axis=0)
        front = nxt[first]
        if allowed is not None:
            arriving &= allowed[front]
        arriving &= ~mask[front]
        new = arriving.any(axis=1)
        front = front[new]
        mask[front] |= arriving[new]
    return mask


def below(count: np.ndarray) -> np.ndarray:
    """Words whose lowest ``count`` bits are set, ``count`` cut to 0..64."""
    count = np.clip(count, 0, 64)
    ones = np.left_shift(np.uint64(1), np.minimum(count, 63).astype(np.uint64)) - np.uint64(1)
    return np.where(count == 64, ~np.uint64(0), ones)


class Lanes:
    """Seeds of a block numbered per scope by position; each is one bit of a node's row."""

    def __init__(self, block: Block):
        self.block = block
        self.adj = Adjacency(block.n, block.src, block.dst)
        self.seed = np.unique(block.seed_node)
        own = block.code[self.seed]
        self.lane = np.arange(len(self.seed)) - np.searchsorted(own, own)

    def passed(self, forward_only: bool = False):
        """Seeds, and node rows of their bits after the pass, ``WORDS * 64`` lanes at a time.

        ``forward_only`` keeps a seed's bit away from nodes before the seed.
        """
        block = self.block
        for low in range(0, int(self.lane.max(initial=-1)) + 1, 64 * WORDS):
            some = np.flatnonzero((self.lane >= low) & (self.lane < low + 64 * WORDS))
            lane = self.lane[some] - low
            words = int(lane.max()) // 64 + 1
            mask = np.zeros((block.n, words), dtype=np.uint64)
            np.bitwise_or.at(mask, (self.seed[some], lane // 64), np.left_shift(np.uint64(1), (lane % 64).astype(np.uint64)))
            allowed = None
            if forward_only:
                before = np.searchsorted(self.seed, np.arange(block.n), side="right")
                before -= np.searchsorted(block.code[self.seed], block.code) + low
                allowed = np.stack([below(before - 64 * w) for w in range(words)], axis=1)
            yield self.seed[some], lane, flow(self.adj, mask, allowed)


def _bit(mask: np.ndarray, lane: int) -> np.ndarray:
    return (mask[:, lane // 64] >> np.uint64(lane % 64)) & np.uint64(1) != 0


def reach(block: Block):
    """Per seed: nodes reached (itself included), least and greatest value among them."""
    lanes = Lanes(block)
    scopes, starts = np.unique(block.code, return_index=True)
    most = np.iinfo(np.int64).max
    for seed, lane, mask in lanes.passed():
        place = np.searchsorted(scopes, block.code[seed])
        found = np.zeros((3, len(seed)), dtype=np.int64)
        for one in np.unique(lane):
            inside = _bit(mask, int(one))
            known = inside & (block.value != NONE)
            sums = (
                np.add.reduceat(inside.astype(np.int64), starts),
                np.minimum.reduceat(np.where(known, block.value, most), starts),
                np.maximum.reduceat(np.where(known, block.value, NONE), starts),
            )
            own = lane == one
            for row, values in zip(found, sums, strict=True):
                row[own] = values[place[own]]
        yield block.out(seed, start=block.pos[seed], reached=found[0], low=found[1], high=found[2])


def arrivals(block: Block) -> pa.RecordBatch:
    """Per node: how many seeds lead to it (itself included)."""
    total = np.zeros(block.n, dtype=np.int64)
    for _, _, mask in Lanes(block).passed():
        total += np.bitwise_count(mask).sum(axis=1, dtype=np.int64)
    return block.out(np.arange(block.n), pos=block.pos, seeds=total)


def closing(block: Block):
    """Edges that lead to a seed from a node which the seed reaches without passing a node before it."""
    back = np.flatnonzero(block.src >= block.dst)
    for seed, lane, mask in Lanes(block).passed(forward_only=True):
        at = np.searchsorted(seed, block.dst[back])
        own = back[(at < len(seed)) & (seed[np.minimum(at, len(seed) - 1)] == block.dst[back])]
        bit = lane[np.searchsorted(seed, block.dst[own])]
        word = mask[block.src[own], bit // 64] >> (bit % 64).astype(np.uint64)
        own = own[word & np.uint64(1) != 0]
        yield block.out(block.src[own], src=block.pos[block.src[own]], dst=block.pos[block.dst[own]])


def masks(block: Block, forward_only: bool):
    """Rows (node, word, bits) after a pass that starts at the given rows: kind 2 with node, word and bits.

    With ``forward_only`` a node's value is the number of seeds of its scope up to it.
    """
    adj = Adjacency(block.n, block.src, block.dst)
    word, bits = block.seed_start, block.seed_dist.view(np.uint64)
    for one in np.unique(word):
        some = word == one
        mask = np.zeros((block.n, 1), dtype=np.uint64)
        np.bitwise_or.at(mask, (block.seed_node[some], 0), bits[some])
        allowed = below(block.value - 64 * one)[:, None] if forward_only else None
        flow(adj, mask, allowed)
        idx = np.flatnonzero(mask[:, 0])
        yield block.out(idx, pos=block.pos[idx], word=np.full(len(idx), one), mask=mask[idx, 0].view(np.int64))


def bit_sums(batches, scope: list[str]):
    """Per (scope, word, bit) of rows with ``word, mask, value``: rows, least and greatest value."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        codes = np.zeros(table.num_rows, dtype=np.int64)
        for name in [*scope, "word"]:
            enc = table[name].combine_chunks().dictionary_encode()
            codes = codes * max(len(enc.dictionary), 1) + enc.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        if not len(order):
            continue
        starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
        mask = table["mask"].to_numpy()[order].view(np.uint64)[:, None]
        value = table["value"].fill_null(NONE).to_numpy()[order]
        heads = table.select([*scope, "word"]).take(pa.array(order[starts])).combine_chunks()
        for bit in range(64):
            inside = _bit(mask, bit)
            known = inside & (value != NONE)
            n = np.add.reduceat(inside.astype(np.int64), starts)
            low = np.minimum.reduceat(np.where(known, value, np.iinfo(np.int64).max), starts)
            high = np.maximum.reduceat(np.where(known, value, NONE), starts)
            keep = np.flatnonzero(n)
            own = heads.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [*(own[c].combine_chunks() if isinstance(own[c], pa.ChunkedArray) else own[c] for c in [*scope, "word"]), pa.array(np.full(len(keep), bit)), *(pa.array(x[keep]) for x in (n, low, high))],
                names=[*scope, "word", "bit", "n", "low", "high"],
            )


def pairs(block: Block):
    """Everything reachable from each seed, breadth first, in bounded slices of seeds."""
    adj = Adjacency(block.n, block.src, block.dst)
    begin = np.searchsorted(block.code, block.code)
    size = np.searchsorted(block.code, block.code, side="right") - begin
    lane_key = block.code[block.seed_node] * block.span + block.seed_start
    order = np.argsort(lane_key, kind="stable")
    node, start, dist = block.seed_node[order], block.seed_start[order], block.seed_dist[order]
    fresh = np.r_[True, np.diff(lane_key[order]) != 0] if len(order) else np.zeros(0, bool)
    lane = np.cumsum(fresh) - 1
    heads = node[fresh]
    weight = np.cumsum(size[heads])
    cut_of_lane = (weight - 1) // PAIR_BUDGET if len(heads) else np.zeros(0, np.int64)
    for cut in np.unique(cut_of_lane):
        lanes = np.flatnonzero(cut_of_lane == cut)
        pick = np.flatnonzero((lane >= lanes[0]) & (lane <= lanes[-1]))
        base = np.zeros(len(lanes), dtype=np.int64)
        base[1:] = np.cumsum(size[heads[lanes]])[:-1]
        base -= begin[heads[lanes]]
        total = int(size[heads[lanes]].sum())
        seen = np.full(total, NONE, dtype=np.int64)
        ln, nd, ds = lane[pick] - lanes[0], node[pick], dist[pick]
        lane_start = start[np.flatnonzero(fresh)[lanes]]
        by_dist = np.argsort(ds, kind="stable")
        queue_l, queue_n, queue_d = ln[by_dist], nd[by_dist], ds[by_dist]
        out_l, out_n, out_d = [], [], []
        step = int(queue_d[0]) if len(queue_d) else 0
        fl, fn = np.zeros(0, np.int64), np.zeros(0, np.int64)
        qi = 0
        while len(fl) or qi < len(queue_d):
            if not len(fl):
                step = int(queue_d[qi])
            qj = qi + int(np.searchsorted(queue_d[qi:], step, side="right"))
            fl, fn = np.r_[fl, queue_l[qi:qj]], np.r_[fn, queue_n[qi:qj]]
            qi = qj
            slot = base[fl] + fn
            new = np.unique(slot[seen[slot] == NONE], return_index=True)[1]
            keep = np.flatnonzero(seen[slot] == NONE)[new]
            fl, fn = fl[keep], fn[keep]
            seen[base[fl] + fn] = step
            out_l.append(fl), out_n.append(fn), out_d.append(np.full(len(fl), step))
            which, nxt = adj.expand(fn)
            fl, fn = fl[which], nxt
            step += 1
        ol, on, od = np.concatenate(out_l), np.concatenate(out_n), np.concatenate(out_d)
        yield block.out(on, start=lane_start[ol], pos=block.pos[on], dist=od)
