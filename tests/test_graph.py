"""Golden measures of small graphs, and block exchange against single blocks."""

import random

import pytest

from skein.operators import edges as E
from skein.operators import inference as C
from skein.operators import integrity as V
from skein.operators import patterns as P
from skein.operators import structure as S
from skein.operators.graph import TraceGraph
from tests.shapes import GOLDEN, SHAPES


@pytest.fixture(scope="module")
def shapes(make):
    return make(SHAPES).cache()


@pytest.fixture(scope="module")
def graph(shapes):
    return TraceGraph(shapes)


def by_session(df, *cols):
    return {r["session_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_stats(shapes, graph):
    got = by_session(
        S.session_stats(shapes, graph=graph), "event_count", "root_count", "leaf_count", "max_depth", "avg_depth"
    )
    for name, want in GOLDEN.items():
        assert got[name][:4] == want[:4], name
        assert round(got[name][4], 2) == want[4], name


def test_critical_path(shapes, graph):
    paths = {}
    for r in S.critical_path(shapes, graph=graph).orderBy("session_id", "step").collect():
        paths.setdefault(r["session_id"], []).append(r["event_id"])
    for name, want in GOLDEN.items():
        assert ",".join(paths.get(name, [])) == want[5], name


def test_cycles(shapes, graph):
    rows = S.cycle_nodes(shapes, graph=graph).groupBy("session_id").count().collect()
    assert {r[0]: r[1] for r in rows} == {n: g[6] for n, g in GOLDEN.items() if g[6]}


def test_roots_and_components(shapes, graph):
    down = {(r.session_id, r.event_id): r.downstream_count for r in S.find_roots(shapes, graph=graph).collect()}
    assert down[("uneven", "r")] == 6
    assert down[("forest", "c")] == 2
    sizes = sorted(r["size"] for r in S.components(shapes, graph=graph).filter("session_id = 'forest'").collect())
    assert sizes == [2, 3]


def test_break_cycles(shapes, graph):
    kept = S.break_cycles(shapes, graph=graph)
    left = {(r.session_id, r.event_id): r.parent_event_id for r in kept.collect()}
    assert left[("cycle", "a")] is None
    assert left[("cycle", "c")] == "b"
    assert left[("multi-parent-cycle", "a")] == "root"
    assert left[("diamond", "target")] == "c,d"


def test_paths_and_frontier(shapes, graph):
    counts = {
        (r.session_id, ">".join(r.pattern)): r.occurrences
        for r in P.path_counts(shapes, graph=graph).collect()
    }
    assert counts[("deep-chain", "Read>Bash")] == 5
    assert counts[("cycle", "Bash>Read>Edit")] == 1
    width = by_session(S.frontier_summary(shapes, graph=graph), "max_width")
    assert width["fork"] == (2,)


def test_invariants(shapes):
    rows = {(r.session_id, r.check): r.violations for r in V.check_invariants(shapes).collect()}
    assert rows[("external", "local_references")] == 1
    assert rows[("cycle", "acyclicity")] == 3
    assert rows[("chain", "unique_ids")] == 0


def test_fidelity(make):
    ev = make({k: [(i, t.lower(), p) for i, t, p in SHAPES[k]] for k in ("chain", "fan-in", "diamond")})
    got = by_session(C.measure_fidelity(ev), "edge_f1", "fan_in_native", "fan_in_reproduced", "child_exact_agreement")
    assert got["chain"][0] == 1.0
    assert got["fan-in"][1:3] == (1, 1)
    assert got["diamond"][1:3] == (1, 0)
    assert got["diamond"][3] < 0.5


def test_compress_tree(make):
    ev = make(
        {
            "s": [
                ("a", "Read", ""),
                ("b", "Bash", "a"),
                ("c", "Bash", "b"),
                ("d", "Bash", "c"),
                ("e", "Edit", "d"),
                ("f", "Edit", "e"),
            ]
        }
    )
    runs = {(r.run_id, r.run_length) for r in S.compress_tree(ev).collect()}
    assert runs == {("a", 1), ("b", 3), ("e", 1), ("f", 1)}


@pytest.fixture(scope="module")
def tangled(make):
    """Random graphs, a fifth of the links pointing forward."""
    rnd = random.Random(7)
    sessions = {}
    for s in range(2):
        nodes = []
        for i in range(14):
            ps = {rnd.randrange(i) for _ in range(rnd.choice((0, 1, 1, 2)))} if i else set()
            if s == 1 and rnd.random() < 0.2:
                ps.add(rnd.randrange(14))
            nodes.append((f"e{i}", rnd.choice("ABC"), ",".join(f"e{p}" for p in sorted(ps))))
        sessions[f"s{s}"] = nodes
    return make(sessions).cache()


@pytest.mark.parametrize(
    "name",
    ["session_stats", "components", "branch_persistence", "frontier_width", "branch_collapse"],
)
def test_blocks_agree(tangled, name):
    """Cutting sessions into small blocks changes nothing."""
    fn = getattr(S, name)
    whole = sorted(map(tuple, fn(tangled, graph=TraceGraph(tangled)).collect()))
    parts = sorted(map(tuple, fn(tangled, graph=TraceGraph(tangled, block_rows=7)).collect()))
    assert whole == parts and whole


def test_long_chain(make):
    """A chain across many blocks has its full depth."""
    n = 120
    ev = make({"s": [(f"e{i}", "A", f"e{i - 1}" if i else "") for i in range(n)]})
    g = TraceGraph(ev, block_rows=60)
    assert S.node_depths(ev, graph=g).agg({"depth": "max"}).first()[0] == n - 1
    assert E.roots(ev).count() == 1


def random_sessions(seed, sessions, size, ahead):
    rnd = random.Random(seed)
    out = {}
    for s in range(sessions):
        nodes = []
        for i in range(size):
            ps = {rnd.randrange(i) for _ in range(rnd.choice((0, 1, 1, 2)))} if i else set()
            if rnd.random() < ahead:
                ps.add(rnd.randrange(size))
            nodes.append((f"e{i}", rnd.choice("ABC"), ",".join(f"e{p}" for p in sorted(ps))))
        out[f"s{s}"] = nodes
    return out


def scan_breaks(nodes):
    """References that a scan in event order drops, by searching back from each parent."""
    graph = {e: [p for p in ps.split(",") if p] for e, _, ps in nodes}
    lost = set()
    for e, _, _ in nodes:
        kept = []
        for p in graph[e]:
            seen, todo = set(), [p]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += graph.get(x, [])
            if e in seen:
                lost.add((e, p))
            else:
                kept.append(p)
        graph[e] = kept
    return lost


@pytest.mark.parametrize("block_rows", [None, 7])
def test_dropped_references(make, block_rows):
    """Rings, overlapping rings and loops, reference by reference; whole blocks and small ones."""
    sessions = random_sessions(11, 12 if block_rows is None else 3, 14, 0.35)
    sessions["ring"] = [("a", "A", "c"), ("b", "A", "a"), ("c", "A", "b,e"), ("d", "A", "c"), ("e", "A", "d,e")]
    ev = make(sessions)
    got = {}
    for r in S.closing_links(ev, graph=TraceGraph(ev, block_rows=block_rows)).collect():
        got.setdefault(r.session_id, set()).add((r.event_id, r.parent))
    want = {s: lost for s, nodes in sessions.items() if (lost := scan_breaks(nodes))}
    assert got == want and len(want) >= 2
    if block_rows is None:
        assert S.cycle_nodes(S.break_cycles(ev)).count() == 0


def test_few_large_sessions_leave_the_others_on_one_pass(make):
    """Sessions larger than a block go over blocks, the others do not, and results are the same."""
    sessions = random_sessions(3, 3, 40, 0.0)
    for s, nodes in random_sessions(4, 9, 6, 0.1).items():
        sessions[f"small-{s}"] = nodes
    ev = make(sessions).cache()
    whole, mixed = TraceGraph(ev), TraceGraph(ev, block_rows=24)
    for fn in (S.branch_collapse, S.branch_persistence, S.node_depths):
        assert mixed.big is not None and mixed.big.count() == 3
        assert sorted(map(tuple, fn(ev, graph=whole).collect())) == sorted(map(tuple, fn(ev, graph=mixed).collect())), fn.__name__


def test_more_seeds_than_bits(make):
    """More than 512 roots in a session: counts over several passes of words."""
    n = 600
    nodes = [(f"r{i}", "A", "") for i in range(n)] + [("end", "B", ",".join(f"r{i}" for i in range(n)))]
    ev = make({"s": nodes, "t": nodes[:3]})
    for block_rows in (None, 400):
        g = TraceGraph(ev, block_rows=block_rows)
        assert [(r.event_id, r.incoming_branches) for r in S.branch_collapse(ev, graph=g).collect()] == [("end", n)]
        down = S.find_roots(ev, graph=g)
        assert {(r.session_id, r.downstream_count): r["count"] for r in down.groupBy("session_id", "downstream_count").count().collect()} == {("s", 1): n, ("t", 0): 3}
