"""Small causal graphs with known measures."""

SHAPES = {
    "chain": [("root", "Read", ""), ("a", "Bash", "root"), ("b", "Edit", "a"), ("c", "Read", "b")],
    "fan-in": [("root_a", "Read", ""), ("root_b", "Grep", ""), ("target", "Edit", "root_a,root_b")],
    "deep-merge": [("root", "Read", ""), ("a", "Bash", "root"), ("b", "Grep", "root"), ("c", "Edit", "a,b")],
    "diamond": [
        ("root", "Read", ""),
        ("a", "Bash", "root"),
        ("b", "Grep", "root"),
        ("c", "Edit", "a"),
        ("d", "Write", "b"),
        ("target", "Bash", "c,d"),
    ],
    "fork": [("root", "Read", ""), ("a", "Bash", "root"), ("b", "Grep", "root")],
    "forest": [("a", "Read", ""), ("b", "Bash", "a"), ("c", "Grep", ""), ("d", "Edit", "c"), ("e", "Write", "d")],
    "deep-chain": [(f"n{i:03d}", "Read" if i % 2 == 0 else "Bash", f"n{i - 1:03d}" if i else "") for i in range(10)],
    "uneven": [
        ("r", "A", ""),
        ("a", "A", "r"),
        ("b", "A", "r"),
        ("l1", "A", "a"),
        ("l2", "A", "l1"),
        ("m", "A", "b,l2"),
        ("z", "A", "m"),
    ],
    "external": [("x", "A", "outside"), ("y", "B", "x")],
    "cycle": [("a", "Bash", "c"), ("b", "Read", "a"), ("c", "Edit", "b")],
    "multi-parent-cycle": [("root", "Read", ""), ("a", "Bash", "root,b"), ("b", "Edit", "a")],
}

# events, roots, leaves, max depth, avg depth, longest path, events on cycles
GOLDEN = {
    "chain": (4, 1, 1, 3, 1.5, "root,a,b,c", 0),
    "fan-in": (3, 2, 1, 1, 0.33, "root_a,target", 0),
    "deep-merge": (4, 1, 1, 2, 1.0, "root,a,c", 0),
    "diamond": (6, 1, 1, 3, 1.5, "root,a,c,target", 0),
    "fork": (3, 1, 2, 1, 0.67, "root,a", 0),
    "forest": (5, 2, 2, 2, 0.8, "c,d,e", 0),
    "deep-chain": (10, 1, 1, 9, 4.5, ",".join(f"n{i:03d}" for i in range(10)), 0),
    "uneven": (7, 1, 1, 5, 2.29, "r,a,l1,l2,m,z", 0),
    "external": (2, 1, 1, 1, 0.5, "x,y", 0),
    "cycle": (3, 0, 0, 0, 0.0, "", 3),
    "multi-parent-cycle": (3, 1, 0, 0, 0.0, "root", 2),
}
