"""Exact, near and substring dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest

from skein.llm.components import components
from skein.llm.exactdup import exact_groups
from skein.llm.neardup import intersections, near_groups
from skein.llm.substring import repeated_passages

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(docs, texts, keep):
    pick = min if keep == "smallest" else max
    every = texts | {121: ""}
    groups = {}
    for i, t in every.items():
        groups.setdefault(t, []).append(i)
    got = {r.doc_id: r for r in exact_groups(docs, keep=keep).collect()}
    assert got.keys() == every.keys()
    for i, t in every.items():
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (pick(groups[t]), len(groups[t]), i == pick(groups[t]))
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_groups_odd_rows(spark, empty):
    assert exact_groups(empty).count() == 0
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (2, None), (3, "")]
    got = sorted(map(str, exact_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).drop("text_sha256").collect()))
    assert len(got) == 6  # the repeated row is one document
    assert "Row(doc_id=None, keep_id=1, group_size=2, kept=False)" in got
    assert "Row(doc_id=None, keep_id=None, group_size=1, kept=True)" in got
    assert "Row(doc_id=3, keep_id=2, group_size=2, kept=False)" in got


def near_brute(texts, size, percent):
    sets = {}
    for i, t in texts.items():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = SPLIT.findall(low)
        sets[i] = {tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    head = {i: i for i in texts}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                head[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, 128), (5, 80, 4)])
def test_near_groups(docs, texts, size, percent, block, monkeypatch):
    monkeypatch.setattr("skein.llm.neardup.BLOCK", block)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_groups(docs, shingle_words=size, percent=percent).collect()}
    assert got == near_brute(texts | {121: None}, size, percent)


def test_near_groups_odd_rows(spark, empty):
    assert near_groups(empty).count() == 0
    rows = [(5, "a b c"), (5, "a b c"), (None, "A b c"), (7, None), (8, " ")]
    got = sorted(map(tuple, near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle_words=3).collect()), key=str)
    assert got == sorted([(5, 1, None, False), (5, 1, None, False), (None, 1, None, True), (7, 0, 7, True), (8, 0, 8, True)], key=str)


def test_intersections_match_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(25)]
    common = intersections(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert common[i, j] == len(np.intersect1d(a, b))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()))
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def passages_brute(texts, width):
    first = {}
    for i, t in texts.items():
        w = SPLIT.findall(t or "")
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(i, first.get(g, i))
    out = {}
    for i, t in texts.items():
        w = SPLIT.findall(t or "")
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), kept)
    return out


@pytest.mark.parametrize(("width", "seed"), [(13, 6), (50, 12), (4, 4), (2, 1)])
def test_repeated_passages(docs, texts, width, seed):
    rows = repeated_passages(docs, min_words=width, seed_words=seed).collect()
    want = passages_brute(texts | {121: None}, width)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in rows} == want
    for r in rows:
        assert r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest()
        assert sum(s.end - s.begin for s in r.spans) == r.n_removed
        assert all(s.end - s.begin >= width for s in r.spans)


def test_repeated_passages_odd_rows(spark, empty):
    assert repeated_passages(empty).count() == 0
    long = " ".join(f"w{i}" for i in range(20))
    rows = [(None, long), (None, long + " x"), (4, "a " + long), (4, long), (9, long)]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed) for r in repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(False, 0, 20, 0), (False, 0, 21, 0), (True, 4, 20, 20), (True, 4, 21, 20), (True, 9, 20, 20)]


def test_near_rows_of_one_id(spark):
    """An id with two texts is two documents: only the near copy joins the group of the other."""
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"x{i}" for i in range(60))
    rows = [(5, base), (7, base + " tail"), (7, other), (7, other), (9, other + " tail"), (None, "lone words of a row")]
    found = near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle_words=3, percent=85, rows=3, tables=10)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.collect()), key=str)
    assert got == sorted([(5, 58, 5, True), (7, 59, 5, False), (7, 58, 7, True), (7, 58, 7, True), (9, 59, 7, False), (None, 3, None, True)], key=str)


def test_blocks_of_a_family_are_dealt_out(spark):
    """The groups of blocks stand behind an exchange of their own, also where the join by family could serve."""
    from skein.llm import neardup

    members = spark.createDataFrame([(i, 0, False, b"") for i in range(1000)], "rep bigint, family bigint, near boolean, items binary")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = neardup._dealt(members).groupBy("family", "p", "q").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(family" in plan and "p#" in plan[plan.index("REPARTITION_BY_COL") - 80 :]


def test_texts_of_one_hash_are_told_apart_by_their_ids(spark, monkeypatch):
    """Where all texts have one hash, each document still gets its own words cut."""
    from pyspark.sql import functions as F

    monkeypatch.setattr("skein.llm.substring.F.xxhash64", lambda *columns: F.lit(7).cast("bigint"))
    shared = " ".join(f"s{i}" for i in range(20))
    rows = [(1, shared), (2, f"a b {shared}"), (3, f"{shared} c d e"), (4, "x " * 5)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (20, 0, shared), 2: (22, 20, "a b"), 3: (23, 20, "c d e"), 4: (5, 0, "x x x x x")}
