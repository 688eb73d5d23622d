"""Quality rules, toxicity and packing against brute force."""

import random
import re

import numpy as np

from skein.llm import toxicity
from skein.llm.packing import Bins, best_fit_bins
from skein.llm.quality import quality_rules
from skein.llm.toxicity import fit_toxicity, score_toxicity, segments

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_counts(docs, texts, empty):
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for i, t in (texts | {121: ""}).items():
        w = SPLIT.findall(t)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        twice = {g for g in set(windows) if windows.count(g) > 1} if len(w) < 2000 else set()
        covered = {p for k, g in enumerate(windows) if g in twice for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if SPLIT.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        if len(w) < 2000:
            assert r.n_repeat_words == len(covered)
            assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality_rules(empty).count() == 0


def test_quality_rules_name_what_broke(spark):
    good = "The river is wide and the light of the cloud was on the paper that it had with this stone."
    rows = [(1, good), (2, " ".join(w + "###" for w in good.split())), (3, "line one here\n" * 1 + good), (None, None), (None, None)]
    got = [(r.doc_id, r.failed, r.kept) for r in quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert (1, [], True) in got and (2, ["symbols"], False) in got and (3, [], True) in got
    assert sum(x[0] is None and "too_short" in x[1] for x in got) == 2


def brute_segments(scores):
    """Maximal scoring segments by their recursive definition: the best one, then left and right of it."""
    best, at = 0.0, None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > best + 1e-12:
                best, at = total, (a, b + 1)
    if at is None:
        return []
    a, b = at
    return brute_segments(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in brute_segments(scores[b:])]


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(4)
    for n in range(60):
        scores = rng.normal(-0.3, 1.5, n % 25)
        assert [(a, b) for a, b, _ in segments(scores)] == brute_segments(scores.tolist())


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    calm = [f"w{i}word".replace("0", "o") for i in range(300)]
    calm = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in calm]
    rude = ["grobian", "vileword", "nastything"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(calm) for _ in range(rng.randrange(20, 90))]
        toxic = i % 5 == 0
        for _ in range(4 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(rude) + rng.choice(["", "s", "en"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (None, "ok", "x")], "doc_id bigint, text string, score string")
    known = spark.createDataFrame([x for x in labels if x[0] % 4] + [(None, 1), (7777, 1), (3, None)], "doc_id bigint, toxic int")
    got = score_toxicity(df, fit_toxicity(df, known)).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 for r in got)
    held = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 4 == 0}
    right = sum((held[i].score >= 0.3) == (i % 5 == 0) for i in held)
    assert right >= 0.95 * len(held)
    assert any(r.passages for r in held.values()) and all(r.score < 0.01 for r in got if r.doc_id in (900, 901))
    assert score_toxicity(df.limit(0), toxicity.Fit(np.zeros(toxicity.BUCKETS, np.float32))).count() == 0
    nothing = fit_toxicity(df, known.limit(0))
    assert len({r.score for r in score_toxicity(df, nothing).collect()}) == 1


def test_toxicity_of_few_labels_and_of_rare_words(spark):
    """No toxic word is in 28 labelled toxic texts, by which a fixed bound of 5.5 would find it."""
    letters = lambda k: "".join(chr(97 + int(c)) for c in f"{k:03d}")
    for texts, kinds, many in ((160, 3, 3), (500, 20, 3)):
        rng = random.Random(kinds)
        calm, rude = [f"calm{letters(i)}" for i in range(200)], [f"{letters(i * 37)}vile" for i in range(kinds)]
        rows, labels = [], []
        for i in range(texts):
            words = [rng.choice(calm) for _ in range(rng.randrange(20, 60))]
            for k in rng.sample(range(len(words)), many if i % 5 == 0 else 0):
                words[k] = rng.choice(rude)
            rows.append((i, " ".join(words)))
            labels.append((i, int(i % 5 == 0)))
        known = [x for x in labels if x[0] % 4]
        assert all(sum(w in rows[i][1] for i, toxic in known if toxic) < 28 for w in rude)
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = score_toxicity(df, fit_toxicity(df, spark.createDataFrame(known, "doc_id bigint, toxic int"))).collect()
        held = [r for r in got if r.doc_id % 4 == 0]
        assert sum((r.score >= 0.3) == (r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)
        assert all(r.passages for r in held if r.doc_id % 5 == 0 and r.score >= 0.3)


def naive_put(bins, capacity, size, source, cluster):
    fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= size and source not in b["sources"] and cluster not in b["clusters"] and b["room"] > 0]
    if not fits:
        bins.append({"room": capacity, "sources": set(), "clusters": set()})
        fits = [(capacity, len(bins) - 1)]
    k = min(fits)[1]
    bins[k]["room"] -= size
    bins[k]["sources"].add(source)
    bins[k]["clusters"].add(cluster)
    return k


def test_best_fit_is_the_tightest_compatible_bin():
    rng = random.Random(8)
    for _ in range(20):
        bins, naive = Bins(100), []
        for i in range(200):
            size, source, cluster = rng.randrange(0, 101), rng.randrange(6), rng.randrange(30)
            assert bins.put(size, 1 << source, 1 << cluster) == naive_put(naive, 100, size, source, cluster), i


def test_packing_is_whole_and_free_of_conflicts(docs, texts, empty):
    from pyspark.sql import functions as F

    out = best_fit_bins(docs, F.length("text"), 500, cluster=F.col("text"), shard_rows=40).collect()
    every = texts | {121: None}
    pieces, held = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append((r.begin, r.size, r.piece))
        held.setdefault((r.shard, r.bin), []).append(r)
    for i, t in every.items():
        at = 0
        for k, (begin, size, piece) in enumerate(sorted(pieces.pop(i))):
            assert (begin, piece) == (at, k)
            at += size
        assert at == len(t or "")
    assert not pieces
    for rows in held.values():
        assert sum(r.size for r in rows) <= 500
        sources = [f"src{r.doc_id % 3}" for r in rows if r.doc_id % 5 and r.doc_id != 121]
        words = [every[r.doc_id] for r in rows if every[r.doc_id] is not None]
        assert len(set(sources)) == len(sources) and len(set(words)) == len(words)
    assert best_fit_bins(empty, "n", 10).count() == 0


def test_packing_repeated_and_null_rows(spark):
    rows = [(None, 5, "a"), (None, 5, "a"), (1, 25, None), (1, 25, None), (2, None, "b")]
    out = best_fit_bins(spark.createDataFrame(rows, "doc_id bigint, size bigint, source string"), "size", 10).collect()
    assert sorted((r.doc_id or 0, r.piece, r.size) for r in out) == sorted([(0, 0, 5)] * 2 + [(1, 0, 10), (1, 1, 10), (1, 2, 5)] * 2 + [(2, 0, 0)])
    assert len({(r.shard, r.bin) for r in out if r.doc_id is None}) == 2
    assert len({(r.shard, r.bin) for r in out if r.doc_id == 1 and r.piece < 2}) == 4
