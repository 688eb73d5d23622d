"""Toxic passages by maximum-scoring segments over token log-odds.

Model. Tokens are lowered runs of letters; each stands for itself and for its beginnings of
4 to 9 bytes, hashed to a table of fixed size. A feature's score is its log-odds between the
classes under an informative Dirichlet prior (the counts of both classes together), where its
z reaches a bound; the bound is the one of ``BOUNDS`` with the smallest log loss in a
cross-validation inside the labels, so it follows their number. A token takes the score of its longest significant feature, less a drift, so
that text without toxic words runs downhill.

Search. All maximal scoring segments of a text are found in one pass over its tokens. A
segment of score S in a text of n tokens has the extreme-value p-value
``1 - exp(-K n exp(-lambda S))``; lambda solves the score equation on clean tokens, K is
fitted on clean texts that the features were not counted on, as is the curve below. Segments under the significance level are the passages; the p-value
of the best few together, by the law of sums of such scores, gives the text's score through
a one-variable logistic curve.

The classifier is fitted on at most ``SAMPLE_ROWS`` labelled rows, evenly drawn by a hash of
their ids. Only that sample of labels, the feature table and a few numbers are broadcast.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from math import lgamma, log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import wordspans
from skein.llm.tables import cut, given, ship
from skein.llm.wordspans import mix, slices, split_words

BUCKETS = 1 << 20
#: Most labelled rows that the classifier is fitted on.
SAMPLE_ROWS = 20_000
BEGINNINGS = (9, 8, 7, 6, 5, 4)
#: Weight of the prior as a share of all counts.
PRIOR_SHARE = 0.05
HIGHEST, DRIFT = 8.0, 0.4
#: Bounds for |z| that cross-validation chooses from, and its parts.
BOUNDS = tuple(x / 2 for x in range(2, 14))
FOLDS = 5
#: Columns of counts: clean and toxic texts of each part.
COUNTS = [f"{label}{fold}" for fold in range(FOLDS) for label in ("clean", "toxic")]
#: Segments whose joint evidence the curve is fitted on; scoring goes on while more add to it.
JOINED = 8
SIGNIFICANT = 1e-3

#: Bytes outside words: everything in ASCII but letters.
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

@dataclass
class Fit:
    """What scoring needs: the feature scores (0: not significant), the tail of clean texts and the logistic curve."""

    score: np.ndarray
    lam: float = 1.0
    k: float = 1.0
    slope: float = 1.0
    offset: float = -2.0


def features(column: pa.Array) -> tuple[wordspans.Words, np.ndarray]:
    """Words of the texts and their feature buckets, one row per kind of feature."""
    words = split_words(column, lower=True, white=NOT_LETTER)
    up, down = wordspans.powers(len(words.data) + 1)
    total = np.zeros(len(words.data) + 1, dtype=np.uint64)
    np.cumsum((words.data + np.uint64(1)) * up[: len(words.data)], out=total[1:])
    out = np.empty((1 + len(BEGINNINGS), len(words.starts)), dtype=np.int32)
    mask = np.uint64(BUCKETS - 1)
    for row, size in enumerate((None, *BEGINNINGS)):
        ends = words.ends if size is None else np.minimum(words.starts + size, words.ends)
        own = mix((total[ends] - total[words.starts]) * down[words.starts] + np.uint64(row))
        out[row] = (own & mask).astype(np.int32)
    return words, out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of clean and of toxic texts with each feature, by part of the labels."""
    seen = np.zeros((FOLDS, 2, BUCKETS), dtype=np.int32)
    for batch in batches:
        for part in slices(batch, "text"):
            words, buckets = features(part.column("text"))
            labels = zip(part.column("fold").to_pylist(), part.column("toxic").to_pylist(), strict=True)
            for (fold, label), a, b in zip(labels, words.first[:-1], words.first[1:], strict=True):
                seen[fold, label][np.unique(buckets[:, a:b])] += 1
    seen = seen.reshape(2 * FOLDS, BUCKETS)
    at = np.flatnonzero(seen.any(axis=0))
    for some in np.array_split(at, 1 + len(at) // 65_536) if len(at) else ():
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *map(pa.array, seen[:, some])], ["bucket", *COUNTS])


def log_odds(clean: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds with a Dirichlet prior in the proportions of both classes together, and their z."""
    both = clean + toxic
    prior = PRIOR_SHARE * (both + 0.01)
    mass = prior.sum()

    def odds(x: np.ndarray) -> np.ndarray:
        return np.log((x + prior) / np.maximum(x.sum() + mass - x - prior, 1e-9))

    delta = odds(toxic) - odds(clean)
    return delta, delta / np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))


def feature_scores(delta: np.ndarray, z: np.ndarray, bound: float) -> np.ndarray:
    return np.where(np.abs(z) >= bound, np.clip(delta, -1.0, HIGHEST), 0.0).astype(np.float32)


def token_scores(buckets: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Score of each token: its longest significant feature's, less the drift."""
    best = score[buckets[0]]
    for row in buckets[1:]:
        best = np.where(best == 0, score[row], best)
    return best - np.float32(DRIFT)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (begin, end, score), in order; linear in the tokens.

    Candidates are kept on a stack with the sums before and after them. A new positive run
    is joined to the nearest candidate that starts lower, if that one also ends lower.
    """
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    breaks = np.flatnonzero(np.diff(up) > 1) + 1
    stack: list[list] = []  # begin, end, sum before, sum after, nearest candidate that starts lower
    for run in np.split(up, breaks):
        begin, end = int(run[0]), int(run[-1]) + 1
        left, right = sums[begin], sums[end]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append([begin, end, left, right, j])
                break
            begin, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(b, e, float(after - before)) for b, e, before, after, _ in stack]


def top_sums(found: list[tuple[int, int, float]], least: float = np.inf) -> np.ndarray:
    """Sum of the best segment's score, of the best two's, and so on: JOINED sums, and more while scores exceed ``least``."""
    best = sorted((s for *_, s in found), reverse=True)
    best = best[: max(JOINED, sum(s > least for s in best))]
    return np.cumsum(best + [0.0] * (JOINED - len(best)))


def _best(batches: Iterator[pa.RecordBatch], models) -> Iterator[pa.RecordBatch]:
    """Number of tokens of each text and, for each bound, sums of its best segment scores by the other parts' features."""
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            words, buckets = features(part.column("text"))
            tops = []
            for fold, a, b in zip(part.column("fold").to_pylist(), words.first[:-1], words.first[1:], strict=True):
                if fold not in tables:
                    tables[fold] = delta, z = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
                    at, delta[at], z[at] = models.value[fold]
                own = np.unique(buckets[:, a:b], return_inverse=True)
                delta, z = (x[own[0]] for x in tables[fold])
                places = own[1].reshape(len(buckets), -1)
                tops.append(np.concatenate([top_sums(segments(token_scores(places, feature_scores(delta, z, x)))) for x in BOUNDS]))
            columns = [pa.array(words.counts, pa.int64()), pa.array(tops, pa.list_(pa.float64())), part.column("toxic")]
            yield pa.RecordBatch.from_arrays(columns, ["n", "tops", "toxic"])


def lambda_of(scores: np.ndarray, weights: np.ndarray) -> float:
    """lambda from the clean tokens' score distribution."""
    scores, same = np.unique(scores, return_inverse=True)
    weights = np.bincount(same, weights, minlength=len(scores))
    if not (scores > 0).any() or (scores * weights).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    value = lambda lam: float((weights * np.exp(np.minimum(lam * scores, 80))).sum() / weights.sum())
    while value(high) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 1 else (low, middle)
    return (low + high) / 2


def tail_p(top, n, fit: Fit):
    """p-value of a best segment score in a text of ``n`` tokens."""
    return -np.expm1(-fit.k * np.maximum(n, 1) * np.exp(-fit.lam * np.asarray(top, dtype=np.float64)))


def strength(sums: np.ndarray, n: np.ndarray, fit: Fit) -> np.ndarray:
    """-log10 of the smallest p-value of the best r segments together, over r, at most 30.

    The sum of the r best normalised scores exceeds x with probability of about
    ``exp(-x) x^(r-1) / (r! (r-1)!)``; r itself costs a factor of 2^r.
    """
    size = np.log(np.maximum(fit.k * np.maximum(n, 1), 1e-12))
    best = -np.log10(np.maximum(tail_p(sums[:, 0], n, fit), 1e-300)) - log10(2)
    for r in range(2, sums.shape[1] + 1):
        x = fit.lam * sums[:, r - 1] - r * size
        # Beyond JOINED only far in the tail, where the law holds for many segments.
        real = (sums[:, r - 1] > sums[:, r - 2]) & (x > (r if r <= JOINED else r * r))
        spread = (x - (r - 1) * np.log(np.maximum(x, 1.0)) + lgamma(r + 1) + lgamma(r)) / log(10) - r * log10(2)
        best = np.where(real, np.maximum(best, spread), best)
    return np.clip(best, 0.0, 30.0)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of P(y) over x by Newton steps; the slope is not negative."""
    w = np.zeros(2)
    design = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + ridge * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] >= 0 else (0.0, float(w[1]))


def log_loss(x: np.ndarray, y: np.ndarray, slope: float, offset: float) -> float:
    p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
    return float(-np.log(np.where(y == 1, p, 1 - p)).mean())


def choose(seen: np.ndarray, models: list, n: np.ndarray, tops: np.ndarray, toxic: np.ndarray) -> Fit:
    """The fit on all parts at the bound with the smallest log loss; the largest such bound.

    ``seen`` has the counts by part and class, ``models`` the features, log-odds and
    z without each part, ``tops`` each text's sums by bound, from the features of the other parts.
    """
    found = []
    clean = toxic == 0
    held = [own[0, at] for own, (at, *_) in zip(seen, models, strict=True)]
    weights = np.concatenate([*held, [seen[:, 0].sum(dtype=np.float64) - sum(x.sum(dtype=np.float64) for x in held)]])
    for k, bound in enumerate(BOUNDS):
        sums = tops[:, k]
        scores = np.concatenate([*(feature_scores(delta, z, bound) for _, delta, z in models), [0.0]]) - DRIFT
        lam = lambda_of(scores, weights)
        rest = float((n * np.exp(-lam * sums[:, 0]))[clean].sum())
        tail = Fit(np.zeros(0), lam, max(1e-12, clean.sum() / rest) if rest > 0 else 1.0)
        x = strength(sums, n, tail)
        curve = logistic(x, toxic.astype(float))
        found.append((log_loss(x, toxic, *curve), -bound, lam, tail.k, *curve))
    _, bound, *rest = min(found)
    return Fit(feature_scores(*log_odds(*seen.sum(axis=0, dtype=np.float64)), -bound), *rest)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> Fit:
    """Fit on at most ``sample_rows`` rows of ``labels`` (those with the smallest id hashes).

    Labels that are null, other than 0 and 1, or without a document are not used. Without
    any toxic or any clean row the fit gives every text the same score.
    """
    spark = docs.sparkSession
    known = given(labels, doc_id=id_col, toxic=labels[label_col].cast("int")).filter("toxic IN (0, 1) AND doc_id IS NOT NULL")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)
    rows = given(docs, doc_id=id_col, text=text_col).join(F.broadcast(sample), "doc_id").select("text", "toxic")
    # Copies are one text, lest they pass for evidence.
    rows = cut(rows.withColumn("h", F.xxhash64("text", "toxic")).dropDuplicates(["h"]).withColumn("fold", F.pmod("h", F.lit(FOLDS)).cast("int")).drop("h"))
    counts = rows.mapInArrow(_counts, ", ".join(["bucket int", *(f"{c} int" for c in COUNTS)]))
    counts = counts.groupBy("bucket").agg(*[F.sum(c).cast("int").alias(c) for c in COUNTS]).toArrow()
    seen = np.zeros((2 * FOLDS, BUCKETS), dtype=np.float32)
    for own, name in zip(seen, COUNTS, strict=True):
        own[counts["bucket"].to_numpy()] = counts[name].to_numpy()
    del counts
    seen = seen.reshape(FOLDS, 2, BUCKETS)
    every = seen.sum(axis=0)
    if not every[0].any() or not every[1].any():
        return Fit(np.zeros(BUCKETS, np.float32), slope=0.0, offset=-4.0)
    models = []
    for own in seen:
        delta, z = log_odds(*(every - own).astype(np.float64))
        at = np.flatnonzero(np.abs(z) >= BOUNDS[0])
        models.append((at.astype(np.int32), delta[at].astype(np.float32), z[at].astype(np.float32)))
    shared = spark.sparkContext.broadcast(models)
    best = rows.mapInArrow(lambda batches: _best(batches, shared), "n bigint, tops array<double>, toxic int").toArrow()
    tops = best["tops"].combine_chunks().flatten().to_numpy().reshape(-1, len(BOUNDS), JOINED)
    return choose(seen, models, best["n"].to_numpy(), tops, best["toxic"].to_numpy())


def _scored(batches: Iterator[pa.RecordBatch], fit) -> Iterator[pa.RecordBatch]:
    model = Fit(**fit.value)
    fields = [("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]
    for batch in batches:
        for part in slices(batch, "text"):
            words, buckets = features(part.column("text"))
            scores = token_scores(buckets, model.score)
            tops, passages = [], []
            for a, b in zip(words.first[:-1], words.first[1:], strict=True):
                found = segments(scores[a:b])
                # A segment below this adds nothing to the evidence of those before it.
                tops.append(top_sums(found, log(max(1.0, model.k * max(1, b - a))) / model.lam))
                own = []
                for begin, end, value in found:
                    p = float(tail_p(value, b - a, model))
                    if p <= SIGNIFICANT:
                        own.append({"begin": begin, "end": end, "score": value, "p_value": p})
                passages.append(own)
            widest = max(map(len, tops))
            padded = np.stack([np.pad(t, (0, widest - len(t)), mode="edge") for t in tops])
            x = strength(padded, words.counts, model)
            chance = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))
            columns = [
                part.column("doc_id"),
                pa.array(chance, pa.float64()),
                pa.array(words.counts, pa.int64()),
                pa.array(passages, pa.list_(pa.struct(fields))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "n_tokens", "passages"])


def score_toxicity(docs: DataFrame, fit: Fit, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, n_tokens, passages`` of every row.

    ``passages`` are the significant segments as (begin, end, score, p_value), counted in
    tokens. Null and empty texts have no tokens and the score of a text without toxic
    words. Ids may repeat or be null; an empty table gives an empty result; other columns
    are ignored.
    """
    source = given(docs, doc_id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(asdict(fit))  # plain values: workers need not have this package
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        lambda batches: _scored(batches, shared),
        f"doc_id {kind}, score double, n_tokens bigint, "
        "passages array<struct<begin:bigint,end:bigint,score:double,p_value:double>>",
    )


ship(wordspans, sys.modules[__name__])
